"""Retrieval evaluation: a lexical path ranking, recall, reciprocal rank, thresholds, percentiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import plain_path
from ..session import first_by, range_blocks, table

SPLITS = {"train": "training", "dev": "development", "eval": "evaluation"}


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Distinct judged queries with a plain split, the plain paths of their targets and the targets as they are."""
    q = table(spark, d, "dataset").select("id", "project", "query", "category", "split", "relevant", "added_at")
    once = first_by(q, ["id"], -F.coalesce(F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(0)), F.xxhash64(F.to_json("relevant")))
    s = F.lower(F.trim("split"))
    plain = F.when(s.startswith("train"), "training").when(s.startswith("dev"), "development").when(s.startswith("eval"), "evaluation").otherwise("none")
    paths = F.array_distinct(F.transform("relevant", lambda r: plain_path(r["path"])))
    return once.select("id", "project", "query", F.coalesce("category", F.lit("unknown")).alias("category"), plain.alias("split"), paths.alias("paths"), "relevant")


def rarest_and_best(queries: DataFrame, items: DataFrame, top: int, rarest: int = 3) -> tuple[DataFrame, DataFrame]:
    """The rarest words ``ws`` of each query, and the ``top`` items of each such set of words: ``item``, ``score`` (the sum of 1 / number of items with the word), ``rank``.

    ``queries``: ``query_id``, ``project``, ``word``. ``items``: ``project``, ``item`` (a struct in whose order ties stand), ``words`` (distinct).
    Queries of the same rarest words are one. Of the items that hold some of the words only the first ``top`` count: whatever stands behind
    them has no more of the words, or is one of the items that have more. So hits are not listed by query, but ``top`` of each group of words.
    """
    post = items.select("project", "item", "words", F.explode("words").alias("word"))
    df = post.groupBy("project", "word").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "word"))
    sets = queries.join(df, ["project", "word"]).withColumn("k", place).where(f"k <= {rarest}").groupBy("query_id", "project").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("ws"))
    some = [F.when(F.size("ws") > max(at), F.array(*[F.get("ws", F.lit(i)) for i in at])) for n in range(1, rarest + 1) for at in combinations(range(rarest), n)]
    wanted = sets.select("project", "ws").distinct()
    groups = wanted.select("project", "ws", F.explode(F.array_compact(F.array(*some))).alias("t"))
    once = groups.select("project", "t", F.col("t")[0]["word"].alias("word")).distinct()
    there = once.join(post, ["project", "word"]).where(F.forall("t", lambda x: F.array_contains("words", x["word"])))
    first = F.row_number().over(Window.partitionBy("project", "word", "t").orderBy("item"))
    firsts = there.withColumn("at", first).where(f"at <= {top}").groupBy("project", "word", "t").agg(F.collect_list("item").alias("items"))
    score = F.round(F.aggregate("t", F.lit(0.0), lambda s, x: s + F.lit(1.0) / x["df"]), 9)
    met = groups.join(firsts, ["project", "t"]).select("project", "ws", "items", score.alias("score")).repartition("project", "ws")
    found = met.select("project", "ws", F.explode("items").alias("item"), "score")
    rank = F.row_number().over(Window.partitionBy("project", "ws").orderBy(F.desc("score"), "item"))
    best = found.groupBy("project", "ws", "item").agg(F.max("score").alias("score")).withColumn("rank", rank).where(f"rank <= {top}")
    return sets, best


def best_by_rarest(queries: DataFrame, items: DataFrame, top: int, rarest: int = 3) -> DataFrame:
    """The ``top`` items of each query by its rarest words: ``query_id``, ``item``, ``score``, ``rank``."""
    sets, best = rarest_and_best(queries, items, top, rarest)
    return sets.join(best, ["project", "ws"]).select("query_id", "item", "score", "rank")


def _query_words(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select(F.col("id").alias("query_id"), "project", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"([a-z]{4,})"), 1))).alias("word"))


def _name_words(name: str) -> Column:
    spaced = F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"))
    return F.array_distinct(F.regexp_extract_all(spaced, F.lit(r"([a-z]{4,})"), 1)).alias("words")


def _by_path(files: DataFrame, *fields: str) -> DataFrame:
    return files.select("project", F.struct(*fields).alias("item"), _name_words("path"))


def path_ranking(spark: SparkSession, d: str, top: int = 5) -> DataFrame:
    """Files for each query by its three rarest words that stand in paths of the project: an inverted index, rare words count more.

    ``query_id``, ``path``, ``score``, ``rank``; ties by path.
    """
    files = table(spark, d, "chunks").where("kind = 'code'").select("project", plain_path(F.col("file_path")).alias("path")).distinct()
    best = best_by_rarest(_query_words(spark, d), _by_path(files, "path"), top)
    return best.select("query_id", "item.path", "score", "rank")


def ranking(spark: SparkSession, d: str) -> DataFrame:
    return path_ranking(spark, d).select("query_id", "path", "score", F.col("rank").cast("bigint").alias("rank"))


def per_query(spark: SparkSession, d: str) -> DataFrame:
    """Per query: rank of the first hit and the share of its targets within 1, 3 and 5."""
    targets = judged(spark, d).select("id", F.explode("paths").alias("path"))
    found = targets.join(path_ranking(spark, d).withColumnRenamed("query_id", "id"), ["id", "path"], "left")
    within = lambda k: F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("double")).alias(f"recall_{k}")
    return found.groupBy("id").agg(within(1), within(3), within(5), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall at 1, 3, 5 and reciprocal rank by split and category, with the totals of each split and of all."""
    rows = judged(spark, d).select("id", "split", "category").join(per_query(spark, d), "id")
    g = rows.rollup("split", "category").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "rr")])
    return g.select(F.coalesce("split", F.lit("*")).alias("split"), F.coalesce("category", F.lit("*")).alias("category"), "queries", "recall_1", "recall_3", "recall_5", "rr")


def no_answer(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a target: how many get no hit, by split."""
    none = judged(spark, d).where("size(paths) = 0").select("id", "split")
    hit = path_ranking(spark, d).select(F.col("query_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return none.join(hit, "id", "left").groupBy("split").agg(F.count("*").alias("queries"), F.count_if(F.col("hit").isNull()).alias("abstained"))


def threshold_fit(spark: SparkSession, d: str) -> DataFrame:
    """A score cutoff fitted on development rows only (the best score of a query without answer there), and what it does to every split."""
    best = path_ranking(spark, d).where("rank = 1").select(F.col("query_id").alias("id"), "score")
    rows = judged(spark, d).select("id", "split", (F.size("paths") > 0).alias("answerable")).join(best, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    cut = rows.where("split = 'development' and not answerable").agg(F.max("score").alias("cutoff"))  # one row
    taken = F.col("score") > F.col("cutoff")
    return rows.join(F.broadcast(cut)).groupBy("split").agg(
        F.count_if(taken & F.col("answerable")).alias("accepted"), F.count_if(~taken & F.col("answerable")).alias("lost"), F.count_if(taken & ~F.col("answerable")).alias("false_accepts"), F.count_if(~taken & ~F.col("answerable")).alias("abstained"), F.round(F.max("cutoff"), 6).alias("cutoff")
    )


def order_statistics(df: DataFrame, part: str, column: str, places: dict[str, Column]) -> DataFrame:
    """Per ``part`` the values at 1-based places of the ascending order (columns of the count ``n``), and ``n``; nulls are left out.

    Blocks of the order are counted, and only blocks that hold a place are numbered, so no task holds all values of a part.
    """
    placed = range_blocks(df.where(F.col(column).isNotNull()).select(F.col(part).alias("_p"), F.col(column).alias("_v")), ["_p", "_v"])
    counts = placed.groupBy("_p", "_block").agg(F.count("*").alias("c"))  # a row per part and block
    w = Window.partitionBy("_p")
    spans = counts.withColumn("before", F.coalesce(F.sum("c").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(w))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("bigint").alias("at")) for name, at in places.items()]))
    there = spans.select("_p", "_block", "before", "c", "n", wanted.alias("x")).where("before < x.at and x.at <= before + c").select("_p", "_block", "n", "x.name", (F.col("x.at") - F.col("before")).alias("_k"))
    hit = placed.join(there.select("_p", "_block").distinct(), ["_p", "_block"], "left_semi")
    numbered = hit.withColumn("_k", F.row_number().over(Window.partitionBy("_p", "_block").orderBy("_v")))
    found = numbered.join(there, ["_p", "_block", "_k"]).groupBy(F.col("_p").alias(part))
    return found.agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places])


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles, interpolated median and mean of the measured values by type."""
    e, n = table(spark, d, "events").select("event_type", "value"), F.col("n")
    at = order_statistics(e, "event_type", "value", {"p50": F.ceil(n * 0.5), "p95": F.ceil(n * 0.95), "low": F.floor((n - 1) / 2) + 1, "high": F.ceil((n - 1) / 2) + 1})
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return mean.join(at, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "mean")


def _by_unit(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("kind = 'code' and func_name is not null").select("id", "project", plain_path(F.col("file_path")).alias("path"), "line_start", "line_end", "func_name").dropDuplicates(["id"])
    return c.select("project", F.struct("path", "id", "line_start", "line_end").alias("item"), _name_words("func_name"))


def span_ranking(spark: SparkSession, d: str, top: int = 5) -> DataFrame:
    """Records for each query by its three rarest words that stand in names of units of the project: ``query_id``, ``id``, ``path``, ``line_start``, ``line_end``, ``score``, ``rank``."""
    best = best_by_rarest(_query_words(spark, d), _by_unit(spark, d), top)
    return best.select("query_id", "item.id", "item.path", "item.line_start", "item.line_end", "score", "rank")


def _file_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("kind = 'code'").groupBy("project", plain_path(F.col("file_path")).alias("path")).agg(F.max("line_end").alias("last"))


def hit_lists(spark: SparkSession, d: str, top: int = 5) -> DataFrame:
    """Hits of three methods as line spans: ``files`` by path words (the whole file), ``spans`` by unit names, and both ``fused`` by file, a row per query.

    A hit is ``rank``, ``path``, ``a``, ``b``, ``valid``: whether the lines are lines of the file. Hits are listed by set of rare words and reach
    a query as one list, so no table of single hits is shuffled or written. In the fusion a file has one vote a list, by its first
    rank; ties go to the path; spans of both lists stand for it, and one that isn't valid makes the hit invalid.
    """
    words, lines = _query_words(spark, d), _file_lines(spark, d)

    def listed(sets: DataFrame, hits: DataFrame, name: str) -> DataFrame:
        lists = hits.groupBy("project", "ws").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "a", "b", "valid"))).alias(name))
        return sets.join(lists, ["project", "ws"]).select("query_id", name)

    sets, best = rarest_and_best(words, _by_path(lines, "path", "last"), top)
    last = F.coalesce("item.last", F.lit(0))
    files = listed(sets, best.select("project", "ws", "rank", "item.path", F.lit(1).alias("a"), last.alias("b"), (last >= 1).alias("valid")), "files")
    sets, best = rarest_and_best(words, _by_unit(spark, d), top)
    parts = best.select("project", "ws", "rank", "item.path", F.col("item.line_start").alias("a"), F.col("item.line_end").alias("b")).join(lines, ["project", "path"], "left")
    spans = listed(sets, parts.withColumn("valid", F.coalesce((F.col("a") >= 1) & (F.col("a") <= F.col("b")) & (F.col("b") <= F.col("last")), F.lit(False))), "spans")
    none = F.array().cast("array<struct<rank:int,path:string,a:int,b:int,valid:boolean>>")
    both = files.join(spans, "query_id", "full").select("query_id", F.coalesce("files", none).alias("files"), F.coalesce("spans", none).alias("spans"))
    first = lambda c: F.array_distinct(F.transform(c, lambda h: h["path"])).alias(f"{c}_first")
    both = both.select("query_id", "files", "spans", first("files"), first("spans"), F.concat("files", "spans").alias("both"))
    vote = lambda c, p: F.when(F.array_contains(f"{c}_first", p), 1.0 / (60 + F.array_position(f"{c}_first", p))).otherwise(0.0)
    order = F.array_sort(F.transform(F.array_union("files_first", "spans_first"), lambda p: F.struct((-F.round(vote("files", p) + vote("spans", p), 9)).alias("rrf"), p.alias("path"))))
    of = lambda p: F.filter("both", lambda h: h["path"] == p)
    placed = F.transform(F.slice(order, 1, 5), lambda o, i: F.struct((i + 1).alias("rank"), o["path"].alias("path"), F.array_distinct(F.transform(of(o["path"]), lambda h: F.struct(h["a"].alias("a"), h["b"].alias("b")))).alias("ab"), F.forall(of(o["path"]), lambda h: h["valid"]).alias("valid")))
    both = both.select("query_id", "files", "spans", placed.alias("placed"))
    fused = F.flatten(F.transform("placed", lambda o: F.transform(o["ab"], lambda s: F.struct(o["rank"].alias("rank"), o["path"].alias("path"), s["a"].alias("a"), s["b"].alias("b"), o["valid"].alias("valid")))))
    return both.select("query_id", "files", "spans", fused.alias("fused"))


METHODS = ("files", "spans", "fused")


def by_method(lists: DataFrame, *rest: str) -> DataFrame:
    """A row per query and method with its list of ``hits``."""
    return lists.select("query_id", *rest, F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("hits")) for m in METHODS])))


def ranked_spans(spark: SparkSession, d: str) -> DataFrame:
    """The hits of ``hit_lists`` as rows: ``method``, ``query_id``, ``rank``, ``path``, ``a``, ``b``, ``valid``."""
    return by_method(hit_lists(spark, d)).select("method", "query_id", F.inline("hits"))


def fused_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = ranked_spans(spark, d).where("method = 'fused'")
    return r.groupBy("query_id", "path").agg(F.min("rank").cast("bigint").alias("rank"), F.count("*").alias("spans"), F.bool_and("valid").alias("valid"))


def span_judgements(spark: SparkSession, d: str) -> DataFrame:
    """Per method and query: its split, recall within 1, 3 and 5, reciprocal rank, whether a query without answer got none, invalid hits.

    A target is found by a valid hit on its path whose lines overlap the target's lines. Lists and targets of a query meet in one row.
    """
    target = F.transform("relevant", lambda r: F.struct(plain_path(r["path"]).alias("path"), r["start_line"].alias("s"), r["end_line"].alias("e")))
    q = judged(spark, d).where("id is not null").select(F.col("id").alias("query_id"), "split", (F.coalesce(F.size("relevant"), F.lit(0)) > 0).alias("answerable"), target.alias("targets"))
    rows = by_method(q.join(hit_lists(spark, d), "query_id", "left"), "split", "answerable", "targets")
    met = lambda t: F.filter("hits", lambda h: h["valid"] & (h["path"] == t["path"]) & (h["a"] <= t["e"]) & (h["b"] >= t["s"]))
    ranks = F.transform("targets", lambda t: F.array_min(F.transform(met(t), lambda h: h["rank"])))
    wrong = F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: ~h["valid"]), lambda h: h["rank"])))
    rows = rows.withColumn("hits", F.coalesce("hits", F.array().cast(rows.schema["hits"].dataType))).select("method", "query_id", "split", "answerable", ranks.alias("ranks"), F.size("hits").alias("n"), wrong.alias("invalid"))
    within = lambda k: F.when(F.col("answerable"), F.size(F.filter("ranks", lambda r: r <= k)) / F.size("ranks")).alias(f"recall_{k}")
    rr = F.when(F.col("answerable"), F.coalesce(1.0 / F.array_min("ranks"), F.lit(0.0))).alias("rr")
    return rows.select("method", "query_id", "split", "answerable", within(1), within(3), within(5), rr, F.when(~F.col("answerable"), F.col("n") == 0).alias("abstained"), "invalid")


def span_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The judgements by method and split, with the totals of each method."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    g = span_judgements(spark, d).rollup("method", "split").agg(
        F.count("*").alias("queries"), F.count_if("answerable").alias("answerable"), mean("recall_1"), mean("recall_3"), mean("recall_5"), mean("rr"),
        F.round(F.avg(F.col("abstained").cast("double")), 6).alias("no_answer_accuracy"), F.sum("invalid").alias("invalid"),
    )
    return g.where("method is not null").select("method", F.coalesce("split", F.lit("*")).alias("split"), "queries", "answerable", "recall_1", "recall_3", "recall_5", "rr", "no_answer_accuracy", "invalid")


QUERIES = {"ranking": ranking, "retrieval_metrics": retrieval_metrics, "no_answer": no_answer, "threshold_fit": threshold_fit, "latency_percentiles": latency_percentiles, "fused_ranking": fused_ranking, "span_metrics": span_metrics}

_P = r"regexp_replace(regexp_replace(replace({0}, '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '')"
_Q = f"""(select id, project, query, coalesce(category, 'unknown') as category, case when lower(trim(split)) like 'train%' then 'training' when lower(trim(split)) like 'dev%' then 'development' when lower(trim(split)) like 'eval%' then 'evaluation' else 'none' end as split,
  list_distinct(list_transform(relevant, lambda r: {_P.format('r.path')})) as paths from dataset qualify row_number() over (partition by id order by added_at desc nulls last) = 1)"""
_RANK = f"""(with q as (select id, project, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z]{{4,}}'))) as word from {_Q}),
  post as (select project, path, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(path, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z]{{4,}}'))) as word from (select distinct project, {_P.format('file_path')} as path from chunks where kind = 'code')),
  df as (select project, word, count(*) as df from post group by all),
  k as (select id, project, word, df from q join df using (project, word) qualify row_number() over (partition by id order by df, word) <= 3),
  h as (select id, path, round(sum(1.0::double / df), 9) as score from k join post using (project, word) group by all)
  select * from (select id as query_id, path, score, row_number() over (partition by id order by score desc, path)::bigint as rank from h) where rank <= 5)"""
_PER = f"""(select id, avg((coalesce(rank, 99) <= 1)::int::double) as recall_1, avg((coalesce(rank, 99) <= 3)::int::double) as recall_3, avg((coalesce(rank, 99) <= 5)::int::double) as recall_5, coalesce(1.0::double / min(rank), 0) as rr
  from (select id, unnest(paths) as path from {_Q}) t left join {_RANK} r on r.query_id = t.id and r.path = t.path group by id)"""
_CUT = f"(select id, split, len(paths) > 0 as answerable, coalesce(score, 0) as score from {_Q} q left join (select query_id, score from {_RANK} where rank = 1) b on b.query_id = q.id)"

_LAST = f"(select project, {_P.format('file_path')} as path, max(line_end) as last from chunks where kind = 'code' group by all)"
_SPANS = f"""(with q as (select id as query_id, project, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z]{{4,}}'))) as word from {_Q}),
  c as (select distinct on (id) id, project, {_P.format('file_path')} as path, line_start, line_end, func_name from chunks where kind = 'code' and func_name is not null),
  post as (select id, project, path, line_start, line_end, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(func_name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z]{{4,}}'))) as word from c),
  df as (select project, word, count(*) as df from post group by all), k as (select query_id, project, word, df from q join df using (project, word) qualify row_number() over (partition by query_id order by df, word) <= 3),
  h as (select query_id, project, id, path, line_start, line_end, round(sum(1.0::double / df), 9) as score from k join post using (project, word) group by all)
  select * from (select *, row_number() over (partition by query_id order by score desc, path, id)::bigint as rank from h) where rank <= 5)"""
_HITS = f"""(with whole as (select query_id, rank, path, 1 as a, coalesce(last, 0) as b, coalesce(last, 0) >= 1 as valid, 1 as l from (select r.*, q.project from {_RANK} r join {_Q} q on q.id = r.query_id) left join {_LAST} using (project, path)),
  parts as (select query_id, rank, path, line_start as a, line_end as b, coalesce(line_start >= 1 and line_start <= line_end and line_end <= last, false) as valid, 2 as l from {_SPANS} left join {_LAST} using (project, path)),
  both_ as (select * from whole union all select * from parts), v as (select query_id, l, path, row_number() over (partition by query_id, l order by min(rank)) as r from both_ group by query_id, l, path),
  f as (select query_id, path, row_number() over (partition by query_id order by round(sum(1.0::double / (60 + r)), 9) desc, path)::bigint as rank from v group by query_id, path)
  select 'files' as method, query_id, rank, path, a, b, valid from whole union all select 'spans', query_id, rank, path, a, b, valid from parts
  union all select distinct 'fused', query_id, f.rank, path, a, b, bool_and(valid) over (partition by query_id, path) from f join both_ using (query_id, path) where f.rank <= 5)"""

SQL = {
    "ranking": f"select * from {_RANK}",
    "retrieval_metrics": f"""select coalesce(split, '*') as split, coalesce(category, '*') as category, count(*)::bigint as queries, round(avg(recall_1), 6) as recall_1, round(avg(recall_3), 6) as recall_3, round(avg(recall_5), 6) as recall_5, round(avg(rr), 6) as rr
      from (select id, split, category from {_Q}) join {_PER} using (id) group by rollup (split, category)""",
    "no_answer": f"select split, count(*)::bigint as queries, count(*) filter (id not in (select query_id from {_RANK}))::bigint as abstained from {_Q} where len(paths) = 0 group by split",
    "threshold_fit": f"""with r as (select * from {_CUT}), c as (select max(score) as cutoff from r where split = 'development' and not answerable)
      select split, count(*) filter (score > cutoff and answerable)::bigint as accepted, count(*) filter (score <= cutoff and answerable)::bigint as lost, count(*) filter (score > cutoff and not answerable)::bigint as false_accepts, count(*) filter (score <= cutoff and not answerable)::bigint as abstained, round(max(cutoff), 6) as cutoff from r, c group by split""",
    "latency_percentiles": "select event_type, count(value)::bigint as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, round(quantile_cont(value, 0.5), 6) as median, round(avg(value), 6) as mean from events group by event_type",
    "fused_ranking": f"select query_id, path, min(rank)::bigint as rank, count(*)::bigint as spans, bool_and(valid) as valid from {_HITS} where method = 'fused' group by all",
    "span_metrics": f"""with h as materialized (select * from {_HITS}), q as (select id as query_id, relevant from dataset qualify row_number() over (partition by id order by added_at desc nulls last) = 1), m as (select unnest(['files', 'spans', 'fused']) as method),
      t as (select query_id, i as t, {_P.format('r.path')} as path, r.start_line as s, r.end_line as e from (select query_id, i, relevant[i] as r from (select query_id, relevant, unnest(range(1, len(relevant) + 1)) as i from q))),
      met as (select method, query_id, t, min(rank) as rank from t join h using (query_id, path) where valid and a <= e and b >= s group by all),
      sc as (select method, query_id, avg((coalesce(rank, 99) <= 1)::int::double) as r1, avg((coalesce(rank, 99) <= 3)::int::double) as r3, avg((coalesce(rank, 99) <= 5)::int::double) as r5, coalesce(1.0::double / min(rank), 0) as rr from (select * from t, m) left join met using (method, query_id, t) group by all),
      sh as (select method, query_id, count(*) as hits, count(*) filter (not valid) as invalid from (select distinct method, query_id, rank, path, valid from h) group by all),
      x as (select method, query_id, coalesce(len(relevant), 0) > 0 as answerable, r1, r3, r5, rr, case when coalesce(len(relevant), 0) = 0 then hits is null end as abstained, coalesce(invalid, 0) as invalid from (select * from q, m) left join sh using (method, query_id) left join sc using (method, query_id))
      select method, coalesce(split, '*') as split, count(*)::bigint as queries, count(*) filter (answerable)::bigint as answerable, round(avg(r1), 6) as recall_1, round(avg(r3), 6) as recall_3, round(avg(r5), 6) as recall_5, round(avg(rr), 6) as rr, round(avg(abstained::int::double), 6) as no_answer_accuracy, sum(invalid)::bigint as invalid
      from x join (select id as query_id, split from {_Q}) using (query_id) group by rollup (method, split) having method is not null""",
}
