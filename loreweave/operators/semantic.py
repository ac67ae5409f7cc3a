"""Search by meaning over index records and texts: stored mock vectors, filters before the top k, payloads, anchors, file graphs.

Vectors are those of the offline embedder. Queries are records whose id is divisible by 100, against all rows; a text without words
has no vector and is no hit. The filters come before the top k, so k rows come out where there are k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE, plain_path
from ..session import checkpoints, first_by, nth, spread, table
from .graph import connected_components
from .search import KEYWORDS, QUESTION, dense_vector, keyword_topk, nearest_to_question, ranked, rrf
from .vectors import QUERY_EVERY, knn

def record_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors of the index records with what filters need; no texts. Repeated rows count once."""
    checkpoints(spark)
    rows = spread(table(spark, d, "chunks").select("id", "kind", "project", "file_path", "lang", "content"), "id")
    c = rows.select("id", "kind", "project", plain_path(F.col("file_path")).alias("path"), F.lower(F.trim("lang")).alias("lang"), dense_vector("content").alias("vec"))
    return first_by(c, ["id"], F.xxhash64("vec")).where("vec is not null").checkpoint()


def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id").select("doc_id", dense_vector("text").alias("vec")).where("vec is not null")


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the queries' records as they are stored, by component; zeros left out."""
    v = record_vectors(spark, d).where(f"id % {QUERY_EVERY} = 0").select("id", F.posexplode("vec").alias("bucket", "value")).where("value <> 0")
    return v.select("id", F.col("bucket").cast("bigint").alias("bucket"), F.col("value").cast("bigint").alias("value"))


def with_payload(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """Hits with what a reader is shown; records that left the index meanwhile vanish."""
    c = table(spark, d, "chunks").select("id", "func_name", "line_start", "line_end", F.trim(F.regexp_replace(F.substring("content", 1, 200), r"\n", " ")).alias("preview"))
    joined = hits.join(c, "id")
    return first_by(joined.drop("vec"), ["id"], F.xxhash64("preview", "func_name"))


def _search(spark: SparkSession, d: str, where: str, k: int, least: float) -> DataFrame:
    hits = nearest_to_question(record_vectors(spark, d).where(where), "id", k, least)
    return with_payload(spark, d, hits).select("id", "kind", "lang", "path", "func_name", "score", F.md5("preview").alias("preview_md5"))


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """All kinds, journals left out."""
    return _search(spark, d, "not (kind = 'wiki' and coalesce(lang, '') = 'session')", 20, 0.1)


def semantic_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one type only."""
    return _search(spark, d, "kind = 'wiki' and lang = 'concept'", 10, 0.0)


def semantic_code(spark: SparkSession, d: str, language: str = "python", most_lines: int = 5_000) -> DataFrame:
    """Code of a language by meaning if every page job is ready, else by words; the level by size and the reason stand beside each hit."""
    state = table(spark, d, "wiki_jobs").agg(F.max(F.when(F.col("state") == "failed", 1).otherwise(0)).alias("failed"))  # one row
    lines = table(spark, d, "chunks").where("kind = 'code'").agg(F.sum("line_end").alias("n"))  # one row
    level = F.when(F.col("failed") == 0, 2).when(F.col("n") < most_lines, 0).otherwise(1)
    why = F.when(F.col("failed") == 0, "ready").otherwise("failed jobs")
    vectors = nearest_to_question(record_vectors(spark, d).where(f"kind = 'code' and lang = '{language}'"), "id", 10, -1.0).select("id", "score", F.lit("vector").alias("channel"))
    code = table(spark, d, "chunks").where("kind = 'code'").where(F.lower(F.trim("lang")) == language).select("id", "content").dropDuplicates(["id"])
    words = keyword_topk(code, "content", KEYWORDS, ["id"]).select("id", F.col("score").cast("double").alias("score"), F.lit("words").alias("channel"))
    gate = F.broadcast(state.join(lines))
    return vectors.unionByName(words).join(gate).where((F.col("channel") == "vector") == (F.col("failed") == 0)).select("id", "score", "channel", level.cast("bigint").alias("level"), why.alias("why"))


def semantic_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Journals by what was asked in them."""
    s = table(spark, d, "sessions").dropDuplicates(["id"]).select("id", dense_vector(F.array_join("prompts", " ")).alias("vec")).where("vec is not null")
    return nearest_to_question(s, "id", 15, 0.0, "why does the backlink graph drop the snapshot").select("id", "score")


def _neighbours(v: DataFrame, k: int) -> DataFrame:
    return knn(v, v.where(f"id % {QUERY_EVERY} = 0"), "id", "vec", k, digits=9).checkpoint()


def record_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest records of each query with the files of both."""
    v = record_vectors(spark, d)
    f = v.select("id", "project", "path")
    n = _neighbours(v, 5).join(f.select(F.col("id").alias("query_id"), F.col("path").alias("query_path")), "query_id").join(f.select(F.col("id").alias("neighbour"), "path"), "neighbour")
    return n.select("query_id", "query_path", "neighbour", "path", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def file_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files by their nearest records: best score, and whether it is strong by the adaptive threshold (the score at 0.85 of all pairs, and 0.1 more)."""
    v = record_vectors(spark, d)
    f = v.select("id", F.concat_ws(":", "project", "path").alias("file"))
    n = _neighbours(v, 4).join(f.select(F.col("id").alias("query_id"), F.col("file").alias("x")), "query_id").join(f.select(F.col("id").alias("neighbour"), F.col("file").alias("y")), "neighbour")
    pairs = n.where("x <> y").groupBy(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b")).agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("edges")).checkpoint()
    cut = nth(pairs, "score", F.least(F.floor(F.col("n") * 0.85), F.col("n") - 1), ties=["file_a", "file_b"]).withColumnRenamed("score", "cut")
    edge = F.when(F.col("score") >= F.col("cut") + 0.1, "strong").when(F.col("score") >= F.col("cut"), "kept").otherwise("below")
    return pairs.join(F.broadcast(cut)).select("file_a", "file_b", "score", "edges", edge.alias("edge"))


def _text_neighbours(spark: SparkSession, d: str, records: DataFrame, k: int) -> DataFrame:
    """Records next to texts: every hundredth text against all records of all kinds."""
    return knn(records.withColumnRenamed("id", "rid"), text_vectors(spark, d).where(f"doc_id % {QUERY_EVERY} = 0"), "rid", "vec", k, own="doc_id", digits=9)


def anchors(spark: SparkSession, d: str, k: int = 6, least: float = 0.3, most: int = 3) -> DataFrame:
    """Code that texts lean on: among the nearest records of all kinds, the first ``most`` code records with the score."""
    v = record_vectors(spark, d)
    n = _text_neighbours(spark, d, v, k).join(v.where("kind = 'code'").select(F.col("id").alias("neighbour"), "path"), "neighbour").where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return n.withColumn("place", place.cast("bigint")).where(f"place <= {most}").select(F.col("query_id").alias("doc_id"), "neighbour", "path", F.round("score", 6).alias("score"), "place")


def isolated_texts(spark: SparkSession, d: str, least: float = 0.8) -> DataFrame:
    """Queried texts that name no indexed file and have no record as near as ``least``."""
    q = text_vectors(spark, d).where(f"doc_id % {QUERY_EVERY} = 0").select("doc_id")
    near = _text_neighbours(spark, d, record_vectors(spark, d), 1).where(F.col("score") >= least).select(F.col("query_id").alias("doc_id"))
    names = table(spark, d, "documents").where(f"doc_id % {QUERY_EVERY} = 0").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EDGE + r"([A-Za-z0-9_-]+\.(?:py|go|ts|js|rs|rb|java|sh|c|h))" + EDGE), 1)).alias("name"))
    files = table(spark, d, "chunks").select(F.regexp_extract(plain_path(F.col("file_path")), r"([^/]*)$", 1).alias("name")).distinct()
    return q.join(near, "doc_id", "left_anti").join(names.join(files, "name").select("doc_id"), "doc_id", "left_anti")


def semantic_groups(spark: SparkSession, d: str, least: float = 0.85) -> DataFrame:
    """Records that near pairs join: one row per queried record or partner of one, with its group."""
    e = _neighbours(record_vectors(spark, d), 5).where(F.col("score") >= least).select(F.col("query_id").alias("a"), F.col("neighbour").alias("b"))
    return connected_components(e).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def hybrid_records(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    """Words and meaning fused over pages, with the pool three times the limit and at least 20; a channel without hits leaves the other alone."""
    pool = max(3 * limit, 20)
    pages = table(spark, d, "chunks").where("kind = 'wiki'").select("id", "content").dropDuplicates(["id"])
    words = ranked(keyword_topk(pages, "content", KEYWORDS, ["id"], pool).select("id", "score"), F.desc("score"), "id")
    near = ranked(nearest_to_question(record_vectors(spark, d).where("kind = 'wiki'"), "id", pool, -1.0).select("id", "score"), F.desc("score"), "id")
    both = rrf(words, near, "id")
    channel = F.when(F.col("rb").isNull(), "keyword").when(F.col("ra").isNull(), "vector").otherwise("both")
    return both.select("id", "rrf", channel.alias("channels")).orderBy(F.desc("rrf"), "id").limit(limit)


QUERIES = {
    "stored_vectors": stored_vectors, "semantic_search": semantic_search, "semantic_pages": semantic_pages, "semantic_code": semantic_code, "semantic_sessions": semantic_sessions, "record_neighbours": record_neighbours,
    "file_graph": file_graph, "anchors": anchors, "isolated_texts": isolated_texts, "semantic_groups": semantic_groups, "hybrid_records": hybrid_records,
}

_P = r"regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '')"
_V = r"""(select id, list(coalesce(v, 0)::double order by b) as vec from (select id, b, v from (select distinct id from W) cross join (select unnest(range(64)) as b) left join (select id, b, sum(s) as v from W group by all) using (id, b)) group by id having list_dot_product(list(coalesce(v, 0)::double order by b), list(coalesce(v, 0)::double order by b)) > 0)"""
_WORDS = r"""(select id, ('0x' || substr(md5(w), 31, 2))::int % 64 as b, case when ('0x' || substr(md5(w), 29, 2))::int % 2 = 1 then 1 else -1 end as s from (select id, unnest(regexp_split_to_array(lower(t), '[ \t\n\f\r\v]+')) as w from TEXTS) where w <> '')"""


def _vec(texts: str) -> str:
    return _V.replace("W", _WORDS.replace("TEXTS", texts))


_C = f"(select distinct on (id) *, {_P} as path, lower(trim(lang)) as plain from chunks)"
_RV = f"(select id, kind, project, path, plain as lang, vec from {_vec('(select distinct on (id) id, content as t from chunks)')} join {_C} using (id))"
_QV = lambda q: _vec(f"(select 0 as id, '{q}' as t)")
_NEAR = "(select v.*, round(list_dot_product(v.vec, q.vec) / sqrt(list_dot_product(v.vec, v.vec) * list_dot_product(q.vec, q.vec)), 6) as score from {0} v, {1} q)"
_SHOWN = lambda where, k, least: f"select id, s.kind, s.lang, s.path, func_name, score, md5(trim(replace(substr(content, 1, 200), chr(10), ' '))) as preview_md5 from (select * from {_NEAR.format(_RV, _QV(QUESTION))} where {where} and score >= {least} order by score desc, id limit {k}) s join (select distinct on (id) id, func_name, content from chunks) using (id)"
_COS = "round(list_dot_product(q.vec, e.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(e.vec, e.vec)), 9)"
_KNN = lambda k: f"(with v as materialized (select id, vec from {_RV}) select * from (select *, row_number() over (partition by query_id order by score desc, neighbour)::bigint as rank from (select q.id as query_id, e.id as neighbour, {_COS} as score from v q join v e on q.id % 100 = 0 and e.id <> q.id)) where rank <= {k})"
_TKNN = lambda k: f"(with v as materialized (select id, vec from {_RV}), q as materialized {_vec('(select doc_id as id, text as t from documents where text is not null and doc_id % 100 = 0)')} select * from (select *, row_number() over (partition by query_id order by score desc, neighbour)::bigint as rank from (select q.id as query_id, e.id as neighbour, {_COS} as score from q, v e)) where rank <= {k})"
_KWC = " + ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in KEYWORDS)
_FILES = f"(select id, concat_ws(':', project, path) as file from {_C})"

SQL = {
    "stored_vectors": f"select id, b::bigint as bucket, v::bigint as value from (select id, unnest(range(64)) as b, unnest(vec) as v from {_RV} where id % 100 = 0) where v <> 0",
    "semantic_search": _SHOWN("not (kind = 'wiki' and coalesce(lang, '') = 'session')", 20, 0.1),
    "semantic_pages": _SHOWN("kind = 'wiki' and lang = 'concept'", 10, 0.0),
    "semantic_code": f"""with g as (select max((state = 'failed')::int) as failed from wiki_jobs), n as (select sum(line_end) as n from chunks where kind = 'code'), a as (select id, score, 'vector' as channel from {_NEAR.format(_RV, _QV(QUESTION))} where kind = 'code' and lang = 'python' order by score desc, id limit 10),
      w as (select id, score::double as score, 'words' as channel from (select id, ({_KWC})::bigint as score from (select distinct on (id) id, lower(content) as t from chunks where kind = 'code' and lower(trim(lang)) = 'python')) where score > 0 order by score desc, id limit 10)
      select id, score, channel, (case when failed = 0 then 2 when n < 5000 then 0 else 1 end)::bigint as level, case when failed = 0 then 'ready' else 'failed jobs' end as why from (select * from a union all select * from w), g, n where (channel = 'vector') = (failed = 0)""",
    "semantic_sessions": f"select id, score from {_NEAR.format(_vec('(select distinct on (id) id, array_to_string(prompts, chr(32)) as t from sessions)'), _QV('why does the backlink graph drop the snapshot'))} where score >= 0 order by score desc, id limit 15",
    "record_neighbours": f"select query_id, a.path as query_path, neighbour, b.path, round(score, 6) as score, rank from {_KNN(5)} n join {_C} a on a.id = query_id join {_C} b on b.id = neighbour",
    "file_graph": f"""with p as (select least(a.file, b.file) as file_a, greatest(a.file, b.file) as file_b, round(max(score), 6) as score, count(*)::bigint as edges from {_KNN(4)} n join {_FILES} a on a.id = query_id join {_FILES} b on b.id = neighbour where a.file <> b.file group by all),
      r as (select score, row_number() over (order by score, file_a, file_b) as k, count(*) over () as c from p), t as (select score as cut from r where k = least(floor(c * 0.85), c - 1) + 1)
      select file_a, file_b, score, edges, case when score >= cut + 0.1 then 'strong' when score >= cut then 'kept' else 'below' end as edge from p, t""",
    "anchors": f"select query_id as doc_id, neighbour, path, round(score, 6) as score, place from (select n.*, c.path, (row_number() over (partition by query_id order by rank))::bigint as place from {_TKNN(6)} n join {_C} c on c.id = neighbour and c.kind = 'code' where score >= 0.3) where place <= 3",
    "isolated_texts": rf"""with f as (select distinct regexp_extract({_P}, '([^/]*)$', 1) as name from chunks), m as (select doc_id, unnest(regexp_extract_all(text, '\b([A-Za-z0-9_-]+\.(?:py|go|ts|js|rs|rb|java|sh|c|h))\b', 1)) as name from documents where doc_id % 100 = 0)
      select distinct query_id as doc_id from {_TKNN(1)} where score < 0.8 and query_id not in (select doc_id from m where name in (select name from f))""",
    "semantic_groups": f"""with recursive n as materialized (select query_id as a, neighbour as b from {_KNN(5)} where score >= 0.85), e as materialized (select a, b from n union select b, a from n), r(node, reach) as (select distinct a, a from e union select r.node, e.b from r join e on r.reach = e.a)
      select node as id, min(reach) as group_id from r group by node""",
    "hybrid_records": f"""with w as (select id, row_number() over (order by score desc, id) as ra from (select id, ({_KWC})::bigint as score from (select distinct on (id) id, lower(content) as t from chunks where kind = 'wiki') where ({_KWC}) > 0 order by score desc, id limit 60)),
      m as (select id, row_number() over (order by score desc, id) as rb from (select id, score from {_NEAR.format(_RV, _QV(QUESTION))} where kind = 'wiki' order by score desc, id limit 60))
      select id, round(coalesce(1.0::double / (60 + ra), 0) + coalesce(1.0::double / (60 + rb), 0), 9) as rrf, case when rb is null then 'keyword' when ra is null then 'vector' else 'both' end as channels from w full join m using (id) order by rrf desc, id limit 20""",
}
