"""The chunk index and its jobs: manifest differences, line windows, statistics, job states, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import plain_path
from ..session import checkpoints, first_by, running_sum, table
from ..sources.pages import BUILD, HIDDEN, SENSITIVE, discovery_reason

CUT = "2026-06-01"


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct index records with the columns asked for."""
    return table(spark, d, "chunks").select("id", *columns).dropDuplicates(["id"])


def manifest(rows: DataFrame) -> DataFrame:
    """One line per file: a hash over the revisions of its records, and their number."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.col("id").cast("string"), "content_sha")))  # the records of one file, a few each
    return rows.groupBy("project", "path").agg(F.md5(F.array_join(parts, ",")).alias("hash"), F.count("*").alias("records"))


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two snapshots: records seen before the cut against those modified since or unchanged."""
    c = chunks(spark, d, "project", "file_path", "content_sha", "last_modified").select("id", "project", plain_path(F.col("file_path")).alias("path"), "content_sha", "last_modified")
    old = manifest(c.where(f"last_modified is null or last_modified < timestamp '{CUT}' or id % 7 = 0"))
    new = manifest(c.where("id % 11 <> 0"))
    both = old.select("project", "path", F.col("hash").alias("old_hash")).join(new.select("project", "path", F.col("hash").alias("new_hash")), ["project", "path"], "full_outer")
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return both.groupBy("project", state.alias("state")).agg(F.count("*").alias("files"))


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The records of the next index: unchanged files keep theirs, added and changed ones bring new ones, deleted ones leave."""
    c = chunks(spark, d, "project", "file_path", "content_sha", "last_modified").select("id", "project", plain_path(F.col("file_path")).alias("path"), "content_sha", "last_modified")
    before, after = c.where(f"last_modified is null or last_modified < timestamp '{CUT}' or id % 7 = 0"), c.where("id % 11 <> 0")
    old, new = manifest(before).drop("records"), manifest(after).drop("records")
    same = old.join(new, ["project", "path", "hash"]).select("project", "path")
    kept = before.join(same, ["project", "path"], "left_semi").withColumn("origin", F.lit("kept"))
    fresh = after.join(same, ["project", "path"], "left_anti").withColumn("origin", F.lit("indexed"))
    return kept.unionByName(fresh).select("id", "project", "origin")


def line_windows(rows: DataFrame, key: str, text: str, size: int = 80, overlap: int = 10) -> DataFrame:
    """Windows of ``size`` lines that overlap by ``overlap``; the last one ends with the text."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), r"\n")
    step = size - overlap
    at = rows.where(F.length(text) > 0).select(key, lines.alias("ls"), F.explode(F.sequence(F.lit(0), F.greatest(F.size(lines) - overlap - 1, F.lit(0)), F.lit(step))).alias("s"))
    part = F.array_join(F.slice("ls", F.col("s") + 1, F.lit(size)), "\n")
    return at.select(key, (F.col("s") + 1).cast("bigint").alias("line_start"), F.least(F.col("s") + size, F.size("ls")).cast("bigint").alias("line_end"), part.alias("content"))


def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return line_windows(table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "line_start", "line_end", F.md5("content").alias("content_md5"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Records and characters by kind and language as spelled plainly, with subtotals in the same pass."""
    c = chunks(spark, d, "kind", "lang", "content").select("kind", F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("-")).alias("lang"), F.length("content").alias("n"))
    r = c.rollup("kind", "lang").agg(F.count("*").alias("records"), F.sum("n").cast("bigint").alias("chars"), F.grouping_id().cast("bigint").alias("level"))
    return r.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.when(F.col("level") > 0, "*").otherwise(F.col("lang")).alias("lang"), "records", "chars", "level")


def lines_by_ending(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "kind", "file_path", "content").where("kind = 'code'")
    ending = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    return c.groupBy(ending.alias("ending")).agg(F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).cast("bigint").alias("line_ends"), F.count("*").alias("records"))


def record_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each file: what a lookup by path answers."""
    c = chunks(spark, d, "project", "file_path", "kind", "func_name", "line_start").withColumn("path", plain_path(F.col("file_path"))).drop("file_path")
    return first_by(c.select("project", "path", "id", "kind", "func_name", "line_start"), ["project", "path"], F.col("id"))


def embed_text_stats(spark: SparkSession, d: str) -> DataFrame:
    """The input of the embedder per record: title line, type and path before the content, cut at 8000 characters."""
    c = chunks(spark, d, "kind", "file_path", "func_name", "lang", "content")
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("func_name", F.regexp_extract("file_path", r"([^/\\]*)$", 1))), F.concat(F.lit("Type: "), "kind"), F.concat(F.lit("Category: "), F.lower(F.trim("lang"))), "content")
    return c.select("id", F.md5(F.substring(text, 1, 8000)).alias("input_md5"), F.least(F.length(text), F.lit(8000)).cast("bigint").alias("chars"))


def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether what a judged query points at can be shown: the file is indexed, and its lines are within the file."""
    q = first_by(table(spark, d, "dataset").select("id", "project", "relevant", "added_at"), ["id"], -F.coalesce(F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(0)), F.xxhash64(F.to_json("relevant")))
    refs = q.select("id", "project", F.posexplode("relevant").alias("pos", "r")).select("id", "project", "pos", plain_path(F.col("r.path")).alias("path"), "r.start_line", "r.end_line")
    files = table(spark, d, "chunks").groupBy("project", plain_path(F.col("file_path")).alias("path")).agg(F.max("line_end").alias("last"))
    both = refs.join(files, ["project", "path"], "left")
    status = (
        F.when(F.col("path").isNull(), "no_path").when(F.col("last").isNull(), "unknown_file").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "bad_range")
        .when(F.col("start_line") > F.col("last"), "beyond_file").when(F.col("end_line") > F.col("last"), "end_clipped").otherwise("ok")
    )
    return both.select("id", F.col("pos").cast("bigint").alias("pos"), status.alias("status"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_jobs").dropDuplicates(["id"])


def job_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).groupBy("state").agg(F.count("*").alias("jobs"), F.max("attempts").cast("bigint").alias("most_attempts"), F.countDistinct("path").alias("paths"))


def failed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose latest job failed."""
    last = jobs(spark, d).groupBy("path").agg(F.max("id").alias("id"), F.max_by("state", "id").alias("state"), F.max_by("error", "id").alias("error"))
    return last.where("state = 'failed'").select("path", "id", "error")


def job_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue after every job of a page was enqueued in order of time: a job like its forerunner is a duplicate, a later different one supersedes those that wait."""
    j = jobs(spark, d).select("id", "path", "snapshot_sha", "fingerprint", "state", "created")
    w = Window.partitionBy("path").orderBy("created", "id")
    key = F.concat_ws("/", "snapshot_sha", "fingerprint")
    seen = j.withColumn("key", key).withColumn("before", F.lag("key").over(w)).withColumn("later", F.lead("key").over(w))
    fate = F.when(F.col("before") == F.col("key"), "duplicate").when(F.col("state").isin("pending", "retry") & F.col("later").isNotNull() & (F.col("later") != F.col("key")), "superseded").otherwise(F.col("state"))
    return seen.select("id", "path", fate.alias("fate"))


def job_finish(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of running jobs whose lease ran out: retry with doubled delay, failed after three attempts."""
    j = jobs(spark, d).where("state = 'running'")
    tries = F.coalesce("attempts", F.lit(0)) + 1
    return j.select("id", F.when(tries >= 3, "failed").otherwise("retry").alias("state"), tries.cast("bigint").alias("attempts"), F.when(tries < 3, F.col("updated") + F.pow(F.lit(2.0), tries)).alias("next_attempt"))


def greedy_batches(rows: DataFrame, part: str, key: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """Batches of each part's rows in order of the key, as many rows as fit both limits, at least one: ``part``, ``first``, ``rows``, ``size``.

    Each row knows where a batch that begins with it would end: within ``most_rows`` rows ahead by the running sum. Which rows do begin one follows
    from the first row of a part by doubling these steps, so a hot part is spread by row number and never one task.
    """
    checkpoints(rows.sparkSession)
    slim = rows.where(F.col(part).isNotNull()).select(F.col(part).alias("p"), F.col(key).alias("k"), F.coalesce(size, F.lit(0)).cast("bigint").alias("s"), F.lit(1).alias("one"))
    upto = running_sum(running_sum(slim, "p", ["k"], "one", "n"), "p", ["k"], "s", "sum").select("p", "k", "n", "s", "sum").checkpoint()
    ahead = upto.select("p", "n", F.col("sum").alias("end"))
    pairs = upto.select("p", (F.col("sum") - F.col("s")).alias("base"), F.col("n").alias("i"), F.explode(F.sequence(F.col("n"), F.col("n") + most_rows - 1)).alias("n")).join(ahead, ["p", "n"])
    fits = (F.col("end") - F.col("base") <= most_size) | (F.col("n") == F.col("i"))
    step = pairs.groupBy("p", "i").agg((F.max(F.when(fits, F.col("n"))) + 1).alias("j"), F.max_by(F.col("end") - F.col("base"), F.when(fits, F.col("n"))).alias("total")).checkpoint()
    jump, begun = step.select("p", "i", "j"), step.where("i = 1").select("p", "i")
    while True:
        begun = begun.unionByName(begun.join(jump, ["p", "i"]).select("p", F.col("j").alias("i"))).distinct().checkpoint()
        jump = jump.join(jump.select("p", F.col("i").alias("j"), F.col("j").alias("k")), ["p", "j"]).select("p", "i", F.col("k").alias("j")).checkpoint()
        if jump.isEmpty():
            break
    starts = step.join(begun, ["p", "i"]).join(upto.select("p", F.col("n").alias("i"), "k"), ["p", "i"])
    return starts.select(F.col("p").alias(part), F.col("k").alias("first"), (F.col("j") - F.col("i")).alias("rows"), F.col("total").alias("size"))


def embed_batches(spark: SparkSession, d: str, most_rows: int = 16, most_chars: int = 20_000) -> DataFrame:
    """Batches of each project's pages for the embedder, in order of id: as many as fit both limits, at least one."""
    p = chunks(spark, d, "kind", "project", "content").where("kind = 'wiki'").select("project", "id", F.length("content").alias("n"))
    return greedy_batches(p, "project", "id", "n", most_rows, most_chars).select("project", F.col("first").alias("first_id"), F.col("rows").cast("bigint").alias("rows"), F.col("size").alias("chars"))


def page_index_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether each page's embedding is ready, stale (modified since), building, failed or missing, by its latest job."""
    p = chunks(spark, d, "kind", "file_path", "last_modified").where("kind = 'wiki'").groupBy(plain_path(F.col("file_path")).alias("path")).agg(F.max("last_modified").alias("modified"))
    last = jobs(spark, d).groupBy("path").agg(F.max_by(F.struct("state", "updated"), F.struct("created", "id")).alias("j"))
    both = p.join(last, "path", "left")
    stale = F.col("j.updated") < F.unix_micros(F.col("modified").cast("timestamp")) / 1_000_000
    state = (
        F.when(F.col("j").isNull(), "missing").when(F.col("j.state") == "failed", "failed").when(F.col("j.state").isin("pending", "running", "retry"), "building")
        .when(F.coalesce(stale, F.lit(False)), "stale").otherwise("ready")
    )
    return both.select("path", state.alias("state"))


def job_retention(spark: SparkSession, d: str, days: int = 90) -> DataFrame:
    """Finished jobs older than ``days`` before the newest one that a clean-up removes, but the last of each page."""
    j = jobs(spark, d)
    last = j.groupBy("path").agg(F.max("id").alias("id"))
    newest = j.agg(F.max("updated").alias("newest"))  # one row
    old = j.join(F.broadcast(newest)).where(F.col("state").isin("done", "failed", "superseded") & (F.col("updated") < F.col("newest") - days * 86400.0))
    return old.join(last, "id", "left_anti").select("id", "path", "state")


def changed_since(spark: SparkSession, d: str, marker: str = "2026-09-01") -> DataFrame:
    """Records a run after the marker has to look at, by project and kind."""
    c = table(spark, d, "chunks").where(F.col("indexed_at") > F.lit(marker).cast("timestamp_ntz"))
    return c.groupBy("project", "kind").agg(F.countDistinct("id").alias("records"), F.max("indexed_at").alias("next_marker"))


def discovery(spark: SparkSession, d: str, most: int = 20_000) -> DataFrame:
    """Why files would not be indexed, the first rule that holds, and how many files."""
    files = chunks(spark, d, "project", "file_path", "content").groupBy("project", plain_path(F.col("file_path")).alias("path")).agg(F.sum(F.length("content")).alias("size"))
    return files.groupBy(F.coalesce(discovery_reason("path", "size", most), F.lit("indexed")).alias("reason")).agg(F.count("*").alias("files"))


def first_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Names defined more than once in a project: the definition that wins (wiki before code, then path, then record) and how many it hides."""
    c = chunks(spark, d, "project", "kind", "file_path", "func_name").where("func_name is not null and func_name <> ''").withColumn("path", plain_path(F.col("file_path")))
    g = c.groupBy("project", "func_name").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "path"), F.struct(F.when(F.col("kind") == "wiki", 0).otherwise(1), "path", "id")).alias("b"))
    return g.where("n > 1").select("project", "func_name", F.col("b.id").alias("id"), F.col("b.path").alias("path"), (F.col("n") - 1).alias("hidden"))


QUERIES = {
    "page_index_state": page_index_state, "job_retention": job_retention, "changed_since": changed_since, "discovery": discovery, "first_definitions": first_definitions,
    "manifest_diff": manifest_diff, "index_refresh": index_refresh, "window_chunks": window_chunks, "index_stats": index_stats, "lines_by_ending": lines_by_ending, "record_lookup": record_lookup,
    "embed_text_stats": embed_text_stats, "evidence_status": evidence_status, "job_counts": job_counts, "failed_pages": failed_pages, "job_queue": job_queue, "job_finish": job_finish, "embed_batches": embed_batches,
}

_PATH = r"regexp_replace(regexp_replace(replace({0}, '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '')"
_P = _PATH.format("file_path")
_C = "(select distinct on (id) * from chunks)"
_J = "(select distinct on (id) * from wiki_jobs)"
_OLD = f"select id, project, {_P} as path, content_sha from {_C} where last_modified is null or last_modified < timestamp '{CUT}' or id % 7 = 0"
_NEW = f"select id, project, {_P} as path, content_sha from {_C} where id % 11 <> 0"
_MAN = "select project, path, string_agg(s, ',' order by s) as hash from (select project, path, id || coalesce(':' || content_sha, '') as s from ({0})) group by all"

SQL = {
    "page_index_state": f"""select path, case when state is null then 'missing' when state = 'failed' then 'failed' when state in ('pending', 'running', 'retry') then 'building' when updated < epoch_us(modified)::double / 1000000 then 'stale' else 'ready' end as state
      from (select {_P} as path, max(last_modified) as modified from {_C} where kind = 'wiki' group by 1) left join (select distinct on (path) path, state, updated from {_J} order by path, created desc, id desc) using (path)""",
    "job_retention": f"select id, path, state from {_J} where state in ('done', 'failed', 'superseded') and updated < (select max(updated) from wiki_jobs) - 90 * 86400.0 and id not in (select max(id) from wiki_jobs group by path)",
    "changed_since": "select project, kind, count(distinct id)::bigint as records, max(indexed_at) as next_marker from chunks where indexed_at > timestamp '2026-09-01' group by all",
    "discovery": f"""select coalesce(case when regexp_matches(path, '{SENSITIVE}') then 'sensitive' when regexp_matches(path, '{HIDDEN}') then 'hidden' when regexp_matches(path, '{BUILD}') then 'generated' when size > 20000 then 'too_large' when size = 0 then 'empty' end, 'indexed') as reason, count(*)::bigint as files
      from (select project, {_P} as path, sum(length(content)) as size from {_C} group by all) group by 1""",
    "first_definitions": f"""select project, func_name, id, path, n - 1 as hidden from (select project, func_name, id, path, (count(*) over (partition by project, func_name))::bigint as n, row_number() over (partition by project, func_name order by case when kind = 'wiki' then 0 else 1 end, path, id) as r
      from (select *, {_P} as path from {_C} where func_name is not null and func_name <> '')) where n > 1 and r = 1""",
    "manifest_diff": f"""select project, case when o.hash is null then 'added' when n.hash is null then 'deleted' when o.hash = n.hash then 'unchanged' else 'changed' end as state, count(*)::bigint as files
      from ({_MAN.format(_OLD)}) o full join ({_MAN.format(_NEW)}) n using (project, path) group by all""",
    "index_refresh": f"""with s as (select project, path from ({_MAN.format(_OLD)}) o join ({_MAN.format(_NEW)}) n using (project, path, hash)) select id, project, 'kept' as origin from ({_OLD}) where (project, path) in (select (project, path) from s)
      union all select id, project, 'indexed' from ({_NEW}) where (project, path) not in (select (project, path) from s)""",
    "window_chunks": r"""select doc_id, (s + 1)::bigint as line_start, least(s + 80, len(ls))::bigint as line_end, md5(array_to_string(ls[s + 1 : s + 80], chr(10))) as content_md5 from (
      select doc_id, ls, unnest(range(0, greatest(len(ls) - 11, 0) + 1, 70)) as s from (select doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) as ls from documents where length(text) > 0))""",
    "index_stats": f"""select coalesce(kind, '*') as kind, case when level > 0 then '*' else lang end as lang, records, chars, level from (select kind, lang, count(*)::bigint as records, sum(length(content))::bigint as chars, (grouping(kind) * 2 + grouping(lang))::bigint as level
      from (select * replace (coalesce(nullif(lower(trim(lang)), ''), '-') as lang) from {_C}) group by rollup (kind, lang))""",
    "lines_by_ending": rf"select lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1)) as ending, sum(length(content) - length(replace(content, chr(10), '')))::bigint as line_ends, count(*)::bigint as records from {_C} where kind = 'code' group by 1",
    "record_lookup": f"select distinct on (project, path) project, path, id, kind, func_name, line_start from (select *, {_P} as path from {_C}) order by project, path, id",
    "embed_text_stats": r"""select id, md5(substr(t, 1, 8000)) as input_md5, least(length(t), 8000)::bigint as chars from (select id, concat_ws(chr(10), '# ' || coalesce(func_name, regexp_extract(file_path, '([^/\\]*)$', 1)), 'Type: ' || kind, 'Category: ' || lower(trim(lang)), content) as t from (select distinct on (id) * from chunks))""",
    "evidence_status": f"""with q as (select * from dataset qualify row_number() over (partition by id order by added_at desc nulls last) = 1),
      r as (select id, project, pos, {_PATH.format('r.path')} as path, r.start_line as s, r.end_line as e from (select id, project, relevant[i] as r, i::bigint - 1 as pos from (select id, project, relevant, unnest(range(1, len(relevant) + 1)) as i from q))),
      f as (select project, {_P} as path, max(line_end) as last from chunks group by all)
      select id, pos, case when path is null then 'no_path' when last is null then 'unknown_file' when s < 1 or e < s then 'bad_range' when s > last then 'beyond_file' when e > last then 'end_clipped' else 'ok' end as status from r left join f using (project, path)""",
    "embed_batches": f"""with recursive p as materialized (select project, id, row_number() over (partition by project order by id) as n, coalesce(length(content), 0) as s from {_C} where kind = 'wiki'),
      f(project, n, first, rows, chars) as (select project, n, id, 1, s from p where n = 1 union all select p.project, p.n, case when f.rows < 16 and f.chars + p.s <= 20000 then f.first else p.id end, case when f.rows < 16 and f.chars + p.s <= 20000 then f.rows + 1 else 1 end,
        case when f.rows < 16 and f.chars + p.s <= 20000 then f.chars + p.s else p.s end from f join p on p.project = f.project and p.n = f.n + 1)
      select project, first as first_id, max(rows)::bigint as rows, max(chars)::bigint as chars from f group by all""",
    "job_counts": f"select state, count(*)::bigint as jobs, max(attempts)::bigint as most_attempts, count(distinct path)::bigint as paths from {_J} group by state",
    "failed_pages": f"select path, id, error from {_J} where state = 'failed' and id in (select max(id) from wiki_jobs group by path)",
    "job_queue": f"""select id, path, case when before = key then 'duplicate' when state in ('pending', 'retry') and later <> key then 'superseded' else state end as fate from (select *, lag(key) over w as before, lead(key) over w as later
      from (select *, concat_ws('/', snapshot_sha, fingerprint) as key from {_J}) window w as (partition by path order by created, id))""",
    "job_finish": f"select id, case when t >= 3 then 'failed' else 'retry' end as state, t::bigint as attempts, case when t < 3 then updated + pow(2.0::double, t) end as next_attempt from (select *, coalesce(attempts, 0) + 1 as t from {_J} where state = 'running')",
}
