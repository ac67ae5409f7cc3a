"""What goes into the index and what leaves: selection of pages and files, chunk dispatch, gaps, windows of runs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import plain_path, without_comments
from ..session import first_by, table
from .audit import pages
from .index import chunks, line_windows
from .journal import sessions, worth

TODAY = "2026-11-01"
# Pages that are never embedded, and the bounds of a triage window in days.
NOT_EMBEDDED = r"^wiki/(?:(?:log|index|roadmap)\.md$|raw/)"
LEAST_DAYS, MOST_DAYS = 7, 30
#: Characters beyond which a file is not chunked.
MOST_CHARS = 500_000


def embeddable(path: Column, kind: Column, with_sessions: bool = False) -> Column:
    """Whether a page is embedded: no list, nothing raw, journals only if asked for."""
    ok = ~path.rlike(NOT_EMBEDDED)
    return ok if with_sessions else ok & (F.coalesce(kind, F.lit("")) != "session")


def embeddable_pages(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return p.where(embeddable(F.col("path"), F.col("type"))).groupBy("folder", "type").agg(F.count("*").alias("pages"), F.sum(F.length("content")).cast("bigint").alias("chars"))


def under(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of ``paths`` (``path``) with the literal ``prefix`` they are or lie below; a path below several comes once for each.

    Every leading part of a path is looked up, so the join is by equality, whatever the number of prefixes. Prefixes hold no pattern; a slash at their end is ignored.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    clean = prefixes.select(F.regexp_replace("prefix", "/+$", "").alias("prefix")).where("prefix <> ''").distinct()
    return paths.withColumn("prefix", F.explode(heads)).join(clean, "prefix")


def files_below(spark: SparkSession, d: str) -> DataFrame:
    """Files of each project below the folders its judged queries point at."""
    files = table(spark, d, "chunks").select("project", plain_path(F.col("file_path")).alias("path")).distinct()
    judged = table(spark, d, "dataset").select(F.explode("relevant").alias("r")).select(F.regexp_extract(plain_path(F.col("r.path")), r"^(.*)/[^/]*$", 1).alias("prefix"))
    return under(files, judged).groupBy("prefix").agg(F.count("*").alias("files"), F.countDistinct("project").alias("projects"))


def chunk_list(spark: SparkSession, d: str, limit: int = 100) -> DataFrame:
    """The first pages of the index by id."""
    c = table(spark, d, "chunks").where("kind = 'wiki'").select("id", "project", plain_path(F.col("file_path")).alias("path"), F.lower(F.trim("lang")).alias("page_type"), "indexed_at")
    return first_by(c, ["id"], F.col("indexed_at")).orderBy("id").limit(limit).select("id", "project", "path", "page_type")


def dispatched(files: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Records of files (``key``, ``kind``, ``text``): a page is one record with lines 0 and 0, code comes in windows of lines; texts too large or empty give none."""
    ok = files.where(F.col("text").isNotNull() & (F.length("text") <= most) & (F.col("text") != ""))
    whole = ok.where("kind = 'wiki'").select("key", F.lit(0).cast("bigint").alias("line_start"), F.lit(0).cast("bigint").alias("line_end"), F.col("text").alias("content"))
    return whole.unionByName(line_windows(ok.where("kind = 'code'"), "key", "text"))


def dispatch(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "kind", "content").select(F.col("id").alias("key"), "kind", F.col("content").alias("text"))
    return dispatched(c, 6_000).select(F.col("key").alias("id"), "line_start", "line_end", F.md5("content").alias("content_md5"))


def module_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files that no record covers, between its records and before the first: what a module's own record would hold."""
    c = table(spark, d, "chunks").where("kind = 'code' and line_start >= 1 and line_end >= line_start").select("project", plain_path(F.col("file_path")).alias("path"), "line_start", "line_end").distinct()
    w = Window.partitionBy("project", "path").orderBy("line_start", "line_end")  # the records of one file
    upto = F.coalesce(F.max("line_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("upto", upto).where("line_start > upto + 1").select("project", "path", (F.col("upto") + 1).cast("bigint").alias("gap_start"), (F.col("line_start") - 1).cast("bigint").alias("gap_end"))


def triage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Days each project's next triage looks back: from its last distilled journal and one more, within bounds; the most where there was none."""
    last = sessions(spark, d).groupBy("project").agg(F.max(F.when(F.col("distilled"), F.col("ended"))).alias("last"))
    age = F.floor((F.unix_micros(F.lit(TODAY).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / (86_400 * 1_000_000)) + 1
    return last.select("project", F.when(F.col("last").isNull(), MOST_DAYS).otherwise(F.greatest(F.lit(LEAST_DAYS), F.least(F.lit(MOST_DAYS), age))).cast("bigint").alias("days"))


def transcripts_purged(spark: SparkSession, d: str, days: int = 60) -> DataFrame:
    """Transcript files whose last row came more than ``days`` before the newest one and whose session has no journal that waits for its summary."""
    t = table(spark, d, "transcript").groupBy("session_id", "transcript_path").agg(F.max("received_at").alias("last"), F.count("*").alias("rows"))
    newest = table(spark, d, "transcript").agg(F.max("received_at").alias("newest"))  # one row
    waits = sessions(spark, d).where(F.col("summary").isNull() & worth()).select(F.col("cc_session_id").alias("session_id")).distinct()
    old = t.join(F.broadcast(newest)).where(F.col("last") < F.col("newest") - F.expr(f"interval {days} days"))
    return old.join(waits, "session_id", "left_anti").select("session_id", "transcript_path", "rows")


def run_history(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    """The last runs of each state with their error, newest first; a limit per state before the shuffle."""
    j = table(spark, d, "wiki_jobs").dropDuplicates(["id"])
    k = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("updated"), F.desc("id")))
    return j.withColumn("k", k.cast("bigint")).where(f"k <= {most}").select("state", "k", "id", "path", "error")


def exported_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as lines of JSON, journals left out."""
    p = pages(spark, d).where("coalesce(type, '') <> 'session'")
    return p.select("id", F.to_json(F.struct("id", "slug", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("type", F.lit("")).alias("type"), F.sha2("content", 256).alias("sha"))).alias("line"))


# Sections of the texts that a profile keeps.
PROFILE = ("Next steps", "Open questions", "Decision", "Summary")


def profile_sections(spark: SparkSession, d: str) -> DataFrame:
    """The lists under the sections of texts that a profile keeps: their items without comments and marks."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", without_comments(F.col("text")).alias("t"))
    parts = docs.select("doc_id", F.posexplode(F.split("t", r"(?m)^#{1,6}[ \t]+")).alias("pos", "part"))
    named = parts.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.trim(F.regexp_extract("part", r"^([^\r\n]*)", 1)).alias("section"), "part").where(F.col("pos") > 0).where(F.col("section").isin(*PROFILE))
    items = F.filter(F.split("part", r"\r?\n"), lambda x: x.rlike(r"^[-*] "))
    return named.select("doc_id", "pos", "section", F.size(items).cast("bigint").alias("items"), F.md5(F.array_join(F.transform(items, lambda x: F.regexp_replace(x, r"^[-*] +", "")), "\n")).alias("items_md5"))


def page_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the wiki by folder: pages, characters, days since the oldest and newest, share with tags."""
    p = pages(spark, d)
    age = F.datediff(F.lit(TODAY).cast("date"), "created")
    return p.groupBy("folder").agg(F.count("*").alias("pages"), F.sum(F.length("content")).cast("bigint").alias("chars"), F.max(age).cast("bigint").alias("oldest"), F.min(age).cast("bigint").alias("newest"), F.round(F.avg(F.col("tags").isNotNull().cast("double")), 6).alias("tagged"))


QUERIES = {
    "embeddable_pages": embeddable_pages, "files_below": files_below, "chunk_list": chunk_list, "dispatch": dispatch, "module_gaps": module_gaps, "triage_windows": triage_windows, "transcripts_purged": transcripts_purged,
    "run_history": run_history, "exported_pages": exported_pages, "profile_sections": profile_sections, "page_tiers": page_tiers,
}

from .audit import _PAGES  # noqa: E402
from .index import _P, _PATH  # noqa: E402
from .journal import _S, _WORTH  # noqa: E402

SQL = {
    "embeddable_pages": f"select folder, type, count(*)::bigint as pages, sum(length(content))::bigint as chars from {_PAGES} where not regexp_matches(path, '{NOT_EMBEDDED}') and coalesce(type, '') <> 'session' group by all",
    "files_below": f"""with f as (select distinct project, {_P} as path from chunks), p as (select distinct regexp_replace(regexp_extract({_PATH.format('r.path')}, '^(.*)/[^/]*$', 1), '/+$', '') as prefix from (select unnest(relevant) as r from dataset))
      select prefix, count(*)::bigint as files, count(distinct project)::bigint as projects from p join f on f.path = prefix or starts_with(f.path, prefix || '/') where prefix <> '' group by prefix""",
    "chunk_list": f"select id, project, {_P} as path, lower(trim(lang)) as page_type from (select distinct on (id) * from chunks where kind = 'wiki' order by id, indexed_at) order by id limit 100",
    "dispatch": r"""with f as (select distinct on (id) id, kind, content from chunks where length(content) between 1 and 6000), l as (select id, string_split(regexp_replace(content, '\n\z', ''), chr(10)) as ls from f where kind = 'code')
      select id, 0::bigint as line_start, 0::bigint as line_end, md5(content) as content_md5 from f where kind = 'wiki' union all select id, (s + 1)::bigint, least(s + 80, len(ls))::bigint, md5(array_to_string(ls[s + 1 : s + 80], chr(10))) from (select id, ls, unnest(range(0, greatest(len(ls) - 11, 0) + 1, 70)) as s from l)""",
    "module_gaps": f"""select project, path, (upto + 1)::bigint as gap_start, (line_start - 1)::bigint as gap_end from (select *, coalesce(max(line_end) over (partition by project, path order by line_start, line_end rows between unbounded preceding and 1 preceding), 0) as upto
      from (select distinct project, {_P} as path, line_start, line_end from chunks where kind = 'code' and line_start >= 1 and line_end >= line_start)) where line_start > upto + 1""",
    "triage_windows": f"select project, case when last is null then 30 else greatest(7, least(30, floor(epoch(timestamp '{TODAY}' - last) / 86400) + 1)) end::bigint as days from (select project, max(case when distilled then ended end) as last from {_S} group by project)",
    "transcripts_purged": f"""select session_id, transcript_path, count(*)::bigint as rows from transcript where session_id is null or session_id not in (select cc_session_id from {_S} where summary is null and {_WORTH} and cc_session_id is not null) group by session_id, transcript_path
      having max(received_at) < (select max(received_at) from transcript) - interval 60 day""",
    "run_history": "select state, k, id, path, error from (select *, (row_number() over (partition by state order by updated desc, id desc))::bigint as k from (select distinct on (id) * from wiki_jobs)) where k <= 5",
    "exported_pages": f"select id, to_json({{'id': id, 'slug': slug, 'title': coalesce(title, ''), 'type': coalesce(type, ''), 'sha': sha256(content)}})::varchar as line from {_PAGES} where coalesce(type, '') <> 'session'",
    "profile_sections": rf"""select doc_id, pos, section, len(items)::bigint as items, md5(array_to_string(list_transform(items, lambda x: regexp_replace(x, '^[-*] +', '')), chr(10))) as items_md5 from (select doc_id, pos, section, list_filter(regexp_split_to_array(part, '\r?\n'), lambda x: regexp_matches(x, '^[-*] ')) as items
      from (select doc_id, i::bigint - 1 as pos, trim(regexp_extract(parts[i], '^([^\r\n]*)', 1)) as section, parts[i] as part from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, regexp_split_to_array(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?m)^#{{1,6}}[ \t]+') as parts from documents where text is not null)))
      where pos > 0 and section in {PROFILE})""",
    "page_tiers": f"select folder, count(*)::bigint as pages, sum(length(content))::bigint as chars, max(date '{TODAY}' - created)::bigint as oldest, min(date '{TODAY}' - created)::bigint as newest, round(avg((tags is not null)::int::double), 6) as tagged from {_PAGES} group by folder",
}
