"""Composed reports: statistics and audits of the whole wiki, timelines, job and file states, message noise, refused task lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_score, plain_path
from ..session import first_by, table
from .audit import lint_issues, pages
from .index import chunks, jobs
from .journal import message_events, sessions
from .links import linked_pages, orphan_pages, _resolved
from .merges import _log, read_log, trust_tiers
from .roadmap import tasks
from .search import KEYWORDS, ranked

TODAY = "2026-11-01"
KNOWLEDGE = ("concept", "entity", "decision", "source")
#: Bytes beyond which a file's hash is its size and time.
MOST_BYTES = 20_000


def _figures(*parts: tuple[str, DataFrame]) -> DataFrame:
    """One row per measure, from frames of one row with ``value``."""
    found = None
    for name, one in parts:
        row = one.select(F.lit(name).alias("measure"), F.col("value").cast("bigint").alias("value"))
        found = row if found is None else found.unionByName(row)
    return found


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("value"))


def wiki_figures(spark: SparkSession, d: str) -> DataFrame:
    """Pages and characters, log entries, active and archived journals, and pages nothing links to."""
    p, s = pages(spark, d), sessions(spark, d)
    orphans = orphan_pages(linked_pages(spark, d), _resolved(spark, d)).where("rule = 'stats'")
    return _figures(
        ("pages", _count(p)), ("chars", p.agg(F.sum(F.length("content")).alias("value"))), ("log_entries", _count(_log(spark, d).where("line is not null"))),
        ("sessions_active", _count(s.where("not archived"))), ("sessions_archived", _count(s.where("archived"))), ("orphans", _count(orphans)), ("knowledge_pages", _count(p.where(F.col("type").isin(*KNOWLEDGE)))),
    )


def lint_report(spark: SparkSession, d: str) -> DataFrame:
    """Issues by check, pages by tier of trust, and a warning where journals are more than three times the knowledge pages."""
    issues = lint_issues(spark, d).groupBy("check").agg(F.count("*").alias("n")).select(F.concat(F.lit("issue:"), "check").alias("measure"), "n")
    tiers = trust_tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n")).select(F.concat(F.lit("tier:"), "tier").alias("measure"), "n")
    many = _count(sessions(spark, d)).select(F.col("value").alias("s")).join(F.broadcast(_count(pages(spark, d).where(F.col("type").isin(*KNOWLEDGE)))))  # one row
    volume = many.where(F.col("s") > 3 * F.greatest(F.lit(1), F.col("value"))).select(F.lit("warning:session_volume").alias("measure"), F.col("s").alias("n"))
    return issues.unionByName(tiers).unionByName(volume)


def full_timeline(spark: SparkSession, d: str, first: str = "2026-09-01", last: str = "2026-10-15", limit: int = 200) -> DataFrame:
    """Log entries and journals of a span of days, both ends included, as one stream; how many of each kind there are before the cut stands with each row."""
    log = read_log(_log(spark, d).where("line is not null")).select(F.col("log_day").alias("day"), F.col("log_type").alias("type"), F.col("log_text").alias("what"), F.col("id").alias("ref"))
    own = sessions(spark, d).select(F.col("session_day").alias("day"), F.lit("journal").alias("type"), F.col("project").alias("what"), F.col("id").alias("ref"))
    every = log.unionByName(own).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumn("kind", F.split("type", ":")[0])
    counts = every.groupBy("kind").agg(F.count("*").alias("of_kind"))  # a row per kind
    return every.orderBy(F.desc("day"), "type", "ref").limit(limit).join(F.broadcast(counts), "kind").select("day", "type", F.md5("what").alias("what_md5"), "ref", "of_kind")


def job_report(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    """Jobs by state and the latest ones."""
    j = jobs(spark, d)
    by = j.groupBy("state").agg(F.count("*").alias("n")).select(F.lit("state").alias("part"), "state", F.lit(0).cast("bigint").alias("id"), "n")
    last = j.orderBy(F.desc("id")).limit(most).select(F.lit("latest").alias("part"), "state", "id", F.lit(1).cast("bigint").alias("n"))
    return by.unionByName(last)


def context_excerpts(spark: SparkSession, d: str, most_words: int = 10, most: int = 5, size: int = 1200) -> DataFrame:
    """The best pages for the first words of a prompt, lists and journals left out, with an excerpt of their text."""
    p = pages(spark, d).where("coalesce(type, '') <> 'session' and stem not in ('index', 'log')").withColumn("score", keyword_score(F.col("content"), KEYWORDS[:most_words]))
    top = p.orderBy(F.desc("score"), "id").limit(most).where("score > 0")
    return top.select("id", "slug", "score", F.md5(F.substring(F.regexp_replace("body", r"^\s+|\s+$", ""), 1, size)).alias("excerpt_md5"))


def recent_summaries(spark: SparkSession, d: str, most: int = 12) -> DataFrame:
    """The newest active journals that have a summary, with its first 200 characters."""
    s = sessions(spark, d).where("not archived and summary is not null and trim(summary) <> ''")
    return s.orderBy(F.desc("session_day"), F.desc("id")).limit(most).select("id", "session_day", F.substring(F.trim("summary"), 1, 200).alias("summary"))


def revisions_expected(spark: SparkSession, d: str) -> DataFrame:
    """What a writer must hold of each judged file before it writes: the revision of its records, or that it is missing."""
    q = table(spark, d, "dataset").select("project", F.explode("relevant").alias("r")).select("project", plain_path(F.col("r.path")).alias("path")).where("path is not null").distinct()
    parts = chunks(spark, d, "project", "file_path", "content_sha").groupBy("project", plain_path(F.col("file_path")).alias("path")).agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("id").cast("string"), "content_sha"))).alias("x"))  # the records of one file
    return q.join(parts, ["project", "path"], "left").select("project", "path", F.coalesce(F.concat(F.lit("sha256:"), F.sha2(F.array_join("x", ","), 256)), F.lit("missing")).alias("revision"))


def file_states(spark: SparkSession, d: str) -> DataFrame:
    """Every file's size, its hash (of what it holds, or of size and time where it is too large) and why it would be left out."""
    c = chunks(spark, d, "project", "file_path", "content", "last_modified").select("project", plain_path(F.col("file_path")).alias("path"), "id", F.length("content").alias("n"), F.sha2("content", 256).alias("sha"), "last_modified")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sha"))), lambda x: x["sha"]), ",")  # the records of one file
    f = c.groupBy("project", "path").agg(F.sum("n").alias("size"), F.sha2(parts, 256).alias("sha"), F.unix_seconds(F.max("last_modified").cast("timestamp")).alias("modified"))
    big = F.col("size") > MOST_BYTES
    return f.select("project", "path", F.col("size").cast("bigint").alias("size"), F.when(big, F.concat_ws(":", F.lit("oversize"), F.col("size").cast("string"), F.col("modified").cast("string"))).otherwise(F.col("sha")).alias("hash"), F.when(big, "too_large").when(F.col("size") == 0, "empty").alias("excluded"))


def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Judged spans against the index: unknown file, lines out of bounds, lines no record holds, records that differ by version; the first reason that holds, and counts."""
    q = first_by(table(spark, d, "dataset").select("id", "project", "relevant", "added_at"), ["id"], -F.coalesce(F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(0)), F.xxhash64(F.to_json("relevant")))
    refs = q.select("id", "project", F.posexplode("relevant").alias("pos", "r")).select("id", "pos", "project", plain_path(F.col("r.path")).alias("path"), F.col("r.start_line").alias("s"), F.col("r.end_line").alias("e"))
    c = table(spark, d, "chunks").where("kind = 'code'").select("project", plain_path(F.col("file_path")).alias("path"), "line_start", "line_end", "rev").distinct()
    last = c.groupBy("project", "path").agg(F.max("line_end").alias("last"))
    inside = refs.join(c, ["project", "path"]).where("line_start <= e and line_end >= s").groupBy("id", "pos").agg(F.countDistinct("rev").alias("revs"))
    both = refs.join(last, ["project", "path"], "left").join(inside, ["id", "pos"], "left")
    why = F.when(F.col("last").isNull(), "unknown_file").when((F.col("s") < 1) | (F.col("e") < F.col("s")) | (F.col("e") > F.col("last")), "bounds").when(F.col("revs").isNull(), "no_record").when(F.col("revs") > 1, "mixed_revisions").otherwise("ok")
    return both.groupBy("project", why.alias("status")).agg(F.count("*").alias("spans"), F.countDistinct("id").alias("queries"))


def noise_reason() -> Column:
    """Why a message row holds nothing said: the first rule that holds, or null."""
    c, first = F.col("content"), F.col("first_text")
    return (
        F.when(F.coalesce(F.lower("event_type") == "system", F.lit(False)), "system").when(c.isNull() | (F.trim(c) == ""), "empty").when(F.lower(F.trim(c)).rlike(r"^\(no[\s_-]*content\)$"), "no_content")
        .when(F.ltrim(c).rlike(r"^<(command|local-command)-"), "markup").when(F.col("is_array") & ~F.col("valid"), "damaged").when(F.col("is_array") & (F.coalesce(F.trim(first), F.lit("")) == ""), "no_text")
    )


def message_noise(spark: SparkSession, d: str) -> DataFrame:
    """Message rows by what they hold: noise by its reason, or text; how many have their words in blocks, and the characters of the first words."""
    t = table(spark, d, "transcript").select("row_id", "event_type", F.col("message.content").alias("content")).withColumn("is_array", F.coalesce(F.col("content").rlike(r"^\s*\["), F.lit(False)))
    blocks = F.from_json(F.when(F.col("is_array"), F.col("content")), "array<struct<type:string,text:string>>")
    said = F.filter(blocks, lambda b: (F.coalesce(b["type"], F.lit("text")) == "text") & F.coalesce(F.trim(b["text"]) != "", F.lit(False)))
    rows = t.withColumn("valid", F.try_parse_json(F.when(F.col("is_array"), F.col("content"))).isNotNull()).withColumn("first_text", F.when(F.col("is_array"), F.try_element_at(said, F.lit(1))["text"]).otherwise(F.col("content")))
    kind = F.coalesce(noise_reason(), F.lit("text"))
    return rows.groupBy(kind.alias("holds")).agg(F.count("*").alias("rows"), F.count_if("is_array").alias("arrays"), F.sum(F.when(kind == "text", F.length("first_text")).otherwise(0)).cast("bigint").alias("chars"))


# Names of the fields of a task line, which a value must not imitate.
TASK_FIELDS = ("id", "est", "owner", "added", "started", "done", "took", "blocker")


def refused_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts that can't stand in a task line (ends of lines, bars, or a field of their own), and the fields they would stand in."""
    names = "|".join(TASK_FIELDS)
    t = tasks(spark, d)
    values = t.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("title", "est", "owner", "took", "blocker")])).alias("x")).select("id", "x.field", "x.v").where("v is not null")
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.lit("note").alias("field"), F.substring("text", 1, 400).alias("v"))
    why = F.when(F.col("v").rlike(r"[\r\n]"), "line").when(F.col("v").contains("|"), "bar").when(F.col("v").rlike(rf"(^|\s)({names}):"), "field")
    return values.unionByName(docs).groupBy("field", F.coalesce(why, F.lit("ok")).alias("why")).agg(F.count("*").alias("n"))


def channel_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Journals ranked by age and by messages at once: the sum of reciprocal ranks over projects' newest ones."""
    s = sessions(spark, d).where("not archived").select("id", "project", "session_day", F.coalesce("messages_user", F.lit(0)).alias("m"))
    new = ranked(s.orderBy(F.desc("session_day"), "id").limit(50).select("id", "session_day"), F.desc("session_day"), "id").select("id", F.col("rank").alias("ra"))
    big = ranked(s.orderBy(F.desc("m"), "id").limit(50).select("id", "m"), F.desc("m"), "id").select("id", F.col("rank").alias("rb"))
    score = F.coalesce(1.0 / (60 + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("rb")), F.lit(0.0))
    return new.join(big, "id", "full_outer").select("id", F.round(score, 9).alias("score"))


def session_tools(spark: SparkSession, d: str) -> DataFrame:
    """Journals' own tool lists against the calls in their transcripts: tools in both, in one only."""
    own = sessions(spark, d).where("cc_session_id is not null").select("cc_session_id", F.explode("tools").alias("tool")).distinct().withColumn("j", F.lit(1))
    said = message_events(spark, d).select(F.col("session_id").alias("cc_session_id"), F.explode("tools").alias("tool")).distinct().withColumn("t", F.lit(1))
    both = own.join(said, ["cc_session_id", "tool"], "full_outer")
    where = F.when(F.col("j").isNull(), "transcript").when(F.col("t").isNull(), "journal").otherwise("both")
    return both.groupBy("tool", where.alias("stands_in")).agg(F.count("*").alias("sessions"))


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    """The record of each file's unit that was indexed last, with how many versions it had."""
    c = table(spark, d, "chunks").where("func_name is not null").select("id", "project", plain_path(F.col("file_path")).alias("path"), "func_name", "indexed_at", "rev")
    best = c.groupBy("project", "path", "func_name").agg(F.max_by(F.struct("id", "rev"), F.struct("indexed_at", "id")).alias("b"), F.countDistinct("id").alias("versions"))
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("versions"), "path", "func_name"))
    return best.withColumn("k", k.cast("bigint")).where("k <= 10").select("project", "path", "func_name", "b.id", "b.rev", "versions", "k")


QUERIES = {
    "wiki_figures": wiki_figures, "lint_report": lint_report, "full_timeline": full_timeline, "job_report": job_report, "context_excerpts": context_excerpts, "recent_summaries": recent_summaries, "revisions_expected": revisions_expected,
    "file_states": file_states, "evidence_checks": evidence_checks, "message_noise": message_noise, "refused_lines": refused_lines, "channel_ranks": channel_ranks, "session_tools": session_tools, "latest_versions": latest_versions,
}

from .audit import _LINT, _PAGES  # noqa: E402
from .index import _C, _J, _P, _PATH  # noqa: E402
from .journal import _EV, _S  # noqa: E402
from .links import _ORPHANS  # noqa: E402
from .merges import _LOGROWS, _TIERS  # noqa: E402
from .roadmap import _T  # noqa: E402

_KW10 = " + ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in KEYWORDS[:10])
_NAMES = "|".join(TASK_FIELDS)

SQL = {
    "wiki_figures": f"""select 'pages' as measure, count(*)::bigint as value from {_PAGES} union all select 'chars', sum(length(content)) from {_PAGES} union all select 'log_entries', count(*) from {_LOGROWS} where line is not null
      union all select 'sessions_active', count(*) from {_S} where not archived union all select 'sessions_archived', count(*) from {_S} where archived union all select 'orphans', count(*) from {_ORPHANS} where rule = 'stats' union all select 'knowledge_pages', count(*) from {_PAGES} where type in {KNOWLEDGE}""",
    "lint_report": f"""select 'issue:' || "check" as measure, count(*)::bigint as n from {_LINT} group by 1 union all select 'tier:' || tier, count(*) from {_TIERS} group by 1
      union all select 'warning:session_volume', s from (select (select count(*) from {_S}) as s, (select count(*) from {_PAGES} where type in {KNOWLEDGE}) as k) where s > 3 * greatest(1, k)""",
    "full_timeline": f"""with e as (select *, split_part(type, ':', 1) as kind from (select day, type, trim(text) as what, id as ref from {_LOGROWS} where line is not null union all select session_day, 'journal', project, id from {_S}) where day between date '2026-09-01' and date '2026-10-15')
      select day, type, md5(what) as what_md5, ref, of_kind from (select *, (count(*) over (partition by kind))::bigint as of_kind from e) order by day desc, type, ref limit 200""",
    "job_report": f"select 'state' as part, state, 0::bigint as id, count(*)::bigint as n from {_J} group by state union all select 'latest', state, id, 1 from (select * from {_J} order by id desc limit 20)",
    "context_excerpts": f"""select id, slug, score, md5(substr(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), 1, 1200)) as excerpt_md5 from (select *, ({_KW10})::bigint as score from (select *, lower(content) as t from {_PAGES} where coalesce(type, '') <> 'session' and stem not in ('index', 'log'))) where score > 0 order by score desc, id limit 5""",
    "recent_summaries": f"select id, session_day, substr(trim(summary), 1, 200) as summary from {_S} where not archived and trim(summary) <> '' order by session_day desc, id desc limit 12",
    "revisions_expected": f"""with q as (select distinct project, {_PATH.format('r.path')} as path from (select project, unnest(relevant) as r from dataset)), p as (select project, {_P} as path, string_agg(id || coalesce(':' || content_sha, ''), ',' order by id || coalesce(':' || content_sha, '')) as x from {_C} group by all)
      select project, path, coalesce('sha256:' || sha256(x), 'missing') as revision from q left join p using (project, path) where path is not null""",
    "file_states": f"""select project, path, size, case when size > {MOST_BYTES} then concat_ws(':', 'oversize', size, modified) else sha end as hash, case when size > {MOST_BYTES} then 'too_large' when size = 0 then 'empty' end as excluded
      from (select project, {_P} as path, sum(length(content))::bigint as size, sha256(string_agg(sha256(content), ',' order by id)) as sha, floor(epoch(max(last_modified)))::bigint as modified from {_C} group by all)""",
    "evidence_checks": f"""with q as (select * from dataset qualify row_number() over (partition by id order by added_at desc nulls last) = 1), r as (select id, pos, project, {_PATH.format('x.path')} as path, x.start_line as s, x.end_line as e from (select id, i as pos, project, relevant[i] as x from (select id, project, relevant, unnest(range(1, len(relevant) + 1)) as i from q))),
      c as (select distinct project, {_P} as path, line_start, line_end, rev from chunks where kind = 'code'), l as (select project, path, max(line_end) as last from c group by all), n as (select id, pos, count(distinct rev) as revs from r join c using (project, path) where line_start <= e and line_end >= s group by all)
      select project, case when last is null then 'unknown_file' when s < 1 or e < s or e > last then 'bounds' when revs is null then 'no_record' when revs > 1 then 'mixed_revisions' else 'ok' end as status, count(*)::bigint as spans, count(distinct id)::bigint as queries from r left join l using (project, path) left join n using (id, pos) group by all""",
    "message_noise": r"""with t as (select lower(event_type) as k, message.content as c, coalesce(regexp_matches(message.content, '^\s*\['), false) as is_array from transcript), v as (select *, is_array and coalesce(json_valid(c), false) as valid from t),
      w as (select *, case when is_array then case when valid then list_filter(json_transform(c, '[{"type":"VARCHAR","text":"VARCHAR"}]'), lambda b: coalesce(b.type, 'text') = 'text' and trim(b.text) <> '')[1].text end else c end as first_text from v),
      x as (select *, case when k = 'system' then 'system' when c is null or trim(c) = '' then 'empty' when regexp_matches(lower(trim(c)), '^\(no[\s_-]*content\)$') then 'no_content' when regexp_matches(ltrim(c), '^<(command|local-command)-') then 'markup' when is_array and not valid then 'damaged' when is_array and coalesce(trim(first_text), '') = '' then 'no_text' else 'text' end as holds from w)
      select holds, count(*)::bigint as rows, count(*) filter (is_array)::bigint as arrays, sum(case when holds = 'text' then length(first_text) else 0 end)::bigint as chars from x group by holds""",
    "refused_lines": f"""with v as (select id, unnest(['title', 'est', 'owner', 'took', 'blocker']) as field, unnest([title, est, owner, took, blocker]) as v from {_T} union all select doc_id::varchar, 'note', substr(text, 1, 400) from documents where text is not null)
      select field, case when regexp_matches(v, '[\\r\\n]') then 'line' when contains(v, '|') then 'bar' when regexp_matches(v, '(^|\\s)({_NAMES}):') then 'field' else 'ok' end as why, count(*)::bigint as n from v where v is not null group by all""",
    "channel_ranks": f"""with s as (select id, session_day, coalesce(messages_user, 0) as m from {_S} where not archived), a as (select id, row_number() over (order by session_day desc, id) as ra from s), b as (select id, row_number() over (order by m desc, id) as rb from s)
      select id, round(coalesce(1.0::double / (60 + ra), 0) + coalesce(1.0::double / (60 + rb), 0), 9) as score from (select * from a where ra <= 50) full join (select * from b where rb <= 50) using (id)""",
    "session_tools": f"""with o as (select distinct cc_session_id, unnest(tools) as tool from {_S} where cc_session_id is not null), t as (select distinct session_id as cc_session_id, unnest(regexp_extract_all(content, '"type": "tool_use", "name": "([^"]+)"', 1)) as tool from {_EV})
      select tool, case when o.cc_session_id is null then 'transcript' when t.cc_session_id is null then 'journal' else 'both' end as stands_in, count(*)::bigint as sessions from o full join t using (cc_session_id, tool) group by all""",
    "latest_versions": f"""select project, path, func_name, id, rev, versions, k from (select *, (row_number() over (partition by project order by versions desc, path, func_name))::bigint as k from (select project, {_P} as path, func_name, last(id order by indexed_at, id) as id, last(rev order by indexed_at, id) as rev, count(distinct id)::bigint as versions
      from chunks where func_name is not null group by all)) where k <= 10""",
}
