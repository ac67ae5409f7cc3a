"""Keyed merges: frames of changes applied to frames of pages, lists, tasks and versions.

Each operator takes the old rows and the changes and gives the new rows with what happened to each, so that publishing is one
write. Changes with a null key are left out; of several changes to one key the last one stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..session import first_by, running_sum, table
from .audit import VERIFIED, content_revision, pages, sections, trust_tier
from .journal import sessions
from .roadmap import PRIORITIES, STATES, tasks

TODAY = "2026-11-01"
# The order of header fields in a written page, and the section that holds tasks of a state.
HEADER = ("title", "type", "created", "updated", "sources", "tags")
SECTION_OF = {"open": "Open", "in-progress": "In Progress", "blocked": "Blocked", "done": "Done", "cancelled": "Cancelled"}
# What an entry of the log may be, and how an actor of a check is named.
LOG_TYPE, LOG_LENGTH = r"^[a-z][a-z0-9_-]*(:[a-z0-9_-]+)?$", 200
ACTOR = r"^(human:[a-z0-9._-]+|[a-z0-9._-]+/[a-z0-9._-]+(/[A-Za-z0-9._-]+)?)$"


def merge_sections(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Sections of pages (``id``, ``pos``, ``section``, ``text``) with those of ``changes`` put in their place by name, new ones at the end.

    Of sections of one name the first place and the last text count. ``action`` is kept, replaced or added.
    """
    once = lambda rows: rows.where("id is not null and section is not null").groupBy("id", "section").agg(F.min("pos").alias("pos"), F.max_by("text", "pos").alias("text"))
    new = once(changes).select("id", "section", F.col("pos").alias("new_pos"), F.trim("text").alias("new_text"))
    both = once(old).join(new, ["id", "section"], "full_outer")
    action = F.when(F.col("new_pos").isNull(), "kept").when(F.col("pos").isNull(), "added").otherwise("replaced")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("pos"), "new_pos", "section"))  # the sections of one page
    return both.select("id", order.cast("bigint").alias("pos"), "section", F.coalesce("new_text", "text").alias("text"), action.alias("action"))


def union_lists(old: Column, new: Column) -> Column:
    """The entries of two lists in order, each once; null is an empty list."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, none), F.coalesce(new, none))


def append_once(text: Column, block: Column) -> Column:
    """A text with a block as its last paragraph, unless it is there already."""
    return F.when(F.coalesce(text, F.lit("")) == "", block).when(F.contains(text, block), text).otherwise(F.concat(text, F.lit("\n\n"), block))


def compose_header(fields: dict[str, Column]) -> Column:
    """A header with the fields that are set, the known ones first and in their order."""
    names = [*(n for n in HEADER if n in fields), *sorted(n for n in fields if n not in HEADER)]
    lines = F.array_compact(F.array(*[F.when(fields[n].isNotNull(), F.concat(F.lit(f"{n}: "), fields[n].cast("string"))) for n in names]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def compose_sections(merged: DataFrame) -> DataFrame:
    """The body of each page from its sections in order; the one named '' has no heading."""
    part = F.when(F.col("section") == "", F.col("text")).otherwise(F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))  # the sections of one page
    return merged.groupBy("id").agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["part"]), "\n\n"), F.lit("\n")).alias("body"), F.count("*").alias("n_sections"))


def _page_changes(spark: SparkSession, d: str, page_rows: DataFrame) -> DataFrame:
    """What an index run would write to every page: a new section with its place, and the first named section marked as read."""
    old = sections(page_rows)
    first = old.where("section <> ''").groupBy("id").agg(F.min_by(F.struct("section", "text"), "pos").alias("s")).select("id", F.lit(0).cast("bigint").alias("pos"), "s.section", F.concat("s.text", F.lit("\n\n(read)")).alias("text"))
    place = page_rows.select("id", F.lit(1).cast("bigint").alias("pos"), F.lit("Place").alias("section"), F.concat_ws(" ", "project", "path").alias("text"))
    return first.unionByName(place)


def page_merge(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return merge_sections(sections(p), _page_changes(spark, d, p)).select("id", "pos", "section", "action", F.md5("text").alias("text_md5"))


def page_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every page written anew after the merge: header in its order, tags with those of the change, sections; its revision."""
    p = pages(spark, d)
    body = compose_sections(merge_sections(sections(p), _page_changes(spark, d, p)))
    own = F.filter(F.transform(F.split(F.regexp_replace("tags", r"^\[|\]$", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    tags = F.array_join(union_lists(own, F.array_compact(F.array("type", "folder"))), ", ")
    head = compose_header({"title": F.col("title"), "type": F.col("type"), "created": F.col("created"), "updated": F.lit(TODAY), "tags": F.concat(F.lit("["), tags, F.lit("]"))})
    return p.join(body.withColumnRenamed("body", "new_body"), "id").select("id", tags.alias("tag_list"), "n_sections", F.concat(F.lit("sha256:"), F.sha2(F.concat(head, F.lit("\n"), "new_body"), 256)).alias("revision"))


def append_lines(old: DataFrame, entries: DataFrame, part: str) -> DataFrame:
    """Lists by ``part`` (old rows with ``pos``, ``line``) with the entries that aren't there yet at their end, in the order of the entries' ``pos``."""
    fresh = entries.where(F.col(part).isNotNull() & (F.trim("line") != "")).groupBy(part, "line").agg(F.min("pos").alias("pos")).join(old.select(part, "line"), [part, "line"], "left_anti")
    last = old.groupBy(part).agg(F.max("pos").alias("_last"))
    placed = running_sum(fresh.withColumn("_one", F.lit(1)), part, ["pos", "line"], "_one", "_k").join(last, part, "left")
    added = placed.select(part, (F.coalesce("_last", F.lit(0)) + F.col("_k")).cast("bigint").alias("pos"), "line", F.lit("added").alias("action"))
    return old.select(part, F.col("pos").cast("bigint").alias("pos"), "line", F.lit("kept").alias("action")).unionByName(added)


def index_append(spark: SparkSession, d: str) -> DataFrame:
    """The index by folder: the pages that were there before a day, then all other pages; a line that is there is not written again."""
    p = pages(spark, d).where("folder <> ''").select("folder", "id", F.concat(F.lit("- [["), "stem", F.lit("]]")).alias("line"), "created")
    there = p.where("created < date '2026-07-01'").groupBy("folder", "line").agg(F.min("id").alias("o")).withColumn("one", F.lit(1))
    old = running_sum(there, "folder", ["o", "line"], "one", "pos").select("folder", "pos", "line")
    return append_lines(old, p.select("folder", F.col("id").alias("pos"), "line"), "folder")


def log_lines(entries: DataFrame) -> DataFrame:
    """Log entries (``day``, ``type``, ``text``) as lines, or the reason they are refused."""
    why = F.when(F.col("day").isNull(), "no_day").when(~F.coalesce(F.col("type").rlike(LOG_TYPE), F.lit(False)), "type").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("text").rlike(r"[\r\n]"), "lines").when(F.length("text") > LOG_LENGTH, "length")
    return entries.withColumn("refused", why).withColumn("line", F.when(why.isNull(), F.concat(F.lit("## ["), F.col("day").cast("string"), F.lit("] "), F.col("type"), F.lit(" | "), F.trim("text"))))


def read_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Log lines as rows again; other lines are left out."""
    rx = r"^## \[(\d{4}-\d\d-\d\d)\] ([^|]+?) \| (.*)$"
    part = lambda n: F.regexp_extract(column, rx, n)
    return lines.where(F.col(column).rlike(rx)).select("*", part(1).try_cast("date").alias("log_day"), part(2).alias("log_type"), part(3).alias("log_text"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d).select("id", F.col("session_day").alias("day"), F.concat(F.lit("session:"), F.lower("harness")).alias("type"), F.coalesce("summary", F.array_join("prompts", "; ")).alias("text"))
    t = tasks(spark, d).where("done is not null").select("id", F.col("done").alias("day"), F.lit("task").alias("type"), F.col("title").alias("text"))
    return log_lines(s.unionByName(t))


def log_append(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("id", "refused", F.md5("line").alias("line_md5"))


def log_tail(spark: SparkSession, d: str, n: int = 50) -> DataFrame:
    """The last entries of the log, read from its lines, newest first."""
    return read_log(_log(spark, d).where("line is not null")).orderBy(F.desc("log_day"), "log_type", "log_text", "id").limit(n).select("id", "log_day", "log_type", "log_text")


def apply_task_changes(old: DataFrame, changes: DataFrame, today: str = TODAY) -> DataFrame:
    """Tasks after changes (``id``, ``op`` of add, update, complete or block, ``title``, ``priority``, ``owner``, ``state``, ``blocker``, ``took``).

    A changed state moves the task to the section of that state. Refused with a reason in ``action``: unknown ids, unknown states and
    priorities, an added task without a title or with an id that is taken, a block without a reason.
    """
    new = changes.where("id is not null").select("id", "op", *[F.col(c).alias(f"_{c}") for c in ("title", "priority", "owner", "state", "blocker", "took")])
    both = old.select("id", "project", "section", "state", "priority", "title", "owner", "added", "done", "took", "blocker").withColumn("_there", F.lit(True)).join(new, "id", "full_outer")
    there, op = F.col("_there").isNotNull(), F.col("op")
    bad = lambda c, known: F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").isin(*known)
    refused = (
        F.when(op.isNull(), None).when(~op.isin("add", "update", "complete", "block"), "refused: op").when((op == "add") & there, "refused: taken").when((op != "add") & ~there, "refused: unknown")
        .when((op == "add") & (F.trim(F.coalesce("_title", F.lit(""))) == ""), "refused: title").when(bad("priority", PRIORITIES), "refused: priority").when(bad("state", STATES), "refused: state")
        .when((op == "block") & (F.trim(F.coalesce("_blocker", F.lit(""))) == ""), "refused: blocker")
    )
    action = F.coalesce(refused, F.when(op.isNull(), "kept").when(op == "add", "added").when(op == "complete", "completed").when(op == "block", "blocked").otherwise("updated"))
    on = F.col("op").isNotNull() & refused.isNull()
    state = F.when(on & (op == "add"), "open").when(on & (op == "complete"), "done").when(on & (op == "block"), "blocked").when(on & F.col("_state").isNotNull(), F.col("_state")).otherwise(F.col("state"))
    names = F.create_map(*[F.lit(x) for kv in SECTION_OF.items() for x in kv])
    take = lambda c: F.when(on, F.coalesce(f"_{c}", c)).otherwise(F.col(c))
    return both.select(
        "id", "project", F.when(on & ~state.eqNullSafe(F.col("state")), F.coalesce(F.try_element_at(names, state), "section")).otherwise(F.col("section")).alias("section"), state.alias("state"),
        *[take(c).alias(c) for c in ("title", "priority", "owner", "took", "blocker")],
        F.when(on & (op == "add"), F.lit(today).cast("date")).otherwise(F.col("added")).alias("added"), F.when(on & (op == "complete"), F.lit(today).cast("date")).otherwise(F.col("done")).alias("done"), action.alias("action"),
    )


def _task_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes as the tables suggest them: urgent work in progress is finished, open work with a blocker blocked, other open work gets an owner; failed jobs become tasks."""
    t = tasks(spark, d)
    none = F.lit(None).cast("string")
    op = F.when((F.col("state") == "in-progress") & F.col("priority").isin("P0", "P1"), "complete").when((F.col("state") == "open") & F.col("priority").isin("P0"), "block").when((F.col("state") == "open") & F.col("owner").isNull(), "update")
    own = t.select("id", op.alias("op"), none.alias("title"), none.alias("priority"), F.when(op == "update", F.lit("nobody")).alias("owner"), none.alias("state"), F.when(op == "block", F.col("est")).alias("blocker"), F.lit("1d").alias("took")).where("op is not null")
    own = own.withColumn("priority", F.when(F.col("owner").isNotNull() & (F.md5("id") < "8"), F.lit("P5")).otherwise(F.lit(None).cast("string")))
    jobs = table(spark, d, "wiki_jobs").where("state = 'failed'").groupBy("path").agg(F.max("error").alias("error"))
    added = jobs.select(F.concat(F.lit("job-"), F.md5("path")).alias("id"), F.lit("add").alias("op"), F.concat(F.lit("Embed "), "path").alias("title"), F.lit("P2").alias("priority"), none.alias("owner"), none.alias("state"), none.alias("blocker"), none.alias("took"))
    return own.unionByName(added)


def task_changes(spark: SparkSession, d: str) -> DataFrame:
    return apply_task_changes(tasks(spark, d), _task_changes(spark, d)).drop("blocker")


def verify_pages(page_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Pages (``id``, ``content``) with a check appended to their header: events ``id``, ``by``, ``at``, ``origin``, of the present content or an older one (``revision``)."""
    both = page_rows.join(events, "id", "left")
    old = F.coalesce(F.from_json(F.trim(F.regexp_extract("content", r"(?m)^verified:([^\n]*)", 1)), VERIFIED), F.array().cast(VERIFIED))
    event = F.struct("by", "at", F.coalesce("revision", content_revision(F.col("content"))).alias("content_revision"), "origin")
    said = F.concat(F.lit("verified: "), F.to_json(F.array_append(old, event)))
    bare = F.regexp_replace("content", r"(?m)^verified:[^\n]*\n", "")
    return both.select("id", F.when(F.col("by").isNull(), F.col("content")).otherwise(F.regexp_replace(bare, r"(?s)\A---(\r?\n)", F.concat(F.lit("---$1"), F.regexp_replace(said, r"([\\$])", r"\\$1"), F.lit("\n")))).alias("content"))


def trust_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Pages after checks by people (decisions), by a process (concepts) and of an older state (sources): their tier, and whether the actor's name is one."""
    p = pages(spark, d)
    by = F.when(F.col("type") == "decision", "human:reviewer").when(F.col("type") == "concept", "index/check/v1").when(F.col("type") == "source", "human:Reviewer")
    events = p.where(by.isNotNull()).select("id", by.alias("by"), F.lit("2026-10-01").alias("at"), F.lit("local-cli").alias("origin"), F.when(F.col("type") == "source", "sha256:0").alias("revision"))
    tiers = verify_pages(p.select("id", "content"), events).join(events.select("id", "by"), "id", "left")
    return tiers.select("id", trust_tier(F.col("content")).alias("tier"), F.coalesce(F.col("by").rlike(ACTOR), F.lit(False)).alias("known_actor"))


def expired_pages(spark: SparkSession, d: str, months: int = 4) -> DataFrame:
    """Pages whose date to look again (some months after their creation) is past, by tier of trust."""
    p = pages(spark, d).select("id", F.add_months("created", months).alias("stale_after"))
    late = p.where(F.col("stale_after") < F.lit(TODAY).cast("date")).join(trust_tiers(spark, d), "id")
    return late.groupBy("tier").agg(F.count("*").alias("pages"), F.min("stale_after").alias("oldest"))


def versions(rows: DataFrame, key: str, order: list[str], keep: int = 20) -> DataFrame:
    """The last ``keep`` versions of each key, numbered from its first one; a limit per key before the shuffle."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    total = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return rows.withColumn("_k", newest).where(f"_k <= {keep}").join(total, key).withColumn("version", (F.col("_n") - F.col("_k") + 1).cast("bigint")).drop("_n", "_k")


def version_history(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "wiki_jobs").dropDuplicates(["id"]).select("path", "created", "id", "snapshot_sha")
    return versions(j, "path", ["created", "id"], 3).select("path", "version", "id", "snapshot_sha")


def rollback(spark: SparkSession, d: str) -> DataFrame:
    """Every page set back to its latest version with another content: what is there now is written down first, then the old one as a version of its own."""
    j = table(spark, d, "wiki_jobs").dropDuplicates(["id"]).select("path", F.struct("created", "id").alias("o"), "snapshot_sha")
    last = j.groupBy("path").agg(F.max("o").alias("now"), F.max_by("snapshot_sha", "o").alias("current"), F.count("*").alias("n"))
    back = j.join(last, "path").where("snapshot_sha <> current").groupBy("path", "n", "current").agg(F.max_by("snapshot_sha", "o").alias("old"))
    saved = back.select("path", (F.col("n") + 1).alias("version"), F.col("current").alias("snapshot_sha"), F.lit("saved").alias("why"))
    return saved.unionByName(back.select("path", (F.col("n") + 2).alias("version"), F.col("old").alias("snapshot_sha"), F.lit("restored").alias("why")))


def absorb(spark: SparkSession, d: str) -> DataFrame:
    """Summaries gathered under the section of their harness in each project's profile: dated lines in order, each text once."""
    s = sessions(spark, d).where("summary is not null and session_day is not null").select("project", F.concat_ws("/", "project", F.lower("harness")).alias("part"), "session_day", F.trim("summary").alias("text"))
    once = s.where("text <> ''").groupBy("part", "text").agg(F.min("session_day").alias("day"))
    placed = running_sum(once.withColumn("one", F.lit(1)), "part", ["day", "text"], "one", "pos")
    return placed.select("part", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("- "), F.col("day").cast("string"), F.lit(": "), "text").alias("line"))


def summary_append(spark: SparkSession, d: str) -> DataFrame:
    """A stamped block appended to each page's text, twice: the second time changes nothing."""
    block = F.concat(F.lit("Seen in "), "project", F.lit("\n_(index, "), F.lit(TODAY), F.lit(")_"))
    once = pages(spark, d).select("id", append_once(F.trim("body"), block).alias("once"), block.alias("block"))
    return once.select("id", F.md5("once").alias("text_md5"), (append_once(F.col("once"), F.col("block")) == F.col("once")).alias("idempotent"))


def mark_distilled(spark: SparkSession, d: str) -> DataFrame:
    """Journals of days with two or more of them get their mark once; those that have it keep it."""
    s = sessions(spark, d).select("id", "project", "session_day", F.coalesce("distilled", F.lit(False)).alias("distilled"))
    days = s.where("session_day is not null").groupBy("project", "session_day").agg(F.count("*").alias("n")).where("n >= 2")
    both = s.join(days, ["project", "session_day"], "left")
    return both.select("id", F.when(F.col("distilled"), "had").when(F.col("n").isNotNull(), "marked").otherwise("open").alias("mark"))


def task_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that new tasks would take: the slug of the title, the project before it where the slug alone is taken in another one."""
    t = tasks(spark, d).select("id", "project", slugify(F.col("title"), 40, "task").alias("slug"))
    many = t.groupBy("slug").agg(F.countDistinct("project").alias("projects"))
    return t.join(many, "slug").select("id", F.when(F.col("projects") > 1, F.concat_ws(":", "project", "slug")).otherwise(F.col("slug")).alias("new_id"))


def latest_per_name(spark: SparkSession, d: str) -> DataFrame:
    """The last page of every project and folder by name."""
    p = pages(spark, d).select("project", "folder", "slug", "id", "created")
    return p.groupBy("project", "folder").agg(F.max_by(F.struct("slug", "id", "created"), F.struct("slug", "id")).alias("b")).select("project", "folder", "b.slug", "b.id", "b.created")


def newest_first_budget(spark: SparkSession, d: str, most: int = 400) -> DataFrame:
    """The lines of each profile section from the end as far as a budget of characters goes, the first line that doesn't fit ends it."""
    a = absorb(spark, d).withColumn("size", F.length("line") + 1).withColumn("back", -F.col("pos"))
    return running_sum(a, "part", ["back"], "size", "used").where(F.col("used") <= most).select("part", "pos", F.col("used").cast("bigint").alias("used"))


def first_source(spark: SparkSession, d: str) -> DataFrame:
    """Names from three sources (wiki pages, code, texts) as one list; the first source that has a name wins."""
    c = table(spark, d, "chunks").where("func_name is not null and func_name <> ''")
    rows = (
        c.where("kind = 'wiki'").select(F.col("func_name").alias("name"), F.lit(0).alias("rank"), F.lit("wiki").alias("source"), F.col("id").alias("ref"))
        .unionByName(c.where("kind = 'code'").select(F.col("func_name").alias("name"), F.lit(1).alias("rank"), F.lit("code").alias("source"), F.col("id").alias("ref")))
        .unionByName(table(spark, d, "documents").select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("name"), F.lit(2).alias("rank"), F.lit("text").alias("source"), F.col("doc_id").alias("ref")).where("name <> ''"))
    )
    return first_by(rows, ["name"], F.col("rank"), F.col("ref")).select("name", "source", "ref")


QUERIES = {
    "page_merge": page_merge, "page_upsert": page_upsert, "index_append": index_append, "log_append": log_append, "log_tail": log_tail, "task_changes": task_changes, "trust_tiers": trust_tiers, "expired_pages": expired_pages,
    "version_history": version_history, "rollback": rollback, "absorb": absorb, "summary_append": summary_append, "mark_distilled": mark_distilled, "task_ids": task_ids, "latest_per_name": latest_per_name,
    "newest_first_budget": newest_first_budget, "first_source": first_source,
}

from .audit import _PAGES  # noqa: E402
from .journal import _S  # noqa: E402
from .roadmap import _T  # noqa: E402

_SEC = rf"""(select id, pos, section, text from (select id, pos, case when pos = 0 then '' else trim(regexp_extract(part, '^([^\r\n]*)', 1)) end as section,
    regexp_replace(case when pos = 0 then part else regexp_replace(part, '^[^\r\n]*\r?\n?', '') end, '^\s+|\s+$', '', 'g') as text
  from (select id, i::bigint - 1 as pos, parts[i] as part from (select id, parts, unnest(range(1, len(parts) + 1)) as i from (select id, regexp_split_to_array(body, '(?m)^##[ \t]+') as parts from {_PAGES})))) where pos > 0 or text <> '')"""
_ONCE = "select id, section, min(pos) as pos, max_by(text, pos) as text from {0} group by all"
_MERGED = f"""(with o as ({_ONCE.format(_SEC)}), c as (select id, 0 as pos, section, text || chr(10) || chr(10) || '(read)' as text from (select *, row_number() over (partition by id order by pos) as r from {_SEC} where section <> '') where r = 1
    union all select id, 1, 'Place', concat_ws(' ', project, path) from {_PAGES}), n as (select id, section, min(pos) as np, trim(max_by(text, pos)) as nt from c group by all)
  select id, (row_number() over (partition by id order by pos nulls last, np, section))::bigint as pos, section, coalesce(nt, text) as text, case when np is null then 'kept' when pos is null then 'added' else 'replaced' end as action from o full join n using (id, section))"""
_TAGS = r"array_to_string(list_concat(own, list_filter([type, case when folder is distinct from type then folder end], lambda t: t is not null and not list_contains(own, t))), ', ')"
_LOGROWS = f"""(select *, case when refused is null then '## [' || day || '] ' || type || ' | ' || trim(text) end as line from (select *, case when day is null then 'no_day' when not coalesce(regexp_matches(type, '{LOG_TYPE}'), false) then 'type' when trim(coalesce(text, '')) = '' then 'empty'
    when regexp_matches(text, '[\\r\\n]') then 'lines' when length(text) > {LOG_LENGTH} then 'length' end as refused
  from (select id, session_day as day, 'session:' || lower(harness) as type, coalesce(summary, array_to_string(prompts, '; ')) as text from {_S} union all select id, done, 'task', title from {_T} where done is not null)))"""
_TIERS = f"(select id, case type when 'decision' then 'human-reviewed' when 'concept' then 'machine-confirmed' when 'source' then 'stale' else 'unverified' end as tier, coalesce(type in ('decision', 'concept'), false) as known_actor, created from {_PAGES})"
_JOBS = "(select distinct on (id) path, created, id, snapshot_sha from wiki_jobs)"
_ABSORB = f"(select part, (row_number() over (partition by part order by day, text))::bigint as pos, '- ' || day || ': ' || text as line from (select concat_ws('/', project, lower(harness)) as part, trim(summary) as text, min(session_day) as day from {_S} where summary is not null and session_day is not null and trim(summary) <> '' group by all))"
_SLUG40 = "coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', ''), ''), 'task')"
_OP = "case when state = 'in-progress' and priority in ('P0', 'P1') then 'complete' when state = 'open' and priority = 'P0' then 'block' when state = 'open' and owner is null then 'update' end"

SQL = {
    "page_merge": f"select id, pos, section, action, md5(text) as text_md5 from {_MERGED}",
    "page_upsert": rf"""with b as (select id, string_agg(case when section = '' then text else '## ' || section || chr(10) || chr(10) || text end, chr(10) || chr(10) order by pos) || chr(10) as nb, count(*)::bigint as n_sections from {_MERGED} group by id),
      p as (select *, {_TAGS} as tag_list from (select *, list_distinct_order as own from (select *, coalesce(list_filter(list_transform(string_split(regexp_replace(tags, '^\[|\]$', '', 'g'), ','), lambda t: trim(t)), lambda t: t <> ''), []) as list_distinct_order from {_PAGES})))
      select id, tag_list, n_sections, 'sha256:' || sha256('---' || chr(10) || concat_ws(chr(10), 'title: ' || title, 'type: ' || type, 'created: ' || created, 'updated: {TODAY}', 'tags: [' || tag_list || ']') || chr(10) || '---' || chr(10) || chr(10) || nb) as revision from p join b using (id)""",
    "index_append": f"""with p as (select folder, id, '- [[' || stem || ']]' as line, created from {_PAGES} where folder <> ''), o as (select folder, line, (row_number() over (partition by folder order by min(id), line))::bigint as pos from p where created < date '2026-07-01' group by folder, line)
      select folder, pos, line, 'kept' as action from o union all select folder, (coalesce(last, 0) + row_number() over (partition by folder order by o2, line))::bigint, line, 'added' from (select folder, line, min(id) as o2 from p where (folder, line) not in (select (folder, line) from o) group by all) left join (select folder, max(pos) as last from o group by folder) using (folder)""",
    "log_append": f"select id, refused, md5(line) as line_md5 from {_LOGROWS}",
    "log_tail": f"select id, day as log_day, type as log_type, trim(text) as log_text from {_LOGROWS} where line is not null order by day desc, type, trim(text), id limit 50",
    "task_changes": f"""with t as (select id, project, section, state, priority, title, owner, added, done, took, est, {_OP} as op, md5(id) < '8' as odd from {_T}),
      a as (select *, case when op is null then 'kept' when op = 'update' and odd then 'refused: priority' when op = 'block' and trim(coalesce(est, '')) = '' then 'refused: blocker' when op = 'complete' then 'completed' when op = 'block' then 'blocked' else 'updated' end as action from t)
      select id, project, case action when 'completed' then 'Done' when 'blocked' then 'Blocked' else section end as section, case action when 'completed' then 'done' when 'blocked' then 'blocked' else state end as state, title, priority, case when action = 'updated' then 'nobody' else owner end as owner,
        case when action in ('completed', 'blocked', 'updated') then '1d' else took end as took, added, case when action = 'completed' then date '{TODAY}' else done end as done, action from a
      union all select 'job-' || md5(path), null, 'Open', 'open', 'Embed ' || path, 'P2', null, null, date '{TODAY}', null, 'added' from wiki_jobs where state = 'failed' group by path""",
    "trust_tiers": f"select id, tier, known_actor from {_TIERS}",
    "expired_pages": f"select tier, count(*)::bigint as pages, min(created + interval 4 month)::date as oldest from {_TIERS} where created + interval 4 month < date '{TODAY}' group by tier",
    "version_history": f"select path, version, id, snapshot_sha from (select *, (row_number() over (partition by path order by created, id))::bigint as version, row_number() over (partition by path order by created desc, id desc) as k from {_JOBS}) where k <= 3",
    "rollback": f"""with l as (select path, last(snapshot_sha order by created, id) as current, count(*)::bigint as n from {_JOBS} group by path), b as (select path, n, current, last(snapshot_sha order by created, id) as old from {_JOBS} join l using (path) where snapshot_sha <> current group by all)
      select path, n + 1 as version, current as snapshot_sha, 'saved' as why from b union all select path, n + 2, old, 'restored' from b""",
    "absorb": f"select * from {_ABSORB}",
    "summary_append": f"""select id, md5(case when trim(body) = '' then block when contains(trim(body), block) then trim(body) else trim(body) || chr(10) || chr(10) || block end) as text_md5, true as idempotent from (select *, 'Seen in ' || project || chr(10) || '_(index, {TODAY})_' as block from {_PAGES})""",
    "mark_distilled": f"select id, case when coalesce(distilled, false) then 'had' when n >= 2 and session_day is not null then 'marked' else 'open' end as mark from (select *, count(*) over (partition by project, session_day) as n from {_S})",
    "task_ids": f"select id, case when projects > 1 then concat_ws(':', project, slug) else slug end as new_id from (select id, project, {_SLUG40} as slug from {_T}) join (select {_SLUG40} as slug, count(distinct project) as projects from {_T} group by 1) using (slug)",
    "latest_per_name": f"select project, folder, slug, id, created from (select *, row_number() over (partition by project, folder order by slug desc, id desc) as r from {_PAGES}) where r = 1",
    "newest_first_budget": f"select part, pos, used from (select part, pos, (sum(length(line) + 1) over (partition by part order by pos desc))::bigint as used from {_ABSORB}) where used <= 400",
    "first_source": r"""select distinct on (name) name, source, ref from (select func_name as name, case when kind = 'wiki' then 0 else 1 end as rank, case when kind = 'wiki' then 'wiki' else 'code' end as source, id as ref from chunks where func_name <> ''
      union all select regexp_extract(path, '([^/]*)\.md$', 1), 2, 'text', doc_id from documents) where name <> '' order by name, rank, ref""",
}
