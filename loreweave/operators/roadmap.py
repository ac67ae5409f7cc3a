"""Task lines of the roadmap: lists, counts, triage, archive, ids, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..session import table

TODAY = "2026-11-01"
# States and priorities in the order of lists, and the signs of task lines.
STATES = ("in-progress", "blocked", "open", "done", "cancelled")
PRIORITIES = ("P0", "P1", "P2", "P3")
SIGNS = {"open": " ", "in-progress": "~", "done": "x", "blocked": "!", "cancelled": "-"}


def plain_status(status: Column) -> Column:
    """The state behind odd spellings; unknown states stay as they are, in lower case."""
    s = F.lower(F.trim(status))
    return F.when(s.isin("wip", "doing", "started", "in progress"), "in-progress").when(s.isin("todo", "new"), "open").when(s.isin("closed", "complete", "completed"), "done").otherwise(s)


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").dropDuplicates(["id"]).withColumn("state", plain_status(F.col("status")))


def _place(values: tuple[str, ...], c: str) -> Column:
    at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(values) + 1).otherwise(at)


def task_list(spark: SparkSession, d: str) -> DataFrame:
    """Open work of owners, by state, priority and age; tasks without a date come first among equals."""
    t = tasks(spark, d).where("state in ('open', 'in-progress', 'blocked') and owner is not null")
    ordered = t.orderBy(_place(STATES, "state"), _place(PRIORITIES, "priority"), F.asc_nulls_first("added"), "id").limit(60)
    return ordered.select("id", "project", "state", "priority", "title", "owner", "added")


def task_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of every known state, zero where there is none, over all tasks."""
    known = spark.createDataFrame([(s,) for s in STATES], "state string")
    counts = tasks(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))
    return known.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("tasks"), F.coalesce("projects", F.lit(0)).alias("projects"))


def task_triage(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that need a look: not started for two weeks, urgent without an estimate, too long in progress or blocked."""
    age = lambda c: F.datediff(F.lit(TODAY).cast("date"), F.col(c) if isinstance(c, str) else c)
    reasons = F.array_compact(F.array(
        F.when((F.col("state") == "open") & (age("added") > 14) & F.col("started").isNull(), "unstarted"),
        F.when(F.col("priority").isin("P0", "P1") & F.col("est").isNull() & (F.col("state") != "done"), "no_estimate"),
        F.when((F.col("state") == "in-progress") & (age("started") > 7), "slow"),
        F.when((F.col("state") == "blocked") & (age(F.coalesce("started", "added")) > 7), "stuck"),
    ))
    return tasks(spark, d).select("id", "project", F.explode(reasons).alias("reason"))


def roadmap_focus(spark: SparkSession, d: str) -> DataFrame:
    """Per project the five most urgent open tasks and two in progress."""
    t = tasks(spark, d)
    rank = lambda *o: F.row_number().over(Window.partitionBy("project").orderBy(*o)).cast("bigint")
    urgent = t.where("state = 'open' and priority in ('P0', 'P1')").withColumn("k", rank("priority", F.asc_nulls_first("added"), "id")).where("k <= 5").withColumn("list", F.lit("urgent"))
    doing = t.where("state = 'in-progress'").withColumn("k", rank(F.asc_nulls_first("started"), "id")).where("k <= 2").withColumn("list", F.lit("doing"))
    return urgent.unionByName(doing).select("project", "list", "k", "id", "title")


def task_archive(spark: SparkSession, d: str, days: int = 30) -> DataFrame:
    """Done tasks older than ``days`` leave for the archive of today's quarter, one that is there already is left out; the rest stays."""
    t = tasks(spark, d)
    old = (F.col("state") == "done") & (F.col("done") < F.date_sub(F.lit(TODAY).cast("date"), days))
    quarter = F.concat(F.lit("archive-"), F.lit(TODAY[:4]), F.lit("-Q"), F.quarter(F.lit(TODAY).cast("date")).cast("string"))
    archived = t.where("lower(section) = 'archive'").select("id")
    moved = t.where(old).join(archived, "id", "left_anti")
    return moved.select("id", "project", "done", quarter.alias("archive"))


def legacy_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of old lines: the slug of the title, numbered within the project where titles meet, and whether the alias is ambiguous."""
    t = tasks(spark, d).withColumn("slug", slugify(F.col("title"), 60, "task"))
    w = Window.partitionBy("project", "slug")
    n = F.row_number().over(w.orderBy(F.asc_nulls_last("pos"), "id"))
    return t.withColumn("n", n).withColumn("of", F.count("*").over(w)).select(
        "id", "project", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"))).alias("legacy_id"), (F.col("of") > 1).alias("ambiguous")
    )


def task_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each task as its text line: sign, priority, title, then the known fields that are set, then the other ones by name."""
    sign = F.coalesce(*[F.when(F.col("state") == s, F.lit(c)) for s, c in SIGNS.items()], F.lit("?"))
    field = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    extra = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("extra", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), " | ")
    head = F.concat(F.lit("- ["), sign, F.lit("] "), F.when(F.col("priority").isNotNull(), F.concat(F.col("priority"), F.lit(" "))).otherwise(""), F.regexp_replace(F.coalesce("title", F.lit("")), r"[|\r\n]+", " "))
    return tasks(spark, d).select("id", F.concat_ws(" | ", head, *[field(c) for c in ("est", "owner", "added", "started", "done", "took", "blocker")], F.nullif(extra, F.lit(""))).alias("line"))


QUERIES = {
    "task_list": task_list, "task_counts": task_counts, "task_triage": task_triage, "roadmap_focus": roadmap_focus, "task_archive": task_archive, "legacy_ids": legacy_ids, "task_lines": task_lines,
}

_STATE = "case when lower(trim(status)) in ('wip', 'doing', 'started', 'in progress') then 'in-progress' when lower(trim(status)) in ('todo', 'new') then 'open' when lower(trim(status)) in ('closed', 'complete', 'completed') then 'done' else lower(trim(status)) end"
_T = f"(select *, {_STATE} as state from (select distinct on (id) * from tasks))"
_AT = lambda values, c: "case " + " ".join(f"when {c} = '{v}' then {i}" for i, v in enumerate(values, 1)) + f" else {len(values) + 1} end"
_SIGN = "case " + " ".join(f"when state = '{s}' then '{c}'" for s, c in SIGNS.items()) + " else '?' end"
_FIELDS = ", ".join(f"'{c}: ' || {c}" for c in ("est", "owner", "added", "started", "done", "took", "blocker"))

SQL = {
    "task_list": f"select id, project, state, priority, title, owner, added from {_T} where state in ('open', 'in-progress', 'blocked') and owner is not null order by {_AT(STATES, 'state')}, {_AT(PRIORITIES, 'priority')}, added nulls first, id limit 60",
    "task_counts": f"select state, coalesce(n, 0)::bigint as tasks, coalesce(projects, 0)::bigint as projects from (select unnest({list(STATES)}) as state) left join (select state, count(*) as n, count(distinct project) as projects from {_T} group by all) using (state)",
    "task_triage": f"""select id, project, reason from (select id, project, unnest([case when state = 'open' and date '{TODAY}' - added > 14 and started is null then 'unstarted' end, case when priority in ('P0', 'P1') and est is null and state <> 'done' then 'no_estimate' end,
      case when state = 'in-progress' and date '{TODAY}' - started > 7 then 'slow' end, case when state = 'blocked' and date '{TODAY}' - coalesce(started, added) > 7 then 'stuck' end]) as reason from {_T}) where reason is not null""",
    "roadmap_focus": f"""select project, list, k, id, title from (select *, 'urgent' as list, row_number() over (partition by project order by priority, added nulls first, id)::bigint as k from {_T} where state = 'open' and priority in ('P0', 'P1')) where k <= 5
      union all select project, list, k, id, title from (select *, 'doing' as list, row_number() over (partition by project order by started nulls first, id)::bigint as k from {_T} where state = 'in-progress') where k <= 2""",
    "task_archive": f"select id, project, done, 'archive-2026-Q4' as archive from {_T} where state = 'done' and done < date '{TODAY}' - 30 and id not in (select id from tasks where lower(section) = 'archive' and id is not null)",
    "legacy_ids": f"""select id, project, case when n = 1 then slug else slug || '-' || n end as legacy_id, c > 1 as ambiguous from (select id, project, slug, row_number() over (partition by project, slug order by pos nulls last, id) as n, count(*) over (partition by project, slug) as c
      from (select *, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'task') as slug from {_T}))""",
    "task_lines": f"""select id, concat_ws(' | ', '- [' || {_SIGN} || '] ' || coalesce(priority || ' ', '') || regexp_replace(coalesce(title, ''), '[|\\r\\n]+', ' ', 'g'), {_FIELDS},
      nullif(array_to_string(list_transform(list_sort(map_entries(extra)), lambda e: e.key || ': ' || coalesce(e.value, '')), ' | '), '')) as line from {_T}""",
}
