"""Session journals and message events: classification, retention, triage, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import duration_text
from ..session import first_by, running_sum, table

TODAY = "2026-11-01"
# Tools that write, parts of names of such tools, and words that make a short journal worth keeping.
WRITE_TOOLS = (
    "Write", "Edit", "MultiEdit", "NotebookEdit", "write_to_file", "replace_file_content", "wiki.upsert_entity", "wiki.upsert_concept", "wiki.upsert_source", "wiki.upsert_analysis",
    "wiki.update_overview", "wiki.log_append", "roadmap.add", "roadmap.update", "roadmap.complete", "skill.save", "skill.patch",
)
WRITE_PARTS = ("__Write", "__Edit", "wiki_upsert_", "wiki_update_overview", "wiki_log_append", "roadmap_add", "roadmap_update", "roadmap_complete", "skill_save", "skill_patch")
SIGNALS = (
    "decisione", "decision", "split", "design", "breaking", "ship", "release", "migra", "migrat", "refactor", "architett", "architecture", "roadmap", "piano", "deploy", "bump", "security", "sicurezza",
)
# Days after which journals of a kind leave, and after which the archive forgets those without a summary.
SHORT_DAYS, DISTILLED_DAYS, WORTH_DAYS, PURGE_DAYS = 14, 14, 30, 180


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct journals; a journal written again is the same row."""
    return table(spark, d, "sessions").dropDuplicates(["id"])


def programmatic_reason() -> Column:
    """Why a session was no person's: the first rule that holds, or null."""
    entry, reason = F.lower(F.coalesce(F.col("entrypoint"), F.lit(""))), F.lower(F.coalesce(F.col("end_reason"), F.lit("")))
    n, secs = F.coalesce(F.col("messages_user"), F.lit(0)), F.coalesce(F.col("duration_s"), F.lit(0))
    return (
        F.when(entry.startswith("sdk"), F.concat(F.lit("entrypoint:"), entry)).when(n <= 0, "no-user-messages")
        .when((n == 1) & (secs < 30) & reason.isin("other", ""), "one-shot<30s")
    )


def worth() -> Column:
    """Whether a journal is worth a page: enough messages and time, and many messages, a writing tool or a signal word."""
    n, secs = F.coalesce(F.col("messages_user"), F.lit(0)), F.coalesce(F.col("duration_s"), F.lit(0))
    wrote = F.exists(F.coalesce("tools", F.array().cast("array<string>")), lambda t: F.coalesce(t.isin(*WRITE_TOOLS) | t.rlike("|".join(WRITE_PARTS)), F.lit(False)))
    said = F.lower(F.array_join(F.coalesce("prompts", F.array().cast("array<string>")), " "))
    signal = said.rlike("|".join(SIGNALS))
    return (n >= 3) & (secs >= 300) & ((n >= 8) | wrote | signal)


def session_flags(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).select("id", programmatic_reason().alias("programmatic"), worth().alias("worth"), duration_text(F.col("duration_s")).alias("duration"))


def _age() -> Column:
    return F.datediff(F.lit(TODAY).cast("date"), F.coalesce(F.col("session_day"), F.to_date("started")))


def _why() -> Column:
    """Action and reason of the compaction; the first rule that holds wins."""
    short = (F.coalesce("messages_user", F.lit(0)) < 3) | (F.coalesce("duration_s", F.lit(0)) < 300)
    return (
        F.when(F.col("archived"), "keep:already-archived").when(programmatic_reason().isNotNull(), F.concat(F.lit("machine:"), programmatic_reason()))
        .when(F.col("distilled"), F.when(_age() >= DISTILLED_DAYS, "archive:distilled").otherwise("keep:distilled, recent"))
        .when(short, F.when(_age() >= SHORT_DAYS, "archive:short").otherwise("keep:short, recent"))
        .when(_age() >= WORTH_DAYS, "archive:worth stale").otherwise("keep:worth")
    )


def compact_actions(spark: SparkSession, d: str) -> DataFrame:
    """What the compaction does with each journal, and why; the first rule wins."""
    why = _why()
    return sessions(spark, d).select("id", F.substring_index(why, ":", 1).alias("action"), F.regexp_replace(why, "^[a-z]+:", "").alias("why"), _age().cast("bigint").alias("age_days"))


def compact_report(spark: SparkSession, d: str) -> DataFrame:
    return compact_actions(spark, d).groupBy("action", F.regexp_extract("why", r"^([^,(]+)", 1).alias("reason")).agg(F.count("*").alias("sessions"), F.max("age_days").alias("oldest"))


def action_budget(spark: SparkSession, d: str, budget: int = 40) -> DataFrame:
    """The first actions of a run per project, in order of id, as far as the budget goes."""
    acts = sessions(spark, d).withColumn("action", F.substring_index(_why(), ":", 1)).withColumn("is_action", (F.col("action") != "keep").cast("int")).select("id", "project", "action", "is_action")
    return running_sum(acts, "project", ["id"], "is_action", "used").where(f"is_action = 1 and used <= {budget}").select("id", "project", "action", F.col("used").cast("bigint").alias("used"))


def archive_purge(spark: SparkSession, d: str, cap: int = 2) -> DataFrame:
    """What the archive of each project forgets: rows without a summary beyond the age, then, as long as more than ``cap`` remain, the oldest without one."""
    bare = F.length(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?s)<!--.*?-->", ""))) == 0
    s = sessions(spark, d).where("archived").select("id", "project", "session_day", bare.alias("bare"), _age().alias("age"))
    old = s.where(F.col("bare") & (F.col("age") >= PURGE_DAYS)).select("id", "project", F.lit("age").alias("why"))
    rest = s.where(~(F.col("bare") & (F.coalesce("age", F.lit(0)) >= PURGE_DAYS)))
    over = rest.groupBy("project").agg((F.count("*") - cap).alias("over")).where("over > 0")
    placed = running_sum(rest.where("bare").withColumn("one", F.lit(1)), "project", ["session_day", "id"], "one", "k")
    return old.unionByName(placed.join(over, "project").where("k <= over").select("id", "project", F.lit("cap").alias("why")))


def session_list(spark: SparkSession, d: str, limit: int = 50) -> DataFrame:
    return sessions(spark, d).where("not archived").orderBy(F.desc("session_day"), F.desc("id")).limit(limit).select("id", "project", "session_day", "messages_user")


def sessions_index(spark: SparkSession, d: str) -> DataFrame:
    """The day section of the index: active and archived journals, the ids of the active ones in order (a day of a project is bounded by its people)."""
    s = sessions(spark, d)
    ids = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("archived"), F.col("id")))), " ")
    return s.groupBy("project", "session_day").agg(F.count_if(~F.col("archived")).alias("active"), F.count_if(F.col("archived")).alias("in_archive"), ids.alias("ids"))


def message_events(spark: SparkSession, d: str) -> DataFrame:
    """Message rows, repeated rows once: the last received of each session, file and line.

    Of the content only the tools it calls are kept, so that no text goes through the shuffle.
    """
    content = F.coalesce(F.col("message.content"), F.lit(""))
    calls = F.size(F.regexp_extract_all(content, F.lit('"type": "(tool_use)"'), 1))
    tools = F.regexp_extract_all(content, F.lit('"type": "tool_use", "name": "([^"]+)"'), 1)
    t = table(spark, d, "transcript").select("row_id", "session_id", "transcript_path", "line_no", "event_type", "entrypoint", calls.alias("calls"), tools.alias("tools"), "received_at")
    return first_by(t, ["session_id", "transcript_path", "line_no"], -F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)), -F.col("row_id"))


def event_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per session: rows, user and assistant rows, files, first entry point by line, tool calls."""
    e = message_events(spark, d)
    return e.groupBy("session_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("event_type") == "user").alias("user_rows"), F.count_if(F.col("event_type") == "assistant").alias("assistant_rows"),
        F.countDistinct("transcript_path").alias("files"), F.min_by("entrypoint", F.when(F.col("entrypoint").isNotNull(), F.struct("transcript_path", "line_no"))).alias("entrypoint"), F.sum("calls").alias("tool_calls"),
    )


def tool_usage(spark: SparkSession, d: str, top: int = 3) -> DataFrame:
    """The most used tools of each session."""
    e = message_events(spark, d)
    used = e.select("session_id", F.explode("tools").alias("tool")).groupBy("session_id", "tool").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("uses"), "tool"))
    return used.withColumn("place", rank.cast("bigint")).where(f"place <= {top}")


def transcript_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether each journal's transcript is archived, at hand, or the journal stands alone; and transcripts without a journal."""
    s = sessions(spark, d).select("id", "cc_session_id", "archived")
    t = table(spark, d, "transcript").select(F.col("session_id").alias("cc_session_id")).distinct().withColumn("there", F.lit(1))
    both = s.join(t, "cc_session_id", "full_outer")
    status = F.when(F.col("id").isNull(), "no_journal").when(F.col("there").isNull(), "journal_only").when(F.col("archived"), "archived").otherwise("available")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("sessions"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Sessions, task dates and jobs as one stream of the last 30 days; newest 100."""
    day = lambda c: F.col(c).cast("date")
    s = sessions(spark, d).select(day("session_day").alias("day"), F.lit("session").alias("type"), F.col("id").alias("ref"), "project")
    tasks = table(spark, d, "tasks").dropDuplicates(["id"])
    done = tasks.where("done is not null").select(day("done").alias("day"), F.lit("task:done").alias("type"), F.col("id").alias("ref"), "project")
    added = tasks.where("added is not null").select(day("added").alias("day"), F.lit("task:added").alias("type"), F.col("id").alias("ref"), "project")
    every = s.unionByName(done).unionByName(added).where(F.col("day").between(F.date_sub(F.lit(TODAY).cast("date"), 30), F.lit(TODAY).cast("date")))
    return every.orderBy(F.desc("day"), "type", "ref").limit(100)


def timeline_counts(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks").dropDuplicates(["id"])
    every = (
        sessions(spark, d).select(F.lit("session").alias("type"), F.col("session_day").alias("day"))
        .unionByName(tasks.select(F.lit("task:done").alias("type"), F.col("done").alias("day"))).unionByName(tasks.select(F.lit("task:added").alias("type"), F.col("added").alias("day")))
    )
    return every.where("day is not null").groupBy(F.split("type", ":")[0].alias("kind"), F.trunc("day", "month").alias("month")).agg(F.count("*").alias("events"))


def _day_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Project's days with their number of sessions, and their distinct prompt words, a row each."""
    s = sessions(spark, d).where("session_day is not null")
    counts = s.groupBy("project", "session_day").agg(F.count("*").alias("n"))
    said = s.select("project", "session_day", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.array_join("prompts", " ")), F.lit(r"([\p{L}\p{N}_]{4,})"), 1))).alias("word")).distinct()
    return counts, said


def triage_days(spark: SparkSession, d: str) -> DataFrame:
    """Words of each project's day and their Jaccard similarity with the day before: what an ordered merge of days starts from. Words are joined, not gathered."""
    counts, said = _day_words(spark, d)
    sizes = counts.join(said.groupBy("project", "session_day").agg(F.count("*").alias("words")), ["project", "session_day"], "left").withColumn("words", F.coalesce("words", F.lit(0)))
    after = lambda rows, *c: rows.select("project", F.date_add("session_day", 1).alias("session_day"), *c)
    shared = said.join(after(said, "word"), ["project", "session_day", "word"]).groupBy("project", "session_day").agg(F.count("*").alias("shared"))
    both = sizes.join(after(sizes, F.col("words").alias("old")), ["project", "session_day"], "left").join(shared, ["project", "session_day"], "left")
    common = F.coalesce("shared", F.lit(0))
    union = F.col("words") + F.col("old") - common
    return both.select("project", "session_day", F.col("n").alias("sessions"), "words", F.when(union > 0, F.round(common / union, 6)).alias("with_day_before"))


def triage_clusters(spark: SparkSession, d: str, least: float = 0.3) -> DataFrame:
    """Adjacent days of a project merged while the words gathered so far and the day's words overlap by more than ``least``.

    An ordered fold over a run of days without a gap; its state is bounded by the days of such a run and the vocabulary, not by the rows.
    """
    counts, said = _day_words(spark, d)
    w = Window.partitionBy("project").orderBy("session_day")  # a row per day
    gap = F.datediff("session_day", F.lag("session_day").over(w))
    runs = counts.withColumn("run", F.sum(F.when(gap == 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = said.groupBy("project", "session_day").agg(F.collect_set("word").alias("words"))
    days = runs.join(words, ["project", "session_day"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    ordered = days.groupBy("project", "run").agg(F.array_sort(F.collect_list(F.struct("session_day", "n", "words"))).alias("days"))
    empty = F.expr("cast(array() as array<struct<first:date,last:date,n:bigint,words:array<string>>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        union = F.size(F.array_union(last["words"], x["words"]))
        merge = F.coalesce((union > 0) & (F.size(F.array_intersect(last["words"], x["words"])) / union > least), F.lit(False))
        cluster = lambda first, n, words: F.struct(first.alias("first"), x["session_day"].alias("last"), n.alias("n"), words.alias("words"))
        return F.when(
            merge, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(cluster(last["first"], last["n"] + x["n"], F.array_union(last["words"], x["words"]))))
        ).otherwise(F.concat(acc, F.array(cluster(x["session_day"], x["n"], x["words"]))))

    folded = ordered.select("project", F.explode(F.aggregate("days", empty, step)).alias("c"))
    return folded.select("project", F.col("c.first").alias("first_day"), F.col("c.last").alias("last_day"), F.col("c.n").alias("sessions"), F.size("c.words").cast("bigint").alias("words"))


def journal_merge(spark: SparkSession, d: str) -> DataFrame:
    """Keyed merge of what the transcripts say into the journals: counts from the events win, the journal's own id and summary stay."""
    s = first_by(sessions(spark, d).select("cc_session_id", "id", "summary", "messages_user", "messages_assistant"), ["cc_session_id"], F.col("id"))
    e = message_events(spark, d).groupBy("session_id").agg(F.count_if(F.col("event_type") == "user").alias("u"), F.count_if(F.col("event_type") == "assistant").alias("a"))
    both = s.join(e.withColumnRenamed("session_id", "cc_session_id"), "cc_session_id", "full_outer")
    return both.select(
        "cc_session_id", "id", F.coalesce("u", F.col("messages_user").cast("bigint")).alias("messages_user"), F.coalesce("a", F.col("messages_assistant").cast("bigint")).alias("messages_assistant"),
        F.when(F.col("id").isNull(), "insert").when(F.col("u").isNull(), "keep").otherwise("update").alias("action"),
    )


def pending_summaries(spark: SparkSession, d: str, hours: int = 24 * 30, top: int = 3) -> DataFrame:
    """Per project the newest journals worth a summary that have none yet, ended within the last hours."""
    bare = F.length(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?s)<!--.*?-->", ""))) == 0
    recent = F.col("ended") >= F.lit(TODAY).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    s = sessions(spark, d).where(recent & bare & ~F.col("archived") & (F.coalesce("messages_user", F.lit(0)) >= 2)).select("id", "project", "ended")
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("ended"), "id"))
    return s.withColumn("place", rank.cast("bigint")).where(f"place <= {top}")


def attached_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls between two spoken messages of the assistant, counted with the message that follows; what follows none goes with a last one of its own."""
    said = F.coalesce(F.col("message.content").rlike('"type": "text"') | ~F.col("message.content").rlike(r"^\s*\["), F.lit(False))
    speaks = (F.coalesce(F.col("event_type"), F.lit("")) == "assistant") & said
    calls = F.size(F.regexp_extract_all(F.coalesce(F.col("message.content"), F.lit("")), F.lit('"type": "(tool_use)"'), 1))
    t = table(spark, d, "transcript").select("row_id", "session_id", "transcript_path", "line_no", "received_at", speaks.cast("int").alias("speaks"), calls.alias("calls"))
    e = first_by(t, ["session_id", "transcript_path", "line_no"], -F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)), -F.col("row_id"))
    counted = running_sum(e.select("session_id", "transcript_path", "line_no", "speaks", "calls"), "session_id", ["transcript_path", "line_no"], "speaks", "n")
    return counted.groupBy("session_id", (F.col("n") - F.col("speaks")).alias("message_no")).agg(F.sum("calls").alias("tools"), F.max("speaks").cast("bigint").alias("spoken")).where("tools > 0 or spoken > 0")


QUERIES = {
    "pending_summaries": pending_summaries, "attached_tools": attached_tools,
    "session_flags": session_flags, "compact_actions": compact_actions, "compact_report": compact_report, "action_budget": action_budget, "archive_purge": archive_purge, "session_list": session_list,
    "sessions_index": sessions_index, "event_stats": event_stats, "tool_usage": tool_usage, "transcript_status": transcript_status, "timeline": timeline, "timeline_counts": timeline_counts,
    "triage_days": triage_days, "triage_clusters": triage_clusters, "journal_merge": journal_merge,
}

_S = "(select distinct on (id) * from sessions)"
_T = "(select distinct on (id) * from tasks)"
_PROG = "case when starts_with(lower(coalesce(entrypoint, '')), 'sdk') then 'entrypoint:' || lower(entrypoint) when coalesce(messages_user, 0) <= 0 then 'no-user-messages' when messages_user = 1 and coalesce(duration_s, 0) < 30 and lower(coalesce(end_reason, '')) in ('other', '') then 'one-shot<30s' end"
_WORTH = f"""(coalesce(messages_user, 0) >= 3 and coalesce(duration_s, 0) >= 300 and (messages_user >= 8 or coalesce(list_has_any(tools, {list(WRITE_TOOLS)}) or regexp_matches(array_to_string(tools, ' '), '{"|".join(WRITE_PARTS)}'), false)
  or regexp_matches(coalesce(lower(array_to_string(prompts, ' ')), ''), '{"|".join(SIGNALS)}')))"""
_AGE = f"(date '{TODAY}' - coalesce(session_day, started::date))"
_WHY = f"""case when archived then 'keep:already-archived' when {_PROG} is not null then 'machine:' || {_PROG} when distilled then case when {_AGE} >= {DISTILLED_DAYS} then 'archive:distilled' else 'keep:distilled, recent' end
  when coalesce(messages_user, 0) < 3 or coalesce(duration_s, 0) < 300 then case when {_AGE} >= {SHORT_DAYS} then 'archive:short' else 'keep:short, recent' end when {_AGE} >= {WORTH_DAYS} then 'archive:worth stale' else 'keep:worth' end"""
_ACT = rf"(select id, project, split_part({_WHY}, ':', 1) as action, regexp_replace({_WHY}, '^[a-z]+:', '') as why, {_AGE}::bigint as age_days from {_S})"
_EV = "(select * replace (message.role as role, message.content as content) from (select *, null::varchar as role, null::varchar as content from transcript qualify row_number() over (partition by session_id, transcript_path, line_no order by received_at desc nulls last, row_id desc) = 1))"
_WORDS = r"list_distinct(flatten(list(regexp_extract_all(lower(array_to_string(prompts, ' ')), '[\p{L}\p{N}_]{4,}'))))"

SQL = {
    "pending_summaries": f"""select id, project, ended, place from (select id, project, ended, row_number() over (partition by project order by ended desc, id)::bigint as place from {_S}
      where ended >= timestamp '{TODAY}' - interval 720 hour and length(trim(regexp_replace(coalesce(summary, ''), '(?s)<!--.*?-->', '', 'g'))) = 0 and not archived and coalesce(messages_user, 0) >= 2) where place <= 3""",
    "attached_tools": rf"""select session_id, message_no, tools, spoken from (select session_id, (n - speaks)::bigint as message_no, sum(calls)::bigint as tools, max(speaks)::bigint as spoken
      from (select *, sum(speaks) over (partition by session_id order by transcript_path, line_no rows unbounded preceding) as n from (select session_id, transcript_path, line_no, len(regexp_extract_all(coalesce(content, ''), '"type": "tool_use"')) as calls,
        (coalesce(event_type, '') = 'assistant' and coalesce(regexp_matches(content, '"type": "text"') or not regexp_matches(content, '^\s*\['), false))::int as speaks from {_EV})) group by all) where tools > 0 or spoken > 0""",
    "session_flags": f"""select id, {_PROG} as programmatic, {_WORTH} as worth, case when duration_s is null or duration_s < 0 then '0s' when duration_s < 60 then duration_s || 's'
      when duration_s < 3600 then (duration_s // 60) || 'm ' || (duration_s % 60) || 's' else (duration_s // 3600) || 'h ' || (duration_s % 3600 // 60) || 'm' end as duration from {_S}""",
    "compact_actions": f"select id, action, why, age_days from {_ACT}",
    "compact_report": f"select action, regexp_extract(why, '^([^,(]+)', 1) as reason, count(*)::bigint as sessions, max(age_days)::bigint as oldest from {_ACT} group by all",
    "action_budget": f"""select id, project, action, used from (select id, project, action, (sum((action <> 'keep')::int) over (partition by project order by id))::bigint as used from {_ACT}) where action <> 'keep' and used <= 40""",
    "archive_purge": f"""with a as (select id, project, session_day, length(trim(regexp_replace(coalesce(summary, ''), '(?s)<!--.*?-->', '', 'g'))) = 0 as bare, {_AGE} as age from {_S} where archived), r as (select * from a where not (bare and coalesce(age, 0) >= {PURGE_DAYS}))
      select id, project, 'age' as why from a where bare and age >= {PURGE_DAYS} union all select id, project, 'cap' from (select *, row_number() over (partition by project order by session_day, id) as k from r where bare)
      join (select project, count(*) - 2 as over from r group by project) using (project) where k <= over""",
    "session_list": f"select id, project, session_day, messages_user from {_S} where not archived order by session_day desc, id desc limit 50",
    "sessions_index": f"select project, session_day, count(*) filter (not archived)::bigint as active, count(*) filter (archived)::bigint as in_archive, coalesce(string_agg(id, ' ' order by id) filter (not archived), '') as ids from {_S} group by all",
    "event_stats": f"""select session_id, count(*)::bigint as rows, count(*) filter (event_type = 'user')::bigint as user_rows, count(*) filter (event_type = 'assistant')::bigint as assistant_rows, count(distinct transcript_path)::bigint as files,
      first(entrypoint order by transcript_path, line_no) filter (entrypoint is not null) as entrypoint, sum(len(regexp_extract_all(coalesce(content, ''), '"type": "tool_use"')))::bigint as tool_calls from {_EV} group by session_id""",
    "tool_usage": f"""select session_id, tool, uses, place from (select *, row_number() over (partition by session_id order by uses desc, tool)::bigint as place from (select session_id, tool, count(*)::bigint as uses
      from (select session_id, unnest(regexp_extract_all(content, '"type": "tool_use", "name": "([^"]+)"', 1)) as tool from {_EV}) group by all)) where place <= 3""",
    "transcript_status": f"""select case when id is null then 'no_journal' when t.session_id is null then 'journal_only' when archived then 'archived' else 'available' end as status, count(*)::bigint as sessions
      from {_S} s full join (select distinct session_id from transcript) t on s.cc_session_id = t.session_id group by all""",
    "timeline": f"""select * from (select session_day as day, 'session' as type, id as ref, project from {_S} union all select done, 'task:done', id, project from {_T} where done is not null union all select added, 'task:added', id, project from {_T} where added is not null)
      where day between date '{TODAY}' - 30 and date '{TODAY}' order by day desc, type, ref limit 100""",
    "timeline_counts": f"""select split_part(type, ':', 1) as kind, date_trunc('month', day)::date as month, count(*)::bigint as events from (select session_day as day, 'session' as type from {_S} union all select done, 'task:done' from {_T} union all select added, 'task:added' from {_T})
      where day is not null group by all""",
    "triage_days": f"""with g as (select project, session_day, count(*)::bigint as sessions, {_WORDS} as w from {_S} where session_day is not null group by all),
      l as (select *, lag(w) over p as old, session_day - lag(session_day) over p as gap from g window p as (partition by project order by session_day))
      select project, session_day, sessions, len(w)::bigint as words, case when gap = 1 and len(list_distinct(list_concat(w, old))) > 0 then round(len(list_intersect(w, old))::double / len(list_distinct(list_concat(w, old))), 6) end as with_day_before from l""",
    "triage_clusters": f"""with recursive g as materialized (select *, row_number() over (partition by project order by d) as r from (select project, session_day as d, count(*)::bigint as n, {_WORDS} as w from {_S} where session_day is not null group by all)),
      f(project, r, first, last, n, w) as (select project, r, d, d, n, w from g where r = 1 union all select project, r, case when m then first else d end, d, case when m then fn + n else n end, case when m then list_distinct(list_concat(fw, w)) else w end
        from (select g.*, f.first, f.n as fn, f.w as fw, coalesce(g.d - f.last = 1 and len(list_distinct(list_concat(f.w, g.w))) > 0 and len(list_intersect(f.w, g.w))::double / len(list_distinct(list_concat(f.w, g.w))) > 0.3, false) as m from f join g on g.project = f.project and g.r = f.r + 1))
      select project, first as first_day, max(last) as last_day, max(n)::bigint as sessions, max(len(w))::bigint as words from f group by project, first""",
    "journal_merge": f"""select coalesce(s.cc_session_id, e.session_id) as cc_session_id, id, coalesce(u, messages_user::bigint) as messages_user, coalesce(a, messages_assistant::bigint) as messages_assistant, case when id is null then 'insert' when u is null then 'keep' else 'update' end as action
      from (select distinct on (cc_session_id) * from {_S} order by cc_session_id, id) s full join (select session_id, count(*) filter (event_type = 'user')::bigint as u, count(*) filter (event_type = 'assistant')::bigint as a from {_EV} group by session_id) e on s.cc_session_id = e.session_id""",
}
