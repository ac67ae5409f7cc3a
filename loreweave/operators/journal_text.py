"""Journals, skills and profiles as text: written from rows, and read back into rows.

A null field is not written and is null (a number 0) when read; a text without the expected header or section gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import EDGE, body, duration_seconds, duration_text, front_matter, header_field, slugify, without_comments
from ..session import first_by, table
from .audit import pages
from .journal import sessions
from .merges import compose_header

PLACEHOLDER = "<!-- empty until asked for -->"
# Sections of a journal.
SUMMARY, PROMPTS = "Summary", "User prompts"


def bare(text: Column) -> Column:
    """A text without white space around it, null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def section(text: Column, name: str) -> Column:
    """The text of a level-two section up to the next one, null where there is none."""
    return bare(F.regexp_extract(text, rf"(?s)(?:\A|\n)## {name}[ \t]*\n(.*?)(?=\n## |\z)", 1))


def replace_section(text: Column, name: str, new: Column) -> Column:
    """The text with a section's content replaced; one that isn't there is put at the end."""
    rx = rf"(?s)((?:\A|\n)## {name}[ \t]*\n)(.*?)(?=\n## |\z)"
    quoted = F.regexp_replace(new, r"([\\$])", r"\\$1")
    return F.when(text.rlike(rx), F.regexp_replace(text, F.lit(rx), F.concat(F.lit("$1\n"), quoted, F.lit("\n")))).otherwise(F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit(f"\n\n## {name}\n\n"), new, F.lit("\n")))


def journal_text(rows: DataFrame) -> DataFrame:
    """``id`` and ``text`` of each journal: header, summary or a placeholder, figures, prompts each on a line."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    head = compose_header({
        "title": F.concat(F.lit("Session "), "id"), "type": F.lit("session"), "created": F.col("session_day"), "id": F.col("id"), "cc_session_id": F.col("cc_session_id"), "started": stamp("started"), "ended": stamp("ended"),
        "duration": duration_text(F.col("duration_s")), "agent": F.col("agent"), "harness": F.col("harness"), "end_reason": F.nullif(F.col("end_reason"), F.lit("")), "messages_user": F.col("messages_user"),
        "tools_used": F.when(F.size("tools") > 0, F.concat(F.lit("["), F.array_join("tools", ", "), F.lit("]"))),
    })
    said = F.transform(F.coalesce("prompts", F.array().cast("array<string>")), lambda p: F.concat(F.lit("- "), F.substring(F.trim(F.regexp_replace(p, r"[\r\n]+", " ")), 1, 280)))
    parts = [head, F.lit(f"\n## {SUMMARY}\n\n"), F.coalesce("summary", F.lit(PLACEHOLDER)), F.lit("\n\n## Stats\n\n- messages: "), F.coalesce("messages_user", F.lit(0)).cast("string"), F.lit(f"\n\n## {PROMPTS}\n\n"), F.array_join(said, "\n"), F.lit("\n")]
    return rows.select("id", F.concat(*parts).alias("text"))


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two times as text, never under 0, and 0 where either can't be read."""
    at = lambda c: F.unix_micros(F.try_to_timestamp(c)) / 1_000_000
    return F.greatest(F.coalesce(F.floor(at(end) - at(start)), F.lit(0)), F.lit(0)).cast("bigint")


def read_journal(texts: DataFrame) -> DataFrame:
    """Journal texts as rows: the header's fields, the summary (without comments, else the first 200 characters of the body), tools and prompts."""
    t, head = F.col("text"), front_matter(F.col("text"))
    field = lambda n: header_field(head, n)
    tools = F.filter(F.transform(F.split(F.regexp_replace(field("tools_used"), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.filter(F.split(section(t, PROMPTS), r"\r?\n"), lambda x: x.startswith("- "))
    summary = bare(without_comments(section(t, SUMMARY)))
    return texts.select(
        "id", field("cc_session_id").alias("cc_session_id"), field("created").try_cast("date").alias("day"), F.coalesce(field("messages_user").try_cast("bigint"), F.lit(0)).alias("messages_user"),
        duration_seconds(F.coalesce(field("duration"), F.lit(""))).cast("bigint").alias("duration_s"), elapsed(field("started"), field("ended")).alias("elapsed_s"), F.coalesce(tools, F.array().cast("array<string>")).alias("tools"),
        F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(F.substring(x, 3, 1_000_000_000))).alias("prompts"), F.substring(F.coalesce(summary, F.trim(F.regexp_replace(body(t), r"\s+", " "))), F.lit(1), F.when(summary.isNull(), 200).otherwise(300)).alias("preview"),
        summary.isNull().alias("pending"),
    )


def journal_texts(spark: SparkSession, d: str) -> DataFrame:
    return journal_text(sessions(spark, d)).select("id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


def journal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Journals written as text and read again: what their statistics say."""
    r = read_journal(journal_text(sessions(spark, d)))
    return r.select("id", "cc_session_id", "day", "messages_user", "duration_s", "elapsed_s", F.array_join("tools", ",").alias("tools"), F.size("prompts").cast("bigint").alias("prompts"), "preview", "pending")


def archive_stubs(spark: SparkSession, d: str) -> DataFrame:
    """What is left of archived journals: their header with a flag, the summary, and where the transcript is."""
    t = table(spark, d, "transcript").groupBy(F.col("session_id").alias("cc_session_id")).agg(F.max("transcript_path").alias("transcript"))
    texts = journal_text(sessions(spark, d)).join(sessions(spark, d).where("archived").select("id", "cc_session_id"), "id").join(t, "cc_session_id", "left")
    head = F.regexp_replace(front_matter(F.col("text")), r"\z", "\narchived: true")
    stub = F.concat(F.lit("---\n"), head, F.lit("\n---\n\n## Summary\n\n"), section(F.col("text"), SUMMARY), F.lit("\n\n## Transcript\n\n"), F.coalesce("transcript", F.lit("missing")), F.lit("\n"))
    return texts.select("id", F.md5(stub).alias("stub_md5"), F.col("transcript").isNotNull().alias("at_hand"))


def summaries_written(spark: SparkSession, d: str) -> DataFrame:
    """Journals without a summary after one is put in its place (the first prompt), read again; a second time changes nothing."""
    t = journal_text(sessions(spark, d)).join(sessions(spark, d).where("summary is null").select("id", F.coalesce(F.try_element_at("prompts", F.lit(1)), F.lit("nothing")).alias("new")), "id")
    done = t.withColumn("text", replace_section(F.col("text"), SUMMARY, F.col("new"))).withColumn("again", replace_section(F.col("text"), SUMMARY, F.col("new")))
    return done.select("id", section(F.col("text"), SUMMARY).alias("summary"), (F.col("again") == F.col("text")).alias("stable"))


def journal_days(spark: SparkSession, d: str) -> DataFrame:
    """The folder each journal belongs to: the day it ended, not the one it was started or received on."""
    s = sessions(spark, d)
    day = F.coalesce(F.to_date("ended"), F.to_date("started"), "session_day")
    return s.select("id", day.alias("folder_day"), (day > F.coalesce(F.to_date("started"), day)).alias("over_midnight"))


def scalar_kind(text: Column) -> Column:
    """What a bare header value is: null, a truth value, a whole number, a number, or text."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.isNull() | low.isin("", "null", "none", "~"), "null").when(low.isin("true", "yes", "on", "false", "no", "off"), "bool").when(low.rlike(r"^[+-]?\d{1,18}$"), "int")
        .when(low.rlike(r"^[+-]?(\d+\.\d*|\.\d+)(e[+-]?\d+)?$"), "float").otherwise("text")
    )


def header_values(rows: DataFrame) -> DataFrame:
    """Header fields of texts (``id``, ``text``) by name with kind and value: scalars without quotes, inline and block lists joined, inline JSON as it is."""
    head = F.regexp_replace(front_matter(F.col("text")), r"\r", "")
    # a block list is one field: its items are put behind their name
    folded = F.regexp_replace(head, r"\n[ \t]*- ", "\u0001")
    lines = rows.select("id", F.explode(F.split(folded, "\n")).alias("line")).where(F.col("line").rlike(r"^[A-Za-z_][\w-]*:"))
    raw = F.trim(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1))
    items = lambda s, rx: F.array_join(F.filter(F.transform(F.split(s, rx), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != ""), "|")
    kind = F.when(raw.contains("\u0001"), "list").when(raw.rlike(r"^\["), "list").when(raw.rlike(r"^\{"), F.when(F.try_parse_json(raw).isNotNull(), "json").otherwise("text")).when(raw.rlike("^[\"'].*[\"']$"), "text").otherwise(scalar_kind(raw))
    value = F.when(raw.contains("\u0001"), items(raw, "\u0001")).when(raw.rlike(r"^\["), items(F.regexp_replace(raw, r"^\[|\]$", ""), ",")).when(raw.rlike(r"^\{"), raw).otherwise(F.regexp_replace(raw, "^[\"']|[\"']$", ""))
    return lines.select("id", F.regexp_extract("line", r"^([^:]*):", 1).alias("field"), kind.alias("kind"), value.alias("value"))


def typed_headers(spark: SparkSession, d: str) -> DataFrame:
    """Typed fields of the wiki pages' headers and of the journals' texts."""
    p = pages(spark, d).select(F.concat(F.lit("page:"), F.col("id").cast("string")).alias("id"), F.col("content").alias("text"))
    return header_values(p.unionByName(journal_text(sessions(spark, d)).select(F.concat(F.lit("journal:"), "id").alias("id"), "text")))


def skill_texts(rows: DataFrame) -> DataFrame:
    """Texts of the source skill (``doc_id``, ``text``, ``path``, ``project``) as catalogue rows: name by the path, the first heading, the first plain line as description."""
    lines = F.split("text", r"\r?\n")
    heading = F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+([^\r\n]*?)[ \t]*$", 1)
    plain = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^[^\s#>*\-`~\d|]")), F.lit(1))
    return rows.select("doc_id", "project", slugify(F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1), 60, "skill").alias("name"), heading.alias("title"), F.substring(plain, 1, 120).alias("description"))


def skill_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Skills by name, the one of the newest text; how many texts hold the name."""
    docs = table(spark, d, "documents").where("lower(trim(source)) = 'skill' and text is not null")
    rows = skill_texts(docs).join(docs.select("doc_id", "updated"), "doc_id")
    best = first_by(rows.select("name", "project", "title", "description", "doc_id", "updated"), ["name"], -F.coalesce(F.unix_micros(F.col("updated").cast("timestamp")), F.lit(0)), F.col("doc_id"))
    return best.join(rows.groupBy("name").agg(F.count("*").alias("texts")), "name").select("name", "project", "title", "description", "texts")


def invocations(spark: SparkSession, d: str) -> DataFrame:
    """Script calls in message texts by script: how many, in how many sessions."""
    words = F.regexp_extract_all(F.coalesce("message.content", F.lit("")), F.lit(EDGE + r"(?:python3?|bash|sh|node)\s+(?:\S*/)?([\w.-]+\.(?:py|sh|js))"), 1)
    t = table(spark, d, "transcript").select("session_id", "transcript_path", "line_no", F.explode(F.array_distinct(words)).alias("script")).distinct()
    named = F.regexp_extract_all(F.coalesce("message.content", F.lit("")), F.lit(EDGE + r"([a-z]+_[a-z]+\.(?:py|sh|js|ts|go|rs))" + EDGE), 1)
    m = table(spark, d, "transcript").select("session_id", "transcript_path", "line_no", F.explode(F.array_distinct(named)).alias("script")).distinct()
    count = lambda x, how: x.groupBy("script").agg(F.count("*").alias("rows"), F.countDistinct("session_id").alias("sessions")).withColumn("how", F.lit(how))
    return count(t, "called").unionByName(count(m, "named"))


@F.pandas_udf(StringType())
def ascii_slug(texts):  # noqa: ANN001, ANN201
    """Kebab-case slug of the letters without accents and forms; null stays null, a text without any gives ''."""
    import re
    import unicodedata

    plain = lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    return texts.map(lambda s: re.sub(r"[^a-z0-9]+", "-", plain(s)).strip("-"), na_action="ignore")


# Letters with accents that the titles of the tables hold, with their plain forms; SQL has no normal forms.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def accent_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Words of the texts that hold an accent, as slugs, and how many texts have them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"([a-z]*[{ACCENTED}][a-z{ACCENTED}]*)"), 1)
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.countDistinct("doc_id").alias("texts"))
    return w.select("word", ascii_slug("word").alias("slug"), "texts")


def truncate_tokens(text: Column, most: int, mark: str = " [...]") -> Column:
    """A text cut to about ``most`` tokens of 3.5 characters, with a mark where it was cut."""
    size = int(most * 3.5)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size)), F.lit(mark)))


def excerpts(spark: SparkSession, d: str, tokens: int = 120) -> DataFrame:
    """Excerpts of the texts without comments and header, cut to a number of tokens."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", body(without_comments(F.col("text"))).alias("t"))
    return t.select("doc_id", F.md5(truncate_tokens(F.col("t"), tokens)).alias("excerpt_md5"), (F.length("t") > int(tokens * 3.5)).alias("cut"))


QUERIES = {
    "journal_texts": journal_texts, "journal_stats": journal_stats, "archive_stubs": archive_stubs, "summaries_written": summaries_written, "journal_days": journal_days, "typed_headers": typed_headers,
    "skill_catalogue": skill_catalogue, "invocations": invocations, "accent_slugs": accent_slugs, "excerpts": excerpts,
}

from .audit import _PAGES  # noqa: E402
from .journal import _S  # noqa: E402

_DUR = "case when duration_s is null or duration_s < 0 then '0s' when duration_s < 60 then duration_s || 's' when duration_s < 3600 then (duration_s // 60) || 'm ' || (duration_s % 60) || 's' else (duration_s // 3600) || 'h ' || (duration_s % 3600 // 60) || 'm' end"
_FIELDS = rf"""concat_ws(chr(10), 'title: Session ' || id, 'type: session', 'created: ' || session_day, 'agent: ' || agent, 'cc_session_id: ' || cc_session_id, 'duration: ' || {_DUR}, 'end_reason: ' || nullif(end_reason, ''), 'ended: ' || strftime(ended, '%Y-%m-%dT%H:%M:%S'),
  'harness: ' || harness, 'id: ' || id, 'messages_user: ' || messages_user, 'started: ' || strftime(started, '%Y-%m-%dT%H:%M:%S'), case when len(tools) > 0 then 'tools_used: [' || array_to_string(tools, ', ') || ']' end)"""
_SAID = r"list_transform(coalesce(prompts, []), lambda p: '- ' || substr(trim(regexp_replace(p, '[\r\n]+', ' ', 'g')), 1, 280))"
_TEXT = f"(select *, {_FIELDS} as fields, '---' || chr(10) || {_FIELDS} || chr(10) || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || coalesce(summary, '{PLACEHOLDER}') || chr(10) || chr(10) || '## Stats' || chr(10) || chr(10) || '- messages: ' || coalesce(messages_user, 0) || chr(10) || chr(10) || '## User prompts' || chr(10) || chr(10) || array_to_string({_SAID}, chr(10)) || chr(10) as text from {_S})"
_RAW = r"trim(regexp_extract(line, '(?s)^[^:]*:(.*)$', 1))"
_KIND = r"""case when regexp_matches(raw, '^\[') then 'list' when low in ('', 'null', 'none', '~') then 'null' when low in ('true', 'yes', 'on', 'false', 'no', 'off') then 'bool' when regexp_matches(low, '^[+-]?\d{1,18}$') then 'int' when regexp_matches(low, '^[+-]?(\d+\.\d*|\.\d+)(e[+-]?\d+)?$') then 'float' else 'text' end"""
_LIST = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(raw, '^\[|\]$', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> ''), '|')"""

SQL = {
    "journal_texts": f"select id, md5(text) as text_md5, length(text)::bigint as chars from {_TEXT}",
    "journal_stats": rf"""select id, cc_session_id, session_day as day, coalesce(messages_user, 0)::bigint as messages_user, (case when duration_s is null or duration_s < 0 then 0 when duration_s < 3600 then duration_s else duration_s - duration_s % 60 end)::bigint as duration_s,
      greatest(coalesce(floor(epoch(date_trunc('second', ended)) - epoch(date_trunc('second', started))), 0), 0)::bigint as elapsed_s, coalesce(array_to_string(tools, ','), '') as tools, len(coalesce(prompts, []))::bigint as prompts,
      case when summary is null then substr(trim(regexp_replace(regexp_replace(text, '(?s)\A---\n.*?\n---\n*', ''), '\s+', ' ', 'g')), 1, 200) else substr(trim(summary), 1, 300) end as preview, summary is null as pending from {_TEXT}""",
    "archive_stubs": f"""select id, md5('---' || chr(10) || fields || chr(10) || 'archived: true' || chr(10) || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || coalesce(summary, '{PLACEHOLDER}') || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || coalesce(transcript, 'missing') || chr(10)) as stub_md5,
      transcript is not null as at_hand from {_TEXT} left join (select session_id as cc_session_id, max(transcript_path) as transcript from transcript group by 1) using (cc_session_id) where archived""",
    "summaries_written": f"select id, coalesce(prompts[1], 'nothing') as summary, true as stable from {_S} where summary is null",
    "journal_days": f"select id, coalesce(ended::date, started::date, session_day) as folder_day, coalesce(ended::date, started::date, session_day) > coalesce(started::date, ended::date, session_day) as over_midnight from {_S}",
    "typed_headers": rf"""select id, field, {_KIND} as kind, case when regexp_matches(raw, '^\[') then {_LIST} else raw end as value from (select id, regexp_extract(line, '^([^:]*):', 1) as field, {_RAW} as raw, lower({_RAW}) as low from (
      select 'page:' || id as id, unnest(string_split(regexp_replace(regexp_extract(content, '(?s)\A---\r?\n(.*?)\r?\n---', 1), '\r', '', 'g'), chr(10))) as line from {_PAGES} union all select 'journal:' || id, unnest(string_split(fields, chr(10))) from {_TEXT}) where regexp_matches(line, '^[A-Za-z_][\w-]*:'))""",
    "skill_catalogue": r"""with r as (select doc_id, project, updated, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_extract(path, '([^/]*?)(?:\.md)?$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'skill') as name,
        regexp_extract(text, '(?m)^#{1,6}[ \t]+([^\r\n]*?)[ \t]*$', 1) as title, substr(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '^[^\s#>*\-`~\d|]'))[1], 1, 120) as description from documents where lower(trim(source)) = 'skill' and text is not null)
      select distinct on (name) name, project, title, description, (count(*) over (partition by name))::bigint as texts from r order by name, updated desc nulls last, doc_id""",
    "invocations": r"""with m as (select session_id, transcript_path, line_no, coalesce(message.content, '') as c from transcript), x as (select distinct session_id, transcript_path, line_no, 'called' as how, unnest(regexp_extract_all(c, '\b(?:python3?|bash|sh|node)\s+(?:\S*/)?([\w.-]+\.(?:py|sh|js))', 1)) as script from m
      union all select distinct session_id, transcript_path, line_no, 'named', unnest(regexp_extract_all(c, '\b([a-z]+_[a-z]+\.(?:py|sh|js|ts|go|rs))\b', 1)) from m) select script, how, count(*)::bigint as rows, count(distinct session_id)::bigint as sessions from x group by all""",
    "accent_slugs": f"""select word, regexp_replace(translate(word, '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', '-', 'g') as slug, count(distinct doc_id)::bigint as texts from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]*[{ACCENTED}][a-z{ACCENTED}]*')) as word from documents where text is not null) group by word""",
    "excerpts": r"""select doc_id, md5(case when length(t) <= 420 then t else rtrim(substr(t, 1, 420), ' ') || ' [...]' end) as excerpt_md5, length(t) > 420 as cut from (select doc_id, regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?s)\A---\r?\n.*?\r?\n---\r?\n*', '') as t from documents where text is not null)""",
}
