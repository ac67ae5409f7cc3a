"""Queries of the training-data operators, by the names of their problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoints, table
from .conversations import conversations, dropped_sessions, session_states
from .credentials import find_credentials, redact_credentials
from .handwritten import evidence_report, not_handwritten
from .mixing import mix, mix_check
from .overlap import exact_overlaps, overlap_report, overlapping_records
from .packing import pack_check, pack_documents, pack_report
from .sentences import split_sentences
from .split import find_units, reassembled, split_oversized

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoints(spark)
        return build(table(spark, sf_dir, name))

    return run


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def _mix(part: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoints(spark)
        return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[part]

    return run


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over("chunks", lambda c: find_units(c).select("id", "line_no")),
        "p1_pieces": _over("chunks", split_oversized),
        "p1_reassembled": _over("chunks", lambda c: reassembled(split_oversized(c)).select("id", F.md5("content").alias("content_md5"), "within")),
        "p2_found": _over("dataset", lambda d: overlapping_records(d).select("id_a", "id_b")),
        "p2_report": _over("dataset", overlap_report),
        "p2_exact": _over("dataset", exact_overlaps),
        "p3_found": _over("chunks", lambda c: not_handwritten(c).select("project", "file_path")),
        "p3_reasons": _over("chunks", lambda c: evidence_report(not_handwritten(c))),
        "p4_found": _over("transcript", lambda t: dropped_sessions(t).select("session_id")),
        "p4_states": _over("transcript", session_states),
        "p4_conversations": _over("transcript", conversations),
        "p5_found": _over("chunks", lambda c: find_credentials(c).select("id", "line_no")),
        "p5_redacted": _over("chunks", lambda c: redact_credentials(c).select("id", "file_path", "content", "n_redacted")),
        "p5_shape": _over("chunks", lambda c: redact_credentials(c).select("id", F.length("content").cast("bigint").alias("chars"), F.regexp_count("content", F.lit(r"\n")).cast("bigint").alias("line_ends"))),
        "p6_packs": _packs,
        "p6_fill": lambda spark, sf_dir: pack_report(_packs(spark, sf_dir)),
        "p6_check": lambda spark, sf_dir: pack_check(_packs(spark, sf_dir)),
        "p7_mix": _mix(0),
        "p7_shares": _mix(1),
        "p7_check": lambda spark, sf_dir: mix_check(_mix(1)(spark, sf_dir)),
        "p8_found": _over("documents", lambda d: split_sentences(d, with_text=False).select("doc_id", "start_pos", "end_pos").dropDuplicates()),
        "p8_sentences": _over("documents", split_sentences),
    }


_TURNS = r"""(with e as (select session_id, transcript_path, line_no, event_type, trim(event_time) as t, message.role as role, message.content as content from transcript where session_id is not null
    qualify row_number() over (partition by session_id, transcript_path, line_no order by received_at desc nulls last, row_id desc) = 1),
  w as (select *, coalesce(regexp_matches(content, '^\s*\[\s*(\{|\]|$)'), false) as is_array, lower(trim(role)) as r, lower(trim(event_type)) as k,
    case when regexp_matches(t, '^\d{9,17}$') then try_cast(t as hugeint) * case when length(t) <= 11 then 1000000 when length(t) <= 14 then 1000 else 1 end else epoch_us(try_cast(t as timestamptz)) end::bigint as own from e),
  x as (select *, is_array and not json_valid(content) as damaged, case when is_array then case when json_valid(content) then
      array_to_string(list_transform(list_filter(json_transform(content, '[{"type":"VARCHAR","text":"VARCHAR"}]'), lambda b: coalesce(b.type, 'text') = 'text' and trim(regexp_replace(b.text, '\s+', ' ', 'g')) <> ''), lambda b: b.text), chr(10)) end else content end as words,
    case when k = 'system' and role is null then 'system' when r in ('user', 'human', 'customer', 'utente') then 'user' when r in ('assistant', 'ai', 'model', 'bot', 'assistente') then 'assistant' when r = 'system' then 'system' when k in ('user', 'assistant') then k end as speaker,
    coalesce(own, last_value(own ignore nulls) over (f rows between unbounded preceding and current row), first_value(own ignore nulls) over (f rows between current row and unbounded following), 0) as "at"
    from w window f as (partition by session_id, transcript_path order by line_no)),
  y as (select *, regexp_replace(words, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as text from x)
  select *, coalesce(not damaged and speaker in ('user', 'assistant') and text <> '' and not regexp_matches(lower(text), '^[\s\p{Z}]*\(no[\s_-]*content\)[\s\p{Z}]*$') and not regexp_matches(text, '^<(command|local-command)-'), false) as is_turn from y)"""
_STATES = f"""(with t as (select * from {_TURNS}), o as (select *, row_number() over s as n, lead(speaker) over s as following from t where is_turn window s as (partition by session_id order by "at", line_no, transcript_path)),
  talk as (select session_id, count(*) as turns, bool_or(n = 1 and speaker = 'assistant') as opened, bool_or(speaker = 'user' and coalesce(following, 'user') = 'user') as unanswered from o group by session_id),
  files as (select session_id, bool_or(damaged) as damaged, bool_or(lost) as lost from (select session_id, transcript_path, bool_or(damaged) as damaged, max(line_no) is null or count(line_no) < max(line_no) or min(line_no) < 1 as lost from t group by all) group by session_id)
  select session_id, coalesce(turns, 0) as turns, coalesce(turns is null or opened or unanswered, true) or lost or damaged as dropped from files left join talk using (session_id))"""


_PATH = r"regexp_replace(regexp_replace(trim(replace(r.path, '\', '/')), '/(\./)*/*', '/', 'g'), '^(\./)+', '')"
_ASKED = f"""(select id, coalesce(project, chr(1)) as project, case when s like 'train%' then 't' when s like 'dev%' or s like 'valid%' or s = 'val' or s like 'eval%' or s like 'test%' then 'h' end as side, q, list_sort(list_distinct(list_filter(list_transform(coalesce(relevant, []), lambda r: {_PATH}), lambda p: p is not null and p <> ''))) as files
  from (select *, lower(regexp_replace(split, '[\s_-]+', '', 'g')) as s, lower(trim(regexp_replace(query, '\s+', ' ', 'g'))) as q from dataset where id is not null qualify row_number() over (partition by id order by added_at desc nulls last) = 1))"""


def oracle_sql() -> dict[str, str]:
    """SQL of the results that plain SQL can state; the others are tested against brute force or exact round trips."""
    return {
        "p1_reassembled": "select id, md5(any_value(content)) as content_md5, true as within from chunks where id is not null and content is not null group by id",
        "p2_exact": f"select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from {_ASKED} a join {_ASKED} b on a.side = 't' and b.side = 'h' and a.project = b.project and a.q = b.q and a.files = b.files where regexp_matches(a.q, '[\\p{{L}}\\p{{N}}]')",
        "p5_shape": "select id, length(content)::bigint as chars, (length(content) - length(replace(content, chr(10), '')))::bigint as line_ends from chunks",
        "p6_check": "select pack_name, count(*)::bigint as texts, sum(length(text))::bigint as chars, 0::bigint as over from (select doc_id, any_value(text) as text from documents where text <> '' and doc_id is not null group by doc_id), (select distinct pack_name from pack_sizes where capacity_tokens > 0) group by pack_name",
        "p7_check": "select source, count(*)::bigint as documents, true as within_caps, true as adds_up from (select doc_id, min(lower(trim(regexp_replace(source, '\\s+', ' ', 'g')))) as source from documents where text <> '' and doc_id is not null and source is not null group by doc_id) where source in (select source from mix_targets) group by source",
        "p4_found": f"select session_id from {_STATES} where dropped",
        "p4_conversations": f"""select session_id, row_number() over (partition by session_id order by "at", line_no, transcript_path)::bigint as turn_no, speaker as role, text as content, "at"
          from {_TURNS} where is_turn and session_id in (select session_id from {_STATES} where not dropped)""",
    }
