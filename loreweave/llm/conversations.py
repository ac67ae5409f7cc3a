"""Problem 4: conversations from message rows.

The rows are an event log: rows of the same session, file and line are versions of one event.
The first creates it, a later one edits it or, sent again unchanged, is a retry, and one without
words (null, blank, "(no content)") deletes its turn; the version received last stands. System
rows, tool traffic and command markup leave no turn. What is left is ordered by instant and
line, and whole sessions are validated.

Each row is read where it lies: only what its words come to (speaker, instant, turn or none,
damage) is folded and ordered, and the texts of kept turns join at the end. A hot session is
never one task: its turns are cut into range blocks along the order of the conversation, each
block is summed up, and only the few sums of a session meet.

Null session ids are left out. Null or unreadable times take the instant of the line before
in the same file, where there is one; null roles follow the event type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoints, fixed_blocks

# Spellings of the two speakers.
USER_ROLES = ("user", "human", "customer", "utente")
ASSISTANT_ROLES = ("assistant", "ai", "model", "bot", "assistente")
BLOCKS = "array<struct<type:string,text:string>>"
EMPTY = r"^[\s\p{Z}]*\(no[\s_-]*content\)[\s\p{Z}]*$"


def instant(column: Column) -> Column:
    """Microseconds of a time as clients write it: ISO with zone or offset, with T or a space, or epoch seconds to microseconds."""
    s = F.trim(column)
    digits = s.try_cast("decimal(38,0)")
    n = F.length(s)
    epoch = (digits * F.when(n <= 11, 1_000_000).when(n <= 14, 1_000).when(n <= 17, 1).otherwise(None)).cast("bigint")
    return F.when(s.rlike(r"^\d{9,17}$"), epoch).otherwise(F.unix_micros(F.try_to_timestamp(F.regexp_replace(s, r"^(\d{4}-\d\d-\d\d) ", "$1T"))))


def read_rows(transcript: DataFrame) -> DataFrame:
    """Every row with the words of its speaker (``text``), whether they are a turn, and whether its array of blocks is damaged."""
    rows = transcript.where("session_id is not null").select(
        "row_id", "session_id", "transcript_path", "line_no", "event_type", "event_time", F.col("message.role").alias("role"), F.col("message.content").alias("content"), "received_at"
    )
    content = F.col("content")
    is_array = content.rlike(r"^\s*\[\s*(\{|\]|$)")
    valid = F.try_parse_json(content).isNotNull()
    said = F.from_json(content, BLOCKS)
    texts = F.filter(said, lambda b: (F.coalesce(b["type"], F.lit("text")) == "text") & F.coalesce(F.trim(F.regexp_replace(b["text"], r"[\s\p{Z}]+", " ")) != "", F.lit(False)))
    words = F.when(is_array, F.array_join(F.transform(texts, lambda b: b["text"]), "\n")).otherwise(content)
    bare = F.regexp_replace(words, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    role = F.lower(F.trim("role"))
    speaker = F.coalesce(
        F.when(role.isin(*USER_ROLES), "user").when(role.isin(*ASSISTANT_ROLES), "assistant").when(role == "system", "system"),
        F.when(F.lower(F.trim("event_type")).isin("user", "assistant"), F.lower(F.trim("event_type"))),
    )
    return (
        rows.withColumn("damaged", F.coalesce(is_array & ~valid, F.lit(False)))
        .withColumn("text", bare)
        .withColumn("speaker", F.when(F.coalesce(F.lower(F.trim("event_type")) == "system", F.lit(False)) & F.col("role").isNull(), "system").otherwise(speaker))
        .withColumn("at", instant(F.col("event_time")))
        .withColumn(
            "is_turn",
            ~F.col("damaged") & F.col("speaker").isin("user", "assistant") & (F.col("text") != "") & ~F.lower("text").rlike(EMPTY) & ~F.col("text").rlike(r"^<(command|local-command)-"),
        )
        .withColumn("is_turn", F.coalesce("is_turn", F.lit(False)))
    )


LINE = ["session_id", "transcript_path", "line_no"]


def events(transcript: DataFrame) -> DataFrame:
    """One row per session, file and line, without its text: the version received last, written once for all readers."""
    order = F.struct(F.coalesce("received_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.col("row_id").alias("i"))
    rest = ["row_id", "speaker", "at", "is_turn", "damaged"]
    folded = read_rows(transcript).groupBy(*LINE).agg(F.max_by(F.struct(*rest), order).alias("e"))
    checkpoints(transcript.sparkSession)
    return folded.select(*LINE, *[F.col("e")[c].alias(c) for c in rest]).checkpoint()


def _placed(rows: DataFrame) -> DataFrame:
    """Turns in range blocks along (session, instant, line), each with its place and the speaker after it in its block."""
    placed = fixed_blocks(rows.where("is_turn").select(*LINE, "row_id", "speaker", "at"), ["session_id", "at", "line_no", "transcript_path"])
    inside = Window.partitionBy("session_id", "_block").orderBy("at", "line_no", "transcript_path")
    return placed.withColumn("pos", F.row_number().over(inside)).withColumn("next", F.lead("speaker").over(inside))


def fill_instants(rows: DataFrame) -> DataFrame:
    """Give turns without a readable time the instant of the nearest earlier line of their file, else of the nearest later one, else 0.

    Only files with such a turn are looked at; range blocks along the lines give the neighbours inside a block,
    and one row per file and block those beyond it.
    """
    file = ["session_id", "transcript_path"]
    lines = rows.select(*file, "line_no", "at", "is_turn")
    short = lines.where("at is null and is_turn").select(*file).distinct()
    placed = fixed_blocks(lines.join(short, file, "left_semi"), [*file, "line_no"])
    w = Window.partitionBy("_block", *file).orderBy("line_no")
    near = placed.withColumn("before", F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "after", F.first("at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    )
    known = F.when(F.col("at").isNotNull(), F.col("line_no"))
    ends = placed.groupBy(*file, "_block").agg(F.max_by("at", known).alias("end"), F.min_by("at", known).alias("start"))
    by_block = Window.partitionBy(*file).orderBy("_block")
    carried = ends.select(
        *file, "_block",
        F.last("end", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("start", ignorenulls=True).over(by_block.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    filled = near.where("at is null and is_turn").join(carried, [*file, "_block"]).select(*file, "line_no", F.coalesce("before", "earlier", "after", "later", F.lit(0)).alias("filled"))
    return rows.join(filled, [*file, "line_no"], "left").withColumn("at", F.coalesce("at", "filled")).drop("filled")


def _states(rows: DataFrame, placed: DataFrame) -> DataFrame:
    whole = rows.groupBy("session_id", "transcript_path").agg(
        F.max("line_no").alias("last"), F.count("line_no").alias("lines"), F.min("line_no").alias("first"), F.bool_or("damaged").alias("damaged")
    )
    files = whole.groupBy("session_id").agg(
        F.bool_or("damaged").alias("damaged"), F.bool_or(F.expr("last is null or lines < last or first < 1")).alias("gap")
    )
    sums = placed.groupBy("session_id", "_block").agg(
        F.count("*").alias("n"),
        F.min_by("speaker", "pos").alias("first"),
        F.max_by("speaker", "pos").alias("last"),
        F.bool_or(F.expr("speaker = 'user' and next = 'user'")).alias("unanswered"),
    )
    order = Window.partitionBy("session_id").orderBy("_block")
    joined = sums.withColumn("following", F.lead("first").over(order)).withColumn("k", F.row_number().over(order))
    talk = joined.groupBy("session_id").agg(
        F.sum("n").alias("turns"),
        F.min_by("first", "k").alias("opens"),
        F.bool_or(F.coalesce("unanswered", F.lit(False)) | ((F.col("last") == "user") & (F.coalesce("following", F.lit("user")) == "user"))).alias("unanswered"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("turns").isNull(), "no_message"),
            F.when(F.col("opens") == "assistant", "not_opened_by_user"),
            F.when(F.col("unanswered"), "unanswered"),
            F.when(F.col("gap"), "lost_line"),
            F.when(F.col("damaged"), "damaged_json"),
        )
    )
    return files.join(talk, "session_id", "left").select("session_id", F.coalesce("turns", F.lit(0)).alias("turns"), reasons.alias("reasons"))


def session_states(transcript: DataFrame) -> DataFrame:
    """Every session with its number of turns and the reasons to drop it (an empty array: keep it)."""
    rows = events(transcript)
    return _states(rows, _placed(fill_instants(rows)))


def dropped_sessions(transcript: DataFrame) -> DataFrame:
    return session_states(transcript).where(F.size("reasons") > 0)


def conversations(transcript: DataFrame) -> DataFrame:
    """The turns of the sessions that are kept: ``session_id``, ``turn_no`` from 1, ``role``, ``content``, ``at`` (epoch microseconds).

    One row per turn, not one array per session, so that a session of any size can be written.
    """
    rows = events(transcript)
    placed = _placed(fill_instants(rows))
    sums = placed.groupBy("session_id", "_block").agg(F.max("pos").alias("n"))
    before = Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("session_id", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    kept = _states(rows, placed).where(F.size("reasons") == 0).select("session_id")
    turns = placed.join(offsets, ["session_id", "_block"]).join(kept, "session_id", "left_semi").withColumn("turn_no", F.col("off") + F.col("pos"))
    # a row id is one row's, but repeated copies of that row may be there: they hold the same words
    words = read_rows(transcript).where("is_turn").select(*[F.col(c).alias(f"_{c}") for c in ("row_id", *LINE)], "text")
    same = F.lit(True)
    for c in ("row_id", *LINE):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    said = turns.join(words, same).select("session_id", "turn_no", F.col("speaker").alias("role"), F.col("text").alias("content"), "at")
    return said.dropDuplicates(["session_id", "turn_no"])
