"""Pages, transcripts and task files of a directory as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body, front_matter, header_field

# Parts of paths that are never indexed.
HIDDEN = r"(^|/)\.[^/]"
BUILD = r"(^|/)(node_modules|target|dist|build|__pycache__|venv)/"
SENSITIVE = r"(^|/)(\.env[^/]*|[^/]*\.(pem|key|p12)|id_[a-z0-9]+)$"


def read_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Every Markdown file below a directory, a row each: relative path, size, time, header fields, body. Files in hidden folders are left out."""
    raw = spark.read.text(directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    full = F.col("_metadata.file_path")
    rel = F.regexp_replace(F.regexp_replace(full, r"^file:/+", "/"), "^" + directory.rstrip("/") + "/", "")
    files = raw.select(rel.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))
    head = front_matter(F.col("raw"))
    return files.where(~F.col("path").rlike(HIDDEN)).select(
        "path", "size", "modified", *[header_field(head, n).alias(n) for n in ("title", "type", "created", "updated", "status", "stale_after")], body(F.col("raw")).alias("body"), F.sha2("raw", 256).alias("sha"), "raw"
    )


def discovery_reason(path: str = "path", size: str = "size", most: int = 500_000):  # noqa: ANN201
    """Why a file is not indexed, the first rule that holds, or null."""
    p = F.col(path)
    return (
        F.when(p.rlike(SENSITIVE), "sensitive").when(p.rlike(HIDDEN), "hidden").when(p.rlike(BUILD), "generated").when(F.col(size) > most, "too_large").when(F.col(size) == 0, "empty")
    )


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Message events of JSON lines; lines that are no JSON objects are left out, content may be text or an array of blocks."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("transcript_path"), F.monotonically_increasing_id().alias("order"))
    v = lines.withColumn("v", F.try_parse_json("value")).where("v is not null")
    get = lambda p: F.try_variant_get("v", p, "string")
    return v.select("transcript_path", "order", get("$.type").alias("event_type"), get("$.timestamp").alias("event_time"), get("$.entrypoint").alias("entrypoint"), get("$.message.role").alias("role"), get("$.message.content").alias("content")).where("event_type is not null")


# Fields of a task line; a bar before anything else belongs to the text it stands in.
TASK_FIELDS = ("id", "est", "owner", "added", "started", "done", "took", "blocker")


def _task_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a Markdown roadmap with their section and place."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^##[ \t]+")).alias("s", "part"))
    section = F.trim(F.regexp_extract("part", r"^([^\r\n]*)", 1))
    lines = raw.where("s > 0").select(F.col("s").cast("bigint").alias("s"), section.alias("section"), F.posexplode(F.split("part", r"\r?\n")).alias("i", "line")).where("i > 0")
    return lines.select("section", (F.col("s") * (1 << 32) + F.col("i")).alias("pos"), "line")


NEXT_FIELD = rf"\s*\|\s*(?:{'|'.join(TASK_FIELDS)})\s*:"
TASK_LINE = rf"^- \[(.)\] (?:(P[0-3]) )?(.*?)((?:{NEXT_FIELD}.*)?)$"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task lines of a Markdown roadmap with their section, sign, priority, title and known fields; ``repeated`` marks ids that several lines hold.

    A bar separates only before a known field; of a field that stands twice the first counts. A line without an id has none (its old name follows from the title).
    """
    rows = _task_file(spark, path).where(F.col("line").rlike(TASK_LINE))
    field = lambda k: F.nullif(F.trim(F.regexp_extract(F.regexp_extract("line", TASK_LINE, 4), rf"\|\s*{k}\s*:(.*?)(?={NEXT_FIELD}|$)", 1)), F.lit(""))
    tasks = rows.select(
        "section", "pos", F.regexp_extract("line", TASK_LINE, 1).alias("sign"), F.nullif(F.regexp_extract("line", TASK_LINE, 2), F.lit("")).alias("priority"), F.trim(F.regexp_extract("line", TASK_LINE, 3)).alias("title"), *[field(k).alias(k) for k in TASK_FIELDS]
    )
    twice = tasks.where("id is not null").groupBy("id").agg((F.count("*") > 1).alias("repeated"))
    return tasks.join(twice, "id", "left").select("section", "pos", "sign", "priority", "title", *TASK_FIELDS, F.coalesce("repeated", F.lit(False)).alias("repeated"))


def read_task_notes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a roadmap's sections that are no tasks and not blank."""
    return _task_file(spark, path).where(~F.col("line").rlike(TASK_LINE) & (F.trim("line") != ""))
