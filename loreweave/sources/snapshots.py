"""Published snapshots of a table: written beside the old one, then named by a pointer, only if nobody published meanwhile."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Someone else published since the expected generation was read."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Generation and directory of what is published; (0, None) before the first."""
    jvm, p, fs = _fs(spark, f"{root}/_pointers")
    if not fs.exists(p):
        return 0, None
    names = sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())
    if not names:
        return 0, None
    text = spark.read.text(f"{root}/_pointers/{names[-1]}", wholetext=True).first()[0]
    return names[-1], json.loads(text)["directory"]


def read(spark: SparkSession, root: str) -> DataFrame | None:
    _, directory = current(spark, root)
    return spark.read.parquet(f"{root}/{directory}") if directory else None


def publish(df: DataFrame, root: str, expected: int) -> int:
    """Write ``df`` as the next generation; raises ``Conflict`` if ``expected`` is no longer the current one.

    The pointer of a generation is created exclusively, so of two writers one fails and its files are never named.
    """
    spark = df.sparkSession
    generation, _ = current(spark, root)
    if generation != expected:
        raise Conflict(f"expected generation {expected}, found {generation}")
    directory = f"data-{expected + 1}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(f"{root}/{directory}")
    jvm, p, fs = _fs(spark, f"{root}/_pointers/{expected + 1}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise Conflict(f"generation {expected + 1} was published meanwhile") from e
    out.write(bytearray(json.dumps({"directory": directory}).encode()))
    out.close()
    return expected + 1


def merge(old: DataFrame, changes: DataFrame, key: str, delete: str | None = None) -> DataFrame:
    """Keyed merge: rows of ``changes`` replace rows of the same key, ``delete`` names a flag of rows to remove. Columns of ``old`` stay."""
    gone = changes.where(delete).select(key) if delete else None
    kept = old.join(changes.select(key), key, "left_anti")
    fresh = changes.join(gone, key, "left_anti") if gone is not None else changes
    return kept.unionByName(fresh.select(*[c for c in old.columns if c in fresh.columns]), allowMissingColumns=True)
