"""Tables of a data directory, and the settings the library expects of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side, in rows and in bytes as text, that a query may broadcast after counting it.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Make sure there is a checkpoint folder: the one the session names; a temporary one only in a local session, as in tests.

    On a cluster without one this raises: a folder of one machine would not be there for the others.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``, as an aggregation: partial results meet before the shuffle, hot keys included."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its rows and their bytes are counted to be few, else as it is (the join then shuffles)."""
    if not df.columns:
        return df
    sizes = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if sizes[0] <= limit and sizes[1] <= most_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores before work that is heavy per row, where the scan gives fewer splits; else as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys) if df.rdd.getNumPartitions() < n else df


def range_blocks(df: DataFrame, order: Sequence[Column | str], n: int | None = None) -> DataFrame:
    """Add ``_block``, the number of a range partition over ``order``: a hot key is cut into as many blocks as its share needs."""
    spark = df.sparkSession
    n = n or max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the cuts are sampled anew each time the frame is computed; written out, all readers see the same ones
    checkpoints(spark)
    return df.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id()).checkpoint()


def running_sum(df: DataFrame, part: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` by ``order`` within ``part``, the row itself included, without one task per ``part``."""
    placed = range_blocks(df, [part, *order])
    w = Window.partitionBy(part, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_upto", F.sum(value).over(w))
    sums = placed.groupBy(part, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, [part, "_block"]).withColumn(out, F.col("_off") + F.col("_upto")).drop("_off", "_upto", "_block")


def nth(df: DataFrame, column: str, index: Column, *, ties: Sequence[str] = ()) -> DataFrame:
    """The value at a 0-based index of the ascending order, as a one-row frame, without sorting everything in one task.

    ``index`` is a column of the row count ``n``. Blocks are counted first; only the block that holds the index is ordered.
    """
    placed = range_blocks(df.select(column, *ties), [column, *ties])
    counts = placed.groupBy("_block").agg(F.count("*").alias("c"))  # a row per block
    w = Window.partitionBy(F.lit(1)).orderBy("_block")
    spans = counts.withColumn("before", F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(1))))
    at = spans.withColumn("at", index).where("before <= at and at < before + c").select("_block", (F.col("at") - F.col("before") + 1).alias("k"))
    inside = placed.join(F.broadcast(at), "_block").withColumn("r", F.row_number().over(Window.partitionBy("_block").orderBy(column, *ties)))
    return inside.where("r = k").select(column)
