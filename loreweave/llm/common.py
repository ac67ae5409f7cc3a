"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoints, first_by, range_blocks, table  # noqa: F401
from ..session import running_sum as inclusive_sum


def task_count(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row: three waves over the cluster, never under the shuffle setting."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows evenly before Python work when the scan gives fewer splits than there are cores.

    A scan of many files is left as it is: its splits are already balanced and moving whole
    texts through a shuffle would cost more than it gains.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return first_by(df, keys, *order)


def blocks(df: DataFrame, order: Sequence[Column | str], n: int | None = None) -> DataFrame:
    """Add ``_block``: the number of a range partition over ``order``.

    Ranges are cut by sampled quantiles, so a single hot key is spread over as many blocks
    as its share needs, and block order is the order of the keys. The cuts are sampled anew each time the frame is
    computed: one that is read twice must be fixed first, see ``fixed_blocks``.
    """
    n = n or task_count(df.sparkSession)
    return df.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id())


def fixed_blocks(df: DataFrame, order: Sequence[Column | str], n: int | None = None) -> DataFrame:
    """``blocks`` written to the checkpoint folder, so that all readers see the same cuts."""
    return range_blocks(df, order, n)


def running_sum(df: DataFrame, part: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` by ``order`` within ``part``, without one task per ``part``."""
    return inclusive_sum(df, part, order, value, out).withColumn(out, F.col(out) - F.col(value))
