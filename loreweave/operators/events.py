"""Event logs: the 60-second rule, sessions by gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import range_blocks, table


def with_previous(df: DataFrame, keys: list[str], at: str, ties: list[str]) -> DataFrame:
    """Add ``_prev``, the time before in the order of the key, without one task per key.

    Range blocks give the neighbour inside a block; the first row of a key in a block takes the last time of
    the key in the blocks before, from one row per key and block.
    """
    placed = range_blocks(df, [*keys, at, *ties])
    w = Window.partitionBy("_block", *keys).orderBy(at, *ties)
    local = placed.withColumn("_prev", F.lag(at).over(w))
    ends = placed.groupBy(*keys, "_block").agg(F.max(at).alias("_end"))
    before = ends.withColumn("_before", F.max("_end").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    return local.join(before, [*keys, "_block"]).withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before", "_block")


def accepted(df: DataFrame, keys: list[str], at: str, ident: str, seconds: int = 60) -> DataFrame:
    """Rows that come at least ``seconds`` after the last accepted row of their key.

    A row that far from the row before it is accepted whatever came earlier, so the order splits into runs
    there and only the rows of one run are folded, as a stream in order. Null keys or times must be left out before.
    """
    rows = with_previous(df.select(*keys, at, ident), keys, at, [ident])
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = F.col("_prev").isNull() | (us(at) - us("_prev") >= seconds * 1_000_000)
    # a run is named by its first row's time: the greatest start at or before the row
    starts = rows.withColumn("_start", fresh)
    marked = range_blocks(starts, [*keys, at, ident])
    w = Window.partitionBy("_block", *keys).orderBy(at, ident).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_run", F.last(F.when(F.col("_start"), F.col(at)), ignorenulls=True).over(w))
    ends = local.groupBy(*keys, "_block").agg(F.max("_run").alias("_last"))
    before = ends.withColumn("_before", F.max("_last").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    runs = local.join(before, [*keys, "_block"]).withColumn("_run", F.coalesce("_run", "_before"))
    order = [*keys, "_run", "_us", ident]
    sorted_runs = runs.select(*keys, us("_run").alias("_run"), us(at).alias("_us"), ident).repartition(*keys, "_run").sortWithinPartitions(*order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, 0  # carried from batch to batch: a run of any length is a stream
        for pdf in batches:
            keep = []
            for *this, now in pdf[[*keys, "_run", "_us"]].itertuples(index=False, name=None):
                fresh = this != run or now - last >= seconds * 1_000_000
                if fresh:
                    run, last = this, now
                keep.append(fresh)
            yield pdf.loc[keep, [*keys, ident]]

    return sorted_runs.mapInPandas(fold, df.select(*keys, ident).schema)


def dedupe_60s(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user and type that a hook would record: none within a minute of the last recorded one."""
    e = table(spark, d, "events").where("ts is not null and user_id is not null and event_type is not null")
    return accepted(e, ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


def sessionize(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user by gaps of half an hour."""
    e = table(spark, d, "events").where("ts is not null")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"), F.max("ts").alias("last"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("last").alias("ended"), "events", "value")


def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events and values by day and type, with subtotals."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    r = e.cube("day", "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"), F.sum("k").alias("k"), F.grouping_id().cast("bigint").alias("level"))
    return r.select("day", F.coalesce("event_type", F.lit("*")).alias("event_type"), "events", "value", "k", "level")


QUERIES = {"dedupe_60s": dedupe_60s, "sessionize": sessionize, "event_rollup": event_rollup}

SQL = {
    "dedupe_60s": """with recursive e as (select event_id, user_id, event_type, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events where ts is not null and user_id is not null and event_type is not null),
      f(user_id, event_type, n, last, ok, event_id) as (select user_id, event_type, n, ts, true, event_id from e where n = 1
        union all select e.user_id, e.event_type, e.n, case when e.ts - f.last >= interval 60 second then e.ts else f.last end, e.ts - f.last >= interval 60 second, e.event_id from f join e on e.user_id = f.user_id and e.event_type = f.event_type and e.n = f.n + 1)
      select event_id, user_id, event_type from f where ok""",
    "sessionize": """select user_id, min(ts) as started, max(ts) as ended, count(*)::bigint as events, round(sum(value), 4) as value from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (
      select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as new from events where ts is not null)) group by user_id, s""",
    "event_rollup": """select day, coalesce(event_type, '*') as event_type, events, value, k, level from (select day, event_type, count(*)::bigint as events, round(sum(value), 4) as value, sum(k)::bigint as k, (grouping(day) * 2 + grouping(event_type))::bigint as level
      from (select ts::date as day, event_type, value, json_extract_string(props, '$.k')::bigint as k from events) group by cube (day, event_type))""",
}
