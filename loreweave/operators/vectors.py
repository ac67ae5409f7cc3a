"""Exact vector search: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoints, nth, table

#: Rows of a block of queries and of a block of data: at most 4 and 25 MB of 64-dimensional floats, matched by one task.
QUERY_ROWS, DATA_ROWS = 8_192, 50_000
QUERY_EVERY = 100


def valid_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has the dimension, only finite values and a length above zero."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > F.lit(3.4028235e38)))
    return df.where(x.isNotNull() & (F.size(x) == dim) & ~bad & F.exists(x, lambda v: v != 0))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def knn(data: DataFrame, queries: DataFrame, key: str, vec: str, k: int, least: float = -2.0, own: str | None = None, digits: int | None = None) -> DataFrame:
    """The ``k`` nearest rows by cosine of every query, itself left out: ``query_id``, ``neighbour``, ``score``, ``rank``; ties by key.

    Blocks of queries meet blocks of data as groups of one join, so nothing passes through the driver and no task holds more than a block of
    each; what is shuffled on is k rows a query and block. ``own`` names the queries' key where they come from another table
    (then no row is left out). ``digits`` rounds scores before they are ranked, for vectors of whole numbers, whose scores tie often. Null keys are left out.
    """
    name = own or key
    d, q = data.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(vec).alias("_v")), queries.where(F.col(name).isNotNull()).select(F.col(name).alias("_k"), F.col(vec).alias("_v"))
    nq = max(1, -(-q.count() // QUERY_ROWS))
    nd = max(1, -(-d.count() // DATA_ROWS))
    block = lambda n, seed: F.pmod(F.xxhash64("_k", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = d.select("*", block(nd, 1).alias("_d"), every(nq).alias("_q")), q.select("*", block(nq, 2).alias("_q"), every(nd).alias("_d"))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(rows) and len(asked):
            rows = rows.sort_values("_k", ignore_index=True)
            ids, keys, x, y = asked["_k"].to_numpy(), rows["_k"].to_numpy(), _unit(rows["_v"]), _unit(asked["_v"])
            for at in range(0, len(ids), 1024):
                s = y[at : at + 1024] @ x.T
                if digits is not None:
                    s = np.round(s, digits)
                if own is None:
                    s[ids[at : at + 1024, None] == keys[None, :]] = -3.0
                m = min(k, s.shape[1])
                floor = np.maximum(np.partition(s, s.shape[1] - m, axis=1)[:, -m], max(least, -2.0))
                r, c = np.nonzero(s >= floor[:, None])  # all equal to the last one too: the smaller keys win below
                found.append(pd.DataFrame({"query_id": ids[at + r], "neighbour": keys[c], "score": s[r, c]}))
        if not found:
            return pd.DataFrame({"query_id": asked["_k"][:0], "neighbour": rows["_k"][:0], "score": pd.Series(dtype=float)})
        best = pd.concat(found).sort_values(["query_id", "score", "neighbour"], ascending=[True, False, True])
        return best.groupby("query_id", sort=False).head(k)

    schema = f"query_id {q.schema['_k'].dataType.simpleString()}, neighbour {d.schema['_k'].dataType.simpleString()}, score double"
    near = left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour"))
    return near.withColumn("rank", rank).where(f"rank <= {k}")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return valid_vectors(table(spark, d, "embeddings"), "embedding", 64)


def _neighbours(spark: SparkSession, d: str, k: int, least: float = -2.0, where: str = "true") -> DataFrame:
    v = _vectors(spark, d)
    return knn(v.where(where), v.where(f"vec_id % {QUERY_EVERY} = 0"), "vec_id", "embedding", k, least)


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, 5).select("query_id", "neighbour", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rows of three labels only: the filter comes before the top k, so k rows come out where there are k."""
    return _neighbours(spark, d, 5, where="label in (1, 2, 3)").select("query_id", "neighbour", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def semantic_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours above a score, with the class of the edge."""
    edge = F.when(F.col("score") >= 0.4, "strong").when(F.col("score") >= 0.33, "medium").otherwise("weak")
    return _neighbours(spark, d, 8, 0.25).select("query_id", "neighbour", F.round("score", 6).alias("score"), edge.alias("edge"))


def surprise_edges(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs without an explicit tie in either direction; rows of one label are tied."""
    near = _neighbours(spark, d, 5, 0.2).select(F.least("query_id", "neighbour").alias("a"), F.greatest("query_id", "neighbour").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    ends = near.join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    return ends.where("la <> lb").select("a", "b", F.round("score", 6).alias("score"))


def isolated_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a neighbour at or above the score."""
    q = _vectors(spark, d).where(f"vec_id % {QUERY_EVERY} = 0").select(F.col("vec_id").alias("query_id"))
    return q.join(_neighbours(spark, d, 1, 0.4), "query_id", "left_anti").select("query_id")


def label_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labels by their nearest rows: the best score and how many edges join them."""
    n = _neighbours(spark, d, 4)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    both = n.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("x")), "query_id").join(labels.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("y")), "neighbour")
    return both.where("x <> y").groupBy(F.least("x", "y").alias("label_a"), F.greatest("x", "y").alias("label_b")).agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("edges"))


def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The score at index floor(0.85 n) of all neighbour scores in ascending order, and the edges at or above it."""
    checkpoints(spark)
    n = _neighbours(spark, d, 4).select("query_id", "neighbour", "score").checkpoint()
    t = nth(n, "score", F.least(F.floor(F.col("n") * 0.85), F.col("n") - 1), ties=["query_id", "neighbour"]).withColumnRenamed("score", "threshold")
    return n.join(F.broadcast(t), F.col("score") >= F.col("threshold")).groupBy(F.round("threshold", 6).alias("threshold")).agg(F.count("*").alias("edges"), F.countDistinct("query_id").alias("queries"))


QUERIES = {
    "knn_topk": knn_topk, "knn_filtered": knn_filtered, "semantic_neighbours": semantic_neighbours, "surprise_edges": surprise_edges, "isolated_vectors": isolated_vectors, "label_graph": label_graph,
    "adaptive_threshold": adaptive_threshold,
}


def _knn_sql(k: int, least: float | None = None, where: str = "true") -> str:
    floor = f"where score >= {least}" if least is not None else ""
    return f"""(select * from (select *, row_number() over (partition by query_id order by score desc, neighbour)::bigint as rank from (select q.vec_id as query_id, e.vec_id as neighbour, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as score
      from embeddings q join embeddings e on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id and e.{where if where != 'true' else 'vec_id is not null'}) {floor}) where rank <= {k})"""


SQL = {
    "knn_topk": f"select query_id, neighbour, round(score, 6) as score, rank from {_knn_sql(5)}",
    "knn_filtered": f"select query_id, neighbour, round(score, 6) as score, rank from {_knn_sql(5, where='label in (1, 2, 3)')}",
    "semantic_neighbours": f"select query_id, neighbour, round(score, 6) as score, case when score >= 0.4 then 'strong' when score >= 0.33 then 'medium' else 'weak' end as edge from {_knn_sql(8, 0.25)}",
    "surprise_edges": f"""select a, b, round(score, 6) as score from (select least(query_id, neighbour) as a, greatest(query_id, neighbour) as b, max(score) as score from {_knn_sql(5, 0.2)} group by all) n
      join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b where x.label <> y.label""",
    "isolated_vectors": f"select vec_id as query_id from embeddings where vec_id % 100 = 0 and vec_id not in (select query_id from {_knn_sql(1, 0.4)})",
    "label_graph": f"""select least(x.label, y.label) as label_a, greatest(x.label, y.label) as label_b, round(max(score), 6) as score, count(*)::bigint as edges from {_knn_sql(4)} n join embeddings x on x.vec_id = query_id join embeddings y on y.vec_id = neighbour
      where x.label <> y.label group by all""",
    "adaptive_threshold": f"""with n as (select *, row_number() over (order by score, query_id, neighbour) as r, count(*) over () as c from {_knn_sql(4)}), t as (select score as threshold from n where r = least(floor(c * 0.85), c - 1) + 1)
      select round(threshold, 6) as threshold, count(*)::bigint as edges, count(distinct query_id)::bigint as queries from n, t where score >= threshold group by all""",
}
