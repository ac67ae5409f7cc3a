"""Problem 7: a mix of sources by target shares of all tokens.

Efraimidis-Spirakis sampling: every document gets the key -ln(u) / weight, u from a hash of
its id and the seed, weight its quality; in the order of these keys each source is a weighted
sample without replacement of any length. A source's budget is filled by complete epochs
first, then by the prefix of that order whose tokens fit.

A source without documents can't reach its share; the shares of the others are scaled to
one. Without ``total_tokens`` the mix is the largest in which every other source reaches its
share within ``max_repeats``; a larger total is filled as nearly as the caps allow, what a
capped source lacks going to the others by their shares. Documents without text, tokens or a
listed source are in no mix; repeated rows (same id) count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sum
from .tokens import token_sizes, tokenizer_path


def plain(source: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(source, r"[\s\p{Z}]+", " ")))


def budgets(sources: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per source: tokens at hand, scaled target, token budget. A table of the few target rows."""
    t = targets.select(plain(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    b = t.join(sources, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("most", F.col("tokens") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)))
    every = Window.partitionBy(F.lit(1))  # the table of targets has a row per source
    b = b.withColumn("scaled", F.when(F.col("most") > 0, F.col("target_share") / F.sum(F.when(F.col("most") > 0, F.col("target_share"))).over(every)).otherwise(0.0))
    if total_tokens is None:
        reach = F.min(F.when(F.col("scaled") > 0, F.col("most") / F.col("scaled"))).over(every)
        return b.withColumn("budget", F.floor(F.least(F.coalesce(reach, F.lit(0.0)) * F.col("scaled") + 1e-6, F.col("most"))).cast("bigint"))
    b = b.withColumn("got", F.lit(0.0))
    for _ in range(t.count()):  # a row per source; each round fills at least one capped source or ends
        lack = F.lit(float(total_tokens)) - F.sum("got").over(every)
        open_share = F.when(F.col("got") < F.col("most"), F.col("scaled")).otherwise(0.0)
        b = b.withColumn("_l", lack).withColumn("_o", open_share).withColumn("_s", F.sum("_o").over(every))
        b = b.withColumn("got", F.when(F.col("_s") > 0, F.least(F.col("most"), F.col("got") + F.col("_l") * F.col("_o") / F.col("_s"))).otherwise(F.col("got"))).drop("_l", "_o", "_s")
    return b.withColumn("budget", F.floor(F.col("got") + 1e-6).cast("bigint")).drop("got")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (``doc_id``, ``source``, ``n_tokens``, ``times``) and the report of its shares."""
    base = docs.select("doc_id", "text", plain(F.col("source")).alias("source")).where("doc_id is not null and source is not null and text is not null")
    wanted = targets.select(plain(F.col("source")).alias("source")).distinct()
    listed = base.join(F.broadcast(wanted), "source", "left_semi")  # the targets are a row per source
    sizes = token_sizes(listed, tokenizer or tokenizer_path()).drop("parts", "curve", "n_chars")
    sized = (
        listed.select("doc_id", "source").join(sizes, "doc_id").groupBy("doc_id")
        .agg(F.min("source").alias("source"), F.first("n_tokens").alias("n_tokens"), F.first("quality").alias("quality"))
        .where("n_tokens > 0").checkpoint()
    )
    plan = budgets(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), targets, total_tokens)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = sized.withColumn("es_key", -F.ln(u) / F.col("quality"))
    ordered = running_sum(keyed, "source", ["es_key", "doc_id"], "n_tokens", "before")
    split = plan.where("tokens > 0").select("source", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"))
    chosen = ordered.join(F.broadcast(split), "source").withColumn("times", F.col("epochs") + F.when(F.col("before") + F.col("n_tokens") <= F.col("rest"), 1).otherwise(0))
    out = chosen.where("times > 0").select("doc_id", "source", "n_tokens", F.col("times").cast("int").alias("times"))
    used = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("mix_tokens"), F.max("times").alias("most_repeats"), F.count("*").alias("mix_documents"))
    report = plan.join(used, "source", "left").select(
        "source", "target_share", "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.col("tokens").alias("source_tokens"), F.coalesce("mix_documents", F.lit(0)).alias("mix_documents"),
        F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce("mix_tokens", F.lit(0)) / F.sum("mix_tokens").over(Window.partitionBy(F.lit(1))), 6).alias("reached_share"),
    )
    return out, report


def mix_check(report: DataFrame) -> DataFrame:
    """Per source with documents: how many, whether the cap on repeats holds, and whether the source's tokens in the mix are as many as its share says."""
    every = Window.partitionBy(F.lit(1))  # a row per source
    share = F.abs(F.col("reached_share") - F.col("mix_tokens") / F.sum("mix_tokens").over(every)) < 1e-5
    return report.withColumn("adds_up", share).where("documents > 0").select("source", "documents", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_caps"), "adds_up")
