"""Problem 9: mixing sources to target weights by weighted fair queueing.

Every document of a source gets a shuffled place. Its virtual finish time in a mix is the tokens of its source up to and
including it, divided by the target share; a repeated use of the source continues the count, so the r-th copy of a
document finishes after all earlier copies of its source. Served in the order of finish times, sources progress in
proportion to their shares. The mix is range-sorted by finish time and truncated at the total budget.

The budget of a mix defaults to the largest that meets every share: the smallest, over its sources that have tokens, of
tokens x max_repeats / share (shares rescaled over these sources, since a source without tokens can't contribute). All
running totals are two-level prefix sums over range partitions, so a source with a third of all rows is spread.

Null and empty texts have no tokens and are not selected; targets with a null or non-positive share or max_repeats are
reported and contribute nothing; a (mix_id, source) given twice counts with its largest share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.encoding import token_counts
from gleaner.llm.tables import cut, table

#: Seed of the shuffle.
SEED = 20_240_501


def running_total(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the running total of value inside group, in the given (total) order. Rows are range-partitioned by group
    and order; totals of earlier partitions are added to each partition's own running total."""
    parts = df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts)  # the partition numbers must not change when a task is run again
    inside = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.groupBy("_part", group).agg(F.sum(value).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    out = parts.withColumn("_own", F.sum(value).over(inside)).join(starts.select("_part", group, "_start"), ["_part", group])
    return out.withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def _targets(mixes: DataFrame) -> DataFrame:
    rows = mixes.filter("mix_id is not null and source is not null").groupBy("mix_id", "source")
    rows = rows.agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & ~F.isnan("target_share")
    return rows.withColumn("usable", F.coalesce(usable, F.lit(False)))


def plan(documents: DataFrame, mixes: DataFrame, budget: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_id, doc_id, source, n_tokens, times) and the targets with the totals they are planned on."""
    sized = token_counts(documents.filter("source is not null and text is not null"), ("doc_id", "source"), path=path).filter("n_tokens > 0")
    shuffled = sized.withColumn("place", F.xxhash64(F.lit(SEED), F.col("doc_id")))
    # Range partitioning looks at its input twice; texts are encoded once.
    docs = cut(running_total(cut(shuffled), "source", [F.col("place"), F.col("doc_id")], "n_tokens", "upto"))
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    targets = cut(_targets(mixes).join(totals, "source", "left").withColumn("usable", F.col("usable") & F.col("source_tokens").isNotNull()))
    used = targets.filter("usable")
    scaled = used.join(used.groupBy("mix_id").agg(F.sum("target_share").alias("all_shares")), "mix_id")
    scaled = scaled.withColumn("weight", F.col("target_share") / F.col("all_shares"))
    most = F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("weight"))
    limits = scaled.groupBy("mix_id").agg((F.least(most, F.lit(float(budget))) if budget else most).alias("budget"))
    scaled = scaled.join(limits, "mix_id")
    # Copy r of a document finishes at (r x source tokens + upto) / weight; later copies than the budget allows don't.
    copies = docs.join(scaled, "source").select(
        "mix_id", "doc_id", "source", "n_tokens", "budget", "weight", "upto", "source_tokens",
        F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)).alias("copy"),
    )
    copies = copies.withColumn("finish", (F.col("copy") * F.col("source_tokens") + F.col("upto")) / F.col("weight"))
    copies = copies.filter(F.col("finish") <= F.col("budget") * (1 + 1e-9)).drop("weight", "upto", "source_tokens")
    queued = running_total(copies, "mix_id", [F.col("finish"), F.col("source"), F.col("doc_id"), F.col("copy")], "n_tokens", "served")
    chosen = queued.filter(F.col("served") <= F.col("budget"))
    selection = chosen.groupBy("mix_id", "doc_id", "source", "n_tokens").agg(F.count("*").cast("int").alias("times"))
    return selection, targets


def selection(spark: SparkSession, root: str) -> DataFrame:
    """p9_mix: mix_id, doc_id, source, n_tokens and how often the document is used."""
    return plan(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def shares(spark: SparkSession, root: str) -> DataFrame:
    """p9_shares: every target with its actual share of the mix, tokens, uses and most repeats of one document."""
    chosen, targets = plan(table(spark, root, "documents"), table(spark, root, "mix_targets"))
    got = chosen.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("uses"), F.max("times").alias("most_times")
    )
    rows = targets.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "uses", "most_times"])
    whole = rows.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    rows = rows.join(whole, "mix_id").withColumn("actual_share", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)))
    return rows.select("mix_id", "source", "target_share", "max_repeats", "actual_share", "tokens", "uses", "most_times", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"))


QUERIES = {"p9_mix": selection, "p9_shares": shares}
ORACLE_SQL: dict[str, str] = {}
