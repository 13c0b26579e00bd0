"""First-wins resolution: a row is dropped exactly if a kept earlier row is close to it.

This is the lexicographically first maximal independent set of the closeness graph, not its components. Rows meet under
keys; close rows share one. Hot keys are settled by leaders: the earliest open row under all its keys is kept, rows
close to it are dropped, so no key pairs all its rows. When every key is small, verified pairs are resolved by fixpoint.
Each round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut

#: Open rows under one key up to which all its pairs are compared.
GROUP = 64


def _near(rows: DataFrame, others: DataFrame, whats: DataFrame, close: Callable[[Column, Column], Column], earlier: bool, exact: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(id, other): rows that share a key with, and are close to, one of others (an earlier one, if asked)."""
    a = rows.select("id", "at", F.explode("keys").alias("key"))
    b = others.select(F.col("id").alias("other"), F.col("at").alias("other_at"), F.explode("keys").alias("key"))
    met = a.join(b, "key")
    met = met.filter((F.col("other_at") < F.col("at")) if earlier else (F.col("id") != F.col("other"))).select("id", "other").distinct()
    # A pair that meets under several keys is verified once; payloads are joined only to distinct pairs.
    met = met.join(whats, "id").join(whats.select(F.col("id").alias("other"), F.col("what").alias("other_what")), "other")
    met = met.filter(close(F.col("what"), F.col("other_what"))).select("id", "other")
    return met if exact is None else exact(cut(met))


def first_wins(rows: DataFrame, close: Callable[[Column, Column], Column], group: int = GROUP, exact: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows (id, at: total order, keys: array, what: compared) to (id, kept, by): by is the earliest kept row that is
    close to a dropped one. Rows with null or no keys are kept. exact says which pairs (id, other) are close where close is
    only a small what's necessary condition."""
    rows = cut(rows.withColumn("keys", F.coalesce("keys", F.slice(F.array(F.lit(0).cast("bigint")), 1, 0))))
    # What is compared stays where it is; only ids, places and keys go through the rounds.
    whats, still, kept = rows.select("id", "what"), rows.drop("what"), []
    while (largest := still.select(F.explode("keys").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] or 0) > group:
        cells = still.select("id", "at", F.explode("keys").alias("key"))
        first = cells.groupBy("key").agg(F.min("at").alias("first"))
        behind = cells.join(first, "key").filter(F.col("at") != F.col("first")).select("id").distinct().withColumn("behind", F.lit(True))
        marked = cut(still.join(behind, "id", "left"))
        now = marked.filter("behind is null").drop("behind")
        rest = marked.filter("behind").drop("behind")
        kept.append(now)
        still = cut(rest.join(_near(rest, now, whats, close, False, exact).select("id").distinct(), "id", "left_anti"))
    whole = not kept  # no row was settled without its pairs
    every = pairs = cut(_near(still, still, whats, close, True, exact))
    while not pairs.isEmpty():
        now = cut(still.join(pairs.select("id").distinct(), "id", "left_anti"))
        kept.append(now)
        gone = pairs.join(now.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
        still = cut(still.join(pairs.select("id").distinct(), "id", "left_semi").join(gone, "id", "left_anti"))
        ids = still.select("id")
        pairs = cut(pairs.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "other"), "other", "left_semi"))
    winners = cut(reduce(DataFrame.unionByName, kept, still))
    dropped = rows.drop("what").join(winners.select("id"), "id", "left_anti")
    reasons = every if whole else _near(dropped, winners, whats, close, True, exact)
    reasons = reasons.join(winners.select(F.col("id").alias("other"), "at"), "other")
    reasons = reasons.groupBy("id").agg(F.min_by("other", "at").alias("by"))
    out = winners.select("id", F.lit(True).alias("kept"), F.lit(None).cast(rows.schema["id"].dataType).alias("by"))
    return out.unionByName(dropped.select("id").join(reasons, "id", "left").select("id", F.lit(False).alias("kept"), "by"))


def resolve_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (id, at) and close pairs (id, other: earlier) to (id, kept), by the same rule."""
    state, pairs = cut(rows.select("id").distinct()), cut(pairs.select("id", "other").distinct())
    kept = []
    while not pairs.isEmpty():
        now = cut(state.join(pairs.select("id").distinct(), "id", "left_anti"))
        kept.append(now)
        gone = pairs.join(now.withColumnRenamed("id", "other"), "other", "left_semi").select("id").distinct()
        state = cut(state.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        pairs = cut(pairs.join(state, "id", "left_semi").join(state.withColumnRenamed("id", "other"), "other", "left_semi"))
    winners = reduce(DataFrame.unionByName, kept, state).withColumn("kept", F.lit(True))
    return rows.select("id").distinct().join(winners, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
