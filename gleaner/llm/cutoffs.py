"""Problem 7: a score cutoff per source that keeps a target fraction, by multi-sequence selection.

Every partition sorts its scores once (the runs, written to the shared checkpoint folder). The driver then only
exchanges pivots and ranks: each round sends a bounded list of pivots per source, every run answers with searchsorted
ranks inside its still open index range, and the summed ranks narrow the bracket of each source. Nothing that grows
with the data reaches the driver: a round returns (sources x PIVOTS) counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tables import cut, table

#: Pivots per source and round; 8 bits of the 64-bit score order are settled by each round.
PIVOTS = 255
#: Scores in one run at most, so that a run is a row of bounded size.
RUN = 65_536
_TOP = np.uint64(1 << 63)


def order_key(x: np.ndarray) -> np.ndarray:
    """Doubles to unsigned integers of the same order (-0.0 counts as 0.0)."""
    bits = (np.asarray(x, dtype=np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def key_score(k: int) -> float:
    """The double of an order key."""
    k = int(k)
    bits = k ^ (1 << 63) if k >> 63 else k ^ ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def kept_count(n: int, share: float) -> int:
    """The smallest count k with k / n >= share; 0 when share is not positive."""
    if not n or not share > 0:
        return 0
    k = min(n, math.ceil(share * n))
    while k > 1 and (k - 1) / n >= share:
        k -= 1
    while k < n and k / n < share:
        k += 1
    return k


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list[np.ndarray]] = {}

    def emit(source: str) -> pd.DataFrame:
        keys = np.sort(order_key(np.concatenate(held.pop(source))))
        return pd.DataFrame({"source": [source], "n": [len(keys)], "run": [keys.tobytes()]})

    for pdf in batches:
        for source, part in pdf.groupby("source", sort=False):
            held.setdefault(source, []).append(part["score"].to_numpy())
            if sum(map(len, held[source])) >= RUN:
                yield emit(source)
    for source in list(held):
        yield emit(source)


def sorted_runs(scores: DataFrame) -> DataFrame:
    """(source, score) to rows (source, n, run) of locally sorted order keys. Rows keep the partition they are in, so a
    source with a third of all rows is spread over every partition."""
    return scores.select("source", "score").mapInPandas(_runs, "source string, n long, run binary")


def _ranks(runs: DataFrame, pivots: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """Scores at or above each pivot, per source."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            for source, n, run in zip(pdf["source"], pdf["n"], pdf["run"]):
                if source in pivots:
                    keys = np.frombuffer(run, dtype=np.uint64)
                    ranks = n - np.searchsorted(keys, np.array(pivots[source], dtype=np.uint64), side="left")
                    found[source] = found.get(source, 0) + ranks
        rows = [(s, i, int(c)) for s, ranks in found.items() for i, c in enumerate(ranks)]
        yield pd.DataFrame(rows, columns=["source", "i", "c"])

    out = {s: np.zeros(len(p), dtype=np.int64) for s, p in pivots.items()}
    for s, i, c in runs.mapInPandas(count, "source string, i int, c long").groupBy("source", "i").agg(F.sum("c")).collect():
        out[s][i] = c
    return out


def select_cutoffs(runs: DataFrame, shares: dict[str, float]) -> dict[str, tuple[float | None, int, int]]:
    """Per source of shares: (cutoff, kept, total). The cutoff is the highest score such that the scores at or above it
    are at least the share of all; None and 0 kept where the source has no scores or its share is not positive."""
    totals = {s: int(n) for s, n in runs.groupBy("source").agg(F.sum("n")).filter(F.col("source").isin(list(shares))).collect()} if shares else {}
    want = {s: kept_count(totals.get(s, 0), shares[s]) for s in shares}
    # Keys in [low, high): count(>= low) reaches the wanted count, count(>= high) does not.
    bracket = {s: [0, 1 << 64] for s, k in want.items() if k}
    kept = dict(totals)
    while live := {s: b for s, b in bracket.items() if b[1] - b[0] > 1}:
        pivots = {}
        for s, (low, high) in live.items():
            step = max(1, -(-(high - low) // (PIVOTS + 1)))
            pivots[s] = list(range(low + step, high, step))
        for s, ranks in _ranks(runs, pivots).items():
            for pivot, rank in zip(pivots[s], ranks):
                if rank >= want[s]:
                    bracket[s][0], kept[s] = pivot, int(rank)
                else:
                    bracket[s][1] = pivot
                    break
    return {s: (key_score(bracket[s][0]), kept[s], totals[s]) if s in bracket else (None, 0, totals.get(s, 0)) for s in shares}


def latest_scores(spark: SparkSession, root: str) -> DataFrame:
    """(id, source, score) of the latest row of each id, for scores that are neither null nor NaN. Of rows with the
    same created_at the one with the larger score counts. Rows without id or strategy take no part."""
    row = F.struct("created_at", "total_score", "strategy")
    return (
        table(spark, root, "samples")
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(row).alias("last"))
        .select("id", F.col("last.strategy").alias("source"), F.col("last.total_score").alias("score"))
        .filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("source").isNotNull())
    )


def _solved(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The scores and one row (source, keep_share, cutoff, kept, total) per target. Targets are one row per source by
    contract of the table, which does not grow."""
    targets = table(spark, root, "keep_targets").filter("strategy is not null and keep_share is not null")
    shares = {s: float(x) for s, x in targets.groupBy("strategy").agg(F.max("keep_share")).collect()}
    scores = cut(latest_scores(spark, root))
    found = select_cutoffs(cut(sorted_runs(scores)), shares)
    rows = [(s, shares[s], *found[s]) for s in sorted(shares)]
    return scores, spark.createDataFrame(rows, "source string, keep_share double, cutoff double, kept long, total long")


def cutoffs(spark: SparkSession, root: str) -> DataFrame:
    """Per target source: strategy, keep_share, cutoff, kept, total."""
    return _solved(spark, root)[1].withColumnRenamed("source", "strategy")


def kept_samples(spark: SparkSession, root: str) -> DataFrame:
    """p7_found: ids at or above the cutoff of their strategy. One row of cutoffs per source is broadcast."""
    scores, found = _solved(spark, root)
    limits = F.broadcast(found.filter("cutoff is not null").select("source", "cutoff"))
    return scores.join(limits, "source").filter("score >= cutoff").select("id")


_LATEST = """
with latest as (
  select id, strategy, total_score,
         row_number() over (partition by id order by created_at desc, total_score desc nulls last) rn
  from samples where id is not null),
scores as (
  select l.id, l.strategy, l.total_score, k.keep_share from latest l join keep_targets k on l.strategy = k.strategy
  where rn = 1 and total_score is not null and cast(total_score as varchar) <> 'nan'),
ranked as (
  select *, count(*) over (partition by strategy) n,
         count(*) over (partition by strategy order by total_score desc range between unbounded preceding and current row) at_or_above
  from scores),
cut as (
  select strategy, max(total_score) cutoff, min(at_or_above) kept from ranked where at_or_above * 1.0::double / n >= keep_share group by strategy)
"""

QUERIES = {"p7_found": kept_samples, "p7_cutoffs": cutoffs}
ORACLE_SQL = {
    "p7_found": _LATEST + "select s.id from scores s join cut c on s.strategy = c.strategy where s.total_score >= c.cutoff",
    "p7_cutoffs": _LATEST
    + """select k.strategy, k.keep_share, c.cutoff, coalesce(c.kept, 0) kept, coalesce(t.n, 0) total
from keep_targets k left join cut c on k.strategy = c.strategy
left join (select strategy, count(*) n from scores group by 1) t on k.strategy = t.strategy""",
}
