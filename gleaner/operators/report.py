"""Reports over stage and judge results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def waterfall(df: DataFrame) -> DataFrame:
    """Rows per (stage, reason); kept rows under stage kept. Counted before the shuffle."""
    return df.groupBy(F.coalesce("drop_stage", F.lit("kept")).alias("stage"), F.coalesce("drop_code", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """produced, dropped and all rows."""
    dropped = F.count("drop_stage")
    return df.agg((F.count("*") - dropped).alias("produced"), dropped.alias("dropped"), F.count("*").alias("total_in"))


#: Lower ends of the score buckets.
BUCKETS = (0, 5, 10, 15, 20)


def score_distribution(df: DataFrame, total: str = "total") -> DataFrame:
    """(bucket, n, mean) of totals over 0; the bucket is its lower end, the mean has one decimal."""
    rows = df.filter(F.col(total) > 0).filter(~F.isnan(total))
    bucket = F.coalesce(*[F.when(F.col(total) >= b, F.lit(b)) for b in reversed(BUCKETS)])
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(total), 1).alias("mean"))


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each state table."""
    counts = [t.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, t in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def cost(calls: int = 0, retried: int = 0, embedded: int = 0, cached: int = 0) -> str:
    """What a run paid for and what it found in its caches, in one line."""
    return f"llm_calls={calls} retried={retried} embed_calls={embedded} cache_hits={cached}"


def text_report(rows: list[tuple[str, str, int]], buckets: list[tuple[int, int, float]], costs: str) -> str:
    """The report of a run: rows of waterfall, of score_distribution (lower end, n, mean) and the cost line."""
    kept = sum(n for stage, _, n in rows if stage == "kept")
    lines = [f"{sum(n for *_, n in rows)} in, {kept} out"]
    lines += [f"  {stage} {reason}: {n}" for stage, reason, n in sorted(rows) if stage != "kept"]
    if buckets:
        n = sum(b[1] for b in buckets)
        ends = [*(str(b) for b in BUCKETS[1:]), ""]
        named = {b: f"{b}-{e}" if e else f"{b}+" for b, e in zip(BUCKETS, ends)}
        lines.append(f"scored={n} mean={sum(b[1] * b[2] for b in buckets) / n:.1f} [{', '.join(f'{named[b]}: {k}' for b, k, _ in sorted(buckets))}]")
    return "\n".join([*lines, costs])
