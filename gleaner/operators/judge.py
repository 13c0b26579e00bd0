"""Judge scores: long form (sample_id, endpoint, dim, value) to gates and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the values of one dimension become one; the median is exact and lies between the middle two of an even number.
AGGREGATIONS = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}


def clamp(value: Column, most: Column | float) -> Column:
    """A judge's value inside [1, most]; NaN and null count as not scored."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(1.0), F.least(value, most if isinstance(most, Column) else F.lit(float(most)))))


def per_dimension(scores: DataFrame, how: str = "mean", dims: list[str] | None = None) -> DataFrame:
    """(sample_id, dim, value, spread, judges) of the values that count."""
    rows = scores.filter("value is not null")
    if dims is not None:
        rows = rows.filter(F.col("dim").isin(dims))
    spread = F.max("value") - F.min("value")
    return rows.groupBy("sample_id", "dim").agg(AGGREGATIONS[how]("value").alias("value"), spread.alias("spread"), F.count("*").alias("judges"))


def judged(
    samples: DataFrame, scores: DataFrame | None, dims: dict[str, float], how: str = "mean", min_judges: int = 1, max_disagreement: float = 0.0,
    min_total: float = 0.0, local: DataFrame | None = None, remote: bool | None = None, labels: list[str] | None = None,
) -> DataFrame:
    """samples (id) to (id, scores: map, total, score_source, drop_code). Gates in this order: insufficient_judges,
    judge_disagreement, min_total (on the unrounded total).

    scores (sample_id, endpoint, dim, value, and judge where one endpoint judges twice) are those of remote judges; a judge
    counts if it scored any declared dimension. Without remote judges (scores None, or remote False) the gates on judges
    don't apply and the source doesn't name them. local (sample_id, source, priority, weight, dim, value in [0, 1]) fills
    dimensions that no judge scored, the scorer of lowest priority first; labels name the scorers that were asked, else
    those with values are. Samples without any score have an empty map and total 0."""
    remote = scores is not None if remote is None else remote
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    if scores is None:
        scores = samples.sparkSession.createDataFrame([], "sample_id string, endpoint string, dim string, value double")
    found = per_dimension(scores, how, list(dims))
    agreed = found.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("remote"), F.max(F.when(F.col("judges") > 1, F.col("spread"))).alias("spread"))
    who = "judge" if "judge" in scores.columns else "endpoint"
    success = scores.filter("value is not null").groupBy("sample_id").agg(F.countDistinct(who).alias("success"))
    out = samples.select("id").join(agreed.withColumnRenamed("sample_id", "id"), "id", "left").join(success.withColumnRenamed("sample_id", "id"), "id", "left")
    source: list[Column] = [F.lit("llm")] if remote else []
    if local is not None:
        most = F.create_map(*[F.lit(x) for pair in dims.items() for x in pair])
        scaled = local.filter(F.col("dim").isin(list(dims))).withColumn("scaled", F.col("value") * most[F.col("dim")].cast("double") * F.col("weight"))
        first = scaled.groupBy("sample_id", "dim").agg(F.min_by("scaled", "priority").alias("scaled"))
        filled = first.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "scaled"))).alias("local"))
        out = out.join(filled.withColumnRenamed("sample_id", "id"), "id", "left")
        added = F.map_filter(F.coalesce("local", empty), lambda k, v: ~F.map_contains_key(F.coalesce(F.col("remote"), empty), k))
        out = out.withColumn("scores", F.map_concat(F.coalesce("remote", empty), added))
        if labels is None:
            named = local.groupBy("sample_id").agg(F.sort_array(F.collect_set(F.struct("priority", "source"))).alias("labels"))
            out = out.join(named.withColumnRenamed("sample_id", "id"), "id", "left")
            source.append(F.array_join(F.transform("labels", lambda x: x["source"]), "+"))
    else:
        out = out.withColumn("scores", F.coalesce("remote", empty))
    source += [F.lit(label) for label in labels or []]
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, v: s + v)
    code = (
        F.when(F.lit(remote) & (F.coalesce("success", F.lit(0)) < min_judges), "insufficient_judges")
        .when(F.lit(remote and bool(max_disagreement)) & (F.col("spread") > max_disagreement), "judge_disagreement")
        .when(F.lit(bool(min_total)) & (F.col("total") < min_total), "min_total")
    )
    rounded = F.transform_values("scores", lambda k, v: F.round(v, 3))
    label = F.concat_ws("+", *source) if source else F.lit("")
    return out.withColumn("total", total).select("id", rounded.alias("scores"), "total", F.when(label == "", "none").otherwise(label).alias("score_source"), code.alias("drop_code"))


def look_aside(wanted: DataFrame, cache: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of wanted answered by the cache, and the distinct keys that are not, to be computed once."""
    keys = wanted.select(*on).distinct()
    return wanted.join(cache, on, "inner"), keys.join(cache.select(*on), on, "left_anti")
