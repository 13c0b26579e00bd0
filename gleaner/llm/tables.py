"""Access to the training-data tables, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import cut, table

__all__ = ["cut", "flat_samples", "stack_fields", "table"]


def flat_samples(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Rows of flat samples (null messages), only the named columns. An id's rows carry the same text, so operators
    judge every row and drop repeated ids from their small results instead of shuffling texts."""
    return table(spark, root, "samples").filter(F.col("messages").isNull() & F.col("id").isNotNull()).select(*columns)


def stack_fields(df: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """One row per named text field: keep columns, field_name, text. Null texts are left out."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    return df.select(*keep, F.inline(cells)).filter(F.col("text").isNotNull())
