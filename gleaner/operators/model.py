"""The canonical sample: schema, validity and the views of the test tables in that form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.session import table

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>"
#: Column to type; pos is the arrival order on which every keep-first rule depends.
SAMPLE = {
    "id": "string", "strategy": "string", "instruction": "string", "output": "string", "reasoning": "string",
    "messages": f"array<{MESSAGE}>", "tools": "string", "lineage": "map<string,string>", "pos": "bigint",
}
#: What stages and judges leave in a sample's metadata; null until they ran.
METRIC_FIELDS = ("special_char_ratio:double", "ngram_diversity:double", "scores:map<string,double>", "total_score:double", "score_source:string")
METRICS = f"struct<{','.join(METRIC_FIELDS)}>"


def as_samples(df: DataFrame, **columns: Column) -> DataFrame:
    """df in the canonical form: given columns, the others null; given columns that are not in the form follow it. Extra
    columns of df are left out."""
    more = [c.alias(name) for name, c in columns.items() if name not in SAMPLE]
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SAMPLE.items()], *more)


def as_json(df: DataFrame) -> Column:
    """A canonical sample as JSON text, and from_json back."""
    return F.to_json(F.struct(*SAMPLE))


def from_json(text: Column) -> Column:
    return F.from_json(text, ", ".join(f"`{k}` {t}" for k, t in SAMPLE.items()))


def problems(df: DataFrame) -> Column:
    """Array of broken rules of each sample: C1 id, C2 strategy, C3 exactly one of messages and flat text. Empty: valid."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    has_messages = F.coalesce(F.size("messages"), F.lit(0)) > 0
    flat = ~blank("instruction") | ~blank("output")
    rules = [(blank("id"), "C1"), (blank("strategy"), "C2"), (has_messages == flat, "C3")]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))


def validated(df: DataFrame, strict: bool = False) -> DataFrame:
    """df with its problems; strict fails the job at the first invalid sample. Rule C4, a metadata object with objects for
    lineage and metrics, holds by type here; readers check it on what they read."""
    out = df.withColumn("problems", problems(df))
    return enforced(out) if strict else out


def enforced(df: DataFrame) -> DataFrame:
    """df, failing the job at the first row with problems."""
    fails = F.raise_error(F.concat(F.lit("invalid sample "), F.coalesce("id", F.lit("?")), F.lit(": "), F.array_join("problems", ",")))
    return df.withColumn("problems", F.when(F.size("problems") > 0, fails.cast("array<string>")).otherwise(F.col("problems")))


def core_text(df: DataFrame) -> Column:
    return T.text_for_dedup(df["instruction"], df["output"], df["messages"])


def document_samples(spark: SparkSession, root: str) -> DataFrame:
    """Documents as flat samples: the instruction names source and language, pos is doc_id."""
    docs = table(spark, root, "documents")
    named = F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce("lang", F.lit("")))
    return as_samples(docs, id=F.col("doc_id"), strategy=F.lit("document"), instruction=named, output=F.coalesce("text", F.lit("")), pos=F.col("doc_id"))


def message_samples(spark: SparkSession, root: str) -> DataFrame:
    """The message-form samples, once per id; pos comes from the id, so the order is the same in every run."""
    rows = table(spark, root, "samples").filter("messages is not null and id is not null").groupBy("id")
    rows = rows.agg(F.max_by(F.struct("strategy", "messages", "tools", "reasoning"), F.struct("created_at", "total_score")).alias("s"))
    full = F.transform("s.messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")))
    pos = F.conv(F.substring("id", 1, 15), 16, 10).cast("bigint")
    return as_samples(rows, id=F.col("id"), strategy=F.col("s.strategy"), messages=full, tools=F.col("s.tools"), reasoning=F.col("s.reasoning"), pos=pos)
