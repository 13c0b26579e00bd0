"""Readers: files in the input formats to canonical samples and materials.

JSON lines are read as text and parsed per line, so no schema is inferred from the data and a broken line becomes a row
with problems instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.model import MESSAGE, as_samples, core_text, problems
from gleaner.session import cut

ROW = {
    "id": "string", "instruction": "string", "query": "string", "output": "string", "response": "string", "reasoning": "string", "prompt": "string",
    "text": "string", "content": "string", "metadata": "struct<id:string,lineage:map<string,string>>", "messages": f"array<{MESSAGE}>", "tools": "string",
    "conversations": "array<struct<from:string,value:string>>",
}
FORMATS = ("flat", "alpaca", "chatml", "openai", "sharegpt")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line: from 0, pos: over all files in the order of their names, value) of text files, blank lines counted.

    A split is read in order by one task; the lines of the splits before it, which are counted first, are added to its own,
    so the numbers don't depend on how splits are spread over tasks. The counts are one row per split."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    zero = F.lit(0).cast("bigint")
    splits = splits.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), zero).alias("_all"), F.coalesce(F.sum("_n").over(inside), zero).alias("_own"))
    own = F.col("_at") - F.col("_first")
    return raw.join(F.broadcast(splits), ["file", "block"]).select("file", (F.col("_own") + own).alias("line"), (F.col("_all") + own).alias("pos"), "value")


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """The same for JSON files: elements of a list, or one object, in place of lines."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    listed = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    rows = raw.select("file", F.posexplode(F.from_json(listed, "array<string>")).alias("line", "value"))
    starts = rows.groupBy("file").count().select("file", F.coalesce(F.sum("count").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_all"))
    return rows.join(F.broadcast(starts), "file").select("file", F.col("line").cast("bigint").alias("line"), (F.col("_all") + F.col("line")).alias("pos"), "value")


def read_json_rows(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """One row per JSON object of .jsonl (lines) or .json files: the fields of ROW, whether messages was present, whether
    metadata is sound (rule C4), pos in file order, line and file. field_map renames keys first. Blank lines are left out
    but counted."""
    return _parsed((_elements if path.endswith(".json") else file_lines)(spark, path), field_map)


def read_state_rows(spark: SparkSession, folder: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """The same of the samples in a state folder: the rendered text of each, the payload where there is none, in the order
    of created_at and id. A payload is a flat row whose id and lineage stand in it."""
    from gleaner.operators.state import State

    rows = State(spark, folder).read("samples").select("created_at", "id", F.coalesce("rendered", "payload").alias("value"))
    rows = cut(rows.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id").withColumn("pos", F.monotonically_increasing_id()))
    return _parsed(rows.select(F.lit(folder).alias("file"), F.col("pos").alias("line"), "pos", "value"), field_map)


def _parsed(raw: DataFrame, field_map: dict[str, str] | None) -> DataFrame:
    names = {new: old for old, new in (field_map or {}).items()}
    of = lambda k: names.get(k, k)
    schema = ", ".join(f"`{of(k)}` {t}" for k, t in ROW.items())
    raw = raw.filter(F.length(T.strip(F.col("value"))) > 0)
    parsed = raw.withColumn("j", F.from_json("value", schema)).withColumn("keys", F.json_object_keys("value"))
    part = lambda p: F.ltrim(F.coalesce(F.get_json_object("value", p), F.lit("{")))
    meta = f"$['{of('metadata')}']"
    sound = part(meta).startswith("{") & part(f"{meta}.lineage").startswith("{") & part(f"{meta}.metrics").startswith("{")
    fields = [F.col("j")[of(k)].alias(k) for k in ROW]
    return parsed.select("pos", "line", "file", "value", F.coalesce(F.array_contains("keys", of("messages")), F.lit(False)).alias("has_messages"), sound.alias("sound"), *fields)


def _some(*columns: str) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns], F.lit(""))


def row_id(fmt: str) -> Column:
    """The row's id, that of its metadata, else one made of its content and place."""
    made = F.concat(F.lit(f"file:{fmt}:"), F.substring(F.sha2(F.col("value"), 256), 1, 16), F.lit(":"), F.col("pos").cast("string"))
    return F.coalesce(F.when(F.col("id") != "", F.col("id")), F.col("metadata.id"), made)


def sharegpt_messages(conversations: Column) -> Column:
    """from and value to role and content; speakers that are not known count as user."""
    role = lambda r: F.when(r.isin("gpt", "assistant"), "assistant").when(r == "system", "system").otherwise("user")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    turn = lambda c: F.struct(role(c["from"]).alias("role"), F.coalesce(c["value"], F.lit("")).alias("content"), none("tool_calls", "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"), none("tool_call_id", "string"))
    return F.transform(conversations, turn)


def to_samples(rows: DataFrame, fmt: str = "flat") -> DataFrame:
    """Rows of read_json_rows as canonical samples; rows whose text is blank are left out. Only flat and alpaca rows keep
    the lineage of their metadata."""
    return _adapted(rows, fmt).drop("sound")


def _adapted(rows: DataFrame, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown input format {fmt!r}; known: {', '.join(FORMATS)}")
    talk = {"chatml": F.lit(True), "openai": F.lit(True), "sharegpt": F.lit(True), "flat": F.col("has_messages"), "alpaca": F.lit(False)}[fmt]
    spoken = sharegpt_messages(F.col("conversations")) if fmt == "sharegpt" else F.col("messages")
    only = lambda c, yes: F.when(talk if yes else ~talk, c)
    from_file = F.create_map(F.lit("input"), F.lit("file"))
    lineage = F.when(talk, from_file).otherwise(F.coalesce("metadata.lineage", from_file)) if fmt in ("flat", "alpaca") else F.lit(None)
    out = as_samples(
        rows, id=row_id(fmt), strategy=F.lit("file"), instruction=only(_some("instruction", "query"), False), output=only(_some("output", "response"), False),
        reasoning=only(F.coalesce("reasoning", F.lit("")), False), messages=only(spoken, True), tools=F.col("tools") if fmt in ("openai", "flat") else F.lit(None),
        lineage=lineage, pos=F.col("pos"), sound=F.col("sound") | talk,
    )
    return out.filter(F.length(T.strip(core_text(out))) > 0)


def open_file(spark: SparkSession, path: str, fmt: str = "flat", field_map: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """The samples of a file, or of a state folder (named state), with the rules they break (C1 to C4) in problems; strict
    fails the job at the first that does."""
    from gleaner.operators.model import enforced

    is_state = path.rstrip("/").rsplit("/", 1)[-1] == "state"
    out = _adapted((read_state_rows if is_state else read_json_rows)(spark, path, field_map), fmt)
    checked = out.withColumn("problems", F.array_compact(F.concat(problems(out), F.array(F.when(~F.coalesce("sound", F.lit(True)), "C4"))))).drop("sound")
    return enforced(checked) if strict else checked


def materialize(rows: DataFrame, path: str) -> DataFrame:
    """Materials written once to a shared folder and read from there."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def load_seeds(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """(id, instruction, output, pos) of a JSON-lines file; prompt and response stand in, missing ids name file and
    line. No seeds: ValueError."""
    rows = read_json_rows(spark, path, field_map)
    named = F.concat(F.lit("seed:"), F.regexp_extract("file", r"([^/]+)$", 1), F.lit(":"), F.col("line").cast("string"))
    out = rows.select(F.coalesce("id", named).alias("id"), F.coalesce("instruction", "prompt").alias("instruction"), F.coalesce("output", "response").alias("output"), "pos")
    if out.isEmpty():
        raise ValueError(f"no seeds in {path}")
    return out


def load_documents(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """(id, text, pos, meta: the row's JSON): rows of .json and .jsonl files with text or content, other files whole, in the
    order of their names; normalised, empty ones left out. None left: ValueError."""
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    if path.endswith((".json", ".jsonl")):
        rows = read_json_rows(spark, path, field_map)
        out = rows.select(F.coalesce("id", F.concat(base, F.lit(":"), F.col("line").cast("string"))).alias("id"), _some("text", "content").alias("text"), "pos", F.col("value").alias("meta"))
    else:
        rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        names = rows.select("file").withColumn("pos", (F.row_number().over(W.orderBy("file")) - 1).cast("bigint"))
        out = rows.join(F.broadcast(names), "file").select(base.alias("id"), F.col("value").alias("text"), "pos", F.lit(None).cast("string").alias("meta"))
    out = out.withColumn("text", T.normalize_text(F.col("text"))).filter("text <> ''")
    if out.isEmpty():
        raise ValueError(f"no documents in {path}")
    return out


def load_topics(spark: SparkSession, topics: list[dict]) -> DataFrame:
    """(pos, topic, weight, knowledge); weights below 0 count as 0 and all add up to 1."""
    weights = [max(0.0, float(t.get("weight", 1.0))) for t in topics]
    whole = sum(weights) or 1.0
    rows = [(i, t["topic"], w / whole, t.get("knowledge")) for i, (t, w) in enumerate(zip(topics, weights))]
    return spark.createDataFrame(rows, "pos int, topic string, weight double, knowledge string")


def load_tools(tools: list[dict]) -> list[dict]:
    """The tools, each with a name and parameters; none, or one without: ValueError."""
    if not tools:
        raise ValueError("no tools")
    for t in tools:
        function = t.get("function") or {}
        if not function.get("name") or "parameters" not in function:
            raise ValueError(f"tool without function.name or function.parameters: {t}")
    return tools
