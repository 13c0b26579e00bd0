"""Renderers: canonical samples to the four output formats as typed columns, and their sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.model import METRICS


def _has_messages() -> Column:
    return F.coalesce(F.size("messages"), F.lit(0)) > 0


def _turn(role: str, content: Column, names: tuple[str, str] = ("role", "content")) -> Column:
    return F.struct(F.lit(role).alias(names[0]), content.alias(names[1]))


def _answer(thinking: bool) -> Column:
    out = F.coalesce("output", F.lit(""))
    return T.think(F.col("reasoning"), out) if thinking else out


def _tagged() -> list[Column]:
    return [F.col("id"), F.col("strategy")]


def _metrics(df: DataFrame) -> Column:
    return F.col("metrics") if "metrics" in df.columns else F.lit(None).cast(METRICS)


def _alpaca(df: DataFrame, thinking: bool) -> list[Column]:
    """instruction, output and metadata; samples in message form have empty texts. lineage and metrics are null where the
    lineage is empty."""
    has = F.size("lineage") > 0
    meta = F.struct(*_tagged(), F.when(has, F.col("lineage")).alias("lineage"), F.when(has, _metrics(df)).alias("metrics"))
    return [F.coalesce("instruction", F.lit("")).alias("instruction"), _answer(thinking).alias("output"), meta.alias("metadata")]


def _dialogue(thinking: bool, always_user: bool) -> Column:
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    if thinking:
        last = F.element_at(plain, -1)
        wrapped = F.struct(last["role"].alias("role"), T.think(F.col("reasoning"), F.coalesce(last["content"], F.lit(""))).alias("content"))
        ends = (last["role"] == "assistant") & (F.coalesce("reasoning", F.lit("")) != "")
        plain = F.when(ends, F.concat(F.slice(plain, 1, F.size(plain) - 1), F.array(wrapped))).otherwise(plain)
    asked = F.coalesce("instruction", F.lit(""))
    answer = _turn("assistant", _answer(thinking))
    both, only = F.array(_turn("user", asked), answer), F.array(answer)
    flat = both if always_user else F.when(asked != "", both).otherwise(only)
    return F.when(_has_messages(), plain).otherwise(flat)


def _chatml(df: DataFrame, thinking: bool) -> list[Column]:
    """messages and metadata; a flat sample has a user turn only if its instruction isn't empty."""
    return [_dialogue(thinking, False).alias("messages"), F.struct(*_tagged(), "lineage", _metrics(df).alias("metrics")).alias("metadata")]


def _openai(df: DataFrame, thinking: bool) -> list[Column]:
    """Like chatml, the user turn always there, tools attached."""
    return [_dialogue(thinking, True).alias("messages"), F.col("tools"), F.struct(*_tagged()).alias("metadata")]


def _sharegpt(df: DataFrame, thinking: bool) -> list[Column]:
    """conversations of from and value; roles that are not known count as user, thinking only concerns flat samples."""
    names = ("from", "value")
    role = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").when(r == "system", "system").otherwise("user")
    spoken = F.transform("messages", lambda m: F.struct(role(m["role"]).alias("from"), F.coalesce(m["content"], F.lit("")).alias("value")))
    asked = F.coalesce("instruction", F.lit(""))
    answer = _turn("gpt", _answer(thinking), names)
    flat = F.when(asked != "", F.array(_turn("human", asked, names), answer)).otherwise(F.array(answer))
    return [F.when(_has_messages(), spoken).otherwise(flat).alias("conversations"), F.struct(*_tagged()).alias("metadata")]


SHAPES: dict[str, Callable[[DataFrame, bool], list[Column]]] = {"alpaca": _alpaca, "chatml": _chatml, "sharegpt": _sharegpt, "openai": _openai}
FORMATS = tuple(SHAPES)


def render(df: DataFrame, fmt: str, thinking: bool = False) -> DataFrame:
    """Samples in one of FORMATS. An unknown one is a ValueError."""
    if fmt not in SHAPES:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    return df.select(*SHAPES[fmt](df, thinking))


def rendered(df: DataFrame, fmt: str, thinking: bool = False) -> Column:
    """The same as a column of JSON text, beside df's own."""
    return F.to_json(F.struct(*SHAPES[fmt](df, thinking)))


alpaca, chatml, openai, sharegpt = (partial(render, fmt=f) for f in ("alpaca", "chatml", "openai", "sharegpt"))


def derive_format(strategies: list[str], explicit: str | None = None) -> str:
    """The configured format, else openai if any strategy calls tools, else alpaca."""
    return explicit or ("openai" if "tool_call" in strategies else "alpaca")


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line; null fields are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def payload(df: DataFrame) -> Column:
    """A sample with its metadata as JSON text, the form in which state tables keep it."""
    return F.to_json(F.struct("id", "strategy", "instruction", "output", "reasoning", "messages", "tools", F.struct("lineage", _metrics(df).alias("metrics")).alias("metadata")))


#: Columns of the columnar export, in order; all but id, strategy and total_score come out of the payload.
EXPORT = ("id", "strategy", "instruction", "output", "reasoning", "messages", "tools", "metadata", "total_score")


def export_rows(samples: DataFrame) -> DataFrame:
    """State rows (id, strategy, payload, total_score, created_at) as the columns of EXPORT and created_at."""
    own = ("id", "strategy", "total_score")
    return samples.select(*[F.col(c) if c in own else F.get_json_object("payload", f"$.{c}").alias(c) for c in EXPORT], "created_at")


def write_export(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columnar export ordered by created_at and id, as range partitions; created_at only orders it."""
    order = [c for c in ("created_at", "id") if c in df.columns]
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    (out.drop("created_at") if set(EXPORT) <= set(df.columns) else out).write.mode(mode).parquet(path)


def write_lines(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The rendered text of state rows (the payload where there is none), one line each, ordered by created_at and id."""
    rows = samples.select("created_at", "id", F.coalesce("rendered", "payload").alias("value"))
    rows.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id").select("value").write.mode(mode).text(path)


def layout(path: str, storage: dict) -> dict[str, str | None]:
    """Where a run's output goes: a path that ends in .jsonl, or storage of type jsonl, is the lines themselves, without a
    state; any other path is a folder with the state and, if export_format names one, the export beside it."""
    if storage.get("type") == "jsonl" or path.endswith(".jsonl"):
        return {"state": None, "lines": path, "export": None}
    name, fmt = storage.get("table", "samples"), storage.get("export_format", "parquet")
    return {"state": f"{path.rstrip('/')}/state", "lines": None, "export": f"{path.rstrip('/')}/{name}.{fmt}" if fmt else None}
