"""Planners: budgets per strategy and the task specs of each.

Specs: (id, strategy, payload JSON, lineage map, pos). Plans that follow an index are DataFrames over spark.range; plans
whose draws follow the standard random generator in order are made on the driver, bounded by their budget."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.chunking import semantic_chunks, structure_chunks
from gleaner.session import cut

SPEC = "id string, strategy string, payload string, lineage map<string,string>, pos bigint"


class PlanError(ValueError):
    """The budget can't be split as asked."""


def allocate(strategies: list[dict], total: int | None = None, only: list[str] | None = None) -> list[tuple[str, int]]:
    """(type, count) per strategy {type, count, weight}. Counts that are given come off the total; the rest is split by
    weight, rounded down, the remainder going to the heaviest (of equal ones the first). Without a total every strategy
    needs its count. Zero counts are left out unless all are."""
    chosen = [s for s in strategies if only is None or s["type"] in only]
    if not chosen:
        raise PlanError("no strategy takes part")
    counts = [s.get("count") for s in chosen]
    if total is None:
        if None in counts:
            raise PlanError("without a total every strategy needs a count")
    else:
        left = total - sum(c for c in counts if c is not None)
        if left < 0:
            raise PlanError(f"the given counts exceed the total of {total}")
        weights = [max(0.0, float(s.get("weight", 1.0))) if c is None else None for s, c in zip(chosen, counts)]
        whole = sum(w for w in weights if w is not None) or 1.0
        counts = [int(left * w / whole) if w is not None else c for w, c in zip(weights, counts)]
        free = [i for i, w in enumerate(weights) if w is not None]
        if free:
            heaviest = max(free, key=lambda i: (weights[i], -i))
            counts[heaviest] += left - sum(counts[i] for i in free)
    out = [(s["type"], c) for s, c in zip(chosen, counts) if c > 0]
    return out or [(chosen[0]["type"], 0)]


def preview(allocation: list[tuple[str, int]], size: int) -> list[tuple[str, int]]:
    """The allocation scaled to about size specs, at least one of each that has any; the largest takes the difference."""
    total = sum(n for _, n in allocation)
    if total <= size or not total:
        return allocation
    scaled = [max(min(n, 1), round(n * size / total)) for _, n in allocation]
    most = max(range(len(scaled)), key=lambda i: allocation[i][1])
    scaled[most] = max(0, scaled[most] + size - sum(scaled))
    return [(name, n) for (name, _), n in zip(allocation, scaled)]


def _pick(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))


def topic_plan(spark: SparkSession, topics: list[str], dimensions: dict[str, list[str]], budget: int, strategy: str = "topic_driven") -> DataFrame:
    """Row n takes topic n mod topics and combination n mod combinations of the dimensions' values (the last fastest)."""
    used = {k: v for k, v in dimensions.items() if v}
    combos = [dict(zip(used, values)) for values in product(*used.values())] or [{}]
    n = F.col("id")
    rows = spark.range(budget).select(n.alias("pos"), _pick(topics, n).alias("topic"), _pick([json.dumps(c) for c in combos], n).alias("combo"))
    sorted_pairs = _pick(["|".join(f"{k}={v}" for k, v in sorted(c.items())) for c in combos], F.col("pos"))
    parts = [F.lit("topic"), F.lit(strategy), F.col("topic"), *([sorted_pairs] if used else []), F.col("pos")]
    payload = F.to_json(F.struct("topic", F.col("combo").alias("dimensions")))
    slots = F.from_json("combo", "map<string,string>")
    lineage = F.map_concat(F.create_map(F.lit("source"), F.lit("topic"), F.lit("topic"), F.col("topic")), slots)
    return rows.select(T.derive_id(*parts).alias("id"), F.lit(strategy).alias("strategy"), payload.alias("payload"), lineage.alias("lineage"), "pos")


def tool_plan(spark: SparkSession, topics: list[str], budget: int) -> DataFrame:
    rows = spark.range(budget).select(F.col("id").alias("pos"), _pick(topics, F.col("id")).alias("topic"))
    lineage = F.create_map(F.lit("source"), F.lit("tool"), F.lit("topic"), F.col("topic"))
    return rows.select(T.derive_id(F.lit("tool"), F.col("topic"), F.col("pos")).alias("id"), F.lit("tool_call").alias("strategy"), F.to_json(F.struct("topic")).alias("payload"), lineage.alias("lineage"), "pos")


#: Budget up to which the planned rows are numbered in one task.
ONE_TASK = 20_000


def _numbered(df: DataFrame, order: list[str], budget: int | None) -> DataFrame:
    """The first budget rows in order, numbered; the limit runs before the one-task numbering, which it bounds. Without a
    budget, or with one over ONE_TASK, rows are numbered inside range partitions, to which the counts of earlier partitions
    are added."""
    if budget is not None and budget > ONE_TASK:
        return _numbered(df, order, None).filter(F.col("n") < budget)
    if budget is None:
        parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # numbers must not change when a task is run again
        before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
        own = parts.withColumn("n", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
        return own.join(F.broadcast(starts), "_part").withColumn("n", F.col("n") + F.col("_start")).drop("_part", "_start")
    first = df.orderBy(*order).limit(budget)
    return first.withColumn("n", F.row_number().over(W.orderBy(*order)) - 1)


def document_plan(documents: DataFrame, budget: int, mode: str | None = None, least: int = 200, most: int = 1500, threshold: float = 0.55) -> DataFrame:
    """documents (id, text, pos) to chunk specs in document order; mode structure, semantic or None for whole texts."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    ranges = {"structure": lambda: structure_chunks(F.col("text"), least, most), "semantic": lambda: semantic_chunks(F.col("text"), threshold, most), None: lambda: whole}[mode]()
    chunks = documents.filter("text is not null").select("id", "text", "pos", F.posexplode(ranges).alias("c", "r")).select("id", "pos", "c", "r.*", T.strip(F.expr("substring(text, r.start + 1, r.end - r.start)")).alias("chunk"))
    rows = _numbered(chunks.filter("chunk <> ''"), ["pos", "id", "c"], budget)
    lineage = F.create_map(F.lit("source"), F.lit("document"), F.lit("source_id"), F.col("id"), F.lit("chunk"), F.concat(F.lit("["), "start", F.lit(", "), "end", F.lit("]")))
    return rows.select(T.derive_id(F.lit("docqa"), F.col("id"), F.col("start"), F.col("end")).alias("id"), F.lit("document_qa").alias("strategy"), F.to_json(F.struct("chunk")).alias("payload"), lineage.alias("lineage"), F.col("n").cast("bigint").alias("pos"))


def backtranslation_plan(documents: DataFrame, budget: int | None, least: int = 50, most: int = 4000, seed: int | None = None) -> DataFrame:
    """documents (id, text, pos) within the length bounds after normalising, all of them without a budget; seed shuffles them by a hash of their id,
    the same in every run and on every cluster."""
    rows = documents.withColumn("text", T.normalize_text(F.col("text"))).filter(F.length("text").between(least, most))
    order = ["pos", "id"] if seed is None else ["_draw", "id"]
    if seed is not None:
        rows = rows.withColumn("_draw", F.xxhash64(F.lit(seed), F.col("id")))
    rows = _numbered(rows, order, budget)
    lineage = F.create_map(F.lit("source"), F.lit("document"), F.lit("source_id"), F.col("id"))
    return rows.select(T.derive_id(F.lit("bt"), F.col("id"), F.col("n"), F.length("text")).alias("id"), F.lit("instruction_backtranslation").alias("strategy"), F.to_json(F.struct("text")).alias("payload"), lineage.alias("lineage"), F.col("n").cast("bigint").alias("pos"))


def _driver_id(*parts: object) -> str:
    import hashlib

    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def _frame(spark: SparkSession, specs: Iterable[tuple[str, str, dict, dict]]) -> DataFrame:
    rows = [(i, s, json.dumps(p, ensure_ascii=False), {k: str(v) for k, v in lineage.items()}, n) for n, (i, s, p, lineage) in enumerate(specs)]
    return spark.createDataFrame(rows, SPEC)


def seed_draws(count: int, seeds: int, crossover: float, mutate: float, values: list[int], seed: int) -> Iterator[tuple[str, list[int]]]:
    """Per spec the operator and the indices drawn for it: a seed, then another one for a crossover, or one of the
    mutations. values has one entry per mutation: of how many values it has, of which a hash of the place picks one
    later. The draws follow the standard generator in this order, which makes ids repeatable."""
    draw = random.Random(seed + int(_driver_id("rng", "seed_driven"), 16) % 10007)
    scale = max(1.0, crossover + mutate)
    edges = (crossover / scale, (crossover + mutate) / scale)
    for _ in range(count):
        at = draw.random()
        op = "crossover" if at < edges[0] else "mutate" if mutate > 0 and at < edges[1] else "fewshot"
        limits = [seeds] + {"crossover": [seeds], "mutate": [len(values)] if values else []}.get(op, [])
        yield op, [draw.randrange(limit) for limit in limits]


def seed_plan(spark: SparkSession, seeds: list[dict], budget: int, crossover: float = 0.0, mutate: float = 0.0, mutations: list[dict] | None = None, seed: int = 0) -> DataFrame:
    """seeds {id, instruction, output}: each spec has an operator and one or two seeds, or a mutation {name, prompt,
    values}, whose prompt's {value} becomes one of its values. Shares above 1 together are scaled."""
    if not seeds:
        raise PlanError("no seeds")
    known = mutations or []

    def spec(n: int, op: str, drawn: list[int]) -> tuple[str, str, dict, dict]:
        first, more = seeds[drawn[0]], drawn[1:]
        second = seeds[more[0]] if op == "crossover" else None
        change = known[more[0]] if op == "mutate" and more else None
        made = _driver_id("seed", first["id"], op, n)
        values = (change or {}).get("values") or []
        payload = {"a": first, "b": second, "op": op, "mutation": change, "n": n, "value": str(values[int(made, 16) % len(values)]) if values else ""}
        named = {"seed_id_b": second and second["id"], "mutation": change and change.get("name")}
        return made, "seed_driven", payload, {"source": "seed", "seed_id": first["id"], "operator": op} | {k: v for k, v in named.items() if v is not None}

    draws = seed_draws(budget, len(seeds), crossover, mutate, [len(m.get("values") or []) for m in known], seed)
    return _frame(spark, (spec(n, op, drawn) for n, (op, drawn) in enumerate(draws)))


#: Names of the depth mutations that are there by default.
DEPTH = ("add_constraint", "deepen", "concretize", "increase_reasoning")
BREADTH = {"name": "breadth", "prompt": "a different but related task"}


def evolution_draws(living: int, depth_rate: float, mutations: int, draw: random.Random) -> list[tuple[int | None, bool]]:
    """For each living entry of a round: the depth mutation it gets, if any, and whether it is entered once more."""
    return [(draw.randrange(mutations) if draw.random() < depth_rate else None, draw.random() < 0.5) for _ in range(living)]


def evol_plan(spark: SparkSession, seeds: list[dict], budget: int, rounds: int = 3, depth_rate: float = 0.7, branches: int = 1, mutations: list[dict] | None = None, include_seeds: bool = False, seed: int = 0, answers: bool = True) -> DataFrame:
    """Rounds of evolution over seeds {id, instruction}: an entry of a round gives a deeper task, if one is drawn, and
    branches broader ones. These tasks, and entries drawn to stay, are the slots by which a round's tasks are numbered; the
    slots that stem from a task are the next round's entries (all entries stay where there is none). Ends after the round
    in which budget * rounds tasks are reached. Seeds themselves are round 0 if wanted. answers: have the result answered."""
    if not seeds:
        raise PlanError("no seeds")
    draw, deeper = random.Random(seed + 7), mutations or [{"name": n, "prompt": n} for n in DEPTH]
    breadth = [BREADTH] * max(0, branches)

    def spec(source: dict, level: int, slot: int, change: dict | None) -> tuple[str, str, dict, dict]:
        payload = {"instruction": source["instruction"], "round": level, "mutation": change, "seed_id": source["id"], "chain": [source["instruction"]], "answer": answers or not level}
        return _driver_id("evol", source["id"], f"r{level}", slot), "evol_instruct", payload, {"source": "seed", "seed_id": source["id"], "evolution_round": level} | ({"mutation": change["name"]} if change else {})

    specs = [spec(s, 0, 0, None) for s in seeds] if include_seeds else []
    made, entries = 0, [(s, False) for s in seeds]
    for level in range(1, rounds + 1):
        drawn = evolution_draws(len(entries), depth_rate, len(deeper), draw)
        tasks = [([deeper[at]] if at is not None else []) + breadth for at, _ in drawn]
        starts = accumulate((len(t) + stays for t, (_, stays) in zip(tasks, drawn)), initial=0)
        specs += [spec(source, level, start + k, change) for (source, _), changes, start in zip(entries, tasks, starts) for k, change in enumerate(changes)]
        made += sum(map(len, tasks))
        slots = [slot for (source, evolved), t, (_, stays) in zip(entries, tasks, drawn) for slot in [(source, True)] * len(t) + [(source, evolved)] * stays]
        entries = [slot for slot in slots if slot[1]] or entries
        if made >= budget * rounds:
            break
    return _frame(spark, specs)


PLANNERS: dict[str, Callable[..., DataFrame]] = {
    "topic_driven": topic_plan, "deep_thinking": lambda *a, **k: topic_plan(*a, **k | {"strategy": "deep_thinking"}), "seed_driven": seed_plan, "evol_instruct": evol_plan,
    "document_qa": document_plan, "instruction_backtranslation": backtranslation_plan, "tool_call": tool_plan,
}
