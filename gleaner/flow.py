"""The three flows a configuration describes: run (materials, plans, a model, stages, judge, output), clean and score (files
instead of generation). Each writes its state in batches of a run number of its own, so a run that is started again never
replaces rows of an earlier one, and what was paid for is written before it is read twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as T
from gleaner.operators import embedding, render, report, scoring, stages
from gleaner.operators.model import METRICS, as_json, core_text, from_json
from gleaner.operators.state import State
from gleaner.plans import generate, planners
from gleaner.session import cut
from gleaner.sources import readers

#: What calls a model: endpoint settings and parameters to a client's factory.
Chats = Callable[[dict, dict], Callable[[], generate.Chat]]
MATERIALS = {"topic_driven": "topics", "deep_thinking": "topics", "seed_driven": "seeds", "evol_instruct": "seeds", "document_qa": "documents", "instruction_backtranslation": "documents", "tool_call": "tools"}


def http_chats(settings: dict, params: dict) -> Callable[[], generate.Chat]:
    return generate.http_chat(settings["base_url"] or "https://api.openai.com/v1", settings["model"], settings["api_key"] or "", params)


def double_chats(settings: dict, params: dict) -> Callable[[], generate.Chat]:
    return generate.double_chat


@dataclass
class Report:
    """Rows of the waterfall, buckets of scores and costs of a run."""

    rows: list[tuple[str, str, int]] = field(default_factory=list)
    buckets: list[tuple[int, int, float]] = field(default_factory=list)
    calls: int = 0
    retried: int = 0
    embedded: int = 0
    cached: int = 0

    def text(self) -> str:
        return report.text_report(self.rows, self.buckets, report.cost(self.calls, self.retried, self.embedded, self.cached))


def material(spark: SparkSession, strategy: dict):
    """What a strategy makes its specs from: seeds and documents as tables, topics and tools as lists."""
    kind = MATERIALS.get(strategy["type"])
    if kind == "topics":
        return [t if isinstance(t, dict) else {"topic": t} for t in strategy["topics"]]
    if kind == "seeds":
        return readers.load_seeds(spark, strategy["seed_file"], strategy["field_map"])
    if kind == "documents":
        return readers.load_documents(spark, strategy["document_file"], strategy["field_map"])
    if kind == "tools":
        return readers.load_tools(strategy["tools"])
    raise ValueError(f"no material for strategy {strategy['type']!r}")


def planned(spark: SparkSession, strategy: dict, budget: int, seed: int | None) -> DataFrame:
    """The specs of one strategy."""
    kind, source = strategy["type"], material(spark, strategy)
    if kind in ("topic_driven", "deep_thinking"):
        values = {d["name"]: list(d.get("values") or []) for d in strategy["dimensions"]}
        return planners.topic_plan(spark, [t["topic"] for t in source], values, budget, kind)
    if kind == "tool_call":
        return planners.tool_plan(spark, strategy["topics"], budget)
    if kind == "document_qa":
        c = strategy["chunking"]
        mode = c.get("mode", "structure") if c.get("enabled") else None
        return planners.document_plan(source, budget, mode, c.get("min_chunk_length", 200), c.get("max_chunk_length", 1500), c.get("similarity_threshold", 0.55))
    if kind == "instruction_backtranslation":
        return planners.backtranslation_plan(source, budget, strategy["min_document_length"], strategy["max_document_length"], (seed or 0) if strategy["shuffle"] else None)
    # Seeds are examples that a person chose; the specs drawn from them are bounded by the budget.
    seeds = [r.asDict() for r in source.orderBy("pos").select("id", F.coalesce("instruction", F.lit("")).alias("instruction"), "output").collect()]
    if kind == "seed_driven":
        evolution = strategy["evolution"]
        return planners.seed_plan(spark, seeds, budget, evolution.get("crossover", 0.0), evolution.get("mutate", 0.0), evolution.get("mutations"), seed or 0)
    return planners.evol_plan(spark, seeds, budget, strategy["max_rounds"], strategy["depth_rate"], strategy["branch_factor"], strategy["depth_mutations"], strategy["include_seeds"], seed or 0, strategy["generate_output"])


def call_options(settings: dict) -> dict:
    """Options of execute() that an endpoint's settings stand for."""
    again, guard = settings["retry"], settings["breaker"]
    return {"attempts": again["attempts"], "backoff": again["backoff"], "max_delay": again["max_delay"], "concurrency": settings["concurrency"], "breaker": {"window": guard["window"], "max_retry_ratio": guard["max_retry_ratio"]}, "endpoint": settings["model"]}


def generated(specs: DataFrame, strategy: dict, llm: dict, chats: Chats) -> tuple[DataFrame, DataFrame]:
    """Samples with drop_code, and the executed specs, which are written."""
    kind = strategy["type"]
    ratio = tuple(strategy.get("ratio_bounds") or (0.5, 5.0))
    done = cut(generate.execute_strategy(specs, kind, lambda params: chats(llm, params), llm["params"], strategy.get("phases"), ratio, **call_options(llm)))
    options = {"max_instruction": strategy.get("max_instruction_length"), "max_output": strategy.get("max_output_length"), "reject_references": strategy.get("reject_context_references"), "require_reasoning": strategy.get("require_reasoning"), "tools": strategy.get("tools"), "system_prompt": strategy.get("system_prompt")}
    return generate.collect_samples(done, kind, ratio=ratio, **{k: v for k, v in options.items() if v is not None}), done


def build_stages(cfg: dict, vectors=stages.stand_in_vectors, history: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """The configured stages in order. history (hash) are fingerprints accepted by earlier runs."""
    made = []
    for s in cfg["stages"]:
        options = config.stage_options(s)
        if s["type"] in ("semantic_dedup", "cluster_dedup"):
            options["vectors"] = vectors
        if s["type"] == "exact_dedup" and history is not None:
            options["history"] = history
        made.append(stages.REGISTRY[s["type"]](**options))
    return stages.pipeline(*made)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The samples of all strategies in one order: by turns, the first of each, then the second of each."""
    turns = [p.withColumn("pos", F.col("pos") * len(parts) + k) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, turns)


class _Flow:
    def __init__(self, spark: SparkSession, cfg: dict, path: str | None, chats: Chats, embed: Callable[[], embedding.Embed] | None, complete, preview: bool = False):
        self.spark, self.cfg, self.chats, self.embed, self.complete, self.preview = spark, cfg, chats, embed, complete, preview
        self.out = render.layout(path or cfg["output"]["path"], cfg["output"]["storage"])
        self.state = State(spark, self.out["state"]) if self.out["state"] and not preview else None
        self.report = Report()
        self.format = render.derive_format([s["type"] for s in cfg["strategies"]], cfg["output"]["format"])

    def read(self, name: str) -> DataFrame | None:
        return self.state.read(name) if self.state else None

    def save(self, name: str):
        return (lambda rows: self.state.add(name, rows)) if self.state else None

    def vectors(self):
        """The embedder with the state's cache. It counts as a call what it adds to the cache."""
        if not {"semantic_dedup", "cluster_dedup"} & {s["type"] for s in self.cfg["stages"]}:
            return stages.stand_in_vectors
        keep = self.save("embeddings")

        def save(rows: DataFrame) -> None:
            self.report.embedded += rows.count()
            if keep:
                keep(rows)

        return embedding.from_config(self.cfg["embedding"], self.read("embeddings"), save, self.embed)

    def drop(self, rows: DataFrame, stage: str, reason: str = "drop_code") -> None:
        """Write rows (id, strategy, reason) as dropped and count them."""
        rows = rows.select("id", F.coalesce("strategy", F.lit("")).alias("strategy"), (F.col(stage) if stage in rows.columns else F.lit(stage)).alias("stage"), F.col(reason).alias("reason"))
        rows = cut(rows)
        if self.state:
            self.state.add("dropped", rows)
        self.report.rows += [(r.stage, r.reason, r.n) for r in rows.groupBy("stage", "reason").agg(F.count("*").alias("n")).collect()]

    def cleaned(self, samples: DataFrame) -> DataFrame:
        """What the stages keep; fingerprints of it join those of earlier runs."""
        prints = self.read("fingerprints")
        kept, dropped = stages.split(build_stages(self.cfg, self.vectors(), prints)(samples))
        self.drop(dropped, "drop_stage")
        if self.state and "exact_dedup" in {s["type"] for s in self.cfg["stages"]}:
            self.state.add("fingerprints", kept.select(T.fingerprint(core_text(kept)).alias("hash"), F.col("id").alias("sample_id")))
        if "stats" in {s["type"] for s in self.cfg["stages"]}:
            options = next(config.stage_options(s) for s in self.cfg["stages"] if s["type"] == "stats")
            return stages.with_metrics(kept, options.get("n", 3), options.get("unit", "char"))
        return kept.withColumn("metrics", F.lit(None).cast(METRICS))

    def scored(self, samples: DataFrame, required: bool = False) -> DataFrame:
        """samples with total and scores in their metrics, those that fail a gate dropped. Without anything to score with
        they stay as they are, or ValueError if a score is what is asked for."""
        judge = scoring.build_judge(self.cfg, complete=self.complete)
        if judge is None:
            if required:
                raise ValueError("nothing to score with: declare judge.dimensions or scorers")
            return samples.withColumn("total_score", F.lit(None).cast("double"))
        samples = cut(samples)
        settings = lambda name: self.cfg["llm"] if name == "llm" else self.cfg["endpoints"][name]
        chat = lambda name: {"factory": self.chats(settings(name), settings(name)["params"]), **{k: v for k, v in call_options(settings(name)).items() if k != "endpoint"}}
        cache = self.read("scores")
        verdicts, failures = judge(samples, chat, cache, self.save("scores"), self.cfg["llm"]["lang"])
        verdicts = cut(verdicts)
        if cache is not None and judge.endpoints:
            self.report.cached += samples.join(cache.filter(F.col("endpoint").isin(judge.endpoints)).select("id", "endpoint"), "id").count()
        if failures is not None:
            # An outage of a local scorer is reported, the sample goes on.
            self.report.rows += [("perplexity", r.reason, r.n) for r in failures.groupBy("reason").agg(F.count("*").alias("n")).collect()]
        joined = samples.join(verdicts, "id")
        has = F.size("scores") > 0
        metrics = F.struct(F.col("metrics.special_char_ratio"), F.col("metrics.ngram_diversity"), F.when(has, F.col("scores")).alias("scores"), F.when(has, F.round("total", 3)).alias("total_score"), F.when(has, F.col("score_source")).alias("score_source")).cast(METRICS)
        joined = cut(joined.withColumn("metrics", metrics).withColumn("total_score", F.when(has, F.col("total"))))
        self.drop(joined.filter("drop_code is not null"), "judge")
        kept = joined.filter("drop_code is null").select(*samples.columns, "total_score")
        self.report.buckets = [tuple(r) for r in report.score_distribution(joined, "total").select("bucket", "n", "mean").collect()]
        return kept

    def written(self, samples: DataFrame) -> Report:
        """Render into the state and export it, or append the lines; the report counts what is kept."""
        thinking = self.cfg["output"]["thinking"]
        samples = cut(samples)
        self.report.rows.append(("kept", "", samples.count()))
        if self.preview:
            return self.report
        if self.state is None:
            samples.select(render.rendered(samples, self.format, thinking).alias("value")).write.mode("append").text(self.out["lines"])
            return self.report
        rows = samples.select("id", "strategy", render.payload(samples).alias("payload"), render.rendered(samples, self.format, thinking).alias("rendered"), "total_score", F.current_timestamp().alias("created_at"))
        self.state.add("samples", rows)
        if self.out["export"]:
            (render.write_lines if self.out["export"].endswith(".jsonl") else lambda df, path: render.write_export(render.export_rows(df), path))(self.state.read("samples"), self.out["export"])
        if self.cfg["output"]["cache_cleanup"]:
            self.state.cleanup()  # nothing is pending once samples are committed
        return self.report


def run(spark: SparkSession, cfg: dict, count: int | None = None, only: list[str] | None = None, preview: bool = False, resume: bool = False, discard: bool = False, chats: Chats = http_chats, embed: Callable[[], embedding.Embed] | None = None, complete=None) -> Report:
    """Plan, generate, clean, judge and write. preview takes about preview_count specs and writes nothing. resume leaves
    out specs that were committed or dropped before, and takes up samples that were generated but not yet settled when a
    run ended. discard overrides a state written under other settings."""
    shares = planners.allocate(cfg["strategies"], count if count is not None else cfg["plan"]["count"], only)
    if preview:
        shares = planners.preview(shares, cfg["run"]["preview_count"])
    flow = _Flow(spark, cfg, None, chats, embed, complete, preview)
    by_type = {s["type"]: s for s in cfg["strategies"]}
    if flow.state:
        kinds = {s["type"]: config.stage_options(s) for s in cfg["stages"]}
        settings = {"seed": cfg["run"]["seed"], "minhash": str(kinds.get("minhash_dedup")), "embedding": cfg["embedding"]["model"] if {"semantic_dedup", "cluster_dedup"} & set(kinds) else None}
        flow.state.check_manifest(settings, flow.state.next_batch(), discard)
    waiting = None
    if flow.state and resume:
        pending = flow.state.read("pending")
        waiting = cut(flow.state.open_specs(pending).select(from_json(F.col("sample")).alias("s")).select("s.*"))
    parts = []
    for kind, budget in shares:
        specs = cut(planned(spark, by_type[kind], budget, cfg["run"]["seed"]))
        if flow.state:
            flow.state.add("planned", specs.select("id", "strategy", F.col("payload").alias("spec")))
            if resume:
                left = cut(flow.state.open_specs(specs).join(waiting.select("id"), "id", "left_anti"))
                flow.report.cached += specs.count() - left.count()
                specs = left
        samples, done = generated(specs, by_type[kind], cfg["llm"], chats)
        cost = done.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.greatest(F.col("calls") - 1, F.lit(0))), F.lit(0)).alias("again")).first()
        flow.report.calls += cost.calls
        flow.report.retried += cost.again if kind != "evol_instruct" else 0
        samples = cut(samples)
        flow.drop(samples.filter("drop_code is not null").withColumn("stage", F.lit(kind)), "stage")
        good = samples.filter("drop_code is null").drop("drop_code")
        if flow.state:
            # What a model was paid for waits here until stages and judges have settled it.
            flow.state.add("pending", good.select("id", "strategy", as_json(good).alias("sample")))
        parts.append(good if waiting is None else good.unionByName(waiting.filter(F.col("strategy") == kind).select(*good.columns)))
    return flow.written(flow.scored(flow.cleaned(_merged(parts))))


def clean(spark: SparkSession, cfg: dict, path: str, output: str | None = None, fmt: str = "flat", field_map: dict[str, str] | None = None, embed: Callable[[], embedding.Embed] | None = None) -> Report:
    """The stages over a file."""
    flow = _Flow(spark, cfg, output, http_chats, embed, None)
    samples = readers.open_file(spark, path, fmt, field_map, strict=True).drop("problems")
    return flow.written(flow.cleaned(samples).withColumn("total_score", F.lit(None).cast("double")))


def score(spark: SparkSession, cfg: dict, path: str, output: str | None = None, fmt: str = "flat", field_map: dict[str, str] | None = None, chats: Chats = http_chats, complete=None) -> Report:
    """The judge over a file."""
    flow = _Flow(spark, cfg, output, chats, None, complete)
    samples = readers.open_file(spark, path, fmt, field_map, strict=True).drop("problems").withColumn("metrics", F.lit(None).cast(METRICS))
    return flow.written(flow.scored(samples, required=True))
