"""Scorers: judges that prompt a model, and local scorers that need none or only its token probabilities.

Judges give (sample_id, judge, endpoint, scores: map); local scorers give (sample_id, source, priority, weight, dim, value
in [0, 1]). operators.judge turns both into totals and gates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import judge
from gleaner.operators.model import core_text
from gleaner.plans.generate import Chat, execute, http_post, messages
from gleaner.session import cut

SCORES = "map<string,double>"
JUDGED = f"sample_id string, judge int, endpoint string, scores {SCORES}"
LOCAL = "sample_id string, source string, priority int, weight double, dim string, value double"


@dataclass(frozen=True)
class Dimension:
    name: str
    most: float = 10.0
    label: str | None = None


def judge_prompt(df: DataFrame, dimensions: list[Dimension], lang: str = "en") -> Column:
    """The conversation that asks a model to score a sample, as JSON text; messages are quoted turn by turn."""
    scale = "; ".join(f"{d.name} (1..{int(d.most)}, {d.label or d.name})" for d in dimensions)
    said = lambda x: F.coalesce(x, F.lit("None"))
    turns = F.array_join(F.transform(df["messages"], lambda m: F.concat(F.lit("["), said(m["role"]), F.lit("] "), said(m["content"]))), "\n")
    flat = F.concat(F.lit("instruction: "), F.coalesce(df["instruction"], F.lit("")), F.lit("\noutput: "), F.coalesce(df["output"], F.lit("")))
    body = F.when(F.coalesce(F.size(df["messages"]), F.lit(0)) > 0, turns).otherwise(flat)
    only = {"zh": "只用 JSON 回答。"}.get(lang, "Answer in JSON alone.")
    form = {"zh": '回答的格式：{"scores": {"维度": 数}}'}.get(lang, 'Form of the answer: {"scores": {"dimension": number}}')
    ask = F.concat(F.lit(f"Rate this sample, 1 for worst, in each of: {scale}\n\n"), body, F.lit(f"\n\n{form}"))
    return messages(f"You judge the quality of training data strictly. {only}", ask)


def reply_scores(reply: Column, dimensions: list[Dimension]) -> Column:
    """The scores of a JSON reply, each clamped to 1 and its dimension's most; what is missing or no number is left out,
    so a useless reply gives an empty map."""
    value = lambda d: judge.clamp(F.get_json_object(reply, f"$.scores['{d.name}']").try_cast("double"), d.most)
    pairs = F.array(*[F.struct(F.lit(d.name).alias("k"), value(d).alias("v")) for d in dimensions]) if dimensions else F.array().cast("array<struct<k:string,v:double>>")
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def judge_scores(samples: DataFrame, dimensions: list[Dimension], endpoint: str = "llm", factory: Callable[[], Chat] | None = None, number: int = 0, lang: str = "en", cache: DataFrame | None = None, save: Callable[[DataFrame], None] | None = None, **options) -> DataFrame:
    """samples scored by one endpoint. cache (id, endpoint, scores: JSON or map) answers what was scored before, also with
    an empty result. save gets the new (id, endpoint, scores: JSON, total), empty ones too, but not failed calls."""
    wanted = samples
    known = None
    if cache is not None:
        mine = cache.filter(F.col("endpoint") == endpoint)
        mine = mine.withColumn("scores", F.from_json("scores", SCORES)) if dict(mine.dtypes)["scores"] == "string" else mine
        mine = mine.groupBy("id").agg(F.first("scores").alias("scores"))
        known = samples.select("id").join(mine, "id")
        wanted = samples.join(mine.select("id"), "id", "left_anti")
    asked = wanted.select("id", judge_prompt(wanted, dimensions, lang).alias("prompt"))
    more = {} if factory is None else {"factory": factory}
    done = cut(execute(asked, F.col("prompt"), endpoint=endpoint, **more, **options).select("id", "error", reply_scores(F.col("reply"), dimensions).alias("scores")))
    # A reply without JSON is a judge's answer without scores; a call that failed is none.
    done = done.withColumn("scores", F.coalesce("scores", F.create_map().cast(SCORES)))
    if save is not None:
        total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda n, v: n + v)
        paid = done.filter(~F.coalesce(F.col("error").startswith("execute_error"), F.lit(False)))
        save(paid.select("id", F.lit(endpoint).alias("endpoint"), F.to_json("scores").alias("scores"), total.alias("total")))
    out = done.select("id", "scores")
    out = out if known is None else out.unionByName(known.select("id", "scores"))
    return out.select(F.col("id").alias("sample_id"), F.lit(number).alias("judge"), F.lit(endpoint).alias("endpoint"), "scores")


def long_scores(judged: DataFrame) -> DataFrame:
    """(sample_id, judge, endpoint, dim, value) of judges' maps."""
    return judged.select("sample_id", "judge", "endpoint", F.explode("scores").alias("dim", "value"))


def _local(rows: DataFrame, source: str, priority: int, weight: float, value: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), v.cast("double").alias("value")) for d, v in value.items()])
    rows = rows.select(F.col("id").alias("sample_id"), F.lit(source).alias("source"), F.lit(priority).alias("priority"), F.lit(float(weight)).alias("weight"), F.inline(cells))
    return rows.filter("value is not null")


def fasttext_predict(model_path: str) -> Callable[[], Callable[[str], float]]:
    """Factory of a predictor: the probability of the likeliest label. Needs the optional package fasttext and a file."""
    if not model_path:
        raise ValueError("the fasttext scorer needs model_path")
    try:
        import fasttext  # noqa: F401
    except ImportError as e:
        raise ImportError("the fasttext scorer needs the package fasttext; install it or take the scorer out") from e

    def factory() -> Callable[[str], float]:
        import fasttext

        model = fasttext.load_model(model_path)
        return lambda line: float((model.predict(line, k=1)[1] or [0.0])[0])

    return factory


def fasttext_scores(samples: DataFrame, predict: Callable[[], Callable[[str], float]], dimensions: list[str] | None = None, priority: int = 0, weight: float = 1.0) -> DataFrame:
    """coherence, fluency and neutral 0.5 for other dimensions, from a classifier's probability; blank texts have none."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = predict()
        for texts in batches:
            yield pd.Series([of(t.replace("\n", " ")) if t.strip() else None for t in texts], dtype=float)

    rows = samples.select("id", core_text(samples).alias("text")).withColumn("p", probability("text"))
    found = T.heuristic_scores(F.col("p"), F.col("text"))
    neutral = F.when(found.isNotNull(), F.lit(0.5))
    return _local(rows, "fasttext", priority, weight, {d: F.coalesce(found[d], neutral) for d in dimensions or ["coherence"]})


Complete = Callable[[dict], dict]


def http_complete(base_url: str, model: str, api_key: str = "", timeout: float = 120.0) -> Callable[[], Complete]:
    """Factory of a client of the common completions interface: request body to response."""
    if not (model and base_url):
        raise ValueError("the perplexity scorer needs a model and a base_url, its own or the language model's")
    return lambda: lambda body: http_post(f"{base_url.rstrip('/')}/completions", {"model": model} | body, api_key, timeout)


def perplexity_request(text: str, mode: str, ratio: float = 0.5, most_tokens: int = 256) -> dict:
    """The request that measures a text: all of it as a prompt whose own probabilities come back (teacher_forced), or its
    beginning, of which the continuation's are taken (continuation)."""
    if mode == "teacher_forced":
        return {"prompt": text, "max_tokens": 1, "echo": False, "logprobs": 1, "prompt_logprobs": 0}
    at = max(16, int(len(text) * ratio))
    rest = len(text[at:])
    return {"prompt": text[:at], "max_tokens": min(most_tokens, max(8, rest // 2 + 8)), "temperature": 0.0, "top_p": 1.0, "logprobs": 0}


def perplexity(samples: DataFrame, complete: Callable[[], Complete], mode: str = "continuation", dimensions: list[str] | None = None, ceiling: float = 6.0, most_chars: int = 4000, ratio: float = 0.5, most_tokens: int = 256, priority: int = 0, weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Local scores from the mean negated log-probability of tokens, and (sample_id, reason) of the calls that failed, as
    scorer_error:Type: a sample whose call failed goes on without this score. most_chars is the scorer's own limit."""
    if mode not in ("teacher_forced", "continuation"):
        raise ValueError(f"perplexity mode must be teacher_forced or continuation, not {mode!r}")

    @F.pandas_udf("struct<payload:string,error:string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = complete()
        for texts in batches:
            out = []
            for t in texts:
                try:
                    out.append((json.dumps(ask(perplexity_request(t[:most_chars], mode, ratio, most_tokens))), None))
                except Exception as error:  # an outage says nothing about the sample
                    out.append((None, f"scorer_error:{type(error).__name__}"))
            yield pd.DataFrame(out, columns=["payload", "error"], dtype=object)

    rows = cut(samples.select("id", call(core_text(samples)).alias("c")).select("id", "c.*"))
    logs = T.parse_prompt_logprobs(F.col("payload"), mode)
    measured = rows.withColumn("nll", T.mean_token_nll(logs)).withColumn("error", F.coalesce("error", F.when(F.col("nll").isNull(), "scorer_error:RuntimeError")))
    quality = T.nll_quality(F.col("nll"), ceiling)
    scores = _local(measured.filter("error is null"), "perplexity", priority, weight, {d: quality for d in dimensions or ["ppl_quality"]})
    return scores, measured.filter("error is not null").select(F.col("id").alias("sample_id"), F.col("error").alias("reason"))


@dataclass(frozen=True)
class Judge:
    """What a configuration asks for: remote endpoints and local scorers, and how they become one verdict."""

    dimensions: list[Dimension]
    endpoints: list[str]
    scorers: list[Callable[[DataFrame, int], tuple[DataFrame, DataFrame | None]]]
    settings: dict

    def __call__(self, samples: DataFrame, chats: Callable[[str], dict], cache: DataFrame | None = None, save: Callable[[DataFrame], None] | None = None, lang: str = "en") -> tuple[DataFrame, DataFrame | None]:
        """(id, scores, total, score_source, drop_code) of all samples, and the failures of local scorers. chats(endpoint)
        gives the options of execute for an endpoint."""
        spark = samples.sparkSession
        # An endpoint that is named twice is asked once and counts twice.
        asked = {e: judge_scores(samples, self.dimensions, e, lang=lang, cache=cache, save=save, **chats(e)) for e in dict.fromkeys(self.endpoints)}
        judged = [asked[e].withColumn("judge", F.lit(k)) for k, e in enumerate(self.endpoints)]
        remote = spark.createDataFrame([], JUDGED)
        for j in judged:
            remote = remote.unionByName(j)
        local, failures = None, None
        for k, scorer in enumerate(self.scorers):
            scores, failed = scorer(samples, k)
            local = scores if local is None else local.unionByName(scores)
            failures = failed if failures is None else failures if failed is None else failures.unionByName(failed)
        dims = {d.name: d.most for d in self.dimensions}
        return judge.judged(samples, long_scores(remote), dims, local=local, remote=bool(self.endpoints), labels=self.labels(), **self.settings), failures

    def labels(self) -> list[str]:
        return [getattr(s, "label", "local") for s in self.scorers]


def build_judge(cfg: dict, predict: Callable[[str], Callable[[], Callable[[str], float]]] = fasttext_predict, complete: Callable[[], Complete] | None = None) -> Judge | None:
    """The judge of a configuration: remote if there are dimensions and an endpoint to ask; None if there is nothing to
    score with. An unknown scorer is a ValueError."""
    own, llm = cfg["judge"], cfg["llm"]
    dimensions = [Dimension(d["name"], float(d.get("max", 10.0)), d.get("label")) for d in own["dimensions"]]
    named = [j.get("endpoint", "llm") if isinstance(j, dict) else j for j in own["judges"]] or [own.get("endpoint") or "llm"]
    endpoints = named if dimensions and (own["judges"] or own.get("endpoint") or llm["model"]) else []
    scorers: list = []

    def add(label: str, run: Callable[[DataFrame, int], tuple[DataFrame, DataFrame | None]]) -> None:
        run.label = label
        scorers.append(run)

    for s in own["scorers"]:
        if s.get("type") != "fasttext":
            raise ValueError(f"unknown scorer {s.get('type')!r}")
        of = predict(s.get("model_path"))
        add("fasttext", lambda df, k, s=s, of=of: (fasttext_scores(df, of, s.get("dimensions"), k, s.get("weight", 1.0)), None))
    if own.get("perplexity"):
        p = own["perplexity"]
        client = complete or http_complete(p.get("base_url") or llm["base_url"], p.get("model") or llm["model"], p.get("api_key") or llm["api_key"] or "")
        named_as = {"nll_ceiling": "ceiling", "max_chars": "most_chars", "target_ratio": "ratio", "max_target_tokens": "most_tokens", "dimensions": "dimensions", "mode": "mode", "weight": "weight"}
        options = {new: p[old] for old, new in named_as.items() if old in p}
        add("perplexity", lambda df, k: perplexity(df, client, priority=k, **options))
    if not endpoints and not scorers:
        return None
    settings = {"how": own["aggregation"], "min_judges": own["min_judges"], "max_disagreement": own["max_disagreement"], "min_total": own["min_total"]}
    return Judge(dimensions, endpoints, scorers, settings)
