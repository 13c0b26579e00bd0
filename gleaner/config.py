"""Configuration: defaults, closed sections, checks. A config is a dict read from YAML (if available) or JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from difflib import get_close_matches
from typing import Any

from gleaner.operators.judge import AGGREGATIONS
from gleaner.operators.render import FORMATS
from gleaner.operators.stages import REGISTRY
from gleaner.plans.planners import PLANNERS, PlanError, allocate


class ConfigError(ValueError):
    """The configuration can't be used."""


#: Section to its fields and defaults; a field that isn't listed is an error.
DEFAULTS: dict[str, dict[str, Any]] = {
    "llm": {"model": None, "api_key": None, "base_url": None, "lang": "en", "concurrency": 1, "params": {}, "retry": {}, "breaker": {}},
    "retry": {"attempts": 3, "backoff": 2.0, "max_delay": 30.0},
    "breaker": {"window": 50.0, "max_retry_ratio": 0.9},
    "embedding": {"model": "text-embedding-v3", "api_key": None, "base_url": None, "batch_size": 32},
    "run": {"seed": None, "preview_count": 8},
    "plan": {"count": None},
    "judge": {"dimensions": [], "min_total": 0.0, "endpoint": None, "judges": [], "aggregation": "mean", "min_judges": 1, "max_disagreement": 0.0, "scorers": [], "perplexity": None},
    "output": {"path": None, "format": None, "thinking": False, "cache_cleanup": True, "storage": {}},
}
STORAGE = {"type": "state", "table": "samples", "export_format": "parquet"}
LISTS = ("strategies", "stages")
#: Other names under which a list may be given.
ALIASES = {"pipeline": "stages"}
#: Fields of strategies, with their defaults; what isn't listed is an error.
STRATEGIES: dict[str, dict[str, Any]] = {
    "topic_driven": {"topics": [], "dimensions": [], "multi_turn": None, "require_reasoning": False}, "deep_thinking": {"topics": [], "dimensions": [], "multi_turn": None, "require_reasoning": True},
    "seed_driven": {"seed_file": None, "field_map": {}, "example_num": 3, "topic": None, "evolution": {}},
    "evol_instruct": {"seed_file": None, "field_map": {}, "max_rounds": 3, "depth_rate": 0.7, "branch_factor": 1, "depth_mutations": None, "ratio_bounds": [0.5, 5.0], "generate_output": True, "require_reasoning": False, "include_seeds": False, "phases": {}},
    "document_qa": {"document_file": None, "field_map": {}, "chunking": {}, "max_instruction_length": 500, "max_output_length": 4000, "reject_context_references": True},
    "instruction_backtranslation": {"document_file": None, "field_map": {}, "min_document_length": 50, "max_document_length": 4000, "max_instruction_length": 500, "reject_context_references": True, "shuffle": False, "phases": {}},
    "tool_call": {"tools": [], "topics": ["weather", "travel", "shopping"], "system_prompt": None, "max_tool_calls_per_sample": 2},
}
#: Options of stages under the names a configuration uses.
STAGE_NAMES = {"max_special_char_ratio": "max_special", "max_word_repetition": "max_word", "max_char_repetition": "max_char", "min_ngram_diversity": "min_diversity", "ngram_n": "n", "num_perm": "permutations"}


@dataclass(frozen=True)
class Issue:
    level: str
    message: str


def load_env(path: str) -> None:
    """KEY=VALUE lines into the environment; what is set stays."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                key, mark, value = line.strip().partition("=")
                if mark and key and not key.startswith("#"):
                    os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


def load(path: str) -> dict[str, Any]:
    """The file with defaults filled in. Unknown sections and fields: ConfigError."""
    load_env(os.path.join(os.path.dirname(os.path.abspath(path)), ".env"))
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    return complete(data or {})


def _closed(where: str, given: dict[str, Any], known: dict[str, Any]) -> dict[str, Any]:
    """given over the defaults; a field that isn't known is an error that names the likeliest one meant."""
    for field in given:
        if field not in known:
            near = get_close_matches(field, known, 1, 0.5)
            raise ConfigError(f"unknown field {field!r} in {where}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return known | given


def complete(data: dict[str, Any]) -> dict[str, Any]:
    """data with defaults filled in; unknown sections and fields are errors."""
    if not isinstance(data, dict):
        raise ConfigError("a configuration is a mapping of sections")
    data = {ALIASES.get(k, k): v for k, v in data.items()}
    sections = set(DEFAULTS) - {"retry", "breaker"}
    _closed("the configuration", data, dict.fromkeys([*sections, *LISTS, "endpoints"]))
    out = {name: _closed(name, data.get(name) or {}, DEFAULTS[name]) for name in sorted(sections)}
    out["output"]["storage"] = _closed("output.storage", out["output"]["storage"] or {}, STORAGE)
    out["endpoints"] = {k: endpoint(out["llm"], v or {}) for k, v in (data.get("endpoints") or {}).items()}
    out["llm"] = endpoint({}, out["llm"])
    for name in LISTS:
        out[name] = [{"type": x} if isinstance(x, str) else dict(x) for x in data.get(name) or []]
    common = {"type": None, "weight": 1.0, "count": None}
    out["strategies"] = [_closed(f"strategy {x.get('type')}", x, common | STRATEGIES[x["type"]]) if x.get("type") in STRATEGIES else x for x in out["strategies"]]
    return out


def stage_options(stage: dict[str, Any]) -> dict[str, Any]:
    """A stage's options under the names its factory has."""
    return {STAGE_NAMES.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in stage.items() if k != "type"}


def endpoint(parent: dict[str, Any], own: dict[str, Any]) -> dict[str, Any]:
    """An endpoint's fields: its own, its parent's, the defaults; model, url and key also from the environment."""
    out = DEFAULTS["llm"] | {k: v for k, v in parent.items() if v is not None} | {k: v for k, v in own.items() if v is not None}
    for field, variable in (("model", "LLM_MODEL"), ("base_url", "LLM_BASE_URL"), ("api_key", "LLM_API_KEY")):
        out[field] = out[field] or os.environ.get(variable)
    return out | {"retry": DEFAULTS["retry"] | out["retry"], "breaker": DEFAULTS["breaker"] | out["breaker"]}


def check(cfg: dict[str, Any], command: str, count: int | None = None, input_path: str | None = None) -> list[Issue]:
    """Errors and warnings for a command (run, clean, score)."""
    out: list[Issue] = []
    error = lambda m: out.append(Issue("error", m))
    warn = lambda m: out.append(Issue("warning", m))
    judge, kinds = cfg["judge"], [s.get("type") for s in cfg["stages"]]
    for kind in kinds:
        if kind not in REGISTRY:
            error(f"unknown stage {kind!r}")
    for s in cfg["strategies"]:
        if s.get("type") not in PLANNERS:
            error(f"unknown strategy {s.get('type')!r}")
        for field in ("seed_file", "document_file"):
            if s.get(field) and "://" not in s[field] and not os.path.exists(s[field]):
                error(f"{s['type']}.{field} does not exist: {s[field]}")
    if cfg["output"]["format"] not in (None, *FORMATS):
        error(f"unknown format {cfg['output']['format']!r}")
    if judge["aggregation"] not in AGGREGATIONS:
        error(f"unknown aggregation {judge['aggregation']!r}")
    if input_path and "://" not in input_path and not os.path.exists(input_path):
        error(f"input does not exist: {input_path}")
    if command == "run":
        if not cfg["strategies"]:
            error("run needs strategies")
        else:
            try:
                allocate(cfg["strategies"], count if count is not None else cfg["plan"]["count"])
            except PlanError as e:
                error(str(e))
            weights = sum(max(float(s.get("weight", 1.0)), 0.0) for s in cfg["strategies"])
            if abs(weights - 1.0) > 1e-9:
                warn(f"weights of strategies add up to {weights:.3f}; they are scaled")
        for s in cfg["strategies"]:
            shares = (s.get("evolution") or {}).get("crossover", 0.0) + (s.get("evolution") or {}).get("mutate", 0.0)
            if shares > 1.0:
                warn(f"{s['type']}: crossover and mutate add up to {shares:.2f}; they are scaled")
    if command == "score" and not judge["dimensions"] and not judge["scorers"] and not judge["perplexity"]:
        error("score needs judge.dimensions or judge.scorers")
    if cfg["output"]["path"] is None:
        error("output.path is missing")
    if command in ("run", "clean") and not kinds:
        warn("no stages: nothing is cleaned")
    meets = [getattr(REGISTRY.get(k), "__name__", "") not in ("length_gate", "stats_gate") for k in kinds]
    if any(a and not b for a, b in zip(meets, meets[1:])):
        warn("a stage that looks at single rows stands behind one that compares rows; it saves less there")
    if {"semantic_dedup", "cluster_dedup"} & set(kinds) and not (cfg["embedding"]["base_url"] or os.environ.get("EMBEDDING_BASE_URL")):
        warn("semantic_dedup and cluster_dedup need an embedding endpoint (embedding.base_url or EMBEDDING_BASE_URL)")
    names = [d.get("name") for d in judge["dimensions"]]
    if len(set(names)) < len(names):
        warn("judge.dimensions repeats a name")
    if (judge["judges"] or judge["endpoint"]) and not names:
        warn("judges without judge.dimensions are not asked")
    most = sum(float(d.get("max", 10.0)) for d in judge["dimensions"])
    if most > 0 and judge["min_total"] > 0 and not 0.3 <= judge["min_total"] / most <= 1.0:
        warn(f"min_total is {judge['min_total'] / most:.2f} of the highest total, outside 0.3 to 1.0")
    for s in judge["scorers"]:
        for d in s.get("dimensions") or []:
            if d not in names:
                warn(f"scorer dimension {d!r} is not declared and counts for nothing")
    if judge["max_disagreement"] and len(judge["judges"]) < 2:
        warn("max_disagreement needs several judges")
    for j in judge["judges"]:
        name = j.get("endpoint", "llm") if isinstance(j, dict) else j
        if name != "llm" and name not in cfg["endpoints"]:
            error(f"unknown endpoint {name!r}")
    return out
