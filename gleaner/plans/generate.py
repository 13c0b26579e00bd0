"""Execution of task specs by a model, in the workers.

A client is a factory called once per worker partition: factory() gives chat(messages) -> str. Calls of one partition
run on a bounded thread pool, so the calls in flight are partitions x concurrency. Results are paid for, so write them
(checkpoint or table) right after execute() and before anything that reads them twice."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.replies import first_object, trajectory_problem
from gleaner.operators.model import as_samples
from gleaner.session import cut

Chat = Callable[[list[dict]], str]
#: Specs whose calls are under way together in one partition.
BATCH = 8


class BreakerOpen(RuntimeError):
    """Too many retries of late."""


class NoJson(ValueError):
    """A reply holds no JSON object; it is asked for again like after any other failure."""


class Breaker:
    """Opens when, of at least `least` calls in the window, more than the given share were retries. One per endpoint and
    worker process: tasks of one process share it."""

    def __init__(self, window: float = 50.0, max_retry_ratio: float = 0.9, least: int = 5, clock: Callable[[], float] = time.monotonic):
        self.window, self.limit, self.least, self.clock, self.seen = window, max_retry_ratio, least, clock, deque()
        # The threads of a partition share it; retries in the window are counted as calls come and go.
        self.lock, self.retries = Lock(), 0

    def record(self, retry: bool) -> None:
        with self.lock:
            self.seen.append((self.clock(), retry))
            self.retries += retry

    def check(self) -> None:
        with self.lock:
            while self.seen and self.seen[0][0] < self.clock() - self.window:
                self.retries -= self.seen.popleft()[1]
            if len(self.seen) >= self.least and self.retries > self.limit * len(self.seen):
                raise BreakerOpen(f"{self.retries} of {len(self.seen)} calls were retries")


_BREAKERS: dict[str, Breaker] = {}


def breaker_of(endpoint: str | None, settings: dict | None = None) -> Breaker:
    """The breaker that calls to an endpoint share in this process; one of its own without an endpoint."""
    made = lambda: Breaker(**(settings or {}))
    return made() if endpoint is None else _BREAKERS.setdefault(f"{endpoint} {sorted((settings or {}).items())}", made())


def backoff_delays(attempts: int = 3, first: float = 2.0, most: float = 30.0) -> Iterator[float]:
    """The waits between attempts: one fewer than there are attempts, each first times the one before, none over most."""
    return (min(most, first**k) for k in range(1, max(1, attempts)))


def retry(call: Callable[[], str], delays: Iterator[float] | None = None, breaker: Breaker | None = None, sleep: Callable[[float], None] = time.sleep):
    """call(), again after each delay while it fails; the last failure stands. An open breaker ends it at once."""
    waits = iter(backoff_delays() if delays is None else delays)
    again = False
    while True:
        if breaker:
            breaker.check()
            breaker.record(again)
        failure: Exception
        try:
            return call()
        except BreakerOpen:
            raise
        except Exception as error:
            failure = error
        wait = next(waits, None)
        if wait is None:
            raise failure
        sleep(wait)
        again = True


def http_post(url: str, body: dict, api_key: str | None, timeout: float) -> dict:
    """The JSON answer to a JSON request, by the standard library alone."""
    import urllib.request

    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as answer:
        return json.load(answer)


def http_chat(base_url: str, model: str, api_key: str = "", params: dict | None = None, timeout: float = 120.0) -> Callable[[], Chat]:
    """Factory of a client of the common chat completions interface."""

    def chat(turns: list[dict]) -> str:
        said = http_post(f"{base_url.rstrip('/')}/chat/completions", {"model": model, "messages": turns} | (params or {}), api_key, timeout)["choices"][0]["message"]["content"]
        return said if isinstance(said, str) else json.dumps(said)

    return lambda: chat


def double_chat() -> Chat:
    """A deterministic stand-in for a model: every reply is made of a digest of what the user said."""

    def chat(turns: list[dict]) -> str:
        asked = [m["content"] for m in turns if m.get("role") == "user"]
        mark = hashlib.sha256("".join(asked[:1]).encode()).hexdigest()
        if asked and '"scores"' in asked[0]:
            names = re.findall(r"(\S+) \(1\.\.(\d+)", asked[0])
            return json.dumps({"scores": {name: 1 + int(mark[2 * k : 2 * k + 2], 16) % int(most) for k, (name, most) in enumerate(names)}})
        return json.dumps({"instruction": f"task {mark[:8]}", "output": f"answer {mark[8:40]}", "reasoning": f"because {mark[40:48]}"})

    return chat


def execute(specs: DataFrame, prompt: Column, factory: Callable[[], Chat] = double_chat, attempts: int = 3, backoff: float = 2.0, concurrency: int = BATCH, max_delay: float = 30.0, breaker: dict | None = None, endpoint: str | None = None) -> DataFrame:
    """specs with reply (JSON object or null), error (execute_error:Type or null) and calls; the plan order stays in pos. A
    null prompt is not asked. Replies without JSON are asked for again; after the last attempt they are no_json. A breaker
    that opens fails the job."""
    rows = specs.withColumn("_messages", prompt)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, guard = factory(), breaker_of(endpoint, breaker)

        def one(turns: str | None) -> tuple[str | None, str | None, int]:
            if not isinstance(turns, str):
                return None, None, 0
            calls = 0

            def ask() -> dict:
                nonlocal calls
                calls += 1
                found = first_object(chat(json.loads(turns)))
                if found is None:
                    raise NoJson("no JSON object in the reply")
                return found

            try:
                return json.dumps(retry(ask, backoff_delays(attempts, backoff, max_delay), guard), ensure_ascii=False), None, calls
            except BreakerOpen:
                raise
            except NoJson:
                return None, "no_json", calls
            except Exception as error:  # any failure of the model is the spec's reason
                return None, f"execute_error:{type(error).__name__}", calls

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf["_messages"]))
                yield pdf.assign(reply=[g[0] for g in got], error=[g[1] for g in got], calls=[g[2] for g in got])[[*names, "reply", "error", "calls"]]

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{types}, reply string, error string, calls int").drop("_messages")


def messages(system: str, user: Column) -> Column:
    """A system and a user turn as JSON text."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(turn("system", F.lit(system)), turn("user", user)))


#: What each operator of the seed strategy asks for.
SEED_TASKS = {"crossover": "Merge what example 1 asks with how example 2 answers into a new sample.", "fewshot": "Write another sample that could stand among the examples."}


def prompt_for(strategy: str) -> Column:
    """The prompt of a spec, built from its payload."""
    field = lambda path: F.coalesce(F.get_json_object("payload", path), F.lit(""))
    ask = ' Return JSON: {"instruction": "...", "output": "..."}'
    example = lambda k, at: F.concat(F.lit(f"Example {k}:\ninstruction: "), field(f"$.{at}.instruction"), F.lit("\noutput: "), field(f"$.{at}.output"))
    examples = F.when(field("$.b.id") != "", F.concat(example(1, "a"), F.lit("\n\n"), example(2, "b"))).otherwise(example(1, "a"))
    wish = F.when(field("$.mutation.prompt") != "", F.concat(F.lit("\nRequirement: "), F.replace(field("$.mutation.prompt"), F.lit("{value}"), field("$.value")))).otherwise("")
    task = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEED_TASKS.items() for x in kv]), field("$.op")), F.lit(SEED_TASKS["fewshot"]))
    users = {
        "topic_driven": F.concat(F.lit("Topic: "), field("$.topic"), F.lit("\nSlots: "), field("$.dimensions"), F.lit(ask)),
        "deep_thinking": F.concat(F.lit("Reason step by step. Topic: "), field("$.topic"), F.lit("\nSlots: "), field("$.dimensions"), F.lit(ask)),
        "seed_driven": F.concat(examples, F.lit("\n\nTask: "), task, wish, F.lit(f"\n{ask.strip()}")),
        "evol_instruct": F.concat(F.lit("Instruction to evolve: "), field("$.instruction"), F.lit("\nBy ["), field("$.mutation.name"), F.lit("]: "), field("$.mutation.prompt"), F.lit('\nReturn JSON: {"instruction": "..."}')),
        "document_qa": F.concat(F.lit("Source text:\n"), field("$.chunk"), F.lit(ask)),
        "instruction_backtranslation": F.concat(F.lit("Write the instruction that this text answers:\n"), field("$.text"), F.lit(ask)),
        "tool_call": F.concat(F.lit("Write a dialogue with tool calls about "), field("$.topic"), F.lit(' Return JSON: {"messages": [...]}')),
    }
    return messages("You write training data. Return JSON only.", users[strategy])


def phase_params(base: dict | None, phases: dict | None, phase: str) -> dict:
    """The endpoint's parameters with those of a strategy's phase over them."""
    return (base or {}) | ((phases or {}).get(phase) or {})


def execute_strategy(specs: DataFrame, strategy: str, chat: Callable[[dict], Callable[[], Chat]] = lambda params: double_chat, params: dict | None = None, phases: dict | None = None, ratio: tuple[float, float] = (0.5, 5.0), **options) -> DataFrame:
    """execute() by the phases of a strategy; chat(parameters) gives a client's factory. evol_instruct first evolves, then
    has the new instruction answered where the payload says so: reply has the evolved instruction, answer the second reply.
    Each phase's replies are written before the next reads them."""
    first = {"evol_instruct": "evolve", "instruction_backtranslation": "backtranslate"}.get(strategy, "generate")
    done = execute(specs, prompt_for(strategy), chat(phase_params(params, phases, first)), **options)
    if strategy != "evol_instruct":
        return done.withColumn("answer", F.lit(None).cast("string"))
    done = cut(done.withColumnsRenamed({"reply": "_reply", "error": "_error", "calls": "_calls"}))
    evolved = F.get_json_object("_reply", "$.instruction")
    wanted = F.coalesce(F.get_json_object("payload", "$.answer").cast("boolean"), F.lit(False)) & within_ratio(evolved, F.get_json_object("payload", "$.instruction"), ratio)
    asked = F.when(wanted & (evolved != ""), messages("You answer the instruction well. Return JSON: {\"output\": \"...\", \"reasoning\": \"...\"}", evolved))
    answered = execute(done, asked, chat(phase_params(params, phases, "answer")), **options).withColumnsRenamed({"reply": "answer", "error": "_second", "calls": "_more"})
    return answered.withColumns({"reply": F.col("_reply"), "error": F.coalesce("_error", F.when(F.col("_second").startswith("execute_error"), F.col("_second"))), "calls": F.col("_calls") + F.col("_more")}).drop("_reply", "_error", "_calls", "_second", "_more")


def within_ratio(new: Column, old: Column, ratio: tuple[float, float]) -> Column:
    """Whether an evolved instruction keeps to the bounds of length against the old one; true without an old one."""
    before = F.coalesce(old, F.lit(""))
    return (before == "") | (F.length(new) / F.greatest(F.length(before), F.lit(1))).between(*ratio)


def collect_samples(done: DataFrame, strategy: str, max_instruction: int = 500, max_output: int = 4000, ratio: tuple[float, float] = (0.5, 5.0), reject_references: bool = True, require_reasoning: bool = False, tools: list[dict] | None = None, system_prompt: str | None = None) -> DataFrame:
    """Executed specs to samples with drop_code (written first, since replies are paid for): the error, or why the reply is rejected (empty_instruction,
    context_reference, instruction_length, output_length, ratio_bounds, a trajectory problem)."""
    done = cut(done)  # replies are paid for and read twice below
    field = lambda path, of="reply": F.coalesce(F.get_json_object(of, path), F.lit(""))
    instruction, output, reasoning = field("$.instruction"), field("$.output"), field("$.reasoning")
    lineage = F.col("lineage")
    code = F.when(instruction == "", "empty_instruction")
    spoken = F.lit(None)
    if strategy == "instruction_backtranslation":
        output = F.get_json_object("payload", "$.text")
    if strategy == "document_qa":
        lineage = F.map_concat(lineage, F.create_map(F.lit("source_text"), F.coalesce(F.get_json_object("payload", "$.chunk"), F.lit(""))))
    if strategy in ("document_qa", "instruction_backtranslation"):
        code = code.when(F.lit(reject_references) & T.context_reference(instruction), "context_reference").when(F.length(instruction) > max_instruction, "instruction_length")
        if strategy == "document_qa":
            code = code.when(F.length(output) > max_output, "output_length")
    if strategy == "evol_instruct":
        code = code.when(~within_ratio(instruction, F.get_json_object("payload", "$.instruction"), ratio), "ratio_bounds")
        if "answer" in done.columns:
            output = F.when(field("$.output", "answer") != "", field("$.output", "answer")).otherwise(field("$.answer", "answer"))
            reasoning = field("$.reasoning", "answer")
        chain = F.concat(F.coalesce(F.from_json(F.get_json_object("payload", "$.chain"), "array<string>"), F.array().cast("array<string>")), F.array(instruction))
        lineage = F.map_concat(lineage, F.create_map(F.lit("evolution_chain"), F.to_json(chain)))
        if require_reasoning:
            reasoning = F.when(reasoning == "", "(no reasoning returned)").otherwise(reasoning)
    if strategy == "topic_driven" and not require_reasoning:
        reasoning = F.lit("")
    if strategy == "tool_call":
        system, known = system_prompt or "You can call tools.", tools or []

        @F.pandas_udf("struct<messages:string,problem:string>")
        def trajectory(replies: pd.Series) -> pd.DataFrame:
            out = []
            for r in replies:
                said = (json.loads(r).get("messages") if isinstance(r, str) else None) or []
                said = [{"role": "system", "content": system}, *[m for m in said if isinstance(m, dict) and m.get("role") != "system"]]
                out.append((json.dumps(said), trajectory_problem(said, known) if len(said) > 1 else "empty_instruction"))
            return pd.DataFrame(out, columns=["messages", "problem"])

        from gleaner.operators.model import MESSAGE

        done = done.withColumn("_t", trajectory("reply"))
        spoken, code = F.from_json("_t.messages", f"array<{MESSAGE}>"), F.when(F.col("_t.problem").isNotNull(), F.col("_t.problem"))
        instruction = output = reasoning = F.lit(None)
    drop = F.coalesce("error", code)
    out = as_samples(done.withColumn("_drop", drop), id=F.col("id"), strategy=F.col("strategy"), instruction=instruction, output=output, reasoning=reasoning, messages=spoken, tools=F.lit(json.dumps(tools) if tools else None), lineage=lineage, pos=F.col("pos"))
    return out.join(done.select("id", drop.alias("drop_code"), F.col("pos").alias("_pos")), "id").filter("pos <=> _pos").drop("_pos")


def look_up(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answers for all wanted keys, the cached ones reused and each missing one computed once; and the new cache rows,
    which the caller writes before reading them again."""
    missing = wanted.select(*on).distinct().join(cache.select(*on), on, "left_anti")
    new = compute(missing)
    return wanted.join(cache.unionByName(new), on, "left"), new
