import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.operators import judge, render, report, stages
from gleaner.operators.greedy import first_wins
from gleaner.operators.model import as_samples, validated
from gleaner.operators.state import IncompatibleState, State
from gleaner.plans import generate, planners
from gleaner.sources import readers


def samples(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, id string, instruction string, output string")
    return as_samples(df.withColumn("strategy", F.lit("s")), **{c: F.col(c) for c in ("id", "strategy", "instruction", "output", "pos")})


def test_length_bounds(spark):
    df = samples(spark, [("a", "1234", "x" * 9), ("b", "12345", "x" * 9), ("c", "1" * 11, "x" * 9), ("d", "12345", "x"), ("e", None, None)])
    got = {r.id: r.drop_code for r in stages.length_gate((5, 10), (2, 20))(df).collect()}
    assert got == {"a": "instruction_len", "b": None, "c": "instruction_len", "d": "output_len", "e": "instruction_len"}


def test_exact_dedup_keeps_first_and_history(spark):
    df = samples(spark, [("a", "i", "o"), ("b", "i", "o"), ("c", "i", "p"), ("d", None, None), ("e", "", "")])
    got = {r.id: (r.drop_code, r.drop_by) for r in stages.exact_dedup()(df).collect()}
    assert got == {"a": (None, None), "b": ("duplicate", "a"), "c": (None, None), "d": (None, None), "e": ("duplicate", "d")}
    assert stages.exact_dedup()(df.filter("false")).count() == 0


def test_pipeline_keeps_first_reason(spark):
    df = samples(spark, [("a", "hello there", "x" * 40), ("b", "hello there", "hello world this is fine text"), ("c", "hello there", "hello world this is fine text"), ("d", "h", "y")])
    out = stages.pipeline(stages.length_gate(), stages.stats_gate(), stages.exact_dedup())(df)
    assert {r.id: r.drop_stage for r in out.collect()} == {"a": "stats", "b": None, "c": "exact_dedup", "d": "length"}
    assert {(r.stage, r.n) for r in report.waterfall(out).collect()} == {("stats", 1), ("exact_dedup", 1), ("length", 1), ("kept", 1)}


@pytest.mark.parametrize("group", [2, 64])
def test_first_wins_equals_sequential(spark, group):
    r = random.Random(3)
    points = [(i, r.randrange(60)) for i in range(120)]
    keys = lambda x: [x // 5 - 1, x // 5, x // 5 + 1]
    df = spark.createDataFrame([(i, i, keys(x), x) for i, x in points], "id long, at long, keys array<bigint>, what long")
    got = {r.id for r in first_wins(df, lambda a, b: F.abs(a - b) <= 3, group).filter("kept").collect()}
    kept = []
    for i, x in points:
        if all(abs(x - points[j][1]) > 3 for j in kept):
            kept.append(i)
    assert got == set(kept)


def test_minhash_dedup(spark):
    base = " ".join(f"w{(7 * i * i) % 97}" for i in range(60))
    df = samples(spark, [("a", "q", base), ("b", "q", base + " tail"), ("c", "q", " ".join(f"z{i}" for i in range(60))), ("d", "q", base)])
    got = {r.id: r.drop_by for r in stages.minhash_dedup()(df).collect()}
    assert got["a"] is None and got["c"] is None and got["b"] == "a" and got["d"] == "a"


@pytest.mark.parametrize("common", [0, 60])
def test_minhash_dedup_equals_brute_force(spark, common):
    """Pairs between 0.80 and 0.90; with common words before every text, most shingles of a set are heavy."""
    r, head = random.Random(8), " ".join(f"c{i}" for i in range(common))
    texts = []
    for i in range(80):
        words = [f"w{i}_{k}" for k in range(120 if not common else 8)]
        texts += [words] + [[*words[: len(words) - k], *(f"v{i}_{j}_{k}" for j in range(k))] for k in (r.randrange(8, 16), r.randrange(3, 8))]
    r.shuffle(texts)
    df = samples(spark, [(str(i), "q", f"{head} {' '.join(t)}") for i, t in enumerate(texts)])
    sets = []
    for t in texts:
        w = ["q", *head.split(), *t]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8
    want, kept = {}, []
    for i, s in enumerate(sets):
        want[str(i)] = next((str(j) for j in kept if alike(s, sets[j])), None)
        kept += [i] if want[str(i)] is None else []
    got = {x.id: x.drop_by for x in stages.minhash_dedup()(df).collect()}
    assert got == want and sum(x is not None for x in want.values()) > 20


def test_semantic_and_cluster_dedup(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.99, 0.01]), (2, [0.0, 1.0]), (3, None)]
    df = spark.createDataFrame([(i, i, v) for i, v in rows], "id long, at long, vec array<double>")
    assert {r.id for r in stages.semantic_kept(df, 0.9).filter("kept").collect()} == {0, 2, 3}
    assert {r.id for r in stages.cluster_kept(df, 0.9).filter("kept").collect()} >= {0, 2, 3}


def test_band_shape():
    assert stages.band_shape(0.7, 128) == (14, 9) and stages.band_shape(0.5, 128) == (25, 5)


def test_judge(spark):
    scores = spark.createDataFrame([("s", "a", "x", 8.0), ("s", "b", "x", 4.0), ("s", "a", "y", 6.0), ("s", "b", "y", 8.0), ("t", "a", "x", 2.0), ("t", "b", "x", 8.0)], "sample_id string, endpoint string, dim string, value double")
    ids = spark.createDataFrame([("s",), ("t",), ("u",)], "id string")
    got = {r.id: r for r in judge.judged(ids, scores, {"x": 10, "y": 10}, min_judges=2, max_disagreement=5).collect()}
    assert got["s"].total == 13 and got["s"].scores == {"x": 6.0, "y": 7.0} and got["s"].drop_code is None
    assert got["t"].drop_code == "judge_disagreement" and got["u"].drop_code == "insufficient_judges"


def test_render_thinking(spark):
    df = samples(spark, [("a", "i", "o")]).withColumn("reasoning", F.lit("r"))
    assert render.chatml(df, thinking=True).first().messages[1].content == "<think>\nr\n</think>\n\no"
    with pytest.raises(ValueError):
        render.render(df, "other")


def test_validation(spark):
    df = samples(spark, [("a", "i", "o"), ("", "i", "o"), ("c", None, None)])
    assert [r.problems for r in validated(df).orderBy("pos").collect()] == [[], ["C1"], ["C3"]]
    with pytest.raises(Exception):
        validated(df, strict=True).collect()


def test_allocate_and_preview():
    assert planners.allocate([{"type": "a", "weight": 2}, {"type": "b"}], 9) == [("a", 6), ("b", 3)]
    assert planners.allocate([{"type": "a", "count": 4}, {"type": "b"}], 10) == [("a", 4), ("b", 6)]
    with pytest.raises(planners.PlanError):
        planners.allocate([{"type": "a", "count": 4}], 3)
    assert sum(n for _, n in planners.preview([("a", 90), ("b", 1)], 8)) == 8


@pytest.mark.parametrize("budget", [1, 7, 23])
def test_plans_are_unique_and_deterministic(spark, budget):
    seeds = [{"id": f"s{i}", "instruction": "x", "output": "y"} for i in range(3)]
    for make in (lambda: planners.topic_plan(spark, ["a", "b"], {"d": ["1", "2", "3"]}, budget), lambda: planners.seed_plan(spark, seeds, budget, 0.4, 0.4), lambda: planners.evol_plan(spark, seeds, budget), lambda: planners.tool_plan(spark, ["a"], budget)):
        first, again = [[r.id for r in make().orderBy("pos").collect()] for _ in range(2)]
        assert first == again and len(set(first)) == len(first)


def test_generation(spark):
    specs = planners.topic_plan(spark, ["a"], {}, 5)
    done = generate.execute(specs, generate.prompt_for("topic_driven"))
    out = generate.collect_samples(done, "topic_driven").collect()
    assert len(out) == 5 and all(r.drop_code is None and r.instruction.startswith("task ") for r in out)


def test_generated_samples_cover_all_documents(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else "a" * (45 + i % 11)) for i in range(2500, 0, -1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [i for i, t in sorted(rows) if t and len(t) >= 50]
    got = catalog.QUERIES["generated_samples"](spark, str(tmp_path)).collect()
    assert len(want) > 1000 and len(got) == len({r.id for r in got}) == len(want) and all(r.drop_code is None for r in got)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("pos"))
    everything, first = [[(r.pos, r.id, r.lineage["source_id"]) for r in planners.backtranslation_plan(docs, n).orderBy("pos").collect()] for n in (None, 600)]
    assert [(n, int(d)) for n, _, d in everything] == list(enumerate(want)) and everything[:600] == first


def test_retry_and_breaker():
    waits, tries = [], []

    def fails():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        generate.retry(fails, generate.backoff_delays(3, 2.0, 3.0), sleep=waits.append)
    assert len(tries) == 3 and waits == [2.0, 3.0]
    b = generate.Breaker()
    for _ in range(5):
        b.record(True)
    with pytest.raises(generate.BreakerOpen):
        b.check()


def test_readers(spark, tmp_path):
    rows = [{"instruction": "i", "output": "o"}, {"query": "q", "response": "r", "id": "x"}, {"instruction": " ", "output": ""}, {"messages": [{"role": "user", "content": "hi"}]}]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = readers.to_samples(readers.read_json_rows(spark, str(path)), "flat").orderBy("pos").collect()
    assert [(r.instruction, r.output) for r in got[:2]] == [("i", "o"), ("q", "r")] and got[1].id == "x" and got[2].messages[0].content == "hi" and len(got) == 3
    share = tmp_path / "s.jsonl"
    share.write_text(json.dumps({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "odd", "value": None}]}))
    got = readers.to_samples(readers.read_json_rows(spark, str(share)), "sharegpt").first()
    assert [(m.role, m.content) for m in got.messages] == [("user", "a"), ("assistant", "b"), ("user", "")]
    seeds = readers.load_seeds(spark, str(path)).collect()
    assert len(seeds) == 4
    with pytest.raises(ValueError):
        readers.load_tools([{"function": {"name": "x"}}])


def test_state(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    one = spark.createDataFrame([("a", "s", "length", "x")], "id string, strategy string, stage string, reason string")
    state.append("dropped", one, 1)
    state.append("dropped", one.withColumn("reason", F.lit("y")), 2)
    state.append("dropped", one.withColumn("reason", F.lit("y")), 2)
    assert [r.reason for r in state.read("dropped").collect()] == ["x"]
    assert state.terminal().count() == 1 and state.read("samples").count() == 0
    state.check_manifest({"seed": 0}, 1)
    with pytest.raises(IncompatibleState):
        state.check_manifest({"seed": None}, 2)
