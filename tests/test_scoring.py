import pytest
from pyspark.sql import functions as F

from gleaner import cli, config, flow
from gleaner.operators import judge, scoring
from gleaner.operators.model import as_samples
from gleaner.plans import generate

DIMS = [scoring.Dimension("q"), scoring.Dimension("r", 5.0)]


def samples(spark, n=6):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("i").alias("instruction"), F.concat(F.lit("o"), "id").alias("output"))
    return as_samples(df, **{c: F.col(c) for c in ("id", "instruction", "output")}, strategy=F.lit("s"), pos=F.col("id").cast("bigint"))


def test_reply_scores(spark):
    replies = ['{"scores": {"q": 20, "r": 0}}', '{"scores": {"q": "7", "x": 3}}', '{"scores": {"q": "many"}}', '{"scores": 3}', None]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, reply string").orderBy("i").select(scoring.reply_scores(F.col("reply"), DIMS).alias("s")).collect()]
    assert got == [{"q": 10.0, "r": 1.0}, {"q": 7.0}, {}, {}, {}]


def test_empty_answers_are_cached_and_failures_are_not(spark):
    def factory():
        def chat(turns):
            if "o0" in turns[1]["content"]:
                raise OSError("down")
            return "no object" if "o1" in turns[1]["content"] else '{"scores": {"q": 4}}'

        return chat

    saved = []
    rows = scoring.judge_scores(samples(spark, 3), DIMS, factory=factory, save=lambda df: saved.extend(df.collect()), attempts=2, backoff=0.0)
    assert {r.sample_id: r.scores for r in rows.collect()} == {"0": {}, "1": {}, "2": {"q": 4.0}}
    assert {(r.id, r.scores, r.total) for r in saved} == {("1", "{}", 0.0), ("2", '{"q":4.0}', 4.0)}


def test_local_scores_alone_pass_the_gates(spark):
    local = spark.createDataFrame([("0", "ppl", 0, 1.0, "q", 0.8)], scoring.LOCAL)
    got = {r.id: (r.total, r.drop_code, r.score_source) for r in judge.judged(samples(spark, 2), None, {"q": 10.0}, min_judges=1, local=local).collect()}
    assert got == {"0": (8.0, None, "ppl"), "1": (0.0, None, "none")}


def test_undeclared_dimensions_are_no_judgement(spark):
    scores = spark.createDataFrame([("0", 0, "e", "x", 3.0), ("1", 0, "e", "q", 3.0), ("1", 1, "e", "q", 5.0)], "sample_id string, judge int, endpoint string, dim string, value double")
    declared = scores.filter(F.col("dim").isin("q"))
    got = {r.id: (r.total, r.drop_code) for r in judge.judged(samples(spark, 2), declared, {"q": 10.0}, min_judges=2).collect()}
    assert got == {"0": (0.0, "insufficient_judges"), "1": (4.0, None)}


def test_build_judge(monkeypatch):
    empty = config.complete({"output": {"path": "x"}})
    assert scoring.build_judge(empty) is None
    cfg = config.complete({"llm": {"model": "m", "base_url": "http://x"}, "judge": {"dimensions": [{"name": "q"}], "perplexity": {"mode": "teacher_forced"}, "scorers": [{"type": "fasttext", "model_path": "m.bin"}]}})
    made = scoring.build_judge(cfg, predict=lambda path: lambda: lambda line: 0.5)
    assert made.endpoints == ["llm"] and made.labels() == ["fasttext", "perplexity"]
    with pytest.raises(ImportError, match="fasttext"):
        scoring.build_judge(cfg)
    cfg["judge"]["scorers"] = [{"type": "other"}]
    with pytest.raises(ValueError, match="unknown scorer"):
        scoring.build_judge(cfg)


def test_phase_params():
    assert generate.phase_params({"t": 1, "u": 2}, {"answer": {"t": 0}}, "answer") == {"t": 0, "u": 2}
    assert generate.phase_params(None, None, "evolve") == {}


def test_replies_without_json_are_asked_for_again(spark):
    def factory():
        seen = []

        def chat(turns):
            seen.append(1)
            return "nothing" if len(seen) % 2 else '{"a": 1}'

        return chat

    df = spark.createDataFrame([(1,)], "id int")
    got = generate.execute(df, generate.messages("s", F.lit("u")), factory, attempts=3, backoff=0.0).first()
    assert (got.reply, got.error, got.calls) == ('{"a": 1}', None, 2)
    got = generate.execute(df, generate.messages("s", F.lit("u")), lambda: lambda turns: "nothing", attempts=2, backoff=0.0).first()
    assert (got.reply, got.error, got.calls) == (None, "no_json", 2)


def test_open_breaker_ends_the_run(spark, tmp_path, monkeypatch, capsys):
    import json

    path = tmp_path / "c.json"
    path.write_text(json.dumps({"output": {"path": str(tmp_path / "o")}, "llm": {"model": "down", "retry": {"attempts": 40, "backoff": 0.0}, "breaker": {"max_retry_ratio": 0.5}}, "strategies": [{"type": "tool_call", "count": 4, "tools": [{"function": {"name": "f", "parameters": {}}}]}]}))

    def fails(turns):
        raise OSError("down")

    monkeypatch.setattr(flow, "double_chats", lambda settings, params: lambda: fails)
    assert cli.main(["-c", str(path), "--stand-in", "run"], spark) == 3
    assert "breaker" in capsys.readouterr().err
