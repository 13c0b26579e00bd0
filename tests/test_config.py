import json

import pytest

from gleaner import cli, config, flow


def written(tmp_path, **sections):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(sections))
    return str(path)


def test_defaults_and_unknown_fields(tmp_path, monkeypatch):
    monkeypatch.setenv("LLM_MODEL", "m")
    cfg = config.load(written(tmp_path, output={"path": "x"}, endpoints={"a": {"concurrency": 4}}))
    assert cfg["endpoints"]["a"]["model"] == "m" and cfg["endpoints"]["a"]["concurrency"] == 4 and cfg["llm"]["retry"]["attempts"] == 3
    for bad in ({"nope": {}}, {"run": {"nope": 1}}):
        with pytest.raises(config.ConfigError):
            config.complete(bad)


def test_exit_codes(tmp_path, capsys):
    good = written(tmp_path, output={"path": "x"}, strategies=[{"type": "topic_driven", "weight": 2}, {"type": "tool_call"}])
    assert cli.main(["-c", good, "validate", "--for", "clean"]) == 0
    assert cli.main(["-c", good, "validate"]) == 2
    assert cli.main(["-c", good, "plan", "--count", "9"]) == 0
    assert capsys.readouterr().out.split() == ["topic_driven", "6", "tool_call", "3"]
    assert cli.main(["-c", str(tmp_path / "none.json"), "validate"]) == 2


def lines(folder):
    return [json.loads(x) for f in folder.glob("part*") for x in f.read_text().split("\n") if x]


def test_hints_and_checks():
    with pytest.raises(config.ConfigError, match="did you mean 'dimensions'"):
        config.complete({"judge": {"dimension": []}})
    with pytest.raises(config.ConfigError, match="did you mean 'stages'|stage"):
        config.complete({"stage": []})
    cfg = config.complete({"output": {"path": "x"}, "pipeline": ["minhash_dedup", "length", "semantic_dedup"], "judge": {"dimensions": [{"name": "q"}], "min_total": 20, "scorers": [{"type": "fasttext", "dimensions": ["z"]}], "max_disagreement": 2, "judges": [{"endpoint": "none"}]}})
    found = config.check(cfg, "clean")
    assert [i.message for i in found if i.level == "error"] == ["unknown endpoint 'none'"]
    for part in ("single rows stands behind", "embedding endpoint", "highest total", "'z' is not declared", "several judges"):
        assert any(part in i.message for i in found), part


def test_clean(spark, tmp_path, capsys):
    rows = [{"id": str(i), "instruction": "a question", "output": t} for i, t in enumerate(["a fine answer here", "a fine answer here", "no"])]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    path = written(tmp_path, output={"path": str(tmp_path / "out.jsonl")}, stages=[{"type": "length", "output": [5, 100]}, "exact_dedup"])
    assert cli.main(["-c", path, "clean", str(tmp_path / "in.jsonl")], spark) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["3 in, 1 out", "  exact_dedup duplicate: 1", "  length output_len: 1"]
    assert [x["output"] for x in lines(tmp_path / "out.jsonl")] == ["a fine answer here"]
    assert cli.main(["-c", path, "clean", str(tmp_path / "none.jsonl")], spark) == 4


def test_run_resume_and_export(spark, tmp_path, capsys):
    seeds = tmp_path / "seeds.jsonl"
    seeds.write_text("\n".join(json.dumps({"prompt": f"question {i}", "response": f"answer {i}"}) for i in range(3)))
    path = written(
        tmp_path, output={"path": str(tmp_path / "out")}, llm={"model": "m"}, plan={"count": 12}, stages=["length", "exact_dedup", "stats", "semantic_dedup"],
        strategies=[{"type": "topic_driven", "topics": ["a", "b"], "dimensions": [{"name": "level", "values": ["x", "y"]}], "count": 4}, {"type": "seed_driven", "seed_file": str(seeds), "count": 4, "evolution": {"mutate": 0.5, "mutations": [{"name": "m", "prompt": "say {value}", "values": ["x", "y"]}]}}, {"type": "evol_instruct", "seed_file": str(seeds), "max_rounds": 1}],
        judge={"dimensions": [{"name": "quality", "max": 10}], "judges": [{"endpoint": "llm"}, {"endpoint": "llm"}], "min_judges": 2},
    )
    assert cli.main(["-c", path, "--stand-in", "run"], spark) == 0
    first = capsys.readouterr().out
    table = spark.read.parquet(str(tmp_path / "out" / "samples.parquet"))
    rows = table.collect()
    assert table.columns == ["id", "strategy", "instruction", "output", "reasoning", "messages", "tools", "metadata", "total_score"]
    assert rows and all(r.total_score >= 1 and json.loads(r.metadata)["metrics"]["score_source"] == "llm" for r in rows)
    evolved = [json.loads(r.metadata)["lineage"] for r in rows if r.strategy == "evol_instruct"]
    assert evolved and all(len(json.loads(x["evolution_chain"])) == 2 for x in evolved)
    assert all(r.output.startswith("answer") for r in rows)
    assert f"{len(rows)} out" in first and "llm_calls=" in first and "scored=" in first
    assert cli.main(["-c", path, "--stand-in", "run", "--resume"], spark) == 0
    again = capsys.readouterr().out
    assert "0 in, 0 out" in again and "llm_calls=0" in again
    assert spark.read.parquet(str(tmp_path / "out" / "samples.parquet")).count() == len(rows)


def test_score_needs_a_judge_and_caches(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"id": str(i), "instruction": f"question {i}", "output": "an answer"}) for i in range(5)))
    none = written(tmp_path, output={"path": str(tmp_path / "o")})
    assert cli.main(["-c", none, "score", str(tmp_path / "in.jsonl")], spark) == 2
    path = written(tmp_path, output={"path": str(tmp_path / "o")}, llm={"model": "m"}, judge={"dimensions": [{"name": "q"}, {"name": "r"}], "min_total": 6})
    for cached in (0, 5):
        assert cli.main(["-c", path, "--stand-in", "score", str(tmp_path / "in.jsonl")], spark) == 0
        assert f"cache_hits={cached}" in capsys.readouterr().out


def test_resume_takes_up_what_was_generated(spark, tmp_path, monkeypatch):
    """A run that breaks off behind the model asks it nothing again."""
    cfg = config.complete({"output": {"path": str(tmp_path / "o")}, "llm": {"model": "m"}, "stages": ["exact_dedup"], "strategies": [{"type": "topic_driven", "topics": ["a", "b", "c"], "count": 3}]})

    def broken(self, samples):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(flow._Flow, "cleaned", broken)
        with pytest.raises(OSError):
            flow.run(spark, cfg, chats=flow.double_chats)
    done = flow.run(spark, cfg, resume=True, chats=flow.double_chats)
    assert done.calls == 0 and done.cached == 3 and ("kept", "", 3) in done.rows
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "o" / "samples.parquet")).select("id", "instruction").collect()]
    assert len(rows) == 3 and all(i.startswith("task") for _, i in rows)
    again = flow.clean(spark, config.complete({"output": {"path": str(tmp_path / "p.jsonl")}, "stages": ["exact_dedup"]}), str(tmp_path / "o" / "state"))
    assert again.rows == [("kept", "", 3)]
