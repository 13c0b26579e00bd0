import json

import pytest

from gleaner.sources import readers


def test_line_numbers_follow_the_files(spark, tmp_path):
    """Several files of several splits each, blank lines among them."""
    folder = tmp_path / "f"
    folder.mkdir()
    want = []
    for name in ("b.txt", "a.txt"):
        lines = [f"{name} {i} {'x' * (i % 40)}" if i % 7 else "" for i in range(300)]
        (folder / name).write_text("\n".join(lines))
        want.append((name, lines))
    expected = [(name, i, x) for name, lines in sorted(want) for i, x in enumerate(lines)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = [(r.file.split("/")[-1], r.line, r.value) for r in readers.file_lines(spark, str(folder)).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expected


def test_seed_ids_count_blank_lines(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text(json.dumps({"prompt": "p", "response": "r"}) + "\n\n" + json.dumps({"instruction": "i"}) + "\n")
    assert [(r.id, r.instruction, r.output) for r in readers.load_seeds(spark, str(path)).orderBy("pos").collect()] == [("seed:s.jsonl:0", "p", "r"), ("seed:s.jsonl:2", "i", None)]
    path.write_text("\n")
    with pytest.raises(ValueError):
        readers.load_seeds(spark, str(path))


def test_broken_lines_and_strict_opening(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a", "output": "x"}\nnot json\n{"id": "b", "output": "y", "metadata": [1]}\n')
    got = readers.open_file(spark, str(path)).orderBy("pos").collect()
    assert [(r.id, r.problems) for r in got] == [("a", []), ("b", ["C4"])]
    with pytest.raises(Exception, match="C4"):
        readers.open_file(spark, str(path), strict=True).collect()


def test_chatml_drops_lineage_and_materialize(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps({"messages": [{"role": "user", "content": "x"}], "metadata": {"id": "m", "lineage": {"a": "b"}}}))
    out = readers.materialize(readers.to_samples(readers.read_json_rows(spark, str(path)), "chatml"), str(tmp_path / "m"))
    assert [(r.id, r.lineage, r.messages[0].content) for r in out.collect()] == [("m", None, "x")]
