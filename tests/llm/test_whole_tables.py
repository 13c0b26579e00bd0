"""Models and counts come from all rows of a table, also of one with more rows than a sample would have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import history, pairs, truncation

ROWS = 6_200
SCHEMA = "id string, instruction string, output string, reasoning string, messages array<string>, origin string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Rows in the order of their hashes; the last ones alone show that zeta goes on behind a stop."""
    ids = [r.id for r in spark.range(ROWS).select(F.col("id").cast("string")).orderBy(F.xxhash64("id")).collect()]
    texts = ["The gardener waits by the river until the bridge is open."] * (ROWS - 9) + ["The gardener sets zeta.alpha to one and waits by the river."] * 8 + ["The gardener waits by the river and sets zeta."]
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, "What does the gardener do?", t, None, None, "o") for i, t in zip(ids, texts)], SCHEMA).coalesce(4).write.parquet(f"{path}/samples.parquet")
    return str(path), ids


def test_truncation_model_of_all_rows(spark, folder):
    root, ids = folder
    model = truncation.shared_model(spark, root).value
    assert model.uses["en"]["gardener"] == ROWS
    held = {r.id for r in spark.read.parquet(f"{root}/samples.parquet").filter(F.pmod(F.xxhash64("id"), F.lit(10)) == 9).collect()}
    learnt = [("en", r.output) for r in spark.read.parquet(f"{root}/samples.parquet").collect() if r.id not in held]
    key, inside, stopped, last = model.count(learnt)
    some = inside + truncation.FIELD_END * last > 1
    assert [x.tolist() for x in (model.key, model.inside, model.stopped, model.last)] == [x[some].tolist() for x in (key, inside, stopped, last)]
    assert ("en", "output") in model.limits
    assert {tuple(r) for r in truncation.found(spark, root).collect()} == {(ids[-1], "output")}


def test_cuts_of_pairs_by_all_rows(spark, folder):
    root, ids = folder
    assert {tuple(r) for r in pairs.found(spark, root).collect()} == {(ids[-1], "truncated")}


def test_history_with_many_far_rows_under_one_key(spark, tmp_path, monkeypatch):
    """A batch whose rows share a part of their signatures, but are not close, takes a few rounds and not one a row."""
    monkeypatch.setattr(history, "GROUP", 2)
    verified, rounds = history.History._verified, []
    monkeypatch.setattr(history.History, "_verified", staticmethod(lambda *a: rounds.append(1) or verified(*a)))
    r = np.random.default_rng(2)
    sigs = r.integers(0, 1 << 40, (41, 128))
    sigs[:, :8] = sigs[0, :8]
    sigs[40, 34:] = sigs[5, 34:]
    rows = [(f"s{i:02}", int(i > 0), i, None, x.tolist()) for i, x in enumerate(sigs)]
    df = spark.createDataFrame(rows, "sample_id string, batch_no int, pos long, hash string, sig array<bigint>")
    index = history.History.create(df.filter("batch_no = 0"), str(tmp_path / "h"))
    assert {x.sample_id for x in index.append(df.filter("batch_no = 1")).collect()} == {"s40"}
    assert len(rounds) < 16


def test_close_signatures_share_a_key():
    r = np.random.default_rng(3)
    for _ in range(300):
        one = r.integers(0, 1 << 40, 128)
        two = one.copy()
        start = r.integers(0, 128 - history.RADIUS)
        at = r.choice(128, history.RADIUS, replace=False) if r.random() < 0.7 else np.arange(start, start + history.RADIUS)
        two[at] += 1
        keys = history.index_of(np.stack([one, two]), np.zeros((0, 128), np.int64))[0]
        assert (keys[0] == keys[1]).any() and keys.shape[1] == history.KEYS
