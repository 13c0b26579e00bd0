import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import stages
from gleaner.operators.model import as_samples


def samples(spark, rows):
    df = spark.createDataFrame(rows, "pos long, id string, instruction string, output string, extra string")
    return as_samples(df.withColumn("strategy", F.lit("s")), **{c: F.col(c) for c in ("id", "strategy", "instruction", "output", "pos")}, drop=F.col("extra"))


def texts(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [" ".join(r.choice(words) for _ in range(40)) for _ in range(n)]


def test_odd_rows_keep_their_number_and_share_verdicts(spark):
    """Null ids and places, repeated rows, nulls and empty texts, a column whose name is like one of the stages' own."""
    t = texts(3)
    rows = [(0, "a", "q", t[0], "x"), (0, "a", "q", t[0], "x"), (1, "b", "q", t[0], "x"), (2, None, "q", t[1], "x"), (None, "c", "q", t[1], None), (None, None, None, None, None), (3, "d", None, None, "x"), (4, "e", "", "", "x")]
    flow = stages.pipeline(stages.exact_dedup(), stages.stats_gate(max_word=1.0), stages.minhash_dedup())
    got = flow(samples(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.id, r.pos), set()).add((r.drop_stage, r.drop_by))
    assert by[("a", 0)] == {(None, None)} and by[("b", 1)] == {("exact_dedup", "a")}
    assert by[(None, 2)] == {("exact_dedup", "c")} and by[("c", None)] == {(None, None)}
    assert flow(samples(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("hot", [2, 100_000])
def test_hot_copies(spark, hot, monkeypatch):
    """A text that a third of the rows share, and more copies of others."""
    monkeypatch.setattr(stages, "HOT", hot)
    t = texts(20)
    rows = [(i, f"r{i:03}", "q", t[0] if i % 3 == 0 else t[i % 20], None) for i in range(120)]
    first, want = {}, {}
    for pos, i, _, o, _ in rows:
        want[i] = first.get(o)
        first.setdefault(o, i)
    assert {r.id: r.drop_by for r in stages.exact_dedup()(samples(spark, rows)).collect()} == want
    history = spark.createDataFrame([(t[0],)], "t string").select(T.fingerprint(F.concat(F.lit("q\n"), "t")).alias("hash"))
    codes = {r.id: r.drop_code for r in stages.exact_dedup(history)(samples(spark, rows)).collect()}
    assert codes["r000"] == "duplicate(resume)" and codes["r003"] == "duplicate" and codes["r001"] is None


def test_one_scan_for_all_stages(spark, tmp_path):
    samples(spark, [(i, str(i), "question", x, None) for i, x in enumerate(texts(30))]).write.parquet(str(tmp_path / "s"))
    flow = stages.pipeline(stages.length_gate(), stages.exact_dedup(), stages.stats_gate(), stages.exact_dedup())
    out = flow(spark.read.parquet(str(tmp_path / "s"))).select("id", "drop_stage")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<id:string,pos:bigint>" in plan  # what is joined back needs no texts


def test_stored_signatures(spark):
    t = texts(4)
    df = samples(spark, [(i, str(i), "q", x, None) for i, x in enumerate([t[0], t[1], t[1] + " more", t[2]])])
    core = T.text_for_dedup(F.col("instruction"), F.col("output"))
    old = df.filter("id = '3'").select(F.lit("old").alias("sample_id"), stages.signature(core, 64, 3, "char").alias("sig"))
    short = old.select("sample_id", F.slice("sig", 1, 8).alias("sig"))
    stage = stages.minhash_dedup(0.7, 64, 3, "char", False, old.unionByName(short))
    assert {r.id: r.drop_by for r in stage(df).collect()} == {"0": None, "1": None, "2": "1", "3": "old"}
    with pytest.raises(ValueError):
        stages.minhash_dedup(history=old)


def test_vector_stages_name_reasons(spark):
    def vectors(rows):
        return rows.select("h", F.when(F.col("text").contains("same"), F.array(F.lit(1.0), F.lit(0.01))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vec"))

    df = samples(spark, [(i, str(i), "q", x, None) for i, x in enumerate(["same a", "other", "same b", "same a"])])
    got = {r.id: (r.drop_code, r.drop_by) for r in stages.semantic_dedup(0.9, vectors)(df).collect()}
    assert got == {"0": (None, None), "1": (None, None), "2": ("cosine_dup", "0"), "3": ("cosine_dup", "0")}
    got = {r.id: (r.drop_code, r.drop_by) for r in stages.pipeline(stages.exact_dedup(), stages.cluster_dedup(0.9, 4, vectors))(df).collect()}
    assert got == {"0": (None, None), "1": (None, None), "2": ("crowded_cluster", "0"), "3": ("duplicate", "0")}


def test_custom_stage_parts_the_chain(spark):
    seen = []

    def own(df):
        seen.append(df.filter("drop_stage is null").count())
        return df

    df = samples(spark, [(i, str(i), "question", x, None) for i, x in enumerate(["short", *texts(2)])])
    out = stages.pipeline(stages.length_gate(output=(10, 1000)), own, stages.exact_dedup())(df)
    assert seen == [2] and out.filter("drop_stage is null").count() == 2


def test_cosine_pairs_in_blocks(spark):
    """Exact in many small blocks, most of whose pairs are too far apart to be compared."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 400)] + 0.1 * r.normal(size=(400, 16))
    df = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(v)], "id long, at long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    for threshold in (0.97, 0.3):
        got = {(x.id, x.other) for x in stages.cosine_pairs(df, threshold, 20).collect()}
        assert got == {(i, j) for i in range(400) for j in range(i) if cos[i, j] >= threshold}
    _, near = stages.block_pairs(df.select("id", "vec"), 0.97, 20, 400)
    _, far = stages.block_pairs(df.select("id", "vec"), -1.0, 20, 400)
    assert near.count() * 3 < far.count()
    assert stages.cosine_pairs(df.filter("false"), 0.9).count() == 0


def test_close_sets_share_tokens():
    """Any two sets that are close share SHARED of the tokens each emits, at the bounds of size classes too."""
    r, close = np.random.default_rng(0), 0
    draw = lambda n: r.integers(-(2**62), 2**62, n)

    def emitted(x, threshold):
        (ends, raw), at, out = stages.set_tokens([x], threshold)[0], 0, set()
        takes = [t[0] for which, _, _, t in stages.class_plan(np.array([len(x)]), threshold) if which[0]]
        for many, take in zip(ends, takes, strict=True):
            out |= {raw[stages.TOKEN * i : stages.TOKEN * (i + 1)] for i in range(at, at + take)}
            at += many
        return out

    for threshold in (0.8, 0.95, 0.3):
        for n in [2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65, 300, 513] * 10:
            a, less, more = np.unique(draw(n)), int(r.integers(0, n * (1 - threshold) + 1)), int(r.integers(0, n))
            more = min(more, int((n - less) / threshold) - n)
            b = np.unique(np.append(r.permutation(a)[: n - less], draw(max(0, more))))
            if len(b) and (less or more > 0):
                close += 1
                assert (n - less) / (n + max(0, more)) >= threshold and len(emitted(a, threshold) & emitted(b, threshold)) >= stages.SHARED
    assert close > 300


def test_texts_of_shared_sentences_hardly_meet(spark, monkeypatch):
    """Texts that share most sentences with others but aren't close to them stay out of the rounds."""
    r, met, settle = random.Random(5), [], stages.first_wins

    def seen(rows, *rest, **more):
        met.append(rows.agg(F.sum(F.size("keys"))).first()[0])
        return settle(rows, *rest, **more)

    monkeypatch.setattr(stages, "first_wins", seen)
    said = [" ".join(f"w{r.randrange(3000)}" for _ in range(100)) for _ in range(300)]
    rows = [(i, str(i), "q", " ".join(r.sample(said, 3)), None) for i in range(1500)]
    rows += [(1500 + i, str(1500 + i), "q", rows[i][3] + " more", None) for i in range(30)]
    got = {x.id: x.drop_by for x in stages.minhash_dedup()(samples(spark, rows)).collect()}
    assert {i: by for i, by in got.items() if by} == {str(1500 + i): str(i) for i in range(30)}
    assert met[0] < 30 * len(rows), met[0] / len(rows)
