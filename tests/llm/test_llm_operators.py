import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import cutoffs, encoding, history, mixing, neighbours, pairs, prose, repetition, spans, truncation
from gleaner.llm.labelled import documents


# Problem 1 -------------------------------------------------------------------------------------------------------
def test_rules_hold_on_other_labelled_documents(spark):
    rules = prose.induce(*prose.labelled_statistics(spark))
    rows = [(i, t, y) for i, (t, y) in enumerate(documents(400, seed=99))]
    df = spark.createDataFrame(rows, "i int, t string, y boolean").withColumn("s", prose.statistics(F.col("t")))
    got = df.select("y", *[f"s.{f}" for f in prose.FEATURES]).collect()
    x, y = np.array([r[1:] for r in got], dtype=float), np.array([r[0] for r in got])
    hit = np.logical_or.reduce([prose.covers(r, x) for r in rules])
    assert (hit == y).mean() > 0.97


def test_statistics_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "A b. C d!")], "i int, t string").withColumn("s", prose.statistics(F.col("t")))
    got = {r.i: r.s for r in df.collect()}
    assert got[1] is None and got[2].words == 0 and got[3].words == 0 and got[4].words == 4 and got[4].stop_share == 1.0


# Problem 2 -------------------------------------------------------------------------------------------------------
def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 64))
    v = centres[r.integers(0, 12, 600)] + 0.3 * r.normal(size=(600, 64))
    v[50:80] = v[50] * r.uniform(0.5, 2, (30, 1))  # one direction, other lengths
    rows = [(i, "h", "m", x.tolist()) for i, x in enumerate(v)] + [(600, "h", "m", None), (601, "h", "m", [0.0] * 64), (602, "h", "m", [1.0] * 3), (603, "h", "m", [float("nan")] * 64)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, text_hash string, model string, vec array<double>")
    near = neighbours.nearest(neighbours.usable_vectors(df), shard=200).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -9)
    want = {(i, int(j)) for i in range(600) for j in np.argsort(-cos[i], kind="stable")[:10]}
    got = {(x.vec_id, x.neighbour) for x in near}
    assert len(near) == 6000 and len(got & want) / len(want) > 0.95
    assert {x.neighbour for x in near if x.vec_id == 60} == set(range(50, 60))
    assert neighbours.nearest(neighbours.usable_vectors(df.filter("false"))).count() == 0


@pytest.mark.parametrize("islands, least", [(40, 0.98), (1, 0.9)])
def test_nearest_in_a_dense_region(spark, islands, least):
    """Most vectors lie in one cell, which finer centroids split; vectors that no centroid can part are salted."""
    r = np.random.default_rng(3)
    near, far = r.normal(size=64), r.normal(size=(6, 64))
    centres = near + 0.3 * r.normal(size=(islands, 64))
    v = np.concatenate([centres[r.integers(0, islands, 2400)] + 0.12 * r.normal(size=(2400, 64)), far[r.integers(0, 6, 300)] + 0.25 * r.normal(size=(300, 64)), 5 * far[0] + 1e-7 * r.normal(size=(900, 64))])
    df = spark.createDataFrame([(i, "h", "m", x.tolist()) for i, x in enumerate(v)], "vec_id long, text_hash string, model string, vec array<double>")
    got = {(x.vec_id, x.neighbour) for x in neighbours.nearest(neighbours.usable_vectors(df), shard=150).collect()}
    u = v[:2700] / np.linalg.norm(v[:2700], axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    want = {(i, int(j)) for i in range(2400) for j in np.argsort(-cos[i], kind="stable")[:10]}
    assert len(got & want) / len(want) > least, len(got & want) / len(want)


# Problem 3 -------------------------------------------------------------------------------------------------------
def test_truncation_on_held_out_cuts():
    r = random.Random(5)
    whole = [t for t, bad in documents(1600, seed=3) if not bad and "```" not in t and len(t) > 80 and t.rstrip()[-1:] in ".。!?" and not t.endswith("...")]
    model = truncation.train([("output", t) for t in whole[:-60]])
    held = whole[-60:]
    flags = [truncation.cut_off(model, t, truncation.language(t), "output") for t in held]
    cut = [t[: r.randrange(len(t) // 2, len(t) - 3)].rstrip(" .。!?") for t in held]
    found = [truncation.cut_off(model, t, truncation.language(t), "output") for t in cut]
    assert sum(flags) <= 3 and sum(found) >= 45, (sum(flags), sum(found))


def test_model_abstains_on_unfamiliar_ends_and_knows_beginnings():
    whole = [t for t, bad in documents(1600, seed=3) if not bad and "```" not in t and len(t) > 80 and t.rstrip()[-1:] in ".。!?" and not t.endswith("...")]
    model = truncation.train([("output", t) for t in whole])
    for junk in ("t r g j s i x r e k n s t p h q j f h g n r c y x e d q f", "tzbov etflderxwtv rpfhyrizshzva szfqahhopjsd kkb iuq yofi", "Zobra, Kolin, Mersu, Tovrai, Zenpu, Dalba, Surai, Lintov, Pudal, Merzen, Bako, Raizen, Tovdal"):
        assert not truncation.cut_off(model, junk, truncation.language(junk), "output"), junk
    far = whole[0] + " The large window" + " of the large window" * 60 + " of the large wind"
    assert truncation.final_stretch(far)[0].startswith(" The large window of") and truncation.cut_off(model, far, "en", "output")


@pytest.mark.parametrize("text, expected", [("a whole text here…", True), ("x\n```\ncode", True), ("x\n```\ncode\n```", False), ("a,b,c\nd,e,f\ng,h,i\nj,k", True), ("name (Bel", True), ("half �", True)])
def test_marked_ends(text, expected):
    assert truncation.marked(text) is expected


# Problem 4 -------------------------------------------------------------------------------------------------------
def vote(instruction, output, found=(False, None)):
    return pairs.votes(instruction, output, found, pairs.declining([output or ""])[0])


def test_label_model_on_labelled_pairs():
    rows = [(vote(i, o), d) for i, o, d in pairs.labelled_pairs()]
    for d in (0, 2, 3, 4):
        counts = {}
        for v, _ in rows:
            counts[v[d]] = counts.get(v[d], 0) + 20
        counts["-" * len(rows[0][0][d])] = counts.get("-" * len(rows[0][0][d]), 0) + 5000
        q = pairs.label_model(counts)
        wrong = [(v[d], q[v[d]]) for v, defects in rows if (q[v[d]] > 0.5) != (pairs.DEFECTS[d] in defects)]
        assert len(wrong) <= 1, (pairs.DEFECTS[d], wrong)


def test_label_model_of_cuts_keeps_both_witnesses():
    q = pairs.label_model({"-0-": 9000, "0-0": 1700, "-00": 1700, "+00": 1300, "++0": 300, "0+0": 80, "0--": 20})
    assert {k for k, x in q.items() if x > 0.5} == {"+00", "++0", "0+0"}


def test_votes_look_at_whole_texts():
    ask = "What does the gardener do when the bridge is closed?"
    assert vote(ask, "\u200b" * 100)[0] == "+++"
    assert vote(ask, "-" * 300 + " N/A " + "-" * 300)[0][1] == "+"
    rule = "-" * 240
    assert vote(ask, f"{rule}\n{ask}\n{rule}")[3] == "+++"


def test_classifier_of_refusals_votes_alone():
    low, high, other = pairs.declining(["The gardener waits by the river. " * 30, "The gardener waits. " * 30 + "Sorry, I am not able to answer this.", ""])
    assert high > pairs.SURE > low and other == -1.0


def test_refusal_is_found_anywhere():
    ask, long = "What does the gardener do when the bridge is closed?", "the gardener waits by the river until the bridge is open, " * 9
    for late in (f"Since {long}I'm sorry, but I can't help with that.", f"{long.strip(', ')}. I'm sorry, but I can't help with that."):
        assert late.find("sorry") > 400
        assert vote(ask, late)[2][0] == "+"


def test_language_of_the_whole_text():
    ask = "What does the gardener do when the bridge is closed and the river is high?"
    english = "The gardener waits by the river until the bridge is open, and then he walks home with his dog. " * 11
    german = "Der Gärtner wartet am Fluss, bis die Brücke wieder offen ist, und dann geht er mit dem Hund nach Hause. " * 80
    text = f"{english}{german}{english}{german}{english}"
    assert truncation.language(text) == "de" and vote(ask, text)[4][0] == "+"
    quoted = f"{german[:1040]}{english * 5}{german[:1040]}{english * 5}{german[:1040]}"
    assert truncation.language(quoted) == "en"


def test_letters_after_a_rule_count():
    ask = "What does the gardener do when the bridge is closed?"
    german = "Der Gärtner wartet am Fluss, bis die Brücke wieder offen ist, und dann geht er mit dem Hund nach Hause."
    assert vote(ask, f"{'-' * 90}\n{german}")[4][0] == "+"
    assert vote(ask, "-" * 90)[4][0] == "-"


# Problem 5 -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("group, broadcast, hot", [(2, 1_000_000, 50_000), (512, 1_000_000, 50_000), (512, 0, 3)])
def test_history_equals_sequential(spark, tmp_path, group, broadcast, hot, monkeypatch):
    """Also when the history is opened again for every batch, and by shuffled keys of which some are hot."""
    monkeypatch.setattr(history, "GROUP", group)
    monkeypatch.setattr(history, "BROADCAST", broadcast)
    monkeypatch.setattr(history, "HOT", hot)
    r = np.random.default_rng(1)
    bases = r.integers(0, 50, (8, 128))
    rows = []
    for i in range(90):
        sig = bases[r.integers(0, 8)].copy()
        at = r.choice(128, r.integers(0, 45), replace=False)
        sig[at] = r.integers(0, 50, len(at))
        rows.append((f"s{i:03}", int(i // 30), i, f"h{r.integers(0, 70)}", None if i % 17 == 0 else sig.tolist()))
    df = spark.createDataFrame(rows, "sample_id string, batch_no int, pos long, hash string, sig array<bigint>")
    history.History.create(df.filter("batch_no = 0"), str(tmp_path / "h"))
    got = {x.sample_id for b in (1, 2) for x in history.History.open(spark, str(tmp_path / "h")).append(df.filter(F.col("batch_no") == b)).collect()}
    hashes, sigs, want = set(), [], set()
    for i, b, _, h, s in rows:
        hit = b > 0 and (h in hashes or (s is not None and any(sum(x == y for x, y in zip(s, t)) >= 102 for t in sigs)))
        if hit:
            want.add(i)
        else:
            hashes.add(h)
            sigs += [s] if s is not None else []
    assert got == want and want


def test_signature_spellings(spark):
    good = list(range(127)) + [2**64 - 1]
    cells = [str(good), str(good).replace(" ", ""), "[1, 2]", "broken", None, "[]"]
    got = spark.createDataFrame([(c,) for c in cells], "s string").select(history.parse_signature(F.col("s")).alias("v")).collect()
    assert got[0].v == got[1].v and len(got[0].v) == 128 and all(x.v is None for x in got[2:])


def test_history_of_odd_batches(spark, tmp_path):
    schema = "sample_id string, batch_no int, pos long, hash string, sig array<bigint>"
    index = history.History.create(spark.createDataFrame([], schema), str(tmp_path / "h"))
    sig = list(range(128))
    one = spark.createDataFrame([("a", 1, 0, None, sig), ("b", 1, 1, None, None), ("c", 1, 2, "h", None), ("d", 1, 3, "h", sig)], schema)
    assert {r.sample_id for r in index.append(one).collect()} == {"d"}
    assert index.append(spark.createDataFrame([], schema)).count() == 0
    assert {r.sample_id for r in index.append(one.withColumn("sample_id", F.concat("sample_id", F.lit("2")))).collect()} == {"a2", "c2", "d2"}


# Problem 6 -------------------------------------------------------------------------------------------------------
def test_repetition():
    one = "the small river carries a green boat to the old town before noon."
    other = "nobody in this house remembers where the keys were put last winter."
    got = repetition.repeated_shares([None, "", one, f"{one} {one.upper()}", f"1. {one}\n2. {one}\n3. {one}", f"{one} {other}", "我们在河边看到了一只绿色的小船慢慢地走远了。" * 3])
    assert got[:3].tolist() == [0, 0, 0] and got[3] == 0.5 and got[4] == pytest.approx(2 / 3) and got[5] == 0 and got[6] == pytest.approx(2 / 3)


# Problem 7 -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("share, kept", [(0.5, 4), (1.0, 6), (0.01, 1), (0.0, 0)])
def test_cutoffs(spark, share, kept):
    df = spark.createDataFrame([("a", x) for x in (3.0, 3.0, 1.0, -2.0, 5.0, 3.0)], "source string, score double")
    cutoff, n, total = cutoffs.select_cutoffs(cutoffs.sorted_runs(df), {"a": share, "none": 0.5})["a"]
    assert (n, total) == (kept, 6) and (cutoff is None) == (kept == 0)
    if kept:
        assert sum(x >= cutoff for x in (3.0, 3.0, 1.0, -2.0, 5.0, 3.0)) == kept


# Problem 8 -------------------------------------------------------------------------------------------------------
def test_encoding_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = ["", "Hello  world's 123\n\n x²", "<|endoftext|> ok", "这个安静的　花园😀é́", "a" * 300, " \t\r\n", "Größe_x--y", None, "½ cup\x1cend"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.ids for r in encoding.encode(df, "doc_id").collect()}
    machine = encoding.encoder(encoding.vocabulary_path())
    for i, t in enumerate(texts):
        assert got[i] == ([] if not t else reference.encode(t, add_special_tokens=False).ids), t
        assert "".join(machine.pieces(got[i])) == (t or "")


# Problem 9 -------------------------------------------------------------------------------------------------------
def test_mixing(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7), "big" if i % 4 else "small") for i in range(400)] + [(1000, None, "big"), (1001, "", "small"), (1002, "x", None)], "doc_id long, text string, source string")
    mixes = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 2), ("gap", "big", 0.5, 1), ("gap", "nothing", 0.5, 3)], "mix_id string, source string, target_share double, max_repeats int")
    chosen = mixing.plan(docs, mixes)[0].collect()
    tokens = {}
    for r in chosen:
        tokens[r.mix_id, r.source] = tokens.get((r.mix_id, r.source), 0) + r.n_tokens * r.times
        assert r.times <= (2 if r.source == "small" else 1)
    assert abs(tokens["m", "big"] / (tokens["m", "big"] + tokens["m", "small"]) - 0.5) < 0.02
    assert len({(r.mix_id, r.doc_id) for r in chosen}) == len(chosen) and ("gap", "nothing") not in tokens


# Problem 10 ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hot, broadcast", [(2, 2_000_000), (4000, 2_000_000), (4000, 0)])
def test_spans_against_brute_force(spark, hot, broadcast, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST", broadcast)
    monkeypatch.setattr(spans, "HOT_DOCS", 5)
    r, span, gram = random.Random(2), 40, 20
    text = lambda n: "".join(r.choice("abcd 中\U0001f600") for _ in range(n))
    shared = [text(n) for n in (39, 40, 41, 90)]
    docs = [(i, text(60) + r.choice(["", *shared]) + text(r.randrange(80))) for i in range(60)] + [(60, None), (61, ""), (62, shared[1]), (63, "ab" * 100)]
    got = spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), span, gram, hot).collect()
    holders = {}
    for i, t in docs:
        for k in range(len(t or "") - span + 1):
            holders.setdefault(t[k : k + span], set()).add(i)
    want = {i: {k + j for k in range(len(t or "") - span + 1) if len(holders[t[k : k + span]]) > 1 for j in range(span)} for i, t in docs}
    found = {i: set() for i, _ in docs}
    for x in got:
        found[x.doc_id] |= set(range(x.start, x.end))
    assert found == want and any(want.values())
