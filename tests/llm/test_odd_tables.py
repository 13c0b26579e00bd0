"""Every query of the subpackage over tables of odd rows, and over empty ones."""

import datetime

import pytest

from gleaner.llm import registry

AT = datetime.datetime(2024, 1, 1)
#: Extra columns with the names that operators use inside.
EXTRA = ", text string, s string, rule int, votes string, share double, cut boolean, key string, keys string, at string, node long, n_tokens string, part int, window_key string"
NONE = (None,) * (EXTRA.count(","))
SCHEMAS = {
    "samples": "id string, strategy string, instruction string, output string, reasoning string, messages array<struct<role:string,content:string>>, tools string, metadata string, origin string, total_score double, created_at timestamp",
    "fingerprints": "hash string, sample_id string, batch_no int, pos long",
    "minhash_sigs": "sample_id string, sig string, batch_no int, pos long",
    "text_vectors": "vec_id long, text_hash string, model string, vec array<double>",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, file_name string",
    "keep_targets": "strategy string, keep_share double",
    "mix_targets": "mix_id string, source string, target_share double, max_repeats int",
}
LONG = "The gardener waits by the river until the bridge is open, and then he walks home with his dog. " * 3000
SIG = str(list(range(128)))


def flat(i, output, instruction="What does the gardener do?", reasoning=None, score=1.0, strategy="a", origin="o"):
    return (i, strategy, instruction, output, reasoning, None, None, None, origin, score, AT)


ROWS = {
    "samples": [
        flat("a", "The gardener waits by the river."), flat("a", "The gardener waits by the river."), flat("b", None, None, None, None, None, None), flat("c", "", "", ""), flat(None, "x"), flat("d", " \n\t"), flat("e", LONG, reasoning=LONG),
        flat("f", "N/A", score=float("nan")), flat("g", "퟿�" * 50), flat("h", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3"), flat("i", "什么都没有发生，他在家里等着。"), ("m", "a", None, None, None, [("user", None), (None, "x")], None, None, None, 2.0, None), ("n", "a", None, None, None, [], None, None, None, 2.0, AT),
    ],
    "fingerprints": [("AB", "a", 0, 0), ("ab", "b", 1, 1), ("AB", "a", 0, 0), (None, "c", 1, 2), ("x", None, 1, 3), ("y", "d", None, 4), ("z", "e", 2, None)],
    "minhash_sigs": [("a", SIG, 0, 0), ("f", SIG.replace(" ", ""), 1, 1), ("c", None, 1, 2), ("e", "[1, 2]", 2, 3), ("g", "broken", 2, 4), (None, SIG, 1, 5)],
    "text_vectors": [(0, "h", "m", [1.0] * 64), (0, "h", "m", [1.0] * 64), (1, "h", "m", [2.0] * 64), (2, None, "m", [1.0] * 63 + [0.0]), (3, "h", None, [1.0] * 64), (None, "h", "m", [1.0] * 64), (4, "h", "m", None), (5, "h", "m", []), (6, "h", "m", [0.0] * 64), (7, "h", "m", [float("nan")] * 64), (8, "h", "m", [None] * 64), (9, "h", "n", [1e300] * 64)],
    "documents": [(0, None, None, None, None, None), (1, "", "en", "s", 0, "f"), (2, " ", "en", "s", 1, "f"), (3, LONG, "en", "s", len(LONG), "f"), (4, LONG, "en", "t", len(LONG), "f"), (5, "<|endoftext|> ‍́ 😀\r\n", "xx", "t", 20, "f"), (6, "x", "en", None, 1, None)],
    "keep_targets": [("a", 0.5), ("none", 0.5), (None, 0.5), ("b", None)],
    "mix_targets": [("m", "s", 0.5, 1), ("m", "t", 0.5, 2), ("m", "t", 0.5, 2), ("m", "gone", 0.1, 1), ("n", "s", None, None), (None, "s", 1.0, 1), ("o", "s", 0.0, 0)],
}


def tables(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        data = [(*r, *NONE) for r in rows.get(name, [])]
        known = {c.split()[0] for c in schema.replace("array<struct<role:string,content:string>>", "x").split(", ")}
        extra = [c for c in EXTRA[2:].split(", ") if c.split()[0] not in known]
        data = [r[: len(r) - len(NONE) + len(extra)] for r in data]
        spark.createDataFrame(data, ", ".join([schema, *extra])).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {name: tables(spark, tmp_path_factory.mktemp(name), rows) for name, rows in (("odd", ROWS), ("empty", {}))}


EXPECTED = {
    "p1_found": {("g",)}, "p5_found": {("b",), ("f",)}, "p10_found": {(3,), (4,)}, "p2_found": {(0, 1), (0, 2), (1, 2)},
    "p6_found": {("e", "output"), ("e", "reasoning")}, "p7_found": {(i,) for i in "acdeghimn"},
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(spark, folders, name):
    rows = [tuple(str(x) if isinstance(x, (list, dict, float)) else x for x in r) for r in registry.QUERIES[name](spark, folders["odd"]).collect()]
    assert len(set(rows)) == len(rows)
    if name in EXPECTED:
        assert EXPECTED[name] == set(rows), (EXPECTED[name], set(rows))
    if name == "p4_found":
        assert {("b", "empty"), ("c", "empty"), ("d", "empty"), ("f", "empty"), ("i", "other_language")} <= set(rows)
    if name == "p8_ids":
        assert {r[0]: r[1] for r in rows if r[0] in (0, 1)} == {0: "[]", 1: "[]"}
    assert registry.QUERIES[name](spark, folders["empty"]).count() == 0
