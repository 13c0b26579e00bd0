import itertools
import re

import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.chunking import bag_vector, semantic_ranges, structure_ranges
from gleaner.functions.replies import first_object, trajectory_problem


def value(spark, column, **cells):
    names = list(cells)
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("text, expected", [("", 0.0), ("abc!!", 0.4), (None, None)])
def test_special_char_ratio(spark, text, expected):
    assert value(spark, T.special_char_ratio(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [("aaaa", 1.0), ("abab", 0.25), ("", 0.0), ("😀😀a", 2 / 3)])
def test_longest_run(spark, text, expected):
    assert value(spark, T.longest_run_ratio(F.col("t")), t=text) == pytest.approx(expected)


@pytest.mark.parametrize("text, expected", [("a b a c", 0.5), ("a", 0.0), ("", 0.0), ("x x x", 1.0)])
def test_repeated_words(spark, text, expected):
    assert value(spark, T.repeated_word_ratio(F.col("t")), t=text) == pytest.approx(expected)


@pytest.mark.parametrize("text, expected", [("abcd", 1.0), ("ab", 1.0), ("aaaa", 0.5)])
def test_diversity(spark, text, expected):
    assert value(spark, T.ngram_diversity(F.col("t")), t=text) == expected


def test_normalize(spark):
    assert value(spark, T.normalize_text(F.col("t")), t="​﻿ a\r\n\tb\x07 　") == "a\n\tb"


@pytest.mark.parametrize("nll, expected", [(0.0, 1.0), (6.0, 0.0), (50.0, 0.0), (math.nan, 0.0), (2.0, 0.6667), (None, 0.0)])
def test_quality(spark, nll, expected):
    assert spark.createDataFrame([(nll,)], "x double").select(T.nll_quality(F.col("x")).alias("v")).first().v == expected


def test_structure_ranges():
    assert structure_ranges("") == [] and structure_ranges(None) == []
    text = "a" * 300 + "\n\n" + "b" * 50 + "\n\n" + "c" * 3200
    got = structure_ranges(text, 200, 1500)
    assert got[0] == (0, 351) and got[-1][1] - got[-1][0] >= 200 and all(b > a for a, b in got)


def test_semantic_ranges():
    both = lambda ss: [bag_vector(s) for s in ss]
    assert semantic_ranges("one sentence only", both) == [(0, 17)]
    got = semantic_ranges("Alpha beta. " * 3 + "12345 67890! " * 3, both, 0.99)
    assert got[0][0] == 0 and all(a < b for a, b in got)


@pytest.mark.parametrize("reply, expected", [('{"a": 1}', {"a": 1}), ('```json\n{"a": 2}\n```', {"a": 2}), ('x {bad} then {"a": 3} y', {"a": 3}), ("none", None), (None, None), ("[1]", None)])
def test_first_object(reply, expected):
    assert first_object(reply) == expected


def call(i, name="f", args="{}"):
    return {"role": "assistant", "tool_calls": [{"id": i, "function": {"name": name, "arguments": args}}]}


def test_trajectories():
    tools = [{"function": {"name": "f"}}]
    done = lambda i: {"role": "tool", "tool_call_id": i}
    assert trajectory_problem([call("1"), done("1")], tools) is None
    assert trajectory_problem([call("1")], tools) == "broken_chain:no_result"
    assert trajectory_problem([done("1")], tools) == "broken_chain:orphan_result"
    assert trajectory_problem([call("")], tools) == "missing_call_id"
    assert trajectory_problem([call("1"), done("1"), call("1")], tools) == "duplicate_call_id"
    assert trajectory_problem([call("1", "g")], tools) == "unknown_function:g"
    assert trajectory_problem([call("1", args="{")], tools) == "invalid_arguments_json"


def test_measures_equal_plain_counts(spark):
    texts = [None, "", "a", "aab", "aa aa b", "ünï — ‘x’ 你好，世界！ ½ ²", "x_y x_y\tz\r\n..", "​퟿!", "😀😀 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in df.select("i", T.measures(F.col("t"), 4).alias("m"), T.special_char_ratio(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].m is None and got[i].s is None
            continue
        grams = [t[k : k + 4] for k in range(len(t) - 3)]
        best = max((sum(1 for _ in g) for _, g in itertools.groupby(t)), default=0)
        words = re.findall(r"\w+", t)
        assert got[i].m.run == (best / len(t) if t else 0)
        assert got[i].m.diversity == (len(set(grams)) / len(grams) if grams else 1)
        assert abs(got[i].m.repeated - (sum(words.count(w) > 1 for w in words) / len(words) if words else 0)) < 1e-12
        assert abs(got[i].m.special - got[i].s) < 1e-12, (t, got[i])


@pytest.mark.parametrize("unit", ["word", "char"])
def test_hash_shingles_counts_distinct_grams(unit):
    texts = [None, "", "a b c", "a B c a b C a b c", "x  y\n z w", "one two three four five six"]
    for t, got in zip(texts, T.hash_shingles(texts, 3, unit)):
        if t is None:
            assert got is None
            continue
        items = re.findall(r"\w+", t.lower()) if unit == "word" else list(re.sub(r"\s+", " ", t).strip())
        assert len(got) == len({tuple(items[k : k + 3]) for k in range(len(items) - 2)})
