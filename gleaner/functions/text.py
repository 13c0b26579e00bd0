"""Scalar text functions as native column expressions. Null text gives null unless a function says otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, spelled out because \s is ASCII only in Java patterns.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; a lambda that uses an expression computes it again for each element."""
    return F.transform(F.array(value), body)[0]


def derive_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by a bar; a null part counts as the word None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


def text_for_dedup(instruction: Column, output: Column, messages: Column | None = None) -> Column:
    """The text a sample is compared by: role:content lines of its messages, else instruction, newline, output."""
    flat = F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n"), F.coalesce(output, F.lit("")))
    if messages is None:
        return flat
    said = lambda x: F.coalesce(x, F.lit("None"))
    lines = F.transform(messages, lambda m: F.concat(said(m["role"]), F.lit(":"), said(m["content"])))
    return F.when(F.size(messages) > 0, F.array_join(lines, "\n")).otherwise(flat)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    """Without control and format characters other than newline and tab, stripped."""
    return strip(F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", ""))


def special_char_ratio(text: Column) -> Column:
    """Share of code points that are neither letters, numbers, white space nor full-width forms; 0 for empty text."""
    plain = r"[\p{L}\p{N}\s\x{1c}-\x{1f}\x{85}\p{Z}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, plain, "")) / F.length(text)).when(text.isNotNull(), 0.0)


def tokens(text: Column, unit: str = "char") -> Column:
    """Code points, or words of letters, digits and underscores."""
    if unit == "word":
        return F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


_WORDS = re.compile(r"\w+")  # letters, numbers and underscores of every script, as WORD
_SPACES = re.compile(r"[\s\x1c-\x1f\x85]+")


def token_codes(text: str, unit: str) -> np.ndarray:
    """One integer per token, equal for equal tokens."""
    if unit == "char":
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return pd.factorize(np.array(_WORDS.findall(text), dtype=object))[0].astype(np.int64)


def distinct_grams(codes: np.ndarray, n: int) -> int:
    """How many different runs of n codes there are. Code points fit 21 bits, so three make one integer; longer ones are
    numbered step by step, which keeps the count exact."""
    left = codes[: len(codes) - n + 1]
    for k in range(1, n):
        if k % 3 == 0 or int(left.max()) >= 1 << 42:
            left = np.unique(left, return_inverse=True)[1].astype(np.int64)
        left = (left << 21) | codes[k : k + len(left)]
    return len(np.unique(left))


@lru_cache(maxsize=1)
def plain_codes() -> np.ndarray:
    """For every code point whether it is a letter, a number, white space or a full-width form."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out = np.isin(kinds, ["L", "N", "Z"])
    for first, last in ((0x09, 0x0D), (0x1C, 0x1F), (0x85, 0x85), (0x3000, 0x303F), (0xFF00, 0xFFEF)):
        out[first : last + 1] = True
    return out


def measure(text: str | None, n: int = 3, unit: str = "char", word_unit: str = "word") -> tuple[float | None, ...]:
    """Longest run of equal neighbouring tokens over tokens, share of words whose type occurs more than once, distinct
    n-grams over n-grams, share of special characters. 0, 0, 1 and 0 where there are no tokens; null for null."""
    if text is None:
        return None, None, None, None
    points = token_codes(text, "char")
    codes = points if unit == "char" else token_codes(text, unit)
    run = 0.0
    if len(codes):
        ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
        run = float(np.diff(ends, prepend=-1).max()) / len(codes)
    words = Counter(_WORDS.findall(text) if word_unit == "word" else text)
    repeated = 1.0 - list(words.values()).count(1) / words.total() if words else 0.0
    special = float((~plain_codes()[points]).sum()) / len(points) if len(points) else 0.0
    return run, repeated, distinct_grams(codes, n) / (len(codes) - n + 1) if len(codes) >= n else 1.0, special


def measures(text: Column, n: int = 3, unit: str = "char", word_unit: str = "word") -> Column:
    """Struct of the four shares of measure(), in Arrow batches over arrays of code points."""

    @F.pandas_udf("struct<run:double,repeated:double,diversity:double,special:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t if isinstance(t, str) else None, n, unit, word_unit) for t in texts], columns=["run", "repeated", "diversity", "special"], dtype=float)

    return F.when(text.isNotNull(), of(text))


def longest_run_ratio(text: Column, unit: str = "char") -> Column:
    """Longest run of equal neighbouring tokens over all tokens; 0 without tokens."""
    return measures(text, unit=unit)["run"]


def repeated_word_ratio(text: Column, unit: str = "word") -> Column:
    """Share of tokens whose type occurs more than once; 0 without tokens."""
    return measures(text, word_unit=unit)["repeated"]


def grams(items: Column, n: int) -> Column:
    """n-grams of an array of strings as strings; none if it is shorter than n."""

    def build(t: Column) -> Column:
        last = F.size(t) - n + 1
        joined = lambda i: F.concat(*[F.concat(F.lit("\x1f") if k else F.lit(""), t[i + k]) for k in range(n)])
        return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), joined)).otherwise(F.array().cast("array<string>"))

    return let(items, build)


def ngram_diversity(text: Column, n: int = 3, unit: str = "char") -> Column:
    """Distinct n-grams over n-grams; 1 for texts shorter than n tokens."""
    return measures(text, n, unit)["diversity"]


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams after collapsing white space; none for shorter texts."""
    return F.array_distinct(grams(tokens(strip(F.regexp_replace(text, f"{SPACE}+", " "))), n))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_shingles(texts: list[str | None], n: int, unit: str) -> list[np.ndarray | None]:
    """Distinct 64-bit hashes of the n-grams of every text, sorted: of words in lower case, or of characters after
    collapsing white space. The words of all texts are hashed together."""
    if unit == "word":
        parts = [_WORDS.findall(t.lower()) if t else [] for t in texts]
        codes, names = pd.factorize(np.array([w for ws in parts for w in ws], dtype=object))
        known = pd.util.hash_array(np.asarray(names, dtype=object)) if len(names) else np.zeros(0, np.uint64)
        flat, sizes = known[codes] if len(codes) else np.zeros(0, np.uint64), [len(ws) for ws in parts]
    else:
        arrays = [token_codes(_SPACES.sub(" ", t).strip(), "char").astype(np.uint64) if t else np.zeros(0, np.uint64) for t in texts]
        flat, sizes = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64), [len(x) for x in arrays]
    h = np.zeros(max(0, len(flat) - n + 1), dtype=np.uint64)
    for k in range(n):
        h = (h ^ flat[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    out, at = [], 0
    for t, size in zip(texts, sizes):
        out.append(None if t is None else np.unique(h[at : at + size - n + 1].view(np.int64)) if size >= n else np.zeros(0, np.int64))
        at += size
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, cut to the shorter one; a norm of zero counts as 1e-9."""
    n = F.least(F.size(a), F.size(b))
    norm = lambda v: F.when(dot(v, v) > 0, F.sqrt(dot(v, v))).otherwise(1e-9)
    return dot(F.slice(a, 1, n), F.slice(b, 1, n)) / (norm(a) * norm(b))


def think(reasoning: Column, text: Column) -> Column:
    wrapped = F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"), F.coalesce(text, F.lit("")))
    return F.when(F.coalesce(reasoning, F.lit("")) != "", wrapped).otherwise(text)


def parse_prompt_logprobs(payload: Column, mode: str | None = None) -> Column:
    """First value of every position of choices[0].logprobs.prompt_logprobs (teacher_forced), or the list token_logprobs
    (continuation); without a mode whichever is there. Null positions stay, malformed payloads are null."""
    schema = "choices array<struct<logprobs:struct<prompt_logprobs:array<map<string,double>>,token_logprobs:array<double>>>>"
    logs = F.try_element_at(F.from_json(payload, schema)["choices"], F.lit(1))["logprobs"]
    firsts = F.transform(logs["prompt_logprobs"], lambda m: F.try_element_at(F.map_values(m), F.lit(1)))
    return {"teacher_forced": firsts, "continuation": logs["token_logprobs"]}.get(mode, F.coalesce(firsts, logs["token_logprobs"]))


def mean_token_nll(logprobs: Column) -> Column:
    """Mean of the negated log-probabilities that are not null; null without any."""
    kept = F.filter(logprobs, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s - x) / F.size(kept))


def nll_quality(nll: Column, ceiling: float = 6.0) -> Column:
    """1 at 0, falling to 0 at the ceiling, 4 decimals; 0 for NaN, infinity and null."""
    finite = nll.isNotNull() & ~F.isnan(nll) & (F.abs(nll) < float("inf"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(nll, F.lit(0.0)) / max(ceiling, 1e-9)))
    return F.when(finite, F.round(value, 4)).otherwise(0.0)


def heuristic_scores(p: Column, text: Column) -> Column:
    """Map of the local scores coherence and fluency from a classifier's probability; null for blank text. Any other
    dimension has the neutral score 0.5, which the caller fills in."""
    length = F.length(text)
    coherence = F.round(0.5 * p + 0.5 * F.least(length / 200, F.lit(1.0)), 4)
    pairs = F.create_map(F.lit("coherence"), coherence, F.lit("fluency"), F.round(p, 4))
    return F.when(F.length(strip(text)) > 0, pairs)


def context_reference(instruction: Column) -> Column:
    """Whether an instruction refers to a text its reader can't see."""
    #: Turns of phrase that give such instructions away.
    turns = ["根据上文", "根据给定文档", "如上文所述", "as mentioned above", "according to the passage", "per the document", "based on the text"]
    low = F.lower(instruction)
    return F.coalesce(F.exists(F.array(*map(F.lit, turns)), lambda t: low.contains(t)), F.lit(False))
