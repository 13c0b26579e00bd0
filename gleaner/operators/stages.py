"""Governance stages. A stage adds drop_stage, drop_code, drop_value and drop_by to the rows it rejects; rows rejected before
keep the first reason and are not looked at again. Nulls count as empty texts.

A stage says what it needs of a row (features) and, if rows meet each other, how the open rows are settled (decide). A
pipeline computes the features of all its stages in one scan, writes them as a narrow table (id, pos, features, no texts),
settles stage after stage on that table, and joins the reasons back to the rows once. (id, pos) names a row, a null counting
as an empty id or place -1; rows that repeat it are the same row and share its verdict. Any other function from rows to rows may stand in a pipeline too; it
parts the stages before it from those behind it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.chunking import bag_vector
from gleaner.operators.greedy import GROUP, first_wins, resolve_pairs
from gleaner.operators.model import METRIC_FIELDS, METRICS, core_text
from gleaner.session import cut

DROPS = {"drop_stage": "string", "drop_code": "string", "drop_value": "double", "drop_by": "string"}
MARKS = "id string, pos bigint, code string, value double, by string"
#: Rows of one key from which the key is hot: they are met by a broadcast. At most rows / HOT keys are.
HOT = 100_000
#: Rows of keys up to which they are broadcast instead of shuffled with what they pick from.
BROADCAST = 500_000


@dataclass(frozen=True)
class Stage:
    """features(df, open): columns, null where open doesn't hold. Without decide they are code and value, row by row.
    decide(rows, df): marks (id, pos, code, value, by) of the rejected among the open rows (id, pos, features); df are the
    rows with their texts."""

    name: str
    features: Callable[[DataFrame, Column], dict[str, Column]]
    decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return _run(df, [self])


def opened(df: DataFrame) -> DataFrame:
    """df with empty reason columns where it has none."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in DROPS.items() if c not in df.columns})


def _run(df: DataFrame, chain: list[Stage]) -> DataFrame:
    """The stages of the chain over df, in one scan."""
    df = opened(df)
    wide = df.withColumn("_open", F.col("drop_stage").isNull())
    for k, s in enumerate(chain):
        wide = wide.withColumns({f"_{k}_{name}": c for name, c in s.features(wide, F.col("_open")).items()})
        if s.decide is None:
            wide = wide.withColumn("_open", F.col("_open") & F.col(f"_{k}_code").isNull())
    none = F.lit(None)
    if all(s.decide is None for s in chain):
        reasons = [(s.name, F.col(f"_{k}_code"), F.col(f"_{k}_value").cast("double"), none.cast("string")) for k, s in enumerate(chain)]
        return _filled(wide, reasons).select(*df.columns)
    row = {"id": F.coalesce("id", F.lit("")), "pos": F.coalesce("pos", F.lit(-1).cast("bigint"))}
    narrow = cut(wide.select(row["id"].alias("id"), row["pos"].alias("pos"), F.col("drop_stage").isNotNull().alias("_was"), *[c for c in wide.columns if c[:1] == "_" and c != "_open"]))
    alive, dropped = narrow.filter("not _was"), []
    for k, s in enumerate(chain):
        if s.decide is None:
            code = F.col(f"_{k}_code")
            dropped.append(alive.filter(code.isNotNull()).select("id", "pos", F.lit(s.name).alias("stage"), code.alias("code"), F.col(f"_{k}_value").cast("double").alias("value"), none.cast("string").alias("by")))
            alive = alive.filter(code.isNull())
            continue
        mine = {c: c[len(f"_{k}_") :] for c in narrow.columns if c.startswith(f"_{k}_")}
        marks = cut(s.decide(alive.select("id", "pos", *[F.col(c).alias(name) for c, name in mine.items()]), df.withColumns(row)))
        dropped.append(marks.select("id", "pos", F.lit(s.name).alias("stage"), "code", F.col("value").cast("double").alias("value"), F.col("by").cast("string").alias("by")))
        if k + 1 < len(chain):
            alive = alive.join(marks.select("id", "pos"), ["id", "pos"], "left_anti")
    gone = reduce(DataFrame.unionByName, dropped).groupBy("id", "pos").agg(F.first(F.struct("stage", "code", "value", "by")).alias("_gone"))
    gone = gone.withColumnsRenamed({"id": "_id", "pos": "_pos"})
    out = df.join(gone, (row["id"] == F.col("_id")) & (row["pos"] == F.col("_pos")), "left")
    fill = lambda new, old: F.coalesce(F.col(old), F.col(f"_gone.{new}"))
    return out.withColumns({"drop_stage": fill("stage", "drop_stage"), "drop_code": fill("code", "drop_code"), "drop_value": fill("value", "drop_value"), "drop_by": fill("by", "drop_by")}).select(*df.columns)


def _filled(df: DataFrame, reasons: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Fill the reason columns of open rows with the first reason whose code isn't null."""
    none = F.col("drop_stage").isNull()
    pick = lambda i, old: F.when(none, F.coalesce(*[F.when(r[1].isNotNull(), r[i] if i else F.lit(r[0])) for r in reasons])).otherwise(F.col(old))
    return df.withColumns({"drop_stage": pick(0, "drop_stage"), "drop_code": pick(1, "drop_code"), "drop_value": pick(2, "drop_value"), "drop_by": pick(3, "drop_by")})


def _open_text(df: DataFrame, open_: Column) -> Column:
    return F.when(open_, core_text(df))


def length_gate(instruction: tuple[int, int] = (5, 4000), output: tuple[int, int] = (10, 8000)) -> Stage:
    """Inclusive bounds in code points. Of messages: the first user or human content, and all contents together."""

    def features(df: DataFrame, open_: Column) -> dict[str, Column]:
        has = F.coalesce(F.size("messages"), F.lit(0)) > 0
        asked = F.filter("messages", lambda m: m["role"].isin("user", "human"))
        first = F.coalesce(F.length(F.try_element_at(asked, F.lit(1))["content"]), F.lit(0))
        whole = F.aggregate("messages", F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
        size = lambda c: F.coalesce(F.length(c), F.lit(0))
        i, o = F.when(has, first).otherwise(size("instruction")), F.when(has, whole).otherwise(size("output"))
        code = F.when(~i.between(*instruction), F.lit("instruction_len")).when(~o.between(*output), F.lit("output_len"))
        return {"code": F.when(open_, code), "value": F.when(~i.between(*instruction), i).otherwise(o)}

    return Stage("length", features)


def copies(rows: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """rows (id, pos, key) whose key stands in several of them (or in seen), with lead (pos, id): the earliest of them, and
    old: whether seen has the key.

    Keys are counted before they are shuffled. Rows of a hot key, which may be a third of the table, meet their lead by a
    broadcast of the hot keys, at most one for every HOT rows; only the others are shuffled by key."""
    groups = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("pos", "id")).alias("lead"), F.count("*").alias("n"))
    if seen is not None:
        # Of what was seen before only keys of these rows are moved; few of them are looked up without a shuffle.
        groups = cut(groups)
        keys = groups.select(key)
        old = seen.select(F.col(seen.columns[0]).alias(key)).join(F.broadcast(keys) if groups.count() <= BROADCAST else keys, key, "left_semi").distinct()
        groups = groups.join(old.withColumn("old", F.lit(True)), key, "left")
    else:
        groups = groups.withColumn("old", F.lit(None).cast("boolean"))
    groups = cut(groups.filter((F.col("n") > 1) | F.col("old")))
    hot = groups.filter(F.col("n") > HOT).drop("n")
    few = groups.filter(F.col("n") <= HOT).drop("n")
    if hot.isEmpty():
        return rows.join(few, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(few, key))


def exact_dedup(history: DataFrame | None = None) -> Stage:
    """Keep the earliest open row of each fingerprint; history (hash) holds fingerprints of earlier runs, whose rows all
    are duplicates (duplicate for the later ones of this run, duplicate(resume) for the first)."""

    def decide(rows: DataFrame, _: DataFrame) -> DataFrame:
        met = copies(rows, "fp", history)
        later = F.struct("pos", "id") != F.col("lead")
        code = F.when(later, "duplicate").when(F.col("old"), "duplicate(resume)")
        return met.select("id", "pos", code.alias("code"), F.lit(None).alias("value"), F.col("lead.id").alias("by")).filter("code is not null")

    return Stage("exact_dedup", lambda df, open_: {"fp": T.fingerprint(_open_text(df, open_))}, decide)


def text_statistics(text: Column, n: int = 3, unit: str = "char") -> dict[str, Column]:
    found = T.measures(text, n, unit)
    return {"special_char_ratio": found["special"], "char_repetition": found["run"], "word_repetition": found["repeated"], "ngram_diversity": found["diversity"]}


def stats_gate(max_special: float = 0.3, max_char: float = 0.5, max_word: float = 0.5, min_diversity: float = 0.2, n: int = 3, unit: str = "char") -> Stage:
    """Gates in this order; the first that fails names the reason, its value rounded to 4 decimals."""

    def features(df: DataFrame, open_: Column) -> dict[str, Column]:
        gates = {"special_char_ratio": (max_special, 1), "char_repetition": (max_char, 1), "word_repetition": (max_word, 1), "ngram_diversity": (min_diversity, -1)}
        found = text_statistics(_open_text(df, open_), n, unit)
        fails = {k: (found[k] > limit) if side > 0 else (found[k] < limit) for k, (limit, side) in gates.items()}
        return {"code": F.coalesce(*[F.when(bad, F.lit(k)) for k, bad in fails.items()]), "value": F.coalesce(*[F.when(bad, F.round(found[k], 4)) for k, bad in fails.items()])}

    return Stage("stats", features)


def with_metrics(df: DataFrame, n: int = 3, unit: str = "char") -> DataFrame:
    """df with the statistics that its metadata keeps, rounded to 4 decimals, in metrics."""
    found = text_statistics(core_text(df), n, unit)
    named = {"special_char_ratio": F.round(found["special_char_ratio"], 4), "ngram_diversity": F.round(found["ngram_diversity"], 4)}
    return df.withColumn("metrics", F.struct(*[named.get(part.split(":")[0], F.lit(None)).alias(part.split(":")[0]) for part in METRIC_FIELDS]).cast(METRICS))


def band_shape(threshold: float, permutations: int) -> tuple[int, int]:
    """Bands and rows whose collision curve has the smallest sum of false positive and false negative areas."""
    x = (np.arange(1000) + 0.5) / 1000
    low, high = x[x < threshold], x[x >= threshold]
    shapes = ((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1))
    cost = lambda b, r: ((1 - (1 - low**r) ** b).sum() + ((1 - high**r) ** b).sum()) / 1000
    return min(shapes, key=lambda s: (round(cost(*s), 9), s))


def minhash_signatures(hashes: list[np.ndarray | None], permutations: int = 128) -> list[np.ndarray | None]:
    """Signatures of arrays of 64-bit shingle hashes: one multiply-shift minimum per permutation. An empty array has the
    signature of largest values, so all texts without shingles are alike."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    out = []
    for x in hashes:
        if x is None:
            out.append(None)
            continue
        least = np.full(permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(x), 2048):
            least = np.minimum(least, (x[i : i + 2048].view(np.uint64)[:, None] * a + b).min(0))
        out.append((least >> np.uint64(32)).astype(np.int64))
    return out


def signature(text: Column, permutations: int = 128, n: int = 3, unit: str = "char") -> Column:
    """MinHash signature of a text's shingles; null for null."""

    @F.pandas_udf("array<bigint>")
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series(minhash_signatures(T.hash_shingles([t if isinstance(t, str) else None for t in texts], n, unit), permutations), dtype=object)

    return sign(text)


def band_keys(sig: Column, threshold: float, permutations: int) -> Column:
    bands, rows = band_shape(threshold, permutations)
    return F.array(*[F.xxhash64(F.lit(b), F.slice(sig, b * rows + 1, rows)) for b in range(bands)])


#: Cells of the counts by which tokens are ordered; a power of two. The order changes the work, never the result.
CELLS = 1 << 18
#: Bytes of a token, whose highest four bits fall with its size, and tokens of one task that meets them, about.
TOKEN, MEETING = 6, 4_000_000
#: Bits of the sketch of a set, a multiple of 64.
BITS = 1024
#: Sets under one key up to which it is met alone, and heavier keys of a set of which each pair is one key.
HEAVY, PAIRED = 256, 32
#: Tokens that two close sets share among those that are emitted.
SHARED = 2


def size_class(n: np.ndarray) -> np.ndarray:
    """Class c holds the sizes over 2 ** c and up to 2 ** (c + 1), class 0 also 1."""
    return np.maximum(0, np.frexp(np.maximum(n, 1) - 0.5)[1].astype(np.int64) - 1)


def class_plan(n: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For sets of n shingles, class by class from their own upwards: which sets may meet larger ones of that class, the
    class, into how many parts it divides shingles, and how many tokens such a set emits.

    Sets of a and b >= a shingles that are at least threshold alike differ in (a + b) * (1 - t) / (1 + t) shingles at most, and
    b <= a / t. So they differ in as many parts at most, k, and in any order that all sets follow, the first SHARED tokens
    that both have are among the first k + SHARED of each."""
    apart, largest = (1 - threshold) / (1 + threshold), np.floor(n / threshold + 1e-9)
    own, out = size_class(n), []
    for up in range(int((size_class(largest) - own).max(initial=0)) + 1):
        top = np.exp2(own + up + 1)
        differ = np.floor((n + np.minimum(top, largest)) * apart + 1e-9).astype(np.int64)
        which = (n > 0) & (differ > 0) & (np.exp2(own + up) < largest if up else True)
        out.append((which, own + up, np.ceil(2.7 * apart * top).astype(np.int64) + 2 + SHARED, differ + SHARED))
    return out


_ODD = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


def set_tokens(sets: list[np.ndarray], threshold: float) -> list[tuple[list[int], bytes]]:
    """The tokens of sets of shingles, class by class: how many, and all of them by size, largest first.

    A class divides all shingles into parts by a hash; what a set has in a part is one token. Few tokens stand in sets that
    aren't close, because most hold several shingles. Empty parts come last, and only as many as are emitted."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    plan = class_plan(n, threshold)
    if len(sets) > 1 and max([int(parts[which].max(initial=1)).bit_length() for which, _, parts, _ in plan]) + len(sets).bit_length() > 32 or len(sets) > 4096:
        return set_tokens(sets[: len(sets) // 2], threshold) + set_tokens(sets[len(sets) // 2 :], threshold)
    flat = _mixed(np.concatenate([x.view(np.uint64) for x in sets])) if n.sum() else np.zeros(0, np.uint64)
    at = np.repeat(np.arange(len(sets)), n)
    ends, found = [[] for _ in sets], [[] for _ in sets]
    for which, kind, parts, emitted in plan:
        mine = which[at]
        x, doc = flat[mine], at[mine].astype(np.uint64)
        width = np.uint64(32 + int(parts[which].max(initial=1)).bit_length())
        part = ((x >> np.uint64(32)) * parts[at[mine]].astype(np.uint64)) >> np.uint64(32)
        x = np.sort(doc << width | part << np.uint64(32) | x & np.uint64(0xFFFFFFFF))
        if not len(x):
            continue
        cell = x >> np.uint64(32)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size, doc, part = np.diff(first, append=len(x)), x[first] >> width, cell[first] & ((np.uint64(1) << (width - np.uint64(32))) - np.uint64(1))
        whole = np.bitwise_xor.reduceat(_mixed(x & ((np.uint64(1) << width) - np.uint64(1))), first)
        name = lambda what, part, kind: _mixed(_mixed(what + part) + kind.astype(np.uint64)) >> np.uint64(20)
        token = (np.uint64(15) - np.minimum(size, 15).astype(np.uint64)) << np.uint64(44) | name(whole, part, kind[doc.astype(np.int64)])
        token = np.sort(doc << np.uint64(48) | token)
        many = np.bincount((token >> np.uint64(48)).astype(np.int64), minlength=len(sets))
        last = np.cumsum(many)
        raw = token.view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes()
        for i in np.flatnonzero(which):
            body, short = raw[TOKEN * (last[i] - many[i]) : TOKEN * last[i]], int(emitted[i] - many[i])
            if short > 0:
                free = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), part[doc == i])[:short]
                empty = np.uint64(15) << np.uint64(44) | name(np.zeros(len(free), np.uint64), free, np.full(len(free), kind[i]))
                body += empty.view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes()
            ends[i].append(len(body) // TOKEN)
            found[i].append(body)
    return [(e, b"".join(f)) for e, f in zip(ends, found)]


def token_sets(text: Column, threshold: float, n: int, unit: str) -> Column:
    """Struct of a text's shingle set: n its size, set its hash, tokens and many as set_tokens, bits a sketch of BITS bits in
    which every shingle sets one."""

    @F.pandas_udf("struct<n:int,set:bigint,many:array<int>,tokens:binary,bits:array<bigint>>")
    def made(texts: pd.Series) -> pd.DataFrame:
        sets = T.hash_shingles([t if isinstance(t, str) else None for t in texts], n, unit)
        there = [x for x in sets if x is not None]
        tokens = iter(set_tokens(there, threshold) if there else [])
        out = []
        for x in sets:
            if x is None:
                out.append((None, None, None, None, None))
                continue
            whole = np.bitwise_xor.reduce((x.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * _ODD[0]) if len(x) else np.uint64(0)
            out.append((len(x), int(whole.astype(np.int64)), *next(tokens), _sketch(x)))
        return pd.DataFrame(out, columns=["n", "set", "many", "tokens", "bits"]).astype({"n": "Int32", "set": "Int64"})

    return F.when(text.isNotNull(), made(text))


def _sketch(x: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(x.view(np.uint64) >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(bits).view(np.int64)


def may_be_alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether the sketches (n, bits) of two sets allow them to be threshold alike: a bit that only one of them has stands
    for a shingle at least that the other hasn't."""
    alone = lambda x, y: sum((F.bit_count(x["bits"][i].bitwiseAND(F.bitwise_not(y["bits"][i]))) for i in range(BITS // 64)), F.lit(0))
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (a["n"] + b["n"]) - 1e-9)
    return (a["n"] - alone(a, b) >= least) & (b["n"] - alone(b, a) >= least)


def _tokens(column: pa.Array) -> np.ndarray:
    """All tokens of a binary column, one after the other."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, TOKEN)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :TOKEN] = raw
    return wide.view(np.uint64)[:, 0]


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many tokens of sets (tokens) fall in each of CELLS cells. Every task sends one row per cell at most."""

    def count(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_cell(_tokens(batch.column(0))), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "texts": total[at]})

    got = sets.select("tokens").mapInArrow(count, "cell int, texts bigint").groupBy("cell").agg(F.sum("texts").alias("texts")).toArrow()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[got["cell"].to_numpy()] = got["texts"].to_numpy()
    return counts


def exact_keys(sets: DataFrame, threshold: float, heavy: int = HEAVY) -> DataFrame:
    """sets (set, n, many, tokens: token_sets), each set once, to (set, keys), only sets that share keys: all pairs at least
    threshold alike share one.

    A set emits its rarest tokens, as many as class_plan says, so that close sets share SHARED of them. Tokens of one task
    for another are moved as one block of bytes. Tokens that one set alone has go no farther. Sets that
    share only tokens of more than heavy sets share a pair of these."""
    spark, counts = sets.sparkSession, token_counts(sets)
    usual = counts.mean() + 6 * counts.mean() ** 0.5 + 8
    level = spark.sparkContext.broadcast(np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / usual))).astype(np.int64))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // MEETING))

    def emit(batches):
        for batch in batches:
            names, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            plan = class_plan(n, threshold)
            takes = np.array([t for row in zip(*[np.where(w, e, 0) for w, _, _, e in plan]) for t in row if t], dtype=np.int64)
            many = batch.column(2).flatten().to_numpy().astype(np.int64)
            tokens = _tokens(batch.column(3))
            if not len(tokens):
                continue
            group = np.repeat(np.arange(len(many)), many)
            order = np.argsort(group << 6 | level.value[_cell(tokens)], kind="stable")
            rank = np.arange(len(tokens)) - np.repeat(np.cumsum(many) - many, many)
            taken = rank < takes[group]
            tokens, doc = tokens[order[taken]], np.repeat(np.arange(len(n)), [len(x) for x in batch.column(2).to_pylist()])[group[taken]]
            task = (_mixed(tokens) >> np.uint64(32)).astype(np.int64) % tasks
            order = np.argsort(task, kind="stable")
            task, tokens, doc = task[order], tokens[order], doc[order]
            begins = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            rows = {"task": task[begins].astype(np.int32), "names": [], "counts": [], "tokens": []}
            for a, b in zip(begins, np.append(begins[1:], len(task))):
                start = np.flatnonzero(np.append(True, doc[a + 1 : b] != doc[a : b - 1]))
                rows["names"].append(names[doc[a:b][start]].tobytes())
                rows["counts"].append(np.diff(start, append=b - a).astype(np.int32).tobytes())
                rows["tokens"].append(tokens[a:b].view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes())
            yield pa.RecordBatch.from_pydict(rows)

    def meet(batches):
        names, tokens = [], []
        for batch in batches:
            if batch.num_rows:
                ids, counts = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=kind) for i, kind in ((1, np.int64), (2, np.int32)))
                names.append(np.repeat(ids, counts))
                tokens.append(_tokens(batch.column(3)))
        if not names:
            return
        names, tokens = np.concatenate(names), np.concatenate(tokens)
        order = np.argsort(tokens)
        tokens = tokens[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        size = np.diff(first, append=len(tokens))
        size = np.repeat(size, size)
        several = size > 1
        table = pa.table({"set": names[order[several]], "key": tokens[several].astype(np.int64), "sets": size[several]})
        yield from table.to_batches(max_chunksize=10_000)

    blocks = sets.select("set", "n", "many", "tokens").mapInArrow(emit, "task int, names binary, counts binary, tokens binary")
    met = blocks.repartitionById(tasks, "task").mapInArrow(meet, "set bigint, key bigint, sets bigint")
    each = met.groupBy("set").agg(F.collect_set(F.struct("key", "sets")).alias("met")).filter(F.size("met") >= SHARED)
    plain = F.transform(F.filter("met", lambda x: x["sets"] <= heavy), lambda x: x["key"])
    hot = F.array_sort(F.transform(F.filter("met", lambda x: x["sets"] > heavy), lambda x: x["key"]))
    paired = F.flatten(F.transform("hot", lambda x: F.transform(F.filter("hot", lambda y: y > x), lambda y: F.xxhash64(x, y))))
    each = each.select("set", plain.alias("plain"), hot.alias("hot"))
    return each.select("set", F.concat("plain", F.when(F.size("hot") <= PAIRED, paired).otherwise(F.col("hot"))).alias("keys"))


def minhash_dedup(threshold: float = 0.8, permutations: int = 128, n: int = 5, unit: str = "word", verify: bool = True, history: DataFrame | None = None) -> Stage:
    """Near-duplicates, earliest first. verify finds every pair of shingle sets at least threshold alike: candidates share
    groups of shingles (exact_keys) and the sets themselves are compared. Without it any shared band of the MinHash signature
    drops, also one of history (sample_id, sig), the signatures stored by earlier runs, of which those of another length
    take no part. Rows of equal sets are one row here, so copies are not paired. Texts without shingles share the empty
    set and are alike."""
    if history is not None and verify:
        raise ValueError("stored signatures are compared by bands, so they need verify=False")

    def features(df: DataFrame, open_: Column) -> dict[str, Column]:
        text = _open_text(df, open_)
        if verify:
            found = token_sets(text, threshold, n, unit)
            return {k: found[k] for k in ("n", "set", "many", "tokens", "bits")}
        sig = signature(text, permutations, n, unit)
        return {"set": F.when(sig.isNotNull(), F.xxhash64(sig)), "keys": F.when(sig.isNotNull(), band_keys(sig, threshold, permutations))}

    def decide(rows: DataFrame, df: DataFrame) -> DataFrame:
        # One row of each set goes through the rounds, under the set's hash.
        again = cut(copies(rows.select("id", "pos", "set"), "set").filter(F.struct("pos", "id") != F.col("lead")).select("id", "pos", "set", F.col("lead.id").alias("lead")))
        copied = again.select("id", "pos")
        lead = rows.filter("set is not null").join(F.broadcast(copied) if copied.count() <= BROADCAST else copied, ["id", "pos"], "left_anti")
        at = F.struct("pos", "id").alias("at")
        stored = None
        if verify:
            # Pairs are sorted out by their sketches; only sets of the pairs left are made once more and compared.
            keys = cut(exact_keys(lead.select("set", "n", "many", "tokens"), threshold))
            keys = F.broadcast(keys.select("set", "keys")) if keys.count() <= BROADCAST // 10 else keys
            meeting = lead.select("set", at, F.struct("n", "bits").alias("what")).join(keys, "set").select(F.col("set").alias("id"), "at", "keys", "what")
            alike = lambda x, y: may_be_alike(x, y, threshold)
            exact = lambda pairs: close_sets(pairs, lead.select("id", "pos", "set"), df, threshold, n, unit)
        else:
            if history is not None:
                old = history.filter(F.size("sig") == permutations).select("sample_id", F.explode(band_keys(F.col("sig"), threshold, permutations)).alias("key"))
                met = lead.select("set", F.explode("keys").alias("key")).join(old.groupBy("key").agg(F.min("sample_id").alias("by")), "key")
                stored = cut(met.groupBy("set").agg(F.min("by").alias("by")))
                lead = lead.join(stored.select("set"), "set", "left_anti")
            meeting = lead.select(F.col("set").alias("id"), at, "keys", F.lit(None).cast("array<bigint>").alias("what"))
            alike, exact = lambda x, y: F.lit(True), None
        gone = cut(first_wins(meeting, alike, HEAVY if verify else GROUP, exact).filter("not kept").select(F.col("id").alias("set"), F.col("by").alias("other")))
        others = gone.select("other").distinct()
        named = lead.select(F.col("set").alias("other"), F.col("id").alias("by")).join(F.broadcast(others) if gone.count() <= BROADCAST else others, "other", "left_semi")
        verdict = gone.join(named, "other").select("set", "by")
        if stored is not None:
            verdict = verdict.unionByName(stored)
        verdict = cut(verdict)
        # A copy goes to where the first of its kind went, or to that one. Few sets are dropped, so they are met first.
        far = again.join(verdict, "set", "left").select("id", "pos", F.coalesce("by", "lead").alias("by"))
        near = rows.select("id", "pos", "set").join(verdict, "set").join(copied, ["id", "pos"], "left_anti").select("id", "pos", "by")
        return far.unionByName(near).select("id", "pos", F.lit("near_dup").alias("code"), F.lit(None).alias("value"), "by")

    return Stage("minhash_dedup", features, decide)


def shingle_sets(text: Column, n: int, unit: str) -> Column:
    """Distinct hashes of the shingles of a text, sorted."""

    @F.pandas_udf("array<bigint>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(T.hash_shingles([t if isinstance(t, str) else None for t in texts], n, unit), dtype=object)

    return made(text)


def close_sets(pairs: DataFrame, named: DataFrame, df: DataFrame, threshold: float, n: int, unit: str) -> DataFrame:
    """The pairs (id, other) of sets that are at least threshold alike; named (id, pos, set) says which row has a set."""
    ids = cut(pairs.select("id").union(pairs.select("other")).distinct().withColumnRenamed("id", "set"))
    few = ids.count() <= BROADCAST
    wanted = named.join(F.broadcast(ids) if few else ids, "set")
    wanted = cut(wanted.groupBy("id", "pos").agg(F.first("set").alias("set")))
    texts = df.select("id", "pos", core_text(df).alias("text")).join(F.broadcast(wanted) if few else wanted, ["id", "pos"])
    sets = cut(texts.select(F.col("set").alias("id"), shingle_sets(F.col("text"), n, unit).alias("what")).dropDuplicates(["id"]))
    both = pairs.join(sets, "id").join(sets.withColumnsRenamed({"id": "other", "what": "other_what"}), "other")
    return both.filter(_jaccard(F.col("what"), F.col("other_what")) >= threshold).select("id", "other")


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


#: Vectors on which the blocks' centres are fitted, and blocks at most (a centre of 64 numbers has 512 bytes, so 10 MB).
CENTRE_SAMPLE, BLOCKS = 20_000, 20_000


def _block_centres(rows: DataFrame, blocks: int, n: int) -> np.ndarray:
    """Centres of at most blocks compact groups of vectors, fitted on a bounded sample."""
    wanted = min(CENTRE_SAMPLE, n)
    limit = int(-(1 << 63) + min(1.0, 1.5 * wanted / n) * ((1 << 64) - 1))
    h = F.xxhash64("id")
    part = rows.filter(h <= F.lit(min(limit, (1 << 63) - 1))).orderBy(h, "id").limit(wanted).select("vec").toPandas()
    sample = _unit(np.array(part["vec"].tolist(), dtype=np.float64))
    centres = sample[np.random.default_rng(0).choice(len(sample), min(blocks, BLOCKS, max(1, len(sample) // 8)), replace=False)]
    for _ in range(5):
        at = np.concatenate([(sample[k : k + 2048] @ centres.T).argmax(1) for k in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def block_pairs(rows: DataFrame, threshold: float, block: int, n: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, vec) with their block b, and the pairs of blocks (i, j, i <= j) of which two vectors may be threshold
    alike: the angle between two vectors is at least that between the centres of their blocks less the blocks' radii."""
    spark, blocks = rows.sparkSession, max(1, -(-n // block))
    centres = _block_centres(rows, blocks, n)

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(vecs: pd.Series) -> pd.DataFrame:
        cos = _unit(np.array(vecs.tolist(), dtype=np.float64)) @ centres.T
        cell = cos.argmax(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))})

    placed = rows.withColumn("c", nearest("vec")).select(*rows.columns, "c.*")
    # A group larger than a block is cut into parts by a hash.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = cut(placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"))
    found = placed.groupBy("cell", "part").agg(F.max("angle").alias("radius")).orderBy("cell", "part").toPandas()
    found["b"] = np.arange(len(found), dtype=np.int32)
    cells, radius, limit = found["cell"].to_numpy(), found["radius"].to_numpy(), math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def partners(frames):
        for pdf in frames:
            for i in pdf["id"]:
                apart = np.arccos(np.clip(centres[cells[i:]] @ centres[cells[i]], -1, 1))
                j = i + np.flatnonzero(apart - radius[i:] - radius[i] <= limit)
                yield pd.DataFrame({"i": np.full(len(j), i, dtype=np.int32), "j": j.astype(np.int32)})

    named = spark.createDataFrame(found[["cell", "part", "b"]], "cell int, part int, b int")
    return placed.join(F.broadcast(named), ["cell", "part"]).drop("cell", "part", "angle"), spark.range(len(found)).mapInPandas(partners, "i int, j int")


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(id, other, cosine) of vectors (id, at, vec) and earlier ones at least threshold alike, in compact blocks.

    Exact: pairs of blocks too far apart for any pair of their vectors are left out, blocks of the others are multiplied
    as matrices, and only pairs over the threshold leave a task. Vectors are compared in double precision."""
    rows = cut(vectors.select("id", "at", F.transform("vec", lambda x: x.cast("double")).alias("vec")))
    n = rows.count()
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"id {kinds['id']}, other {kinds['id']}, cosine double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    placed, pairs = block_pairs(rows, threshold, block, n)
    touched = pairs.select(F.col("i").alias("b"), "i", "j").unionByName(pairs.filter("i <> j").select(F.col("j").alias("b"), "i", "j"))
    spread = placed.join(touched, "b")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        m = _unit(np.array(pdf["vec"].tolist(), dtype=np.float64))
        left, right = np.flatnonzero(pdf["b"].to_numpy() == i), np.flatnonzero(pdf["b"].to_numpy() == j)
        cos = m[left] @ m[right].T
        a, b = np.nonzero(cos >= threshold)
        ids, at, value = pdf["id"].to_numpy(), pdf["at"].to_numpy(), cos[a, b]
        a, b = left[a], right[b]
        later = at[a] > at[b]
        keep = (at[a] != at[b]) & (later | (i != j))
        first, second = np.where(later, a, b)[keep], np.where(later, b, a)[keep]
        return pd.DataFrame({"id": ids[first], "other": ids[second], "cosine": value[keep]})

    return spread.groupBy("i", "j").applyInPandas(multiply, schema)


Vectors = Callable[[DataFrame], DataFrame]


def stand_in_vectors(texts: DataFrame) -> DataFrame:
    """texts (h, text) to (h, vec) by the deterministic stand-in for an embedding model."""

    @F.pandas_udf("array<double>")
    def embed(t: pd.Series) -> pd.Series:
        return pd.Series([bag_vector(x) for x in t], dtype=object)

    return texts.select("h", embed("text").alias("vec"))


def _embedded(rows: DataFrame, df: DataFrame, vectors: Vectors) -> DataFrame:
    """rows (id, pos, h) as (id: of row, at: total order, vec); a text that several rows share is embedded once."""
    source = df.select(T.fingerprint(core_text(df)).alias("h"), core_text(df).alias("text"))
    wanted = source.join(rows.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    made = cut(vectors(wanted))
    at = F.concat(F.lpad((F.col("pos") + F.lit(1 << 62)).cast("string"), 20, "0"), F.lit("|"), "id")
    return cut(rows.join(made, "h").select("id", "pos", at.alias("at"), "vec"))


def _by_text(df: DataFrame, open_: Column) -> dict[str, Column]:
    return {"h": T.fingerprint(_open_text(df, open_))}


def semantic_kept(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """vectors (id, at, vec) to (id, kept, by): dropped if a kept earlier vector is at least threshold alike, by the first
    such. Null vectors are kept."""
    usable = cut(vectors.filter("vec is not null"))
    pairs = cut(cosine_pairs(usable, threshold))
    verdict = cut(resolve_pairs(usable, pairs))
    kept = verdict.filter("kept").select(F.col("id").alias("other")).join(usable.select(F.col("id").alias("other"), "at"), "other")
    by = pairs.join(kept, "other").groupBy("id").agg(F.min_by("other", "at").alias("by"))
    out = vectors.select("id").join(verdict, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(True))).join(by, "id", "left")
    return out.select("id", "kept", F.when(~F.col("kept"), F.col("by")).alias("by"))


def semantic_dedup(threshold: float = 0.85, vectors: Vectors = stand_in_vectors) -> Stage:
    """Drop a row whose text's vector is at least threshold alike to that of a kept earlier row. Exact, in blocks."""

    def decide(rows: DataFrame, df: DataFrame) -> DataFrame:
        embedded = _embedded(rows, df, vectors)
        named = embedded.select(F.col("at").alias("id"), "at", "vec")  # at names the row, whatever repeats its id
        by = F.expr("substring(by, instr(by, '|') + 1)")
        gone = semantic_kept(named, threshold).filter("not kept").select(F.col("id").alias("at"), by.alias("by"))
        return embedded.join(gone, "at").select("id", "pos", F.lit("cosine_dup").alias("code"), F.lit(None).alias("value"), "by")

    return Stage("semantic_dedup", _by_text, decide)


def hyperplanes(dimensions: int, planes: int = 8, seed: int = 0) -> list[list[float]]:
    """Normal vectors drawn uniformly from [-1, 1] in the order of the standard generator."""
    draw = random.Random(seed)
    return [[draw.uniform(-1, 1) for _ in range(dimensions)] for _ in range(max(1, min(planes, dimensions)))]


def sign_bucket(vec: Column, planes: list[list[float]]) -> Column:
    bits = [F.when(T.dot(vec, F.array(*map(F.lit, p))) >= 0, "0").otherwise("1") for p in planes]
    return F.concat(*bits)


#: Hyperplanes at most, so that there are at most 2 ** PLANES anchors to broadcast.
PLANES = 12


def cluster_kept(vectors: DataFrame, threshold: float = 0.9, planes: int = 8) -> DataFrame:
    """vectors (id, at, vec) to (id, bucket, anchor, kept): in each sign bucket the earliest vector is the anchor, and
    others at least threshold alike to it are dropped. Anchors are pre-aggregated, so a hot bucket stays spread; there
    are at most 2 ** planes, which is broadcast up to PLANES planes and shuffled beyond."""
    first = vectors.filter("vec is not null").select(F.size("vec").alias("n")).limit(1).first()
    normals = hyperplanes(first.n if first else 1, planes)
    rows = vectors.select("id", "at", F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("bucket", sign_bucket(F.col("vec"), normals))
    anchors = rows.groupBy("bucket").agg(F.min_by(F.struct("id", "at", "vec"), "at").alias("a")).select("bucket", F.col("a.id").alias("anchor"), F.col("a.vec").alias("anchor_vec"))
    joined = rows.join(F.broadcast(anchors) if len(normals) <= PLANES else anchors, "bucket", "left")
    alike = (F.col("id") != F.col("anchor")) & (T.cosine(F.col("vec"), F.col("anchor_vec")) >= threshold)
    return joined.select("id", "bucket", "anchor", (~F.coalesce(alike, F.lit(False))).alias("kept"))


def cluster_dedup(threshold: float = 0.9, planes: int = 8, vectors: Vectors = stand_in_vectors) -> Stage:
    """Drop rows whose text's vector is at least threshold alike to the earliest of their sign bucket."""

    def decide(rows: DataFrame, df: DataFrame) -> DataFrame:
        embedded = _embedded(rows, df, vectors)
        gone = cluster_kept(embedded.select(F.col("at").alias("id"), "at", "vec"), threshold, planes).filter("not kept")
        gone = gone.select(F.col("id").alias("at"), F.expr("substring(anchor, instr(anchor, '|') + 1)").alias("by"))
        return embedded.join(gone, "at").select("id", "pos", F.lit("crowded_cluster").alias("code"), F.lit(None).alias("value"), "by")

    return Stage("cluster_dedup", _by_text, decide)


REGISTRY: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {"length": length_gate, "exact_dedup": exact_dedup, "stats": stats_gate, "minhash_dedup": minhash_dedup, "semantic_dedup": semantic_dedup, "cluster_dedup": cluster_dedup}


def register(name: str, stage: Callable[..., Callable[[DataFrame], DataFrame]]) -> None:
    """Add a stage of one's own; built-in names stay."""
    REGISTRY.setdefault(name, stage)


def pipeline(*stages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The stages in their order; neighbouring Stages share one scan."""

    def run(df: DataFrame) -> DataFrame:
        df, chain = opened(df), []
        for s in (*stages, None):
            if isinstance(s, Stage):
                chain.append(s)
                continue
            if chain:
                df, chain = _run(df, chain), []
            if s is not None:
                df = s(df)
        return df

    return run


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows of one result, written once so that it isn't computed twice."""
    done = cut(df)
    return done.filter("drop_stage is null").drop(*DROPS), done.filter("drop_stage is not null")


__all__ = ["REGISTRY", "Stage", "cluster_dedup", "cluster_kept", "cosine_pairs", "exact_dedup", "length_gate", "minhash_dedup", "pipeline", "register", "semantic_dedup", "semantic_kept", "split", "stats_gate"]
