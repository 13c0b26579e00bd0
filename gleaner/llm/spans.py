"""Problem 10: spans of at least MIN_SPAN characters found verbatim in more than one document.

1. Anchors. Each document is winnowed: of every window of MIN_SPAN characters the smallest GRAM-gram hash is selected, so
   two documents that share a span of MIN_SPAN characters share an anchor inside it. About 2 % of positions are anchors.
2. Routing. Only anchors seen in two documents go on, with the text around them: everything that a span of MIN_SPAN
   characters over the anchor can touch. Equal windows are one row, however many documents hold them.
3. Matching statistics. Windows are sharded by anchor. Each shard is indexed by a compressed FM-index (Burrows-Wheeler
   transform in a wavelet matrix of packed bits); every window is streamed backwards through it, keeping the interval of
   suffixes that occur in another document, and the intervals of at least MIN_SPAN characters are reported.
4. An anchor with more than HOT windows is not given to one shard: all its sub-spans of MIN_SPAN characters are counted
   by key instead, which is exact and spreads over the cluster.

Spans count when another document holds them; a repeat inside one document does not. Null, empty and short texts share
nothing. A document id should be unique; rows repeating it count as the same document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tables import cut, table

MIN_SPAN, GRAM = 200, 100
#: Distinct windows of one anchor beyond which it takes the counted path; characters in an index shard.
HOT, SHARD_CHARS = 4_000, 1_000_000
#: Rows up to which anchors, document ids and found intervals are broadcast; documents from which a window is hot.
BROADCAST, HOT_DOCS = 2_000_000, 50_000
#: Characters hashed at once; positions fit the low bits of a packed value.
_POS_BITS = 24
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n-gram of code points, by doubling."""
    level, width, out, done = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, None, 0
    size = len(codes) - n + 1
    while width <= n:
        if n & width:
            # The parts already joined stand to the left of those to come.
            out = level[:size].copy() if out is None else out * _power(width) + level[done : done + size]
            done += width
        if width * 2 <= n:
            level = level[:-width] * _power(width) + level[width:]
        width *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def anchors(codes: np.ndarray, span: int = MIN_SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text of at least span code points."""
    hashes = gram_hashes(codes, gram)
    low = np.uint64((1 << _POS_BITS) - 1)
    least, width, reach = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1, span - gram + 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := reach - width:
        least = np.minimum(least[:-rest], least[rest:])
    at = np.unique(least & low).astype(np.int64)
    return at, hashes[at].view(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def text_anchors(text: str, span: int = MIN_SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text of any length, in overlapping blocks."""
    codes, ats, hashes = code_points(text), [], []
    for start in range(0, max(1, len(codes) - span + 1), _BLOCK):
        part = codes[start : start + _BLOCK + span - 1]
        if len(part) >= span:
            at, h = anchors(part, span, gram)
            ats.append(at + start)
            hashes.append(h)
    if not ats:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, first = np.unique(np.concatenate(ats), return_index=True)
    return at, np.concatenate(hashes)[first]


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks and LCP array (LCP[r] of ranks r-1 and r) of codes, compared to depth characters."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    step = max(1, 62 // bits)
    packed = np.zeros(n, dtype=np.int64)
    for k in range(step):
        packed <<= bits
        packed[: max(0, n - k)] |= codes[k:]
    ranks, widths = [], []
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = step
    while True:
        ranks.append(rank.astype(np.int32))
        widths.append(width)
        if width >= depth:
            break
        second = np.zeros(n, dtype=np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, width = new, width * 2
    order = np.argsort(rank, kind="stable")
    position = np.empty(n, dtype=np.int64)
    position[order] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, dtype=np.int32)
    for r, w in zip(reversed(ranks), reversed(widths)):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = r[a[inside]] == r[b[inside]]
        shared[same] += w
        a[same] += w
        b[same] += w
    for k in range(step):  # what is left is shorter than the first width
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = codes[a[inside]] == codes[b[inside]]
        shared[same] += 1
        a[same] += 1
        b[same] += 1
        a[~same] = n
    return order, position, np.concatenate([[-1], shared, [-1]]).astype(np.int32)


class WaveletMatrix:
    """Rank over a sequence of small integers, in packed bits with a count for every 64."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            bit = (current >> level & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)])[:-1].astype(np.int32))
            self.zeros.append(int(self.n - ones.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair: occurrences of the symbol before the position, plus those of smaller ones in its class; only
        differences of two positions for the same symbol mean something together with starts()."""
        at = at.copy()
        for k in range(self.bits):
            word, inside = at >> 6, (at & 63).astype(np.uint64)
            below = self.words[k][word] & ((np.uint64(1) << inside) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            bit = symbols >> (self.bits - 1 - k) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def occurrences(self, symbols: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.ranks(symbols, at) - starts[symbols]

    def starts(self, size: int) -> np.ndarray:
        return self.ranks(np.arange(size), np.zeros(size, dtype=np.int64))


class ShardIndex:
    """FM-index of windows, each with the one document that holds it, or none if several do."""

    def __init__(self, texts: list[str], docs: np.ndarray, several: np.ndarray, span: int):
        parts = [code_points(t) for t in texts]
        self.span, self.lengths = span, np.array([len(p) for p in parts])
        self.base = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        joined = np.zeros(int((self.lengths + 1).sum()), dtype=np.int64)
        for b, p in zip(self.base, parts):
            joined[b : b + len(p)] = p.astype(np.int64) + 1
        alphabet, codes = np.unique(joined, return_inverse=True)  # 0 ends a window
        self.codes, depth = codes.astype(np.int64), int(self.lengths.max()) + 1
        order, self.position, self.lcp = suffix_order(self.codes, depth)
        self.n = n = len(codes)
        bwt = self.codes[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(alphabet)))[:-1]])
        self.matrix = WaveletMatrix(bwt, max(1, (len(alphabet) - 1).bit_length()))
        self.starts = self.matrix.starts(len(alphabet))
        # Nearest rank below and above with another document; a window of several documents differs from all.
        holder = np.repeat(np.where(several, -1 - np.arange(len(texts)), docs), self.lengths + 1)
        alone = np.repeat(several, self.lengths + 1)[order]
        changes = np.concatenate([[True], np.diff(holder[order]) != 0]) | alone
        changes[1:] |= alone[:-1]
        start = np.maximum.accumulate(np.where(changes, np.arange(n), 0))
        self.below = start - 1
        ends = np.where(np.append(changes[1:], True), np.arange(n), n)
        self.above = np.minimum.accumulate(ends[::-1])[::-1] + 1
        self.least = [np.maximum(self.lcp, 0).astype(np.int16)]
        while 1 << len(self.least) <= len(self.lcp):
            k, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[: len(last) - k], last[k:]))

    def _widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all suffixes that share their first depth characters with those in [low, high)."""
        low, high = low.copy(), high.copy()
        for k in range(len(self.least) - 1, -1, -1):
            size, row = 1 << k, self.least[k]
            at = low - size + 1
            ok = at >= 1
            ok[ok] = row[at[ok]] >= depth[ok]
            low[ok] -= size
            ok = high + size <= self.n
            ok[ok] = row[high[ok]] >= depth[ok]
            high[ok] += size
        return low, high

    def shared(self, windows: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, start, end) of the maximal intervals of at least span characters that another document holds, for
        windows held by one document each."""
        found: list[tuple[int, int, int]] = []
        q = np.asarray(windows, dtype=np.int64)
        at = self.lengths[q] - 1
        low, high, size = np.zeros(len(q), np.int64), np.full(len(q), self.n, np.int64), np.zeros(len(q), np.int64)

        def report(who: np.ndarray) -> None:
            for w, i, s in zip(q[who].tolist(), at[who].tolist(), size[who].tolist()):
                found.append((w, i + 1, i + 1 + s))

        while len(q):
            # A window whose rest is too short for a span is done.
            live = (at >= 0) & (at + 1 + size >= self.span)
            if not live.all():
                report(~live & (size >= self.span))
                q, at, low, high, size = q[live], at[live], low[live], high[live], size[live]
                if not len(q):
                    break
            own = self.base[q] + at
            symbols, rank = self.codes[own], self.position[own]
            below = self.first[symbols] + self.matrix.occurrences(symbols, low, self.starts)
            above = self.first[symbols] + self.matrix.occurrences(symbols, high, self.starts)
            fits = (self.below[rank] >= below) | (self.above[rank] < above)
            report(~fits & (size >= self.span))
            stuck = ~fits & (size == 0)
            low, high = np.where(fits, below, low), np.where(fits, above, high)
            size = np.where(fits, size + 1, size)
            at = np.where(fits | stuck, at - 1, at)
            shrink = np.flatnonzero(~fits & ~stuck)
            if len(shrink):
                depth = np.maximum(np.maximum(self.lcp[low[shrink]], self.lcp[high[shrink]]), 0).astype(np.int64)
                # Own occurrence alone: the parent interval is the deepest one that holds more suffixes.
                low[shrink], high[shrink] = self._widen(low[shrink], high[shrink], depth)
                whole = shrink[depth == 0]
                low[whole], high[whole] = 0, self.n
                size[shrink] = depth
        return found


_CELL = "anchor long, window_key long, start int, end int"


def _search_shard(span: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        several = (pdf["least_doc"] != pdf["last_doc"]).to_numpy()
        rows = [(i, 0, len(t)) for i, t in enumerate(pdf["text"]) if several[i]]
        # One window of an anchor has nothing to be compared with.
        asked = ~several & (pdf.groupby("anchor")["anchor"].transform("size") > 1).to_numpy()
        if asked.any():
            index = ShardIndex(list(pdf["text"]), pdf["least_doc"].to_numpy(np.int64), several, span)
            rows += index.shared(np.flatnonzero(asked))
        out = pd.DataFrame(rows, columns=["i", "start", "end"])
        out["anchor"] = pdf["anchor"].to_numpy()[out["i"]]
        out["window_key"] = pdf["window_key"].to_numpy()[out["i"]]
        return out[["anchor", "window_key", "start", "end"]]

    return search


def _hot_spans(hot: DataFrame, span: int) -> DataFrame:
    """Sub-spans of hot windows that several documents hold, by counting keys."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                h = gram_hashes(code_points(row.text), span).view(np.int64)
                yield pd.DataFrame({"anchor": row.anchor, "window_key": row.window_key, "least_doc": row.least_doc, "last_doc": row.last_doc, "start": np.arange(len(h), dtype=np.int32), "key": h})

    cells = hot.mapInPandas(keys, "anchor long, window_key long, least_doc long, last_doc long, start int, key long")
    shared = cells.groupBy("anchor", "key").agg(F.min("least_doc").alias("a"), F.max("last_doc").alias("b")).filter("a <> b").select("anchor", "key")
    return cells.join(shared, ["anchor", "key"], "left_semi").select("anchor", "window_key", "start", (F.col("start") + span).alias("end"))


def _small(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def _meet(windows: DataFrame, cells: DataFrame, hot: DataFrame) -> DataFrame:
    """windows with their cells. Few cells are broadcast; of many, those of hot windows (at most one for every HOT_DOCS
    windows), which a third of the documents may hold, and only the other windows are shuffled by their key."""
    on = ["anchor", "window_key"]
    if cells.count() <= BROADCAST:
        return windows.join(F.broadcast(cells), on)
    spread = windows.join(F.broadcast(cells.join(F.broadcast(hot), on, "left_semi")), on)
    return spread.unionByName(windows.join(F.broadcast(hot), on, "left_anti").join(cells, on))


def shared_spans(docs: DataFrame, span: int = MIN_SPAN, gram: int = GRAM, hot: int = HOT, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id long, text) to rows (doc_id, start, end): stretches of each document, in code points, every span of which
    lies in another document too. Stretches of one document can overlap."""
    docs = docs.select("doc_id", "text").filter(F.length("text") >= span)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [text_anchors(t, span, gram) for t in pdf["text"]]
            if found:
                ids = np.repeat(pdf["doc_id"].to_numpy(), [len(a) for a, _ in found])
                yield pd.DataFrame({"doc_id": ids, "at": np.concatenate([a for a, _ in found]), "anchor": np.concatenate([h for _, h in found])})

    all_anchors = cut(docs.mapInPandas(find, "doc_id long, at int, anchor long"))
    shared = cut(all_anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("anchor"))
    places = cut(all_anchors.join(_small(shared), "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("at", "anchor")).alias("places")))
    # Only texts of documents with a shared anchor are moved.
    docs = docs.join(_small(places.select("doc_id")), "doc_id", "left_semi")

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = span - gram
        for pdf in batches:
            rows = []
            for doc, text, spots in zip(pdf["doc_id"], pdf["text"], pdf["places"]):
                for spot in spots:
                    begin = max(0, spot["at"] - left)
                    window = text[begin : spot["at"] + span]
                    if len(window) >= span:
                        rows.append((spot["anchor"], doc, begin, window))
            yield pd.DataFrame(rows, columns=["anchor", "doc_id", "begin", "text"])

    windows = cut(
        docs.join(places, "doc_id")
        .mapInPandas(around, "anchor long, doc_id long, begin int, text string")
        .withColumn("window_key", F.xxhash64("text"))
    )
    distinct = windows.groupBy("anchor", "window_key").agg(F.min("doc_id").alias("least_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("holders"), F.first("text").alias("text"))
    distinct = cut(distinct)
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    hot_anchors = sizes.filter(F.col("n") > hot).select("anchor")
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_chars))
    cells = (
        distinct.join(hot_anchors, "anchor", "left_anti")
        .groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
        .applyInPandas(_search_shard(span), _CELL)
        .unionByName(_hot_spans(distinct.join(hot_anchors, "anchor", "left_semi"), span))
    )
    met = _meet(windows.select("anchor", "window_key", "doc_id", "begin"), cut(cells), distinct.filter(F.col("holders") > HOT_DOCS).select("anchor", "window_key"))
    return met.select("doc_id", (F.col("begin") + F.col("start")).alias("start"), (F.col("begin") + F.col("end")).alias("end"))


def _covered(spans: DataFrame) -> DataFrame:
    """Distinct stretches merged per document: doc_id, n_spans, shared_chars. A document's stretches are bounded by its
    own length."""
    ordered = F.array_sort(F.collect_set(F.struct("start", "end")))
    merged = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(-1).alias("reach")),
        lambda m, s: F.struct(
            (m["n"] + F.when(s["start"] > m["reach"], 1).otherwise(0)).alias("n"),
            (m["chars"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], m["reach"]))).alias("chars"),
            F.greatest(s["end"], m["reach"]).alias("reach"),
        ),
    )
    return spans.groupBy("doc_id").agg(merged.alias("m")).select("doc_id", F.col("m.n").alias("n_spans"), F.col("m.chars").alias("shared_chars"))


def found(spark: SparkSession, root: str) -> DataFrame:
    """p10_found: doc_id of documents that share a span of 200 characters with another."""
    return shared_spans(table(spark, root, "documents")).select("doc_id").distinct()


def shared_parts(spark: SparkSession, root: str) -> DataFrame:
    """p10_shared: for every document with a shared span: n_spans, shared_chars, n_chars, shared_share."""
    docs = table(spark, root, "documents")
    lengths = docs.select("doc_id", F.length("text").alias("n_chars"))
    return _covered(shared_spans(docs)).join(lengths, "doc_id").withColumn("shared_share", F.col("shared_chars") / F.col("n_chars"))


QUERIES = {"p10_found": found, "p10_shared": shared_parts}
ORACLE_SQL: dict[str, str] = {}
