"""Problem 8: encoding with a public byte-level BPE vocabulary by a lazily determinised transducer.

The merges are compiled into a transducer over bytes. Its theory: for a prefix of a word there is exactly one token that
the encoding of the prefix ends with, and two tokens may stand side by side in an encoding exactly if encoding their
joined bytes gives the two back. A state therefore holds the few open ways to read on (threads): a node of the token
trie, reached since the thread's last token boundary, and the tokens that are not certain yet. On a byte every thread
walks on in the trie; the one thread that completes a token compatible with its last one opens a new thread. What all
threads agree on is emitted, so lookahead is bounded by the longest token. States and their moves are made when first
needed and kept (lazy determinisation), so a byte costs one dictionary access once warm; whole words are kept too.

Null and empty texts have no ids: an empty list. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tables import table

#: Words and states kept by one Python worker; beyond it the store starts anew (results do not change).
KEPT_WORDS, KEPT_MOVES, KEPT_PAIRS = 500_000, 1_000_000, 500_000
#: Fixed value: the word pattern of the byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same words by the faster standard engine, in texts without the characters on which the two differ: numbers that
#: are not decimal digits, and separators that only one of the engines counts as white space.
FAST_PATTERN = r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

#: The same again for texts of Latin-1 characters only.
LATIN_PATTERN = r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """The rank file of a public vocabulary; GLEANER_TOKENIZERS names its folder where it is not the installed one."""
    folder = os.environ.get("GLEANER_TOKENIZERS")
    if not folder:
        import public_tokenizers

        return public_tokenizers.path(f"{name}.tiktoken")
    return os.path.join(folder, f"{name}.tiktoken")


class Transducer:
    """Bytes of one word in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = self.children[node].get(byte)
                if step is None:
                    step = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = step
            self.token_at[node] = rank
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state: the last emitted token (-1 at the start) and its threads (trie node, pending tokens).
        self.states: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = [(-1, ((0, ()),))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.final: dict[int, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The encoding by its definition, lowest rank first. Used to decide which tokens may be neighbours."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def neighbours(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, threads = self.states[state]
        walked: list[tuple[int, tuple[int, ...]]] = []
        opened: tuple[int, tuple[int, ...]] | None = None
        for node, pending in threads:
            step = self.children[node].get(byte)
            if step is None:
                continue
            token = self.token_at[step]
            if token >= 0 and opened is None and self.neighbours(pending[-1] if pending else last, token):
                opened = (0, (*pending, token))
            if self.children[step]:
                walked.append((step, pending))
        if opened is None:
            raise ValueError("the vocabulary lacks single bytes")
        walked.append(opened)
        shared = os.path.commonprefix([p for _, p in walked]) if all(p for _, p in walked) else ()
        n = len(shared)
        target = (shared[-1] if n else last, tuple((node, p[n:]) for node, p in walked))
        k = self.number.get(target)
        if k is None:
            k = self.number[target] = len(self.states)
            self.states.append(target)
        self.moves[state << 8 | byte] = move = (k, tuple(shared))
        return move

    def encode(self, word: bytes) -> list[int]:
        if len(self.moves) > KEPT_MOVES:
            self._reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in word:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        rest = self.final.get(state)
        if rest is None:
            rest = self.final[state] = next(p for node, p in self.states[state][1] if node == 0)
        out.extend(rest)
        return out


class Words(dict):
    """Word to the bytes of its ids, by the transducer when it is first seen."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        ids = self.machine.encode(word.encode("utf-8", "surrogatepass"))
        part = self[word] = array("i", ids).tobytes()
        return part


class Encoder:
    """Texts to ids and back with one vocabulary."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.machine = Transducer(ranks)
        self.exact, self.fast = regex.compile(WORD_PATTERN).findall, re.compile(FAST_PATTERN).findall
        self.latin = re.compile(LATIN_PATTERN).findall
        odd = (chr(c) for c in range(0x110000) if chr(c).isnumeric() and not chr(c).isdecimal() and not chr(c).isalpha())
        self.plain = frozenset([*odd, *"\x1c\x1d\x1e\x1f\x85"]).isdisjoint
        self.words = Words(self.machine)

    def ids(self, text: str | None) -> np.ndarray:
        """int32 ids; none for null and empty texts."""
        if not text:
            return np.empty(0, dtype=np.int32)
        if not self.plain(text):
            find = self.exact
        elif text.isascii() or max(text) <= "\xff":
            find = self.latin
        else:
            find = self.fast
        words = find(text)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.int32)

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """Streaming decode: text as soon as its UTF-8 bytes are complete; broken bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.machine.token_bytes[int(i)]):
                yield piece
        if piece := machine.decode(b"", True):
            yield piece


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def encode(df: DataFrame, id_column: str, text_column: str = "text", path: str | None = None) -> DataFrame:
    """id column and ids (array of int) of each row. No shuffle; texts cross to Python in Arrow batches."""
    path, kind = path or vocabulary_path(), df.schema[id_column].dataType
    schema = f"`{id_column}` {kind.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for batch in batches:
            rows = [ids(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, "ids"])

    return df.select(id_column, text_column).mapInArrow(run, schema)


def token_counts(df: DataFrame, keep: tuple[str, ...], text_column: str = "text", path: str | None = None) -> DataFrame:
    """The keep columns and n_tokens (0 for null and empty texts)."""
    path = path or vocabulary_path()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        ids = encoder(path).ids
        return pd.Series([len(ids(t)) for t in texts], dtype="int32")

    return df.select(*keep, count(text_column).alias("n_tokens"))


def document_ids(spark: SparkSession, root: str) -> DataFrame:
    """p8_ids: doc_id and ids of every document by byte_bpe_50k, without special tokens."""
    return encode(table(spark, root, "documents"), "doc_id")


QUERIES = {"p8_ids": document_ids}
ORACLE_SQL: dict[str, str] = {}
