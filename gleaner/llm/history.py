"""Problem 5: duplicates of new batches against everything accepted so far, without reprocessing the history.

The history is an index in a folder that is opened by its path and only ever appended to: per accepted sample its hash and
signature (rows), and one narrow row per key under which it can be found (keys), with its distances to PIVOTS fixed pivots
and a sketch. Of GROUPS groups of positions, two signatures of WIDTH numbers that differ in at most RADIUS positions differ in at
most RADIUS / GROUPS in one, and so are equal on two of its PARTS parts: all pairs of parts of a group are the keys, and none
of the partners is missed. They are half as wide again as RADIUS + 1 blocks, one of which would be equal, and chance partners,
whose number grows with the square of the rows, are an eighth.

The position-wise difference is a metric: a partner x of y has |d(x, p) - d(y, p)| <= RADIUS for every pivot p. Stored
distances and the sketch (one bit of each number, whose difference never exceeds the true one) prune key partners inside
the join, and what is left is verified on the signatures. Pivots alone prune too little here: see the README.

What is computed for a batch (parsing, keys, distances, sketches) is computed for its rows only. The keys of a batch of up
to BROADCAST key rows are broadcast to the stored keys, which then are neither shuffled nor split by key, so a hot key is
no hot task; a larger batch is joined by shuffle in slices of keys, hot keys of the history salted.

Where batch 0, all of which is accepted, has keys with over GROUP rows, a new row is checked against one leader per key
first, which settles groups of near-copies in linear work; then, if still open, against every partner of its keys. Rows of
one batch are settled by their verified pairs, earliest first. Where a batch has more pairs under its keys than ROOM * GROUP a
row, its earliest rows are settled alone, so many that they have as many, and rows close to those accepted are cases before
the next ones are taken. Equal hashes are keys of their own.

Signatures that are null, unreadable or of another length only take part by hash; rows without sample_id or batch_no take
no part; a sample_id counts once, with its earliest (batch_no, pos).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tables import cut, table
from gleaner.session import ensure_checkpoint_dir

WIDTH, AGREE = 128, 102
RADIUS = WIDTH - AGREE
#: Fixed pivots, taken from the earliest distinct signatures of batch 0. Their distances share one integer, a byte each.
PIVOTS = 6
#: Groups of positions and parts of each, two of which are a key; keys of a row.
GROUPS = 9
PARTS = RADIUS // GROUPS + 2
KEYS = GROUPS * PARTS * (PARTS - 1) // 2
#: Rows under one key of batch 0 beyond which leaders are kept. ROOM * GROUP: pairs a row up to which open rows of a batch are
#: settled at once.
GROUP, ROOM = 512, 4
#: Key rows of a batch, or candidate pairs, up to which they are broadcast (about 60 bytes each).
BROADCAST = 1_000_000
#: Stored rows of one key from which it is hot, and parts into which it is split where keys are shuffled.
HOT, SALTS = 50_000, 32
_EDGES = [i * WIDTH // (GROUPS * PARTS) for i in range(GROUPS * PARTS + 1)]
#: Share of the stored rows, by id, by which hot keys are found: a thousand rows of each.
_SEEN = 1_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
TABLES = {"rows": "old_id string, hash string, sig array<bigint>", "keys": "key bigint, old_id string, near bigint, b0 bigint, b1 bigint", "leaders": "key bigint, old_id string, near bigint, b0 bigint, b1 bigint"}


def parsed(text: str | None) -> np.ndarray | None:
    """A JSON list of WIDTH unsigned 64-bit numbers as signed ones of the same order; None for anything else."""
    try:
        numbers = json.loads(text) if text else None
        if not isinstance(numbers, list) or len(numbers) != WIDTH or any(type(x) is not int for x in numbers):
            return None
        return (np.array(numbers, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    except (ValueError, OverflowError):
        return None


def parse_signature(sig: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([parsed(t) for t in texts], dtype=object)

    return parse(sig)


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """One row per sample_id: batch_no, pos, hash (lower case), sig (array<bigint> or null)."""
    keys = ["sample_id", "batch_no", "pos"]
    prints = table(spark, root, "fingerprints").select(*keys, F.lower("hash").alias("hash"), F.lit(None).cast("array<bigint>").alias("sig"))
    sigs = table(spark, root, "minhash_sigs").select(*keys, F.lit(None).cast("string").alias("hash"), parse_signature(F.col("sig")).alias("sig"))
    both = prints.unionByName(sigs).filter("sample_id is not null and batch_no is not null")
    first = F.min(F.struct("batch_no", "pos")).alias("at")
    merged = both.groupBy("sample_id").agg(first, F.max("hash").alias("hash"), F.max("sig").alias("sig"))
    return merged.select("sample_id", F.col("at.batch_no").alias("batch_no"), F.col("at.pos").alias("pos"), "hash", "sig")


def _mixed(columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of every row of unsigned numbers."""
    h = np.full(len(columns), 0x632BE59BD9B4E019, dtype=np.uint64)
    for k in range(columns.shape[1]):
        h = (h ^ columns[:, k]) * _MIX
        h ^= h >> np.uint64(32)
    return h


def index_of(sigs: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of signatures: keys, packed distances to the pivots, and the two halves of the sketch."""
    m = np.ascontiguousarray(sigs).view(np.uint64)
    parts = [_mixed(np.concatenate([np.full((len(m), 1), i, np.uint64), m[:, a:b]], axis=1)) for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))]
    keys = np.stack([_mixed(np.stack(two, axis=1)) for g in range(GROUPS) for two in combinations(parts[g * PARTS : (g + 1) * PARTS], 2)], axis=1)
    near = np.zeros(len(m), dtype=np.int64)
    for k, p in enumerate(pivots):
        near |= (sigs != p).sum(1).astype(np.int64) << (8 * k)
    bits = ((m * _MIX) >> np.uint64(63)).astype(np.uint64)
    half = [(bits[:, a : a + 64] << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64) for a in (0, 64)]
    return keys.view(np.int64), near, half[0], half[1]


def _indexed(pivots: list[list[int]]):
    p = np.array(pivots, dtype=np.int64).reshape(-1, WIDTH)

    @F.pandas_udf("struct<keys:array<bigint>,near:bigint,b0:bigint,b1:bigint>")
    def index(sigs: pd.Series) -> pd.DataFrame:
        has = sigs.notna().to_numpy()
        out = pd.DataFrame({"keys": [[] for _ in sigs], "near": None, "b0": None, "b1": None}, dtype=object)
        if has.any():
            keys, near, b0, b1 = index_of(np.stack(sigs[has].to_numpy()).astype(np.int64), p)
            out.loc[has, "keys"] = pd.Series(list(keys), index=out.index[has], dtype=object)
            for name, x in (("near", near), ("b0", b0), ("b1", b1)):
                out.loc[has, name] = x
        return out.astype({"near": "Int64", "b0": "Int64", "b1": "Int64"})

    return index


def distance(a: Column, b: Column) -> Column:
    """Differing positions of two signatures; WIDTH + 1 if one is null."""

    @F.pandas_udf("int")
    def differing(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), WIDTH + 1, dtype=np.int32)
        both = (x.notna() & y.notna()).to_numpy()
        if both.any():
            out[both] = (np.stack(x[both].to_numpy()) != np.stack(y[both].to_numpy())).sum(1)
        return pd.Series(out)

    return differing(a, b)


def _close():
    """Whether distances to the pivots and the sketches allow a pair of rows n and o to be close; true without them."""
    byte = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255).cast("bigint"))
    inside = [F.abs(byte("n.near", k) - byte("o.near", k)) <= RADIUS for k in range(PIVOTS)]
    differing = sum((F.bit_count(F.col(f"n.{b}").bitwiseXOR(F.col(f"o.{b}"))) for b in ("b0", "b1")), F.lit(0))
    return F.coalesce(reduce(lambda x, y: x & y, inside, differing <= RADIUS), F.lit(True))


class History:
    """Accepted samples as an index below a folder that all executors share. open() an old one, create() a new one."""

    def __init__(self, spark: SparkSession, folder: str, pivots: list[list[int]], hot: bool, batches: int):
        self.spark, self.folder, self.pivots, self.hot, self.batches = spark, folder.rstrip("/"), pivots, hot, batches

    @classmethod
    def create(cls, batch: DataFrame, folder: str) -> History:
        """A history that begins with batch (sample_id, batch_no, pos, hash, sig), all of it accepted."""
        usable = batch.filter("sig is not null")
        first = usable.orderBy("batch_no", "pos", "sample_id").limit(64 * PIVOTS).groupBy("sig").agg(F.min(F.struct("batch_no", "pos", "sample_id")).alias("at"))
        pivots = [list(r.sig) for r in first.orderBy("at").limit(PIVOTS).collect()]
        spark = batch.sparkSession
        out = cls(spark, folder, pivots, False, 0)
        rows = out._keyed(batch)
        out.hot = (rows.select(F.explode("keys").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0] or 0) > GROUP
        settings = spark.createDataFrame([(out.hot, pivots)], "hot boolean, pivots array<array<bigint>>")
        settings.coalesce(1).write.parquet(f"{out.folder}/settings")
        # Of rows alike in hash and signature the earliest stands for all.
        alike = rows.groupBy("hash", F.xxhash64("sig").alias("s"), "near", "b0", "b1").agg(F.min(F.struct("pos", "sample_id")).alias("first"))
        out._append(rows.join(alike.select(F.col("first.sample_id").alias("sample_id")), "sample_id", "left_semi"))
        return out

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> History:
        """The history that an earlier session left in folder."""
        settings = spark.read.parquet(f"{folder.rstrip('/')}/settings").first()
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/keys/batch=*/_SUCCESS")
        done = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        numbers = [int(f.getPath().getParent().getName().split("=")[1]) for f in (done or [])]
        return cls(spark, folder, [list(p) for p in settings.pivots], settings.hot, max(numbers, default=-1) + 1)

    def table(self, name: str) -> DataFrame:
        """One table of the index, without batches whose writing was broken off: keys are written last."""
        paths = [f"{self.folder}/{name}/batch={b}" for b in range(self.batches)]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _keyed(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch with keys (the last one is that of the hash), packed distances (near) and sketch (b0, b1)."""
        rows = batch.withColumn("i", _indexed(self.pivots)("sig"))
        by_hash = F.array_compact(F.array(F.when(F.col("hash").isNotNull(), F.xxhash64(F.lit("hash"), F.col("hash")))))
        return cut(rows.select("sample_id", "pos", "hash", "sig", F.concat("i.keys", by_hash).alias("keys"), F.col("hash").isNotNull().alias("hashed"), "i.near", "i.b0", "i.b1"))

    @staticmethod
    def _exploded(rows: DataFrame, name: str = "sample_id", *more: str) -> DataFrame:
        """One row per key; the key of the hash has no distances and no sketch, so it is never pruned."""
        cells = rows.select(F.col("sample_id").alias(name), *more, "near", "b0", "b1", "hashed", F.size("keys").alias("n"), F.posexplode("keys").alias("k", "key"))
        own = lambda c: F.when(~(F.col("hashed") & (F.col("k") == F.col("n") - 1)), F.col(c)).alias(c)
        return cells.select("key", name, *more, own("near"), own("b0"), own("b1"))

    def _append(self, accepted: DataFrame) -> None:
        """Add accepted rows as one batch: rows, leaders (one row per key) where they are needed, and keys, sorted, last."""
        keyed = self._exploded(accepted, "old_id").select("key", "old_id", "near", "b0", "b1")
        at = f"batch={self.batches}"
        accepted.select(F.col("sample_id").alias("old_id"), "hash", "sig").write.mode("overwrite").parquet(f"{self.folder}/rows/{at}")
        if self.hot:
            lead = keyed.groupBy("key").agg(F.min_by(F.struct("old_id", "near", "b0", "b1"), "old_id").alias("l")).select("key", "l.*")
            lead.write.mode("overwrite").parquet(f"{self.folder}/leaders/{at}")
        keyed.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.folder}/keys/{at}")
        self.batches += 1

    def _met(self, new: DataFrame, old: DataFrame, key_rows: int, ordered: bool = False) -> DataFrame:
        """Distinct (sample_id, old_id) that share a key and may be close; ordered: old ones that are earlier."""
        may = _close()
        if ordered:
            may = (F.struct("o.pos", "o.old_id") < F.struct("n.pos", "n.sample_id")) & may
        if key_rows <= BROADCAST:
            joined = old.alias("o").join(F.broadcast(new.alias("n")), (F.col("n.key") == F.col("o.key")) & may)
        else:
            one_of = max(1, HOT // _SEEN)
            seen = old.filter(F.pmod(F.xxhash64("old_id"), F.lit(one_of)) == 0)
            hot = seen.groupBy("key").count().filter(F.col("count") * one_of > HOT).select("key", F.lit(SALTS).alias("parts"))
            part = F.pmod(F.xxhash64("old_id"), F.lit(SALTS)).cast("int")
            o = old.join(F.broadcast(hot), "key", "left").withColumn("part", F.when(F.col("parts").isNotNull(), part).otherwise(0))
            n = new.join(F.broadcast(hot), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
            joined = o.alias("o").join(n.alias("n"), (F.col("n.key") == F.col("o.key")) & (F.col("n.part") == F.col("o.part")) & may)
        return joined.select("n.sample_id", "o.old_id").distinct()

    @staticmethod
    def _verified(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
        """The pairs (written) with equal hashes, or signatures within RADIUS. Few pairs are broadcast to the signatures."""
        old = old.withColumnsRenamed({"hash": "old_hash", "sig": "old_sig"}).join(F.broadcast(pairs) if pairs.count() <= BROADCAST else pairs, "old_id")
        joined = old.join(new.select("sample_id", "hash", "sig"), "sample_id")
        same = F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False))
        return joined.filter(same | (distance(F.col("sig"), F.col("old_sig")) <= RADIUS)).select("sample_id", "old_id")

    def _hits(self, rows: DataFrame, against: str, count: int) -> DataFrame:
        """Ids of rows that are close to one of a stored table of keys."""
        pairs = cut(self._met(self._exploded(rows), self.table(against), count * (KEYS + 1)))
        return self._verified(pairs, rows, self.table("rows")).select("sample_id").distinct()

    def _settle(self, still: DataFrame, count: int) -> DataFrame:
        """Ids of the accepted among open rows of one batch that are close to nothing in the history."""
        accepted, rows = [], still
        while (last := self._last_at_once(rows, count)) is not None:
            # The earliest rows; those after them that are close to an accepted one are cases.
            part = cut(rows.filter(F.col("pos").isNull() | (F.col("pos") <= last)))
            now = cut(part.join(self._first_of_pairs(part, count), "sample_id", "left_semi"))
            accepted.append(now.select("sample_id"))
            rest = cut(rows.filter(F.col("pos") > last))
            met = cut(self._met(self._exploded(rest), self._exploded(now, "old_id"), count * (KEYS + 1)))
            rows = cut(rest.join(self._verified(met, rest, self._as_old(now)).select("sample_id").distinct(), "sample_id", "left_anti"))
        return reduce(DataFrame.unionByName, accepted, self._first_of_pairs(rows, count))

    @staticmethod
    def _as_old(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("sample_id").alias("old_id"), "hash", "sig")

    @staticmethod
    def _last_at_once(rows: DataFrame, count: int) -> int | None:
        """The pos up to which rows can be settled at once; None for all of them."""
        if count <= GROUP:
            return None
        size = F.col("count")
        found = rows.select(F.explode("keys").alias("key")).groupBy("key").count().agg(F.sum(size * (size - 1) / 2)).first()[0] or 0.0
        n, room = rows.agg(F.count("*"), F.max("pos")).first(), ROOM * GROUP
        if found <= room * n[0]:
            return None
        last = rows.agg(F.percentile_approx("pos", room * n[0] / found, 100_000)).first()[0]
        return last if last is not None and last < n[1] else None

    def _first_of_pairs(self, rows: DataFrame, count: int) -> DataFrame:
        """Ids of rows accepted when all their verified pairs are resolved, earliest first."""
        accepted, open_ = [], rows.select("sample_id")
        pairs = cut(self._verified(cut(self._met(self._exploded(rows, "sample_id", "pos"), self._exploded(rows, "old_id", "pos"), count * (KEYS + 1), True)), rows, self._as_old(rows)))
        while not pairs.isEmpty():
            now = cut(open_.join(pairs.select("sample_id"), "sample_id", "left_anti"))
            accepted.append(now)
            gone = pairs.join(now.select(F.col("sample_id").alias("old_id")), "old_id", "left_semi")
            open_ = cut(open_.join(pairs.select("sample_id"), "sample_id", "left_semi").join(gone.select("sample_id"), "sample_id", "left_anti"))
            pairs = cut(pairs.join(open_, "sample_id", "left_semi").join(open_.withColumnRenamed("sample_id", "old_id"), "old_id", "left_semi"))
        return reduce(DataFrame.unionByName, accepted, open_)

    def append(self, batch: DataFrame) -> DataFrame:
        """Settle one batch: its cases (sample_id) are returned, the rest is accepted and appended."""
        rows = self._keyed(batch)
        count = rows.count()
        left = cut(rows.join(self._hits(rows, "leaders", count), "sample_id", "left_anti")) if self.hot else rows
        still = cut(left.join(self._hits(left, "keys", count), "sample_id", "left_anti"))
        kept = cut(self._settle(still, count))
        self._append(still.join(kept, "sample_id", "left_semi"))
        return rows.select("sample_id").join(kept, "sample_id", "left_anti")


def found(spark: SparkSession, root: str) -> DataFrame:
    """p5_found: sample_id of the cases of batches 1 and later, batch after batch."""
    rows = cut(arrivals(spark, root))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/history-{uuid.uuid4().hex}"
    history = History.create(rows.filter("batch_no = 0"), folder)
    batches = [r.batch_no for r in rows.filter("batch_no > 0").select("batch_no").distinct().orderBy("batch_no").collect()]
    out = [history.append(rows.filter(F.col("batch_no") == b)) for b in batches]
    none = rows.filter("false").select("sample_id")
    return reduce(DataFrame.unionByName, out, none)


QUERIES = {"p5_found": found}
ORACLE_SQL: dict[str, str] = {}
