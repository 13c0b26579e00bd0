"""Problem 2: the most similar vectors of every vector, by a robust-pruned directed graph per shard.

Vectors of one model are split by centroids (fitted on a bounded sample) into cells, and dense cells once more by finer
centroids fitted inside them, so that a shard stays near SHARD vectors however dense a region is and a vector asks only
the nearest shards. Inside a shard a directed graph is built: greedy searches propose neighbours, relaxed distance pruning
(ALPHA) keeps diverse edges, reverse edges are added and pruned again. Every vector then beam-searches the shards of its
PROBES nearest cells, and the best of all shards are merged. A cell that finer centroids can't split is split by a salt,
and all its parts are asked. Shards other than its own get a vector in single precision.

Vectors that are null, have another length than DIMENSIONS, hold null, NaN or infinity, or are all zero take no part. A
vec_id counts once. Vectors of equal direction are one node of the graph, so a group of identical vectors of any size
costs one search: the members are told apart afterwards by their smallest ids. Cosines are compared after rounding to
9 decimals, equal ones by smaller vec_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.tables import cut, table

DIMENSIONS, K = 64, 10
#: Vectors in a shard; sampled vectors per cell for the centroids and their bound in all; cells searched per vector.
SHARD, SAMPLE_PER_CELL, SAMPLE, PROBES = 2_000, 40, 20_000, 2
#: Finer centroids in all, which every task holds (512 bytes each).
CENTRES = 100_000
#: A shard whose centroid is up to so many times as far as the nearest one is asked too: where a region has no parts of its
#: own, neighbours lie in all of its shards.
AS_NEAR = 1.25
#: Out-degree, build and search beam width, relaxation of the pruning.
DEGREE, BEAM, ALPHA = 20, 32, 1.2
#: One node in so many is an entry point: dense islands far from each other need entries of their own.
ENTRIES = 6


def directions(vec: Column) -> Column:
    """Struct of the unit vector and a key of its direction (10 decimals); null for a vector that takes no part."""

    @F.pandas_udf("struct<key:string,vec:array<double>>")
    def unit(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"key": None, "vec": None}, index=vectors.index, dtype=object)
        whole = vectors.map(lambda v: v is not None and len(v) == DIMENSIONS).to_numpy(bool)
        if whole.any():
            m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors[whole]])
            most = np.abs(m).max(1)  # NaN, also of null, and infinity show here
            usable = np.isfinite(most) & (most > 0)
            m = m[usable] / most[usable, None]
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            at = vectors.index[whole][usable]
            out.loc[at, "vec"] = pd.Series(list(m), index=at, dtype=object)
            out.loc[at, "key"] = [hashlib.blake2b(r.tobytes(), digest_size=16).hexdigest() for r in np.round(m, 10) + 0.0]
        return out

    return unit(vec)


def usable_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, model, key, vec) of the rows that take part."""
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("model").isNotNull() & (F.size("vec") == DIMENSIONS))
    return rows.select("vec_id", "model", directions(F.col("vec")).alias("d")).select("vec_id", "model", "d.*").filter("key is not null")


def prune(points: np.ndarray, candidates: np.ndarray, similar: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for many points at once. candidates (n, c) are node ids sorted from near to far, -1 where none;
    similar their cosines. A candidate goes when a kept neighbour is alpha times nearer to it than the point is."""
    n, c = candidates.shape
    alive = candidates >= 0
    away = 2 - 2 * similar
    vectors = points[np.maximum(candidates, 0)]
    kept = np.full((n, degree), -1, dtype=np.int32)
    rows = np.arange(n)
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        kept[:, k] = np.where(some, candidates[rows, pick], -1)
        between = 2 - 2 * np.matmul(vectors, vectors[rows, pick][:, :, None])[:, :, 0]
        alive &= alpha * alpha * between > away
        alive[rows, pick] = False
    return kept


def beam_search(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of many queries in step: ids and cosines (q, beam) from near to far, -1 where none. It starts
    from the nearest entry points and, for queries that are nodes, from the node (own, -1 where none)."""
    q, n = len(queries), len(points)
    seen = np.zeros((q, n + 1), dtype=bool)
    ids = np.full((q, beam), -1, dtype=np.int32)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    first = queries @ points[entries].T
    width = min(beam, len(entries))
    order = np.argsort(-first, axis=1, kind="stable")[:, :width]
    ids[:, :width] = entries[order]
    sims[:, :width] = np.take_along_axis(first, order, 1)
    if own is not None:
        add = np.flatnonzero((own >= 0) & ~(ids == own[:, None]).any(1))
        ids[add, -1], sims[add, -1] = own[add], np.einsum("ij,ij->i", queries[add], points[own[add]])
    np.put_along_axis(seen, ids.astype(np.int64), True, 1)
    done = ids < 0
    rows = np.arange(q)
    while len(rows):
        pick = (~done[rows]).argmax(1)
        open_ = ~done[rows, pick]
        rows, pick = rows[open_], pick[open_]
        if not len(rows):
            break
        done[rows, pick] = True
        near = graph[ids[rows, pick]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        cos = np.matmul(points[np.maximum(near, 0)], queries[rows][:, :, None])[:, :, 0]
        cos[~fresh] = -np.inf
        all_sims = np.concatenate([sims[rows], cos], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_sims, top, 1), axis=1, kind="stable"), 1)
        sims[rows] = np.take_along_axis(all_sims, top, 1)
        ids[rows] = np.where(np.isfinite(sims[rows]), np.take_along_axis(np.concatenate([ids[rows], near], 1), top, 1), -1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(near.shape, bool)], 1), top, 1) | (ids[rows] < 0)
    return ids, sims


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, degree), -1 where none, and entry points. Starts from random edges; two rounds, the second relaxed."""
    n = len(points)
    rng = np.random.default_rng(0)
    entries = rng.permutation(n)[: max(16, n // ENTRIES)].astype(np.int32)
    if n <= degree + 1:
        graph = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        graph[np.arange(n), np.arange(n)] = -1
        return graph, entries
    graph = rng.integers(0, n, (n, degree), dtype=np.int32)
    for relax in (1.0, alpha):
        found, sims = beam_search(points, graph, entries, points, beam, np.arange(n, dtype=np.int32))
        old = np.where(graph == np.arange(n)[:, None], -1, graph)
        old_sims = np.where(old >= 0, np.matmul(points[np.maximum(old, 0)], points[:, :, None])[:, :, 0], -np.inf)
        graph = _pruned(points, np.concatenate([found, old], 1), np.concatenate([sims, old_sims], 1), degree, relax)
        # Reverse edges, at most degree new ones per node (the nearest), then pruned together.
        source, target = np.repeat(np.arange(n, dtype=np.int32), degree), graph.ravel()
        source, target = source[target >= 0], target[target >= 0]
        cos = np.einsum("ij,ij->i", points[source], points[target])
        order = np.lexsort((-cos, target))
        source, target, cos = source[order], target[order], cos[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        take = place < degree
        back, back_sims = np.full((n, degree), -1, dtype=np.int32), np.full((n, degree), -np.inf, dtype=np.float32)
        back[target[take], place[take]], back_sims[target[take], place[take]] = source[take], cos[take]
        own_sims = np.where(graph >= 0, np.matmul(points[np.maximum(graph, 0)], points[:, :, None])[:, :, 0], -np.inf)
        graph = _pruned(points, np.concatenate([graph, back], 1), np.concatenate([own_sims, back_sims], 1), degree, relax)
    return graph, entries


def _pruned(points: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """prune() after sorting from near to far, without the point itself and repeated candidates; in blocks."""
    n = len(points)
    out = np.empty((n, degree), dtype=np.int32)
    for a in range(0, n, 1024):
        c, s = candidates[a : a + 1024], sims[a : a + 1024].copy()
        by_id = np.argsort(c, axis=1, kind="stable")
        ordered = np.take_along_axis(c, by_id, 1)
        twice = np.zeros(c.shape, dtype=bool)
        np.put_along_axis(twice, by_id, np.concatenate([np.zeros((len(c), 1), bool), ordered[:, 1:] == ordered[:, :-1]], 1), 1)
        s[twice | (c < 0) | (c == np.arange(a, a + len(c))[:, None])] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")
        s = np.take_along_axis(s, order, 1)
        c = np.where(np.isfinite(s), np.take_along_axis(c, order, 1), -1)
        out[a : a + 1024] = prune(points, c, np.where(np.isfinite(s), s, -1).astype(np.float32), degree, alpha)
    return out


def _fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(8):
        at = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def _search_shard(k: int, beam: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        inside = pdf["inside"].to_numpy(bool)
        vectors = np.empty((len(pdf), DIMENSIONS))
        for has, column in ((inside, "vec"), (~inside, "asked")):
            if has.any():
                vectors[has] = np.stack(pdf[column][has].to_numpy())
        nodes, points = pdf["node"].to_numpy()[inside], vectors[inside]
        asked, queries = pdf["node"].to_numpy(), vectors
        out = []
        if len(points):
            small = points.astype(np.float32)
            graph, entries = build_graph(small)
            node_of = np.where(inside, np.cumsum(inside) - 1, -1).astype(np.int32)
            for a in range(0, len(queries), 1024):
                own = node_of[a : a + 1024]
                ids, _ = beam_search(small, graph, entries, queries[a : a + 1024].astype(np.float32), beam, own)
                exact = np.einsum("qbd,qd->qb", points[np.maximum(ids, 0)], queries[a : a + 1024])
                near = nodes[np.maximum(ids, 0)]
                exact = np.where((ids < 0) | (near == asked[a : a + 1024, None]), -np.inf, np.round(exact, 9))
                order = np.lexsort((near, -exact), axis=1)[:, :k]
                exact, near = np.take_along_axis(exact, order, 1), np.take_along_axis(near, order, 1)
                rows = np.repeat(asked[a : a + 1024], order.shape[1])
                ok = np.isfinite(exact).ravel()
                out.append(pd.DataFrame({"node": rows[ok], "near": near.ravel()[ok], "cosine": exact.ravel()[ok]}))
        if not out:
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        return pd.concat(out)

    return search


def _sampled(rows: DataFrame, share: float, wanted: int) -> np.ndarray:
    """About a share of the directions of rows (key, vec), at most wanted: those of the smallest hashes of the key."""
    limit = int(-(1 << 63) + min(1.0, share) * ((1 << 64) - 1))
    h = F.xxhash64("key")
    some = rows.filter(h <= F.lit(min(limit, (1 << 63) - 1))).groupBy("key").agg(F.first("vec").alias("vec"))
    part = some.orderBy(F.xxhash64("key"), "key").limit(wanted).select("vec").toPandas()
    return np.array(part["vec"].tolist()).reshape(-1, DIMENSIONS)


def _finer(routed: DataFrame, dense: dict[tuple[str, int], int], shard: int) -> dict[tuple[str, int], np.ndarray]:
    """Finer centroids of each dense cell (model, cell: number of vectors), fitted on a bounded sample of the cell."""
    parts = {cell: max(2, round(n / shard)) for cell, n in dense.items()}
    scale = min(1.0, CENTRES / sum(parts.values()))
    plan = [(m, c, max(2, int(p * scale)), min(1.0, 1.5 * min(SAMPLE, p * SAMPLE_PER_CELL) / dense[m, c])) for (m, c), p in parts.items()]
    wanted = routed.sparkSession.createDataFrame(plan, "model string, cell int, parts int, share double")  # at most one row per cell

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = np.stack(pdf["vec"].to_numpy())
        centres = _fit_centroids(sample, min(int(pdf["parts"].iat[0]), max(1, len(sample) // 2)))
        return pd.DataFrame({"model": pdf["model"].iat[0], "cell": pdf["cell"].iat[0], "centre": list(centres)})

    rows = routed.select("model", F.col("asks")[0]["cell"].alias("cell"), "vec", ((F.xxhash64("node") / F.lit(float(1 << 64))) + 0.5).alias("u"))
    some = rows.join(F.broadcast(wanted), ["model", "cell"]).filter("u <= share")
    got = some.groupBy("model", "cell").applyInPandas(fit, "model string, cell int, centre array<double>").toPandas()
    return {cell: np.stack(g["centre"].to_numpy()) for cell, g in got.groupby(["model", "cell"])}


def _router(cells: dict[str, np.ndarray], finer: dict[tuple[str, int], np.ndarray], probes: int):
    """The shards (cell, sub) that a vector asks, nearest first: of the cells, dense ones replaced by their finer ones, the
    nearest probes and all that are hardly farther than the nearest (AS_NEAR)."""

    @F.pandas_udf("array<struct<cell:int,sub:int>>")
    def route(model: pd.Series, vec: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[]] * len(model)
        for m in model.unique():
            at = np.flatnonzero((model == m).to_numpy())
            x = np.stack(vec.iloc[at].to_numpy())
            cos = x @ cells[m].T
            close = cos >= 1 - AS_NEAR * (1 - cos.max(1, keepdims=True))
            np.put_along_axis(close, np.argsort(-cos, axis=1, kind="stable")[:, :probes], True, 1)
            found: list[list[tuple[float, int, int]]] = [[] for _ in at]
            for cell in np.flatnonzero(close.any(0)):
                who = np.flatnonzero(close[:, cell])
                if (centres := finer.get((m, int(cell)))) is None:
                    for i in who:
                        found[i].append((-cos[i, cell], int(cell), 0))
                    continue
                sub = x[who] @ centres.T
                nearest = sub >= 1 - AS_NEAR * (1 - sub.max(1, keepdims=True))
                np.put_along_axis(nearest, np.argsort(-sub, axis=1, kind="stable")[:, :probes], True, 1)
                for i, row, near in zip(who, sub, nearest):
                    found[i] += [(-row[j], int(cell), int(j)) for j in np.flatnonzero(near)]
            for a, options in zip(at, found):
                options.sort()
                limit = AS_NEAR * (1 + options[0][0])
                out[a] = [{"cell": c, "sub": b} for k, (d, c, b) in enumerate(options) if k < probes or 1 + d <= limit]
        return pd.Series(out, dtype=object)

    return route


def nearest(vectors: DataFrame, k: int = K, shard: int = SHARD, probes: int = PROBES, beam: int = BEAM) -> DataFrame:
    """vectors as of usable_vectors to rows (vec_id, neighbour, cosine, place): the k most similar vectors."""
    # Nodes: vectors of equal direction, named by their smallest id; members beyond the first k + 1 matter only as
    # askers. The rank limit works before the shuffle, so a huge group sends k + 1 rows a partition.
    keyed = cut(vectors.groupBy("vec_id").agg(F.min(F.struct("model", "key")).alias("c")).select("vec_id", "c.*"))
    by_key = W.partitionBy("model", "key").orderBy("vec_id")
    few = keyed.withColumn("place", F.row_number().over(by_key)).filter(F.col("place") <= k + 1)
    names = cut(few.groupBy("model", "key").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("members")))

    cells: dict[str, np.ndarray] = {}
    for model, n in names.groupBy("model").count().orderBy("model").collect():
        count = max(1, round(n / shard))
        wanted = min(SAMPLE, max(count * SAMPLE_PER_CELL, 256))
        sample = _sampled(vectors.filter(F.col("model") == model), 1.5 * wanted / n, wanted)
        cells[model] = _fit_centroids(sample, max(1, min(count, wanted // 2, len(sample))))

    nodes = vectors.groupBy("model", "key").agg(F.first("vec").alias("vec")).join(names.select("model", "key", "node"), ["model", "key"]).select("node", "model", "vec")
    routed = cut(nodes.withColumn("asks", _router(cells, {}, probes)("model", "vec")))
    own = [F.col("asks")[0]["cell"].alias("cell"), F.col("asks")[0]["sub"].alias("sub")]
    sizes = {(r.model, r.cell): r["count"] for r in routed.groupBy("model", own[0]).count().filter(F.col("count") > 2 * shard).collect()}
    if sizes:
        routed = routed.withColumn("asks", _router(cells, _finer(routed, sizes, shard), probes)("model", "vec"))
        routed = cut(routed)
    # What finer centroids could not split is split by salt; a vector asks every part of it.
    parts = routed.groupBy("model", *own).agg(F.ceil(F.count("*") / (4 * shard)).cast("int").alias("parts")).filter("parts > 1")
    asks = routed.select("node", "model", "vec", F.posexplode("asks").alias("rank", "a")).select("node", "model", "vec", "rank", "a.*")
    asks = asks.join(F.broadcast(parts), ["model", "cell", "sub"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # salted cells are few
    mine = F.pmod(F.xxhash64("node"), "parts").cast("int")
    asks = asks.select("node", "vec", "model", "cell", "sub", "rank", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    inside = (F.col("rank") == 0) & (F.col("part") == F.col("own"))
    shards = asks.select("node", "model", "cell", "sub", "part", inside.alias("inside"), F.when(inside, F.col("vec")).alias("vec"), F.when(~inside, F.col("vec").cast("array<float>")).alias("asked"))
    hits = shards.groupBy("model", "cell", "sub", "part").applyInPandas(_search_shard(k, beam), "node long, near long, cosine double")
    best = W.partitionBy("node").orderBy(F.desc("cosine"), "near")
    hits = cut(hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place"))

    # Candidates of a node: members of its own class (cosine 1) and of its neighbours' classes.
    members = names.select(F.col("node").alias("near"), "members")
    own_class = names.select("node", F.lit(1.0).alias("cosine"), F.explode("members").alias("neighbour"))
    others = hits.join(members, "near").select("node", "cosine", F.explode("members").alias("neighbour"))
    ranked = W.partitionBy("node").orderBy(F.desc("cosine"), "neighbour")
    lists = own_class.unionByName(others).withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
    lists = lists.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "neighbour", "cosine"))).alias("list"))
    asking = keyed.select("vec_id", "model", "key").join(names.select("model", "key", "node"), ["model", "key"]).select("vec_id", "node")
    kept = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("vec_id")), 1, k)
    out = asking.join(lists, "node").select("vec_id", F.posexplode(kept).alias("place", "x"))
    return out.select("vec_id", F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("place") + 1).alias("place"))


def found(spark: SparkSession, root: str) -> DataFrame:
    """p2_found: distinct pairs in which one is among the 10 most similar vectors of the other."""
    near = nearest(usable_vectors(table(spark, root, "text_vectors")))
    pair = near.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b"))
    return pair.distinct()


QUERIES = {"p2_found": found}
ORACLE_SQL: dict[str, str] = {}
