"""Embedding near-duplicates over an inverted multi-index (operator 1).

Unit vectors are cut into halves, each half with its own k-means codebook; a vector's cell is its
pair of nearest centroids, so K + K centroids give K * K cells. A query's multi-sequence traversal
visits cells by rising sum of its two distances; as many as a calibration against brute force (a
bounded set of query vectors against *all* rows) needs for the target recall, and as many as made
partners of those vectors at the threshold need, so that a table with few links or none is calibrated
too. Every pair met in a
cell is verified by its cosine in double precision, so no pair below the threshold ever links.

* Bounds: codebooks are fitted on ``sample`` vectors and calibrated on ``probes`` vectors at most,
  chosen by hash; every row is indexed, and every row is a query.
* Equal vectors are one entry with a multiplicity. A vector is written once, with the cells on its way; visits carry it
  only while a share of the cells is compared, one share after the other. A cell's members and visitors meet in pair blocks
  of bounded size, so a hot cell is spread over many tasks; two visitors aren't compared. A pair that two visits would meet is
  compared in the smaller cell only; each block adds counts and root edges per vector, not pairs.
* Null, zero and non-finite vectors link with nothing: n_links 0, component_id the own id. Vectors of
  different lengths don't link; each length has an index of its own, built one after the other. Rows with
  one vec_id are one node. Null vec_id: links count as for others and join what they meet (under numbers
  from ``UNKNOWN`` on, above every vec_id), component null. Further columns aren't read, whatever their
  names; no column is so long that it is cut. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, connected_components, materialise, pair_blocks, release

SAMPLE = 20_000
PROBES = 256
CELL = 32  # vectors in a cell on average, until K reaches its limit
MAX_K = 4096
EACH = 8  # vectors in the sample for each centroid at least
UNKNOWN = 1 << 62
CHUNK = 8192
#: Cosines that numpy holds at once.
PAIRS = 1 << 20
#: Visits that a share has, or as many as there are vectors.
VISITS = 1 << 19


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _units(column: pa.Array, dims: int) -> np.ndarray:
    x = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    return np.maximum(d, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; an empty centre stays where it is."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(x[lo : lo + 4096], centres).argmin(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def traverse(first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """Each row's ``cells`` nearest cells (c1 * K + c2) by rising sum of distances.

    The multi-sequence traversal for many queries at once: the t-th visited pair of ranks (i, j) has
    (i + 1) * (j + 1) <= t, so only that hyperbola of the two sorted sequences is looked at."""
    k1, k2 = first.shape[1], second.shape[1]
    cells = min(cells, k1 * k2)
    pairs = [(i, j) for i in range(min(k1, cells)) for j in range(min(k2, cells // (i + 1)))]
    i, j = np.array(pairs).T
    o1, o2 = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
    sums = np.take_along_axis(first, o1, 1)[:, i] + np.take_along_axis(second, o2, 1)[:, j]
    best = np.argsort(sums, 1, kind="stable")[:, :cells]
    return o1[np.arange(len(first))[:, None], i[best]] * k2 + o2[np.arange(len(first))[:, None], j[best]]


def _ranks(first: np.ndarray, second: np.ndarray, cell: np.ndarray, k2: int) -> np.ndarray:
    """At which place of its traversal each row reaches a given cell."""
    own = first[np.arange(len(cell)), cell // k2] + second[np.arange(len(cell)), cell % k2]
    return np.array([(a[:, None] + b[None] < s).sum() for a, b, s in zip(first, second, own)], np.int64) + 1


def _made_ranks(q: np.ndarray, books: tuple, threshold: float, each: int = 16, seed: int = 9) -> np.ndarray:
    """After how many cells each vector and partners made at cosine ``threshold`` meet, by either's way."""
    q = q.repeat(each, 0)
    side = np.random.default_rng(seed).normal(size=q.shape)
    side -= (side * q).sum(1, keepdims=True) * q
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    y = threshold * q + math.sqrt(max(0.0, 1 - threshold * threshold)) * side
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    half, (b1, b2) = q.shape[1] // 2, books
    ranks = []
    for lo in range(0, len(q), 1024):
        d = [(_distances(x[lo : lo + 1024, :half], b1), _distances(x[lo : lo + 1024, half:], b2)) for x in (q, y)]
        cell = [one.argmin(1) * len(b2) + two.argmin(1) for one, two in d]
        ranks.append(np.minimum(_ranks(*d[0], cell[1], len(b2)), _ranks(*d[1], cell[0], len(b2))))
    return np.concatenate(ranks)


def _cells_needed(heads: DataFrame, books: tuple, dims: int, threshold: float, target: float, probes: int) -> int:
    """Cells to visit for the target recall, by brute force of the probes against all rows and by made
    partners, whichever needs more."""
    rows = heads.orderBy(F.xxhash64("head", F.lit(1)), "head").limit(probes).select("head", "v").collect()
    q = _units(pa.array([r.v for r in rows], pa.list_(pa.float64())), dims)
    ids = np.array([r.head for r in rows], np.int64)
    half, (b1, b2) = dims // 2, books
    d1, d2 = _distances(q[:, :half], b1), _distances(q[:, half:], b2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for whole in batches:
            for part in range(0, whole.num_rows, 4096):
                batch = whole.slice(part, 4096)
                x = _units(batch.column(1), dims)
                a, b = np.nonzero(q @ x.T >= threshold)
                other = ids[a] != batch.column(0).to_numpy()[b]
                a, b = a[other], b[other]
                cell = _distances(x[:, :half], b1).argmin(1) * len(b2) + _distances(x[:, half:], b2).argmin(1)
                for lo in range(0, len(a), 1024):
                    s = slice(lo, lo + 1024)
                    for r, n in zip(*np.unique(_ranks(d1[a[s]], d2[a[s]], cell[b[s]], len(b2)), return_counts=True)):
                        seen[int(r)] = seen.get(int(r), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["r", "n"])

    found = heads.select("head", "v").mapInArrow(run, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect()
    made = np.sort(_made_ranks(q, books, threshold))
    least = max(2, int(made[math.ceil(target * len(made)) - 1]))
    total, reached = sum(f.n for f in found), 0
    for f in found:
        reached += f.n
        if reached >= target * total:
            return max(least, int(f.r))
    return least


def _route(books: tuple, dims: int, cells: int, shares: int):
    """Each vector with its own cell, and the cells on its way by share (the remainder of a cell's number)."""
    half, (b1, b2) = dims // 2, books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 2048):
                batch = whole.slice(part, 2048)
                x = _units(batch.column(1), dims)
                way = traverse(_distances(x[:, :half], b1), _distances(x[:, half:], b2), cells).astype(np.int32)
                group = np.arange(len(way))[:, None] * shares + way % shares
                ends = np.cumsum(np.bincount(group.ravel(), minlength=len(way) * shares))
                mine = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(way.ravel()[np.argsort(group.ravel(), kind="stable")]))
                ways = pa.ListArray.from_arrays(pa.array(np.arange(0, len(way) * shares + 1, shares, dtype=np.int32)), mine)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(way[:, 0]), ways], ["head", "v", "copies", "home", "ways"])

    return run


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the smallest ordinal of each one's group, after the groups of a[i] and b[i] became one."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _verify(dims: int, threshold: float):
    """Per block: each vector's number of links found there, and an edge to its block root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_key(batches, ["cell", "i", "j"]):
            cell, i, j = (g[k][0].as_py() for k in ("cell", "i", "j"))
            ids, c, copies = g["head"].to_numpy(), g["c"].to_numpy(), g["copies"].to_numpy()
            x = _units(g["v"].combine_chunks(), dims)
            home = g["home"].to_numpy()
            member = home == cell
            ways = g["way"].combine_chunks().flatten().to_numpy().reshape(member.sum(), -1) if member.any() else np.zeros((0, 1), np.int32)
            row = np.cumsum(member) - 1
            n, root = np.zeros(len(ids)), np.arange(len(ids))
            # two visitors meet elsewhere, so each pair has a member
            sides = [(np.flatnonzero(member & (c == i)), np.flatnonzero(c == j))]
            if i != j:
                sides.append((np.flatnonzero(member & (c == j)), np.flatnonzero(~member & (c == i))))
            for ours, others in sides:
                step = max(1, PAIRS // max(1, len(others)))
                for at in range(0, len(ours), step):
                    a, b = np.nonzero(x[ours[at : at + step]] @ x[others].T >= threshold)
                    a, b = ours[at + a], others[b]
                    if i == j:
                        once = (a < b) | ~member[b]
                        a, b = a[once], b[once]
                    # a visitor and a member whose ways cross both cells meet in the smaller one
                    skip = np.zeros(len(a), bool)
                    low = np.flatnonzero(home[b] < cell)
                    for some in (low[k : k + 100_000] for k in range(0, len(low), 100_000)):
                        skip[some] = (ways[row[a[some]]] == home[b[some]][:, None]).any(1)
                    a, b = a[~skip], b[~skip]
                    n += np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                    root = _joined(root, a, b)
            some = np.flatnonzero(n > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(ids[root[some]])], ["a", "n", "b"]
                )

    return run


def _routed(indexed: DataFrame, dims: int, threshold: float, target: float, sample: int, probes: int) -> tuple[DataFrame, int]:
    """The vectors of one length with their ways, written, and how many shares the cells are in."""
    n = indexed.count()
    k = min(MAX_K, max(2, 1 << round(math.log2(max(4, math.sqrt(max(1, n) / CELL))))))
    drawn = indexed.orderBy(F.xxhash64("head"), "head").limit(max(sample, EACH * k)).select("v").collect()
    x = _units(pa.array([r.v for r in drawn], pa.list_(pa.float64())), dims)
    half = dims // 2
    books = kmeans(x[:, :half], min(k, len(x))), kmeans(x[:, half:], min(k, len(x)), seed=8)
    cells = _cells_needed(indexed, books, dims, threshold, target, probes)
    shares = math.ceil(n * cells / max(VISITS, n))
    kind = dict(indexed.dtypes)["v"]
    schema = f"head long, v {kind}, copies long, home int, ways array<array<int>>"
    return materialise(indexed.mapInArrow(_route(books, dims, cells, shares), schema), "ways"), shares


def _links(routed: DataFrame, shares: int, dims: int, threshold: float, chunk: int) -> DataFrame:
    """(a, n, b) of the vectors of one length: how many links a has in a block, and an edge to its block root."""
    sizes = routed.select(F.explode(F.flatten("ways")).alias("cell")).groupBy("cell").agg(F.count("*").alias("k"))
    sizes = materialise(sizes.where(F.col("k") > chunk), "sizes")
    found, keys = [], ["cell", "i", "j"]
    for share in range(shares):  # one after the other, so that no more than a share's visits carry their vectors on disk
        way = F.when(F.pmod("home", F.lit(shares)) == share, F.flatten("ways")).alias("way")  # before the rows are multiplied
        visits = routed.select(F.col("ways")[share].alias("cells"), "head", "v", "copies", F.col("home").cast("long").alias("home"), way)
        visits = visits.select(F.explode("cells").alias("cell"), "head", "v", "copies", "home", "way")
        # no more of a share's cells than it has chunks
        visits = visits.join(F.broadcast(sizes.where(F.pmod("cell", F.lit(shares)) == share)), "cell", "left")
        own = F.when(F.col("cell") == F.col("home"), F.col("way")).alias("way")
        visits = visits.select(F.col("cell").cast("long").alias("cell"), "head", "v", "copies", "home", own, F.coalesce("k", F.lit(1)).alias("k"))
        blocks = pair_blocks(visits, F.col("head"), "k", chunk).select(*keys, "c", "head", "v", "copies", "home", "way")
        blocks = blocks.repartition(*keys).sortWithinPartitions(*keys)
        found.append(materialise(blocks.mapInArrow(_verify(dims, threshold), "a long, n long, b long"), "links"))
    release(routed, sizes)
    return reduce(DataFrame.unionByName, found)


def embedding_classes(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = 0.9,
    target: float = 0.98,
    sample: int = SAMPLE,
    probes: int = PROBES,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    single = dict(vectors.select(F.col(embedding).alias("v")).dtypes)["v"] == "array<float>"  # as exact, in half of the bytes
    v = F.col(embedding).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(_usable(v), v).alias("v"))
    # 128 bits know a vector again, so that whole vectors don't meet in the last join
    marks = [F.when(F.col("v").isNotNull(), h).alias(c) for c, h in (("one", F.xxhash64("v")), ("other", F.xxhash64(F.lit(1), "v")))]
    heads = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"))
    # several vectors under one id stay apart in the index; those under none get a number of their own
    number = F.coalesce("head", F.monotonically_increasing_id() + F.lit(UNKNOWN))
    heads = materialise(heads.select(number.alias("head"), "v", "copies", F.size("v").alias("dims"), *marks), "vectors")
    lengths = [r.dims for r in heads.groupBy("dims").count().orderBy("dims").collect()]
    routed = [(*_routed(heads.where(F.col("dims") == d).select("head", "v", "copies"), d, threshold, target, sample, probes), d) for d in lengths]
    known = materialise(heads.drop("v", "dims"), "known")
    release(heads)
    found = [_links(table, shares, d, threshold, chunk) for table, shares, d in routed]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = reduce(DataFrame.unionByName, found)
    links = found.groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n"))
    groups = connected_components(found).withColumnRenamed("node", "head")
    own = known.join(links, "head", "left").join(groups, "head", "left")
    out = rows.select("vec_id", *marks).join(own, ["one", "other"], "left")
    component = F.when(F.col("vec_id").isNull(), F.lit(None).cast("long")).otherwise(F.least(F.coalesce("component", "head", "vec_id"), "vec_id"))
    return out.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
