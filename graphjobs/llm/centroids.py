"""Centroid clustering (operator 13): Lloyd's rounds by kd-tree filtering, in whole numbers.

Components become floor(scale * x). The centroids start as the ``k`` vectors of smallest sha256 of
"1:<vec_id>". Each of ``rounds`` rounds assigns every vector to its nearest centroid (squared Euclidean
distance, ties to the smaller number) and moves each centroid to the floor of its vectors' mean; empty ones
stay. Then all are assigned once more.

1. Once, each partition deals its vectors into blocks of at most ``BLOCK`` and writes a kd-tree for each: the
   vectors in the tree's order, and for every node its box and the sum of its vectors (its count is its range's
   length). All rounds read these trees; vectors are never shuffled.
2. A round filters the centroids from the root down: of a node's candidates, the nearest to the box's middle
   dominates another one *strictly* if it is nearer at the corner of the box where the other does best, and
   so everywhere in the box. Candidates that tie anywhere stay. A node with one candidate left goes to it whole, by its
   count and sum. A leaf with several is resolved vector by vector.
3. A task adds up counts and sums by centroid in 64-bit integers; Spark sums those, and the driver sees one
   number for each component of the centroids.

Vectors that are null, hold null or non-finite components, or haven't exactly ``dims`` components, are left
out. Components beyond 2 ** 27 in size after scaling are held there. Null vec_id: its hash ranks last, else
treated like others. Rows that share a vec_id are rows of their own, ordered by their components where
hashes tie. Fewer vectors than ``k``: as many centroids. Sums of distances beyond 64 bits are held at the
largest long. Further columns aren't read, whatever their names. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .integer_vectors import finite, rows_of, scaled, squares, summed_by

SCALE, DIMS, K, ROUNDS = 64, 64, 16, 3
BLOCK, LEAF = 4096, 64
MOST = np.iinfo(np.int64).max
#: A tree's arrays are written as bytes, which no encoding of the files makes small and a reader large again.
TYPES = {"x": np.int32, "lo": np.int32, "hi": np.int32, "sums": np.int64}


def node_ranges(n: int) -> list[tuple[int, int, int]]:
    """(begin, end, left child or 0 for a leaf) of the nodes of a tree over n points that is halved down to leaves; a
    right child follows its left one in the list."""
    out = [(0, n, 0)]
    at = 0
    while at < len(out):
        a, b, _ = out[at]
        if b - a > LEAF:
            out[at] = (a, b, len(out))
            out += [(a, (a + b) // 2, 0), ((a + b) // 2, b, 0)]
        at += 1
    return out


def build_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, lo, hi, sums): the order of the points in the tree, and each node's box and sum. Nodes are halved across
    their widest side."""
    order, nodes = np.arange(len(x)), node_ranges(len(x))
    lo, hi, sums = (np.zeros((len(nodes), x.shape[1]), np.int64) for _ in range(3))
    for k, (a, b, left) in enumerate(nodes):
        own = x[order[a:b]]
        lo[k], hi[k], sums[k] = own.min(0), own.max(0), own.sum(0)
        if left:
            axis = int((hi[k] - lo[k]).argmax())
            order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
    return order, lo, hi, sums


def undominated(lo: np.ndarray, hi: np.ndarray, some: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The candidates that no other one beats strictly at every point of the box."""
    c = centroids[some]
    best = c[squares(2 * c, lo + hi).argmin()]
    corner = np.where(c > best, hi, lo)  # where each candidate does best against it
    return some[squares(c, corner) <= squares(best, corner)]


def settled(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(node, begin, end, candidates) of the nodes that filtering ends at: one candidate is left, or it is a leaf."""
    nodes, todo = node_ranges(len(x)), [(0, np.arange(len(centroids)))]
    while todo:
        node, some = todo.pop()
        some = undominated(lo[node], hi[node], some, centroids)
        a, b, left = nodes[node]
        if left and len(some) > 1:
            todo += [(left, some), (left + 1, some)]
        else:
            yield node, a, b, some


def _grow(dims: int):
    """Blocks of vectors as trees, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = rows_of(batch.column(1), dims)
            order, *nodes = build_tree(x)

            ids = batch.column(0).take(pa.array(order))
            packed = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in zip((x[order], *nodes), TYPES.values())]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *packed], ["ids", *TYPES])

        waiting: list[pa.RecordBatch] = []
        rows = 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, BLOCK - rows)
                at, rows = at + batch.num_rows, rows + batch.num_rows
                waiting.append(batch)
                if rows == BLOCK:
                    yield tree(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    waiting, rows = [], 0
        if rows:
            yield tree(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    return run


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch["ids"][k].values, *(np.frombuffer(batch[c][k].as_buffer(), t).astype(np.int64).reshape(-1, dims) for c, t in TYPES.items())


def _add_up(sent, dims: int):
    """Partial sums of a task: n and the sum of component i of each centroid's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        counts, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for _, x, lo, hi, sums in _trees(batches, dims):
            for node, a, b, some in settled(x, lo, hi, centroids):
                if len(some) == 1:
                    counts[some[0]] += b - a
                    total[some[0]] += sums[node]
                else:
                    own = squares(x[a:b, None], centroids[some][None]).argmin(1)
                    n, s = summed_by(own, x[a:b], len(some))
                    counts[some] += n
                    total[some] += s
        used = np.flatnonzero(counts)
        cols = [np.repeat(used, dims), np.tile(np.arange(dims), len(used)), np.repeat(counts[used], dims), total[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cluster", "i", "n", "s"])

    return run


def _assign(sent, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        for ids, x, lo, hi, _ in _trees(batches, dims):
            own, far = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            for _, a, b, some in settled(x, lo, hi, centroids):
                d = squares(x[a:b, None], centroids[some][None])
                first = d.argmin(1)
                own[a:b], far[a:b] = some[first], d[np.arange(b - a), first]
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    v = F.col(embedding).cast("array<double>")
    kept = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where((F.size("v") == dims) & finite(F.col("v")))
    rows = kept.select("vec_id", scaled(F.col("v"), scale).alias("x"))
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dims)
    kind = rows.schema["vec_id"].dataType.simpleString()
    trees = materialise(rows.mapInArrow(_grow(dims), f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in TYPES)), "trees")
    context = rows.sparkSession.sparkContext
    for _ in range(rounds if len(centroids) else 0):
        sent = context.broadcast(centroids)
        partial = trees.mapInArrow(_add_up(sent, dims), "cluster long, i long, n long, s long")
        centroids = centroids.copy()
        for r in partial.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # a row a component
            centroids[r.cluster, r.i] = r.s // r.n
        sent.unpersist()
    sent = context.broadcast(centroids)
    own = materialise(trees.mapInArrow(_assign(sent, dims), f"vec_id {kind}, cluster int, distance long"), "assigned")
    release(trees)
    held = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_cluster = own.groupBy("cluster").agg(held("distance").alias("cluster_inertia"))
    digests = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids.tolist())]
    known = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sizes = by_cluster.join(by_cluster.agg(held("cluster_inertia").alias("inertia"))).join(known, "cluster")
    out = own.join(F.broadcast(sizes), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """An assignment to the centroids c{n} and the centroids c{n + 1} after it."""
    return f"""a{n} AS MATERIALIZED (
  SELECT vec_id, x, min(struct_pack(d := d, cluster := cluster)) AS near FROM (
    SELECT vec_id, x, cluster, list_sum(list_transform(range(1, 65), lambda i: (x[i] - z[i]) * (x[i] - z[i])))::BIGINT AS d FROM v, c{n}) GROUP BY vec_id, x),
c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.z, c.z) AS z FROM c{n} c LEFT JOIN (
    SELECT cluster, list(floor(s / k)::BIGINT ORDER BY i) AS z FROM (
      SELECT near.cluster AS cluster, i, sum(x[i]) AS s, count(*) AS k FROM a{n}, (SELECT range AS i FROM range(1, 65)) GROUP BY near.cluster, i) GROUP BY cluster) m
  ON m.cluster = c.cluster),
"""


#: For vectors with ids of their own, as the given tables hold.
SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x AS z FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)),
{_round(0)}{_round(1)}{_round(2)}{_round(3).partition("c4 AS")[0].rstrip().rstrip(",")}
SELECT vec_id, near.cluster::INT AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.cluster))::BIGINT AS cluster_inertia,
  (sum(near.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.cluster = near.cluster
"""
