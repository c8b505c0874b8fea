"""Vector code compression (operator 11): product quantisation in whole numbers, kd-trees over the codebooks.

A vector is cut into ``parts`` consecutive parts; each part position has a codebook of at most ``entries``
entries, at first that part of the vectors of smallest vec_id. A round assigns every part to its nearest
entry (squared Euclidean distance, ties to the lower index) and moves each entry to the floor of its parts'
mean; unused entries stay. After the last round all parts are assigned again.

1. Components become integers once, in a written table that all passes read; no pass shuffles vectors.
2. Each round broadcasts a kd-tree of each codebook: parts x entries x width integers, whatever the table's
   size. The search goes down a tree with all parts of a batch at once, to the nearer child first, and skips
   a node for the parts whose distance to its box is *above* the best one so far. Nodes at an equal
   distance are visited, so that an entry of a lower index that ties is never lost.
3. A task adds up its parts by entry in 64-bit integers; Spark sums those partial sums, and the driver sees
   one number for each component of the codebooks.

Vectors that are null or hold null or non-finite components are dropped. Vectors of different lengths have
codebooks of their own, one length after the other; a length that ``parts`` doesn't divide is cut as evenly
as it can be, and an empty vector has the code of zeros and no error. Components beyond 2 ** 27 in size after
scaling are held there. Null vec_id: ranks last, coded like others. Rows that share a vec_id are rows of
their own, ordered by their components where codebooks begin. Null labels are one group. Sums of errors
beyond 64 bits are held at the largest long. Further columns aren't read, whatever their names. Fewer
vectors than entries: smaller codebooks. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .integer_vectors import finite, rows_of, scaled, squares, summed_by

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LEAF = 8
BATCH = 8192
FAR = np.iinfo(np.int64).max


class CodebookTree:
    """A kd-tree over the entries of one codebook, for the nearest entries of many points at once."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple] = []  # (lo, hi, members, None) of a leaf, or (lo, hi, (axis, cut), (left, right))
        self._build(np.arange(len(entries)))

    def _build(self, members: np.ndarray) -> int:
        at, x = len(self.nodes), self.entries[members]
        lo, hi = x.min(0), x.max(0)
        self.nodes.append((lo, hi, np.sort(members), None))
        if len(members) > LEAF and x.shape[1]:
            axis = int((hi - lo).argmax())
            order = members[np.argsort(x[:, axis], kind="stable")]
            half = len(order) // 2
            cut = self.entries[order[half], axis]
            self.nodes[at] = (lo, hi, (axis, cut), (self._build(order[:half]), self._build(order[half:])))
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, the lower index where entries tie."""
        best, index = np.full(len(points), FAR), np.full(len(points), len(self.entries))

        def visit(node: int, at: np.ndarray) -> None:
            lo, hi, inner, children = self.nodes[node]
            x = points[at]
            outside = np.maximum(np.maximum(lo - x, x - hi), 0)
            near = (outside * outside).sum(1) <= best[at]  # an equal bound may hide a tie of a lower index
            at, x = at[near], x[near]
            if not len(at):
                return
            if children is None:
                d = squares(x[:, None], self.entries[inner][None])
                first = d.argmin(1)
                d, entry = d[np.arange(len(at)), first], inner[first]
                better = (d < best[at]) | ((d == best[at]) & (entry < index[at]))
                best[at[better]], index[at[better]] = d[better], entry[better]
                return
            axis, cut = inner
            below = x[:, axis] < cut
            left, right = children
            visit(left, at[below])
            visit(right, at)
            visit(left, at[~below])

        visit(0, np.arange(len(points)))
        return index, best


def _cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


def _add_up(trees, cuts: list[tuple[int, int]], dims: int):
    """Partial sums of a task: n and the sum of component i of the parts assigned to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = trees.value
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        sums = [np.zeros_like(b.entries) for b in books]
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                x = rows_of(whole.column(0).slice(lo, BATCH), dims)
                for p, (a, b) in enumerate(cuts):
                    n, s = summed_by(books[p].nearest(x[:, a:b])[0], x[:, a:b], len(counts[p]))
                    counts[p] += n
                    sums[p] += s
        for p, (n, s) in enumerate(zip(counts, sums)):
            used = np.flatnonzero(n)
            entry, i = np.repeat(used, s.shape[1]), np.tile(np.arange(s.shape[1]), len(used))
            cols = [np.full(len(entry), p), entry, i, np.repeat(n[used], s.shape[1]), s[used].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "entry", "i", "n", "s"])

    return run


def _encode(trees, cuts: list[tuple[int, int]], dims: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                x = rows_of(batch.column(batch.schema.get_field_index("x")), dims)
                found = [trees.value[p].nearest(x[:, a:b]) for p, (a, b) in enumerate(cuts)]
                digits = np.stack([index for index, _ in found], 1).astype(np.uint8).tobytes().hex()
                width = 2 * len(cuts)
                codes = pa.array([digits[k * width : (k + 1) * width] for k in range(len(x))], pa.string())
                error = pa.array(np.sum([d for _, d in found], axis=0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], codes, error], [*names, "code", "error"])

    return run


def fit_codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, from rows (vec_id, x) of vectors of ``dims`` integers."""
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    cuts = _cuts(dims, parts)
    books = [start[:, a:b].copy() for a, b in cuts]
    for _ in range(rounds):
        trees = rows.sparkSession.sparkContext.broadcast([CodebookTree(b) for b in books])
        partial = rows.select("x").mapInArrow(_add_up(trees, cuts, dims), "part long, entry long, i long, n long, s long")
        for r in partial.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # a row a component
            books[r.part][r.entry, r.i] = r.s // r.n
        trees.unpersist()
    return books


def encode_vectors(rows: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """rows without x, with code (two hex digits a part) and error."""
    trees = rows.sparkSession.sparkContext.broadcast([CodebookTree(b) for b in books])
    names = [c for c in rows.columns if c != "x"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(_encode(trees, _cuts(dims, len(books)), dims, names), f"{kinds}, code string, error long")


def digest_of(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    v = F.col(embedding).cast("array<double>")
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v")).where(finite(F.col("v")))
    rows = materialise(kept.select("vec_id", "label", scaled(F.col("v"), scale).alias("x"), F.size("v").alias("dims")), "integers")
    coded = []
    for dims in [r.dims for r in rows.groupBy("dims").count().orderBy("dims").collect()]:
        own = rows.where(F.col("dims") == dims).drop("dims")
        books = fit_codebooks(own, dims, parts, entries, rounds)
        coded.append(encode_vectors(own, books, dims).withColumn("codebooks_sha256", F.lit(digest_of(books))))
    if not coded:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialise(reduce(DataFrame.unionByName, coded), "codes")
    release(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(FAR).cast("decimal(38,0)")).cast("long")
    totals = materialise(coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")), "label_errors")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(k: int) -> str:
    """An assignment to the codebooks b{k} and the codebooks b{k + 1} after it."""
    return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, y, min(struct_pack(d := d, entry := entry)) AS near FROM (
    SELECT vec_id, p.part, p.y, entry, list_sum(list_transform(range(1, 5), lambda i: (p.y[i] - z[i]) * (p.y[i] - z[i])))::BIGINT AS d
    FROM p JOIN b{k} ON b{k}.part = p.part) GROUP BY vec_id, part, y),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, CASE WHEN m.z IS NULL THEN b.z ELSE m.z END AS z FROM b{k} b LEFT JOIN (
    SELECT part, near.entry AS entry, list_transform([sum(y[1]), sum(y[2]), sum(y[3]), sum(y[4])], lambda s: floor(s / count(*))::BIGINT) AS z
    FROM a{k} GROUP BY part, near.entry) m ON m.part = b.part AND m.entry = b.entry),
"""


#: For vectors of 64 components with ids of their own, as the given tables hold.
SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, r.part, x[r.part * 4 + 1 : r.part * 4 + 4] AS y FROM v, (SELECT range AS part FROM range(16)) r),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS z FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_round(0)}{_round(1)}{_round(2)}codes AS (
  SELECT vec_id, string_agg(lpad(lower(hex(near.entry)), 2, '0'), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN v USING (vec_id), book
"""
