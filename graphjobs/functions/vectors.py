"""Vector columns: keyed sums, dense layers and row-wise functions.

Keyed sums of weighted vectors run as numpy segment sums: first where the rows are read, over runs of rows of bounded
size, so that partial sums are shuffled and not rows, then over the key-sorted partial sums. Sums along edges run by
blocks of sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else dims or 0)


def lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def _segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sums of w * x over runs of equal keys; the last run of a batch is carried to the next."""
    carried: tuple[list, np.ndarray] | None = None
    names: list[str] = []

    def out(key_rows: list[list], sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(k, t) for k, t in zip(key_rows, types)], lists(sums)], [*names, "x"])

    types: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names, types = batch.schema.names[:keys], [f.type for f in batch.schema][:keys]
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        x = matrix(batch.column(keys + 1)) * batch.column(keys).to_numpy()[:, None]
        new = np.zeros(len(x), bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(x, starts, axis=0)
        heads = [c[starts].tolist() for c in cols]
        if carried:
            if [h[0] for h in heads] == carried[0]:
                sums[0] += carried[1]
            else:
                yield out([[k] for k in carried[0]], carried[1][None])
        carried = [h[-1] for h in heads], sums[-1].copy()
        if len(starts) > 1:
            yield out([h[:-1] for h in heads], sums[:-1])
    if carried:
        yield out([[k] for k in carried[0]], carried[1][None])


#: Bytes of vectors whose rows are added up together before the shuffle.
TOGETHER = 32 << 20


def _added(cols: list[np.ndarray], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of x added up by key, in the order of the keys."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.append(True, np.zeros(len(x) - 1, bool))
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return [c[starts] for c in cols], np.add.reduceat(x[order], starts, axis=0)


def _partial(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sums of w * x by key over runs of rows of about ``TOGETHER`` bytes; columns are the keys, w and x."""

    def out(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        names, types = waiting[0].schema.names[:keys], [f.type for f in waiting[0].schema][:keys]
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in waiting]) for i in range(keys)]
        cols, sums = _added(cols, np.concatenate([matrix(b.column(keys + 1)) * b.column(keys).to_numpy()[:, None] for b in waiting]))
        return pa.RecordBatch.from_arrays([*[pa.array(c.tolist(), t) for c, t in zip(cols, types)], lists(sums)], [*names, "x"])

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column(keys + 1).nbytes
            if size >= TOGETHER:
                yield out(waiting)
                waiting, size = [], 0
    if waiting:
        yield out(waiting)


def segment_vector_sum(df: DataFrame, keys: list[str], weight: str, vec: str, salt: int = 1) -> DataFrame:
    """(keys, x): sum of weight * vec per key. Rows are added up where they are read, then partial sums by key; salt > 1
    adds those in two stages, for keys with so many rows that their partial sums are many too."""
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)
    rows = df.select(*keys, F.col(weight).cast("double").alias("w"), vec).mapInArrow(lambda b: _partial(b, n), f"{fields}, x array<double>")
    one = F.lit(1.0).alias("w")
    if salt > 1:
        rows = rows.select(*keys, F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int").alias("_salt"), one, "x")
        first = rows.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt")
        rows = first.mapInArrow(lambda b: _segments(b, n + 1), f"{fields}, _salt int, x array<double>")
    done = rows.select(*keys, one, "x").repartition(*keys).sortWithinPartitions(*keys)
    return done.mapInArrow(lambda b: _segments(b, n), f"{fields}, x array<double>")


#: Edges of a block, and edges whose weighted vectors are made at once.
BLOCK, AT_ONCE = 1 << 19, 1 << 15


def _edge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, dst, nodes, weights): a partition's edges (block, node, dst, w) as one row for each dst, ``BLOCK`` edges at a time."""

    def out(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(waiting).combine_chunks().sort_by("dst")
        dst = t["dst"].to_numpy()
        starts = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
        ends = pa.array(np.append(starts, len(dst)), pa.int32())
        listed = [pa.ListArray.from_arrays(ends, t[c].combine_chunks()) for c in ("node", "w")]
        return pa.RecordBatch.from_arrays([t["block"].take(starts).combine_chunks(), t["dst"].take(starts).combine_chunks(), *listed], ["block", "dst", "nodes", "weights"])

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                yield out(waiting)
                waiting, size = [], 0
    if waiting:
        yield out(waiting)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, x): sums of weight * x by node and block, from rows (block, nodes, weights, x) by block. What is held are the
    sums of one block's nodes."""
    block, parts, rows, settled, kind = None, [], 0, 0, None

    def joined() -> tuple[list[np.ndarray], np.ndarray]:
        return _added([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]))

    def done() -> Iterator[pa.RecordBatch]:
        (ids,), sums = joined()
        for i in range(0, len(ids), AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + AT_ONCE], kind), lists(sums[i : i + AT_ONCE])], ["node", "x"])

    for batch in batches:
        if not batch.num_rows:
            continue
        at, kind = batch["block"].to_numpy(), batch.schema.field("nodes").type.value_type
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for low, high in zip(cuts, cuts[1:]):
            if at[low] != block:
                if parts:
                    yield from done()
                block, parts, rows, settled = at[low], [], 0, 0
            own = batch.slice(low, high - low)
            x, nodes, weights = matrix(own["x"]), own["nodes"].flatten().to_numpy(), own["weights"].flatten().to_numpy()
            row = np.repeat(np.arange(len(own)), own["nodes"].value_lengths().to_numpy())
            for i in range(0, len(nodes), AT_ONCE):
                some = slice(i, i + AT_ONCE)
                (ids,), sums = _added([nodes[some]], x[row[some]] * weights[some, None])
                parts.append((ids, sums))
                rows += len(ids)
                if rows - settled > max(settled, 2 * AT_ONCE):
                    (ids,), sums = joined()
                    parts, rows, settled = [(ids, sums)], len(ids), len(ids)
    if parts:
        yield from done()


def weighted_sums_by_block(e: DataFrame, x: DataFrame) -> DataFrame:
    """(node, x): sums of weight * x[dst] over the edges e(src, dst, weight, piece), complete for each (src, piece).

    Edges are dealt in blocks of sources (and pieces) next to each other, of about ``BLOCK`` edges. A vector goes once to each
    block that needs it, with the list of its edges there; so what moves is vectors by block and not sums by edge: about
    the vectors' own size where neighbours' ids are near each other, and never more than a vector an edge."""
    spark = e.sparkSession
    blocks = max(spark.sparkContext.defaultParallelism, -(-e.count() // BLOCK))
    kinds = {c: e.schema[c].dataType.simpleString() for c in ("src", "dst")}
    dealt = e.repartitionByRange(blocks, "src", "piece").select(F.spark_partition_id().alias("block"), F.col("src").alias("node"), "dst", F.col("weight").cast("double").alias("w"))
    listed = dealt.mapInArrow(_edge_lists, f"block int, dst {kinds['dst']}, nodes array<{kinds['src']}>, weights array<double>")
    met = listed.join(x.select(F.col("node").alias("dst"), "x").hint("merge"), "dst").select("block", "nodes", "weights", "x")
    return met.repartition("block").sortWithinPartitions("block").mapInArrow(_block_sums, f"node {kinds['src']}, x array<double>")


def linear(df: DataFrame, vec: str, w: np.ndarray, b: np.ndarray | None = None, name: str | None = None) -> DataFrame:
    """vec * w.T + b as column ``name``; w and b are model parameters of a fixed size."""
    name = name or vec
    keep = [c for c in df.columns if c != name]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index(vec)), w.shape[1])
            y = x @ w.T + (0 if b is None else b)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], lists(y)], [*keep, name])

    return df.mapInArrow(run, f"{fields}, `{name}` array<double>")


def elu(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1))


def row_layer_norm(vec: Column, scale: Column | None = None, offset: Column | None = None) -> Column:
    """(x - mean) / sqrt(population variance + 1e-9) * scale + offset within the row."""
    n = F.size(vec)

    def centred(total: Column) -> Column:  # sums are lambda variables here, so each is computed once a row
        mean = total / n
        square = lambda s, x: s + (x - mean) * (x - mean)
        return F.aggregate(vec, F.lit(0.0), square, lambda q: F.transform(vec, lambda x: (x - mean) / F.sqrt(q / n + F.lit(1e-9))))

    out = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x, centred)
    if scale is not None:
        out = F.zip_with(out, scale, lambda x, y: x * y)
    return out if offset is None else F.zip_with(out, offset, lambda x, y: x + y)


def elu_and_norm(df: DataFrame, vec: str, scale: np.ndarray | None = None, offset: np.ndarray | None = None) -> DataFrame:
    """elu and row_layer_norm in one vectorised pass, for wide vectors."""
    keep = [c for c in df.columns if c != vec]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index(vec)))
            x = np.where(x > 0, x, np.expm1(np.minimum(x, 0)))
            if x.size:
                x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-9)
                x = x * (1 if scale is None else scale) + (0 if offset is None else offset)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], lists(x)], [*keep, vec])

    return df.mapInArrow(run, f"{fields}, `{vec}` array<double>")


def l2_normalize(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x, lambda q: F.transform(vec, lambda x: x / F.greatest(F.sqrt(q), F.lit(1e-12))))


def sigmoid(vec: Column) -> Column:
    return F.transform(vec, lambda x: 1 / (1 + F.exp(-x)))


def softmax(vec: Column) -> Column:
    def shifted(top: Column) -> Column:
        return F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.exp(x - top), lambda q: F.transform(vec, lambda x: F.exp(x - top) / q))

    return F.aggregate(vec, F.lit(float("-inf")), lambda s, x: F.greatest(s, x), shifted)


def concat_self_and_neighbors(own: DataFrame, agg: DataFrame) -> DataFrame:
    """(node, x): own vector, then the aggregated one, by node."""
    return own.join(agg.select("node", F.col("x").alias("_agg")), "node").select("node", F.concat("x", "_agg").alias("x"))
