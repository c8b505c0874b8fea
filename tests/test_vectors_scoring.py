"""Vector sums three ways, encoders against numpy, losses and F1."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphjobs.functions import vectors as V
from graphjobs.operators import graph as G
from graphjobs.operators import sampling as M
from graphjobs.operators import scoring as E


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((12, 12)) < 0.3) * rng.integers(1, 4, (12, 12))
    a[11] = 0
    x = rng.normal(size=(12, 5))
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i, j in zip(*(k.tolist() for k in np.nonzero(a)))], "src bigint, dst bigint, weight double")
    return a, x, e.cache(), spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node bigint, x array<double>").cache()


def dense(df, col="x", n=12):
    got = {r.node: r[col] for r in df.collect()}
    return np.array([got[i] for i in range(n)])


@pytest.mark.parametrize("most", [1 << 20, 3, 1])
def test_neighbour_sums_agree(spark, data, most, monkeypatch):
    """Rows of more than ``most`` edges are cut into pieces; sums are handed on after every few rows."""
    a, x, e, f = data
    monkeypatch.setattr(V, "TOGETHER", 100)
    nodes = f.select("node")
    assert np.allclose(dense(E.aggregate_neighbors(e, f, nodes, E.hub_rows(e, most))), a @ x)
    assert np.allclose(dense(E.aggregate_transposed(e, f, nodes)), a.T @ x)
    by_columns = {r.node: r.x for r in E.aggregate_neighbors_by_columns(e, f, 5).collect()}
    assert all(np.allclose(v, (a @ x)[k]) for k, v in by_columns.items())


def _norm(x):
    x = np.where(x > 0, x, np.expm1(np.minimum(x, 0)))
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-9)


def _head(x, head):
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x @ head["w"].T + head["b"]


def test_encoders(spark, data):
    a, x, e, f = data
    rows = a.sum(1, keepdims=True)
    m = np.divide(a, rows, out=np.zeros(a.shape), where=rows > 0)
    norm = G.row_normalize(e)
    layers, head = E.encoder_params([5, 3], [1, 0], 2)
    h = _norm(np.hstack([x @ layers[0]["self.w"].T + layers[0]["self.b"], m @ x @ layers[0]["w.w"].T + layers[0]["w.b"]]))
    h = _norm(h @ layers[1]["w.w"].T + layers[1]["w.b"])
    assert np.allclose(dense(E.graphsage_infer(norm, f, layers, [1, 0], head), "scores"), _head(h, head))
    layers, head = E.encoder_params([5, 3], [1, 1], 2, "gcn")
    h = x
    for p in layers:
        h = _norm(m @ h @ p["w.w"].T + p["w.b"])
    assert np.allclose(dense(E.gcn_infer(norm, f, layers, [1, 1], head), "scores"), _head(h, head))


def test_sampled_encoder_with_everything_drawn(spark, data):
    a, x, e, f = data
    seeds = spark.createDataFrame([(0, i) for i in (0, 3, 5)], "batch_id bigint, node bigint")
    layers, head = E.encoder_params([5, 3], [1], 2)
    blocks, sets = M.layerwise_sample(e, seeds, [100], [1], 1)
    got = {r.node: r.scores for r in E.sampled_infer(blocks, sets, f, layers, [1], head).collect()}
    b = np.zeros((12, 12))
    for r in blocks.collect():
        b[r.src, r.dst] = r.value
    p = layers[0]
    h = _norm(np.hstack([x @ p["self.w"].T + p["self.b"], b @ x @ p["w.w"].T + p["w.b"]]))
    assert sorted(got) == [0, 3, 5]
    assert all(np.allclose(got[k], _head(h, head)[k]) for k in got)
    layers, head = E.encoder_params([5, 3], [1], 2, "gcn")
    got = {r.node: r.scores for r in E.sampled_infer(blocks, sets, f, layers, [1], head, "gcn").collect()}
    h = _norm(b @ x @ layers[0]["w.w"].T + layers[0]["w.b"])
    assert sorted(got) == [0, 3, 5] and all(np.allclose(got[k], _head(h, head)[k]) for k in got)
    layers, head = E.encoder_params([5, 3], [0], 2, "gcn")
    got = {r.node: r.scores for r in E.sampled_infer(None, seeds, f, layers, [0], head, "gcn").collect()}
    h = _norm(x @ layers[0]["w.w"].T + layers[0]["w.b"])
    assert sorted(got) == [0, 3, 5] and all(np.allclose(got[k], _head(h, head)[k]) for k in got)


def test_row_functions(spark, data):
    _, x, _, f = data
    got = f.select("node", V.row_layer_norm(V.elu(F.col("x"))).alias("x"))
    assert np.allclose(dense(got), _norm(x))
    assert np.allclose(dense(f.select("node", V.softmax(F.col("x")).alias("x"))).sum(1), 1)
    assert np.allclose(np.linalg.norm(dense(f.select("node", V.l2_normalize(F.col("x")).alias("x"))), axis=1), 1)


def test_multilabel_f1(spark):
    true = spark.createDataFrame([(0, [1, 0]), (1, [1, 1]), (2, [0, 1]), (3, [0, 0])], "node bigint, labels array<int>")
    pred = spark.createDataFrame([(0, [0.9, 0.5]), (1, [0.4, 0.8]), (2, [0.2, 0.7]), (3, [0.6, 0.1])], "node bigint, scores array<double>")
    r = E.f1_multilabel(true, E.threshold_predictions(pred)).first()
    assert (r.micro, r.macro) == (0.75, 0.75)


def test_losses_broadcast_no_arrays(spark, tmp_path):
    """Estimates of sizes don't see how long computed arrays are; no side may be broadcast by them."""
    spark.range(1000).select(F.col("id").alias("node")).write.parquet(str(tmp_path / "n"))
    n = spark.read.parquet(str(tmp_path / "n"))
    pred = n.select("node", F.array(*[F.lit(0.1) * c for c in range(10)]).alias("scores"))
    true = n.select("node", F.array(*[F.lit(c % 2) for c in range(10)]).alias("labels"), F.lit(1).alias("label"), F.lit(1).alias("target"))
    for df in (E.bce_loss(pred, true), E.cross_entropy_loss(pred, true), E.f1_multilabel(true, E.threshold_predictions(pred)), E.f1_multiclass(true, E.argmax_class(pred))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_losses_of_unequal_and_null_arrays(spark):
    """Elements meet at the same place; places that only one side has, and null elements and arrays, don't count."""
    pred = spark.createDataFrame([(1, [0.0, 2.0, 5.0]), (2, [1.0]), (3, None), (4, [None, 3.0]), (5, [])], "node bigint, scores array<double>")
    true = spark.createDataFrame([(1, [1, 0]), (2, [1, 1, 1]), (3, [1]), (4, [1, 1]), (5, [1]), (6, [1])], "node bigint, labels array<int>")
    bce = lambda x, y: max(x, 0) - x * y + np.log1p(np.exp(-abs(x)))
    expected = (bce(0, 1) + bce(2, 0) + bce(1, 1) + bce(3, 1)) / 3
    assert E.bce_loss(pred, true).first().loss == pytest.approx(expected)


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_sums_by_block(spark, monkeypatch, at_once):
    """A row for each block and neighbour goes to a block's sums; whatever the runs, they are those of each block's nodes."""
    monkeypatch.setattr(V, "AT_ONCE", at_once)
    monkeypatch.setattr(V, "BLOCK", 5 * at_once)
    rng = np.random.default_rng(2)
    edges = sorted({(int(s) // 8, int(s), int(d)) for s, d in rng.integers(0, 24, (150, 2))})
    block, src, dst = map(np.array, zip(*edges))
    w, x = rng.random(len(src)), rng.normal(size=(24, 3)).astype(np.float32)
    listed = []
    for b in range(3):
        own = pa.RecordBatch.from_arrays([pa.array(block[block == b].astype(np.int32)), pa.array(src[block == b]), pa.array(dst[block == b]), pa.array(w[block == b])], ["block", "node", "dst", "w"])
        listed += V._edge_lists(iter([own.slice(0, 9), own.slice(9)]))
    assert at_once < 1000 or sum(map(len, listed)) == len({(b, d) for b, _, d in edges})
    rows = [pa.RecordBatch.from_arrays([r["block"], r["nodes"], r["weights"], pa.array(x[r["dst"].to_numpy()].tolist(), pa.list_(pa.float32()))], ["block", "nodes", "weights", "x"]) for r in listed]
    got = [(n, v) for r in V._block_sums(iter(rows)) for n, v in zip(r["node"].to_pylist(), r["x"].to_pylist())]
    assert sorted(n for n, _ in got) == sorted(set(src.tolist()))
    for n, v in got:
        assert np.allclose(v, (w[src == n, None] * x[dst[src == n]]).sum(0))


@pytest.mark.parametrize("kind", ["graphsage", "gcn"])
def test_narrowing_layers_come_before_sums(spark, data, monkeypatch, kind):
    """Rows of the layer's width, not of the features', go along edges; a widening layer comes after them."""
    _, _, e, f = data
    summed, widths = E.aggregate_neighbors, []

    def seen(e, x, *more):
        widths.append(len(x.first().x))
        return summed(e, x, *more)

    monkeypatch.setattr(E, "aggregate_neighbors", seen)
    infer = E.graphsage_infer if kind == "graphsage" else E.gcn_infer
    for hidden, expected in ((3, 3), (7, 5)):
        layers, head = E.encoder_params([5, hidden], [1], 2, kind)
        infer(e, f, layers, [1], head)
        assert widths.pop() == expected
