"""Neighbour aggregation, full-graph and sampled encoders, losses and F1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialise
from ..functions.vectors import concat_self_and_neighbors, elu_and_norm, l2_normalize, linear, segment_vector_sum, weighted_sums_by_block
from .graph import transpose


#: Edges of a row from which on it is cut into pieces.
HUB = 1 << 20


def hub_rows(e: DataFrame, most: int = HUB) -> DataFrame:
    """(src, pieces): the rows of more than ``most`` edges, and into how many pieces they are cut. Mostly none; at most one
    row for ``most`` edges."""
    counts = e.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return materialise(counts.select("src", F.ceil(F.col("n") / most).cast("int").alias("pieces")), "hubs")


def aggregate_neighbors(e: DataFrame, x: DataFrame, nodes: DataFrame | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(node, x): sum over edges of weight * x[dst]. With nodes, those without edges get zeros.

    Vectors go once to each block of rows that needs them and are added up there (``weighted_sums_by_block``). The degree
    table ``hubs``, by default ``hub_rows(e)``, says which rows are cut into pieces by a hash of dst, so that a block may end
    within a row; the sums of such rows are added in a second stage, which other rows don't go through."""
    hubs = hub_rows(e) if hubs is None else hubs
    if hubs.isEmpty():
        out = weighted_sums_by_block(e.withColumn("piece", F.lit(-1)), x)
    else:
        cut = e.join(hubs, "src", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("dst"), "pieces").cast("int"), F.lit(-1)))
        sums = materialise(weighted_sums_by_block(cut, x), "pieces")
        cut_rows = hubs.select(F.col("src").alias("node"))
        parts = sums.join(cut_rows, "node", "left_semi").select("node", F.lit(1.0).alias("weight"), "x")
        out = sums.join(cut_rows, "node", "left_anti").unionByName(segment_vector_sum(parts, ["node"], "weight", "x"))
    if nodes is None:
        return out
    # one row, also where x has none
    zero = x.limit(1).agg(F.max(F.size("x")).alias("_d")).select(F.array_repeat(F.lit(0.0), F.coalesce("_d", F.lit(0))).alias("_zero"))
    return nodes.select("node").join(out, "node", "left").join(F.broadcast(zero)).select("node", F.coalesce("x", "_zero").alias("x"))


def aggregate_transposed(e: DataFrame, g: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The same along reversed edges."""
    return aggregate_neighbors(transpose(e), g, nodes)


def aggregate_neighbors_by_columns(e: DataFrame, x: DataFrame, dims: int) -> DataFrame:
    """The same from built-in sums, a column per dimension; for narrow vectors."""
    step = e.join(x.select(F.col("node").alias("dst"), "x"), "dst")
    sums = step.groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("weight") * F.col("x")[i]).alias(f"d{i}") for i in range(dims)])
    return sums.select("node", F.array(*[f"d{i}" for i in range(dims)]).alias("x"))


def _dense(p: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    return p[f"{name}.w"], p[f"{name}.b"]


def _narrows(w: np.ndarray) -> bool:
    """Whether the layer's rows are shorter behind it: then it comes before the sums over neighbours, as w (sum of a x) is the
    sum of a (w x), and the shorter rows move."""
    return w.shape[0] < w.shape[1]


def _plus(df: DataFrame, b: np.ndarray) -> DataFrame:
    """The bias b added to every row of x."""
    return df.withColumn("x", F.zip_with("x", F.array(*map(F.lit, b.tolist())), lambda v, c: v + c))


def _near(e: DataFrame, x: DataFrame, nodes: DataFrame, hubs: DataFrame, p: dict) -> DataFrame:
    """The dense layer of weighted sums over neighbours."""
    w, b = _dense(p, "w")
    if _narrows(w):
        return _plus(aggregate_neighbors(e, linear(x.select("node", "x"), "x", w), nodes, hubs), b)
    return linear(aggregate_neighbors(e, x, nodes, hubs), "x", w, b)


def _sage_layer(x: DataFrame, near: DataFrame | None, p: dict) -> DataFrame:
    if near is None:
        out = linear(x, "x", *_dense(p, "w"))
    else:
        out = concat_self_and_neighbors(linear(x, "x", *_dense(p, "self")), near)
    return elu_and_norm(out, "x", p.get("scale"), p.get("offset"))


def _head(x: DataFrame, head: dict) -> DataFrame:
    return linear(x.withColumn("x", l2_normalize(F.col("x"))), "x", head["w"], head["b"], "scores").drop("x")


def graphsage_infer(e: DataFrame, x: DataFrame, layers: list[dict], orders: list[int], head: dict) -> DataFrame:
    """(node, scores) of all nodes, layer by layer over all neighbours, without dropout."""
    nodes, hubs = x.select("node"), hub_rows(e)
    for p, order in zip(layers, orders):
        x = materialise(_sage_layer(x, _near(e, x, nodes, hubs, p) if order else None, p), "layer")
    return _head(x, head)


def gcn_infer(e: DataFrame, x: DataFrame, layers: list[dict], orders: list[int], head: dict) -> DataFrame:
    """The same without the self branch; e is the normalised A + I."""
    nodes, hubs = x.select("node"), hub_rows(e)
    for p, order in zip(layers, orders):
        out = _near(e, x, nodes, hubs, p) if order else linear(x, "x", *_dense(p, "w"))
        x = materialise(elu_and_norm(out, "x", p.get("scale"), p.get("offset")), "layer")
    return _head(x, head)


def sampled_infer(blocks: DataFrame, layer_nodes: DataFrame, x: DataFrame, layers: list[dict], orders: list[int], head: dict, kind: str = "graphsage") -> DataFrame:
    """(batch_id, node, scores) of each batch's seeds from sampled blocks; layer t uses block t. kind: graphsage or gcn.
    Where all orders are 0 there are no blocks, and layer_nodes holds the seeds."""
    used = [t for t, o in enumerate(orders) if o]
    key = ["batch_id", "node"]
    start = layer_nodes.where(F.col("layer") == used[0]) if used else layer_nodes
    h = start.select(*key).distinct().join(x, "node").select(*key, "x")
    for t, (p, order) in enumerate(zip(layers, orders)):
        if not order:
            h = elu_and_norm(linear(h, "x", *_dense(p, "w")), "x", p.get("scale"), p.get("offset"))
            continue
        block, (w, b) = blocks.where(F.col("layer") == t), _dense(p, "w")
        sent = linear(h, "x", w) if _narrows(w) else h
        step = block.join(sent.select("batch_id", F.col("node").alias("dst"), "x"), ["batch_id", "dst"])
        agg = segment_vector_sum(step.select("batch_id", F.col("src").alias("node"), "value", "x"), key, "value", "x")
        prev = layer_nodes.where((F.col("layer") == t) & F.col("is_prev")).select(*key)
        zero = [0.0] * min(w.shape)
        agg = prev.join(agg, key, "left").withColumn("x", F.coalesce("x", F.array(*map(F.lit, zero))))
        agg = _plus(agg, b) if _narrows(w) else linear(agg, "x", w, b)
        if kind == "graphsage":
            own = linear(prev.join(h, key), "x", *_dense(p, "self"))
            agg = own.join(agg.withColumnRenamed("x", "_agg"), key).select(*key, F.concat("x", "_agg").alias("x"))
        h = materialise(elu_and_norm(agg, "x", p.get("scale"), p.get("offset")), "layer")
    return _head(h, head)


def encoder_params(dims: list[int], orders: list[int], classes: int, kind: str = "graphsage") -> tuple[list[dict], dict]:
    """Parameters by formula, so that any engine can rebuild them: dims = [features, hidden]."""

    def dense(o: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.fromfunction(lambda a, c: ((a * 7 + c * 13) % 19 - 9) / 50, (o, i)), (np.arange(o) % 5 - 2) / 10

    layers, width = [], dims[0]
    for order in orders:
        p = {}
        for name in ("self", "w"):
            p[f"{name}.w"], p[f"{name}.b"] = dense(dims[1], width)
        layers.append(p)
        width = dims[1] * (1 + bool(order)) if kind == "graphsage" else dims[1]
    w, b = dense(classes, width)
    return layers, {"w": w, "b": b}


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables by node, merged and not broadcast: estimates of sizes don't see how long computed arrays are, so a
    broadcast chosen by them may bring every node's array to the driver."""
    return a.join(b.hint("merge"), "node")


def _zipped(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """(node, c, x, y): the elements of a's arrays beside those of b's at the same place c, where both have one. Arrays meet
    before they are exploded, so that a node and not each of its elements is a row of the join."""
    n = F.greatest(F.least(F.size("_x"), F.size("_y")), F.lit(0))
    both = _paired(a.select("node", F.col(x).alias("_x")), b.select("node", F.col(y).alias("_y")))
    each = F.arrays_zip(F.slice("_x", F.lit(1), n).alias("x"), F.slice("_y", F.lit(1), n).alias("y"))
    return both.select("node", F.posexplode(each).alias("c", "z")).select("node", "c", "z.x", "z.y")


def bce_loss(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sum over rows and classes of binary cross-entropy with logits, over rows."""
    z = _zipped(pred, "scores", labels, "labels")
    each = F.greatest(F.col("x"), F.lit(0.0)) - F.col("x") * F.col("y") + F.log1p(F.exp(-F.abs("x")))
    return z.agg((F.sum(each) / F.count_distinct("node")).alias("loss"))


def cross_entropy_loss(pred: DataFrame, target: DataFrame) -> DataFrame:
    """One row: mean of -log softmax at the target class."""
    top = F.array_max("scores")
    lse = top + F.log(F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return _paired(pred, target).agg(F.avg(lse - F.element_at("scores", (F.col("target") + 1).cast("int"))).alias("loss"))


def threshold_predictions(pred: DataFrame, at: float = 0.5) -> DataFrame:
    """Scores above the threshold as 1; the threshold itself as 0."""
    return pred.select("node", F.transform("scores", lambda x: (x > at).cast("int")).alias("predicted"))


def argmax_class(pred: DataFrame) -> DataFrame:
    """The first index of the largest score."""
    return pred.select("node", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("predicted"))


def _f1(counts: DataFrame) -> DataFrame:
    """(micro, macro) from per-class tp, fp, fn; 0 / 0 counts as 0."""

    def ratio(tp, fp, fn):
        return F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))

    each = ratio(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.agg(ratio(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"), F.avg(each).alias("macro"))


def f1_multilabel(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """true(node, labels), predicted(node, predicted), both 0/1 arrays; all columns count."""
    z = _zipped(true, "labels", predicted, "predicted").select("c", F.col("x").alias("t"), F.col("y").alias("p"))
    return _f1(z.groupBy("c").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn")))


def f1_multiclass(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """true(node, label), predicted(node, predicted); classes present in either count."""
    z = _paired(true, predicted)
    own = F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t"), (F.col("label") == F.col("predicted")).cast("int").alias("p")), F.struct(F.col("predicted").alias("c"), (F.col("label") == F.col("predicted")).cast("int").alias("t"), F.lit(1).alias("p")))
    each = z.select(F.explode(F.array_distinct(own)).alias("v")).select("v.c", "v.t", "v.p")
    return _f1(each.groupBy("c").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn")))


def weighted_mean_f1(per_batch: DataFrame) -> DataFrame:
    """One row: F1 of batches weighted by their rows."""
    return per_batch.agg((F.sum(F.col("f1") * F.col("n")) / F.sum("n")).alias("f1"))


