"""Layer-wise importance sampling for a whole epoch: batch_id is a column, one join per layer.

Uniform numbers are hashes of (seed, batch, layer, node), so a repeated task draws alike and SQL can
repeat the draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import is_written, materialise, scratch
from .graph import induced_subgraph
from .placement import hash_order
from .ranking import rank_globally


#: Slices of a draw's key for each doubling of it.
SLICES = 32


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0)


def _met(e: DataFrame, frontier: DataFrame) -> DataFrame:
    """(batch_id, node): a row for each entry of each frontier row."""
    step = frontier.select("batch_id", F.col("node").alias("src")).join(e.where("weight <> 0"), "src")
    return step.select("batch_id", F.col("dst").alias("node"))


def layer_importance(e: DataFrame, frontier: DataFrame) -> DataFrame:
    """(batch_id, node, imp): in how many frontier rows of the batch each column has an entry."""
    return _met(e, frontier).groupBy("batch_id", "node").agg(F.count("*").cast("double").alias("imp"))


def bias_local(imp: DataFrame, favoured: DataFrame, factor: float, ranks: DataFrame | None = None) -> DataFrame:
    """Importance times factor for favoured nodes, if factor is above 1. favoured(node) holds for all batches;
    favoured(rank, node) for those of a worker, by ranks(batch_id, rank)."""
    if factor <= 1:
        return imp
    keys = ["rank", "node"] if "rank" in favoured.columns else ["node"]
    flag = favoured.select(*keys).distinct().withColumn("_fav", F.lit(True))
    known = imp.join(ranks.select("batch_id", "rank"), "batch_id", "left") if "rank" in keys else imp
    biased = known.join(flag, keys, "left").withColumn("imp", F.col("imp") * F.when(F.col("_fav"), factor).otherwise(1.0))
    return biased.select(*imp.columns)


def to_probability(imp: DataFrame) -> DataFrame:
    """Importance over its batch's sum; the sum is aggregated first and joined back."""
    total = imp.groupBy("batch_id").agg(F.sum("imp").alias("_t"))
    return imp.join(total, "batch_id").withColumn("p", F.when(F.col("_t") > 0, F.col("imp") / F.col("_t")).otherwise(0.0)).drop("_t")


def draw_keys(df: DataFrame, seed: int, layer: int = 0) -> DataFrame:
    """df(batch_id, node, p, ...) with the draw's _key, -ln(u) / p, and the key's _slice; null where p isn't above 0."""
    u = uniform(F.lit(seed), F.col("batch_id"), F.lit(layer), F.col("node"))
    keyed = df.withColumn("_key", F.when(F.col("p") > 0, F.round(-F.log(u) / F.col("p"), 9)))
    return keyed.withColumn("_slice", F.when(F.col("_key").isNotNull(), F.floor(F.log2(F.greatest("_key", F.lit(1e-9))) * SLICES).cast("int")))


def _taken(keyed: DataFrame, k: int, always: Column) -> DataFrame:
    """The rows of draw_keys, written before, that are among their batch's k smallest keys or for which ``always`` holds."""
    counts = keyed.where("_slice is not null").groupBy("batch_id", "_slice").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("batch_id").orderBy("_slice"))
    cuts = counts.withColumn("_upto", upto).where(F.col("_upto") > k).groupBy("batch_id")
    cuts = materialise(cuts.agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("_n")).alias("before"))).alias("_cut")), "cuts")
    placed = keyed.join(cuts, "batch_id", "left")
    at_cut = F.coalesce(F.col("_slice") == F.col("_cut._slice"), F.lit(False))
    early = F.col("_slice").isNotNull() & (F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut._slice")))
    order = Window.partitionBy("batch_id").orderBy("_key", "node")
    edge = placed.where(at_cut).withColumn("_r", F.row_number().over(order) + F.col("_cut.before")).where((F.col("_r") <= k) | always)
    return placed.where(early | (always & ~at_cut)).unionByName(edge.drop("_r")).drop("_key", "_slice", "_cut")


def weighted_sample_without_replacement(df: DataFrame, k: int, seed: int, layer: int = 0) -> DataFrame:
    """min(k, nodes with p > 0) nodes per batch, drawn by p: the k smallest of -ln(u) / p
    (Efraimidis and Spirakis 2006), the same distribution as successive draws. The keys are made once and written.

    The k smallest are found without sorting a batch: tasks count candidates by (batch, slice of the key), 2,000 slices a
    batch at most, whose counts combine before the shuffle. The running count finds the slice of each batch's cut; candidates
    before it are taken where they are read, and only those in the cut's slice, some hundredths of k, are ranked."""
    return _taken(materialise(draw_keys(df.where("p > 0"), seed, layer), "keys"), k, F.lit(False))


def _factor(size: Column, floor: float) -> Column:
    return 1 / F.least(F.greatest(size * F.col("p"), F.lit(floor)), F.lit(1.0))


def _drawable(what: str, k: int) -> Column:
    """Aggregate: min(nodes above 0, k)."""
    return F.least(F.sum((F.col(what) > 0).cast("long")), F.lit(k))


def _factors(p: DataFrame, k: int, floor: float) -> DataFrame:
    """(batch_id, node, factor): 1 / clip(s * p, floor, 1) with s = min(nodes with p > 0, k)."""
    s = p.groupBy("batch_id").agg(_drawable("p", k).alias("s"))
    return p.join(s, "batch_id").select("batch_id", "node", "p", _factor(F.col("s"), floor).alias("factor"))


def sampled_layer(
    e: DataFrame, frontier: DataFrame, k: int, seed: int, layer: int, favoured: DataFrame | None = None, factor: float = 1.0, prob_floor: float = 1e-10,
    ranks: DataFrame | None = None, entries: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(block, nodes): the layer's edges with values, and its node set.

    block(batch_id, src, dst, src_pos, dst_pos, value): frontier rows by kept columns, value = 1 over
    the stored entries of the whole row, times the column's factor. nodes(batch_id, node, pos, is_prev,
    prob): the drawn nodes and the frontier."""
    prev, nodes = _drawn_nodes(e, frontier, k, seed, layer, favoured, factor, prob_floor, ranks)
    return _block(e, prev, nodes, row_entries(e) if entries is None else entries), nodes.drop("factor")


def _drawn_nodes(e: DataFrame, frontier: DataFrame, k: int, seed: int, layer: int, favoured: DataFrame | None, factor: float, floor: float, ranks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(the distinct frontier, the layer's nodes with pos, is_prev, prob and factor).

    The frontier's own rows go through the aggregation of importances, with none of their own, so that a row says both
    whether it was in the frontier and how likely it is, and the layer is a filter of these rows."""
    step = _met(e, frontier).select("batch_id", "node", F.lit(1.0).alias("imp"), F.lit(False).alias("is_prev"))
    own = frontier.select("batch_id", "node", F.lit(0.0).alias("imp"), F.lit(True).alias("is_prev"))
    imp = step.unionByName(own).groupBy("batch_id", "node").agg(F.sum("imp").alias("imp"), F.max("is_prev").alias("is_prev"))
    if favoured is not None:
        imp = bias_local(imp, favoured, factor, ranks)
    imp = materialise(imp, "importances")
    totals = imp.groupBy("batch_id").agg(F.sum("imp").alias("_t"), _drawable("imp", k).alias("_s"))
    p = imp.join(totals, "batch_id").withColumn("p", F.when(F.col("_t") > 0, F.col("imp") / F.col("_t")).otherwise(0.0))
    p = p.select("batch_id", "node", "is_prev", "p", _factor(F.col("_s"), floor).alias("factor"))
    drawn = _taken(materialise(draw_keys(p, seed, layer), "probabilities"), k, F.col("is_prev"))
    order = Window.partitionBy("batch_id").orderBy("node")  # of at most k and the frontier's rows
    nodes = drawn.select("batch_id", "node", (F.row_number().over(order) - 1).cast("long").alias("pos"), "is_prev", F.col("p").alias("prob"), "factor")
    nodes = materialise(nodes, "layer")
    return nodes.where("is_prev").select("batch_id", "node"), nodes


def row_entries(e: DataFrame) -> DataFrame:
    """(src, _n): the stored entries of each row."""
    return e.groupBy("src").agg(F.count("*").alias("_n"))


def _ranks(batches: DataFrame) -> DataFrame | None:
    return batches.select("batch_id", "rank").distinct() if "rank" in batches.columns else None


def _block(e: DataFrame, rows: DataFrame, nodes: DataFrame, full: DataFrame) -> DataFrame:
    order = Window.partitionBy("batch_id").orderBy("src")
    src = rows.select("batch_id", F.col("node").alias("src")).withColumn("src_pos", (F.row_number().over(order) - 1).cast("long"))
    dst = nodes.select("batch_id", F.col("node").alias("dst"), F.col("pos").alias("dst_pos"), "factor")
    edges = src.join(e.select("src", "dst"), "src").join(dst, ["batch_id", "dst"]).join(full, "src")
    return edges.select("batch_id", "src", "dst", "src_pos", "dst_pos", (F.col("factor") / F.col("_n")).alias("value"))


def layerwise_sample(
    e: DataFrame, batches: DataFrame, ks: list[int], orders: list[int], seed: int, favoured: list[DataFrame] | None = None, factor: float = 1.0, entries: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(blocks, layer_nodes) with a layer column, 0 the input side; layers of order 0 have no block. favoured has a
    (node) or (rank, node) table for each layer; entries are the ``row_entries`` of e, counted once for all layers."""
    ranks, entries = _ranks(batches), materialise(row_entries(e), "entries") if entries is None else entries
    frontier, blocks, sets = batches.select("batch_id", "node"), None, None
    for d, order in enumerate(reversed(orders)):
        if order == 0:
            continue
        layer = len(orders) - 1 - d
        fav = favoured[layer] if favoured else None
        block, nodes = sampled_layer(e, frontier, ks[d], seed, layer, fav, factor, ranks=ranks, entries=entries)
        block, nodes = block.withColumn("layer", F.lit(layer)), nodes.withColumn("layer", F.lit(layer))
        blocks = block if blocks is None else blocks.unionByName(block)
        sets = nodes if sets is None else sets.unionByName(nodes)
        frontier = nodes.select("batch_id", "node")
    return blocks, sets


def subgraph_sample(e: DataFrame, batches: DataFrame, k: int, orders: list[int], seed: int, favoured: DataFrame | None = None, factor: float = 1.0, prob_floor: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """One draw at the first layer of order > 0 from the output side; every layer below it is the
    sub-graph induced on that set, with the same factors. Frontier nodes that the draw couldn't reach
    have the floor's factor there, which is large."""
    first = next(d for d, o in enumerate(reversed(orders)) if o)
    top = len(orders) - 1 - first
    prev, nodes = _drawn_nodes(e, batches, k, seed, top, favoured, factor, prob_floor, _ranks(batches))
    entries = materialise(row_entries(e), "entries")
    blocks = _block(e, prev, nodes, entries).withColumn("layer", F.lit(top))
    sets = nodes.drop("factor").withColumn("layer", F.lit(top))
    if top:
        inside = materialise(induced_subgraph(e, nodes.select("node").distinct()), "induced")
        low = _block(inside, nodes, nodes, entries)
    for layer in range(top):
        blocks = blocks.unionByName(low.withColumn("layer", F.lit(layer)))
        sets = sets.unionByName(nodes.drop("factor").withColumn("is_prev", F.lit(True)).withColumn("layer", F.lit(layer)))
    return blocks, sets


def sample_in_waves(e: DataFrame, batches: DataFrame, path: str, waves: int, ks: list[int], orders: list[int], seed: int, favoured: list[DataFrame] | None = None, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``layerwise_sample`` of an epoch by waves of its batches, batch_id modulo ``waves``, under a path of the caller's:
    blocks/wave=n and layer_nodes/wave=n. (blocks, layer_nodes) of all waves, with a wave column.

    The rows between frontiers and importances are many times the sample, so a wave bounds the disk that they take: its
    intermediate tables go as soon as its sample is written. A wave that is written to its end is not made again, so a
    stopped job goes on where it was; as draws are hashes of batch and node, the waves together are the sample that
    one job makes. A path holds one epoch: the same batches, edges and parameters."""
    spark, root = e.sparkSession, path.rstrip("/")
    with scratch(spark):
        entries = materialise(row_entries(e), "entries")
        for wave in range(waves):
            to = [f"{root}/{name}/wave={wave}" for name in ("blocks", "layer_nodes")]
            if all(is_written(spark, p) for p in to):
                continue
            with scratch(spark):
                own = batches.where(F.pmod("batch_id", F.lit(waves)) == wave)
                for made, p in zip(layerwise_sample(e, own, ks, orders, seed, favoured, factor, entries), to):
                    made.write.mode("overwrite").parquet(p)
    return spark.read.parquet(f"{root}/blocks"), spark.read.parquet(f"{root}/layer_nodes")


def make_train_batches(train: DataFrame, world: int, batch: int, seed: int, epoch: int = 0, local_shuffle: bool = False) -> DataFrame:
    """(batch_id, rank, pos, node): every train node once; a chunk of ceil(T / world) per worker.

    Globally shuffled, chunks are slices of one permutation, the same for all workers; locally
    shuffled, chunks are slices of train(pos, node), each permuted in itself."""
    total = train.count()
    chunk = max(1, -(-total // world))
    per_rank = -(-chunk // batch)
    keyed = train.select("pos", "node", hash_order(f"{seed}|{epoch}", "node").alias("k"))
    if local_shuffle:
        chunks = keyed.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("int"))
        ranked = rank_globally(chunks, ["chunk", "k", "node"])
    else:
        ranked = rank_globally(keyed, ["k", "node"])
    rank, at = F.floor(F.col("rank") / chunk), F.col("rank") % chunk
    return ranked.select((rank * per_rank + F.floor(at / batch)).cast("long").alias("batch_id"), rank.cast("int").alias("rank_of_worker"), (at % batch).cast("int").alias("pos"), "node").withColumnRenamed("rank_of_worker", "rank")


def sample_validation(valid: DataFrame, size: int, seed: int) -> DataFrame:
    """One random batch of ``size`` nodes."""
    key = hash_order(seed, "node")
    return valid.select("node", key.alias("k")).orderBy("k", "node").limit(size).select("node")


def make_test_batches(test: DataFrame, batch: int) -> DataFrame:
    """Consecutive slices of test(pos, node); the last may be short, none is empty."""
    return test.select(F.floor(F.col("pos") / batch).cast("long").alias("batch_id"), (F.col("pos") % batch).cast("int").alias("pos"), "node")


def batch_inputs(layer_nodes: DataFrame) -> DataFrame:
    """The deepest sampled layer of each batch: the rows to fetch."""
    deepest = layer_nodes.groupBy("batch_id").agg(F.min("layer").alias("layer"))
    return layer_nodes.join(deepest, ["batch_id", "layer"]).select("batch_id", "node")
