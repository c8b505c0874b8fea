"""Which worker keeps which node's features, and where each read is served from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bitsets
from ..functions.tables import materialise
from .propagate import k_hop_bits, k_hop_by_group
from .ranking import rank_globally

HOST = -1


def buffer_rows(n: DataFrame, ratio: float) -> int:
    """Rows that each worker caches: the whole part of ratio * nodes."""
    return int(ratio * n.count())


def _slices(ranked: DataFrame, devices: int, rows: int) -> DataFrame:
    kept = ranked.where(F.col("rank") < devices * rows)
    return kept.select(F.floor(F.col("rank") / rows).cast("int").alias("device"), (F.col("rank") % rows).cast("int").alias("slot"), "node")


def place_contiguous(n: DataFrame, devices: int, rows: int) -> DataFrame:
    """(device, slot, node): consecutive ids, one slice per worker."""
    if rows <= 0:
        return n.select(F.lit(0).alias("device"), F.lit(0).alias("slot"), "node").limit(0)
    return _slices(rank_globally(n.select("node"), ["node"]), devices, rows)


def hash_order(seed: str, *parts: str):
    """A permutation key that SQL engines can repeat: the md5 of seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def place_random(n: DataFrame, devices: int, rows: int, seed: int = 0) -> DataFrame:
    """Slices of a permutation of the ids."""
    if rows <= 0:
        return place_contiguous(n, devices, rows)
    keyed = n.select("node", hash_order(seed, "node").alias("k"))
    return _slices(rank_globally(keyed, ["k", "node"]), devices, rows)


def rank_by_score(scores: DataFrame, most: int) -> DataFrame:
    """(node, score, rank): the ``most`` best, scores rounded to 12 places before ties go by node."""
    s = scores.select("node", F.round("score", 12).alias("score"))
    return rank_globally(s, [F.desc("score"), F.col("node")]).where(F.col("rank") < most)


def _fold(devices: int):
    """Rounds of devices - 1 candidates, in rank order; each round goes to the workers by their load so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, order = np.zeros(devices), np.arange(devices)
        for batch in batches:
            taker, keeper = [], []
            for i, score in zip(batch["i"].to_pylist(), batch["score"].to_pylist()):
                at = i % (devices - 1)
                if at == 0:
                    order = np.argsort(load, kind="stable")
                taker.append(int(order[at]))
                keeper.append(int(order[-1]))
                load[order[at]] += score
            cols = [*batch.columns, pa.array(taker, pa.int32()), pa.array(keeper, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "taker", "keeper"])

    return run


def hot_swaps(scores: DataFrame, devices: int, rows: int, alpha: float, balance: str = "snake") -> tuple[DataFrame, DataFrame]:
    """(ranked, swaps): swaps(i, node, score, slot, evicted, taker, keeper).

    Candidates are the ranks after the first ``rows``; round i // (devices - 1) evicts slot
    rows - 1 - round. As candidates' scores fall and evicted ones rise, "stop at the first failure" is
    a plain filter. Only the balance of load needs order: 'snake' is column arithmetic and keeps loads
    within one candidate's score per round; 'exact' gives each round to the workers by their load so far,
    which folds the swaps in rank order in one task with one float per worker, on at most
    rows * (devices - 1) narrow rows."""
    ranked = materialise(rank_by_score(scores, devices * rows), "ranked")
    if devices < 2 or rows < 1:
        none = ranked.select(F.col("rank").alias("i"), "node", "score", F.lit(0).alias("slot"), F.col("node").alias("evicted"), F.lit(0).alias("taker"), F.lit(0).alias("keeper"))
        return ranked, none.limit(0)
    cand = ranked.where(F.col("rank") >= rows).withColumn("i", F.col("rank") - rows)
    cand = cand.withColumn("slot", (F.lit(rows - 1) - F.floor(F.col("i") / (devices - 1))).cast("int"))
    partner = ranked.select(F.col("rank").cast("int").alias("slot"), F.col("node").alias("evicted"), F.col("score").alias("held"))
    swaps = cand.join(partner, "slot").where(F.col("score") >= F.lit(float(alpha)) * F.col("held")).select("i", "node", "score", "slot", "evicted")
    if balance == "snake":
        turn, at = F.floor(F.col("i") / (devices - 1)), F.col("i") % (devices - 1)
        swaps = swaps.withColumn("taker", F.when(turn % 2 == 0, at).otherwise(devices - 1 - at).cast("int"))
        return ranked, swaps.withColumn("keeper", F.when(turn % 2 == 0, devices - 1).otherwise(0).cast("int"))
    ordered = swaps.repartition(1).sortWithinPartitions("i")
    schema = "i long, node long, score double, slot int, evicted long, taker int, keeper int"
    return ranked, ordered.mapInArrow(_fold(devices), schema)


def place_hot_replicated(scores: DataFrame, devices: int, rows: int, alpha: float = 0.0, balance: str = "snake") -> tuple[DataFrame, DataFrame]:
    """(buffer, location): the hottest nodes on every worker, warm ones on one, by ``hot_swaps``.

    location(viewer, node, holder, slot) has cached nodes only; a missing row means the host."""
    ranked, swaps = hot_swaps(scores, devices, rows, alpha, balance)
    swaps = materialise(swaps, "swaps")
    spark = scores.sparkSession
    workers = F.broadcast(spark.range(devices).select(F.col("id").cast("int").alias("device")))
    first = ranked.where(F.col("rank") < rows).select(F.col("rank").cast("int").alias("slot"), F.col("node").alias("hot"))
    start = first.join(workers)
    taken = swaps.select(F.col("taker").alias("device"), "slot", F.col("node").alias("new"), "keeper")
    after = materialise(start.join(taken, ["device", "slot"], "left"), "buffers")
    buffer = after.select("device", "slot", F.coalesce("new", "hot").alias("node"))
    hot = after.select(F.col("device").alias("viewer"), F.col("hot").alias("node"), F.coalesce("keeper", "device").alias("holder"), "slot")
    swapped = swaps.join(workers).select(F.col("device").alias("viewer"), "node", F.col("taker").alias("holder"), "slot")
    return buffer, hot.unionByName(swapped)


def partition_blocks(train: DataFrame, nblocks: int = 20) -> DataFrame:
    """(pos, node, block): consecutive blocks of train(pos, node); the short last one stays a block."""
    total = train.count()
    size = max(1, total // nblocks)
    return train.select("pos", "node", F.floor(F.col("pos") / size).cast("int").alias("block"))


def _greedy(masks: DataFrame, blocks: int, devices: int, total: int) -> list[int]:
    """Worker of each block, from masks(sets, n), counts of nodes by the set of blocks that reach them.
    A pass over that table gives a block's overlaps and the workers' sizes in one row."""

    def count(cond) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    def meets(numbers: int) -> Column:
        return bitsets.meets(F.col("sets"), numbers)

    reached = masks.agg(*[count(meets(1 << b)) for b in range(blocks)]).first()
    owned, load, owner = [0] * devices, np.ones(devices), []
    for b in range(blocks):
        if b < devices:
            best = b
        else:
            row = masks.agg(*[count(meets(o)) for o in owned], *[count(meets(o) & meets(1 << b)) for o in owned]).first()
            size, overlap = np.array(row[:devices], np.int64), np.array(row[devices:], np.int64)
            best = int(np.argmax(np.abs(overlap * (total - size) / load)))
        owned[best] |= 1 << b
        load[best] += reached[b]
        owner.append(best)
    return owner


def assign_blocks_greedy(e: DataFrame, blocks: DataFrame, devices: int, total: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(assignment(block, device), reach(node, sets)): blocks in order go to the worker with most
    overlap * free space / load. Any number of blocks; sets are bit sets of blocks.

    One closure over bit sets finds which blocks reach each node, and the counts by set stay a table: the driver sees one
    row of numbers per block. Where weights are below 0 a neighbour counts by its group's sum, so the closure runs in
    rows by block and node, and becomes bits after it."""
    nblocks = blocks.agg(F.max("block")).first()[0] + 1
    words = bitsets.words_for(nblocks)
    e, seeds = materialise(e.select("src", "dst", "weight"), "edges"), blocks.select(F.col("block").alias("group"), "node")
    if e.where("weight < 0").isEmpty():
        rows = k_hop_bits(e, seeds, nblocks, k).select("node", F.col("sets").alias("s"))
    else:
        rows = k_hop_by_group(e, seeds, k).select("node", bitsets.single(F.col("group"), words).alias("s"))
    reach = materialise(rows.groupBy("node").agg(bitsets.union_all(F.col("s"), words).alias("sets")), "reach")
    masks = materialise(reach.groupBy("sets").agg(F.count("*").alias("n")), "masks")
    owner = _greedy(masks, nblocks, devices, total)
    return e.sparkSession.createDataFrame(list(enumerate(owner)), "block int, device int"), reach


def nodes_of_devices(reach: DataFrame, owner: DataFrame, devices: int) -> DataFrame:
    """(device, node): the nodes that any block of each worker reaches, from reach(node, sets) and owner(block, device)."""
    own = [0] * devices
    for r in owner.collect():  # a row a block
        own[r.device] |= 1 << r.block
    held = F.filter(F.array(*[F.when(bitsets.meets(F.col("sets"), o), F.lit(d)) for d, o in enumerate(own)]), lambda d: d.isNotNull())
    return reach.select(F.explode(held).alias("device"), "node")


def top_rows_per_device(device_nodes: DataFrame, scores: DataFrame, rows: int) -> DataFrame:
    """(device, slot, node): each worker's best-scored nodes of its own set, ties by id."""
    have = device_nodes.select("device", "node").distinct().join(scores, "node", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 12))
    # ranked over all workers in range partitions, so that no worker's candidates meet in one task
    ranked = rank_globally(have.select("device", "node", "score"), ["device", F.desc("score"), "node"])
    first = ranked.groupBy("device").agg(F.min("rank").alias("first"))  # a row per worker
    kept = ranked.join(F.broadcast(first), "device").withColumn("slot", (F.col("rank") - F.col("first")).cast("int"))
    return kept.where(F.col("slot") < rows).select("device", "slot", "node")


def place_greedy_blocks(e: DataFrame, train: DataFrame, scores: DataFrame, devices: int, rows: int, total: int, k: int, nblocks: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(buffer, location, train_assign(node, pos, block, device)); a worker sees its own buffer only."""
    blocks = materialise(partition_blocks(train, nblocks), "blocks")
    owner, reach = assign_blocks_greedy(e, blocks, devices, total, k)
    buffer = materialise(top_rows_per_device(nodes_of_devices(reach, owner, devices), scores, rows), "buffers")
    return buffer, location_table(buffer, devices, shared=False), blocks.join(owner, "block")


def location_table(buffer: DataFrame, devices: int, shared: bool = True) -> DataFrame:
    """(viewer, node, holder, slot): shared buffers are seen by all workers, others by their own."""
    if not shared:
        return buffer.select(F.col("device").alias("viewer"), "node", F.col("device").alias("holder"), "slot")
    viewers = F.broadcast(buffer.sparkSession.range(devices).select(F.col("id").cast("int").alias("viewer")))
    return buffer.join(viewers).select("viewer", "node", F.col("device").alias("holder"), "slot")


def choose_placement(strategy: str, devices: int, rows: int, nodes: DataFrame, scores: DataFrame | None = None, alpha: float = 0.0, seed: int = 0, balance: str = "snake", **greedy) -> tuple[DataFrame, DataFrame]:
    """(buffer, location) by strategy: contiguous, random, hot (by balance) or greedy_blocks."""
    if strategy == "hot":
        return place_hot_replicated(scores, devices, rows, alpha, balance)
    if strategy == "greedy_blocks":
        return place_greedy_blocks(scores=scores, devices=devices, rows=rows, **greedy)[:2]
    place = {"contiguous": lambda: place_contiguous(nodes, devices, rows), "random": lambda: place_random(nodes, devices, rows, seed)}
    if strategy not in place:
        raise ValueError(f"unknown strategy {strategy}")
    buffer = materialise(place[strategy](), "buffers")
    return buffer, location_table(buffer, devices)


def train_order_for_greedy(train_assign: DataFrame) -> DataFrame:
    """(node, pos): the workers' blocks end to end."""
    ranked = rank_globally(train_assign.select("device", "block", "pos", "node"), ["device", "block", "pos"], "new_pos")
    return ranked.select("node", F.col("new_pos").alias("pos"))


def resolve_location(inputs: DataFrame, location: DataFrame) -> DataFrame:
    """inputs(batch_id, rank, node) with holder (HOST where not cached) and slot, as seen by its rank."""
    seen = location.select(F.col("viewer").alias("rank"), "node", "holder", "slot")
    return inputs.join(seen, ["rank", "node"], "left").withColumn("holder", F.coalesce("holder", F.lit(HOST)))


def movement_report(resolved: DataFrame, dims: int) -> DataFrame:
    """Per batch and rank: rows read locally, from other workers and from the host, and bytes."""

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    local, host = F.col("holder") == F.col("rank"), F.col("holder") == HOST
    out = resolved.groupBy("batch_id", "rank").agg(n(local).alias("local"), n(~local & ~host).alias("remote"), n(host).alias("host"), F.count("*").alias("total"))
    return out.withColumn("hit_ratio", F.round(F.col("local") / F.col("total"), 6)).withColumn("bytes", F.col("total") * dims * 4)


def holder_totals(resolved: DataFrame) -> DataFrame:
    """Rows per (rank, holder), per rank and in all; totals have null keys."""
    return resolved.rollup("rank", "holder").agg(F.count("*").alias("n"))


def gather_by_location(resolved: DataFrame, buffers: DataFrame, features: DataFrame) -> DataFrame:
    """resolved with features: cached rows by (holder, slot) from buffers(device, slot, features), others by node."""
    held = resolved.where(F.col("holder") != HOST).join(buffers.select(F.col("device").alias("holder"), "slot", "features"), ["holder", "slot"])
    rest = resolved.where(F.col("holder") == HOST).join(features.select("node", "features"), "node")
    return held.unionByName(rest)


def load_per_device(swaps: DataFrame) -> DataFrame:
    """Sum of the scores of swapped-in nodes per worker."""
    return swaps.groupBy(F.col("taker").alias("device")).agg(F.sum("score").alias("load"), F.count("*").alias("n"))


