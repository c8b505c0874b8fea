"""The end-to-end jobs: placement, mini-batches with locality, full-graph scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialise
from ..operators import graph, placement, propagate, sampling, scoring, stats


def placement_job(edges: DataFrame, train: DataFrame, nodes: DataFrame, devices: int, ratio: float, alpha: float, k: int, balance: str = "snake") -> tuple[DataFrame, DataFrame]:
    """(buffer, location): normalise, score, rank, place."""
    norm = materialise(graph.row_normalize(edges), "normalised")
    scores = propagate.access_score(norm, train, k)
    return placement.place_hot_replicated(scores, devices, placement.buffer_rows(nodes, ratio), alpha, balance)


def batch_closures(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, rank, node): the rows that a batch would read with all one-hop neighbours."""
    seeds = batches.select(F.col("batch_id").alias("group"), "node")
    reach = propagate.k_hop_by_group(edges, seeds, 1).select(F.col("group").alias("batch_id"), "node")
    return reach.join(batches.select("batch_id", "rank").distinct(), "batch_id")


def favoured_nodes(edges: DataFrame, nodes: DataFrame, buffer: DataFrame, layers: int, top: int = 8192) -> list[DataFrame]:
    """For each layer, 0 the input side, (rank, node): what each worker holds, and what is often met from there."""
    held = buffer.select(F.col("device").alias("rank"), "node")
    every = materialise(propagate.skewed_node_sets_by_rank(edges, nodes, held, layers, top), "favoured")
    return [every.where(F.col("level") == layer).select("rank", "node") for layer in range(layers)]


def locality_job(edges: DataFrame, train: DataFrame, location: DataFrame, devices: int, batch: int, ks: list[int], orders: list[int], seed: int, dims: int, favoured: list[DataFrame] | None = None, factor: float = 1.0) -> DataFrame:
    """Movement report of one epoch of layer-wise samples, biased to favoured nodes if given."""
    batches = materialise(sampling.make_train_batches(train, devices, batch, seed), "batches")
    _, layers = sampling.layerwise_sample(edges, batches, ks, orders, seed, favoured, factor)
    inputs = sampling.batch_inputs(layers).join(batches.select("batch_id", "rank").distinct(), "batch_id")
    return placement.movement_report(placement.resolve_location(inputs, location), dims)


def scoring_job(edges: DataFrame, features: DataFrame, roles: DataFrame, labels: DataFrame, hidden: int, orders: list[int], classes: int) -> DataFrame:
    """Scale, encode over all neighbours, score and compare: one row of F1."""
    scaled = stats.standard_scale(features, roles).withColumnRenamed("features", "x")
    dims = features.select(F.size("features")).first()[0]
    layers, head = scoring.encoder_params([dims, hidden], orders, classes)
    scores = scoring.graphsage_infer(materialise(graph.row_normalize(edges), "normalised"), materialise(scaled, "scaled"), layers, orders, head)
    return scoring.f1_multiclass(labels.where("label is not null"), scoring.argmax_class(scores))
