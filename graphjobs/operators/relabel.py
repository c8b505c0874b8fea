"""New ids by descending degree, applied to every table of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import degrees
from .ranking import rank_globally


def relabel_by_degree(n: DataFrame, degree_edges: DataFrame) -> DataFrame:
    """(node, new_id): rank by whole-number row weight, largest first, ties by old id."""
    key = degrees(degree_edges, n).select("node", F.col("out_weight").cast("long").alias("k"))
    return rank_globally(key, [F.desc("k"), F.col("node")], "new_id").select("node", "new_id")


def apply_relabel_edges(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends rewritten; a weight stays with its edge."""
    a = mapping.select(F.col("node").alias("src"), F.col("new_id").alias("a"))
    b = mapping.select(F.col("node").alias("dst"), F.col("new_id").alias("b"))
    return e.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def apply_relabel_rows(df: DataFrame, mapping: DataFrame, node: str = "node") -> DataFrame:
    """Features, labels or roles under the new ids."""
    m = mapping.select(F.col("node").alias(node), "new_id")
    return df.join(m, node).drop(node).withColumnRenamed("new_id", node).select(*df.columns)


def split_by_position(ranked: DataFrame, n_train: int, n_valid: int, rank: str = "rank") -> DataFrame:
    """The first n_train ranks are train, the next n_valid valid, the rest test."""
    role = F.when(F.col(rank) < n_train, "tr").when(F.col(rank) < n_train + n_valid, "va").otherwise("te")
    return ranked.select("node", role.alias("role"))
