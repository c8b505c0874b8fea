"""Global ranks and tops without a window over everything in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import materialise


def rank_globally(df: DataFrame, order: list[str | Column], name: str = "rank", running: str | None = None) -> DataFrame:
    """Adds each row's 0-based rank; with ``running`` also ``before``, that column's sum over earlier rows.

    Range partitions are sorted and numbered in place and written once, so that both passes see one
    split; only one row per partition goes through the prefix sum and is broadcast."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND((1 << 33) - 1))
    total = F.sum(running).alias("_s") if running else F.lit(0).alias("_s")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), total)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sum"))
    out = placed.join(F.broadcast(first), "_part").withColumn(name, (F.col("_first") + F.col("_pos")).cast("long"))
    if running:
        inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", (F.col("_sum") + F.coalesce(F.sum(running).over(inside), F.lit(0))).cast("long"))
    return out.drop("_at", "_part", "_pos", "_first", "_sum")


def top_k(df: DataFrame, k: int, score: str = "score", node: str = "node") -> DataFrame:
    """The k largest scores, ties by node. For large k rank globally and filter."""
    return df.orderBy(F.desc(score), node).limit(k)


def top_k_per_group(df: DataFrame, group: str, k: int, score: str = "score", node: str = "node") -> DataFrame:
    """The k largest scores of each group, with their 0-based slot."""
    order = Window.partitionBy(group).orderBy(F.desc(score), node)
    return df.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < k)


def top_of_groups(df: DataFrame, group: str, order: list[str | Column], k: int, name: str = "slot") -> DataFrame:
    """The first k rows of each group in this order, with their 0-based place. For any k and any size of group: rows are
    ranked over all groups in range partitions, so that no group meets in one task."""
    ranked = rank_globally(df, [group, *order], "_rank")
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_first"))
    kept = ranked.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, (F.col("_rank") - F.col("_first")).cast("int"))
    return kept.where(F.col(name) < k).drop("_rank", "_group", "_first")
