"""Edge tables ``(src, dst, weight)``: construction, selection, degrees and normalisation.

Ids are any bigint; ``nodes`` tables (node) say which nodes exist where isolated ones matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["src", "dst", "weight"]


def coalesce_edges(e: DataFrame) -> DataFrame:
    """One row per (src, dst), weights summed."""
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def transpose(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def add_reverse_edges(e: DataFrame) -> DataFrame:
    """Each listed edge once each way with weight 1, then summed: a mutual pair or a self loop gets 2."""
    one = e.select("src", "dst", F.lit(1.0).alias("weight"))
    return coalesce_edges(one.union(transpose(one)))


def symmetrize_max(e: DataFrame) -> DataFrame:
    """Duplicates summed, then the larger of each edge and its reverse (weights not negative).

    Both directions of a pair are summed in one row of one aggregation, so edges are read, shuffled and held once."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    up = F.col("src") <= F.col("dst")
    sums = e.groupBy(*pair).agg(F.sum(F.when(up, F.col("weight"))).alias("up"), F.sum(F.when(~up, F.col("weight"))).alias("down"))
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = sums.select(F.explode(F.array_distinct(ends)).alias("e"), F.greatest("up", "down").alias("weight"))
    return both.select("e.src", "e.dst", "weight")


def add_self_loops(e: DataFrame, n: DataFrame) -> DataFrame:
    """One more on every node's diagonal, isolated nodes included."""
    loops = n.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
    return coalesce_edges(e.select(*EDGE).union(loops))


def select_rows(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges out of listed nodes; a node listed twice gives its rows twice."""
    return e.join(nodes.select(F.col("node").alias("src")), "src").select(*EDGE)


def select_cols(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges into a set of nodes."""
    return e.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*EDGE)


def induced_subgraph(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the set."""
    return select_cols(e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi"), nodes)


def local_index(df: DataFrame, group: list[str], node: str = "node") -> DataFrame:
    """Distinct nodes of each group with their 0-based position in ascending order."""
    order = Window.partitionBy(*group).orderBy(node)
    return df.select(*group, node).distinct().withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def union_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").union(b.select("node")).distinct()


def intersect_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """(device, n): nodes of each device's set a(device, node) that are in the set b(node)."""
    return a.select("device", "node").distinct().join(b.select("node").distinct(), "node").groupBy("device").agg(F.count("*").alias("n"))


def membership_flag(every: DataFrame, subset: DataFrame, name: str = "is_member") -> DataFrame:
    """every with a flag: is its node in the subset?"""
    known = subset.select("node").distinct().withColumn(name, F.lit(True))
    return every.join(known, "node", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def to_adjacency(e: DataFrame, longest: int = 1 << 16) -> DataFrame:
    """(src, piece, nbrs): neighbours with weights, by dst, in pieces of at most ``longest``, numbered from 0.

    A hub's row is never one value nor sorted in one task: entries are ranked over all rows in range partitions, which
    cut between a row's entries too, and an entry's place in its row says which piece it belongs to."""
    from .ranking import rank_globally

    ranked = rank_globally(e.select(*EDGE), ["src", "dst", "weight"], "_rank")
    first = ranked.groupBy("src").agg(F.min("_rank").alias("_first"))
    piece = F.floor((F.col("_rank") - F.col("_first")) / longest).cast("int").alias("piece")
    return ranked.join(first, "src").groupBy("src", piece).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("nbrs"))


def from_adjacency(a: DataFrame) -> DataFrame:
    """Edges of adjacency rows, in pieces or whole."""
    return a.select("src", F.explode("nbrs").alias("x")).select("src", "x.dst", "x.weight")


def row_pointers(e: DataFrame, n: DataFrame) -> DataFrame:
    """(row, start, end): where each node's entries stand when entries are ordered by row."""
    from .ranking import rank_globally

    counts = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    rows = n.select("node").join(counts, "node", "left").select("node", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    ranked = rank_globally(rows, ["node"], running="k")
    return ranked.select(F.col("node").alias("row"), F.col("before").alias("start"), (F.col("before") + F.col("k")).alias("end"))


def from_row_pointers(ptr: DataFrame, entries: DataFrame) -> DataFrame:
    """entries(pos, ...) with their row: each row's interval becomes its positions, then an equi-join."""
    spread = ptr.where("end > start").select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return entries.join(spread, "pos")


def sort_edges_by_row(e: DataFrame) -> DataFrame:
    """Entries ordered by (src, dst) over and within partitions."""
    return e.repartitionByRange("src").sortWithinPartitions("src", "dst")


def degrees(e: DataFrame, n: DataFrame) -> DataFrame:
    """(node, out_weight, out_count, in_weight, in_count), 0 where there are none."""
    out = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("out_weight"), F.count("*").alias("out_count"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("in_weight"), F.count("*").alias("in_count"))
    zero = {"out_weight": 0.0, "out_count": 0, "in_weight": 0.0, "in_count": 0}
    return n.select("node").join(out, "node", "left").join(into, "node", "left").fillna(zero)


def endpoint_degree(e: DataFrame) -> DataFrame:
    """Each listed edge adds 1 to both of its ends."""
    return e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def row_normalize(e: DataFrame) -> DataFrame:
    """Weight over its row's sum; 0 in rows whose sum is 0. Aggregates first, so hub rows combine."""
    total = e.groupBy("src").agg(F.sum("weight").alias("total"))
    part = F.when(F.col("total") == 0, 0.0).otherwise(F.col("weight") / F.col("total"))
    return e.join(total, "src").select("src", "dst", part.alias("weight"))


def sym_normalize(e: DataFrame) -> DataFrame:
    """Weight over the roots of its row's and its column's sum; 0 where a sum is 0, NaN below 0."""
    rows = e.groupBy("src").agg(F.sum("weight").alias("r"))
    cols = e.groupBy("dst").agg(F.sum("weight").alias("c"))

    def inverse(s: str):
        return F.when(F.col(s) == 0, 0.0).otherwise(F.pow(F.col(s), F.lit(-0.5)))

    return e.join(rows, "src").join(cols, "dst").select("src", "dst", (inverse("r") * F.col("weight") * inverse("c")).alias("weight"))


def laplacian(e: DataFrame, n: DataFrame) -> DataFrame:
    """Rows of A + I, normalised."""
    return row_normalize(add_self_loops(e, n))
