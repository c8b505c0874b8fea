"""Neighbourhoods and propagation along edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bitsets
from ..functions.tables import bucketed, materialise
from .graph import add_self_loops, select_rows
from .ranking import top_k, top_of_groups

#: A node that holds more than one of so many of the edges' rows is heavy; there are fewer such nodes than this.
HEAVY = 1000


def neighbors(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of the nodes' edges whose summed weight isn't 0; listed repeats count again."""
    return select_rows(e, nodes).groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("w")).where("w <> 0").select("node")


def k_hop_by_group(e: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(group, node, hop) reached within k hops of each group's seeds, hop the first one.

    Only nodes that are new in a hop are expanded in the next. Whether a node is known is found by the aggregation that adds
    up its weights, in one pass without a join. Hops that are read again are written; the last one isn't."""
    hops = [materialise(seeds.select("group", "node").distinct().withColumn("hop", F.lit(0)), "hops")]
    none = F.lit(None).cast(e.schema["weight"].dataType).alias("weight")
    for hop in range(1, k + 1):
        front = hops[-1].select("group", F.col("node").alias("src"))
        step = front.join(e, "src").select("group", F.col("dst").alias("node"), "weight", F.lit(False).alias("known"))
        known = reduce(DataFrame.unionByName, hops).select("group", "node", none, F.lit(True).alias("known"))
        met = step.unionByName(known).groupBy("group", "node").agg(F.sum("weight").alias("w"), F.max("known").alias("known"))
        new = met.where("w <> 0 and not known").select("group", "node", F.lit(hop).alias("hop"))
        hops.append(materialise(new, "hops") if hop < k else new)
    return reduce(DataFrame.unionByName, hops)


def k_hop_bits(e: DataFrame, seeds: DataFrame, groups: int, k: int) -> DataFrame:
    """(node, hop, sets): the groups, numbered from 0, that reach a node first in that hop, as a bit set.

    The closure of all groups at once, in rows by node in place of rows by group and node: a hop sends one row of
    ``groups`` bits along each edge, whose unions combine before the shuffle, and only groups that are new at a node go on.
    A neighbour counts by any edge of weight above 0, so weights must not be negative; ``k_hop_by_group`` sums them."""
    words = bitsets.words_for(groups)
    first = seeds.select("node", bitsets.single(F.col("group"), words).alias("s")).groupBy("node").agg(bitsets.union_all(F.col("s"), words).alias("sets"))
    hops = [materialise(first.select("node", F.lit(0).alias("hop"), "sets"), "bits")]
    live = e.where("weight > 0").select("src", "dst")
    for hop in range(1, k + 1):
        front = hops[-1].select(F.col("node").alias("src"), F.col("sets").alias("s"))
        step = front.join(live, "src").groupBy(F.col("dst").alias("node")).agg(bitsets.union_all(F.col("s"), words).alias("found"))
        known = reduce(DataFrame.unionByName, hops).groupBy("node").agg(bitsets.union_all(F.col("sets"), words).alias("old"))
        none = F.array(*[F.lit(0).cast("long")] * words)
        new = step.join(known, "node", "left").select("node", F.lit(hop).alias("hop"), bitsets.minus(F.col("found"), F.coalesce("old", none)).alias("sets"))
        hops.append(materialise(new.where(~bitsets.is_empty(F.col("sets"))), "bits"))
    return reduce(DataFrame.unionByName, hops)


def groups_of_bits(bits: DataFrame, groups: int) -> DataFrame:
    """(group, node, hop) of (node, hop, sets)."""
    return bits.select(F.explode(bitsets.members(F.col("sets"), bitsets.words_for(groups))).alias("group"), "node", "hop")


def k_hop(e: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, hop) reached within k hops."""
    return k_hop_by_group(e, nodes.select(F.lit(0).alias("group"), "node"), k).drop("group")


def _step(e: DataFrame, vec: DataFrame, value: str, keys: list[str], hint: bool = False) -> DataFrame:
    """One round: sums of value times weight by the edges' other end."""
    v = vec.select(*keys, F.col("node").alias("src"), F.col(value).alias("v"))
    return e.join(F.broadcast(v) if hint else v, "src").select(*keys, F.col("dst").alias("node"), (F.col("v") * F.col("weight")).alias("v"))


def heavy_sources(e: DataFrame, most: int = HEAVY) -> DataFrame:
    """(src): nodes with more than one of ``most`` of all edges out; fewer than ``most`` rows, and mostly none."""
    counts = materialise(e.groupBy("src").agg(F.count("*").alias("n")), "degrees")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return materialise(counts.where(F.col("n") * most > total).where(F.col("n") > most).select("src"), "heavy")


def propagate(vec: DataFrame, e: DataFrame, k: int = 1, value: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """k times: new value of j = sum over i of value of i times weight (i, j). Absent nodes are 0. With ``keys``, columns of
    vec such as a worker, each of their values is a vector of its own, and all are propagated at once.

    For several rounds the edges are dealt by their source once, in a table of buckets, so that later rounds move nothing
    but values. Sources of more than a thousandth of the edges would make a bucket large: their edges stay as they are
    dealt, and meet the values of these fewer than a thousand nodes by a broadcast. Sums combine before the shuffle, so
    much-pointed-to nodes are cheap."""
    by = list(keys)
    if k == 1:
        return _step(e, vec, value, by).groupBy(*by, "node").agg(F.sum("v").alias(value))
    e = materialise(e.select("src", "dst", "weight"), "edges")
    heavy = heavy_sources(e)
    some = not heavy.isEmpty()
    rest = e.join(F.broadcast(heavy), "src", "left_anti") if some else e
    hot = e.join(F.broadcast(heavy), "src", "left_semi") if some else None
    with bucketed(rest, "src", "edges_by_source") as dealt:
        for _ in range(k):
            step = _step(dealt, vec, value, by)
            if some:
                loud = vec.join(F.broadcast(heavy.withColumnRenamed("src", "node")), "node", "left_semi")
                # with keys the heavy nodes' values are rows by key, of a number that only the optimiser can see
                step = step.unionByName(_step(hot, loud, value, by, hint=not by))
            vec = materialise(step.groupBy(*by, "node").agg(F.sum("v").alias(value)), "scores")
    return vec


def access_score(e_norm: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """Expected visits of k-step walks that start once at every train node."""
    return propagate(train.select("node", F.lit(1.0).alias("score")), e_norm, k)


def skewed_node_sets(e: DataFrame, n: DataFrame, cached: DataFrame, layers: int, top: int = 8192) -> DataFrame:
    """(level, node): level 0 all cached nodes; level i the ``top`` nodes by i raw steps on A + I."""
    loops = materialise(add_self_loops(e, n), "loops")
    start = cached.select("node").distinct()
    out, v = start.withColumn("level", F.lit(0)), start.withColumn("score", F.lit(1.0))
    for level in range(1, layers):
        v = materialise(propagate(v, loops), "level")
        out = out.unionByName(top_k(v.where("score > 0"), top).select("node", F.lit(level).alias("level")))
    return out.select("level", "node")


def skewed_node_sets_by_rank(e: DataFrame, n: DataFrame, cached: DataFrame, layers: int, top: int = 8192) -> DataFrame:
    """(level, rank, node) for the nodes cached(rank, node) of every worker at once: the worker is a key of the rows, so the
    jobs are as many for any number of workers, and A + I is made once. The best of a level are found in range partitions
    over all workers, not in one task a worker."""
    loops = materialise(add_self_loops(e, n), "loops")
    start = materialise(cached.select("rank", "node").distinct(), "cached")
    out, v = start.withColumn("level", F.lit(0)), start.withColumn("score", F.lit(1.0))
    for level in range(1, layers):
        v = materialise(propagate(v, loops, keys=("rank",)), "level")
        best = top_of_groups(v.where("score > 0"), "rank", [F.desc("score"), "node"], top)
        out = out.unionByName(best.select("rank", "node", F.lit(level).alias("level")))
    return out.select("level", "rank", "node")
