"""The forms of operators that are made for large graphs, against plain ones: waves, bit sets, pieces, buckets, partial sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphjobs.functions import bitsets
from graphjobs.functions.tables import bucketed, hadoop_path, is_written, materialise, new_path, scratch
from graphjobs.operators import graph as G
from graphjobs.operators import placement as P
from graphjobs.operators import propagate as N
from graphjobs.operators import sampling as M
from graphjobs.operators import stats as A
from graphjobs.operators.ranking import top_of_groups

EDGES = "src bigint, dst bigint, weight double"


def graph(spark, n, m, seed, hub=0):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(0, k) for k in range(hub)}
    return sorted(pairs), spark.createDataFrame([(a, b, 1.0 + (a * 7 + b) % 3) for a, b in sorted(pairs)], EDGES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, before)


# sets
def test_bitsets(spark):
    r = random.Random(1)
    sets = [{r.randrange(150) for _ in range(r.randrange(9))} for _ in range(60)] + [set(), {63}, {0, 64, 127, 128}, set(range(150))]
    words = bitsets.words_for(150)
    rows = spark.createDataFrame([(k, m) for k, s in enumerate(sets) for m in s], "k int, m int")
    got = rows.select("k", bitsets.single(F.col("m"), words).alias("s")).groupBy("k").agg(bitsets.union_all(F.col("s"), words).alias("s"))
    other = sum(1 << m for m in (3, 64, 149))
    got = got.select("k", bitsets.members(F.col("s"), words).alias("m"), bitsets.size(F.col("s")).alias("n"), bitsets.meets(F.col("s"), other).alias("hit"))
    found = {r.k: (set(r.m), r.n, r.hit) for r in got.collect()}
    assert found == {k: (s, len(s), bool(s & {3, 64, 149})) for k, s in enumerate(sets) if s}


# N3
@pytest.mark.parametrize("groups", [3, 64, 130])
def test_closure_of_bits_is_that_of_groups(spark, groups):
    _, e = graph(spark, 80, 200, 2)
    seeds = spark.createDataFrame([(g, (g * 7 + k) % 90) for g in range(groups) for k in range(2)], "group int, node bigint")
    for k in (0, 1, 3):
        got = sorted(map(tuple, N.groups_of_bits(N.k_hop_bits(e, seeds, groups, k), groups).select("group", "node", "hop").collect()))
        assert got == sorted(map(tuple, N.k_hop_by_group(e, seeds, k).select("group", "node", "hop").collect()))


def test_closure_of_bits_moves_fewer_rows(spark):
    """A row of bits by node, whatever the number of groups that reach it."""
    _, e = graph(spark, 300, 3000, 3)
    seeds = spark.createDataFrame([(g, g * 11 % 300) for g in range(40)], "group int, node bigint")
    bits, rows = N.k_hop_bits(e, seeds, 40, 2).count(), N.k_hop_by_group(e, seeds, 2).count()
    assert bits * 4 < rows


# P7
@pytest.mark.parametrize(("nblocks", "negative"), [(200, False), (70, True)])
def test_greedy_blocks_of_many_words(spark, nblocks, negative):
    pairs, e = graph(spark, 600, 1200, 4)
    weights = {p: 1.0 + (p[0] * 7 + p[1]) % 3 for p in pairs}
    if negative:
        weights |= {p: -weights[p] for p in pairs[::5]}
        e = spark.createDataFrame([(a, b, w) for (a, b), w in sorted(weights.items())], EDGES)
    train = list(range(0, 600, 1 if nblocks == 200 else 4))
    df = spark.createDataFrame(list(enumerate(train)), "pos bigint, node bigint")
    blocks = P.partition_blocks(df, nblocks)
    owner, reach = P.assign_blocks_greedy(e, blocks, 3, 600, 1)
    size = max(1, len(train) // nblocks)
    sets = []
    for at in range(0, len(train), size):
        total = {}
        for (a, b), w in weights.items():
            if a in train[at : at + size]:
                total[b] = total.get(b, 0) + w
        sets.append(set(train[at : at + size]) | {b for b, w in total.items() if w})
    have, load, expected = [set() for _ in range(3)], [1] * 3, []
    for b, s in enumerate(sets):
        score = [abs(len(h & s) * (600 - len(h)) / w) for h, w in zip(have, load)]
        d = b if b < 3 else score.index(max(score))
        have[d] |= s
        load[d] += len(s)
        expected.append(d)
    assert len(sets) > 63 and [r.device for r in owner.orderBy("block").collect()] == expected
    got = {(r.device, r.node) for r in P.nodes_of_devices(reach, owner, 3).collect()}
    assert got == {(d, v) for d in range(3) for v in have[d]}


# M4, M6
def test_smallest_keys_without_a_window_of_a_batch(spark):
    r = random.Random(5)
    rows = [(b, v, r.random() ** 6 if v % 9 else 0.0) for b, n in enumerate((1, 40, 3000, 9000)) for v in range(n)]
    p = materialise(spark.createDataFrame(rows, "batch_id bigint, node bigint, p double").repartition(5), "p")
    u = {(x.batch_id, x.node): x.u for x in p.select("batch_id", "node", M.uniform(F.lit(3), F.col("batch_id"), F.lit(1), F.col("node")).alias("u")).collect()}
    for k in (1, 35, 700, 8192):
        got = M.weighted_sample_without_replacement(p, k, 3, 1)
        expected = set()
        for b in range(4):
            keys = sorted((round(-math.log(u[b, v]) / q, 9), v) for c, v, q in rows if c == b and q > 0)
            expected |= {(b, v) for _, v in keys[:k]}
        assert {(x.batch_id, x.node) for x in got.collect()} == expected and got.columns == p.columns
    assert "_r" not in got.columns


def test_rows_ranked_for_a_draw_are_few(spark):
    """The window of a draw sees the slice of the cut only, under a twentieth of k."""
    n, k = 30_000, 8192
    p = materialise(spark.range(n).select(F.lit(0).alias("batch_id"), F.col("id").alias("node"), (F.lit(1.0) / n).alias("p")), "p")
    u = M.uniform(F.lit(3), F.col("batch_id"), F.lit(0), F.col("node"))
    key = p.select(F.floor(F.log2(F.greatest(F.round(-F.log(u) / F.col("p"), 9), F.lit(1e-9))) * M.SLICES).alias("s")).groupBy("s").count().orderBy("s").collect()
    upto = 0
    for r in key:
        upto += r["count"]
        if upto > k:
            break
    assert r["count"] < k / 20 and len(key) < 2000


def test_a_layer_draws_its_keys_once(spark, monkeypatch):
    """Keys are written beside the probabilities; the layer is a filter of those rows and meets nothing but its cuts."""
    plans, write = {}, M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    e = spark.range(400).select((F.col("id") % 40).alias("src"), (F.col("id") * 7 % 101).alias("dst"), F.lit(1.0).alias("weight"))
    front = spark.range(60).select((F.col("id") % 3).alias("batch_id"), (F.col("id") % 45).alias("node"))
    nodes = M.sampled_layer(e, front, 8, 1, 0)[1]
    assert "md5" in plans["probabilities"] and "md5" not in plans["layer"]
    assert plans["layer"].count("Join") <= 2
    rows = nodes.collect()
    prev = {(r.batch_id, r.node) for r in front.distinct().collect()}
    assert {(r.batch_id, r.node) for r in rows if r.is_prev} == prev
    every = M.weighted_sample_without_replacement(M.to_probability(M.layer_importance(e, front)), 8, 1, 0)
    assert {(r.batch_id, r.node) for r in rows} == prev | {(r.batch_id, r.node) for r in every.collect()}


def test_waves_are_one_sample_and_go_on_where_they_were(spark, monkeypatch):
    _, e = graph(spark, 200, 3000, 6)
    e = materialise(e, "edges")
    batches = materialise(M.make_train_batches(spark.range(120).select(F.col("id").alias("pos"), F.col("id").alias("node")), 3, 16, 1), "batches")
    args = [[20, 25, 30], [1, 0, 1], 9]
    one = M.layerwise_sample(e, batches, *args)
    path = new_path(spark, "epoch")
    made = []
    whole = M.layerwise_sample
    monkeypatch.setattr(M, "layerwise_sample", lambda e, own, *a: made.append(own.count()) or whole(e, own, *a))
    for waves_again in (4, 0):
        waves = M.sample_in_waves(e, batches, path, 4, *args)
        for a, b in zip(one, waves):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
        assert len(made) == waves_again and sum(made) in (120, 0)
        made.clear()
    fs, _ = hadoop_path(spark, path)
    for name in ("blocks", "layer_nodes"):  # a stopped job: one wave unwritten, one half written
        fs.delete(hadoop_path(spark, f"{path}/{name}/wave=1")[1], True)
    fs.delete(hadoop_path(spark, f"{path}/blocks/wave=2/_SUCCESS")[1], True)
    again = M.sample_in_waves(e, batches, path, 4, *args)
    assert len(made) == 2
    assert sorted(map(tuple, one[0].collect())) == sorted(map(tuple, again[0].select(*one[0].columns).collect()))


def test_scratch_tables_go(spark):
    with scratch(spark):
        outer = materialise(spark.range(3), "outer")
        with scratch(spark):
            inner = materialise(outer, "inner").inputFiles()[0].rpartition("/")[0]
            assert is_written(spark, inner)
        assert not is_written(spark, inner) and outer.count() == 3
        kept = outer.inputFiles()[0].rpartition("/")[0]
    assert not is_written(spark, kept)
    assert materialise(spark.range(3), "stays").count() == 3


def test_subgraph_sample_by_its_rule(spark):
    pairs, e = graph(spark, 60, 500, 7)
    batches = spark.createDataFrame([(b, v) for b in range(2) for v in range(b * 5, b * 5 + 6)], "batch_id bigint, node bigint")
    blocks, sets = M.subgraph_sample(e, batches, 8, [1, 1, 0], 2)
    entries = {a: sum(1 for x, _ in pairs if x == a) for a, _ in pairs}
    nodes = {}
    for r in sets.collect():
        nodes.setdefault((r.batch_id, r.layer), {})[r.node] = r
    assert set(nodes) == {(b, layer) for b in range(2) for layer in (0, 1)}
    for (b, layer), held in nodes.items():
        rows = [v for v in held if held[v].is_prev]
        assert layer or len(rows) == len(held)
        reachable = {y for x, y in pairs if x in range(b * 5, b * 5 + 6)}
        s = min(len(reachable), 8)
        expected = {}
        for x, y in pairs:
            if x in rows and y in held:
                p = held[y].prob
                expected[x, y] = 1 / min(max(s * p, 1e-10), 1) / entries[x]
        got = {(r.src, r.dst): r.value for r in blocks.where(f"batch_id = {b} AND layer = {layer}").collect()}
        assert got.keys() == expected.keys() and all(math.isclose(got[q], expected[q], rel_tol=1e-9) for q in got)


# N5, N8
def test_propagation_by_buckets_moves_scores_only(spark, no_broadcast):
    _, e = graph(spark, 100, 900, 8)
    with bucketed(e, "src") as dealt:
        plan = plan_of(N._step(dealt, spark.range(100).select(F.col("id").alias("node"), F.lit(1.0).alias("score")), "score", []))
        assert plan.count("Exchange hashpartitioning(src") <= 1 and plan.count("Exchange") == 1  # of the scores
        assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
        where = [r.location for r in spark.sql("SHOW TABLES").selectExpr("tableName as location").collect()]
        assert where
    assert not [r for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("buckets_")]


def test_heavy_sources_are_propagated_alike(spark, monkeypatch):
    pairs, e = graph(spark, 300, 900, 9, hub=280)
    monkeypatch.setattr(N, "HEAVY", 10)
    assert [r.src for r in N.heavy_sources(e, 10).collect()] == [0]
    monkeypatch.setattr(N.heavy_sources, "__defaults__", (10,))
    a = np.zeros((300, 300))
    for x, y in pairs:
        a[x, y] = 1.0 + (x * 7 + y) % 3
    v = np.arange(300) % 5 + 1.0
    vec = spark.createDataFrame([(k, float(v[k])) for k in range(300)], "node bigint, score double")
    got = {r.node: r.score for r in N.propagate(vec, e, 3).collect()}
    want = v @ a @ a @ a
    assert all(math.isclose(got.get(k, 0.0), want[k], rel_tol=1e-9) for k in range(300))
    two = vec.withColumn("rank", F.lit(0)).union(vec.withColumn("score", F.col("score") * 2).withColumn("rank", F.lit(1)))
    by_rank = {(r.rank, r.node): r.score for r in N.propagate(two, e, 3, keys=("rank",)).collect()}
    assert all(math.isclose(by_rank.get((q, k), 0.0), want[k] * (q + 1), rel_tol=1e-9) for q in (0, 1) for k in range(300))


def test_favoured_sets_of_all_workers_at_once(spark):
    _, e = graph(spark, 90, 400, 10)
    n = spark.range(90).select(F.col("id").alias("node"))

    def jobs(workers):
        held = materialise(spark.createDataFrame([(d, (d * 13 + k) % 90) for d in range(workers) for k in range(9)], "rank int, node bigint"), "held")
        spark.sparkContext.setJobGroup(f"workers {workers}", "")
        got = sorted(map(tuple, N.skewed_node_sets_by_rank(e, n, held, 3, 20).collect()))
        spark.sparkContext.setJobGroup("", "")
        return held, got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"workers {workers}"))

    held, got, few = jobs(2)
    want = [(r.level, d, r.node) for d in range(2) for r in N.skewed_node_sets(e, n, held.where(f"rank = {d}"), 3, 20).collect()]
    assert got == sorted(want)
    assert jobs(9)[2] <= few + 2


def test_top_of_groups(spark):
    rows = [(k % 3 if k % 7 else None, k, float(k * 37 % 101)) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, node bigint, score double")
    got = {}
    for r in top_of_groups(df, "g", [F.desc("score"), "node"], 4).collect():
        got.setdefault(r.g, []).append((r.slot, r.node))
    for g in (None, 0, 1, 2):
        best = sorted((-s, k) for q, k, s in rows if q == g)[:4]
        assert sorted(got[g]) == [(n, k) for n, (_, k) in enumerate(best)]


# A9, G13
def test_moments_of_far_numbers(spark):
    """Values far from 0, whose squares would lose the spread."""
    r = np.random.default_rng(11)
    x = r.normal(size=(500, 6)) + 1e7
    x[:, 3] = 4.0
    roles = ["tr" if k % 3 else "va" for k in range(500)]
    f = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node bigint, features array<double>").repartition(7)
    got = A.standard_scale(f, spark.createDataFrame(list(enumerate(roles)), "node bigint, role string"))
    train = x[[k % 3 != 0 for k in range(500)]]
    s = train.std(0)
    want = (x - train.mean(0)) / np.where(s == 0, 1, s)
    rows = {q.node: q.features for q in got.collect()}
    assert len(rows) == 500 and all(np.allclose(rows[k], want[k], atol=1e-6) for k in range(500))
    assert "Generate" not in plan_of(got)
    none = A.standard_scale(f, spark.createDataFrame([(0, "va")], "node bigint, role string"))
    assert none.count() == 500 and none.where("features is not null").count() == 0


def test_hub_rows_of_an_adjacency_come_in_pieces(spark):
    pairs, e = graph(spark, 50, 300, 12, hub=47)
    rows = G.to_adjacency(e, 5).collect()
    assert max(len(r.nbrs) for r in rows) == 5
    back = {}
    for r in sorted(rows, key=lambda r: (r.src, r.piece)):
        back.setdefault(r.src, []).extend(q.dst for q in r.nbrs)
    assert back == {a: [y for x, y in pairs if x == a] for a, _ in pairs}
    assert sorted(map(tuple, G.from_adjacency(G.to_adjacency(e, 5)).collect())) == sorted(map(tuple, e.collect()))


def test_symmetrize_max_reads_and_shuffles_edges_once(spark):
    """Against sums by hand, with repeats, self loops and one-way pairs; one exchange and one read of the edges."""
    r = random.Random(5)
    rows = [(r.randrange(9), r.randrange(9), float(r.randrange(4))) for _ in range(60)]
    once = {}
    for a, b, w in rows:
        once[a, b] = once.get((a, b), 0.0) + w
    expected = {p: max(once.get(p, 0.0), once.get(p[::-1], 0.0)) for q in once for p in (q, q[::-1])}
    out = G.symmetrize_max(spark.createDataFrame(rows, EDGES))
    got = out.collect()
    assert len(got) == len(expected) and {(x.src, x.dst): x.weight for x in got} == expected
    assert plan_of(out).split("Initial Plan")[-1].count("Exchange") == 1


def test_k_hop_by_group_finds_known_nodes_without_a_join(spark):
    """A hop is one aggregation over its step and the known nodes; weights that cancel out reach nothing."""
    r = random.Random(8)
    edges = [(r.randrange(30), r.randrange(30), r.choice((-1.0, 1.0, 2.0))) for _ in range(120)]
    seeds = [(g, r.randrange(30)) for g in range(4) for _ in range(3)]
    expected = {(g, n): 0 for g, n in seeds}
    front = set(expected)
    for hop in (1, 2):
        sums = {}
        for g, n in front:
            for a, b, w in edges:
                if a == n:
                    sums[g, b] = sums.get((g, b), 0.0) + w
        front = {p for p, w in sums.items() if w != 0 and p not in expected}
        expected |= {p: hop for p in front}
    out = N.k_hop_by_group(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "group int, node bigint"), 2)
    got = out.collect()
    assert len(got) == len(expected) and {(x.group, x.node): x.hop for x in got} == expected
    assert "LeftAnti" not in plan_of(out) and plan_of(out).split("Initial Plan")[-1].count("HashAggregate") == 2
