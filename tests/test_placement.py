"""Placement, sampling and batching: worked examples, plain-Python doubles and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphjobs.operators import graph as G
from graphjobs.operators import placement as P
from graphjobs.operators import sampling as M

SCORES = [0.25, 0.375, 0.75, 1 / 12, 6.5 / 12, 0.0]
PAIRS = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(list(enumerate(SCORES)), "node bigint, score double").cache()


def plain(scores, devices, rows, alpha):
    """The exchange, swap by swap."""
    order = sorted(range(len(scores)), key=lambda k: (-scores[k], k))[: devices * rows]
    buffers = [order[:rows] for _ in range(devices)]
    seen = [{v: (d, s) for s, v in enumerate(order[:rows])} for d in range(devices)]
    load, turn = [0.0] * devices, []
    for i, cand in enumerate(order[rows:]):
        if i % (devices - 1) == 0:
            turn = sorted(range(devices), key=lambda d: (load[d], d))
        slot = rows - 1 - i // (devices - 1)
        out = order[slot]
        if scores[cand] < alpha * scores[out]:
            break
        d = turn[i % (devices - 1)]
        load[d] += scores[cand]
        for view in seen:
            view[cand] = (d, slot)
        seen[d][out] = (turn[-1], slot)
        buffers[d] = [*buffers[d][:slot], cand, *buffers[d][slot + 1 :]]
    return buffers, seen


@pytest.mark.parametrize(("devices", "rows", "alpha"), [(2, 3, 0.0), (2, 3, 0.5), (2, 3, 1e9), (2, 2, 0.5), (2, 2, 0.9), (3, 2, 0.0)])
def test_hot_replicated(spark, scores, devices, rows, alpha):
    buffer, location = P.place_hot_replicated(scores, devices, rows, alpha, "exact")
    buffers, seen = plain(SCORES, devices, rows, alpha)
    got = {(r.device, r.slot): r.node for r in buffer.collect()}
    assert got == {(d, s): v for d in range(devices) for s, v in enumerate(buffers[d])}
    where = {(r.viewer, r.node): (r.holder, r.slot) for r in location.collect()}
    assert where == {(d, v): x for d in range(devices) for v, x in seen[d].items()}
    assert all(got[x] == v for (_, v), x in where.items())


def test_known_buffers(spark, scores):
    buffer, _ = P.place_hot_replicated(scores, 3, 2, 0.0, "exact")
    assert [[r.node for r in buffer.where(f"device = {d}").orderBy("slot").collect()] for d in range(3)] == [[2, 1], [5, 0], [3, 4]]


def test_exact_balance_on_random_scores(spark):
    rng = np.random.default_rng(3)
    values = [round(float(x), 6) for x in rng.random(60)]
    df = spark.createDataFrame(list(enumerate(values)), "node bigint, score double")
    buffer, _ = P.place_hot_replicated(df, 4, 9, 0.3, "exact")
    buffers, _ = plain(values, 4, 9, 0.3)
    assert {(r.device, r.slot): r.node for r in buffer.collect()} == {(d, s): v for d in range(4) for s, v in enumerate(buffers[d])}


def test_greedy_blocks_against_sets(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))})
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src bigint, dst bigint, weight double")
    train = list(range(0, 60, 2))
    df = spark.createDataFrame(list(enumerate(train)), "pos bigint, node bigint")
    owner, _ = P.assign_blocks_greedy(e, P.partition_blocks(df, 7), 3, 60, 1)
    size = len(train) // 7
    blocks = [train[i : i + size] for i in range(0, len(train), size)]
    have, load, expected = [set() for _ in range(3)], [1] * 3, []
    for b, block in enumerate(blocks):
        reach = set(block) | {y for x, y in edges if x in block}
        score = [abs(len(h & reach) * (60 - len(h)) / w) for h, w in zip(have, load)]
        d = b if b < 3 else score.index(max(score))
        have[d] |= reach
        load[d] += len(reach)
        expected.append(d)
    assert [r.device for r in owner.orderBy("block").collect()] == expected


def test_layer_factors(spark):
    rows = [(a, b, 1.0) for a, b in PAIRS] + [(b, a, 1.0) for a, b in PAIRS]
    t = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    front = spark.createDataFrame([(0, 0), (0, 3)], "batch_id bigint, node bigint")
    imp = M.layer_importance(t, front)
    assert {r.node: r.imp for r in imp.collect()} == {1: 1, 2: 2, 4: 1}
    for k, expected in ((2, {1: 2.0, 2: 1.0, 4: 2.0}), (4, {1: 1.3333, 2: 1.0, 4: 1.3333})):
        got = M._factors(M.to_probability(imp), k, 1e-10)
        assert {r.node: round(r.factor, 4) for r in got.collect()} == expected
    block, nodes = M.sampled_layer(t, front, 4, 1, 0)
    assert sorted(r.node for r in nodes.collect()) == [0, 1, 2, 3, 4]
    assert block.count() == 4
    n = {r.src: r.n for r in t.groupBy("src").agg(F.count("*").alias("n")).collect()}
    assert all(abs(r.value - {1: 4 / 3, 2: 1, 4: 4 / 3}[r.dst] / n[r.src]) < 1e-9 for r in block.collect())


@pytest.mark.parametrize("local", [False, True])
def test_batches_partition_the_train_set(spark, local):
    train = spark.range(103).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("node"))
    got = M.make_train_batches(train, 4, 10, 1, local_shuffle=local).collect()
    assert sorted(r.node for r in got) == [3 * i for i in range(103)]
    sizes = {}
    for r in got:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert max(sizes.values()) == 10 and len(sizes) == 12
    if local:
        assert all(r.node // 3 // 26 == r.rank for r in got)


def test_inclusion_follows_probability(spark):
    p = spark.createDataFrame([(b, i, (i + 1) / 10) for b in range(600) for i in range(4)], "batch_id bigint, node bigint, p double")
    got = M.weighted_sample_without_replacement(p, 1, 9).groupBy("node").count().collect()
    share = {r.node: r["count"] / 600 for r in got}
    assert all(abs(share[i] - (i + 1) / 10) < 0.06 for i in range(4))


def test_movement_adds_up(spark, scores):
    _, location = P.place_hot_replicated(scores, 2, 2, 0.0, "exact")
    inputs = spark.createDataFrame([(0, 0, i) for i in range(6)] + [(1, 1, i) for i in range(6)], "batch_id bigint, rank int, node bigint")
    for r in P.movement_report(P.resolve_location(inputs, location), 8).collect():
        assert r.local + r.remote + r.host == r.total == 6 and r.bytes == 6 * 32


def test_more_cached_than_nodes_and_one_worker(spark, scores):
    buffer, _ = P.place_hot_replicated(scores, 1, 50, 0.0)
    assert buffer.count() == 6
    n = scores.select("node")
    assert P.place_contiguous(n, 2, 4).count() == 6
    assert P.place_contiguous(n, 2, 0).count() == 0
    assert G.union_nodes(n, n).count() == 6


def test_greedy_blocks_with_more_sets_than_a_driver_takes(spark, monkeypatch):
    """However many distinct sets of blocks there are, all are counted by tasks."""
    monkeypatch.setattr(P, "MASKS", 3, raising=False)
    test_greedy_blocks_against_sets(spark)


def test_favoured_by_rank(spark):
    """A worker's favoured nodes count for its own batches only."""
    from graphjobs.operators import sampling as M

    imp = spark.createDataFrame([(0, 5, 1.0), (1, 5, 1.0), (1, 6, 2.0)], "batch_id bigint, node bigint, imp double")
    ranks = spark.createDataFrame([(0, 0), (1, 1)], "batch_id bigint, rank int")
    own = spark.createDataFrame([(1, 5), (0, 6)], "rank int, node bigint")
    got = {(r.batch_id, r.node): r.imp for r in M.bias_local(imp, own, 4.0, ranks).collect()}
    assert got == {(0, 5): 1.0, (1, 5): 4.0, (1, 6): 2.0}
    every = {(r.batch_id, r.node): r.imp for r in M.bias_local(imp, own.select("node").where("node = 5"), 4.0).collect()}
    assert every == {(0, 5): 4.0, (1, 5): 4.0, (1, 6): 2.0}
