"""Hand-computed cases on small graphs."""

import pytest
from pyspark.sql import functions as F

from graphjobs.operators import graph as G
from graphjobs.operators import propagate as N
from graphjobs.operators import relabel as L
from graphjobs.operators import stats as A
from graphjobs.operators.ranking import rank_globally

PAIRS = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5)]


@pytest.fixture(scope="module")
def t(spark):
    rows = [(a, b, 1.0) for a, b in PAIRS] + [(b, a, 1.0) for a, b in PAIRS]
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight double").cache()


@pytest.fixture(scope="module")
def n(spark):
    return spark.range(6).select(F.col("id").alias("node"))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "node bigint")


def vec(df, key="node", value="score", size=6):
    got = {r[key]: r[value] for r in df.collect()}
    return [round(got.get(i, 0.0), 6) for i in range(size)]


def test_normalised_rows(t, n):
    row = {r.dst: r.weight for r in G.laplacian(t, n).where("src = 2").collect()}
    assert row == {0: 0.25, 1: 0.25, 2: 0.25, 3: 0.25}
    row = {r.dst: round(r.weight, 6) for r in G.sym_normalize(t).where("src = 2").collect()}
    assert row == {0: 0.408248, 1: 0.408248, 3: 0.408248}


@pytest.mark.parametrize(
    ("k", "expected"),
    [(1, [0, 0.5, 1, 0, 0.5, 0]), (2, [0.583333, 0.333333, 0.25, 0.583333, 0, 0.25]), (3, [0.25, 0.375, 0.75, 0.083333, 0.541667, 0])],
)
def test_access_score(spark, t, k, expected):
    assert vec(N.access_score(G.row_normalize(t), ids(spark, 0, 3), k)) == expected


def test_closures(spark, t):
    for k, last in ((1, 2), (2, 3), (3, 4)):
        assert sorted(r.node for r in N.k_hop(t, ids(spark, 0), k).collect()) == list(range(last + 1))


def test_relabel(spark, t, n):
    got = {r.node: r.new_id for r in L.relabel_by_degree(n, t).collect()}
    assert got == {2: 0, 0: 1, 1: 2, 3: 3, 4: 4, 5: 5}


def test_propagation_of_cached(spark, t, n):
    loops = G.add_self_loops(t, n)
    one = N.propagate(ids(spark, 2, 3).withColumn("score", F.lit(1.0)), loops)
    assert vec(one) == [1, 1, 2, 2, 1, 0]
    assert vec(N.propagate(one, loops)) == [4, 4, 6, 5, 3, 1]


def test_duplicate_edges(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 2, 1.0)], "src bigint, dst bigint, weight double")
    got = {(r.src, r.dst): r.weight for r in G.symmetrize_max(e).collect()}
    assert got == {(0, 1): 2, (1, 0): 2, (1, 2): 1, (2, 1): 1, (2, 2): 1}
    got = {(r.src, r.dst): r.weight for r in G.add_reverse_edges(e).collect()}
    assert got == {(0, 1): 3, (1, 0): 3, (1, 2): 1, (2, 1): 1, (2, 2): 2}


def test_statistics(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 1, 1, 2, 3, 3)], "k int")
    assert A.skew_ratio(keys, "k").first()[0] == 1.5
    f = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0]), (2, [8.0, 7.0])], "node bigint, features array<float>")
    roles = spark.createDataFrame([(0, "tr"), (1, "tr"), (2, "te")], "node bigint, role string")
    assert {r.node: r.features for r in A.standard_scale(f, roles).collect()} == {0: [-1, 0], 1: [1, 0], 2: [6, 2]}


def test_labels_with_gaps_and_missing(spark, n):
    lab = spark.createDataFrame([(0, 3.0), (1, float("nan")), (2, 5.0), (3, None)], "node bigint, label double")
    assert A.num_classes(lab).first()[0] == 3
    got = {r.node: r.one_hot for r in A.one_hot_with_missing(n, lab).collect()}
    assert got == {0: [1, 0, 0], 2: [0, 0, 1], **{k: [0, 0, 0] for k in (1, 3, 4, 5)}}


def test_pointers_cover_isolated_rows(spark, t):
    more = spark.createDataFrame([(i,) for i in [*range(6), 30_000_000]], "node bigint")
    got = {r.row: (r.start, r.end) for r in G.row_pointers(t, more).collect()}
    assert got == {0: (0, 2), 1: (2, 4), 2: (4, 7), 3: (7, 9), 4: (9, 11), 5: (11, 12), 30_000_000: (12, 12)}


def test_global_rank_has_no_single_partition_window(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.hash("id"), F.lit(50)))
    got = rank_globally(df, [F.desc("k"), F.col("id")])
    assert sorted(r["rank"] for r in got.collect()) == list(range(1000))
    expected = sorted(((-r.k, r.id) for r in df.collect()))
    assert [(-r.k, r.id) for r in got.orderBy("rank").collect()] == expected


def test_empty_graph(spark, n):
    e = spark.createDataFrame([], "src bigint, dst bigint, weight double")
    assert G.degrees(e, n).count() == 6
    assert G.row_normalize(e).count() == 0
    assert N.k_hop(e, ids(spark, 1), 2).collect()[0].node == 1
