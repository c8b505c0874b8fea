"""Every registered query of the graph jobs against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from graphjobs.jobs import registry

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(v):
    if hasattr(v, "item"):
        v = v.item()
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


#: Other columns of jobs that run here under another name.
TWINS = {"m6_sample_in_waves_nodes", "p7_assign_blocks_greedy", "m5_sampled_layer_nodes"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - TWINS))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, D)
    r = con.execute(registry.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(value(row[names.index(c)]) for c in df.columns) for row in r.fetchall()), key=repr)
    assert sorted((tuple(map(value, row)) for row in df.collect()), key=repr) == expected


def test_plans_have_no_cartesian_product(spark):
    for name in ("n5_access_score", "m1_layer_importance", "p12_resolve_location"):
        plan = registry.QUERIES[name](spark, D)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["m5_sampled_layer", "m6_layerwise_sample", "m7_subgraph_sample", "w2_locality_job"])
def test_samples_make_their_graph_once(spark, name):
    """What is left to run reads the written graph, and doesn't order the lines again to make it."""
    assert "l_orderkey" not in registry.QUERIES[name](spark, D)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["w2_locality_job_favoured", "p10_choose_placement_greedy_blocks", "p12_resolve_location"])
def test_scores_read_the_same_graph(spark, monkeypatch, name):
    """The scores behind a placement read the graph that the rest of the query reads."""
    made, make = [], registry.X.g_next
    monkeypatch.setattr(registry.X, "g_next", lambda s, d: (made.append(d), make(s, d))[1])
    registry.QUERIES[name](spark, D)
    assert len(made) == 1
