"""Vectors, pages, the classifier, components and the pipeline."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from graphjobs.llm import common, imi, quality, queries, url_filter  # noqa: E402

D = "/root/testdata/sf0.001"


def find_classes(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")).collect()}
    root = find_classes(341, pairs)
    assert got == {i: root[i] for p in pairs for i in p if p[0] != p[1]}
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keyed_batches():
    key = [1, 1, 2, 2, 2, 5, 6, 6]
    batches = [pa.RecordBatch.from_pydict({"k": key[a:b], "v": list(range(a, b))}) for a, b in ((0, 1), (1, 4), (4, 4), (4, 5), (5, 8))]
    assert [t["v"].to_pylist() for t in common.by_key(iter(batches), ["k"])] == [[0, 1], [2, 3, 4], [5], [6, 7]]


def vectors(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(y) for y in v], 0) for i, v in x], "vec_id bigint, embedding array<float>, label int")


@pytest.mark.parametrize("chunk", [1024, 7])
def test_embedding_classes(spark, chunk):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres.repeat(6, 0) + rng.normal(size=(180, 16)) * 0.25, centres[:5], centres[:5], rng.normal(size=(80, 16))])
    x = x.astype(np.float32).astype(float)
    rows = [*enumerate(x), (500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0] * 3)]
    got = {r.vec_id: r for r in imi.embedding_classes(vectors(spark, rows), chunk=chunk).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.9 * close.sum() and all(got[i].n_links <= close[i].sum() for i in range(len(x)))
    if found == close.sum():
        assert [got[i].component_id for i in range(len(x))] == find_classes(len(x), np.argwhere(close).tolist())
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (500, 501, 502, 503))


def test_embedding_odd_rows(spark):
    got = imi.embedding_classes(vectors(spark, [(None, [1.0, 0, 0, 0]), (3, [1.0, 0, 0, 0]), (3, [1.0, 0, 0, 0]), (2, [0.0, 1, 0, 0])])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (2, 0, 2)], key=repr)
    assert imi.embedding_classes(vectors(spark, [])).count() == 0


def test_traversal_visits_nearest_cells():
    rng = np.random.default_rng(2)
    a, b = rng.random((20, 9)), rng.random((20, 9))
    for k in (1, 5, 30, 81):
        way = imi.traverse(a, b, k)
        sums = (a[:, :, None] + b[:, None]).reshape(20, -1)
        assert np.allclose(np.take_along_axis(sums, way, 1), np.sort(sums, 1)[:, :k])


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_url_rules(spark):
    cases = {
        "https://a.example.com/en/1": "block", "https://www.example.com/en/1": "allow", "https://WWW.Example.COM/en/?q": "allow",
        "http://x.com/": "allow", "http://com/": "allow", "http://notcom.org/es/": None, "http://x.net/es/1": "block", "http://x.net/de/": None,
        "http://x.net/fr/#a": "block", "http://example.com": None, "x.net/es/": None, "http://evilexample.com/en/": "allow",
    }
    df = pages(spark, [*((i, u, None) for i, u in enumerate(cases)), (99, None, "<p>")])
    got = {r.page_id: r for r in url_filter.judge_pages(df, list(url_filter.RULES)).collect()}
    for i, (u, v) in enumerate(cases.items()):
        assert (got[i].verdict, got[i].rule is None) == (v or "allow", v is None), u
    assert (got[99].host, got[99].path, got[99].rule, got[99].verdict) == ("", "", None, "allow")
    assert got[2].host == "www.example.com" and got[2].path == "/en/"


def test_many_rules_decide_alike(spark):
    rng = np.random.default_rng(3)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net"], ["/", "/a", "/a/b"]
    rules = [(("allow", "block")[int(rng.integers(2))], h, p) for h in hosts for p in paths] + [("block", f"h{i}.org", "/") for i in range(60)]
    places = spark.createDataFrame([(h, p) for h in [*hosts, "c.b.a.com", "h3.org", "", "q.h7.org"] for p in ("", "/", "/a/b/c", "/ab")], "host string, path string")
    few = [r for r in rules if r[1] in hosts]
    for part in (few, rules):
        a = {(r.host, r.path): r.decision for r in url_filter.decide(places, part).collect()}
        for (host, path), got in a.items():
            fits = [(len(h) + len(p), len(h), v == "allow", h + p) for v, h, p in part if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert (tuple(got) if got else None) == (max(fits) if fits else None)


def test_redirect_aliases(spark):
    link = '<html><head><LINK href="{}" rel=canonical></head>'
    rows = [
        (1, "http://one.org/a", link.format("http://bad.net/es/x")),
        (2, "http://two.org/b?x=1", '<meta http-equiv="refresh" content="0; url=http://one.org/a">'),
        (3, "http://two.org/b", None),
        (4, "http://fine.com/c", link.format("http://two.org/b")),
        (5, "http://three.org/d/e", link.format("f")),
        (6, "http://three.org/d/f", link.format("/d/e")),
        (7, "http://four.org/", "<p>rel=canonical</p>"),
    ]
    moved = spark.createDataFrame([("http://five.org/x", "http://three.org/d/e")], "from_url string, to_url string")
    got = {r.page_id: r for r in url_filter.judge_pages(pages(spark, [*rows, (8, "http://five.org/x", None)]), list(url_filter.RULES), moved).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    assert got[5].alias_group == got[6].alias_group == got[8].alias_group == "five.org/x"
    assert url_filter.judge_pages(pages(spark, []), list(url_filter.RULES)).count() == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.Trees(rounds=40).fit(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    one = t.score(x[2000:2001])[0]
    margin = t.base
    for root in t.roots:  # node by node
        k = root
        for _ in range(t.depth):
            k = t.left[k] if x[2000, t.feature[k]] <= t.threshold[k] else t.right[k]
        margin += t.value[k]
    assert abs(one - 1 / (1 + np.exp(-margin))) < 1e-12
    assert quality.Trees().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_on_held_out_rows(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op9_quality(spark, "/root/testdata/sf0.01").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [(known[i], got[i].predicted) for i in known if i in got and quality.crc_fold(i) == 0]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert all(r.held_out == (quality.crc_fold(i) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    odd = docs.limit(0).union(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema))
    trees = quality.fit_quality(docs, labels)
    assert quality.score_quality(odd, trees).count() == 2
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, D)
    r = con.execute(queries.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)

    def value(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    expected = sorted((tuple(value(row[names.index(c)]) for c in df.columns) for row in r.fetchall()), key=repr)
    assert sorted((tuple(map(value, row)) for row in df.collect()), key=repr) == expected


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = common.table(spark, D, "documents")
    docs = docs.unionByName(docs.limit(1)).withColumn("token", F.lit(1)).withColumn("slot", F.lit("x"))
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        path = common.new_path(spark, "stage")
        stage(spark, docs, D).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns, name
        docs, n = after, after.count()
        assert n > 0
        if name != "mixing sources to target weights":
            assert n <= before
        before = n
    coded = p.STAGES[-1][1](spark, docs, D)
    assert coded.count() == before and coded.where("not parity").count() == 0
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, D).count() == 0


def test_embedding_rare_pairs(spark):
    """Few planted pairs at the threshold in a table of unique vectors are found too."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(400, 64))
    side -= (side * x[:400]).sum(1, keepdims=True) * x[:400]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([x[:400], 0.901 * x[:400] + np.sqrt(1 - 0.901**2) * side, x[400:]])
    # ids by the hash that draws the probes, so that no probe has a partner
    ids = [r.id for r in spark.range(len(x)).orderBy(F.xxhash64("id", F.lit(1)), "id").collect()][::-1]
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))})
    got = {r.vec_id: r.n_links for r in imi.embedding_classes(spark.createDataFrame(table)).collect()}
    found = sum(got[i] for i in ids[:400])
    print("found", found)
    assert found >= 0.96 * 400 and sum(got.values()) == 2 * found
