"""Vector compression, language ID and clustering against plain versions, and on odd tables."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphjobs.llm import language, queries, vector_codes
from graphjobs.llm.centroids import build_tree, cluster_vectors, node_ranges, undominated
from graphjobs.llm.language import Profiles, learn_languages, ngrams, predict_languages, profile
from graphjobs.llm.quality import crc_fold
from graphjobs.llm.vector_codes import CodebookTree, compress_vectors

D = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def finite(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def floors(v, scale):
    return np.clip(np.floor(scale * np.array(v, np.float32).astype(float)), -(1 << 27), 1 << 27).astype(np.int64)


def odd_vectors(seed, n=700, dims=64, ids=None):
    """Lattice vectors with many ties, hot copies, repeated and null ids, and all that is dropped."""
    r = np.random.default_rng(seed)
    x = r.integers(-2, 3, (n, dims)) / 64
    x[: n // 3] = x[0]
    rows = [(int(k) if ids is None else ids(k), x[k].tolist(), int(k) % 3 if k % 5 else None) for k in range(n)]
    rows += [(n + 1, None, 0), (n + 2, [None] * dims, 0), (n + 3, [float("nan")] * dims, 1), (n + 4, [float("inf")] + [0.0] * (dims - 1), None)]
    return [(*row, "taken", 1) for row in rows]


def plain_codes(rows, scale=256, parts=16, entries=64, rounds=2):
    kept = [(i, floors(v, scale), lab) for i, v, lab, *_ in rows if finite(v)]
    out = []
    for dims in sorted({len(x) for _, x, _ in kept}):
        own = [k for k in kept if len(k[1]) == dims]
        first = sorted(own, key=lambda k: (k[0] is None, k[0] or 0, k[1].tolist()))[:entries]
        cuts = [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]
        books = [[f[1][a:b] for f in first] for a, b in cuts]

        def near(p, y):
            return min((int(((y - z) ** 2).sum()), k) for k, z in enumerate(books[p]))

        for _ in range(rounds):
            new = [list(b) for b in books]
            for p, (a, b) in enumerate(cuts):
                by = {}
                for _, x, _ in own:
                    by.setdefault(near(p, x[a:b])[1], []).append(x[a:b])
                for k, ys in by.items():
                    new[p][k] = np.array([int(s) // len(ys) for s in np.sum(ys, 0)], np.int64)
            books = new
        digest = hashlib.sha256(",".join(str(int(v)) for b in books for z in b for v in z).encode()).hexdigest()
        for i, x, lab in own:
            found = [near(p, x[a:b]) for p, (a, b) in enumerate(cuts)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab, digest))
    total = Counter()
    for _, _, e, lab, _ in out:
        total[lab] += e
    return sorted(((i, c, e, total[lab], h) for i, c, e, lab, h in out), key=repr)


def plain_clusters(rows, k=16, rounds=3, scale=64):
    kept = [(i, floors(v, scale)) for i, v, *_ in rows if v is not None and len(v) == 64 and finite(v)]
    def order(r):
        return (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist())

    centres = [x for _, x in sorted(kept, key=order)[:k]]

    def near(x):
        return min((int(((x - z) ** 2).sum()), c) for c, z in enumerate(centres))

    for _ in range(rounds):
        by = {}
        for _, x in kept:
            by.setdefault(near(x)[1], []).append(x)
        centres = [np.array([int(s) // len(by[c]) for s in np.sum(by[c], 0)], np.int64) if c in by else z for c, z in enumerate(centres)]
    found = [(i, *near(x)) for i, x in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, z.tolist())).encode()).hexdigest() for z in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in found), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_codebook_tree_keeps_ties_of_lower_indexes():
    r = np.random.default_rng(1)
    for width in (1, 2, 4, 5):
        for top in (2, 4, 400):
            entries, points = r.integers(-top, top, (64, width)), r.integers(-top - 3, top + 3, (3000, width))
            index, d = CodebookTree(entries).nearest(points)
            every = ((points[:, None] - entries[None]) ** 2).sum(2)
            assert (index == every.argmin(1)).all() and (d == every.min(1)).all()


def test_filtering_keeps_every_centroid_that_is_nearest_somewhere():
    r = np.random.default_rng(2)
    for top in (2, 6, 60):
        x, centroids = r.integers(-top, top, (500, 5)), r.integers(-top, top, (16, 5))
        centroids[9] = centroids[3]  # equal ones tie everywhere
        order, lo, hi, sums = build_tree(x)
        assert sorted(order.tolist()) == list(range(500))
        for node, (a, b, _) in enumerate(node_ranges(500)):
            own = x[order[a:b]]
            assert (own >= lo[node]).all() and (own <= hi[node]).all() and (own.sum(0) == sums[node]).all()
            nearest = set(((own[:, None] - centroids[None]) ** 2).sum(2).argmin(1).tolist())
            assert nearest <= set(undominated(lo[node], hi[node], np.arange(16), centroids).tolist())


@pytest.mark.parametrize("ids", [None, lambda k: k // 2, lambda k: None if k % 4 == 0 else k % 50])
def test_codes_by_brute_force(spark, ids):
    rows = odd_vectors(3, 300, ids=ids)
    assert got(compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain_codes(rows)


def test_codes_of_odd_lengths_and_sizes(spark):
    rows = [(k, [float(k % 7), -1e30 if k == 3 else 0.5][: k % 3], None, "", 0) for k in range(40)]
    rows += [(100 + k, [0.01 * ((k * i) % 11) for i in range(20)], k % 2, "", 0) for k in range(90)]
    out = got(compress_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert out == plain_codes(rows) and len(out) == 130
    assert got(compress_vectors(spark.createDataFrame(rows[:5], SCHEMA))) == plain_codes(rows[:5])  # fewer vectors than entries
    for none in ([], [(1, None, None, "", 0)]):
        assert got(compress_vectors(spark.createDataFrame(none, SCHEMA))) == []


@pytest.mark.parametrize("ids", [None, lambda k: k // 2, lambda k: None if k % 4 == 0 else k % 50])
def test_clusters_by_brute_force(spark, ids):
    rows = odd_vectors(4, 700, ids=ids)
    rows += [(9000, [0.5] * 63, 0, "", 0), (9001, [], 0, "", 0), (9002, [-1e30] + [0.0] * 63, 0, "", 0)]
    assert got(cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain_clusters(rows)


def test_clusters_of_hot_and_of_few_vectors(spark):
    r = np.random.default_rng(5)
    many = [(k, (r.normal(size=64) / 64 if k % 3 else np.full(64, 0.25)).tolist(), 0, "", 0) for k in range(9000)]
    assert got(cluster_vectors(spark.createDataFrame(many, SCHEMA).coalesce(1))) == plain_clusters(many)  # several blocks, whole nodes
    few = odd_vectors(6, 9)
    assert got(cluster_vectors(spark.createDataFrame(few, SCHEMA))) == plain_clusters(few)
    assert got(cluster_vectors(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_centroids"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{D}/embeddings.parquet'")
    df = queries.QUERIES[name](spark, D)
    assert got(df) == sorted(con.execute(queries.SQL[name]).fetchall(), key=repr)


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    found = Counter()
    for w in words:
        for n in (1, 2, 3):
            padded = w if n == 1 else f" {w} "
            found.update(padded[k : k + n] for k in range(len(padded) - n + 1))
    return found


def packed(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(gram))


def test_ngrams_by_brute_force(monkeypatch):
    r = random.Random(7)
    texts = ["", None, " ", "a", "12 3", "Straße 12\nÉté--b", "\U00020000\U0001d400x", "İstanbul ǅ ʰ", *("".join(r.choice("aB é\n1ß-") for _ in range(r.randint(0, 60))) for _ in range(200))]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(language, "PIECE", piece)
        for t in texts:
            keys, counts = ngrams(t)
            assert dict(zip(keys.tolist(), counts.tolist())) == {packed(g): n for g, n in plain_ngrams(t).items()}


def plain_languages(rows, size):
    counts = {}
    for i, t, lang in rows:
        if i is not None and lang is not None and t is not None and crc_fold(i):
            counts.setdefault(lang, Counter()).update(plain_ngrams(t))

    def top(c):
        return [g for g, _ in sorted(c.items(), key=lambda p: (-p[1], packed(p[0])))[:size]]

    profiles = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in counts.items() if c}
    out = []
    for i, t, _ in rows:
        own = top(plain_ngrams(t))
        held = i is None or crc_fold(i) == 0
        if not own or not profiles:
            out.append((i, held, "und", 0.0))
            continue
        apart = {lang: sum(abs(k - p[g]) if g in p else size for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        out.append((i, held, best, 1 - apart[best] / (size * len(own))))
    return sorted(out, key=repr)


def test_languages_by_brute_force(spark):
    source = duckdb.sql(f"SELECT doc_id, text, lang FROM '{D}/documents.parquet'").fetchall()
    rows = [*source, (None, "the and of", "en"), (5, source[5][1], None), (5, source[5][1], source[5][2]), (100_001, None, "de"), (100_002, "", "de"), (100_003, "4 !!", "zz"), (100_004, source[0][1] * 3, "\U0001f600")]
    docs = spark.createDataFrame([(*r, "held", 0.5) for r in rows], "doc_id long, text string, lang string, place string, score double").repartition(3)
    for size in (language.PROFILE, 20):
        assert got(predict_languages(docs, learn_languages(docs, size=size))) == plain_languages(rows, size)


def test_language_accuracy_on_held_out_texts(spark):
    d = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{d}/documents.parquet'").fetchall())
    held = [r for r in queries.op12_language_id(spark, d).collect() if r.held_out]
    assert len(held) > 150 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_languages_of_empty_tables_and_without_labels(spark):
    schema = "doc_id long, text string, lang string"
    none, unlabelled = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a text", None), (2, None, None)], schema)
    assert got(predict_languages(none, learn_languages(none))) == []
    assert [tuple(r)[2:] for r in predict_languages(unlabelled, learn_languages(unlabelled)).collect()] == [("und", 0.0)] * 2
    assert Profiles.of({}).predict("text") == ("und", 0.0)
    assert profile(*ngrams("bbb aa")).tolist() == [packed(g) for g, _ in sorted(plain_ngrams("bbb aa").items(), key=lambda p: (-p[1], packed(p[0])))]
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(none, entries=300)
