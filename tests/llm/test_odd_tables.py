"""Nulls, repeated rows and ids, long texts and clashing column names, in every operator and stage."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers as pt  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from graphjobs.llm import common, exact_dedup, imi, line_dedup, mixing, ngram_join, quality, secrets, sentencepiece_job, token_files, url_filter  # noqa: E402

#: Names that operators and stages use inside.
CLASHES = (
    "row", "at", "copies", "copy", "taken_id", "had_text", "filled", "gone_row", "gone_pos", "gone_id", "row_of_id", "score", "predicted", "quality_score",
    "quality_predicted", "h", "n", "norm", "place", "size", "key", "slice", "part", "grp", "head", "component", "ids", "token", "spans", "c", "i", "j", "k",
)


def long_text():
    rng = np.random.default_rng(3)
    return " ".join(f"long{int(i)}" for i in rng.integers(0, 10**6, 30_000))


def odd(spark):
    """Rows of documents, with null and repeated ids and texts, and every clashing column."""
    shared = "one two three four five six seven eight nine ten"
    rows = [
        (1, shared), (1, "an unrelated second text under the same number here"), (2, shared), (None, shared), (None, None), (3, None), (4, ""), (5, " \t\n"),
        (7, "first of seven identical rows in this table"), (7, "first of seven identical rows in this table"), (8, long_text()), (9, "plain"),
    ]
    df = spark.createDataFrame([(i, t, "en", ("a", None)[k % 2], 0) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return rows, df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


def untouched(rows):
    return all(r[c] == f"mine {c}" for r in rows for c in CLASHES)


def test_stages(spark):
    import corpus_pipeline as p

    rows, df = odd(spark)
    stages = dict(p.STAGES)
    d = "/root/testdata/sf0.001"
    kept = stages["quality classifier"](spark, df, d)
    assert kept.columns == df.columns and untouched(kept.collect())
    lines = stages["line dedup"](spark, df, d).collect()
    assert untouched(lines)
    # a shared line stays in the row of the least doc_id; rows that had no words stay as they are
    texts = [r.text for r in lines if r.text and r.text.strip()]
    assert sorted(texts) == sorted({t for _, t in rows if t and t.strip()})
    assert sum(r.text is None for r in lines) == 2 and all(r.doc_id == 1 for r in lines if r.text == rows[0][1])
    near = stages["n-gram Jaccard join"](spark, df, d).collect()
    assert untouched(near)
    assert sorted(r.text for r in near if r.text and r.text.strip()) == sorted({t for _, t in rows if t and t.strip()})
    assert sum(not (r.text or "").strip() for r in near) == 4 and {r.doc_id for r in near if r.text == rows[0][1]} == {1}
    mixed = stages["mixing sources to target weights"](spark, df, d).collect()
    assert untouched(mixed)
    total = sum(len((t or "").split()) for _, t in rows)
    assert abs(sum(len((r.text or "").split()) for r in mixed) - total) <= 30_000
    assert all(sum(r.text == t for r in mixed) <= 3 * sum(u == t for _, u in rows) for _, t in rows if t)
    coded = stages["SentencePiece encoding and decoding"](spark, df, d)
    assert coded.count() == len(rows) and coded.where("parity").count() == len(rows)


def test_operators_on_documents(spark):
    rows, df = odd(spark)
    n = len(rows)
    exact = exact_dedup.exact_classes(df).collect()
    assert len(exact) == n and sum(r.kept for r in exact) == len({" ".join((t or "").split()) if (t or "").strip() else (t and " ") or "" for _, t in rows})
    report = line_dedup.line_report(df).collect()
    assert len(report) == n and sum(r.n_dropped for r in report) == 3
    assert untouched(line_dedup.dedup_lines(df).collect())
    joined = ngram_join.ngram_jaccard_classes(df).collect()
    assert len(joined) == n and {r.component_id for r in joined if r.doc_id in (1, 2)} == {1}
    found = secrets.scan(df, pt.path("byte_bpe_50k.tiktoken")).collect()
    assert len(found) == n
    manifest = token_files.write_token_files(df, pt.path("word_bpe_49k.json"), 1)
    read = token_files.read_token_files(manifest)
    ids = [r.doc_id for r in read.orderBy("start").collect()]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert read.rdd.getNumPartitions() == manifest.count() or manifest.count() == 0
    mixed = mixing.mix(df).collect()
    assert len(mixed) == n and all(r.taken <= 3 * r.size for r in mixed)
    trees = quality.Trees().fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    scored = quality.score_quality(df, trees, names=("s", "p")).collect()
    assert len(scored) == n and untouched(scored) and all(r.s == 0.5 for r in scored)
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int")
    named = df.withColumn("doc_id", F.lit("a"))
    quality.fit_quality(named, labels)  # ids of any type
    coded = sentencepiece_job.encode_documents(df, pt.path("piece_bpe_32k.model"), decode=True).collect()
    assert len(coded) == n and all(r.parity for r in coded)
    empty = df.limit(0)
    assert secrets.scan(empty, pt.path("byte_bpe_50k.tiktoken")).count() == 0


def test_vectors_of_every_length(spark):
    """Vectors of a rare length, and under no id, link too; lengths don't mix."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    near = [1.0, 0.1, 0.0], [1.0, 0.0, 0.0]
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), (100, near[0]), (101, near[1]), (None, (x[3] * 1.0001 + 0.001).tolist()), (None, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame([(i, v, "mine") for i, v in rows], "vec_id bigint, embedding array<double>, head string")
    got = imi.embedding_classes(df).collect()
    vectors = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = [[a is not b and len(a) == len(b) and a @ b >= 0.9 for b in vectors] for a in vectors]
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            assert by_id[i].n_links == sum(links[k]), i
            reach, todo = {k}, [k]
            while todo:
                todo = [b for a in todo for b in range(len(rows)) if links[a][b] and b not in reach and not reach.add(b)]
            assert by_id[i].component_id == min(rows[b][0] for b in reach if rows[b][0] is not None)
    assert sorted(r.n_links for r in got if r.vec_id is None) == sorted(sum(links[k]) for k in (42, 43))
    assert all(r.component_id is None for r in got if r.vec_id is None)


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/x", None), (1, "http://a.net/es/x", "<p>"), (None, None, None), (2, "http://b.org/" + "y" * 100_000, "z" * 1_000_000)], "page_id bigint, url string, html string")
    df = df.withColumns({c: F.lit("mine") for c in ("host", "path", "node", "decision", "component", "blocked", "target")})
    got = url_filter.judge_pages(df, list(url_filter.RULES)).collect()
    assert sorted(r.verdict for r in got) == ["allow", "allow", "block", "block"] and len(got) == 4


def test_inclusion_follows_size(spark):
    """Documents enter the rest of a source in proportion to the digits of their sizes, near enough."""
    sizes = [1, 3, 7, 15, 31, 63] * 400
    df = spark.createDataFrame([(i, "w " * n, "ab"[i // 6 % 2]) for i, n in enumerate(sizes)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    taken = {}
    for seed in (1, 2):
        for r in mixing.mix(df, weights, seed=seed).where("copies < 3").collect():
            if r.target < r.source_size:
                taken.setdefault(r["size"], []).append(r.copies)
    share = [np.mean(taken[n]) for n in sorted(taken)]
    assert share[-1] > 2.5 * share[0] and all(b > a - 0.08 for a, b in zip(share, share[1:])), share


def test_words_that_depend_on_others(tmp_path):
    import json

    spec = json.load(open(pt.path("word_bpe_49k.json"), encoding="utf-8"))
    assert token_files.splits_at_space(pt.path("word_bpe_49k.json"))
    for change in (
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
        {"pre_tokenizer": None},
        {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": " ?[a-z]+"}, "behavior": "Removed", "invert": True}},
        {"normalizer": {"type": "Prepend", "prepend": "x"}},
    ):
        small = {k: v for k, v in {**spec, **change}.items() if k != "model"}
        path = tmp_path / "t.json"
        path.write_text(json.dumps(small))
        assert not token_files.splits_at_space(str(path)), change


def test_shared_folder_is_asked_for():
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)
