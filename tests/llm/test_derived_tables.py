"""Tables made by steps that multiply rows, reruns on other partitionings, bounds of memory, short secrets."""

import random
import string
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers as pt  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from graphjobs.llm import common, exact_dedup, line_dedup, mixing, quality, secrets, token_files  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = [
    "first line of its own here\na line that all documents share word for word",
    "another start\na line that all documents share word for word",
    "a line that all documents share word for word\nthird beta text",
    "the fourth document says something else\nand ends with this",
]


def derived(spark, kind):
    """The four documents, made in several ways; the doubled file has each twice."""
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    if kind == "exploded":  # four documents from two rows of a file
        pairs = common.materialise(spark.createDataFrame([(0, TEXTS[:2]), (2, TEXTS[2:])], "base bigint, texts array<string>").coalesce(1), "pairs")
        each = pairs.select("base", F.posexplode("texts").alias("at", "text"))
        return each.select((F.col("base") + F.col("at")).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    files = common.materialise(spark.createDataFrame(rows, DOCS).coalesce(1), "files")
    if kind == "join":
        one = common.materialise(spark.createDataFrame([("en",)], "lang string"), "one")
        return files.join(one, "lang").select(*files.columns)
    if kind == "joined copies":  # every document twice
        return files.join(spark.range(2).withColumnRenamed("id", "turn")).drop("turn")
    path = files.inputFiles()[0]
    return spark.read.parquet(path, path)


KINDS = ["exploded", "join", "joined copies", "doubled file"]


@pytest.mark.parametrize("kind", KINDS)
def test_no_line_is_lost_on_derived_tables(spark, kind):
    docs = derived(spark, kind)
    lines = Counter(line for r in line_dedup.dedup_lines(docs).collect() for line in r.text.split("\n") if line)
    assert lines == Counter({line: 1 for t in TEXTS for line in t.split("\n")})
    report = line_dedup.line_report(docs).collect()
    assert len(report) == docs.count() and sum(r.n_lines - r.n_dropped for r in report) == len(lines)


@pytest.mark.parametrize("kind", ["exploded", "doubled file"])
def test_stages_on_derived_tables(spark, kind):
    import corpus_pipeline as p

    docs, stages, d = derived(spark, kind), dict(p.STAGES), "/root/testdata/sf0.001"
    n = docs.count()
    cleaned = stages["line dedup"](spark, docs, d).collect()
    assert Counter(line for r in cleaned for line in r.text.split("\n") if line) == Counter({line: 1 for t in TEXTS for line in t.split("\n")})
    assert sorted(r.text for r in stages["n-gram Jaccard join"](spark, docs, d).collect()) == sorted(TEXTS)
    mixed = Counter(r.text for r in stages["mixing sources to target weights"](spark, docs, d).collect())
    assert mixed == Counter({t: n // 4 for t in TEXTS})  # one source takes what it has
    coded = stages["SentencePiece encoding and decoding"](spark, docs, d)
    assert coded.count() == n and coded.where("parity").count() == n


def test_mixing_reruns_agree_on_any_partitioning(spark):
    r = random.Random(1)
    def odd_id(k):
        return None if k % 3 == 0 else r.randrange(3) if k % 3 == 1 else k

    rows = [(odd_id(k), " ".join("w" * r.randint(1, 4) for _ in range(r.randint(0, 40))), r.choice(["a", "b", "c", None])) for k in range(2000)]
    rows += [(None, "the same text", "a")] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    def result(parts):
        return Counter(tuple(x) for x in mixing.mix(df.repartition(parts, F.rand(parts))).collect())

    first = result(1)
    assert sum(first.values()) == 2050 and result(7) == first and result(3) == first
    # documents under no id are told apart by their texts
    draws = df.where("doc_id IS NULL").select(mixing.uniform(5, F.col("doc_id"), F.col("text")).alias("u")).distinct().count()
    assert draws > 500


def test_quality_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    rows = [(k % 40, f"text number {n} with {k} words of its own" * (1 + n % 3)) for k in range(40) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(k, 0) for k in range(40)], "doc_id bigint, quality int")
    seen = []
    fit = quality.Trees.fit
    monkeypatch.setattr(quality.Trees, "fit", lambda self, x, y: seen.append(len(y)) or fit(self, x, y))
    trained = sum(quality.crc_fold(k) != 0 for k in range(40))
    quality.fit_quality(docs, labels)
    quality.fit_quality(docs, labels, sample=10)
    assert seen == [trained, 10]


def test_exact_dedup_holds_a_window_of_whole_texts(monkeypatch):
    """Texts with one long beginning are short labels in a trie, and still whole where they wait."""
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(exact_dedup, "TaskContext", Context)
    monkeypatch.setattr(exact_dedup, "WINDOW", 1 << 20)
    texts = ["same beginning " * 20_000 + str(k) for k in range(12)]  # 300 KB each
    batches = (pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t.encode()], pa.binary())], ["doc_id", "text"]) for k, t in enumerate(texts))
    out = [b.num_rows for b in exact_dedup._windows(batches)]
    assert sum(out) == 12 and max(out) <= 4


def test_token_files_have_a_task_each_and_null_ids_are_cut(spark):
    rows = [(None if k % 2 else k, f"text {k} of words") for k in range(3000)] + [(7, f"copy {k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        manifest = token_files.write_token_files(docs, pt.path("word_bpe_49k.json"), 1)
        files = manifest.orderBy("start").collect()
        assert len(files) == 20 and max(f.documents for f in files) < 600
        read = token_files.read_token_files(manifest)
        tasks = read.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
        assert sorted(t.n for t in tasks) == sorted(f.documents for f in files)
        ids = [r.doc_id for r in read.orderBy("start").collect()]
        assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_short_secrets():
    ranks, r = pt.path("byte_bpe_50k.tiktoken"), random.Random(3)
    for n, least in ((12, 0.7), (14, 0.75), (16, 0.8), (19, 0.85)):
        for alphabet in (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits):
            keys = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(200)]
            found = sum(secrets.random_spans(f"see {k} there", [], ranks) == [(4, 4 + n, "random")] for k in keys)
            assert found >= least * 200, (n, len(alphabet), found)
    for plain in ("sha256sum2024", "version10beta", "2024-01-15T10", "user12345678", "x86_64-linux-gnu", "item-00012345", "constitutional", "thnttionanereat", "123456789012345"):
        assert secrets.random_spans(f"see {plain} there", [], ranks) == []
