"""Readers on files written here, the cache and the buffer writer."""

import json

import pytest

from graphjobs.sources import readers as S


def test_readers(spark, tmp_path):
    (tmp_path / "roles.json").write_text(json.dumps({"tr": [1, 2], "va": [3], "te": []}))
    assert {(r.node, r.role) for r in S.read_roles(spark, str(tmp_path / "roles.json")).collect()} == {(1, "tr"), (2, "tr"), (3, "va")}
    (tmp_path / "map.json").write_text(json.dumps({"0": 4, "7": 2}))
    assert {(r.node, r.label) for r in S.read_class_map(spark, str(tmp_path / "map.json")).collect()} == {(0, 4), (7, 2)}
    (tmp_path / "multi.json").write_text(json.dumps({"0": [1, 0]}))
    assert S.read_class_map(spark, str(tmp_path / "multi.json"), multi=True).first().labels == [1, 0]
    (tmp_path / "ids.txt").write_text(" 3\n5 \n")
    assert [r.id for r in S.read_index_file(spark, str(tmp_path / "ids.txt")).collect()] == [3, 5]
    (tmp_path / "bad.txt").write_text("3\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.read_index_file(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "e.csv").write_text("src,dst\n1,2\n")
    r = S.read_edges(spark, str(tmp_path / "e.csv"), "csv").first()
    assert (r.src, r.dst, r.weight) == (1, 2, 1.0)


def test_features_must_have_one_length(spark, tmp_path):
    spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "node bigint, features array<double>").write.parquet(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="dimensions"):
        S.read_features(spark, str(tmp_path / "f"))


def test_cache_makes_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.save_or_load(make, spark, str(tmp_path / "c"), {"k": 3, "alpha": 0.5}).count() == 3
    assert len(made) == 1


def test_label_coverage(spark):
    n = spark.createDataFrame([(0,), (1,)], "node bigint")
    S.check_label_coverage(n, n)
    with pytest.raises(ValueError, match="1 nodes without"):
        S.check_label_coverage(n, n.where("node = 0"))


def test_buffers_are_written_in_slot_order(spark, tmp_path):
    b = spark.createDataFrame([(d, s, 10 * d + s) for d in range(2) for s in range(5)], "device int, slot int, node bigint")
    f = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "node bigint, features array<float>")
    S.write_buffers(b, f, str(tmp_path / "b"))
    for d in range(2):
        files = sorted((tmp_path / "b" / f"device={d}").glob("*.parquet"))
        slots = [r.slot for p in files for r in spark.read.parquet(str(p)).collect()]
        assert slots == list(range(5))
