"""Readers with declared schemas, the buffer writer, the result cache and the label check."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import is_written

EDGES = "src bigint, dst bigint, weight double"


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(src, dst, weight) from parquet, csv with a header, or JSON lines; a missing weight is 1."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {fmt}")
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        named = spark.read.option("header", True).csv(path).columns if fmt == "csv" else None
        kinds = {"src": "bigint", "dst": "bigint", "weight": "double"}
        schema = EDGES if named is None else ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in named)
        df = reader.schema(schema).format(fmt).load(path)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    return df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))


def read_roles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(node, role) from JSON objects of id lists, tr, va and te, one a file, or, at scale, from JSON lines of (node, role)."""
    if lines:
        return spark.read.schema("node bigint, role string").json(path)
    df = spark.read.schema("tr array<bigint>, va array<bigint>, te array<bigint>").json(path, multiLine=True)
    parts = [df.select(F.explode(r).alias("node"), F.lit(r).alias("role")) for r in ("tr", "va", "te")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(node, features array<float>); fails if lengths differ."""
    df = spark.read.parquet(path).select(F.col("node").cast("long").alias("node"), F.col("features").cast("array<float>").alias("features"))
    span = df.agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi")).first()
    if span.lo != span.hi:
        raise ValueError(f"feature rows have {span.lo} to {span.hi} dimensions")
    return df


def read_class_map(spark: SparkSession, path: str, multi: bool = False, lines: bool = False) -> DataFrame:
    """(node, label int) or (node, labels array<int>): one JSON object with ids as keys, or, at scale,
    JSON lines of (node, label or labels)."""
    kind, name = ("array<int>", "labels") if multi else ("int", "label")
    if lines:
        return spark.read.schema(f"node bigint, {name} {kind}").json(path)
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias("k", name))
    return pairs.select(F.col("k").cast("long").alias("node"), name)


def read_index_file(spark: SparkSession, path: str) -> DataFrame:
    """(id): one whole number per line; a bad line fails."""
    return spark.read.text(path).select(F.trim("value").cast("long").alias("id"))


def save_or_load(make: Callable[[], DataFrame], spark: SparkSession, folder: str, params: dict) -> DataFrame:
    """The result stored under these parameters; made and written if there is none."""
    key = hashlib.sha256(repr(sorted(params.items())).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{key}"
    if not is_written(spark, path):
        make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def label_coverage(n: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: missing, the nodes without a label, and extra, the labels without a node."""
    a = n.select("node").distinct().withColumn("known", F.lit(True))
    b = labels.select("node").distinct().withColumn("labelled", F.lit(True))
    return a.join(b, "node", "full_outer").agg(F.count_if(F.col("labelled").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("extra"))


def check_label_coverage(n: DataFrame, labels: DataFrame) -> None:
    """Fails with counts unless labels cover the nodes exactly."""
    missing, extra = label_coverage(n, labels).first()
    if missing or extra:
        raise ValueError(f"{missing} nodes without a label, {extra} labels without a node")


def write_buffers(buffer: DataFrame, features: DataFrame, path: str) -> None:
    """Feature rows of cached nodes, one folder per worker, in slot order within files that follow
    each other in slot ranges."""
    rows = buffer.join(features, "node")
    rows.repartitionByRange("device", "slot").sortWithinPartitions("device", "slot").write.partitionBy("device").parquet(path)
