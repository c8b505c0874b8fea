"""Statistics of columns and vectors, feature scaling and label encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import lists, matrix, segment_vector_sum

SALT = 16
#: Tasks that merge partial moments before the last one.
GROUPS = 32


def mean_std(df: DataFrame, col: str) -> DataFrame:
    """One row: mean and population standard deviation."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))


def zscore(df: DataFrame, col: str, name: str = "z") -> DataFrame:
    """(x - mean) / population std; null where the column doesn't vary."""
    one = F.broadcast(mean_std(df, col))  # one row
    return df.join(one).withColumn(name, F.when(F.col("std") != 0, (F.col(col) - F.col("mean")) / F.col("std"))).drop("mean", "std")


def skew_ratio(df: DataFrame, key: str) -> DataFrame:
    """Largest over mean number of rows per key."""
    k = df.groupBy(key).count()
    return k.agg((F.count("*") * F.max("count") / F.sum("count")).alias("skew_ratio"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task's vectors: their number n, mean and m2, the sum of squared distances from the mean."""
    kept: tuple | None = None
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(0))
            mean = x.mean(0)
            kept = _merged(kept, (len(x), mean, ((x - mean) ** 2).sum(0)))
    if kept:
        yield _as_row(kept)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of moments as one."""
    kept: tuple | None = None
    for batch in batches:
        if batch.num_rows:
            for n, mean, m2 in zip(batch["n"].to_pylist(), matrix(batch["mean"]), matrix(batch["m2"])):
                kept = _merged(kept, (n, mean, m2))
    if kept:
        yield _as_row(kept)


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Two parts' moments as those of the whole (Chan, Golub and LeVeque 1979)."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)


def _as_row(kept: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kept[0]], pa.int64()), lists(kept[1][None]), lists(kept[2][None])], ["n", "mean", "m2"])


MOMENTS = "n long, mean array<double>, m2 array<double>"


def vector_moments(df: DataFrame, vec: str) -> DataFrame:
    """At most one row (n, mean, m2) of equal-length vectors: a task hands on one row for all that it reads, and ``GROUPS``
    tasks merge those before the last one does. No value is exploded, and no pass subtracts large sums."""
    partial = df.where(F.col(vec).isNotNull()).select(vec).mapInArrow(_moments, MOMENTS)
    return partial.repartition(GROUPS).mapInArrow(_merge, MOMENTS).repartition(1).mapInArrow(_merge, MOMENTS)


def standard_scale(features: DataFrame, roles: DataFrame, vec: str = "features") -> DataFrame:
    """Each dimension by the mean and population std of the train nodes; a std of 0 divides by 1. The moments are one row.
    Without train nodes all vectors are null."""
    train = features.join(roles.where("role = 'tr'").select("node"), "node", "left_semi")
    spread = F.transform("m2", lambda q: F.when(q == 0, 1.0).otherwise(F.sqrt(q / F.col("n"))))
    fitted = vector_moments(train, vec).select(F.col("mean").alias("_mean"), spread.alias("_std"))
    x = F.zip_with(F.zip_with(F.col(vec), F.col("_mean"), lambda v, m: v.cast("double") - m), F.col("_std"), lambda v, s: v / s)
    return features.join(F.broadcast(fitted), F.lit(True), "left").withColumn(vec, x).drop("_mean", "_std")


def _known(label: str):
    return F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))


def num_classes(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: largest - smallest + 1 over known labels; for list labels their length."""
    if labels.schema[label].dataType.typeName() == "array":
        return labels.agg(F.max(F.size(label)).cast("long").alias("num_classes"))
    return labels.where(_known(label)).agg((F.max(label) - F.min(label) + 1).cast("long").alias("num_classes"))


def one_hot(labels: DataFrame, label: str = "label") -> DataFrame:
    """(node, one_hot): class number minus the smallest as a 0/1 array; gaps keep their place."""
    span = labels.where(_known(label)).agg(F.min(label).cast("long").alias("_lo"), (F.max(label) - F.min(label)).cast("long").alias("_top"))
    at = F.col(label).cast("long") - F.col("_lo")
    hot = F.transform(F.sequence(F.lit(0).cast("long"), "_top"), lambda i: (i == at).cast("int"))
    return labels.join(F.broadcast(span)).select("node", hot.alias("one_hot"))


def multi_hot(labels: DataFrame, label: str = "labels") -> DataFrame:
    """Sparse rows (node, class_idx) of list labels that aren't 0."""
    return labels.select("node", F.posexplode(label).alias("class_idx", "v")).where("v <> 0").select("node", "class_idx")


def one_hot_with_missing(n: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Every node has a row; null and NaN labels, and nodes without one, give zeros only."""
    span = labels.where(_known(label)).agg(F.min(label).cast("long").alias("_lo"), (F.max(label) - F.min(label)).cast("long").alias("_top"))
    at = F.when(_known(label), F.col(label).cast("long") - F.col("_lo"))
    hot = F.transform(F.sequence(F.lit(0).cast("long"), "_top"), lambda i: F.coalesce(i == at, F.lit(False)).cast("int"))
    return n.select("node").join(labels, "node", "left").join(F.broadcast(span)).select("node", hot.alias("one_hot"))


def gather(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of listed ids(pos, node), with their positions and repeats."""
    return ids.join(features, "node")


def vector_sum(df: DataFrame, key: str, vec: str, salt: int = SALT) -> DataFrame:
    """Element-wise sum of equal-length vectors per key, in two stages, as few keys may hold most rows."""
    return _summed(df, key, vec, salt).select(key, F.col("x").alias(vec))


def vector_mean(df: DataFrame, key: str, vec: str, salt: int = SALT) -> DataFrame:
    """Element-wise mean of equal-length vectors per key: their sum with a one behind each, by its last element."""
    counted = df.select(key, F.concat(F.col(vec).cast("array<double>"), F.array(F.lit(1.0))).alias(vec))
    n = F.element_at("x", -1)
    return _summed(counted, key, vec, salt).select(key, F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda v: v / n).alias(vec))


def _summed(df: DataFrame, key: str, vec: str, salt: int) -> DataFrame:
    return segment_vector_sum(df.where(F.col(vec).isNotNull()).select(key, F.lit(1.0).alias("_one"), vec), [key], "_one", vec, salt)


def clip_by_global_norm(df: DataFrame, vec: str, max_norm: float = 5.0) -> DataFrame:
    """All vectors scaled by min(1, max / (norm + 1e-6)) of their joint L2 norm."""
    square = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    scale = df.agg(F.least(F.lit(1.0), F.lit(max_norm) / (F.sqrt(F.coalesce(F.sum(square), F.lit(0.0))) + F.lit(1e-6))).alias("_scale"))
    return df.join(F.broadcast(scale)).withColumn(vec, F.transform(vec, lambda x: x.cast("double") * F.col("_scale"))).drop("_scale")
