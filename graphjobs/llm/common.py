"""Shared pieces: tables in the cluster's shared folder, connected components, pair blocks, and
streaming over key-sorted Arrow batches. Everything here keeps memory bounded by a block."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir

#: ASCII white space as the contracts write it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Written(threading.local):
    """Paths of the tables that a thread's materialise wrote, in order."""

    def __init__(self):
        self.paths: list[str] = []


written = _Written()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write as a table in the shared folder and read it back: cuts lineage, survives lost
    executors, and gives the optimiser true sizes, so that it broadcasts only what is small.
    The table stays while the application may read it; ``drop_tables`` removes it. Spark deletes the shuffle files of the
    write as soon as it ends, not when the driver happens to collect its garbage."""
    conf, path = df.sparkSession.conf, new_path(df.sparkSession, name)
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    written.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise wrote and nothing reads any more, and have Spark's cleaner drop the
    shuffle files of finished jobs, which it does when the driver collects its garbage."""
    for t in tables:
        drop_tables(t.sparkSession, sorted({f.rpartition("/")[0] for f in t.inputFiles()}))
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def bounded_batches(spark: SparkSession, most: int = 64 << 20) -> None:
    """Has the session hand rows to Python in Arrow batches of at most so many bytes, as rows are whole texts; a smaller
    bound, such as Spark's own, stays. ``parts`` cuts a batch further where it is worked on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > most:
        spark.conf.set(key, most)


def parts(batch: pa.RecordBatch, column: int, rows: int = 500, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many rows, and of about so many bytes in a text column."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.column(column).slice(at, n).nbytes > most:
            n = max(1, n // 2)
        yield batch.slice(at, n)
        at += n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made unlike any column of df whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs, written with a long that tells rows apart. Rows are told apart however docs were made: by steps that multiply
    them, from a file that is read twice, or from no file. A row's number is the same in every pass that reads this table."""
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each is a grouped minimum
    with map-side combine, and a join that adaptive execution can split at hub nodes. Edges with a
    null end and self loops count for nothing. No edges: no rows."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e, before = materialise(e.distinct(), "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).union(e.select("v", "u"))
        least = both.groupBy("n").agg(F.least(F.min("x"), F.first("n")).alias("m"))
        large = both.join(least, "n").where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), "m")
        old, e = e, materialise(moved.union(parent.select("u", "m")).distinct().select("u", F.col("m").alias("v")), "edges")
        drop_tables(e.sparkSession, sorted({f.rpartition("/")[0] for f in old.inputFiles()}))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def pair_blocks(df: DataFrame, member: Column, count: str, chunk: int) -> DataFrame:
    """Adds (i, j, c): a group of ``count`` rows is dealt into chunks c of about ``chunk`` rows, and
    block (i, j) gets chunks i and j. Comparing c = i with c = j in each block compares every pair of
    the group once in blocks of bounded size, however large the group."""
    n = F.ceil(F.col(count) / chunk).cast("int")
    return (
        df.withColumn("c", F.pmod(F.xxhash64(member), n).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("i", F.least("c", "o"))
        .withColumn("j", F.greatest("c", "o"))
        .drop("o")
    )


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by keys, one table each."""
    import numpy as np

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            x = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            new[0] |= bool(rest) and rest[-1].column(batch.schema.get_field_index(k))[-1].as_py() != x[0]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi and lo:
                continue
            if rest and (lo > 0 or lo == hi):
                yield pa.Table.from_batches(rest)
                rest = []
            if hi > lo:
                rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield pa.Table.from_batches(rest)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """A stream sorted by keys in tables of about so many rows, more only where a group is larger; none cuts a group."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    most = rows
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) < most:
            continue
        t = pa.Table.from_batches(held)
        last = np.ones(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            last &= x == x[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        most = rows if cut else 2 * t.num_rows  # so that a large group is not looked through for every batch
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over the ordinals of one block; roots are the smallest ordinals."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
