"""Where queries register, and what several of them use."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from ..operators import graph as G
from ..operators import placement as P
from ..operators import propagate as N
from ..operators import sampling as M
from . import fixtures as X

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, d); sql continues the fixtures' common tables."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = X.SQL + ("" if sql.lstrip().startswith(",") else " ") + sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def scores(s, d, k: int = 3, e: DataFrame | None = None) -> DataFrame:
    """Access scores over the graph e, by default made anew."""
    return N.access_score(G.row_normalize(X.g_next(s, d) if e is None else e), X.train(s, d), k)


def spread(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("i", "v")).withColumn("v", F.round("v", 6))


def whole() -> Column:
    """A number that every dimension of the features and its place count in."""
    weighed = F.transform("features", lambda v, i: v.cast("double") * (i + 1))
    return F.round(F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v), 4).alias("whole")


def rows(s, d) -> int:
    return P.buffer_rows(X.nodes(s, d), X.RATIO)


def snake(s, d, e: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return P.place_hot_replicated(scores(s, d, e=e), X.DEVICES, rows(s, d), 0.5, "snake")


def batches(s, d) -> DataFrame:
    return M.make_train_batches(X.train(s, d).withColumn("pos", F.col("node")), X.DEVICES, X.BATCH, X.SEED)


def written(s, df: DataFrame, fmt: str, **options) -> str:
    """df in a reader's format, in a folder of its own."""
    path = f"{shared_dir(s)}/source-{uuid.uuid4().hex}"
    df.write.format(fmt).options(header=True, **options).save(path)
    return path
