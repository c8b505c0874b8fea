"""Layer-wise samples and the jobs on them, with SQL of any number of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialise, new_path
from ..operators import sampling as M
from . import fixtures as X
from . import workloads as W
from .register import batches, query, rounded, snake

SIZE, DEEP = 128, 256


def layer_sql(n: str, frontier: str, layer: int, k: int, favoured: str = "") -> str:
    """Common tables of a draw from a frontier (batch_id, node): imp, prob, s, drawn, every and pos, named with n behind.
    favoured(rank, node): importance is 4 times as much there, by the batch's rank."""
    factor = f" * CASE WHEN (any_value(rank), dst) IN (SELECT (rank, node) FROM {favoured}) THEN 4.0 ELSE 1.0 END" if favoured else ""
    ranked = f"(SELECT f.batch_id, f.node, r.rank FROM {frontier} f JOIN ranks r USING (batch_id))" if favoured else f"{frontier}"
    return f"""
front{n} AS MATERIALIZED (SELECT batch_id, node, row_number() OVER (PARTITION BY batch_id ORDER BY node) - 1 AS pos FROM {frontier}),
imp{n} AS MATERIALIZED (SELECT batch_id, dst AS node, count(*)::DOUBLE{factor} AS imp FROM {ranked} f JOIN e ON src = f.node GROUP BY batch_id, dst),
prob{n} AS MATERIALIZED (SELECT batch_id, node, imp / sum(imp) OVER (PARTITION BY batch_id) AS p FROM imp{n}),
s{n} AS (SELECT batch_id, least(count(*) FILTER (p > 0), {k}) AS s FROM prob{n} GROUP BY batch_id),
drawn{n} AS MATERIALIZED (
  SELECT batch_id, node FROM prob{n} WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY round(-ln((('0x' || substr(md5('7|' || batch_id || '|{layer}|' || node), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / p, 9), node) <= {k}),
every{n} AS MATERIALIZED (SELECT batch_id, node FROM drawn{n} UNION SELECT batch_id, node FROM {frontier}),
pos{n} AS MATERIALIZED (
  SELECT v.batch_id, v.node, row_number() OVER (PARTITION BY v.batch_id ORDER BY v.node) - 1 AS pos, f.node IS NOT NULL AS is_prev, coalesce(p, 0) AS prob,
    CASE WHEN p IS NULL THEN 1e10 ELSE 1.0 / least(greatest(s * p, 1e-10), 1) END AS factor
  FROM every{n} v LEFT JOIN front{n} f ON f.batch_id = v.batch_id AND f.node = v.node LEFT JOIN prob{n} p ON p.batch_id = v.batch_id AND p.node = v.node LEFT JOIN s{n} ON s{n}.batch_id = v.batch_id)"""


def block_sql(layer: int, rows: str, cols: str) -> str:
    return f"SELECT f.batch_id, e.src, e.dst, f.pos AS src_pos, k.pos AS dst_pos, k.factor / entries AS value, {layer} AS layer FROM {rows} f JOIN e ON e.src = f.node JOIN {cols} k ON k.batch_id = f.batch_id AND k.node = e.dst JOIN deg ON deg.src = e.src"


_DEG = ", deg AS MATERIALIZED (SELECT src, count(*) AS entries FROM e GROUP BY src), ranks AS (SELECT DISTINCT batch_id, rank FROM batches)"
_ROUNDED = "SELECT * REPLACE (round(value + 1e-10, 6) AS value) FROM ({})"
_ONE = _DEG + "," + layer_sql("", "batches", 0, SIZE) + " "


def edges(s, d) -> DataFrame:
    """The graph, made once: every layer reads it several times."""
    return materialise(X.g_next(s, d), "edges")


def _valued(df: DataFrame) -> DataFrame:
    """Values are fractions of small numbers, some of which end just between two rounded ones; engines' last bits differ there."""
    return df.withColumn("value", F.round(F.col("value") + 1e-10, 6))


def _probabilities(s, d) -> DataFrame:
    return materialise(M.to_probability(M.layer_importance(X.g_next(s, d), batches(s, d))), "probabilities")


query("m4_weighted_sample", _ONE + "SELECT * FROM drawn")(lambda s, d: M.weighted_sample_without_replacement(_probabilities(s, d), SIZE, X.SEED).select("batch_id", "node"))
query("m4_weighted_sample_8192", _DEG + "," + layer_sql("", "batches", 0, 8192) + " SELECT * FROM drawn")(
    lambda s, d: M.weighted_sample_without_replacement(_probabilities(s, d), 8192, X.SEED).select("batch_id", "node")
)
query("m5_sampled_layer", _ONE + _ROUNDED.format(f"SELECT * EXCLUDE (layer) FROM ({block_sql(0, 'front', 'pos')})"))(lambda s, d: _valued(M.sampled_layer(edges(s, d), batches(s, d), SIZE, X.SEED, 0)[0]))
query("m5_sampled_layer_nodes", _ONE + "SELECT batch_id, node, pos, is_prev, round(prob, 9) AS prob FROM pos")(lambda s, d: rounded(M.sampled_layer(edges(s, d), batches(s, d), SIZE, X.SEED, 0)[1], "prob", places=9))
_TWO = _DEG + "," + layer_sql("a", "batches", 2, SIZE) + "," + layer_sql("b", "everya", 0, SIZE) + " "
_BOTH = _TWO + _ROUNDED.format(block_sql(2, "fronta", "posa") + " UNION ALL " + block_sql(0, "frontb", "posb"))
query("m6_layerwise_sample", _BOTH)(lambda s, d: _valued(M.layerwise_sample(edges(s, d), batches(s, d), [SIZE] * 3, [1, 0, 1], X.SEED)[0]))


def waves(s, d) -> tuple[DataFrame, DataFrame]:
    return M.sample_in_waves(edges(s, d), materialise(batches(s, d), "batches"), new_path(s, "epoch"), 2, [SIZE] * 3, [1, 0, 1], X.SEED)


query("m6_sample_in_waves", _BOTH)(lambda s, d: _valued(waves(s, d)[0].drop("wave")))
query("m6_sample_in_waves_nodes", _TWO + "SELECT batch_id, node, pos, is_prev, round(prob, 9) AS prob, 2 AS layer, batch_id % 2 AS wave FROM posa UNION ALL SELECT batch_id, node, pos, is_prev, round(prob, 9), 0, batch_id % 2 FROM posb")(
    lambda s, d: rounded(waves(s, d)[1], "prob", places=9).withColumn("wave", F.col("wave").cast("long"))
)
_SUB = _DEG + "," + layer_sql("", "batches", 1, SIZE) + " "
query("m7_subgraph_sample", _SUB + _ROUNDED.format(block_sql(1, "front", "pos") + " UNION ALL " + block_sql(0, "pos", "pos")))(
    lambda s, d: _valued(M.subgraph_sample(edges(s, d), batches(s, d), SIZE, [1, 1], X.SEED)[0])
)
query("m7_subgraph_sample_nodes", _SUB + "SELECT batch_id, node, pos, is_prev, round(prob, 9) AS prob, 1 AS layer FROM pos UNION ALL SELECT batch_id, node, pos, true, round(prob, 9), 0 FROM pos")(
    lambda s, d: rounded(M.subgraph_sample(edges(s, d), batches(s, d), SIZE, [1, 1], X.SEED)[1], "prob", places=9)
)
query("m11_batch_inputs", _TWO + "SELECT batch_id, count(*) AS n FROM everyb GROUP BY batch_id")(
    lambda s, d: M.batch_inputs(M.layerwise_sample(edges(s, d), batches(s, d), [SIZE] * 3, [1, 0, 1], X.SEED)[1]).groupBy("batch_id").agg(F.count("*").alias("n"))
)

# whole jobs
_REPORT = " SELECT b.batch_id, b.rank, count(*) FILTER (holder = b.rank) AS local, count(*) FILTER (holder <> b.rank) AS remote, count(*) FILTER (holder IS NULL) AS host, count(*) AS total, round(count(*) FILTER (holder = b.rank) / count(*), 6) AS hit_ratio, count(*) * 64 * 4 AS bytes FROM everyb i JOIN ranks b ON b.batch_id = i.batch_id LEFT JOIN location l ON l.viewer = b.rank AND l.node = i.node GROUP BY ALL"


def _train(s, d) -> DataFrame:
    return X.train(s, d).withColumn("pos", F.col("node"))


@query("w2_locality_job", _DEG + "," + layer_sql("a", "batches", 1, DEEP) + "," + layer_sql("b", "everya", 0, DEEP) + _REPORT)
def _w2(s, d):
    e = edges(s, d)
    return W.locality_job(e, _train(s, d), snake(s, d, e)[1], X.DEVICES, X.BATCH, [DEEP, DEEP], [1, 1], X.SEED, 64)


_HELD = ", fav0 AS MATERIALIZED (SELECT DISTINCT device AS rank, node FROM buffer), fav1 AS MATERIALIZED (SELECT rank, dst AS node FROM loops JOIN fav0 ON src = node GROUP BY rank, dst HAVING sum(weight) > 0 QUALIFY row_number() OVER (PARTITION BY rank ORDER BY sum(weight) DESC, dst) <= 8192)"


@query("w2_locality_job_favoured", _DEG + _HELD + "," + layer_sql("a", "batches", 1, DEEP, "fav1") + "," + layer_sql("b", "everya", 0, DEEP, "fav0") + _REPORT)
def _w2_favoured(s, d):
    """Every worker favours what it holds, and what is often met from there."""
    e = edges(s, d)
    buffer, location = snake(s, d, e)
    favoured = W.favoured_nodes(e, X.nodes(s, d), buffer, 2)
    return W.locality_job(e, _train(s, d), location, X.DEVICES, X.BATCH, [DEEP, DEEP], [1, 1], X.SEED, 64, favoured, 4.0)
