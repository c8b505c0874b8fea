"""Graphs and node tables derived from the given tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def g_next(spark: SparkSession, d: str) -> DataFrame:
    """Parts that follow each other in an order; weight is how often."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    step = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return step.where("dst is not null").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def g_raw(spark: SparkSession, d: str) -> DataFrame:
    """The same, one row per time."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    step = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.lit(1.0).alias("weight"))
    return step.where("dst is not null")


def g_hub(spark: SparkSession, d: str) -> DataFrame:
    """Part to supplier, with few suppliers of many parts."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"), F.lit(1.0).alias("weight")).distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


def roles(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 10
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(m <= 5, "tr").when(m <= 7, "va").otherwise("te").alias("role"))


def train(spark: SparkSession, d: str) -> DataFrame:
    return roles(spark, d).where("role = 'tr'").select("node")


def features(spark: SparkSession, d: str) -> DataFrame:
    """The embedding whose id is the node's, modulo their number."""
    e = table(spark, d, "embeddings")
    k = F.broadcast(e.agg(F.count("*").alias("k")))
    return nodes(spark, d).join(k).withColumn("vec_id", F.col("node") % F.col("k")).join(e, "vec_id").select("node", F.col("embedding").alias("features"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The embedding's label; null where the node divides by 7."""
    e = table(spark, d, "embeddings")
    k = F.broadcast(e.agg(F.count("*").alias("k")))
    rows = nodes(spark, d).join(k).withColumn("vec_id", F.col("node") % F.col("k")).join(e, "vec_id")
    return rows.select("node", F.when(F.col("node") % 7 != 0, F.col("label")).cast("int").alias("label"))


def doc_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("node"), F.array(F.col("quality").cast("int"), F.col("toxic").cast("int")).alias("labels"))


def predictions(n: DataFrame, classes: int) -> DataFrame:
    """Scores by formula: ((node * 31 + class * 17) % 101) / 100."""
    return n.select("node", F.array(*[((F.col("node") * 31 + c * 17) % 101) / F.lit(100.0) for c in range(classes)]).alias("scores"))


BATCH, DEVICES, RATIO, SEED = 512, 4, 0.1, 7

SQL = """WITH RECURSIVE raw AS (
  SELECT src, dst, 1.0::DOUBLE AS weight FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL),
e AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM raw GROUP BY src, dst),
hub AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 10000000 AS dst, 1.0::DOUBLE AS weight FROM lineitem),
n AS (SELECT p_partkey AS node FROM part),
roles AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 10 <= 5 THEN 'tr' WHEN p_partkey % 10 <= 7 THEN 'va' ELSE 'te' END AS role FROM part),
train AS (SELECT node FROM roles WHERE role = 'tr'),
feat AS (SELECT node, embedding AS features, label FROM n JOIN embeddings ON vec_id = node % (SELECT count(*) FROM embeddings)),
lab AS (SELECT node, CASE WHEN node % 7 <> 0 THEN label END::INT AS label FROM feat),
loops AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT node, node, 1.0 FROM n) GROUP BY src, dst),
norm AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM e),
s1 AS (SELECT dst AS node, sum(weight) AS score FROM norm JOIN train ON src = node GROUP BY dst),
s2 AS (SELECT dst AS node, sum(score * weight) AS score FROM norm JOIN s1 ON src = node GROUP BY dst),
score AS (SELECT dst AS node, round(sum(score * weight), 12) AS score FROM norm JOIN s2 ON src = node GROUP BY dst),
ranked AS (SELECT node, score, row_number() OVER (ORDER BY score DESC, node) - 1 AS rank FROM score),
size AS (SELECT floor(0.1 * count(*))::BIGINT AS rows FROM n),
snake AS (
  SELECT c.rank - rows AS i, c.node, c.score, (rows - 1 - (c.rank - rows) // 3)::INT AS slot, p.node AS evicted,
    (CASE WHEN ((c.rank - rows) // 3) % 2 = 0 THEN (c.rank - rows) % 3 ELSE 3 - (c.rank - rows) % 3 END)::INT AS taker,
    (CASE WHEN ((c.rank - rows) // 3) % 2 = 0 THEN 3 ELSE 0 END)::INT AS keeper
  FROM ranked c, size, ranked p WHERE c.rank >= rows AND c.rank < 4 * rows AND p.rank = rows - 1 - (c.rank - rows) // 3 AND c.score >= 0.5 * p.score),
dev AS (SELECT range::INT AS device FROM range(4)),
buffer AS (
  SELECT d.device, r.rank::INT AS slot, coalesce(s.node, r.node) AS node, r.node AS hot, s.keeper
  FROM ranked r JOIN size ON r.rank < rows CROSS JOIN dev d LEFT JOIN snake s ON s.slot = r.rank AND s.taker = d.device),
location AS (
  SELECT device AS viewer, hot AS node, coalesce(keeper, device) AS holder, slot FROM buffer
  UNION ALL SELECT device, node, taker, slot FROM snake CROSS JOIN dev),
perm AS (SELECT node, row_number() OVER (ORDER BY md5('7|0|' || node), node) - 1 AS rank FROM train),
chunk AS (SELECT ceil(count(*) / 4.0)::BIGINT AS chunk, ceil(ceil(count(*) / 4.0) / 512)::BIGINT AS per FROM train),
batches AS (
  SELECT (rank // chunk) * per + (rank % chunk) // 512 AS batch_id, (rank // chunk)::INT AS rank, ((rank % chunk) % 512)::INT AS pos, node FROM perm, chunk),
inputs AS (
  SELECT DISTINCT b.batch_id, b.rank, x.node FROM batches b JOIN (
    SELECT src, dst AS node FROM e UNION SELECT node, node FROM n) x ON x.src = b.node),
pred AS (SELECT node, c, ((node * 31 + c * 17) % 101) / 100.0 AS x FROM n, (SELECT range AS c FROM range(10)))
"""

#: Features by the train nodes' moments, as lists; continues SQL.
SCALED = """moments AS MATERIALIZED (
  SELECT list(m ORDER BY i) AS m, list(CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS s FROM (
    SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM (
      SELECT unnest(range(1, len(features) + 1)) AS i, unnest(features)::DOUBLE AS v FROM feat WHERE node % 10 <= 5) GROUP BY i)),
scaled AS MATERIALIZED (
  SELECT node, list_transform(range(1, len(features) + 1), lambda i: (features[i]::DOUBLE - m[i]) / s[i]) AS x FROM feat, moments)"""
