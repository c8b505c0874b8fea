"""Registered queries of the graph jobs over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.tables import materialise, shared_dir
from ..operators import graph as G
from ..operators import placement as P
from ..operators import propagate as N
from ..operators import ranking as R
from ..operators import relabel as L
from ..operators import sampling as M
from ..operators import scoring as E
from ..operators import stats as A
from ..sources import readers as S
from . import fixtures as X
from . import workloads as W
from .register import QUERIES, SQL, query
from .register import batches as _batches
from .register import rounded as _r
from .register import rows as _rows
from .register import scores as _scores
from .register import snake as _snake
from .register import spread as _spread
from .register import whole as _whole
from .register import written as _written

# edges
query("g1_coalesce_edges", "SELECT * FROM e")(lambda s, d: G.coalesce_edges(X.g_raw(s, d)))
query("g2_add_reverse_edges", "SELECT src, dst, sum(w) AS weight FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM raw UNION ALL SELECT dst, src, 1.0 FROM raw) GROUP BY src, dst")(lambda s, d: G.add_reverse_edges(X.g_raw(s, d)))
query("g3_symmetrize_max", "SELECT src, dst, max(w) AS weight FROM (SELECT src, dst, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY src, dst")(lambda s, d: G.symmetrize_max(X.g_raw(s, d)))
query("g4_add_self_loops", "SELECT * FROM loops")(lambda s, d: G.add_self_loops(X.g_next(s, d), X.nodes(s, d)))
query("g5_transpose", "SELECT dst AS src, src AS dst, weight FROM e")(lambda s, d: G.transpose(X.g_next(s, d)))
query("g6_select_rows", "SELECT e.* FROM e JOIN (SELECT node FROM train UNION ALL SELECT node FROM train WHERE node % 3 = 0) ON src = node")(
    lambda s, d: G.select_rows(X.g_next(s, d), X.train(s, d).union(X.train(s, d).where("node % 3 = 0")))
)
query("g7_select_cols", "SELECT * FROM e WHERE dst IN (SELECT node FROM train)")(lambda s, d: G.select_cols(X.g_next(s, d), X.train(s, d)))
query("g8_induced_subgraph", "SELECT * FROM e WHERE dst IN (SELECT node FROM train) AND src IN (SELECT node FROM train)")(lambda s, d: G.induced_subgraph(X.g_next(s, d), X.train(s, d)))
query("g9_local_index", "SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pos FROM hub")(lambda s, d: G.local_index(X.g_hub(s, d), ["dst"], "src"))
query("g10_union_nodes", "SELECT node FROM train UNION SELECT dst FROM e WHERE dst % 2 = 0")(lambda s, d: G.union_nodes(X.train(s, d), X.g_next(s, d).select(F.col("dst").alias("node")).where("node % 2 = 0")))
query("g11_intersect_count", "SELECT dst % 4 AS device, count(DISTINCT src) AS n FROM hub WHERE src IN (SELECT node FROM train) GROUP BY 1")(
    lambda s, d: G.intersect_count(X.g_hub(s, d).select((F.col("dst") % 4).alias("device"), F.col("src").alias("node")), X.train(s, d))
)
query("g12_membership_flag", "SELECT node, node IN (SELECT node FROM train) AS is_member FROM n")(lambda s, d: G.membership_flag(X.nodes(s, d), X.train(s, d)))
_ADJ = "SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS at FROM e"
query("g13_adjacency_round_trip", _ADJ)(
    lambda s, d: G.to_adjacency(X.g_next(s, d)).select("src", "piece", F.posexplode("nbrs").alias("at", "x")).select("src", "x.dst", "x.weight", (F.col("piece").cast("long") * (1 << 16) + F.col("at")).alias("at"))
)
query("g13_adjacency_pieces", f"SELECT src, (\"at\" // 8)::INT AS piece, count(*) AS n, min(dst) AS low, max(dst) AS high, sum(weight) AS weight FROM ({_ADJ}) GROUP BY ALL")(
    lambda s, d: G.to_adjacency(X.g_next(s, d), 8).select(
        "src", "piece", F.size("nbrs").cast("long").alias("n"), F.col("nbrs")[0]["dst"].alias("low"), F.element_at("nbrs", -1)["dst"].alias("high"), F.aggregate("nbrs", F.lit(0.0), lambda t, x: t + x["weight"]).alias("weight")
    )
)
query("g13_from_adjacency", "SELECT * FROM e")(lambda s, d: G.from_adjacency(G.to_adjacency(X.g_next(s, d), 8)))
query("g14_row_pointers", "SELECT node AS row, coalesce(sum(k) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(k) OVER (ORDER BY node)::BIGINT AS \"end\" FROM (SELECT node, count(src) AS k FROM n LEFT JOIN e ON src = node GROUP BY node)")(
    lambda s, d: G.row_pointers(X.g_next(s, d), X.nodes(s, d))
)


@query("g15_from_row_pointers", "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, dst, src AS row FROM e")
def _g15(s, d):
    e = X.g_next(s, d)
    return G.from_row_pointers(G.row_pointers(e, X.nodes(s, d)), R.rank_globally(e, ["src", "dst"], "pos").select("pos", "dst"))


query("g16_sort_edges_by_row", "SELECT * FROM e")(lambda s, d: G.sort_edges_by_row(X.g_next(s, d)))

# degrees, normalisation, statistics
query("a1_degrees", "SELECT node, (SELECT coalesce(sum(weight), 0)::DOUBLE FROM e WHERE src = node) AS out_weight, (SELECT count(*) FROM e WHERE src = node) AS out_count, (SELECT coalesce(sum(weight), 0)::DOUBLE FROM e WHERE dst = node) AS in_weight, (SELECT count(*) FROM e WHERE dst = node) AS in_count FROM n")(
    lambda s, d: G.degrees(X.g_next(s, d), X.nodes(s, d))
)
query("a2_endpoint_degree", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")(lambda s, d: G.endpoint_degree(X.g_next(s, d)))
query("a3_row_normalize", "SELECT src, dst, round(weight, 6) AS weight FROM norm")(lambda s, d: _r(G.row_normalize(X.g_next(s, d)), "weight"))
query("a4_sym_normalize", "SELECT src, dst, round(weight / sqrt(sum(weight) OVER (PARTITION BY src)) / sqrt(sum(weight) OVER (PARTITION BY dst)), 6) AS weight FROM e")(lambda s, d: _r(G.sym_normalize(X.g_next(s, d)), "weight"))
query("a5_laplacian", "SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM loops")(lambda s, d: _r(G.laplacian(X.g_next(s, d), X.nodes(s, d)), "weight"))
query("a6_zscore", "SELECT src, dst, round((weight - avg(weight) OVER ()) / stddev_pop(weight) OVER (), 6) AS z FROM e")(lambda s, d: _r(A.zscore(X.g_next(s, d), "weight").drop("weight"), "z"))
query("a7_mean_std", "SELECT round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS std FROM e")(lambda s, d: _r(A.mean_std(X.g_next(s, d), "weight"), "mean", "std"))
query("a8_skew_ratio", "SELECT round(count(*) * max(k) / sum(k), 6) AS skew_ratio FROM (SELECT count(*) AS k FROM hub GROUP BY dst)")(lambda s, d: _r(A.skew_ratio(X.g_hub(s, d), "dst"), "skew_ratio"))
query("a9_standard_scale", ", " + X.SCALED + " SELECT node, unnest(range(len(x)))::INT AS i, unnest(list_transform(x, lambda v: round(v, 6))) AS v FROM scaled")(
    lambda s, d: _spread(A.standard_scale(X.features(s, d), X.roles(s, d)), "features", "node")
)
query("a10_num_classes", "SELECT (max(label) - min(label) + 1)::BIGINT AS num_classes FROM lab")(lambda s, d: A.num_classes(X.labels(s, d)))
_VEC = ", x AS (SELECT label, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, i, round({}(v), 6) AS v FROM x GROUP BY label, i"
query("a11_vector_sum", _VEC.format("sum"))(lambda s, d: _spread(A.vector_sum(X.table(s, d, "embeddings"), "label", "embedding"), "embedding", "label"))
query("a11_vector_mean", _VEC.format("avg"))(lambda s, d: _spread(A.vector_mean(X.table(s, d, "embeddings"), "label", "embedding"), "embedding", "label"))
query("a12_clip_by_global_norm", ", x AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, i, round(v * least(1.0, 5.0 / (sqrt((SELECT sum(v * v) FROM x)) + 1e-6)), 6) AS v FROM x")(
    lambda s, d: _spread(A.clip_by_global_norm(X.table(s, d, "embeddings"), "embedding"), "embedding", "vec_id")
)
query("a13_load_per_device", "SELECT taker AS device, round(sum(score), 6) AS load, count(*) AS n FROM snake GROUP BY taker")(
    lambda s, d: _r(P.load_per_device(P.hot_swaps(_scores(s, d), X.DEVICES, _rows(s, d), 0.5, "snake")[1]), "load")
)

# features and labels
_HOT = ", span AS (SELECT min(label) AS lo, max(label) AS hi FROM lab) SELECT node, i::INT AS i, {} AS v FROM {} (SELECT unnest(range(hi - lo + 1)) AS i, lo FROM span)"
query("f1_one_hot", _HOT.format("(label - lo = i)::INT", "(SELECT * FROM lab WHERE label IS NOT NULL),"))(lambda s, d: A.one_hot(X.labels(s, d).where("label is not null")).select("node", F.posexplode("one_hot").alias("i", "v")))
query("f2_multi_hot", "SELECT doc_id AS node, 0 AS class_idx FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1")(lambda s, d: A.multi_hot(X.doc_labels(s, d)))
query("f3_one_hot_with_missing", _HOT.format("coalesce(label - lo = i, false)::INT", "lab,"))(lambda s, d: A.one_hot_with_missing(X.nodes(s, d), X.labels(s, d)).select("node", F.posexplode("one_hot").alias("i", "v")))
query("f4_gather", "SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey AS node, round(list_sum(list_transform(features, lambda v, i: v::DOUBLE * i)), 4) AS whole, features[1]::DOUBLE AS first FROM lineitem JOIN feat ON node = l_partkey")(
    lambda s, d: A.gather(X.features(s, d), X.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("node"))).select("pos", "node", _whole(), F.col("features")[0].cast("double").alias("first"))
)
_MAP = ", m AS (SELECT node, row_number() OVER (ORDER BY coalesce((SELECT sum(weight) FROM e WHERE src = node), 0)::BIGINT DESC, node) - 1 AS new_id FROM n) "
query("f5_relabel_by_degree", _MAP + "SELECT * FROM m")(lambda s, d: L.relabel_by_degree(X.nodes(s, d), X.g_next(s, d)))
query("f6_apply_relabel_edges", _MAP + "SELECT a.new_id AS src, b.new_id AS dst, weight FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst")(lambda s, d: L.apply_relabel_edges(X.g_next(s, d), L.relabel_by_degree(X.nodes(s, d), X.g_next(s, d))))
query("f7_apply_relabel_rows", _MAP + "SELECT new_id AS node, role FROM roles JOIN m USING (node)")(lambda s, d: L.apply_relabel_rows(X.roles(s, d), L.relabel_by_degree(X.nodes(s, d), X.g_next(s, d))))
query("f8_split_by_position", "SELECT node, CASE WHEN row_number() OVER (ORDER BY node) <= 100 THEN 'tr' WHEN row_number() OVER (ORDER BY node) <= 150 THEN 'va' ELSE 'te' END AS role FROM n")(
    lambda s, d: L.split_by_position(R.rank_globally(X.nodes(s, d), ["node"]), 100, 50)
)

# neighbourhoods
query("n1_neighbors", "SELECT dst AS node FROM e WHERE src IN (SELECT node FROM roles WHERE role = 'va') GROUP BY dst HAVING sum(weight) <> 0")(lambda s, d: N.neighbors(X.g_next(s, d), X.roles(s, d).where("role = 'va'")))
_HOPS = ", h1 AS (SELECT g, dst AS node FROM h0 JOIN e ON src = node UNION SELECT * FROM h0), h2 AS (SELECT g, dst AS node FROM h1 JOIN e ON src = node UNION SELECT * FROM h1) "
_FIRST_HOP = "node, min(hop)::INT AS hop FROM (SELECT g, node, 0 AS hop FROM h0 UNION ALL SELECT g, node, 1 FROM h1 UNION ALL SELECT g, node, 2 FROM h2) GROUP BY g, node"
query("n2_k_hop", ", h0 AS (SELECT 0 AS g, node FROM roles WHERE role = 'te')" + _HOPS + "SELECT " + _FIRST_HOP)(lambda s, d: N.k_hop(X.g_next(s, d), X.roles(s, d).where("role = 'te'"), 2))
query("n3_k_hop_by_group", ", h0 AS (SELECT batch_id AS g, node FROM batches)" + _HOPS + 'SELECT g AS "group", ' + _FIRST_HOP)(
    lambda s, d: N.k_hop_by_group(X.g_next(s, d), _batches(s, d).select(F.col("batch_id").alias("group"), "node"), 2)
)
query("n4_propagate", "SELECT dst AS node, round(sum(node * weight), 6) AS score FROM norm JOIN n ON src = node GROUP BY dst")(lambda s, d: _r(N.propagate(X.nodes(s, d).select("node", F.col("node").cast("double").alias("score")), G.row_normalize(X.g_next(s, d))), "score"))
query("n5_access_score", "SELECT node, round(score, 6) AS score FROM score")(lambda s, d: _r(_scores(s, d), "score"))
_SPMM = ", x AS (SELECT node, unnest(range(len(features)))::INT AS i, unnest(features)::DOUBLE AS v FROM feat) SELECT {} AS node, i, round(sum(weight * v), 6) AS v FROM norm JOIN x ON {} = x.node GROUP BY 1, i"
query("n6_aggregate_neighbors", _SPMM.format("src", "dst"))(lambda s, d: _spread(E.aggregate_neighbors(_normalised(s, d), X.features(s, d).withColumnRenamed("features", "x")), "x", "node"))
query("n6_aggregate_with_hubs", ", hub_norm AS (SELECT dst AS src, src AS dst, 1.0 / count(*) OVER (PARTITION BY dst) AS weight FROM hub), x AS (SELECT node, unnest(range(len(features)))::INT AS i, unnest(features)::DOUBLE AS v FROM feat) SELECT src AS node, i, round(sum(weight * v), 6) AS v FROM hub_norm JOIN x ON dst = x.node GROUP BY 1, i")(
    lambda s, d: _spread(_means_of_hubs(s, d), "x", "node")
)
query("n7_aggregate_transposed", _SPMM.format("dst", "src"))(lambda s, d: _spread(E.aggregate_transposed(_normalised(s, d), X.features(s, d).withColumnRenamed("features", "x")), "x", "node"))


def _normalised(s, d) -> DataFrame:
    return materialise(G.row_normalize(X.g_next(s, d)), "normalised")


def _means_of_hubs(s, d) -> DataFrame:
    """Means over all parts of a supplier; suppliers of more than 64 parts are cut into pieces."""
    e = materialise(G.row_normalize(G.transpose(X.g_hub(s, d))), "normalised")
    return E.aggregate_neighbors(e, X.features(s, d).withColumnRenamed("features", "x"), hubs=E.hub_rows(e, 64))

_LEVELS = ", l1 AS (SELECT dst AS node, sum(score * weight) AS score FROM loops JOIN l0 ON src = node GROUP BY dst), l2 AS (SELECT dst AS node, sum(score * weight) AS score FROM loops JOIN l1 ON src = node GROUP BY dst) SELECT 0 AS level, node FROM l0 UNION ALL (SELECT 1, node FROM l1 WHERE score > 0 ORDER BY score DESC, node LIMIT 8192) UNION ALL (SELECT 2, node FROM l2 WHERE score > 0 ORDER BY score DESC, node LIMIT 8192)"
query("n8_skewed_node_sets", ", l0 AS (SELECT node, 1.0::DOUBLE AS score FROM (SELECT node, row_number() OVER (ORDER BY md5('7|' || node), node) - 1 AS rank FROM n), size WHERE rank < 4 * rows)" + _LEVELS)(
    lambda s, d: N.skewed_node_sets(X.g_next(s, d), X.nodes(s, d), P.place_random(X.nodes(s, d), X.DEVICES, _rows(s, d), X.SEED), 3)
)

# the same over the whole train set, all its blocks, and the real buffers with the production top
query("n1_neighbors_train", "SELECT dst AS node FROM e WHERE src IN (SELECT node FROM train) GROUP BY dst HAVING sum(weight) <> 0")(lambda s, d: N.neighbors(X.g_next(s, d), X.train(s, d)))
_ALL_HOPS = ", t AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM train), h0 AS (SELECT {} AS g, node FROM t)" + _HOPS
_BLOCK = "(pos // greatest(1, (SELECT count(*) FROM t) // 20))::INT"
query("n2_k_hop_train", _ALL_HOPS.format("0") + "SELECT " + _FIRST_HOP)(lambda s, d: N.k_hop(X.g_next(s, d), X.train(s, d), 2))
query("n3_k_hop_by_block", _ALL_HOPS.format(_BLOCK) + 'SELECT g AS "group", ' + _FIRST_HOP)(lambda s, d: N.k_hop_by_group(X.g_next(s, d), _block_seeds(s, d), 2))
query("n3_k_hop_bits", _ALL_HOPS.format(_BLOCK) + 'SELECT g AS "group", ' + _FIRST_HOP)(
    lambda s, d: N.groups_of_bits(N.k_hop_bits(X.g_next(s, d), _block_seeds(s, d).withColumn("group", F.col("group").cast("int")), 64, 2), 64)
)
query("n8_skewed_node_sets_buffers", ", l0 AS (SELECT DISTINCT node, 1.0::DOUBLE AS score FROM buffer)" + _LEVELS)(lambda s, d: N.skewed_node_sets(X.g_next(s, d), X.nodes(s, d), _snake(s, d)[0], 3))
query(
    "n8_skewed_node_sets_by_rank",
    ", l0 AS (SELECT DISTINCT device, node, 1.0::DOUBLE AS score FROM buffer), l1 AS (SELECT device, dst AS node, sum(score * weight) AS score FROM loops JOIN l0 ON src = node GROUP BY ALL), l2 AS (SELECT device, dst AS node, sum(score * weight) AS score FROM loops JOIN l1 ON src = node GROUP BY ALL), every AS (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 WHERE score > 0 UNION ALL SELECT 2, * FROM l2 WHERE score > 0) SELECT level, device AS rank, node FROM every QUALIFY level = 0 OR row_number() OVER (PARTITION BY level, device ORDER BY score DESC, node) <= 8192",
)(lambda s, d: N.skewed_node_sets_by_rank(X.g_next(s, d), X.nodes(s, d), _snake(s, d)[0].withColumnRenamed("device", "rank"), 3))


def _block_seeds(s, d) -> DataFrame:
    """(group, node): the train set's blocks."""
    return P.partition_blocks(R.rank_globally(X.train(s, d), ["node"], "pos")).select(F.col("block").alias("group"), "node")


# sources: tables written in the readers' formats and read back
PIECE = 500


def _objects(labels: DataFrame) -> DataFrame:
    """JSON objects of ids and labels, some hundreds of ids each."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("string"), "label")))
    return labels.groupBy(F.floor(F.col("node") / PIECE).alias("piece")).agg(F.to_json(pairs).alias("value")).select("value")


def _role_objects(s, d) -> DataFrame:
    """Objects of id lists by role, some hundreds of ids each."""
    lists = [F.collect_list(F.when(F.col("role") == r, F.col("node"))).alias(r) for r in ("tr", "va", "te")]
    return X.roles(s, d).groupBy(F.floor(F.col("node") / PIECE).alias("piece")).agg(*lists).drop("piece")


for _fmt in ("csv", "json", "parquet"):
    query(f"s1_read_edges_{_fmt}", "SELECT * FROM e")(lambda s, d, fmt=_fmt: S.read_edges(s, _written(s, X.g_next(s, d), fmt), fmt))
query("s3_read_features", "SELECT node, round(list_sum(list_transform(features, lambda v, i: v::DOUBLE * i)), 4) AS whole FROM feat")(
    lambda s, d: S.read_features(s, _written(s, X.features(s, d), "parquet")).select("node", _whole())
)
query("s4_read_class_map", "SELECT node, coalesce(label, -1)::INT AS label FROM lab")(
    lambda s, d: S.read_class_map(s, _written(s, X.labels(s, d), "json"), lines=True).withColumn("label", F.coalesce("label", F.lit(-1)))
)
query("s4_read_class_map_object", "SELECT node, coalesce(label, -1)::INT AS label FROM lab")(
    lambda s, d: S.read_class_map(s, _written(s, _objects(X.labels(s, d).withColumn("label", F.coalesce("label", F.lit(-1)))), "text", maxRecordsPerFile=1))
)
query("s2_read_roles", "SELECT node, role FROM roles")(lambda s, d: S.read_roles(s, _written(s, _role_objects(s, d), "json", maxRecordsPerFile=1)))
query("s2_read_roles_lines", "SELECT node, role FROM roles")(lambda s, d: S.read_roles(s, _written(s, X.roles(s, d), "json"), lines=True))
query("s5_read_index_file", "SELECT node AS id FROM train")(lambda s, d: S.read_index_file(s, _written(s, X.train(s, d).select(F.col("node").cast("string")), "text")))


@query("s6_save_or_load", "SELECT node, round(score, 6) AS score FROM score")
def _s6(s, d):
    """Made and written once, and found the second time."""
    folder = f"{shared_dir(s)}/results-{uuid.uuid4().hex}"
    S.save_or_load(lambda: _scores(s, d), s, folder, {"k": 3})
    return _r(S.save_or_load(lambda: 1 / 0, s, folder, {"k": 3}), "score")


query("s7_label_coverage", "SELECT (SELECT count(*) FROM n WHERE node NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT node FROM n)) AS extra")(
    lambda s, d: S.label_coverage(X.nodes(s, d), X.table(s, d, "labels").withColumnRenamed("doc_id", "node"))
)


@query("s8_write_buffers", "SELECT device, slot, buffer.node, round(list_sum(list_transform(features, lambda v, i: v::DOUBLE * i)), 4) AS whole FROM buffer JOIN feat ON feat.node = buffer.node")
def _s8(s, d):
    path = f"{shared_dir(s)}/buffers-{uuid.uuid4().hex}"
    S.write_buffers(_snake(s, d)[0], X.features(s, d), path)
    return s.read.parquet(path).select("device", "slot", "node", _whole())


# placement
_SLICE = "SELECT (rank // rows)::INT AS device, (rank % rows)::INT AS slot, node FROM (SELECT node, row_number() OVER (ORDER BY {}) - 1 AS rank FROM n), size WHERE rank < 4 * rows"
query("p1_buffer_rows", "SELECT rows FROM size")(lambda s, d: X.nodes(s, d).agg(F.lit(_rows(s, d)).cast("long").alias("rows")))
query("p2_place_contiguous", _SLICE.format("node"))(lambda s, d: P.place_contiguous(X.nodes(s, d), X.DEVICES, _rows(s, d)))
query("p3_place_random", _SLICE.format("md5('7|' || node), node"))(lambda s, d: P.place_random(X.nodes(s, d), X.DEVICES, _rows(s, d), X.SEED))
query("p4_rank_by_score", "SELECT node, round(score, 6) AS score, rank FROM ranked, size WHERE rank < 4 * rows")(lambda s, d: _r(P.rank_by_score(_scores(s, d), X.DEVICES * _rows(s, d)), "score"))
query("p5_hot_swaps_snake", "SELECT i, node, round(score, 6) AS score, slot, evicted, taker, keeper FROM snake")(lambda s, d: _r(P.hot_swaps(_scores(s, d), X.DEVICES, _rows(s, d), 0.5, "snake")[1], "score").select("i", "node", "score", "slot", "evicted", "taker", "keeper"))
query("p5_place_hot_buffer", "SELECT device, slot, node FROM buffer")(lambda s, d: _snake(s, d)[0])
query("p5_place_hot_location", "SELECT * FROM location")(lambda s, d: _snake(s, d)[1])
query(
    "p5_place_hot_exact",
    # with two workers a round has one candidate, so the fold is a recursion over rounds
    ", sw AS (SELECT c.rank - rows AS i, c.node, c.score, (2 * rows - 1 - c.rank)::INT AS slot FROM ranked c, size, ranked p WHERE c.rank >= rows AND c.rank < 2 * rows AND p.rank = 2 * rows - 1 - c.rank AND c.score >= 0.5 * p.score), fold AS (SELECT -1::BIGINT AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, NULL::INT AS taker, NULL::BIGINT AS node, NULL::INT AS slot UNION ALL SELECT sw.i, CASE WHEN a <= b THEN a + score ELSE a END, CASE WHEN a <= b THEN b ELSE b + score END, CASE WHEN a <= b THEN 0 ELSE 1 END::INT, sw.node, sw.slot FROM fold JOIN sw ON sw.i = fold.i + 1) SELECT i, node, slot, taker FROM fold WHERE i >= 0",
)(lambda s, d: P.hot_swaps(_scores(s, d), 2, _rows(s, d), 0.5, "exact")[1].select("i", "node", "slot", "taker"))
_BLK = ", t AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM train) "
query("p6_partition_blocks", _BLK + "SELECT pos, node, (pos // greatest(1, (SELECT count(*) FROM t) // 20))::INT AS block FROM t")(lambda s, d: P.partition_blocks(R.rank_globally(X.train(s, d), ["node"], "pos")))


query("p8_top_rows_per_device", "SELECT device, slot::INT AS slot, node FROM (SELECT dst % 4 AS device, src AS node, row_number() OVER (PARTITION BY dst % 4 ORDER BY coalesce(round(any_value(score), 12), 0) DESC, src) - 1 AS slot FROM hub LEFT JOIN score ON node = src GROUP BY 1, 2), size WHERE slot < rows")(
    lambda s, d: P.top_rows_per_device(X.g_hub(s, d).select((F.col("dst") % 4).alias("device"), F.col("src").alias("node")), _scores(s, d), _rows(s, d))
)
query("p9_location_table", "SELECT v.device AS viewer, node, (rank // rows)::INT AS holder, (rank % rows)::INT AS slot FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS rank FROM n), size, dev v WHERE rank < 4 * rows")(
    lambda s, d: P.location_table(P.place_contiguous(X.nodes(s, d), X.DEVICES, _rows(s, d)), X.DEVICES)
)
query("p10_choose_placement_contiguous", _SLICE.format("node"))(lambda s, d: P.choose_placement("contiguous", X.DEVICES, _rows(s, d), X.nodes(s, d))[0])
query("p10_choose_placement_hot", "SELECT device, slot, node FROM buffer")(lambda s, d: P.choose_placement("hot", X.DEVICES, _rows(s, d), X.nodes(s, d), _scores(s, d), 0.5)[0])
query("w1_placement_job", "SELECT * FROM location")(lambda s, d: W.placement_job(X.g_next(s, d), X.train(s, d), X.nodes(s, d), X.DEVICES, X.RATIO, 0.5, 3)[1])
query("p10_choose_placement", _SLICE.format("md5('7|' || node), node"))(lambda s, d: P.choose_placement("random", X.DEVICES, _rows(s, d), X.nodes(s, d), seed=X.SEED)[0])
query("p11_train_order_for_greedy", _BLK + "SELECT node, row_number() OVER (ORDER BY node % 4, pos // 10, pos) - 1 AS pos FROM t")(
    lambda s, d: P.train_order_for_greedy(R.rank_globally(X.train(s, d), ["node"], "pos").select((F.col("node") % 4).alias("device"), F.floor(F.col("pos") / 10).alias("block"), "pos", "node"))
)


def _resolved(s, d) -> DataFrame:
    batches, e = materialise(_batches(s, d), "batches"), materialise(X.g_next(s, d), "edges")
    return P.resolve_location(W.batch_closures(e, batches), _snake(s, d, e)[1])


_RES = ", res AS (SELECT i.batch_id, i.rank, i.node, coalesce(holder, -1) AS holder, slot FROM inputs i LEFT JOIN location l ON l.viewer = i.rank AND l.node = i.node) "
query("p12_resolve_location", _RES + "SELECT * FROM res")(lambda s, d: _resolved(s, d).select("batch_id", "rank", "node", "holder", "slot"))
query(
    "flagship_movement_report",
    _RES + "SELECT batch_id, rank, count(*) FILTER (holder = rank) AS local, count(*) FILTER (holder <> rank AND holder <> -1) AS remote, count(*) FILTER (holder = -1) AS host, count(*) AS total, round(count(*) FILTER (holder = rank) / count(*), 6) AS hit_ratio, count(*) * 64 * 4 AS bytes FROM res GROUP BY batch_id, rank",
)(lambda s, d: P.movement_report(_resolved(s, d), 64))
query("p13_holder_totals", _RES + "SELECT rank, holder, count(*) AS n FROM res GROUP BY ROLLUP (rank, holder)")(lambda s, d: P.holder_totals(_resolved(s, d)))


@query("p14_gather_by_location", _RES + "SELECT batch_id, res.rank, res.node, holder, round(list_sum(list_transform(features, lambda v, i: v::DOUBLE * i)), 4) AS whole, features[1]::DOUBLE AS first FROM res JOIN feat ON feat.node = res.node")
def _p14(s, d):
    buffer, location = _snake(s, d)
    features = X.features(s, d)
    batches = materialise(_batches(s, d), "batches")
    resolved = materialise(P.resolve_location(W.batch_closures(X.g_next(s, d), batches), location), "resolved")
    got = P.gather_by_location(resolved, buffer.join(features, "node"), features)
    return got.select("batch_id", "rank", "node", "holder", _whole(), F.col("features")[0].cast("double").alias("first"))


# ranks, tops, sampling
query("r1_rank_globally", "SELECT src, dst, row_number() OVER (ORDER BY weight DESC, src, dst) - 1 AS rank FROM e")(lambda s, d: R.rank_globally(X.g_next(s, d), [F.desc("weight"), F.col("src"), F.col("dst")]).select("src", "dst", "rank"))
query("t1_top_k", "SELECT node, round(score, 6) AS score FROM ranked WHERE rank < 100")(lambda s, d: _r(R.top_k(_r(_scores(s, d), "score", places=12), 100), "score"))
query("t2_top_k_per_group", "SELECT src, dst, slot FROM (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) - 1)::INT AS slot FROM e) WHERE slot < 3")(lambda s, d: R.top_k_per_group(X.g_next(s, d), "src", 3, "weight", "dst").select("src", "dst", "slot"))
_IMP = ", imp AS (SELECT batch_id, dst AS node, count(*)::DOUBLE AS imp FROM batches JOIN e ON src = node GROUP BY 1, 2), prob AS (SELECT batch_id, node, imp / sum(imp) OVER (PARTITION BY batch_id) AS p FROM imp) "
query("m1_layer_importance", _IMP + "SELECT * FROM imp")(lambda s, d: M.layer_importance(X.g_next(s, d), _batches(s, d)))
query("m2_bias_local", _IMP + "SELECT batch_id, node, imp * CASE WHEN node % 5 = 0 THEN 4.0 ELSE 1.0 END AS imp FROM imp")(lambda s, d: M.bias_local(M.layer_importance(X.g_next(s, d), _batches(s, d)), X.nodes(s, d).where("node % 5 = 0"), 4.0))
query("m3_to_probability", _IMP + "SELECT batch_id, node, round(p, 9) AS p FROM prob")(lambda s, d: _r(M.to_probability(M.layer_importance(X.g_next(s, d), _batches(s, d))).select("batch_id", "node", "p"), "p", places=9))
query("m8_make_train_batches", "SELECT * FROM batches")(_batches)
query("m8_local_shuffle", _BLK + ", q AS (SELECT node, pos // chunk AS c, row_number() OVER (ORDER BY pos // chunk, md5('7|0|' || node), node) - 1 AS r FROM t, chunk) SELECT (r // chunk) * per + (r % chunk) // 512 AS batch_id, (r // chunk)::INT AS rank, ((r % chunk) % 512)::INT AS pos, node FROM q, chunk")(
    lambda s, d: M.make_train_batches(R.rank_globally(X.train(s, d), ["node"], "pos"), X.DEVICES, X.BATCH, X.SEED, local_shuffle=True)
)
query("m9_sample_validation", "SELECT node FROM roles WHERE role = 'va' ORDER BY md5('7|' || node), node LIMIT 128")(lambda s, d: M.sample_validation(X.roles(s, d).where("role = 'va'"), 128, X.SEED))
query("m10_make_test_batches", "SELECT r // 64 AS batch_id, (r % 64)::INT AS pos, node FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS r FROM roles WHERE role = 'te')")(
    lambda s, d: M.make_test_batches(R.rank_globally(X.roles(s, d).where("role = 'te'").select("node"), ["node"], "pos"), 64)
)

# vectors and scoring
query("v1_linear", ", x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), o AS (SELECT range AS o FROM range(8)) SELECT vec_id, o::INT AS i, round(sum(v * ((o * 7 + x.i * 13) % 19 - 9) / 50.0) + any_value((o % 5 - 2) / 10.0), 6) AS v FROM x, o GROUP BY vec_id, o")(
    lambda s, d: _spread(V.linear(X.table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", *_dense(8, 64), name="y").select("vec_id", "y"), "y", "vec_id")
)


def _dense(o: int, i: int):
    _, head = E.encoder_params([i, 1], [], o)
    return head["w"], head["b"]


_X = ", x AS (SELECT vec_id, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) "


def _emb(f: Callable) -> Callable:
    return lambda s, d: _spread(X.table(s, d, "embeddings").select("vec_id", f(F.col("embedding").cast("array<double>")).alias("v")), "v", "vec_id")


query("v2_segment_vector_sum", _X + "SELECT label, i, round(sum(v * (vec_id % 7)), 6) AS v FROM x JOIN embeddings USING (vec_id) GROUP BY label, i")(
    lambda s, d: _spread(V.segment_vector_sum(X.table(s, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("w"), "embedding"), ["label"], "w", "embedding", salt=8), "x", "label")
)
query("v3_elu", _X + "SELECT vec_id, i, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) AS v FROM x")(_emb(V.elu))
query("v4_row_layer_norm", _X + "SELECT vec_id, i, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-9), 6) AS v FROM x WINDOW w AS (PARTITION BY vec_id)")(_emb(V.row_layer_norm))
query("v5_concat_self_and_neighbors", _X + "SELECT vec_id, i, round(v, 6) AS v FROM x UNION ALL SELECT vec_id, i + 64, round(v * 2, 6) FROM x")(
    lambda s, d: _spread(V.concat_self_and_neighbors(_own(s, d), _own(s, d).withColumn("x", F.transform("x", lambda v: v * 2))).withColumnRenamed("node", "vec_id"), "x", "vec_id")
)
query("v6_l2_normalize", _X + "SELECT vec_id, i, round(v / greatest(sqrt(sum(v * v) OVER w), 1e-12), 6) AS v FROM x WINDOW w AS (PARTITION BY vec_id)")(_emb(V.l2_normalize))
query("v7_sigmoid", _X + "SELECT vec_id, i, round(1 / (1 + exp(-v)), 6) AS v FROM x")(_emb(V.sigmoid))
query("v7_softmax", _X + "SELECT vec_id, i, round(exp(v) / sum(exp(v)) OVER w, 6) AS v FROM x WINDOW w AS (PARTITION BY vec_id)")(_emb(V.softmax))


def _own(s, d) -> DataFrame:
    return X.table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("x"))


_PRED = ", y AS (SELECT node, c, x, ((node + c) % 3 = 0)::INT AS y FROM pred) "


def _pred(s, d) -> DataFrame:
    return X.predictions(X.nodes(s, d), 10)


def _truth(s, d) -> DataFrame:
    return X.nodes(s, d).select("node", F.array(*[((F.col("node") + c) % 3 == 0).cast("int") for c in range(10)]).alias("labels"))


query("e1_bce_loss", _PRED + "SELECT round(sum(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) / count(DISTINCT node), 6) AS loss FROM y")(lambda s, d: _r(E.bce_loss(_pred(s, d), _truth(s, d)), "loss"))
query("e2_cross_entropy_loss", "SELECT round(avg(l), 6) AS loss FROM (SELECT node, ln(sum(exp(x))) - max(x) FILTER (c = node % 10) AS l FROM pred GROUP BY node)")(lambda s, d: _r(E.cross_entropy_loss(_pred(s, d), X.nodes(s, d).select("node", (F.col("node") % 10).alias("target"))), "loss"))
query("e3_threshold_predictions", "SELECT node, c::INT AS i, (x > 0.5)::INT AS v FROM pred")(lambda s, d: E.threshold_predictions(_pred(s, d)).select("node", F.posexplode("predicted").alias("i", "v")))
_ARG = ", arg AS (SELECT node, (row_number() OVER (PARTITION BY node ORDER BY x DESC, c)) AS r, c::INT AS predicted FROM pred) "
query("e3_argmax_class", _ARG + "SELECT node, predicted FROM arg WHERE r = 1")(lambda s, d: E.argmax_class(_pred(s, d)))
_F1 = "SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro FROM k"
query("e4_f1_multilabel", _PRED + ", k AS (SELECT c, sum(y * (x > 0.5)::INT) AS tp, sum((1 - y) * (x > 0.5)::INT) AS fp, sum(y * (x <= 0.5)::INT) AS fn FROM y GROUP BY c) " + _F1)(lambda s, d: _r(E.f1_multilabel(_truth(s, d), E.threshold_predictions(_pred(s, d))), "micro", "macro"))
query("e4_f1_multiclass", _ARG + ", z AS (SELECT label, predicted FROM arg JOIN lab USING (node) WHERE r = 1 AND label IS NOT NULL), k AS (SELECT c, (SELECT count(*) FROM z WHERE label = c AND predicted = c) AS tp, (SELECT count(*) FROM z WHERE label <> c AND predicted = c) AS fp, (SELECT count(*) FROM z WHERE label = c AND predicted <> c) AS fn FROM (SELECT label AS c FROM z UNION SELECT predicted FROM z)) " + _F1)(
    lambda s, d: _r(E.f1_multiclass(X.labels(s, d).where("label is not null"), E.argmax_class(_pred(s, d))), "micro", "macro")
)
query("e5_weighted_mean_f1", "SELECT round(sum(f1 * k) / sum(k), 6) AS f1 FROM (SELECT count(*) AS k, avg(node % 10) / 10 AS f1 FROM batches GROUP BY batch_id)")(
    lambda s, d: _r(E.weighted_mean_f1(_batches(s, d).groupBy("batch_id").agg(F.count("*").alias("n"), (F.avg(F.col("node") % 10) / 10).alias("f1"))), "f1")
)


# queries with longer SQL
from . import encoder_queries, greedy_queries, sampling_queries  # noqa: E402, F401
