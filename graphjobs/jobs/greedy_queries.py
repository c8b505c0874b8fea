"""Greedy placement by blocks of the train set, with SQL that gives a block a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialise
from ..operators import placement as P
from ..operators.ranking import rank_globally
from . import fixtures as X
from .register import query, rows, scores


def _step(b: int, devices: int) -> str:
    """st{b + 1}, the workers' blocks o0 ... as bits and loads l0 ... once block b has its worker, from st{b}."""
    each, bit = range(devices), 1 << b
    counts = ", ".join(f"coalesce(sum(n) FILTER (mask & o{d} <> 0), 0)::BIGINT AS z{d}, coalesce(sum(n) FILTER (mask & o{d} <> 0 AND mask & {bit} <> 0), 0)::BIGINT AS v{d}" for d in each)
    state = ", ".join(f"any_value(o{d}) AS o{d}, any_value(l{d}) AS l{d}" for d in each)
    ratings = "[" + ", ".join(f"abs(v{d} * (total - z{d}) / l{d})" for d in each) + "]"
    best = str(b) if b < devices else f"list_position({ratings}, list_max({ratings})) - 1"
    owned = ", ".join(f"CASE WHEN best = {d} THEN o{d} | {bit} ELSE o{d} END AS o{d}, CASE WHEN best = {d} THEN l{d} + r ELSE l{d} END AS l{d}" for d in each)
    return f"""
c{b} AS MATERIALIZED (SELECT {counts}, {state}, coalesce(sum(n) FILTER (mask & {bit} <> 0), 0)::BIGINT AS r FROM masks, st{b}),
d{b} AS MATERIALIZED (SELECT *, {best} AS best FROM c{b}, (SELECT count(*) AS total FROM n)),
st{b + 1} AS MATERIALIZED (SELECT {owned}, {"owner || [best]" if b else "[best]"} AS owner FROM d{b}{f", (SELECT owner FROM st{b})" if b else ""}),"""


#: The 20 blocks of a train set, and the short one that its rest may make.
BLOCKS = 21
_START = ", ".join(f"0::BIGINT AS o{d}, 1.0::DOUBLE AS l{d}" for d in range(X.DEVICES))
GREEDY = (
    ", t AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM train), blocks AS (SELECT node, pos, (pos // greatest(1, (SELECT count(*) FROM t) // 20))::INT AS block FROM t),"
    " reach AS MATERIALIZED (SELECT node, bit_or(1::BIGINT << block) AS mask FROM (SELECT block, node FROM blocks UNION SELECT block, dst FROM blocks JOIN e ON src = node) GROUP BY node),"
    f" masks AS MATERIALIZED (SELECT mask, count(*) AS n FROM reach GROUP BY mask), st0 AS (SELECT {_START}),"
    + "".join(_step(b, X.DEVICES) for b in range(BLOCKS)).rstrip(",")
    + f", greedy_buffer AS (SELECT device, node, row_number() OVER (PARTITION BY device ORDER BY coalesce(score, 0) DESC, node) - 1 AS slot FROM (SELECT DISTINCT d.device, r.node, score.score FROM reach r, st{BLOCKS}, (SELECT unnest([{', '.join(f'{{device: {d}, own: o{d}}}' for d in range(X.DEVICES))}], recursive := true) FROM st{BLOCKS}) d LEFT JOIN score ON score.node = r.node WHERE r.mask & d.own <> 0)) "
)
_BUFFER = GREEDY + "SELECT device, slot::INT AS slot, node FROM greedy_buffer, size WHERE slot < rows"


def placed(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    train = materialise(rank_globally(X.train(s, d), ["node"], "pos"), "train")
    e = materialise(X.g_next(s, d), "edges")
    return P.place_greedy_blocks(e, train, scores(s, d, e=e), X.DEVICES, rows(s, d), X.nodes(s, d).count(), 1)


query("p7_assign_blocks_greedy", GREEDY + f"SELECT block, owner[block + 1]::INT AS device, count(*) AS n FROM blocks, st{BLOCKS} GROUP BY 1, 2")(
    lambda s, d: placed(s, d)[2].groupBy("block", "device").agg(F.count("*").alias("n"))
)
query("w4_greedy_buffers", _BUFFER)(lambda s, d: placed(s, d)[0])


@query("p10_choose_placement_greedy_blocks", GREEDY + "SELECT device AS viewer, node, device AS holder, slot::INT AS slot FROM greedy_buffer, size WHERE slot < rows")
def _p10(s, d):
    train = materialise(rank_globally(X.train(s, d), ["node"], "pos"), "train")
    n, e = X.nodes(s, d), materialise(X.g_next(s, d), "edges")
    return P.choose_placement("greedy_blocks", X.DEVICES, rows(s, d), n, scores(s, d, e=e), e=e, train=train, total=n.count(), k=1)[1]
