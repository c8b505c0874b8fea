"""Mixing sources to target weights by Pareto order sampling (operator 5), in DataFrame functions.

A source's target is its weight's share of the whole budget, held at ``most`` times the source's size;
what is above goes to the others by weight, round by round until none is above (a round is one sum over
the sources, of which the driver sees a single row). A source that is asked for ``target / size = c + f``
times its size gives every document c whole copies. The rest, ``f`` of its size, is an order sample with
unequal odds: a document's inclusion p is proportional to the number of binary digits of its size, so
that longer documents are likelier, and scaled so that the expected size is the rest; where p reaches 1
the document is certain. Documents are ranked by the odds of a uniform number over the odds of their
inclusion, u / (1 - u) over p / (1 - p), and the ranking is cut where the source's taken size comes
nearest to the target.

The cut is found without ranking a source in one place: sizes are summed by (source, slice of the rank
key), a window over at most ``SLICES`` rows per source finds the slice of the cut, the same is done with
that slice's own slices, and only the last one's documents, one in millions, are ranked. The uniform
number is a hash of seed, doc_id and text, and ties of the ranking go by doc_id, size and that number, so reruns agree
on any partitioning. The work is one pass of text and narrow shuffles.

Null text has size 0 and draws like an empty one. Null source is a source of its own, last in order; null doc_id draws
like an empty id, and ranks last among ties. Documents of size 0 are taken 0 words of. Rows that share a doc_id draw for
themselves; rows that share their text too are alike in all, so that it shows in no result which of them is taken. Very long texts are counted whole. Further columns aren't read, whatever their names, but those
in ``keep``, which must not be called like a result. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_globally
from .common import WORD, materialise

SLICES = 4096
MOST = 3


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 of the seed, the id and the text's md5."""
    mark = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), mark)
    return (F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last. One row per source."""
    ranked = rank_globally(sources.select("source", F.col("source").isNull().alias("unknown")), ["unknown", "source"])
    return ranked.select("source", (F.col("rank") % 3 + 1).cast("double").alias("weight"))


def targets(totals: DataFrame, weights: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size) and (source, weight)."""
    given = weights.select(F.col("source").alias("given"), "weight")
    s = totals.join(given, F.col("source").eqNullSafe(F.col("given"))).drop("given")
    s = materialise(s.withColumn("cap", (F.col("source_size") * most).cast("double")), "caps")
    level = 0.0
    while True:  # the sources that are full at one level stay full at the next
        full = F.col("cap") < level * F.col("weight")
        left, share = s.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not share or left / share <= level:
            break
        level = left / share
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if share else F.col("cap")
    return s.select("source", "source_size", target.alias("target"))


def _digits(size: Column) -> Column:
    """The number of binary digits of a size, 1 at least: what a document's inclusion is proportional to."""
    return F.length(F.bin(size)).cast("long")


def _cut(drawn: DataFrame, slice_: str, before: Column, rest: Column) -> DataFrame:
    """(cut_source, cut, before): the slice of each source in which its ranking is cut, and the size before it."""
    per_slice = drawn.groupBy("source", slice_).agg(F.sum("size").alias("n"), F.first(before).alias("start"), F.first(rest).alias("rest"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("source").orderBy(slice_))
    cut = per_slice.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0))
    cut = cut.groupBy(F.col("source").alias("cut_source")).agg(F.min(F.struct(slice_, (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    return materialise(cut.select("cut_source", F.col(f"cut.{slice_}").alias("cut"), "cut.before"), "cuts")


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    most: int = MOST,
    seed: int = 5,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken, and the columns in keep.
    weights: (source, weight), every source once; without it ``cyclic_weights``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), uniform(seed, F.col(doc_id), F.col(text)).alias("u"), *keep)
    rows = materialise(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _digits(F.col("size"))).alias("digits"))
    totals = materialise(totals, "totals")
    goal = targets(totals.drop("digits"), cyclic_weights(totals) if weights is None else weights, most)
    goal = goal.join(totals.select(F.col("source").alias("own"), "digits"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    goal = goal.withColumn("asked", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("whole", F.floor("asked").cast("long")).withColumn("f", F.col("asked") - F.col("whole"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "goal_source")
    goal = materialise(goal, "goals")
    p = F.when(F.col("digits") > 0, F.least(F.col("f") * _digits(F.col("size")) * F.col("source_size") / F.col("digits"), F.lit(1.0))).otherwise(F.col("f"))
    u = F.col("u")
    odds = (u * (1 - F.col("p"))) / (u * (1 - F.col("p")) + (1 - u) * F.col("p"))  # Pareto's quotient q as q / (1 + q)
    drawn = (
        rows.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .drop("goal_source")
        .withColumn("p", p)
        .withColumn("key", odds)
        .withColumn("slice", F.floor(F.col("key") * SLICES).cast("int"))
        .withColumn("part", F.floor((F.col("key") * SLICES - F.col("slice")) * SLICES).cast("int"))
    )
    coarse = _cut(drawn, "slice", F.lit(0).cast("long"), F.col("rest"))
    drawn = drawn.join(coarse.select("cut_source", F.col("cut").alias("cut_slice"), F.col("before").alias("start")), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    in_slice = F.col("slice") == F.col("cut_slice")
    fine = _cut(drawn.where(in_slice), "part", F.col("start"), F.col("rest"))
    fine = fine.select("cut_source", F.col("cut").alias("cut_part"), "before")
    drawn = drawn.join(fine, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    at_cut = in_slice & (F.col("part") == F.col("cut_part"))
    # only the documents at the cut of each source are ranked; other rows stay out of its windows
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "u").rowsBetween(Window.unboundedPreceding, -1)
    edge = drawn.where(at_cut).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("more", (F.col("ahead") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("ahead")
    clear = drawn.where(~F.coalesce(at_cut, F.lit(False)))
    # a source without a cut takes none beyond its whole copies, or all where rounding left its cut beyond the last row
    early = (F.col("slice") < F.col("cut_slice")) | (in_slice & (F.col("part") < F.col("cut_part")))
    clear = clear.withColumn("more", F.when(F.col("rest") <= 0, 0).otherwise(F.coalesce(early, F.lit(True)).cast("long")))
    out = clear.unionByName(edge).withColumn("copies", F.least(F.col("whole") + F.col("more"), F.lit(most)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('5|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * length(bin(size)))::BIGINT AS digits,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, (source_size * 3)::DOUBLE AS cap,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum((source_size * 3)::DOUBLE) OVER o, 0) AS rest_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share
  FROM s WINDOW o AS (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT arg_min(rest_size / share, cap / weight) AS level FROM c WHERE rest_size / share * weight <= cap),
g AS (
  SELECT source, source_size, digits, coalesce(least(cap, level * weight), cap) AS target FROM c, l),
a AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS asked FROM g),
w AS (
  SELECT *, floor(asked)::BIGINT AS whole, asked - floor(asked) AS f, target - floor(asked) * source_size AS rest FROM a),
i AS (
  SELECT d.doc_id, d.size, d.u, w.source_size, w.target, w.whole, w.rest, d.source,
         CASE WHEN digits > 0 THEN least(f * length(bin(d.size)) * w.source_size / digits, 1.0) ELSE f END AS p
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
k AS (SELECT *, (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) AS key FROM i),
r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k),
t AS (
  SELECT *, least(whole + CASE WHEN rest > 0 AND ahead + size / 2 <= rest THEN 1 ELSE 0 END, 3)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM t
"""
