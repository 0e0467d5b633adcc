"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Native DataFrame functions only. Each source's target is min(cap, weight * level)
with one level for all, found in closed form: with the sources in order of
cap / weight, the level that clamping the first k of them leaves is largest at
the right k. A source with target t and size s is taken floor(t / s) whole times,
and once more for its documents that come first in a seeded order until the rest
of the target is used up; the one document at the edge is taken in part.

The edge is found from sums over 4,096 ranges of the seeded order, then inside
one range, so no task orders a whole source, and what the documents meet again
is one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tables

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _order_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources are in code point order, null last; their weights repeat. Targets sum
    to all sizes. Sources may be as many as rows: both orders, by name and by
    cap over weight, are summed range by range.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = tables.before(by_source, [F.col("source").asc_nulls_last()], place=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    planned = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    ordered = tables.before(planned, [F.col("cap") / F.col("weight"), F.col("place")], caps=F.col("cap"), weights=F.col("weight"))
    ordered = tables.written(ordered, "ordered")
    size, heavy = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = ordered.agg(F.max((F.lit(size) - F.col("caps")) / (F.lit(heavy) - F.col("weights")))).first()[0]
    return ordered.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level or 0.0)).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row a source: source, source_size, target, whole, edge, each.

    A document takes `whole` times its size, once more if its order key
    (order, doc_id, size) is below `edge`, and `each` words if it is at the edge
    (rows with equal keys share what is left evenly).
    """
    bins = 3
    slim = tables.written(docs.select("doc_id", "source", word_count().alias("size")), "sizes").withColumn("order", _order_key(seed))
    goal = targets(slim, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = tables.written(
        goal.withColumn("whole", whole).withColumn("quota", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), "targets"
    )
    by_bin = slim.groupBy("source", F.substring("order", 1, bins).alias("bin")).agg(F.sum("size").alias("bin_size"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
    edge_bin = (
        goal.select(F.col("source").alias("of"), "quota")
        .join(by_bin, F.col("of").eqNullSafe(F.col("source")))
        .filter("bin_start <= quota and quota < bin_start + bin_size")
        .select("of", "quota", "bin", "bin_start")
    )
    edge_bin = tables.small(edge_bin, "edges")
    within = (
        slim.join(edge_bin, F.col("of").eqNullSafe(F.col("source")) & (F.substring("order", 1, bins) == F.col("bin")))
        .groupBy("source", "quota", "bin_start", F.struct("order", "doc_id", "size").alias("edge"))
        .agg(F.count("*").alias("n"))
    )
    running = Window.partitionBy("source").orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("n") * F.col("edge.size")
    edge = (
        within.withColumn("start", F.col("bin_start") + F.coalesce(F.sum(total).over(running), F.lit(0)))
        .filter(F.col("start") <= F.col("quota"))
        .filter(F.col("quota") < F.col("start") + total)
        .select(F.col("source").alias("of"), "edge", F.expr("(quota - start) div n").alias("each"))
    )
    return tables.small(goal.join(edge, F.col("of").eqNullSafe(F.col("source")), "left").drop("of"), "plan")


def _extra() -> Column:
    key = F.struct(F.col("order"), F.col("doc_id"), F.col("size"))
    # no edge: the quota is the whole source, or nothing
    return (
        F.when(F.col("edge").isNull(), F.when(F.col("quota") > 0, F.col("size")).otherwise(0))
        .when(key < F.col("edge"), F.col("size"))
        .when(key == F.col("edge"), F.col("each"))
        .otherwise(0)
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source, ...).

    taken is whole repetitions of the document plus its part of the fractional
    one; a source's taken words sum to its rounded target. Null text has size
    0 and takes nothing; null sources are one source; a null doc_id orders as
    the word null; repeated rows are separate documents; an empty table gives
    an empty result. Other columns of docs are not read.
    """
    slim = docs.select("doc_id", "source", word_count().alias("size")).withColumn("order", _order_key(seed))
    goal = plan(docs, weights, max_epochs, seed).withColumnRenamed("source", "of")
    return slim.join(goal, F.col("of").eqNullSafe(F.col("source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + _extra()).cast("long").alias("taken")
    )


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed rows of docs, all columns: each row as often as the mix takes it.

    Texts stay whole: the document at a source's edge counts if the mix takes
    at least half of it. Documents of size 0 are kept once, as they weigh nothing.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "source", word_count().alias("size"))
    goal = plan(docs, weights, max_epochs, seed).withColumnRenamed("source", "of")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + F.when(2 * _extra() >= F.col("size"), 1).otherwise(0))
    joined = row.withColumn("order", _order_key(seed)).join(goal, F.col("of").eqNullSafe(F.col("source")))
    taken = joined.withColumn("copies", copies).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


#: The same in SQL, over a table documents (doc_id, text, source).
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
               / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
      FROM p WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, round(target)::BIGINT - whole * source_size AS quota FROM g),
k AS (SELECT source, ord, doc_id, size, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY ord, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (q.whole * d.size + CASE WHEN c.start + c.n * c.size <= q.quota THEN d.size
                                WHEN c.start < q.quota THEN (q.quota - c.start) // c.n ELSE 0 END)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.ord = c.ord AND d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.size = c.size
"""
