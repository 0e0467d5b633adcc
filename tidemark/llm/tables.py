"""Intermediate tables in the shared folder, exact filters by a bounded bitmap, joins with hot keys, connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.session import shared_folder

#: Keys that more than one row in this many holds meet their rows by broadcast; fewer than this many can.
HOT_PART = 10_000
#: Most bits of a cell's number: a bitmap of all cells is 8 MB at most, whatever the input's size.
CELL_BITS = 26


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, outlives lost executors.

    The folder is deleted when the driver ends, or by drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{fresh()}"
    schema = df.schema
    df.write.parquet(path)
    forget_at_end(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._tidemark_path = path
    return out


def fresh() -> str:
    return uuid.uuid4().hex


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Deletes `path` when the driver ends."""
    atexit.register(_delete, spark, path)


class Appended:
    """A Parquet table in the shared folder that results are added to, one after the other."""

    def __init__(self, spark: SparkSession, schema: StructType, name: str):
        self.spark, self.schema, self.path = spark, schema, f"{shared_folder(spark)}/tidemark/{name}-{fresh()}"
        self.empty = True

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)
        if self.empty:
            forget_at_end(self.spark, self.path)
        self.empty = False

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if self.empty else self.spark.read.schema(self.schema).parquet(self.path)


def small(df: DataFrame, name: str, rows: int = 50_000) -> DataFrame:
    """written(df), marked for broadcast if it has at most `rows` rows; beyond that joins shuffle it."""
    out = written(df, name)
    return F.broadcast(out) if out.limit(rows + 1).count() <= rows else out


def schema_with(df: DataFrame, columns: list[str], more: str) -> StructType:
    """The given columns of df with their types, then those of the DDL text `more`; all may be null."""
    return StructType([*[StructField(c, df.schema[c].dataType) for c in columns], *StructType.fromDDL(more).fields])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has one, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def skew_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined (inner) with facts, one row a key, on columns that are not null.

    `weight` counts a key's rows among `total`. Keys that hold more than one row
    in HOT_PART are fewer than HOT_PART, so they are sent to every task and their
    rows stay where they are; the others are joined by shuffle.
    """
    hot = F.col(weight) * HOT_PART > total
    often = F.broadcast(facts.filter(hot).drop(weight))
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(facts.filter(~hot).drop(weight), key))


def before(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with, for each name, the sum of an expression over the rows before a row in the order; ties count in any order.

    Rows are dealt to ranges of the order; each range is summed by itself, and
    the ranges' totals, one row a task, run on from range to range. No task holds all rows.
    """
    part, *totals = free_names(df, "_part", *[f"_total_{name}" for name in sums])
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_part = ranged.groupBy(part).agg(*[F.sum(value).alias(total) for total, value in zip(totals, sums.values())])
    of_part = of_part.select(part, *[F.coalesce(F.sum(t).over(rows(Window.orderBy(part))), F.lit(0)).alias(t) for t in totals])
    inside = rows(Window.partitionBy(part).orderBy(*order))
    found = {name: F.col(total) + F.coalesce(F.sum(value).over(inside), F.lit(0)) for (name, value), total in zip(sums.items(), totals)}
    return ranged.join(F.broadcast(of_part), part).withColumns(found).drop(part, *totals)


def cell_bits(rows: int) -> int:
    """Bits for about 16 cells a row, CELL_BITS at most."""
    return min(CELL_BITS, (16 * rows).bit_length())


def cell(hash64: Column, bits: int) -> Column:
    """The cell of a 64-bit hash: its leading bits."""
    return F.shiftrightunsigned(hash64, 64 - bits)


def bitmap(cells: DataFrame, **kinds: Column) -> DataFrame:
    """(block, <kind>...): for each kind, a condition over the rows, the bits of the cells (column cell) that hold such a row.

    A block is 64 words of 64 cells, so there are at most 2**(CELL_BITS - 12) rows of
    512 bytes a kind, 8 MB a kind: it may be sent to every task.
    """
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    words = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(*[F.coalesce(F.bit_or(F.when(of, bit)), F.lit(0).cast("long")).alias(kind) for kind, of in kinds.items()])
    place = F.col("word").bitwiseAND(63).cast("int")
    blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(*[F.map_from_entries(F.collect_list(F.struct(place, kind))).alias(kind) for kind in kinds])

    def filled(kind: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at(F.col(kind), i), F.lit(0).cast("long")))

    return written(blocks.select("block", *[filled(kind).alias(kind) for kind in kinds]), "cells")


def with_cells(rows: DataFrame, hash64: Column, held: DataFrame, bits: int) -> DataFrame:
    """rows with a boolean column for each kind of bitmap(): whether the row's cell holds such a row."""
    kinds = [c for c in held.columns if c != "block"]
    at, block, *held_bits = free_names(rows, "_cell", "_block", *[f"_bits_{k}" for k in kinds])
    numbered = rows.withColumn(at, cell(hash64, bits)).withColumn(block, F.shiftright(at, 12))
    joined = numbered.join(F.broadcast(held.withColumnsRenamed({"block": block} | dict(zip(kinds, held_bits)))), block, "left")
    word, place = F.expr(f"cast(shiftright({at}, 6) & 63 as int) + 1"), F.expr(f"cast({at} & 63 as int)")
    flag = lambda c: F.coalesce(F.call_function("getbit", F.element_at(F.col(c), word), place) == 1, F.lit(False))
    return joined.withColumns({k: flag(c) for k, c in zip(kinds, held_bits)}).drop(at, block, *held_bits)


def without(rows: DataFrame, hash64: Column, key: Column, named: DataFrame) -> DataFrame:
    """The rows, all columns, whose key isn't among `named` (hash, digest); hash64 is the hash of a row's key there.

    Rows in no named hash's cell are kept without a join, so only named keys' rows, and few others, are ever shuffled.
    """
    named = small(named.distinct(), "named")
    width = cell_bits(named.count())
    kind, digest = free_names(rows, "_named", "_digest")
    held = bitmap(named.select(cell(F.col("hash"), width).alias("cell")), **{kind: F.lit(True)})
    marked = with_cells(rows, hash64, held, width)
    keys = named.select(F.col("digest").alias(digest))
    maybe = marked.filter(F.col(kind)).drop(kind)
    return marked.filter(~F.col(kind)).drop(kind).unionByName(maybe.join(keys, key == F.col(digest), "left_anti")).select(*[F.col(f"`{c}`") for c in rows.columns])


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, df._tidemark_path)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for nodes with an edge.

    Alternates large-star and small-star rounds until the edges no longer
    change; each round is two aggregations with map-side combine and two joins
    on the node, written to the shared folder. Nothing is collected but two
    numbers a round. Null ends and loops are ignored; repeated edges are fine.
    """
    now = written(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: an aggregate on the join's key would hand its partitioning to the join, and a hub's
        # edges would meet in one task; both sides read from tables are plain shuffles, which adaptive execution splits
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop(least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        pairs = large.join(least, "u")
        small = (
            pairs.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, now = now, written(small, "edges")
        drop(before, least, large)
        last, state = state, _state(now)
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest (node, up) with one parent a node: pointer doubling.

    Every round halves the depths with one join over the nodes that have a
    parent; a row for each root is part of the result.
    """
    now = written(parents, "up")
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        step = written(now.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), "up")
        drop(now)
        now = step.select("node", "up")
        now._tidemark_path = step._tidemark_path
        if not step.filter("moved").limit(1).count():
            break
    return now.withColumnRenamed("up", "component").unionByName(
        now.select(F.col("up").alias("node"), F.col("up").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]
