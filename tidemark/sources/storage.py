"""Tables: their layout, idempotent writes by key, reads by range, retention and bounded JSON exports."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import features as fx
from tidemark.operators import clean
from tidemark.session import scratch

BAR_KEY = ["symbol", "window_label", "window_start"]

# Names, columns and types of the published tables.
_BAR = (
    "symbol string, window_label string, window_start timestamp, window_end timestamp, open double, high double, low double, close double, "
    "volume double, trade_count bigint, buy_volume double, sell_volume double"
)
TABLES = {
    "raw_trades": "symbol string, date string, trade_time bigint, event_time bigint, agg_trade_id bigint, price double, quantity double, is_buyer_maker boolean, trace_id string, ingestion_ts timestamp",
    "raw_book_tickers": "symbol string, date string, event_time bigint, best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double, spread double, trace_id string, ingestion_ts timestamp",
    "ohlcv_1m": _BAR + ", price_qty_sum double",
    "ohlcv_5m": _BAR + ", price_qty_sum double",
    "ohlcv_1h": _BAR + ", price_qty_sum double",
    "spread_timeseries": "symbol string, window_label string, window_start timestamp, window_end timestamp, spread_mean double, spread_min double, spread_max double, spread_std double, spread_mean_pct double, mid_price_mean double, tick_count bigint, bid_qty_mean double, ask_qty_mean double, obi double",
    "features_by_window": _BAR + ", vwap double, log_return double, rolling_volatility double, realized_volatility double, momentum double, momentum_pct double, buy_sell_ratio double, return_autocorr double, "
    "spread_mean double, spread_mean_pct double, spread_min double, spread_max double, spread_std double, mid_price_mean double, tick_count bigint, obi double",
}
FEATURE_TABLE = [column.split()[0] for column in TABLES["features_by_window"].split(", ")]


# --- layout ----------------------------------------------------------------------------------------


def ddl(table: str, name: str, location: str) -> str:
    """The statement that makes a published table, by date and symbol if raw, else by label and date as upsert() writes it."""
    raw = table.startswith("raw_")
    columns = TABLES[table] if raw else TABLES[table] + ", date string"
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({'date, symbol' if raw else 'window_label, date'}) LOCATION '{location}'"


def schema(prefix: str, root: str) -> str:
    """The statements of all published tables, named prefix + table, under a folder."""
    return ";\n".join(f"-- {table}\n{ddl(table, prefix + table, f'{root}/{table}')}" for table in TABLES) + ";\n"


def migrate_features(spark: SparkSession, name: str, location: str) -> None:
    """Drops the features table, its rows included, and makes it anew with all columns; harmless to repeat."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, location)
    spark.sql(ddl("features_by_window", name, location))


def statements(text: str) -> list[str]:
    """The statements of a DDL text, without -- comments and empty ones."""
    lines = (line.split("--", 1)[0] for line in text.splitlines())
    return [s.strip() for s in "\n".join(lines).split(";") if s.strip()]


def apply_schema(spark: SparkSession, text: str) -> int:
    found = statements(text)
    for statement in found:
        spark.sql(statement)
    return len(found)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, store = _folder(spark, path)
    return store.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    folder, store = _folder(spark, path)
    store.delete(folder, True)


# --- writes ----------------------------------------------------------------------------------------


def with_defaults(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with each missing column added as a typed null, in the given order of columns."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])


def _keyed(df: DataFrame, keys: list[str], day: str, newest: str | None, unique: bool = False) -> tuple[DataFrame, list[str]]:
    """The rows to write, one a key, with their date, and the columns that they are partitioned by."""
    rest = [c for c in df.columns if c not in keys and c != newest]
    order = [F.col(newest).desc()] if newest else []
    rows = df.dropna(subset=keys)
    if not unique:
        rows = clean.dedup(rows, keys, [*order, *rest] or keys)
    return rows.withColumn("date", F.date_format(day, "yyyy-MM-dd")), [c for c in ("window_label",) if c in df.columns] + ["date"]


def _overwrite(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Replaces the partitions that rows touch, few files each: without rebalancing every task would write one to every partition."""
    rows.hint("rebalance", *map(F.col, parts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def replace_days(df: DataFrame, path: str, keys: list[str] | None = None, day: str = "window_start") -> None:
    """Replaces the (window_label, date) partitions that df touches by its rows: for writers that hold whole days."""
    rows, parts = _keyed(df, keys or BAR_KEY, day, None)
    _overwrite(rows, path, parts)


def upsert(df: DataFrame, path: str, keys: list[str] | None = None, day: str = "window_start", newest: str | None = None, unique: bool = False) -> None:
    """Writes the rows of df over those of the same key and leaves all others; rows with null keys are left out.

    `unique` says that df has one row a key, as an aggregation's result has.

    Of rows of one key that of the greatest `newest` stays, ties and without it the
    first in the order of all other columns. `day` is a time among the keys. Only the partitions of the dates
    from df's first to its last are read, and only those it touches replaced; what they will
    hold is staged first, as they are read here. Columns that either side lacks are null.
    """
    spark, keys = df.sparkSession, keys or BAR_KEY
    rows, parts = _keyed(df, keys, day, newest, unique)
    stage = scratch(spark, "upsert")
    try:
        rows.write.parquet(f"{stage}/new")
        new = spark.read.schema(rows.schema).parquet(f"{stage}/new")
        first, last = new.agg(F.min("date"), F.max("date")).first()
        if first is None:
            return
        if exists(spark, path):
            old = touched(spark, path, first, last).join(new.select(*parts).distinct(), parts, "left_semi")
            kept = old.join(new.select(*keys), keys, "left_anti")
            kept.unionByName(new, allowMissingColumns=True).write.parquet(f"{stage}/both")
            new = spark.read.parquet(f"{stage}/both")
        _overwrite(new, path, parts)
    finally:
        delete(spark, stage)


def touched(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The rows of a table in the partitions of the dates from first to last."""
    found = spark.read.parquet(path).filter(F.col("date").cast("string").between(first, last))
    return found.withColumn("date", F.col("date").cast("string"))


def table_rows(df: DataFrame, table: str) -> DataFrame:
    """The persisted columns of a published table, those that df lacks as null; rows without a window are left out."""
    return with_defaults(df, dict(column.split() for column in TABLES[table].split(", "))).dropna(subset=["window_start"])


def feature_rows(features: DataFrame) -> DataFrame:
    return table_rows(features, "features_by_window")


def spread_rows(spread: DataFrame) -> DataFrame:
    """Spreads as persisted, with their share of the middle price and the imbalance."""
    return table_rows(spread.transform(fx.add_spread_pct).transform(fx.add_obi), "spread_timeseries")


# --- reads -----------------------------------------------------------------------------------------


def read_bars(spark: SparkSession, path: str, label: str, start: str, end: str) -> DataFrame | None:
    """The persisted bars of a resolution with start <= window_start < end (ISO times in UTC), None if there is no table; both bounds prune partitions."""
    if not exists(spark, path):
        return None
    low, high = (F.timestamp_millis(F.lit(int(dt.datetime.fromisoformat(x).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))) for x in (start, end))
    days = F.col("date").cast("string").between(F.date_format(low, "yyyy-MM-dd"), F.date_format(high, "yyyy-MM-dd"))
    return spark.read.parquet(path).filter((F.col("window_label") == label) & days & (F.col("window_start") >= low) & (F.col("window_start") < high)).drop("date")


def retained(df: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """Rows received within the last `days` days."""
    now = F.current_timestamp() if now is None else now
    return df.filter(F.col("ingestion_ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def documents(df: DataFrame, by: str = "symbol", order: str = "window_start") -> DataFrame:
    """One JSON document a symbol: its rows as an array, in order. For frames already cut to a bounded number of rows a symbol."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order])))).alias("records"))


def records(df: DataFrame, most: int = 500) -> list[dict]:
    """At most `most` rows as dicts, times in ISO format."""
    return [json.loads(row) for row in df.limit(most).toJSON().collect()]


def export(df: DataFrame, path: str) -> None:
    """A bounded frame as JSON lines, times in ISO format, in place of what was there."""
    df.write.mode("overwrite").json(path)


def exported(spark: SparkSession, path: str) -> DataFrame | None:
    """What export() wrote, None if nothing is there."""
    return spark.read.json(path) if exists(spark, path) else None


def show(df: DataFrame, title: str, most: int = 20) -> None:
    """A title and at most `most` rows as a table on the console, cells whole."""
    print(title)
    df.show(most, truncate=False)
