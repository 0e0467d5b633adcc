"""Data-quality checks; a violation query of sound data returns no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total and distinct keys, duplicates, their share (0 for an empty frame) and whether the key is clean."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_keys"))
    twice = F.col("total") - F.col("unique_keys")
    return counted.withColumn("duplicates", twice).withColumn("duplicate_rate", F.round(twice / F.greatest("total", F.lit(1)), 6)).withColumn("is_clean", F.col("duplicates") == 0)


def find_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def kept_earliest(raw: DataFrame, deduped: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Deduplicated rows that aren't the earliest of their key."""
    least = raw.groupBy(*keys).agg(F.min(order).alias("_least"))
    return deduped.join(least, keys, "left").filter(F.col("_least").isNull() | (F.col(order) != F.col("_least"))).drop("_least")


def temporal_order(trades: DataFrame) -> DataFrame:
    """Rows whose clocks run backwards (trade <= event <= ingestion), with the reason."""
    arrival = F.unix_millis("ingestion_ts")
    reason = F.when(F.col("event_time") < F.col("trade_time"), "event_before_trade").when(arrival < F.col("event_time"), "ingestion_before_event")
    return trades.withColumn("reason", reason).filter("reason is not null")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: its share of nulls (null for an empty frame)."""
    rates = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in columns])
    return rates.unpivot([], columns, "field", "null_rate")


def conservation(trades: DataFrame, bars: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Counts and volume of trades against those of bars by symbol, within a share of loss."""
    left = trades.groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.sum("quantity"), 6).alias("trade_volume"))
    right = bars.groupBy("symbol").agg(F.sum("trade_count").alias("bar_trades"), F.round(F.sum("volume"), 6).alias("bar_volume"))
    loss = F.round((F.col("trades") - F.coalesce("bar_trades", F.lit(0))) / F.col("trades"), 6)
    return left.join(right, "symbol", "left").withColumn("loss", loss).withColumn("within", F.col("loss") <= tolerance)


def missing_symbols(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.select("symbol").distinct().join(found.select("symbol"), "symbol", "left_anti")


def untraced(features: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows whose trace_id isn't among the raw events'."""
    return features.join(raw.select("trace_id"), "trace_id", "left_anti")


UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def invalid_uuid4(df: DataFrame, column: str = "trace_id") -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.lower(column).rlike(UUID4))


def expired(df: DataFrame, now: F.Column, days: int = 7) -> DataFrame:
    """Rows received more than `days` days before `now`."""
    return df.filter(F.col("ingestion_ts") < now - F.expr(f"INTERVAL {days} DAYS"))


INVARIANTS = {
    "low_le_vwap": "vwap < low - 1e-6",
    "vwap_le_high": "vwap > high + 1e-6",
    "volatility_ge_0": "rolling_volatility < 0 or realized_volatility < 0",
    "spread_ge_0": "spread_min < 0",
    "trade_count_gt_0": "trade_count <= 0",
    "volume_is_sum": "abs(buy_volume + sell_volume - volume) > 1e-6",
    "obi_in_range": "abs(obi) > 1",
    "autocorr_in_range": "abs(return_autocorr) > 1",
}


def invariants(features: DataFrame) -> DataFrame:
    """One row an invariant: how many rows break it."""
    counts = features.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in INVARIANTS.items()])
    return counts.unpivot([], list(INVARIANTS), "invariant", "violations")
