"""Tumbling-window bars and spread series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published resolutions and, below, the columns' names.
WINDOWS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "6h": "6 hours", "1d": "1 day"}
RESOLUTIONS = ("1m", "5m", "1h")


def _order() -> Column:
    """(trade_time, agg_trade_id) as one number: a fixed-width buffer keeps the aggregation hashed."""
    return F.col("trade_time").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("agg_trade_id").cast("decimal(19,0)")


def ohlcv(trades: DataFrame, label: str) -> DataFrame:
    """Bars of clean trades; open and close follow (trade_time, agg_trade_id)."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0.0))
    return (
        trades.withColumn("_order", _order())
        .groupBy("symbol", F.window("trade_datetime", WINDOWS[label]).alias("w"))
        .agg(
            F.min_by("price", "_order").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_order").alias("close"),
            F.sum("quantity").alias("volume"),
            F.count("*").alias("trade_count"),
            side("buy").alias("buy_volume"),
            side("sell").alias("sell_volume"),
            F.sum("price_qty").alias("price_qty_sum"),
        )
        .select("symbol", "open", "high", "low", "close", "volume", "trade_count", "buy_volume", "sell_volume", "price_qty_sum",
                F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.lit(label).alias("window_label"))
    )


def ohlcv_all(trades: DataFrame, labels: tuple[str, ...] = RESOLUTIONS) -> DataFrame:
    """All resolutions in one frame: the finest from trades, each coarser one rolled up from the one before."""
    frames = [ohlcv(trades, labels[0])]
    for label in labels[1:]:
        frames.append(roll_up(frames[-1], label))
    return reduce(DataFrame.unionByName, frames)


def roll_up(bars: DataFrame, label: str) -> DataFrame:
    """Coarser bars from finer ones whose width divides theirs."""
    total = lambda c: F.sum(c).alias(c)
    return (
        bars.groupBy("symbol", F.window("window_start", WINDOWS[label]).alias("w"))
        .agg(
            F.min_by("open", "window_start").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "window_start").alias("close"),
            *[total(c) for c in ("volume", "trade_count", "buy_volume", "sell_volume", "price_qty_sum")],
        )
        .select(*[c for c in bars.columns if not c.startswith("window_")],
                F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.lit(label).alias("window_label"))
    )


def spreads(tickers: DataFrame, label: str) -> DataFrame:
    return (
        tickers.groupBy("symbol", F.window("event_datetime", WINDOWS[label]).alias("w"))
        .agg(
            F.avg("spread").alias("spread_mean"),
            F.min("spread").alias("spread_min"),
            F.max("spread").alias("spread_max"),
            F.stddev_samp("spread").alias("spread_std"),
            F.avg("mid_price").alias("mid_price_mean"),
            F.count("*").alias("tick_count"),
            F.avg("best_bid_qty").alias("bid_qty_mean"),
            F.avg("best_ask_qty").alias("ask_qty_mean"),
        )
        .select("symbol", "spread_mean", "spread_min", "spread_max", "spread_std", "mid_price_mean", "tick_count",
                "bid_qty_mean", "ask_qty_mean", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.lit(label).alias("window_label"))
    )
