"""Features over bars: rows of a symbol in window order; gaps between windows are not filled.

All windows share one partitioning and order, so the whole chain is one exchange and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.safe import ratio

def series():
    """A symbol's rows in window order."""
    return Window.partitionBy("symbol").orderBy("window_start")
SPREAD_COLUMNS = ["spread_mean", "spread_mean_pct", "spread_min", "spread_max", "spread_std", "mid_price_mean", "tick_count", "obi"]
JOIN_KEY = ["symbol", "window_label", "window_start"]


def last_rows(n: int):
    return series().rowsBetween(-(n - 1), 0)


def add_vwap(df: DataFrame) -> DataFrame:
    return df.withColumn("vwap", ratio("price_qty_sum", "volume", 8))


def add_log_return(df: DataFrame) -> DataFrame:
    return df.withColumn("log_return", F.round(F.ln(ratio("close", F.lag("close").over(series()))), 10))


def add_rolling_volatility(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn("rolling_volatility", F.round(F.stddev_samp("log_return").over(last_rows(n)), 10))


def add_realized_volatility(df: DataFrame, n: int = 10) -> DataFrame:
    """Parkinson's range estimate over the last n bars."""
    range_sq = F.pow(F.ln(ratio("high", "low")), 2)
    return df.withColumn("realized_volatility", F.round(F.sqrt(F.avg(range_sq).over(last_rows(n)) * (1 / (4 * math.log(2)))), 10))


def add_momentum(df: DataFrame, n: int = 5) -> DataFrame:
    before = F.lag("close", n).over(series())
    return df.withColumns({"momentum": F.round(F.col("close") - before, 8), "momentum_pct": ratio(F.col("close") - before, before, 8)})


def add_buy_sell_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("buy_sell_ratio", ratio("buy_volume", "sell_volume", 6))


def _correlation(x: Column, y: Column, frame) -> Column:
    """Pearson's correlation over a frame's complete pairs; null where either side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return ratio(F.covar_pop(a, b).over(frame), F.when(spread > 0, spread))


def add_return_autocorr(df: DataFrame, n: int = 20) -> DataFrame:
    lagged = df.withColumn("_before", F.lag("log_return").over(series()))
    return lagged.withColumn("return_autocorr", F.round(_correlation(F.col("log_return"), F.col("_before"), last_rows(n)), 6)).drop("_before")


def all_features(bars: DataFrame) -> DataFrame:
    for step in (add_vwap, add_log_return, add_rolling_volatility, add_realized_volatility, add_momentum, add_buy_sell_ratio, add_return_autocorr):
        bars = step(bars)
    return bars


def add_spread_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("spread_mean_pct", F.round(ratio("spread_mean", "mid_price_mean") * 100, 6))


def add_obi(df: DataFrame) -> DataFrame:
    """Order-book imbalance of mean sizes, null where there is no size."""
    bid, ask = F.col("bid_qty_mean"), F.col("ask_qty_mean")
    return df.withColumn("obi", F.when(bid + ask > 0, F.round((bid - ask) / (bid + ask), 6)))


def join_spreads(features: DataFrame, spread: DataFrame | None) -> DataFrame:
    """features with the eight spread columns of the same window; without a spread frame, unchanged."""
    if spread is None:
        return features
    enriched = spread.transform(add_spread_pct).transform(add_obi).select(*JOIN_KEY, *SPREAD_COLUMNS)
    return features.join(enriched, JOIN_KEY, "left")
