"""Cleaning: required columns, casts, ranges, derived columns, one row a business key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADE_REQUIRED = ["symbol", "price", "quantity", "trade_time", "trace_id"]
TICKER_REQUIRED = ["symbol", "best_bid_price", "best_ask_price", "event_time", "trace_id"]
# The ranges that published rows are held to.
PRICE, QUANTITY = (1e-6, 1e7), (1e-7, 1e6)
TIME_MS = (1_577_836_800_000, 1_893_456_000_000)


def drop_nulls(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(subset=required)


def _cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()} | {"symbol": F.upper("symbol")})


def cast_trades(df: DataFrame) -> DataFrame:
    return _cast(df, {"price": "double", "quantity": "double", "trade_time": "long", "event_time": "long", "agg_trade_id": "long", "is_buyer_maker": "boolean"})


def cast_tickers(df: DataFrame) -> DataFrame:
    return _cast(df, {"best_bid_price": "double", "best_bid_qty": "double", "best_ask_price": "double", "best_ask_qty": "double", "event_time": "long"})


def valid_trade() -> Column:
    return F.col("price").between(*PRICE) & F.col("quantity").between(*QUANTITY) & F.col("trade_time").between(*TIME_MS)


def valid_ticker() -> Column:
    bid, ask = F.col("best_bid_price"), F.col("best_ask_price")
    return (bid >= PRICE[0]) & (ask >= PRICE[0]) & (ask >= bid) & F.col("event_time").between(*TIME_MS)


def validate_trades(df: DataFrame) -> DataFrame:
    return df.filter(valid_trade())


def validate_tickers(df: DataFrame) -> DataFrame:
    return df.filter(valid_ticker())


def _kept(df: DataFrame, required: list[str], valid: Column) -> DataFrame:
    """df, all rows, with a column kept: whether a row has what is required and is valid."""
    return df.withColumn("kept", reduce(Column.__and__, [F.col(c).isNotNull() for c in required], F.coalesce(valid, F.lit(False))))


def mark_trades(df: DataFrame) -> DataFrame:
    """Raw trades, cast, all of them, with `kept`: whether cleaning keeps the row, duplicates aside."""
    return _kept(cast_trades(df), TRADE_REQUIRED, valid_trade())


def mark_tickers(df: DataFrame) -> DataFrame:
    return _kept(cast_tickers(df), TICKER_REQUIRED, valid_ticker())


def derive_trades(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "trade_datetime": F.timestamp_millis("trade_time"),
            "price_qty": F.col("price") * F.col("quantity"),
            "log_price": F.ln("price"),
            "side": F.when(F.col("is_buyer_maker"), "sell").otherwise("buy"),
        }
    )


def derive_tickers(df: DataFrame) -> DataFrame:
    bid, ask = F.col("best_bid_price"), F.col("best_ask_price")
    return df.withColumns({"event_datetime": F.timestamp_millis("event_time"), "spread": ask - bid, "mid_price": (bid + ask) / 2})


def dedup(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def dedup_trades(df: DataFrame) -> DataFrame:
    """The earliest received row of each (symbol, agg_trade_id)."""
    return dedup(df, ["symbol", "agg_trade_id"], ["ingestion_ts", "trade_time", "trace_id"])


def dedup_tickers(df: DataFrame) -> DataFrame:
    """The earliest received row of each (symbol, event_time); distinct books of one millisecond collapse."""
    return dedup(df, ["symbol", "event_time"], ["ingestion_ts", "trace_id", "best_bid_price", "best_ask_price"])


def clean_trades(df: DataFrame) -> DataFrame:
    return drop_nulls(df, TRADE_REQUIRED).transform(cast_trades).transform(validate_trades).transform(derive_trades).transform(dedup_trades)


def clean_tickers(df: DataFrame) -> DataFrame:
    return drop_nulls(df, TICKER_REQUIRED).transform(cast_tickers).transform(validate_tickers).transform(derive_tickers).transform(dedup_tickers)
