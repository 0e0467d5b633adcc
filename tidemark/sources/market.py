"""Scans, routing and lookups of trade and quote events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_COLUMNS = ["symbol", "date", "trade_time", "event_time", "agg_trade_id", "price", "quantity", "is_buyer_maker", "trace_id", "ingestion_ts"]
TICKER_COLUMNS = ["symbol", "date", "event_time", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty", "spread", "trace_id", "ingestion_ts"]


def day_of(millis: str | Column) -> Column:
    """Epoch milliseconds as a UTC yyyy-MM-dd string, whatever the session's time zone."""
    value = F.col(millis) if isinstance(millis, str) else millis
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(value / 86_400_000).cast("int")), "yyyy-MM-dd")


def epoch_millis(ntz: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ntz})")


def scan_day(spark: SparkSession, path: str, date: str) -> DataFrame:
    """One day of a raw table laid out by date and symbol: the filter prunes partitions."""
    return spark.read.parquet(path).filter(F.col("date") == date).withColumn("date", F.col("date").cast("string"))


# --- the driver's event table as trades and quotes -------------------------------------------------


def _events(spark: SparkSession, sf_dir: str, date: str | None) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if date:
        # a range of the column itself, so that it reaches the scan
        events = events.filter(f"ts >= timestamp_ntz'{date}' and ts < timestamp_ntz'{date}' + interval 1 day")
    return events.withColumn("k", k).withColumn("ms", epoch_millis("ts"))


def trades_of_events(spark: SparkSession, sf_dir: str, date: str | None = None) -> DataFrame:
    return _events(spark, sf_dir, date).select(
        F.upper("event_type").alias("symbol"),
        day_of("ms").alias("date"),
        F.col("ms").alias("trade_time"),
        (F.col("ms") + F.col("k") % 10).alias("event_time"),
        F.col("event_id").alias("agg_trade_id"),
        F.col("value").alias("price"),
        (F.col("k") + 1).cast("double").alias("quantity"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
        F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.timestamp_millis(F.col("ms") + F.col("k") * 7).alias("ingestion_ts"),
    )


def tickers_of_events(spark: SparkSession, sf_dir: str, date: str | None = None) -> DataFrame:
    ask = F.col("value") + (F.col("k") + 1) / 100
    return _events(spark, sf_dir, date).select(
        F.upper("event_type").alias("symbol"),
        day_of("ms").alias("date"),
        F.col("ms").alias("event_time"),
        F.col("value").alias("best_bid_price"),
        (F.col("k") + 1).cast("double").alias("best_bid_qty"),
        ask.alias("best_ask_price"),
        (F.col("user_id") % 50 + 1).cast("double").alias("best_ask_qty"),
        (ask - F.col("value")).alias("spread"),
        F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.timestamp_millis(F.col("ms") + F.col("k") * 7).alias("ingestion_ts"),
    )


# --- JSON envelopes --------------------------------------------------------------------------------


KINDS = ("trade", "ticker", "unknown", "malformed")


def classify(raw: DataFrame) -> DataFrame:
    """Rows of JSON text (column value) as kind, one of KINDS, and body.

    The body is `data`, or the message itself. Its keys differ only by case, so
    it is read as a map of strings. A body without `e` that has `b` and `a` is a quote. Null is malformed.
    """
    root = F.from_json("value", "map<string,string>")
    body = F.coalesce(F.from_json(F.element_at("root", "data"), "map<string,string>"), F.col("root"))
    event = F.element_at("body", "e")
    kind = (
        F.when(F.col("root").isNull(), "malformed")
        .when(event == "aggTrade", "trade")
        .when((event == "bookTicker") | (event.isNull() & F.element_at("body", "b").isNotNull() & F.element_at("body", "a").isNotNull()), "ticker")
        .otherwise("unknown")
    )
    return raw.withColumn("root", root).withColumn("body", body).withColumn("kind", kind).select("kind", "body")


def parse_envelopes(raw: DataFrame) -> DataFrame:
    """classify() without the malformed and unknown messages, which are dropped."""
    return classify(raw).filter("kind in ('trade', 'ticker')")


def _field(name: str, kind: str) -> Column:
    return F.element_at("body", name).try_cast(kind)


def route_trades(messages: DataFrame) -> DataFrame:
    """Trades of parse_envelopes(), with a trace id and the arrival time."""
    trade_time = _field("T", "long")
    return messages.filter("kind = 'trade'").select(
        _field("s", "string").alias("symbol"),
        day_of(trade_time).alias("date"),
        trade_time.alias("trade_time"),
        _field("E", "long").alias("event_time"),
        _field("a", "long").alias("agg_trade_id"),
        _field("p", "double").alias("price"),
        _field("q", "double").alias("quantity"),
        _field("m", "boolean").alias("is_buyer_maker"),
        F.uuid().alias("trace_id"),
        F.current_timestamp().alias("ingestion_ts"),
    )


def route_tickers(messages: DataFrame) -> DataFrame:
    """Quotes of parse_envelopes(); a missing or zero event time becomes the arrival clock."""
    event_time = F.coalesce(F.nullif(_field("E", "long"), F.lit(0).cast("long")), F.unix_millis(F.current_timestamp()))
    bid, ask = _field("b", "double"), _field("a", "double")
    return messages.filter("kind = 'ticker'").select(
        _field("s", "string").alias("symbol"),
        day_of(event_time).alias("date"),
        event_time.alias("event_time"),
        bid.alias("best_bid_price"),
        _field("B", "double").alias("best_bid_qty"),
        ask.alias("best_ask_price"),
        _field("A", "double").alias("best_ask_qty"),
        (ask - bid).alias("spread"),
        F.uuid().alias("trace_id"),
        F.current_timestamp().alias("ingestion_ts"),
    )


# --- synthetic walks -------------------------------------------------------------------------------

# Where the walks begin (2024-06-10 12:00 UTC), their rows, steps and spreads.
START_MS = 1_718_020_800_000
TRADE_ROWS, TRADE_STEP_MS, TRADE_SIGMA, TRADE_SEED = 200, 3000, 2e-4, 42
TICKER_ROWS, TICKER_STEP_MS, TICKER_SIGMA, TICKER_SEED = 300, 2000, 1e-4, 99
SPREAD_LOW, SPREAD_HIGH = 0.5, 5.0


def _uniform(name: str) -> Column:
    """A number from 0 up to 1 by the hash of seed, symbol, row and a name: the same however the rows are partitioned."""
    digits = F.substring(F.md5(F.concat_ws("/", "seed", "symbol", "i", F.lit(name)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def _walk(spark: SparkSession, symbols: dict[str, float], rows: int, sigma: float, seed: int) -> DataFrame:
    """(id, i, symbol, price): log-price walks; a row's price is its own noise, about normal, summed along the symbol."""
    from pyspark.sql import Window

    names, prices = F.array(*[F.lit(s) for s in symbols]), F.array(*[F.lit(float(p)) for p in symbols.values()])
    place = (F.floor(F.col("id") / rows) + 1).cast("int")
    base = spark.range(rows * len(symbols)).withColumns({"i": F.col("id") % rows, "symbol": F.element_at(names, place), "base": F.element_at(prices, place), "seed": F.lit(seed)})
    noise = (sum((_uniform(f"step{j}") for j in range(1, 4)), _uniform("step0")) - 2.0) * 3**0.5 * sigma
    return base.withColumn("price", F.col("base") * F.exp(F.sum(noise).over(Window.partitionBy("symbol").orderBy("i"))))


def synthetic_trades(spark: SparkSession, symbols: dict[str, float], rows: int = TRADE_ROWS, step_ms: int = TRADE_STEP_MS, sigma: float = TRADE_SIGMA, seed: int = TRADE_SEED) -> DataFrame:
    """Seeded walks, `rows` trades a symbol."""
    time = F.lit(START_MS) + F.col("i") * step_ms
    return _walk(spark, symbols, rows, sigma, seed).select(
        "symbol",
        day_of(time).alias("date"),
        time.alias("trade_time"),
        (time + 2).alias("event_time"),
        F.col("id").alias("agg_trade_id"),
        F.round("price", 2).alias("price"),
        F.round(_uniform("quantity") * 1.999 + 0.001, 6).alias("quantity"),
        (_uniform("side") < 0.5).alias("is_buyer_maker"),
        F.concat(F.lit("demo-"), F.col("id").cast("string")).alias("trace_id"),
        F.timestamp_millis(time + 10).alias("ingestion_ts"),
    )


def synthetic_tickers(spark: SparkSession, symbols: dict[str, float], rows: int = TICKER_ROWS, step_ms: int = TICKER_STEP_MS, sigma: float = TICKER_SIGMA, seed: int = TICKER_SEED) -> DataFrame:
    """Seeded walks of the middle price, `rows` quotes a symbol, with even spreads and sizes."""
    time = F.lit(START_MS) + F.col("i") * step_ms
    spread = _uniform("spread") * (SPREAD_HIGH - SPREAD_LOW) + SPREAD_LOW
    return _walk(spark, symbols, rows, sigma, seed).select(
        "symbol",
        day_of(time).alias("date"),
        time.alias("event_time"),
        F.round(F.col("price") - spread / 2, 2).alias("best_bid_price"),
        F.round(_uniform("bid") * 9.5 + 0.5, 4).alias("best_bid_qty"),
        F.round(F.col("price") + spread / 2, 2).alias("best_ask_price"),
        F.round(_uniform("ask") * 9.5 + 0.5, 4).alias("best_ask_qty"),
        F.round(spread, 4).alias("spread"),
        F.concat_ws("-", F.lit("quote"), "symbol", F.col("i").cast("string")).alias("trace_id"),
        F.timestamp_millis(time).alias("ingestion_ts"),
    )


# --- point lookups ---------------------------------------------------------------------------------


def last_trades(trades: DataFrame, symbol: str, date: str, n: int) -> DataFrame:
    return trades.filter((F.col("symbol") == symbol) & (F.col("date") == date)).orderBy(F.desc("trade_time"), F.desc("agg_trade_id")).limit(n)


def tickers_between(tickers: DataFrame, symbol: str, date: str, start_ms: int, end_ms: int) -> DataFrame:
    return tickers.filter((F.col("symbol") == symbol) & (F.col("date") == date) & F.col("event_time").between(start_ms, end_ms))


def trace_at(trades: DataFrame, symbol: str, date: str, trade_time: int) -> DataFrame:
    return trades.filter((F.col("symbol") == symbol) & (F.col("date") == date) & (F.col("trade_time") == trade_time))


def trace_by_id(trades: DataFrame, trace_id: str) -> DataFrame:
    return trades.filter(F.col("trace_id") == trace_id)


def large_trades(trades: DataFrame, symbol: str, date: str, n: int = 10) -> DataFrame:
    return (
        trades.filter((F.col("symbol") == symbol) & (F.col("date") == date))
        .orderBy(F.desc("quantity"), F.desc("trade_time"), F.desc("agg_trade_id"))
        .limit(n)
    )


def events_since(trades: DataFrame, symbol: str, date: str, since_ms: int) -> DataFrame:
    return trades.filter((F.col("symbol") == symbol) & (F.col("date") == date) & (F.col("trade_time") >= since_ms)).agg(F.count("*").alias("event_count"))


def run_sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """A query text with named parameters."""
    return spark.sql(text, args=params)
