"""The live path: JSON text in, cleaned and deduplicated rows out, bars and features kept up to date."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions import features as fx
from tidemark.operators import bars, clean
from tidemark.sources import market, storage

WATERMARK = "10 minutes"
#: Rows before a bar that its features depend on: twenty returns, each with the one before it.
LOOKBACK = 21


def messages(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON text files under `path`, parsed and routed."""
    return market.parse_envelopes(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path))


# --- counters --------------------------------------------------------------------------------------


def observed(found: DataFrame, name: str = "messages") -> DataFrame:
    """Rows of market.classify() with counts of them all and by outcome, reported with each micro-batch under `name`."""
    return found.observe(name, F.count("*").alias("received"), *[F.count_if(F.col("kind") == kind).alias(kind) for kind in market.KINDS])


class Counters(StreamingQueryListener):
    """Sums what observed() reports over all micro-batches of a session's queries, by name; add with spark.streams.addListener."""

    def __init__(self):
        self.totals: dict[str, Counter] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        for name, row in (event.progress.observedMetrics or {}).items():
            self.totals.setdefault(name, Counter()).update(row.asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


# --- rows ------------------------------------------------------------------------------------------


def live_trades(raw: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Clean trades of a stream of raw rows, one of each (symbol, agg_trade_id) within the watermark."""
    rows = clean.drop_nulls(raw, clean.TRADE_REQUIRED).transform(clean.cast_trades).transform(clean.validate_trades).transform(clean.derive_trades)
    return rows.withWatermark("trade_datetime", watermark).dropDuplicatesWithinWatermark(["symbol", "agg_trade_id"])


def live_tickers(raw: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Clean quotes of a stream of raw rows, one of each (symbol, event_time) within the watermark."""
    rows = clean.drop_nulls(raw, clean.TICKER_REQUIRED).transform(clean.cast_tickers).transform(clean.validate_tickers).transform(clean.derive_tickers)
    return rows.withWatermark("event_datetime", watermark).dropDuplicatesWithinWatermark(["symbol", "event_time"])


def _within(rows: DataFrame, time: str, watermark: str | None) -> DataFrame:
    return rows.withWatermark(time, watermark) if watermark else rows


def live_bars(trades: DataFrame, label: str = "1m", watermark: str | None = WATERMARK) -> DataFrame:
    """Bars of a stream of trades; state is kept for open windows only, and trades of closed ones are late. None for trades that have a watermark."""
    return bars.ohlcv(_within(trades, "trade_datetime", watermark), label)


def live_spreads(tickers: DataFrame, label: str = "1m", watermark: str | None = WATERMARK) -> DataFrame:
    return bars.spreads(_within(tickers, "event_datetime", watermark), label)


def event_rate(trades: DataFrame, length: str = "10 seconds", step: str = "1 second", watermark: str | None = None) -> DataFrame:
    """Events a second over sliding windows, of a batch or, with a watermark, a stream."""
    seconds = int(length.split()[0])
    counted = _within(trades, "trade_datetime", watermark).groupBy(F.window("trade_datetime", length, step).alias("w")).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), "events", (F.col("events") / seconds).alias("rate"))


def sessions(trades: DataFrame, gap: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """Each symbol's runs of trades without a gap, of a batch or, with a watermark, a stream."""
    counted = _within(trades, "trade_datetime", watermark).groupBy("symbol", F.session_window("trade_datetime", gap).alias("w")).agg(F.count("*").alias("events"))
    return counted.select("symbol", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


# --- sinks -----------------------------------------------------------------------------------------


def write_raw(rows: DataFrame, path: str, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Appends rows to a table by date and symbol; without `every`, all that is available, then stops."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date", "symbol")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def write_console(rows: DataFrame, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    writer = rows.writeStream.format("console").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def each_batch(rows: DataFrame, checkpoint: str, use: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Calls `use` with every micro-batch until all that is available is read."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(use).start()


def keep_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the complete result of an aggregation as a table at `path`, replaced by each micro-batch: for small results, as all of it is state."""
    return each_batch(rows, checkpoint, lambda batch, _: batch.write.mode("overwrite").parquet(path), "complete")


def upsert_rows(rows: DataFrame, path: str, checkpoint: str, keys: list[str], day: str = "window_start") -> StreamingQuery:
    """Writes the rows that a micro-batch changed, one a key as of an aggregation, over those of the same key."""
    return each_batch(rows, checkpoint, lambda batch, _: storage.upsert(batch, path, keys, day, unique=True))


def upsert_bars(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the bars that a micro-batch changed over those of the same (symbol, window_label, window_start)."""
    return upsert_rows(rows, path, checkpoint, storage.BAR_KEY)


def changed_features(every_bar: DataFrame, changed: DataFrame) -> DataFrame:
    """The features of the changed bars and of all later bars of their symbols, from those and the LOOKBACK bars before."""
    first = changed.groupBy("symbol", "window_label").agg(F.min("window_start").alias("_first"))
    near = every_bar.join(first, ["symbol", "window_label"])
    before: Column = F.col("window_start") < F.col("_first")
    place = F.row_number().over(Window.partitionBy("symbol", "window_label", before).orderBy(F.desc("window_start")))
    tail = near.withColumn("_place", place).filter(~before | (F.col("_place") <= LOOKBACK)).drop("_place")
    return fx.all_features(tail).filter(~before).drop("_first")


def upsert_features(rows: DataFrame, bars_path: str, path: str, checkpoint: str) -> StreamingQuery:
    """upsert_bars, and the features that each micro-batch changes kept up to date at `path`; for bars of one resolution."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            storage.upsert(batch, bars_path, unique=True)
            every_bar = spark.read.parquet(bars_path).drop("date").join(batch.select("window_label").distinct(), "window_label", "left_semi")
            storage.upsert(changed_features(every_bar, batch), path, unique=True)
        finally:
            batch.unpersist()

    return each_batch(rows, checkpoint, merge)
