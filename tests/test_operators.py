"""Operators on hand-made rows with known answers, edge cases included."""

import datetime as dt
import json
import math
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.functions import features as fx
from tidemark.operators import bars, checks, clean
from tidemark.plans import analytics as an
from tidemark.session import scratch
from tidemark.sources import market, storage
from tidemark.streaming import live, running

T0 = 1_718_017_200_000
TRADES = "symbol string, date string, trade_time long, event_time long, agg_trade_id long, price double, quantity double, is_buyer_maker boolean, trace_id string, ingestion_ts timestamp"
BARS = "symbol string, window_start timestamp, open double, high double, low double, close double, volume double, buy_volume double, sell_volume double, price_qty_sum double, trade_count long, window_label string"


def trade(i, price=100.0, qty=1.0, t=None, maker=False, symbol="btc", late=10, trace=None):
    t = T0 + 5000 * i if t is None else t
    at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=t + late)
    return (symbol, "2024-06-10", t, t + 3, i, price, qty, maker, trace or f"t{i}", at)


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADES)


def series(spark, closes, **more):
    start = dt.datetime(2024, 6, 10, 12)
    rows = [
        ("A", start + dt.timedelta(minutes=i), c, more.get("high", c), more.get("low", c), c, more.get("volume", 10.0), *more.get("sides", (5.0, 5.0)), c * 10, 1, "1m")
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, BARS)


def column(df, name):
    return [r[name] for r in df.orderBy("window_start").collect()]


@pytest.mark.parametrize("row", [trade(1, price=-1.0), trade(1, qty=0.0), trade(1, t=2_000_000_000_000), trade(1, price=1e8)])
def test_range_filter_drops(spark, row):
    assert clean.validate_trades(trades(spark, [row])).count() == 0


def test_required_columns_and_bad_casts(spark):
    rows = trades(spark, [trade(0), (None, *trade(1)[1:]), trade(2)]).withColumn("price", F.when(F.col("agg_trade_id") == 2, "junk").otherwise(F.col("price").cast("string")))
    out = clean.clean_trades(rows).collect()
    assert [(r.symbol, r.agg_trade_id, r.price_qty, r.side) for r in out] == [("BTC", 0, 100.0, "buy")]


def test_ticker_ranges_and_derived(spark):
    schema = "symbol string, event_time long, best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double, trace_id string, ingestion_ts timestamp"
    at = dt.datetime(2024, 6, 10)
    rows = spark.createDataFrame([("a", T0, 100.0, 1.0, 99.0, 1.0, "x", at), ("a", T0 + 1, 100.0, 1.0, 102.0, 1.0, "y", at), ("a", T0 + 2, 100.0, 1.0, 100.0, 1.0, "z", at)], schema)
    out = clean.clean_tickers(rows).orderBy("event_time").collect()
    assert [(r.spread, r.mid_price) for r in out] == [(2.0, 101.0), (0.0, 100.0)]


def test_dedup_keeps_earliest_with_ties(spark):
    rows = trades(spark, [trade(42, late=20, trace="b"), trade(42, late=10, trace="c"), trade(42, late=10, trace="a"), trade(1)])
    out = clean.dedup_trades(rows)
    assert sorted((r.agg_trade_id, r.trace_id) for r in out.collect()) == [(1, "t1"), (42, "a")]
    assert checks.kept_earliest(rows, out, ["symbol", "agg_trade_id"], "ingestion_ts").count() == 0


def test_bar_values(spark):
    rows = trades(spark, [trade(i, price=p) for i, p in enumerate([100.0, 105.0, 98.0, 103.0, 101.0])]).repartition(3)
    (bar,) = bars.ohlcv(clean.clean_trades(rows), "1m").collect()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume, bar.trade_count, bar.price_qty_sum, bar.sell_volume) == (100, 105, 98, 101, 5, 5, 507, 0)


def test_rolled_up_bars_equal_direct_ones(spark):
    raw = clean.clean_trades(market.synthetic_trades(spark, {"A": 100.0, "B": 7.0}, rows=400, step_ms=20_000))
    direct = bars.ohlcv(raw, "1h").select("symbol", "window_start", "open", "high", "low", "close", F.round("volume", 6).alias("v"), "trade_count")
    rolled = bars.roll_up(bars.ohlcv(raw, "1m"), "1h").select("symbol", "window_start", "open", "high", "low", "close", F.round("volume", 6).alias("v"), "trade_count")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, rolled.collect()))


def test_empty_frames(spark):
    none = clean.clean_trades(trades(spark, []))
    assert fx.all_features(bars.ohlcv(none, "1m")).count() == 0
    assert checks.duplicate_rate(trades(spark, []), ["agg_trade_id"]).first().duplicate_rate == 0


def test_features_known_answers(spark):
    assert column(fx.add_log_return(series(spark, [50.0, 100.0])), "log_return") == [None, round(math.log(2), 10)]
    out = fx.add_momentum(series(spark, [100.0] * 5 + [110.0]))
    assert column(out, "momentum")[-1] == 10.0 and column(out, "momentum_pct")[-1] == 0.1
    assert column(fx.add_buy_sell_ratio(series(spark, [1.0], sides=(75.0, 25.0))), "buy_sell_ratio") == [3.0]
    assert column(fx.add_buy_sell_ratio(series(spark, [1.0], sides=(10.0, 0.0))), "buy_sell_ratio") == [None]


def test_correlation_without_variance_is_null(spark):
    out = fx.add_return_autocorr(fx.add_log_return(series(spark, [2.0**i for i in range(8)])))
    assert column(out, "return_autocorr") == [None] * 8


def test_zscore_without_variance_is_null(spark):
    out = an.volume_anomalies(fx.add_log_return(series(spark, [1.0, 2.0, 3.0])))
    assert [r.volume_zscore for r in out.collect()] == [None] * 3


def test_first_regime_quirk(spark):
    flat = fx.add_rolling_volatility(fx.add_log_return(series(spark, [1.0, 2.0, 1.0, 2.0, 1.0])))
    assert column(an.volatility_regime(flat), "regime_duration_windows")[:2] == [1, 1]
    assert column(an.volatility_regime(flat, True), "regime_duration_windows")[:2] == [1, 2]


def test_backtest_leaves_out_the_tail(spark):
    full = fx.add_buy_sell_ratio(fx.add_log_return(series(spark, [float(i + 1) for i in range(6)], sides=(6.0, 4.0))))
    out = an.backtest_signals(full, 1.2, 3)
    assert out.count() == 2 and {r.signal for r in out.collect()} == {1} and {r.forward_direction for r in out.collect()} == {1}


def test_quality_checks(spark):
    rows = trades(spark, [trade(1), trade(1), trade(1), trade(1)])
    assert checks.duplicate_rate(rows, ["agg_trade_id"]).first().duplicate_rate == 0.75
    bad = trades(spark, [(*trade(1)[:3], T0, *trade(1)[4:]), trade(2, late=-10)])
    assert sorted(r.reason for r in checks.temporal_order(bad).collect()) == ["event_before_trade", "ingestion_before_event"]
    ids = spark.createDataFrame([("0b6f7c1e-52c0-4d6a-9f0e-0123456789ab",), ("nope",)], "trace_id string")
    assert checks.invalid_uuid4(ids).count() == 1


ENVELOPES = [
    {"stream": "x", "data": {"e": "aggTrade", "E": T0 + 9, "s": "AAA", "a": 71, "p": "12.25", "q": "0.5", "T": T0, "m": False, "z": 1}},
    {"stream": "y", "data": {"e": "bookTicker", "E": T0, "s": "AAA", "b": "12.00", "B": "3.5", "a": "14.50", "A": "2.25"}},
    {"s": "BBB", "b": "10", "B": "1", "a": "11", "A": "2"},
    {"data": {"e": "other"}},
    {},
]


def test_routing(spark):
    lines = [json.dumps(m) for m in ENVELOPES] + ["not json", "", None]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    found = market.parse_envelopes(raw).cache()
    (t,) = market.route_trades(found).collect()
    assert (t.symbol, t.agg_trade_id, t.price, t.quantity, t.trade_time, t.is_buyer_maker) == ("AAA", 71, 12.25, 0.5, T0, False)
    quotes = {r.symbol: r for r in market.route_tickers(found).collect()}
    assert quotes["AAA"].spread == 2.5 and quotes["BBB"].event_time > T0 and set(quotes) == {"AAA", "BBB"}
    assert {r.kind: r["count"] for r in market.classify(raw).groupBy("kind").count().collect()} == {"trade": 1, "ticker": 2, "unknown": 2, "malformed": 3}
    # every row has an id of its own, and an arrival
    ids = market.route_trades(market.parse_envelopes(raw.unionByName(raw))).select("trace_id", "ingestion_ts").collect()
    assert len({r.trace_id for r in ids}) == 2 and checks.invalid_uuid4(spark.createDataFrame([(r.trace_id,) for r in ids], "trace_id string")).count() == 0


def closes(spark, path):
    return sorted(r.close for r in spark.read.parquet(path).collect())


def test_upsert_leaves_what_it_is_not_given(spark):
    path = scratch(spark, "bars")
    day = series(spark, [1.0, 2.0, 3.0, 4.0])
    storage.upsert(day, path)
    later = day.withColumns({"window_start": F.col("window_start") + F.expr("INTERVAL 2 DAYS"), "close": F.col("close") + 10})
    storage.upsert(later, path)
    storage.upsert(day.limit(1).withColumn("close", F.lit(9.0)), path)
    assert closes(spark, path) == [2.0, 3.0, 4.0, 9.0, 11.0, 12.0, 13.0, 14.0]
    # a column that one side lacks, a null key, an empty frame, another resolution of the same day
    storage.upsert(day.limit(1).withColumns({"extra": F.lit("x"), "close": F.lit(8.0)}), path)
    storage.upsert(day.withColumn("symbol", F.lit(None).cast("string")), path)
    storage.upsert(day.limit(0), path)
    storage.upsert(day.limit(1).withColumn("window_label", F.lit("5m")), path)
    assert closes(spark, path) == [1.0, 2.0, 3.0, 4.0, 8.0, 11.0, 12.0, 13.0, 14.0]
    storage.replace_days(day.limit(1).withColumn("close", F.lit(7.0)), path)
    assert closes(spark, path) == [1.0, 7.0, 11.0, 12.0, 13.0, 14.0]


def test_upsert_takes_the_newest_of_a_key(spark):
    day = series(spark, [1.0])
    both = day.withColumn("version", F.lit(1)).unionByName(day.withColumns({"close": F.lit(5.0), "version": F.lit(2)})).unionByName(day.withColumns({"close": F.lit(3.0), "version": F.lit(2)}))
    path = scratch(spark, "bars")
    storage.upsert(both.repartition(3), path, newest="version")
    assert closes(spark, path) == [3.0]


def test_upsert_and_range_reads_prune_partitions(spark):
    path = scratch(spark, "bars")
    assert storage.read_bars(spark, path, "1m", "2024-06-10", "2024-06-11") is None
    day = series(spark, [1.0, 2.0, 3.0])
    for n in range(4):
        storage.upsert(day.withColumn("window_start", F.col("window_start") + F.expr(f"INTERVAL {n} DAYS")), path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = storage.read_bars(spark, path, "1m", "2024-06-11 12:01:00", "2024-06-12 12:01:00")
    assert found.count() == 3 and "PartitionFilters: [isnotnull(window_label" in plan(found) and "2024-06-11" in plan(found).split("PartitionFilters")[1][:300]
    touched = plan(storage.touched(spark, path, "2024-06-11", "2024-06-12"))
    assert "2024-06-11" in touched.split("PartitionFilters")[1][:200] and storage.touched(spark, path, "2024-06-11", "2024-06-12").count() == 6
    assert storage.read_bars(spark, path, "5m", "2024-06-10", "2024-06-20").count() == 0


def test_published_tables_are_made_migrated_and_written(spark):
    root, prefix = scratch(spark, "schema"), "t_" + scratch(spark, "x").rsplit("-", 1)[1][:8] + "_"
    assert storage.apply_schema(spark, storage.schema(prefix, root)) == len(storage.TABLES) == storage.apply_schema(spark, storage.schema(prefix, root))
    try:
        for table, columns in storage.TABLES.items():
            found = dict(spark.table(prefix + table).dtypes)
            want = dict(c.split() for c in columns.split(", "))
            assert {c: found[c] for c in want} == want and set(found) <= {*want, "date"}
        assert len(storage.FEATURE_TABLE) == 28
        name, path = prefix + "features_by_window", f"{root}/features_by_window"
        bar = fx.all_features(series(spark, [1.0, 2.0]))
        storage.upsert(storage.feature_rows(bar), path)
        spark.sql(f"MSCK REPAIR TABLE {name}")
        assert spark.table(name).count() == 2 and spark.table(name).filter("obi is null and window_end is null").count() == 2
        storage.migrate_features(spark, name, path)
        assert spark.table(name).count() == 0
    finally:
        for table in storage.TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {prefix}{table}")


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    base = {"A": 100.0, "B": 7.0}
    for made, n in ((market.synthetic_trades, 200), (market.synthetic_tickers, 300)):
        rows = made(spark, base).collect()
        assert len(rows) == 2 * n and sorted(rows) == sorted(made(spark, base).repartition(7).collect()) and len({r.trace_id for r in rows}) == 2 * n
        assert sorted(rows) != sorted(made(spark, base, seed=1).collect())
    quotes = market.synthetic_tickers(spark, base)
    assert clean.clean_tickers(quotes.withColumn("ok", F.lit(1))).count() == 600 and quotes.filter("spread < 0.5 or spread > 5 or date <> '2024-06-10'").count() == 0
    steps = [r.d for r in quotes.selectExpr("symbol", "ln((best_bid_price + best_ask_price) / 2) - ln(lag((best_bid_price + best_ask_price) / 2) over (partition by symbol order by event_time)) as d").filter("symbol = 'A' and d is not null").collect()]
    assert 0.5e-4 < (sum(d * d for d in steps) / len(steps)) ** 0.5 < 2e-4


def test_liquidity_text(spark):
    rows = spark.createDataFrame([("A", 2.0, 1.0, "TIGHTER"), ("B", 1.0, 1.5, "WIDER"), ("C", 1.0, 1.0, "EQUAL"), ("D", None, 1.0, "UNKNOWN")], "symbol string, spread_q1 double, spread_q4 double, verdict string")
    text = {r.symbol: r.text for r in an.liquidity_text(rows).collect()}
    assert "50.00 % tighter" in text["A"] and "50.00 % wider" in text["B"] and "same" in text["C"] and "no spread" in text["D"]


def test_kpis_of_a_day(spark):
    full = fx.all_features(series(spark, [10.0, 11.0, 12.5])).withColumns({"spread_mean": F.lit(1.0), "obi": F.lit(0.0)})
    (row,) = an.feature_kpis(full, ["A"]).collect()
    assert (row.first_close, row.last_close, row.day_return_pct, row.windows, row.dominant_regime) == (10.0, 12.5, 25.0, 3, "UNKNOWN")
    plan = an.feature_kpis(full, ["A"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 1


def test_regimes_come_from_one_pass_over_the_features(spark):
    plan = an.volatility_regime(fx.all_features(series(spark, [1.0, 2.0, 3.0])))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(symbol") == 1


def test_statements_and_documents(spark):
    assert storage.statements("-- a\nCREATE X; -- b\n;\nDROP Y") == ["CREATE X", "DROP Y"]
    out = storage.documents(series(spark, [1.0, 2.0]).select("symbol", "window_start", "close")).first()
    assert [r["close"] for r in json.loads(out.records)] == [1.0, 2.0]
    assert storage.records(series(spark, [1.0, 2.0, 3.0]), 2)[0]["symbol"] == "A"


def line(i, ms, kind=None, **more):
    return json.dumps({"data": ENVELOPES[0]["data"] | {"a": i, "T": T0 + ms, "E": T0 + ms} | ({"e": kind} if kind else {}) | more})


def put(spark, folder, lines):
    """One more file in the folder of messages."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)


def test_latency_marks_are_exact_above_a_hundred_thousand_rows(spark):
    n = 400_000
    at = F.lit(T0) + F.col("id")
    # (id * 7919) % n takes every value below n once
    rows = spark.range(n, numPartitions=7).select(
        F.lit("A").alias("symbol"), at.alias("trade_time"), (at + F.col("id") * 7919 % n).alias("event_time"), F.timestamp_millis(at + F.col("id") * 7919 % n + 1000).alias("ingestion_ts")
    )
    marks = [n // 100 * percent - 1 for percent in (50, 95, 99)]
    assert [tuple(r) for r in an.latency(rows, exact=True).collect()] == [("A", *marks, *(m + 1000 for m in marks), n)]


def test_latency_of_few_rows_takes_the_nearest_rank(spark):
    rows = trades(spark, [trade(i, t=T0, late=late, symbol=symbol) for i, (symbol, late) in enumerate([("A", 50), ("A", 10), ("A", 30), ("A", 20), ("A", 40), ("B", 7)])])
    unarrived = F.when(F.col("symbol") == "A", F.col("ingestion_ts"))
    early = rows.withColumn("event_time", F.col("trade_time") - 1)
    found = an.latency(rows.withColumn("ingestion_ts", unarrived).unionByName(early), exact=True)
    assert sorted(tuple(r) for r in found.collect()) == [("A", 3, 3, 3, 30, 50, 50, 5), ("B", 3, 3, 3, None, None, None, 1)]


def test_streamed_files_to_table_and_bars(spark):
    folder = scratch(spark, "live")
    put(spark, f"{folder}/in", [line(i, 1000 * i) for i in (0, 1, 1, 2)])
    rows = live.live_trades(market.route_trades(live.messages(spark, f"{folder}/in")))
    live.write_raw(rows, f"{folder}/raw", f"{folder}/state", None).awaitTermination()
    assert spark.read.parquet(f"{folder}/raw").count() == 3 and market.scan_day(spark, f"{folder}/raw", "2024-06-10").count() == 3
    stream = clean.derive_trades(clean.validate_trades(market.route_trades(live.messages(spark, f"{folder}/in"))))
    for state in ("s1", "s2"):  # the same rows again change nothing
        live.upsert_bars(live.live_bars(stream, "1m"), f"{folder}/bars", f"{folder}/{state}").awaitTermination()
    assert [r.trade_count for r in spark.read.parquet(f"{folder}/bars").collect()] == [4]


def derived(spark, folder):
    return clean.derive_trades(clean.validate_trades(market.route_trades(live.messages(spark, folder, 1))))


def test_late_rows_are_left_out_once_their_window_is_closed(spark):
    folder, minute = scratch(spark, "late"), 60_000
    bars_of = lambda: {(r.window_start.minute, r.trade_count) for r in spark.read.parquet(f"{folder}/bars").collect()}
    drain = lambda: live.upsert_bars(live.live_bars(derived(spark, f"{folder}/in"), "1m"), f"{folder}/bars", f"{folder}/state").awaitTermination()
    put(spark, f"{folder}/in", [line(1, 0), line(2, 12 * minute)])
    drain()
    assert bars_of() == {(0, 1), (12, 1)}
    # nine minutes behind the latest is within the watermark, twelve isn't any more
    put(spark, f"{folder}/in", [line(3, 3 * minute), line(4, 0), line(5, 12 * minute)])
    drain()
    assert bars_of() == {(0, 1), (3, 1), (12, 2)}


def test_a_row_seen_again_within_the_watermark_is_dropped(spark):
    folder, minute = scratch(spark, "again"), 60_000
    for lines in ([line(1, 0), line(1, 0), line(2, 1000)], [line(1, 0), line(2, 1000), line(3, 30 * minute)], [line(3, 30 * minute)]):
        put(spark, f"{folder}/in", lines)
        rows = live.live_trades(market.route_trades(live.messages(spark, f"{folder}/in", 1)))
        live.write_raw(rows, f"{folder}/raw", f"{folder}/state", None).awaitTermination()
    assert sorted(r.agg_trade_id for r in spark.read.parquet(f"{folder}/raw").collect()) == [1, 2, 3]


def test_features_follow_a_stream(spark):
    folder, minute = scratch(spark, "features"), 60_000
    prices = [round(10 + math.sin(i) + i / 50, 3) for i in range(60)]
    for part in (range(0, 25), range(25, 26), range(26, 60), range(59, 60)):
        put(spark, f"{folder}/in", [line(100 * k + i, i * minute + k, p=str(prices[i] + k)) for i in part for k in (0, 1)])
        found = live.live_bars(derived(spark, f"{folder}/in"), "1m")
        live.upsert_features(found, f"{folder}/bars", f"{folder}/table", f"{folder}/state").awaitTermination()
    whole = fx.all_features(spark.read.parquet(f"{folder}/bars").drop("date"))
    kept = spark.read.parquet(f"{folder}/table").select(whole.columns)
    as_rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert kept.count() == 60 and as_rows(kept) == as_rows(whole)


def test_sliding_and_session_windows_on_a_stream(spark):
    folder, minute = scratch(spark, "windows"), 60_000
    put(spark, f"{folder}/in", [line(1, 0), line(2, 3000)])
    put(spark, f"{folder}/in", [line(3, 4 * minute), line(4, 10 * minute)])
    live.upsert_rows(live.event_rate(derived(spark, f"{folder}/in"), watermark="10 minutes"), f"{folder}/rate", f"{folder}/s1", ["window_start"]).awaitTermination()
    rate = spark.read.parquet(f"{folder}/rate")
    assert rate.agg(F.sum("events")).first()[0] == 40 and rate.agg(F.max("events")).first()[0] == 2
    live.keep_table(live.sessions(derived(spark, f"{folder}/in"), watermark="10 minutes"), f"{folder}/sessions", f"{folder}/s2").awaitTermination()
    assert sorted(r.events for r in spark.read.parquet(f"{folder}/sessions").collect()) == [1, 3]


def test_counters_sum_every_message_by_outcome(spark):
    folder, counters = scratch(spark, "counts"), live.Counters()
    put(spark, f"{folder}/in", [line(1, 0), line(2, 5), "broken", line(3, 0, "other")])
    put(spark, f"{folder}/in", ["{", line(4, 9), json.dumps(ENVELOPES[1])])
    spark.streams.addListener(counters)
    try:
        raw = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{folder}/in")
        seen = live.observed(market.classify(raw), "feed")
        live.write_console(seen.select("kind"), f"{folder}/state", None).awaitTermination()
        for _ in range(100):
            if counters.totals.get("feed", {}).get("received") == 7:
                break
            time.sleep(0.1)
        assert dict(counters.totals["feed"]) == {"received": 7, "trade": 3, "ticker": 1, "unknown": 1, "malformed": 2}
    finally:
        spark.streams.removeListener(counters)


def test_a_failing_query_is_restarted_with_growing_pauses(spark):
    folder, pauses, starts = scratch(spark, "restart"), [], []
    put(spark, f"{folder}/in", [line(i, 1000 * i) for i in range(3)])

    def start(fail_first):
        starts.append(1)
        n = len(starts)

        def use(batch, _):
            if n <= fail_first:
                raise ValueError("a fault of the sink")
            batch.select("agg_trade_id").write.mode("append").parquet(f"{folder}/out{fail_first}")

        return live.each_batch(derived(spark, f"{folder}/in"), f"{folder}/state{fail_first}", use, "append")

    assert running.kept_running(lambda: start(3), pause=pauses.append) == 3 and pauses == [2.0, 4.0, 8.0]
    assert spark.read.parquet(f"{folder}/out3").count() == 3
    pauses.clear(), starts.clear()
    with pytest.raises(StreamingQueryException):
        running.kept_running(lambda: start(99), most=2, longest=3.0, pause=pauses.append)
    assert pauses == [2.0, 3.0] and len(starts) == 3


def test_a_periodic_job_goes_on_after_failures_and_time_limits(spark):
    def slow():
        spark.range(10).repartition(1).foreach(lambda _: time.sleep(3))

    def bad():
        raise ValueError("no")

    jobs = iter([bad, slow, lambda: spark.range(5).count()])
    began = time.monotonic()
    assert list(running.every(spark, lambda: next(jobs)(), period=0.2, limit=2.0, runs=3)) == ["failed", "stopped", "ok"]
    assert time.monotonic() - began < 25


def test_exports_and_console_tables(spark, capsys):
    path = scratch(spark, "export")
    assert storage.exported(spark, path) is None
    for rows in ([1.0, 2.0, 3.0], [5.0]):
        storage.export(series(spark, rows), path)
        assert sorted(r.close for r in storage.exported(spark, path).collect()) == rows
    storage.show(series(spark, [1.0, 2.0]).select("symbol", "close"), "bars", 1)
    printed = capsys.readouterr().out
    assert printed.startswith("bars\n") and "|A     |1.0  |" in printed and "only showing top 1 row" in printed
