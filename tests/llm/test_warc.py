"""The WARC operator: exact round trips, damaged archives, plans that don't gather payloads."""

from __future__ import annotations

import gzip
import hashlib
import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from tidemark.llm import queries, tables, warc  # noqa: E402

PAGES = "page_id long, url string, html string"


def record(body: bytes, extra: bytes = b"") -> bytes:
    return b"WARC/1.1\r\nWARC-Type: response\r\n%sWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (extra, hashlib.sha256(body).hexdigest().encode(), len(body), body)


def payloads(data: bytes) -> list[bytes]:
    return [f.payload for f in warc.salvage(data) if isinstance(f, warc.Record)]


def accounted(data: bytes) -> None:
    """Streams and gaps are all of the data, records and gaps all of each stream, in order."""
    streams, gaps = warc.inflated(data)
    spans = sorted([(a, n) for a, n, _ in streams] + [(g.start, g.length) for g in gaps])
    at = 0
    for start, length in spans:
        assert start == at and length >= 0
        at += length
    assert at == len(data)
    for _, _, stream in streams:
        at = 0
        for found in warc.parsed(stream):
            assert found.start == at and found.length > 0
            at += found.length
        assert at == len(stream)


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_what_comes_before_a_fault_is_kept():
    rng = random.Random(3)
    bodies = [bytes(rng.choice(b"abcdefgh ") for _ in range(600)) for _ in range(100)]
    plain = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in bodies)
    whole = gzip.compress(plain)
    assert len(whole) < 65536
    # a trailer's checksum alone is damaged: nothing is lost, and the next member is read
    wrong = bytearray(whole)
    wrong[-6] ^= 1
    streams, gaps = warc.inflated(bytes(wrong) + whole)
    assert [x for _, _, x in streams] == [plain, plain] and len(gaps) == 1 and len(whole) - 8 <= gaps[0].start and gaps[0].start + gaps[0].length == len(whole)
    assert payloads(bytes(wrong) + whole) == bodies * 2
    # all before a block of a reserved type: a stored part, then the fault
    packer = zlib.compressobj(wbits=31)
    head = packer.compress(plain) + packer.flush(zlib.Z_FULL_FLUSH)
    assert warc.inflated(head + b"\x07" * 50) == ([(0, len(head), plain)], [warc.Gap(len(head), 50, "gzip: Error -3 while decompressing data: invalid block type")])
    # a member cut short: its span is the gap
    cut = whole + whole[:-2000]
    streams, gaps = warc.inflated(cut)
    assert plain == streams[0][2][: len(plain)] and gaps == [warc.Gap(len(whole), len(whole) - 2000, "gzip member cut short")] and len(payloads(cut)) > 190


def test_recovery_beyond_damage():
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhell%d\r\n\r\n" % i for i in range(9)]
    plain = b"".join(records)
    assert len(payloads(plain)) == 9
    for cut in (plain[:70] + b"?" + plain[71:], plain[:90] + plain[100:], b"junk" + plain):
        gaps = [f for f in warc.salvage(cut) if isinstance(f, warc.Gap)]
        assert len(payloads(cut)) >= 8 - (cut is not plain) and gaps
    members = [gzip.compress(r) for r in records]
    broken = bytearray(b"".join(members))
    broken[len(members[0]) + 20] ^= 0xFF
    assert len(payloads(bytes(broken))) >= 8
    assert len(payloads(b"".join(members)[:-20])) == 8 and list(warc.salvage(b"")) == []


@pytest.mark.parametrize("kind", ["plain", "members"])
def test_any_damage_costs_only_the_records_it_is_in(kind):
    """Bytes flipped, cut out, put in or repeated anywhere: nothing raises, all bytes are accounted for, all records away from the damage come back."""
    rng = random.Random(11)
    bodies = [b"%d:" % i + bytes(rng.choice(b"abcdefgh <>/\r\n") for _ in range(rng.randrange(300))) for i in range(60)]
    parts = [record(b) if kind == "plain" else gzip.compress(record(b)) for b in bodies]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = b"".join(parts)
    accounted(whole)
    assert payloads(whole) == bodies
    for _ in range(400):
        at = rng.randrange(len(whole))
        span = rng.choice([1, 1, 3, 40, 400])
        damaged = {
            "flip": whole[:at] + bytes(b ^ rng.randrange(1, 256) for b in whole[at : at + span]) + whole[at + span :],
            "cut": whole[:at] + whole[at + span :],
            "insert": whole[:at] + rng.randbytes(span) + whole[at:],
            "end": whole[:at],
        }[rng.choice(["flip", "cut", "insert", "end"])]
        accounted(damaged)
        sound = [b for b, a, z in zip(bodies, starts, starts[1:]) if z <= at or (a >= at + span and len(damaged) > at)]
        found = payloads(damaged)
        # a member behind the damage is found by its magic, a record by its version line
        missing = set(sound) - set(found)
        assert not missing, (kind, at, span, len(missing))


@pytest.mark.parametrize(
    "header",
    [
        b"WARC-Record-ID: <urn:page:--5>\r\n", "WARC-Record-ID: <urn:page:²>\r\n".encode(), b"WARC-Record-ID: <urn:page:%ZZ>\r\n", b"WARC-Record-ID: \xff\xfe\r\n", b": \r\n::\r\n\x00\r\n",
        b"WARC-Refers-To: <urn:page:" + b"9" * 5000 + b">\r\n",
    ],
)
def test_odd_headers_are_read(header):
    assert payloads(record(b"one") + record(b"two", header) + record(b"three")) == [b"one", b"two", b"three"]


@pytest.mark.parametrize("length", [b"9" * 5000, b"-1", "²".encode(), b"", b"1e3", b"99999999999999999999"])
def test_odd_lengths_are_quarantined(length):
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + length + b"\r\n\r\nxy\r\n\r\n"
    data = record(b"one") + bad + record(b"three")
    accounted(data)
    assert payloads(data) == [b"one", b"three"]
    assert [(g.start, g.length) for g in warc.salvage(data) if isinstance(g, warc.Gap)] == [(len(record(b"one")), len(bad))]


def test_round_trip(spark):
    long, odd = "<p>é" * 60 + "\r\n\r\nWARC/1.1\r\n", "x" * 99
    rows = [(5, "u\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", None), (2, "u", ""), (4, "u", odd), (6, "u", odd), (9, "u", long), (None, "u", long), (None, "u", odd)]
    frame = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("mine") for c in ("digest", "payload", "least", "n", "cell", "_cell", "record_id", "target")})
    got = sorted(map(str, map(tuple, warc.round_trip(frame).collect())))
    want = [(i, len((h or "").encode()), digest(h), "revisit" if h == long and i != 3 else "response", 3 if h == long and i != 3 else None) for i, _, h in rows]
    assert got == sorted(map(str, want))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    same, a, b = oracle.compare(spark, queries.QUERIES["op10_warc"], warc.SQL)
    assert same and a == b


@pytest.mark.parametrize("kind, ids", [("int", [7, 2, 5]), ("string", ["b>\r\n:é", "a b%", "c"]), ("long", [None, None, None])])
def test_ids_of_any_type_come_back(spark, kind, ids):
    rows = [(i, "u", "q" * 200) for i in ids] + [(ids[0], "u", "q" * 200)]
    out = warc.round_trip(spark.createDataFrame(rows, f"page_id {kind}, url string, html string"))
    assert dict(out.dtypes)["page_id"] == dict(out.dtypes)["refers_to"] == {"long": "bigint"}.get(kind, kind)
    least = min(ids) if ids[0] is not None else None
    want = [(i, "response" if i == least else "revisit", None if i == least else least) for i, _, _ in rows]
    assert sorted(map(str, [(r.page_id, r.record_type, r.refers_to) for r in out.collect()])) == sorted(map(str, want))


def test_responses_in_shared_cells(spark, monkeypatch):
    """With few cells most rows share one with a revisit: the rows compared one by one give the same result."""
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p" * 120), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))).alias("html"))
    monkeypatch.setattr(tables, "CELL_BITS", 7)
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 600
    for r in rows:
        again = r.page_id % 3 == 0 and r.page_id != 0
        assert (r.record_type, r.refers_to) == (("revisit", 0) if again else ("response", None))


def test_a_hot_payload_is_spread_over_the_tasks(spark):
    """Two thirds of 60,000 pages are equal: no task of the writing gets more than its part of them, and payloads aren't shuffled by digest."""
    hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    pages = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p" * 150), hot).alias("html"))
    responses, revisits = warc.classified(pages)
    assert responses.count() == 20_001 and revisits.count() == 39_999
    plan = responses._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" not in plan
    in_task = revisits.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert in_task < 20_000


def test_a_fault_in_fresh_archives_is_an_error(spark, monkeypatch):
    real = warc.write_archives

    def faulty(pages, path, **more):
        real(pages, path, **more)
        spark.createDataFrame([("WARC/1.1\r\nContent-Length: x",)], "value string").write.mode("append").text(path)

    monkeypatch.setattr(warc, "write_archives", faulty)
    with pytest.raises(RuntimeError, match="gaps: 1"):
        warc.round_trip(spark.createDataFrame([(1, "u", "x")], PAGES))


def test_gzip_archives_are_read_too(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = f"{tables.shared_folder(spark)}/warc-{tables.fresh()}"
    warc.write_archives(pages, path, "gzip")
    found, gaps = warc.read_archives(spark, path)
    assert found.count() == pages.count() and gaps.count() == 0
