"""WARC archives: writing pages with revisits, and a reader that salvages damaged files.

Archives are written by Spark's text writer (any store Spark can write, with its
commit protocol, so lost tasks leave no half files): one record a line, and the
line separator is the two CRLFs that end a record. They are plain files, so
that a fault costs the record it is in and no other.

The reader takes each file's bytes, plain or gzip. It inflates member by member;
where a member fails its check, what was inflated stays, and the search goes on
at the next member's magic. In the stream a record must have a version line, a
header, its full content, its end mark and, if declared, its payload's digest;
where any of these fails, the search goes on at the next version line and the
bytes passed over are logged as a quarantined gap. Records and gaps together
account for every byte of a stream, streams and gaps for every byte of a file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tables

LEAST_REVISIT_BYTES = 100
VERSION, END, GZIP = b"WARC/1.1", b"\r\n\r\n", b"\x1f\x8b\x08"
#: A file's size as a rule, and the most that files of very long pages grow to (a longer page is a file of its own).
ARCHIVE_BYTES, MOST_BYTES = 16 << 20, 256 << 20
MOST_HEADER = 1 << 20
FOUND = "path string, start long, length long, reason string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, declared string"


def classified(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The responses (page_id, url, payload, payload_bytes, digest) and the revisits (page_id, url, refers_to, digest) among pages (page_id, url, html).

    Of equal payloads of 100 bytes or more the smallest page_id is the response
    and other ids revisit it; repeated rows of that page_id are responses too.
    Payloads whose page_ids are all null are responses.

    Only ids, urls and digests are joined. Which payloads to keep is then told
    by cells, a bitmap over hashes of digest and id: a row whose cell holds no
    revisit is a response, one whose cell holds no response goes, and only rows
    of cells that hold both are compared with the revisits one by one, dealt by
    digest and id. So payloads stay where they are, but for those of shared
    cells, whose share grows with the rows over 2**26; no task gets equal payloads for their number.
    """
    raw = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", raw.alias("payload"), F.sha2(raw.cast("binary"), 256).alias("digest"), F.octet_length(raw).cast("long").alias("payload_bytes"))
    ids = tables.written(full.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).select("page_id", "url", "digest"), "ids")
    every = tables.written(ids.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")), "digests")
    repeated = every.filter("n > 1 and least is not null")
    rows = ids.count()
    same, width = F.col("page_id").eqNullSafe(F.col("least")), tables.cell_bits(rows)
    revisits = tables.written(tables.skew_join(ids, repeated, "digest", "n", rows).filter(~same), "revisits")
    key = F.xxhash64("digest", "page_id")
    hashed = lambda df, revisit: df.select(tables.cell(key, width).alias("cell"), F.lit(revisit).alias("revisit"))
    responses = every.select("digest", F.col("least").alias("page_id"))
    held = tables.bitmap(hashed(revisits, True).unionByName(hashed(responses, False)), revisit=F.col("revisit"), response=~F.col("revisit"))
    marked = tables.with_cells(full, key, held, width)
    short = F.col("payload_bytes") < LEAST_REVISIT_BYTES
    sure = marked.filter(short | ~F.col("revisit")).drop("revisit", "response")
    both = marked.filter(~short & F.col("revisit") & F.col("response")).drop("revisit", "response")
    gone = revisits.select(F.col("digest").alias("_digest"), F.col("page_id").alias("_id")).distinct()
    left = both.join(gone, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left_anti")
    return sure.unionByName(left), revisits.select("page_id", "url", F.col("least").alias("refers_to"), "digest")


def _ident(name: str) -> Column:
    """An id as a URN; ids of any type, their text percent-encoded; null as a URN of its own."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(name).cast("string")), F.lit(">")), F.lit("<urn:no-page>"))


def _id_of(name: str, kind) -> Column:
    """The id in a URN, as a column of type `kind`; null where there is none."""
    return F.when(F.col(name).rlike("^<urn:page:[^>]*>$"), F.try_url_decode(F.regexp_extract(name, ":([^:>]*)>$", 1))).try_cast(kind)


def records(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """One WARC record a row, without its end mark, as column value."""
    line = "\r\n"

    def header(kind: str, more: list[Column], size: Column) -> Column:
        return F.concat(
            F.lit(f"{VERSION.decode()}{line}WARC-Type: {kind}{line}WARC-Record-ID: "), _ident("page_id"),
            F.lit(f"{line}WARC-Date: 1970-01-01T00:00:00Z"),
            F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x1F]", " ")), F.lit("")),
            *more,
            F.lit(f"{line}WARC-Payload-Digest: sha256:"), F.col("digest"),
            F.lit(f"{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), size, F.lit(line + line),
        )

    refers = [F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: "), _ident("refers_to")]
    whole = responses.select(F.concat(header("response", [], F.col("payload_bytes").cast("string")), F.col("payload")).alias("value"))
    return whole.unionByName(revisits.select(header("revisit", refers, F.lit("0")).alias("value")))


def write_archives(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Writes pages as WARC files of about ARCHIVE_BYTES under `path`, none over MOST_BYTES but those of one page.

    With compression `gzip` a file is one gzip stream, and a fault in it costs all that comes after.
    """
    size = pages.agg(F.avg(F.octet_length("html")), F.max(F.octet_length("html"))).first()
    per_file = max(1, min(int(ARCHIVE_BYTES / ((size[0] or 0.0) + 400)), MOST_BYTES // ((size[1] or 0) + 400)))
    writer = records(*classified(pages)).write.option("lineSep", END.decode()).option("compression", compression)
    writer.option("maxRecordsPerFile", per_file).text(path)


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Record:
    start: int
    length: int
    header: dict[str, str]
    payload: bytes = field(repr=False)


@dataclass
class Gap:
    """Quarantined bytes: `start` counts those of the file for the gzip layer, else those of the inflated stream."""

    start: int
    length: int
    reason: str


def _before_fault(member, data: bytes) -> tuple[bytes, int]:
    """(all that a decompressor makes of data up to its fault, how many bytes it took before the one at fault)."""
    out, done = bytearray(), 0
    for step in (4096, 64, 1):
        while done < len(data):
            last = member.copy()
            try:
                out += member.decompress(data[done : done + step])
            except zlib.error:
                member = last
                break
            done += step
    # the byte at fault may end several symbols: one byte of output at a time
    more, rest = b"", data[done : done + 1]
    try:
        while more or rest:
            more = member.decompress(rest, 1)
            rest = member.unconsumed_tail
            out += more
    except zlib.error:
        pass
    return bytes(out), done


def inflated(data: bytes) -> tuple[list[tuple[int, int, bytes]], list[Gap]]:
    """The streams (start, length in the file, bytes) that `data` holds, cut where a gzip member failed, and the gaps; together they are all of `data`.

    A gap reaches from the byte at fault, or of a member cut short from its start, to
    the next member. The search for that begins within the member, as a fault may show
    only after the next one's start; the gap's length is 0 then. Data that doesn't
    begin as gzip, and holds a version line before any member, is one plain stream.
    """
    if not data.startswith(GZIP[:2]):
        at, plain = data.find(GZIP), data.find(VERSION[:5])
        if at < 0 or 0 <= plain < at:
            return ([(0, len(data), data)] if data else []), []
        streams, gaps = inflated(data[at:])
        return [(a + at, n, x) for a, n, x in streams], [Gap(0, at, "no gzip member")] + [Gap(g.start + at, g.length, g.reason) for g in gaps]
    streams, gaps, at, first, now = [], [], 0, 0, bytearray()
    while at < len(data):
        member, done = zlib.decompressobj(31), at
        try:
            # in steps, so that what comes before a fault is kept; the failing one is taken again in smaller ones
            while done < len(data) and not member.eof:
                before = member.copy()
                now += member.decompress(data[done : done + 65536])
                done += 65536
            if member.eof:
                at = min(done, len(data)) - len(member.unused_data)
                if data[at : at + 3] == GZIP or at >= len(data):
                    continue
                why, lost = "no gzip member", at
                beyond = data.find(GZIP, at)
            else:
                now += member.flush()
                why, lost = "gzip member cut short", at
                beyond = data.find(GZIP, at + 1)
        except zlib.error as fault:
            more, taken = _before_fault(before, data[done : done + 65536])
            now += more
            why, lost = f"gzip: {fault}", done + taken
            beyond = data.find(GZIP, at + 1)
        beyond = len(data) if beyond < 0 else beyond
        lost = min(lost, beyond)
        streams.append((first, lost - first, bytes(now)))
        gaps.append(Gap(lost, beyond - lost, why))
        at = first = beyond
        now = bytearray()
    if first < len(data):
        streams.append((first, len(data) - first, bytes(now)))
    return streams, gaps


def _record(data: bytes, at: int) -> Record | str:
    """The record at `at`, or why there is none."""
    stop = data.find(END, at, at + MOST_HEADER)
    if stop < 0:
        return "no end of header"
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return "no version line"
    header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = header.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    start = stop + len(END)
    # a number longer than any file's size isn't even read
    beyond = start + int(length) if len(length) < 19 else len(data) + 1
    if beyond > len(data):
        return "content cut short"
    if data[beyond : beyond + len(END)] != END:
        return "no end mark"
    payload = data[start:beyond]
    declared = header.get("warc-payload-digest", "")
    if header.get("warc-type") != "revisit" and declared.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != declared[7:]:
        return "digest differs"
    return Record(at, beyond + len(END) - at, header, payload)


def parsed(stream: bytes) -> Iterator[Record | Gap]:
    """The sound records and the gaps of one stream, in order: together all its bytes."""
    at = 0
    while at < len(stream):
        found = _record(stream, at)
        if isinstance(found, str):
            beyond = stream.find(VERSION[:7], at + 1)
            beyond = len(stream) if beyond < 0 else beyond
            found = Gap(at, beyond - at, found)
        yield found
        at += found.length


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The sound records of an archive's bytes and the gaps, those of the gzip layer first. Never fails, whatever the bytes."""
    streams, gaps = inflated(data)
    yield from gaps
    for _, _, stream in streams:
        yield from parsed(stream)


def read_archives(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The records under `path` (record_id, record_type, refers_to, payload_bytes, payload_digest, declared) and the gaps (path, start, length, reason).

    Both come from one pass over the files, kept as a table. Of revisits bytes and
    digest are null; declared is the digest that the header names. A task holds one archive at a
    time; files of 2 GB or more can't be read. An empty folder gives empty results.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                out = []
                for found in salvage(content.as_py()):
                    if isinstance(found, Gap):
                        out.append((name, found.start, found.length, found.reason, *[None] * 6))
                        continue
                    header, own = found.header, found.header.get("warc-type") != "revisit"
                    size, digest = (len(found.payload), hashlib.sha256(found.payload).hexdigest()) if own else (None, None)
                    asked = [header.get(f"warc-{x}") for x in ("record-id", "type", "refers-to")]
                    out.append((name, found.start, found.length, None, *asked, size, digest, header.get("warc-payload-digest", "").removeprefix("sha256:")))
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    found = tables.written(files.mapInArrow(run, FOUND), "records")
    return found.filter("reason is null").select(*names[4:]), found.filter("reason is not null").select(*names[:4])


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of pages, read back from archives.

    page_id may be of any type that casts to text and back, and keeps it. Null html
    is an empty payload; null urls leave out the target; repeated rows
    and null page_ids each get a record; an empty table gives an empty result.
    Other columns are not read. Bytes and digest of a response come from
    the payload read; a revisit's come from the response it refers to. A gap in
    the archives just written, or a count of records other than that of rows, is an error: no row is lost in silence.
    """
    spark = pages.sparkSession
    path = f"{tables.shared_folder(spark)}/tidemark/warc-{tables.fresh()}"
    write_archives(pages, path)
    tables.forget_at_end(spark, path)
    found, gaps = read_archives(spark, path)
    lost, got, rows = gaps.count(), found.count(), pages.count()
    if lost or got != rows:
        raise RuntimeError(f"{rows} pages written to {path}, {got} records read; gaps: {lost}, the first {gaps.take(3)}")
    kind = pages.schema["page_id"].dataType
    own = found.filter("record_type = 'response'").select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    asked = found.filter("record_type = 'revisit'").select("record_id", "record_type", "refers_to", F.col("declared").alias("payload_digest"))
    # the response of a payload that many pages share meets them by broadcast
    source = own.join(asked.select(F.col("payload_digest")).distinct(), "payload_digest", "left_semi").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    target = lambda df: df.withColumn("target", F.concat_ws(" ", "refers_to", "payload_digest"))
    weights = target(asked).groupBy("target").agg(F.count("*").alias("n"))
    facts = tables.written(target(source).join(weights, "target").select("target", "payload_bytes", "n"), "sources")
    revisits = tables.skew_join(tables.written(target(asked), "revisits"), facts, "target", "n", got)
    every = own.unionByName(revisits.select(*own.columns))
    return every.select(_id_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _id_of("refers_to", kind).alias("refers_to"))


#: The same in SQL, over a table pages (page_id, html).
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM m
"""
