"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct 5-word shingles; two link when their Jaccard
similarity reaches the threshold (100 * intersection >= 75 * union). Exact:
every pass covers all rows, nothing is capped, every link found is verified on
whole sets and no link between different classes is missed.

1. `scan`: each document's set size and 64-bit set key ("node"), and the cells
   its shingles fall in. Documents with equal sets share a node, so copies never
   meet as pairs.
2. `frequency_levels`: how often each shingle occurs, as 2**26 four-bit levels
   (32 MB at any input size). It only orders shingles, rare first; any order
   gives the same links.
3. Prefixes: if two sets share t shingles, the first |x| - t + k of each, in one
   global order, share at least k. Each document picks its own k from 1 to 4 by
   estimated cost (posting lists read, plus candidates bounded by list lengths
   over k), so a prefix that meets long lists is lengthened and then needs more
   shared tokens; a pair needs the smaller of its two k.
4. Linking: within a token's list, nodes are first tried against one centre (the
   node whose tokens are shared most), one best centre per node, and verified
   links give components. Only pairs of components whose nodes share enough of
   their prefixes are then tested, chunk against chunk, so a large group of near
   copies costs its size, not its square, while every possible link between
   components is still tested.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tables, textops
from tidemark.llm.tables import components, roots

PERCENT = 75
MAX_MATCH = 4
VERIFY_COST = 16.0
CELL_BITS, RANGE_BITS = 26, 10
#: Lists of tokens of this level or more (about 4,096 documents) are dealt over groups of about LONG_PART entries.
LONG_LEVEL, LONG_PART = 12, 100_000
#: Sizes of sets are taken in bands, each up to this many times as wide as its lowest.
BAND = 1.05
_U = np.uint64


def _least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def scan(docs: DataFrame) -> DataFrame:
    """What one pass over the texts gathers, in two kinds of rows.

    part null: doc_id, a hash of the text, n_shingles and node (null for an empty set) of a document.
    Else: the lower bits, two bytes each, of the cells in one range that
    shingles of the task's documents fall in; copies within a task count once.
    """
    low_bits = CELL_BITS - RANGE_BITS
    schema = tables.schema_with(docs, ["doc_id"], "text_hash long, n_shingles long, node long, part int, cells binary")

    def run(batches):
        held, count, seen, kind = [], 0, set(), pa.int64()

        def flush():
            at = np.sort(np.concatenate(held))
            cuts = np.searchsorted(at, np.arange(1 << RANGE_BITS, dtype=np.uint32) << low_bits).tolist() + [len(at)]
            low = (at & ((1 << low_bits) - 1)).astype(np.uint16)
            parts = [i for i in range(1 << RANGE_BITS) if cuts[i] < cuts[i + 1]]
            blobs = [low[cuts[i] : cuts[i + 1]].tobytes() for i in parts]
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(parts), kind), none, none, none, pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names)

        names = schema.names
        for batch in batches:
            kind = batch.column("doc_id").type
            size, node = [0] * len(batch), [None] * len(batch)
            for row, found in textops.shingle_sets(batch.column("text")):
                if not len(found):
                    continue
                size[row], node[row] = len(found), textops.set_key(found)
                if node[row] not in seen:
                    seen.add(node[row])
                    held.append((found >> _U(64 - CELL_BITS)).astype(np.uint32))
                    count += len(found)
                    if count > 2_000_000:
                        yield flush()
                        held, count, seen = [], 0, set()
            ids = [batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int64()), pa.array(node, pa.int64())]
            yield pa.RecordBatch.from_arrays([*ids, pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())], names)
        if count:
            yield flush()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(textops.released(run), schema)


def frequency_levels(scanned: DataFrame) -> np.ndarray:
    """Four-bit levels, two a byte, of how many documents have a shingle of each cell.

    Level = floor(log2(1 + count)), 15 at most; a cell is the top CELL_BITS of a
    shingle's hash. Ranges of cells are summed as streams, so the memory of a
    task is its ranges' counters, whatever the input's size.
    """
    low_bits = CELL_BITS - RANGE_BITS

    def levels(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("cells")):
                counted = sums.setdefault(part, np.zeros(1 << low_bits, np.uint32))
                counted += np.bincount(np.frombuffer(blob.as_buffer(), np.uint16), minlength=1 << low_bits).astype(np.uint32)
        for part, counted in sums.items():
            level = np.minimum(15, np.log2(counted + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([(level[::2] | level[1::2] << 4).tobytes()], pa.binary())], ["part", "cells"]
            )

    parts = scanned.filter("part is not null").select("part", "cells")
    tasks = max(16, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(1 << (CELL_BITS - 1), np.uint8)
    width = 1 << (low_bits - 1)
    # in one job: at most 2**RANGE_BITS rows, 32 MB in all
    held = parts.repartition(tasks, "part").mapInArrow(textops.released(levels), "part int, cells binary").toArrow()
    for part, blob in zip(held.column("part").to_pylist(), held.column("cells")):
        out[part * width : (part + 1) * width] = np.frombuffer(blob.as_buffer(), np.uint8)
    return out


def ordered_tokens(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's tokens in the global order: level in the top four bits, then the hash."""
    cell = found >> _U(64 - CELL_BITS)
    level = (levels[(cell >> _U(1)).astype(np.int64)] >> ((cell & _U(1)) << _U(2)).astype(np.uint8)) & np.uint8(15)
    return np.sort((level.astype(np.uint64) << _U(60)) | (found >> _U(4)))


def choose_prefix(tokens: np.ndarray, percent: int) -> tuple[int, int]:
    """(prefix length, shared tokens it asks for) of least estimated cost."""
    n = len(tokens)
    base = n - _least_overlap(n, percent)
    frequency = np.exp2((tokens >> _U(60)).astype(np.float64))
    read = np.cumsum(frequency)
    best = (math.inf, 0, 0)
    for match in range(1, min(MAX_MATCH, n - base) + 1):
        scan = read[base + match - 1]
        best = min(best, (scan + VERIFY_COST * (scan - (base + match)) / match, base + match, match))
    return best[1], best[2]


_POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("size", "<u4"), ("match", "u1"), ("spread", "u1")])


def postings(docs: DataFrame, levels, percent: int, buckets: int, long_parts: int) -> DataFrame:
    """(bucket, blob): packed postings of every document's prefix, by token."""

    def run(batches):
        table = levels.value
        held, count, seen = [], 0, set()

        def flush():
            rows = np.concatenate(held)
            bucket = rows["token"] % _U(buckets)
            long = rows["token"] >> _U(60) >= LONG_LEVEL
            bucket = bucket.astype(np.int64) * long_parts + np.where(long, textops.mix(rows["node"].view(np.uint64)) % _U(long_parts), 0).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows[order]
            keys, cuts = np.unique(bucket, return_index=True)
            cuts = [*cuts.tolist(), len(rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                ["bucket", "blob"],
            )

        for batch in batches:
            for _, found in textops.shingle_sets(batch.column("text")):
                if not len(found) or (key := textops.set_key(found)) in seen:
                    continue
                seen.add(key)
                tokens = ordered_tokens(found, table)
                length, match = choose_prefix(tokens, percent)
                rows = np.empty(length, _POSTING)
                rows["token"], rows["node"], rows["size"], rows["match"] = tokens[:length], key, len(found), match
                rows["spread"] = int(16 * (tokens[:length] >> _U(60)).mean())
                held.append(rows)
                count += length
                if count > 500_000:
                    yield flush()
                    held, count, seen = [], 0, set()
        if count:
            yield flush()

    return docs.select("text").mapInArrow(textops.released(run), "bucket long, blob binary")


def shared_lists(packed: DataFrame) -> DataFrame:
    """(token, node, size, match, centre) of the lists with two nodes or more.

    The centre is the node whose prefix is most widely shared, ties to the
    smallest: of a text and its edited copies, mostly the text itself.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _POSTING) for x in table.column("blob")])
        rows = rows[np.lexsort((rows["node"], 255 - rows["spread"], rows["token"]))]
        same = (rows["token"][1:] == rows["token"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
        rows = rows[np.concatenate(([True], ~same))]
        first = np.concatenate(([True], rows["token"][1:] != rows["token"][:-1]))
        start = np.flatnonzero(first)
        length = np.diff(np.concatenate((start, [len(rows)])))
        centre = np.repeat(rows["node"][start], length)
        keep = np.repeat(length > 1, length) | (rows["token"] >> _U(60) >= LONG_LEVEL)
        rows, centre = rows[keep], centre[keep]
        return pa.table(
            {
                "token": rows["token"].copy().view(np.int64),
                "node": rows["node"].copy(),
                "size": rows["size"].astype(np.int32),
                "match": rows["match"].astype(np.int32),
                "centre": centre.copy(),
            }
        )

    return packed.groupBy("bucket").applyInArrow(run, "token long, node long, size int, match int, centre long")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text) of each needed node, from one document that has it.

    A bitmap of the needed nodes' leading bits (8 MB at any size) keeps most
    other texts out of the join's shuffle; the join itself decides.
    """
    bits = 26
    at = F.shiftrightunsigned("node", 64 - bits)
    words = needed.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - bits}) & 63 as int))")).alias("bits")
    )
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    held = words.toArrow()
    bitmap[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    del bitmap, held
    textops.release()

    def run(batches):
        have, seen = shared.value.view(np.uint64), set()
        for batch in batches:
            rows, nodes = [], []
            for row, found in textops.shingle_sets(batch.column("text")):
                if not len(found) or (key := textops.set_key(found)) in seen:
                    continue
                cell = (key & (1 << 64) - 1) >> (64 - bits)
                if int(have[cell >> 6]) >> (cell & 63) & 1:
                    seen.add(key)
                    rows.append(row)
                    nodes.append(key)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), batch.column("text").take(pa.array(rows, pa.int64()))], ["node", "text"]
                )

    found = docs.select("text").mapInArrow(textops.released(run), "node long, text string")
    return found.join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = tables.written(_texts(docs, needed), "texts")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sides = []
                for name in ("text_a", "text_b"):
                    coded = part.column(name).dictionary_encode()
                    sets = dict(textops.shingle_sets(coded.dictionary))
                    sides.append([sets[i] for i in coded.indices.to_pylist()])
                keep = []
                for x, y in zip(*sides):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return tables.written(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(textops.released(run), "a long, b long"), "links")


def _asked(own: tuple[str, str, str], other: tuple[str, str, str], percent: int) -> str:
    """SQL for the prefix tokens that sets of sizes low to high, with prefixes of `match` or more, share if they are linked; a side is (low, high, match)."""
    rest = [f"((({high}) * {percent} + 99) div 100 - {match})" for _, high, match in (own, other)]
    overlap = f"(({percent} * ({own[0]} + {other[0]}) + {99 + percent}) div {100 + percent})"
    return f"greatest(1, least({own[2]}, {other[2]}), {overlap} - greatest({rest[0]}, {rest[1]}))"


def _entering(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join for the pairs of components that could still be linked, by token and pair of bands.

    A pair of nodes with enough overlap shares a certain number of prefix
    tokens: of the two prefixes, the one that ends first in the global order has
    all it shares inside the other's; beyond it lie at most the rest of its own
    set. At the first token that the pair shares, each node must have that
    many of its shared tokens left ("slack"). Within a list each component
    enters once for each band of sizes, by the bounds of its nodes there.

    Bands of sizes are joined band by band, and what an entry must have left
    against any partner of a band is asked before the join: of many texts that share
    boilerplate but too little of it, none enters the join, so the join's rows
    follow the candidates and not the square of a list. The bands are fewer than 900 for
    any sizes, so their bounds may be collected and sent to every task.
    """
    of_node = Window.partitionBy("node")
    slack = F.count("*").over(of_node) - F.row_number().over(of_node.orderBy("token")) + 1
    entries = (
        lists.withColumn("slack", slack)
        .withColumn("band", F.floor(F.log(BAND, F.col("size"))))
        .groupBy("token", "component", "band")
        .agg(F.max("slack").alias("slack"), F.min("size").cast("long").alias("low"), F.max("size").cast("long").alias("high"), F.min("match").alias("match"))
    )
    entries = tables.written(entries, "entries")
    bands = sorted(tuple(r) for r in entries.groupBy("band").agg(F.min("low"), F.max("high"), F.min("match")).collect())
    pairs = [(x, y) for i, x in enumerate(bands) for y in bands[i:] if 100 * x[2] >= percent * y[1]]
    columns = ("component", "slack", "low", "high", "match")

    def side(name: str, own: int) -> DataFrame:
        """The entries that have enough left against some partner of the other band, once for each pair of bands."""
        facts = [(n, pair[own][0], *pair[1 - own][1:], pair[0] == pair[1]) for n, pair in enumerate(pairs)]
        facts = lists.sparkSession.createDataFrame(facts, "pair int, band long, o_low long, o_high long, o_match int, equal boolean")
        left = entries.join(F.broadcast(facts), "band").filter(f"slack >= {_asked(('low', 'high', 'match'), ('o_low', 'o_high', 'o_match'), percent)}")
        return left.select("token", "pair", *(["equal"] if own == 0 else []), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    return side("x", 0), side("y", 1)


def _open_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(x, y): the pairs of components that could still be linked; `lists` has token, node, size, match, component."""
    x, y = _entering(lists, percent)
    sides = [tuple(f"{c}_{name}" for c in ("low", "high", "match")) for name in "xy"]
    sizes = f"100 * high_x >= {percent} * low_y and 100 * high_y >= {percent} * low_x"
    order = "case when equal then component_x < component_y else component_x <> component_y end"
    fits = f"{order} and {sizes} and least(slack_x, slack_y) >= {_asked(*sides, percent)}"
    joined = x.join(y, ["token", "pair"]).filter(fits)
    return joined.select(F.least("component_x", "component_y").alias("x"), F.greatest("component_x", "component_y").alias("y")).distinct()


HOST_CHUNK, GUEST_CHUNK, GROUP_ROWS = 64, 256, 1500
#: Most shingles of a chunk's and of a group's texts, but for a single text that has more.
CHUNK_SHINGLES, GROUP_SHINGLES = 100_000, 400_000


def _linked_components(pairs: DataFrame, lists: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of components of which some nodes are linked, from candidate pairs (x, y).

    The larger component of a pair is the host of the other's nodes. Host nodes
    and all guests of a host meet chunk by chunk, with their whole texts, so a
    large component is sent once for every chunk of guests, and a guest once
    for every chunk of host nodes, instead of a row for each pair of nodes. Chunks
    are bounded in nodes and in shingles.
    """
    nodes = tables.written(lists.select("component", "node", "size").distinct(), "nodes")
    chunks = lambda n, size, most: F.ceil(F.greatest(F.col(n) / most, F.col(size) / CHUNK_SHINGLES)).cast("int")
    count = tables.written(nodes.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "sizes")
    sized = pairs.join(count.select(F.col("component").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx")), "x").join(count.select(F.col("component").alias("y"), F.col("n").alias("ny"), F.col("s").alias("sy")), "y")
    first = F.col("nx") >= F.col("ny")
    either = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    placed = tables.written(sized.select(either("x", "y", "host"), either("y", "x", "guest"), either("nx", "ny", "host_n"), either("sx", "sy", "host_s")), "placed")
    guests = placed.join(nodes.select(F.col("component").alias("guest"), "node", "size"), "guest")
    hosts = guests.groupBy("host").agg(F.max("host_n").alias("host_n"), F.max("host_s").alias("host_s"), F.count("*").alias("guest_n"), F.sum("size").alias("guest_s"))
    hosts = hosts.select("host", chunks("host_n", "host_s", HOST_CHUNK).alias("h_parts"), chunks("guest_n", "guest_s", GUEST_CHUNK).alias("g_parts"))
    # read from a table, so that both sides of the joins below are plain shuffles, whose skewed partitions adaptive execution splits
    hosts = tables.written(hosts, "hosts")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = hosts.join(nodes.select(F.col("component").alias("host"), "node", "size"), "host")
    rows = (
        own.select("host", F.lit(None).cast("long").alias("guest"), "node", "size", part("h_parts").alias("h"), every("g_parts").alias("g"))
        .unionByName(guests.join(hosts, "host").select("host", "guest", "node", "size", part("g_parts").alias("g"), every("h_parts").alias("h")))
    )
    rows = tables.written(rows, "rows")
    texts = _texts(docs, rows.select("node").distinct())
    n, shingles = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(64, n // GROUP_ROWS, shingles // GROUP_SHINGLES)

    def run(group: pa.Table) -> pa.Table:
        coded = group.column("text").combine_chunks().dictionary_encode()
        sets = dict(textops.shingle_sets(coded.dictionary))
        text, guest = coded.indices.to_numpy(), group.column("guest").fill_null(0).to_numpy()
        is_host = np.array(group.column("guest").is_null())
        keys = np.stack([group.column(c).to_numpy() for c in ("host", "h", "g")])
        order = np.lexsort(keys)
        new = np.concatenate(([True], (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(0)))
        found = set()
        for cell in np.split(order, np.flatnonzero(new)[1:]):
            host, asks = cell[is_host[cell]], cell[~is_host[cell]]
            if not len(host) or not len(asks):
                continue
            size = np.array([len(sets[t]) for t in text[host]])
            all_tokens = np.concatenate([sets[t] for t in text[host]])
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            for g in asks:
                edge = (int(keys[0, g]), int(guest[g]))
                mine = sets[text[g]]
                at = np.minimum(np.searchsorted(mine, all_tokens), len(mine) - 1)
                both = np.add.reduceat(mine[at] == all_tokens, starts, dtype=np.int64)
                if (100 * both >= percent * (size + len(mine) - both)).any():
                    found.add(edge)
        return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})

    dealt = rows.join(texts, "node").withColumn("bucket", F.pmod(F.xxhash64("host", "h", "g"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def links(docs: DataFrame, scanned: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of nodes linked with another node; `scanned` is a written scan()."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(frequency_levels(scanned))
    textops.release()
    total, sets = scanned.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("node")).first()
    buckets = max(64, int(total * (101 - percent) / 100 // 200_000))
    lists = tables.written(shared_lists(postings(docs, levels, percent, buckets, max(64, sets // LONG_PART))), "lists")

    near = lists.filter("node != centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    best = near.groupBy("node").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"))
    first = verified(best.select(F.col("node").alias("a"), F.col("centre").alias("b")), docs, percent)
    known = tables.written(roots(first.select(F.col("a").alias("node"), F.col("b").alias("up"))), "known")

    placed = lists.select("token", "node", "size", "match").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    lists_open = tables.written(placed.join(mixed, "token", "left_semi"), "open")
    pairs = tables.written(_open_pairs(lists_open, percent), "pairs")
    if pairs.isEmpty():
        return known
    second = _linked_components(pairs, lists_open, docs, percent)
    joined = tables.written(components(second), "joined")
    placed = known.join(joined.withColumnRenamed("component", "to").withColumnRenamed("node", "component"), "component", "left")
    return placed.select("node", F.coalesce("to", "component").alias("component")).unionByName(joined.join(known, "node", "left_anti"))


def join_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, node, component_id, text_hash) for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable by links, itself included; doc_id keeps its type.
    Null or wordless texts have an empty set and link with nothing; texts under
    five words are one shingle; exact copies link; a null doc_id keeps its row
    and is the component only of a class without other ids; repeated rows give
    repeated results; an empty table gives an empty result. Other columns of
    docs are not read.
    """
    docs = docs.select("doc_id", "text")
    scanned = tables.written(scan(docs), "scan")
    prints = scanned.filter("part is null").select("doc_id", "text_hash", "n_shingles", "node")
    found = links(docs, scanned, percent)
    placed = tables.written(
        prints.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed"
    )
    # read from a table, so that adaptive execution can split a component that holds many rows
    least = tables.written(placed.filter("node is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "component", "left").select(
        "doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash"
    )


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without the near copies: of each class the row of its smallest doc_id.

    Rows without words all stay. Of repeated rows of the kept doc_id and text one stays.

    A row is known by its doc_id and a hash of its text. Rows that go are named by
    those and taken out where they are; of a document in repeated rows all are taken out and one is put back.
    """
    classes = join_classes(docs, percent).filter("node is not null")
    same = classes.groupBy("doc_id", "node", "text_hash").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id"))
    of_text = Window.partitionBy("doc_id", "node")
    same = same.withColumns({"rows": F.sum("n").over(of_text), "one": F.min("text_hash").over(of_text)})
    same = tables.written(same.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id"))), "same")
    name = lambda ident, hashed: F.concat_ws("/", F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit("null")), hashed.cast("string"))
    mark = lambda ident, hashed: F.xxhash64(name(ident, hashed))
    ours, theirs = (F.col("doc_id"), F.xxhash64("text")), (F.col("doc_id"), F.col("text_hash"))
    gone = same.filter("not (stays and rows = 1)").select(mark(*theirs).alias("hash"), name(*theirs).alias("digest"))
    kept = tables.without(docs, mark(*ours), name(*ours), gone)
    (key,) = tables.free_names(docs, "key")
    back = tables.small(same.filter("stays and rows > 1 and text_hash = one").select(name(*theirs).alias(key)), "back")
    again = docs.withColumn(key, name(*ours)).join(back, key, "left_semi").dropDuplicates([key]).drop(key)
    return kept.unionByName(again)


#: The same in SQL, over a table documents (doc_id, text) of distinct ids.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
g AS (SELECT doc_id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram FROM u
      WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY i = 1 OR i <= n - 4),
d AS (SELECT DISTINCT doc_id, gram FROM g),
s AS (SELECT doc_id, count(gram) AS n_shingles FROM documents LEFT JOIN d USING (doc_id) GROUP BY doc_id),
b AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS both_ FROM d x JOIN d y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM b JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * both_ >= 75 * (sx.n_shingles + sy.n_shingles - both_)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.root = l.x)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(root) AS component_id FROM r JOIN s USING (doc_id) GROUP BY doc_id
"""
