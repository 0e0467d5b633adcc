"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters of the text in NFKC,
case-folded in every script. The benchmark is taken in
blocks of bounded size, one after the other, each sent to every task and deleted after its
two passes. One pass over the documents
counts in how many of them each gram of the block's items occurs, a gram being
two words next to each other or with one between. An item's seeds are the grams
of the places that would cost least: occurrences in documents times the items that
share the gram, so a template common to many items is the last to seed any. A second pass looks the seeds up in every document; where
they hit, the item is aligned locally with the stretch of the document around
the hits, word by word, so paraphrased and edited copies score too. A document
leaks an item if the score reaches a share of the item's own (2 for a match, -1
for a mismatch or gap).

The seeds lose no leak. An alignment of k matches and edits of cost e scores
2k - e. Of the k - 1 steps from a match to the next, those of cost 0 or 1 have
at most one word between on either side, so both sides share a gram there; the
others cost 2 or more. With x steps of the first kind e is at least
2(k - 1 - x), so a score of 2 * least * n needs x >= least * n - 1 places. Of
the n - 1 places of an item, all but one less than so many are seeds: one hits,
whatever the order that seeds are chosen in.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm import tables, textops

LEAST_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.4
#: Bound of a block of items: what one broadcast holds is at most about this many bytes of text.
BLOCK_BYTES = 8 << 20


def folded(text: str) -> str:
    """NFKC, without case: equal for a text and its upper-case copy, in any script."""
    if text.isascii():
        return text.lower()
    # folding can leave characters that NFKC composes, and NFKC cased ones
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, row and hash of each folded word) for runs of rows as textops.chunks has them."""
    for first, data, bounds in textops.chunks(column):
        if (data >= 128).any():
            raw = data.tobytes()
            texts = [folded(raw[a:b].decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape") for a, b in zip(bounds, bounds[1:])]
            data = np.frombuffer(b"".join(texts), np.uint8)
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        yield first, len(bounds) - 1, *textops.letter_words(data, bounds)


@dataclass
class Block:
    ids: pa.Array
    words: list[np.ndarray]
    #: Of every gram of every item: its hash, its item's number and its first word's place there.
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _grams(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of each two words of a row that are neighbours or have one word between."""
    at = [np.flatnonzero(rows[:-far] == rows[far:]) for far in (1, 2)]
    return np.concatenate([words[a] * textops._K + words[a + far] for far, a in zip((1, 2), at)]), np.concatenate(at)


class Lookup:
    """Places of hashes in a sorted array; most of those that aren't in it are ruled out by their first bits."""

    def __init__(self, wanted: np.ndarray):
        bits = min(24, max(16, len(wanted).bit_length() + 6))
        self.wanted, self.shift = wanted, np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[wanted >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are wanted, first place of each of them)."""
        found = np.flatnonzero(self.some[hashes >> self.shift])
        at = np.minimum(np.searchsorted(self.wanted, hashes[found]), len(self.wanted) - 1)
        hit = self.wanted[at] == hashes[found]
        return found[hit], at[hit]


def _block(items: pa.Table) -> Block:
    ids, kept, found, parts = items.column("item_id").combine_chunks(), [], [], [[], [], []]
    for first, count, rows, words in _words(items.column("text")):
        cuts = np.searchsorted(rows, np.arange(count + 1))
        for row, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b - a >= LEAST_WORDS:
                grams, places = _grams(np.zeros(b - a, np.int64), words[a:b])
                for part, x in zip(parts, (grams, np.full(len(grams), len(kept)), places)):
                    part.append(x)
                kept.append(first + row)
                found.append(words[a:b].copy())
    none = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return Block(ids.take(pa.array(kept, pa.int64())), found, *[np.concatenate([n, *part]) for n, part in zip(none, parts)])


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """The benchmark's items (item_id, text) in blocks of about `most` bytes; null texts and items under LEAST_WORDS words are left out."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // most))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts if total else 0):
        table = dealt.filter(F.col("part") == part).select("item_id", "text").orderBy("item_id", "text").toArrow()
        yield _block(table)


def gram_frequencies(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many rows of docs each of the grams, sorted and distinct, occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        known = Lookup(shared.value)
        total = np.zeros(len(known.wanted), np.int64)
        for batch in batches:
            for _, _, rows, words in _words(batch.column("text")):
                hashes, start = _grams(rows, words)
                found, at = known.find(hashes)
                pair = np.unique(rows[start[found]] * len(total) + at)
                seen, times = np.unique(pair % len(total), return_counts=True)
                total[seen] += times
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["at", "n"])

    found = docs.select("text").mapInArrow(textops.released(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(wanted), np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


@dataclass
class Index:
    """Seeds of a block, sorted, with the item and the place in it of each."""

    ids: pa.Array
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    offset: np.ndarray


def index(block: Block, wanted: np.ndarray, frequency: np.ndarray, least: float = LEAST_SCORE) -> Index:
    """The seeds of a block whose distinct grams are `wanted`, found in `frequency` documents each."""
    at = np.searchsorted(wanted, block.grams)
    once = np.unique(block.item * len(wanted) + at) % max(1, len(wanted))
    cost = frequency.astype(float) * np.bincount(once, minlength=len(wanted))
    cuts = np.searchsorted(block.item, np.arange(len(block.words) + 1))
    chosen = np.zeros(len(block.grams), bool)
    for words, a, b in zip(block.words, cuts, cuts[1:]):
        n, places = len(words), block.place[a:b]
        seen = np.bincount(places, cost[at[a:b]], n - 1)
        # the rounding of least * n may only add a seed
        shared = max(1, int(np.ceil(least * n - 1 - 1e-9)))
        cheapest = np.zeros(n - 1, bool)
        cheapest[np.argsort(seen, kind="stable")[: n - shared]] = True
        chosen[a:b] = cheapest[places]
    order = np.flatnonzero(chosen)[np.argsort(block.grams[chosen], kind="stable")]
    return Index(block.ids, block.words, block.grams[order], block.item[order], block.place[order])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local alignment score of item against text, where it ends in text)."""
    score, end = align_many([item], [text])
    return int(score[0]), int(end[0])


def align_many(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """align() of each item with its text, all at once: a step takes one word of every item."""
    order = np.argsort([-len(x) for x in items], kind="stable")
    sizes, lengths = np.array([len(items[i]) for i in order]), np.array([len(texts[i]) for i in order])
    query, text = np.zeros((len(order), sizes.max(initial=0)), np.uint64), np.zeros((len(order), lengths.max(initial=0)), np.uint64)
    for row, i in enumerate(order):
        query[row, : sizes[row]], text[row, : lengths[row]] = items[i], texts[i]
    inside = np.arange(text.shape[1])[None] < lengths[:, None]
    reach = np.arange(text.shape[1] + 1, dtype=np.int32) * -GAP
    row, best, end = np.zeros((len(order), text.shape[1] + 1), np.int32), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for step in range(query.shape[1]):
        n = int(np.searchsorted(-sizes, -step))  # items that have a word left
        now = np.zeros((n, row.shape[1]), np.int32)
        same = (text[:n] == query[:n, step, None]) & inside[:n]
        now[:, 1:] = row[:n, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(now, row[:n] + np.int32(GAP), out=now)
        np.maximum(now, 0, out=now)
        # gaps along the text: the best start before, less its distance
        now = np.maximum.accumulate(now + reach, axis=1) - reach
        row = now
        at = now.argmax(1)
        top = now[np.arange(n), at]
        better = top > best[:n]
        best[:n][better], end[:n][better] = top[better], at[better]
    back = np.argsort(order)
    return best[back], end[back]


#: Cells of the tables that align_many fills at once.
ALIGN_CELLS = 1 << 18


def hits(column: pa.Array, known: Index, least: float = LEAST_SCORE):
    """(row, item number, score 0 to 1, first and last word) of the leaks in each text; of an item its best stretch."""
    lookup, item_size = Lookup(known.seeds), np.array([len(w) for w in known.words])
    # edits of a leak cost no more than its matches score above the least
    item_pad = np.ceil(MATCH * item_size * (1 - least)).astype(np.int64) + 1
    for first, count, rows, words in _words(column):
        hashes, at = _grams(rows, words)
        found, lo = lookup.find(hashes)
        if not len(found):
            continue
        many = np.searchsorted(known.seeds, hashes[found], "right") - lo
        gram = np.repeat(found, many)
        seed = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, item, start = rows[at[gram]], known.item[seed], at[gram] - known.offset[seed]
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > item_size[item[1:]])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(row)) - 1
        row_start = np.searchsorted(rows, np.arange(count + 1))
        row, item, pad = row[a], item[a], item_pad[item[a]]
        low = np.maximum(row_start[row], start[a] - pad)
        high = np.minimum(row_start[row + 1], start[b] + item_size[item] + pad)
        # no alignment scores more than all common words
        open_ = [k for k in range(len(a)) if np.isin(known.words[item[k]], words[low[k] : high[k]]).sum() >= least * item_size[item[k]]]
        open_.sort(key=lambda k: low[k] - high[k])
        best: dict[tuple[int, int], tuple] = {}
        at = 0
        while at < len(open_):
            most = max(1, ALIGN_CELLS // int(high[open_[at]] - low[open_[at]] + 1))
            batch, at = open_[at : at + most], at + most
            scores, ends = align_many([known.words[item[k]] for k in batch], [words[low[k] : high[k]] for k in batch])
            for k, score, end in zip(batch, scores.tolist(), ends.tolist()):
                r, i = int(row[k]), int(item[k])
                full, end = MATCH * int(item_size[i]), int(low[k]) + end - int(row_start[r])
                # of equal scores the first in the text
                if score >= least * full and (score, -end) > best.get((r, i), (0, 0))[:2]:
                    best[r, i] = (score, -end, score / full)
        for (r, i), (_, end, share) in sorted(best.items()):
            yield first + r, i, share, max(0, -end - int(item_size[i])), -end


def _each_block(docs: DataFrame, benchmark: DataFrame, least: float) -> Iterator:
    """The seed index of each block as a broadcast, one at a time: it is deleted when the next is asked for."""
    for block in blocks(benchmark):
        if len(block.ids):
            wanted = np.unique(block.grams)
            shared = docs.sparkSession.sparkContext.broadcast(index(block, wanted, gram_frequencies(docs, wanted), least))
            yield shared
            shared.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of each document and item that it leaks.

    Both ids keep their types. Null and empty texts leak nothing; a null doc_id or item_id is carried; repeated rows
    repeat; an empty table of either gives an empty result. last_word is where the
    alignment ends among the document's words, first_word about where it begins.
    """
    schema = tables.schema_with(docs, ["doc_id"], "score double, first_word long, last_word long")
    schema = StructType([schema.fields[0], StructField("item_id", benchmark.schema["item_id"].dataType), *schema.fields[1:]])
    out = tables.Appended(docs.sparkSession, schema, "leaks")
    for known in _each_block(docs, benchmark, least):

        def run(batches, shared=known):
            for batch in batches:
                found = list(hits(batch.column("text"), shared.value, least))
                columns = [
                    batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    shared.value.ids.take(pa.array([f[1] for f in found], pa.int64())),
                    pa.array([f[2] for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([f[4] for f in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        out.add(docs.select("doc_id", "text").mapInArrow(textops.released(run), schema))
    return out.table()


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, that leak no item; null texts stay.

    Each block's pass names the leaking texts by a hash and a digest. The rows
    that go are then those whose text is named: rows in no named hash's cell stay where they
    are, the few others are compared by digest.
    """
    named = tables.Appended(docs.sparkSession, StructType.fromDDL("hash long, digest string"), "leaking")
    for known in _each_block(docs, benchmark, least):

        def run(batches, shared=known):
            for batch in batches:
                found = sorted({row for row, *_ in hits(batch.column("text"), shared.value, least)})
                digests = [hashlib.sha256(batch.column("text")[row].as_buffer()).hexdigest() for row in found]
                yield pa.RecordBatch.from_arrays([batch.column("hash").take(pa.array(found, pa.int64())), pa.array(digests, pa.string())], ["hash", "digest"])

        named.add(docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(textops.released(run), "hash long, digest string"))
    return tables.without(docs, F.xxhash64("text"), F.sha2("text", 256), named.table())
