"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A text is cut into pre-tokens; a pre-token is cut into vocabulary tokens so that
the sum of unigram scores is highest (ties: fewer tokens). The best score of a
prefix depends on the prefix alone, so the distinct pre-tokens are inserted into a trie and
each trie node's forward score is computed once for all that share it; a
terminal's token count is stored. The vocabulary is a file of a public byte-level
tokenizer; its ranks give the scores by Zipf's rule, log(1 / (rank + 1)).

The trie is built and scored level by level, all nodes of a level at once. From
every node the vocabulary's own trie is walked forward along the pre-tokens: a
walk is (node, place in the vocabulary's trie, score where it began), it ends
where no token goes on, and where it stands on a whole token it offers the node
a score. Only one level's nodes and walks are held, and a trie is made of about
TRIE_BYTES of pre-tokens, so memory is bounded. A pre-token longer than
LONG bytes is walked alone, byte by byte, with only its open walks held: at
most as many as the longest token has bytes, however long the pre-token.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm import tables, textops

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token rule published with that vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of more bytes are walked alone; bytes of pre-tokens in one trie; stored counts; characters of a piece of text.
LONG, TRIE_BYTES, MOST_STORED, PIECE = 256, 1 << 19, 400_000, 1 << 18
#: Before white space that follows something else a pre-token always ends.
_CUT = regex.compile(r"\S(?=\s)")


def load_scores(path: str = VOCABULARY) -> dict[bytes, float]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return {token: -math.log(rank + 1) for token, rank in ranks.items()}


class Vocabulary:
    """The tokens as a trie: its edges, place * 256 + byte, sorted, the place each leads to, and the score of the token there (nan if none)."""

    def __init__(self, scores: dict[bytes, float]):
        child: dict[int, int] = {}
        at_place = [math.nan]
        for token, score in scores.items():
            place = 0
            for byte in token:
                place = child.setdefault(place << 8 | byte, len(at_place))
                if place == len(at_place):
                    at_place.append(math.nan)
            at_place[place] = score
        order = sorted(child)
        self.edges, self.to = np.array(order, np.int64), np.array([child[e] for e in order], np.int64)
        self.score = np.array(at_place)
        #: A byte outside the vocabulary counts as one token of the score of no rank.
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self._walk: tuple[dict[int, int], list[float]] | None = None

    def count_long(self, raw: bytes) -> int:
        """The tokens of the best cut of one pre-token, walked byte by byte."""
        child, score = self._walk = self._walk or (dict(zip(self.edges.tolist(), self.to.tolist())), self.score.tolist())
        walks: list[tuple[int, float, int]] = []
        best = (0.0, 0)  # score, minus the tokens
        for byte in raw:
            walks.append((0, *best))
            best = (best[0] + self.unknown, best[1] - 1)
            going = []
            for place, began, tokens in walks:
                place = child.get(place << 8 | byte)
                if place is not None:
                    going.append((place, began, tokens))
                    if (own := score[place]) == own and (began + own, tokens - 1) > best:
                        best = (began + own, tokens - 1)
            walks = going
        return -best[1]

    def count(self, words: list[bytes]) -> np.ndarray:
        """The tokens of the best cut of each of the words, by one trie of them all."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        rest = np.flatnonzero(sizes)  # words that go on beyond this level
        node = np.zeros(len(rest), np.int64)  # the node each of them has reached
        best, tokens = np.zeros(1), np.zeros(1, np.int64)  # of this level's nodes
        walk_node, place, began, before = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        level = 0
        while len(rest):
            # every node starts a walk; then the next level's nodes, by parent and byte
            walk_node = np.concatenate([walk_node, np.arange(len(best))])
            place = np.concatenate([place, np.zeros(len(best), np.int64)])
            began, before = np.concatenate([began, best]), np.concatenate([before, tokens])
            order = np.argsort(walk_node, kind="stable")
            walk_node, place, began, before = walk_node[order], place[order], began[order], before[order]
            made, node = np.unique(node << 8 | data[first[rest] + level], return_inverse=True)
            parent, byte = made >> 8, made & 255
            # each new node takes its parent's walks one byte on
            start = np.searchsorted(walk_node, parent)
            many = np.searchsorted(walk_node, parent, "right") - start
            child = np.repeat(np.arange(len(made)), many)
            walk = np.arange(len(child)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
            edge = place[walk] << 8 | byte[child]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            goes = self.edges[at] == edge if len(self.edges) else np.zeros(len(edge), bool)
            walk_node, place, began, before = child[goes], self.to[at[goes]], began[walk[goes]], before[walk[goes]]
            score = began + self.score[place]
            whole = np.flatnonzero(~np.isnan(score))
            # the highest score, then the fewest tokens
            alone, alone_tokens = best[parent] + self.unknown, tokens[parent] + 1
            best = alone.copy()
            np.maximum.at(best, walk_node[whole], score[whole])
            tokens = np.where(alone == best, alone_tokens, np.iinfo(np.int64).max)
            top = whole[score[whole] == best[walk_node[whole]]]
            np.minimum.at(tokens, walk_node[top], before[top] + 1)
            level += 1
            done = sizes[rest] == level
            out[rest[done]] = tokens[node[done]]
            rest, node = rest[~done], node[~done]
        return out


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, or more where none of its pre-tokens ends; pre-tokens are those of the text."""
    at = 0
    while len(text) - at > PIECE:
        found = _CUT.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


class Counter:
    """Token counts of pre-tokens; counts of those met are stored, MOST_STORED at most, and begin anew beyond that."""

    def __init__(self, vocabulary: Vocabulary, most: int = MOST_STORED):
        self.vocabulary, self.most = vocabulary, most
        self.stored: dict[str, int] = {}
        self.long: list[str] = []  # stored for the moment only

    def learn(self, words: Iterable[str]) -> None:
        """Stores the counts of words that aren't stored."""
        batch: list[tuple[str, bytes]] = []
        size = 0

        def settle():
            self.stored.update(zip([w for w, _ in batch], self.vocabulary.count([raw for _, raw in batch]).tolist()))
            batch.clear()

        for word in words:
            raw = word.encode("utf-8", "replace")
            if len(raw) > LONG:
                self.stored[word] = self.vocabulary.count_long(raw)
                self.long.append(word)
                continue
            batch.append((word, raw))
            size += len(raw)
            if size > TRIE_BYTES:
                settle()
                size = 0
        if batch:
            settle()

    def totals(self, parts: list[list[str]]) -> list[int]:
        """The tokens of each list of pre-tokens."""
        if len(self.stored) > self.most:
            self.stored = {}
        self.learn(set().union(*parts).difference(self.stored))
        found = self.stored.__getitem__
        out = [sum(map(found, words)) for words in parts]
        for word in self.long:
            del self.stored[word]
        self.long = []
        return out


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) of every row's whole text.

    doc_id keeps its type. Null and empty texts have 0 of both; repeated rows repeat; an empty table
    gives an empty result; very long texts are read piece by piece and very long
    pre-tokens walked byte by byte, in bounded memory beside the text; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_scores(vocabulary)))
    schema = tables.schema_with(docs, ["doc_id"], "n_pre_tokens long, n_tokens long")

    def run(batches):
        counter, rule = Counter(shared.value), regex.compile(PRE_TOKEN)
        for batch in batches:
            pre, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            rows, parts, size = [], [], 0

            def settle():
                np.add.at(pre, rows, [len(words) for words in parts])
                np.add.at(tokens, rows, counter.totals(parts))

            for row, text in enumerate(batch.column("text")):
                for piece in pieces(text.as_py() or ""):
                    rows.append(row)
                    parts.append(rule.findall(piece))
                    size += len(piece)
                    if size > 4 * PIECE:
                        settle()
                        rows, parts, size = [], [], 0
            if rows:
                settle()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pre), pa.array(tokens)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(textops.released(run), schema)
