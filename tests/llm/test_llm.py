"""The corpus operators against brute force, exact round trips and held-out accuracy, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import tracemalloc
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import (  # noqa: E402
    decontamination, embedding_dedup, fitting, jaccard_join, language_id, mixing, quality, queries, sharding, tables, textops, token_counts, toxicity,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("sources", ["s"])[i % len(more.get("sources", ["s"]))], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


EDGE = [None, "", "   \n\t", "one", "one", "ONE", "two words", "A b c d", "é ü b c d e", "a " * 40_000, "."]


def test_words_and_shingles_equal_a_regex():
    texts = [*EDGE, "Über\x0bTab\tx  y\r\nz \x00 q w e r t y"]
    for row, found in textops.shingle_sets(pa.array(texts, pa.string())):
        assert len(found) == len(shingles(texts[row]))


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(5)
    texts = list(EDGE)
    for b in range(6):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 90])))
        texts += [base, base, *variants(rng, base, 25, 7)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{i}_{k}" for k in range(rng.choice([5, 12, 20]))) for i in range(30)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_classes(docs_of(spark, texts).repartition(5)).collect()}
    assert got == brute_classes(dict(enumerate(texts)))


def test_jaccard_join_on_documents_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_classes(docs).collect()}
    assert got == brute_classes({r.doc_id: r.text for r in docs.collect()})


def test_jaccard_join_of_shared_boilerplate_stays_in_proportion(spark, monkeypatch):
    """Texts that share 100 words and have 26 or 17 of their own link with nothing, and their common lists don't enter a join."""
    real, seen = jaccard_join._entering, []

    def counted(lists, percent):
        sides = real(lists, percent)
        seen.append(max(side.count() for side in sides))
        return sides

    monkeypatch.setattr(jaccard_join, "_entering", counted)
    common = " ".join(f"b{k}" for k in range(100))
    for n in (400, 1600):
        texts = [f"{common} " + " ".join(f"u{i}_{k}" for k in range(26 if i % 2 else 17)) for i in range(n)]
        rows = jaccard_join.join_classes(docs_of(spark, texts)).collect()
        assert all(r.doc_id == r.component_id for r in rows) and len(rows) == n
    assert seen[1] <= 4 * max(seen[0], 100)


def test_jaccard_join_across_size_bands_equals_brute_force(spark):
    """Sets of many sizes at the edge of the threshold: subsets and supersets of one another, with shared boilerplate."""
    rng = random.Random(8)
    common, texts = [f"b{k}" for k in range(60)], []
    for i in range(120):
        own = [f"o{i % 12}_{k}" for k in range(rng.randrange(5, 120))]
        texts.append(" ".join([*common[: rng.randrange(61)], *own, *[f"u{i}_{k}" for k in range(rng.randrange(12))]]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_classes(docs_of(spark, texts)).collect()}
    want = brute_classes(dict(enumerate(texts)))
    assert got == want and len({c for _, c in want.values()}) < 115


@pytest.mark.parametrize("kind", ["int", "string"])
def test_jaccard_join_keeps_the_type_of_ids_and_clashing_columns(spark, kind):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", None, "", "z y x w v u"])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit("mine") for c in ("key", "KEY_", "node", "ident", "component_id", "_tidemark_key")})
    out = jaccard_join.join_classes(docs)
    assert dict(out.dtypes)["component_id"] == kind and {(str(r.doc_id), str(r.component_id)) for r in out.collect()} == {("0", "0"), ("1", "0"), ("2", "2"), ("3", "3"), ("4", "4")}
    kept = jaccard_join.first_of_each(docs)
    assert kept.dtypes == docs.dtypes and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "3", "4"]
    assert jaccard_join.join_classes(docs.limit(0)).count() == 0 and jaccard_join.first_of_each(docs.limit(0)).count() == 0


def test_first_of_each_keeps_rows_and_columns(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", None, "", "z y x w v u"]).withColumn("node", F.lit("mine"))
    out = jaccard_join.first_of_each(docs.unionByName(docs.filter("doc_id = 0")))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4]


def test_components_and_roots(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (3, 2)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, tables.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in (1, 2, 3)} == {1} and {got[k] for k in (7, 8, 9)} == {7} and {got[100 + i] for i in range(41)} == {100} and 5 not in got
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 30)], "node long, up long")
    assert set(tables.roots(chain).collect()) == {(i, 0) for i in range(30)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same, got, want = oracle.compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert same and got == want


def test_embedding_links_equal_sql(spark, tmp_path):
    """On vectors that have links, nulls and odd values among them."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    vectors = [*np.vstack([base, base[:30] + rng.normal(size=(30, 6)) * 0.05, base[:9]]).tolist(), None, [], [0.0] * 6, [math.nan] * 6, [math.inf, *[1.0] * 5], [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, None if i == 5 else i % 2) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda s, d: embedding_dedup.near_copies(s.read.parquet(f"{d}/embeddings.parquet"), exact=True)
    same, got, want = oracle.compare(spark, run, embedding_dedup.SQL, str(tmp_path))
    assert same and got == want and sum(r[2] for r in want) > 60


def test_mixing_equals_sql_and_hits_targets(spark):
    same, a, b = oracle.compare(spark, queries.QUERIES["op1_mixing"], mixing.SQL)
    assert same and a == b
    texts = [None, "", "a b c"] + [" ".join("w" for _ in range(n)) for n in (1, 7, 50, 400, 3, 9, 20)]
    docs = docs_of(spark, texts, sources=["b", None, "a"])
    rows = mixing.mix(docs.unionByName(docs.limit(4))).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert math.isclose(sum(t for _, t in by), total)
    for (size, target), taken in by.items():
        assert target <= 3 * size and abs(sum(taken) - target) < 4
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_many_sources_and_clashing_columns(spark, monkeypatch):
    """As many sources as rows, more than a broadcast takes: the same targets as a plain water-filling."""
    monkeypatch.setattr(tables.small, "__defaults__", (20,))
    rng = random.Random(3)
    rows = [(i if i else None, " ".join("w" * rng.randrange(1, 9)), None if i == 3 else f"s{i % 150:03}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumns({c: F.lit("mine") for c in ("size", "edge", "order", "of", "target", "_part", "place")})
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    capped = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[x] for x in capped)) / sum(weight[x] for x in names if x not in capped)
        over = {x for x in names if x not in capped and weight[x] * level > 3 * sizes[x]}
        if not over:
            break
        capped |= over
    want = {x: 3.0 * sizes[x] if x in capped else weight[x] * level for x in names}
    got = {r.source: r.target for r in mixing.targets(docs.select("source", mixing.word_count().alias("size"))).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in names) and capped
    taken = Counter()
    source_of = {i: x for i, _, x in rows}
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[x] - want[x]) <= 1 for x in names)
    assert mixing.repeat(docs).columns == docs.columns and mixing.repeat(docs.limit(0)).count() == 0


def test_sums_before_a_row_run_on_from_range_to_range(spark):
    frame = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("mine").alias("_part"))
    rows = sorted(map(tuple, tables.before(frame, [F.col("k").desc()], n=F.lit(1), s=F.col("k")).select("k", "n", "s").collect()))
    assert rows == [(k, 499 - k, sum(range(k + 1, 500))) for k in range(500)]


def test_repeat_follows_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("edge", F.lit(1))
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(docs).collect()}
    copies = Counter(r.doc_id for r in out.collect())
    for i, (size, words) in taken.items():
        assert abs(copies[i] * size - words) <= size / 2 or size == 0


def test_sharding_law_slots_and_movement(spark):
    docs = docs_of(spark, [*EDGE, *[f"text {i}" for i in range(600)]])
    rows = sharding.place(docs.unionByName(docs.limit(3)), 40).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))
    first = next(r for r in rows if r.doc_id == 8)
    assert first["size"] == len(EDGE[8].encode()) + 16 and first.text_crc32 == zlib.crc32(EDGE[8].encode())
    assert sharding.place(docs.limit(0)).count() == 0


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    near = base[:60] + rng.normal(size=(60, 24)) * 0.02
    vectors = [*map(list, np.vstack([base, near, near[:5]]).tolist()), None, [0.0] * 24, [float("nan")] * 24, [1.0, None], [1.0, 2.0], [2.0, 4.0], []]
    rows = [(i, v, None if i == 3 else i % 3) for i, v in enumerate(vectors)]
    rows[-2], rows[-3] = (*rows[-2][:2], 1), (*rows[-3][:2], 1)
    got = {r.vec_id: r for r in embedding_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = {i: set() for i, _, _ in rows}
    for i, x, a in rows:
        for j, y, b in rows:
            if i < j and x and y and None not in x and None not in y and len(x) == len(y) and a == b and a is not None:
                n = np.linalg.norm(x) * np.linalg.norm(y)
                if n > 0 and np.isfinite(n) and np.dot(x, y) / n >= 0.98:
                    links[i].add(j), links[j].add(i)
    found, true = sum(got[i].n_links for i in links), sum(map(len, links.values()))
    assert true > 50 and 0.9 * true <= found <= true
    assert all(got[i].n_links <= len(links[i]) for i in links) and all(got[i].kept == (got[i].component_id == i) for i in links)


def test_embedding_copies_count_as_links(spark):
    rows = [(i, [1.0, 0.0], 0, "x") for i in range(40)] + [(50 + i, [1.0, 0.01], 0, "x") for i in range(3)] + [(60, [0.0, 1.0], 0, "x"), (None, [0.0, 1.0], 0, "x"), (61, [1.0, 0.0], 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, digest string")
    got = embedding_dedup.near_copies(frame).collect()
    want = [(i, 42, 0, i == 0) for i in [*range(40), 50, 51, 52]] + [(60, 1, 60, True), (None, 1, 60, False), (61, 0, 61, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert embedding_dedup.near_copies(frame.limit(0)).count() == 0


def test_embedding_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(1500)
    noisy = table.select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: (x + F.rand(4) * 0.02 - 0.01).cast("float")).alias("embedding"), "label")
    both = table.unionByName(noisy).cache()
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_copies(both).collect()}
    rows = both.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    near = ((x @ x.T >= 0.98) & (label[:, None] == label[None])).sum(1) - 1
    assert near.sum() > 500 and sum(got.values()) >= 0.95 * near.sum() and all(got[r.vec_id] <= n for r, n in zip(rows, near))


def cosine_links(x, label):
    """How many other vectors of its label each vector's cosine of 0.98 links it with, and the least row of its component."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    return near.sum(1) - 1, embedding_dedup._forest(len(x), *np.nonzero(near))


@pytest.mark.parametrize("rank", [2, 3, 6, 24])
def test_embedding_recall_on_data_of_few_directions(spark, rank):
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(1200, rank)) @ rng.normal(size=(rank, 64))
    near = base[:400] + (rng.normal(size=(400, 64)) * 0.015 * np.abs(base[:400]).mean())
    x, label = np.vstack([base, near]), np.arange(1600) % 2
    frame = spark.createDataFrame([(i, v, int(label[i])) for i, v in enumerate(x.tolist())], "vec_id int, embedding array<double>, label int")
    want, component = cosine_links(x, label)
    assert want.sum() > 500
    for exact in (False, True):
        out = embedding_dedup.near_copies(frame, exact=exact)
        assert dict(out.dtypes)["vec_id"] == dict(out.dtypes)["component_id"] == "int"
        got = {r.vec_id: r for r in out.collect()}
        found = np.array([got[i].n_links for i in range(1600)])
        assert (found <= want).all() and found.sum() >= (1.0 if exact or rank < 16 else 0.95) * want.sum()
        if exact:
            assert (found == want).all() and [got[i].component_id for i in range(1600)] == component.tolist()


def test_probes_reach_every_list_that_can_hold_a_neighbour():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = embedding_dedup.fit(x, 3000)
    home, *_ = model.code(x)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    cross = home[i] != home[j]
    assert cross.sum() > 100
    probed = model.probes(x, home, 0.2, True)
    low, high = np.where(home[i] < home[j], i, j)[cross], np.where(home[i] < home[j], j, i)[cross]
    assert probed[high, home[low]].all()


def test_directions_are_counted():
    rng = np.random.default_rng(2)
    for rank in (1, 2, 3, 8, 32):
        x = rng.normal(size=(4000, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
        found = np.median(embedding_dedup.directions(x, x[:20]))
        assert rank * 0.6 <= found <= rank * 1.6, (rank, found)


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(3000)] + ["the", "of"] * 200
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(35) for _ in range(20)]
    edited = items[4].split()
    for i in range(3, 35, 8):
        edited[i] = "changed"
    del edited[11]
    docs = [*EDGE, *[text(300) for _ in range(60)], text(80) + " " + items[0] + " " + text(80), text(50) + " " + " ".join(edited), items[7].upper().replace(" ", ", ")]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "a b")], "item_id long, text string")
    frame = docs_of(spark, docs).withColumn("score", F.lit("mine"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, table).collect()}
    n = len(docs)
    assert got == {(n - 3, 0), (n - 2, 4), (n - 1, 7)}
    kept = decontamination.clean(frame, table)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(n - 3))
    assert decontamination.leaks(frame, table.limit(0)).count() == 0 and decontamination.leaks(frame.limit(0), table).count() == 0


def test_decontamination_finds_what_brute_force_alignment_finds(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)] + ["the", "of"] * 60
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(rng.choice([3, 5, 15, 30, 45])).split() for _ in range(40)]
    docs = []
    for item in items:
        half = len(item) // 2 + 1
        edited = [rng.choice([["x"], [], [w, "y"]]) if rng.random() < 0.2 else [w] for w in item]
        copies = [item, item[:half], item[-half:], sum(edited, []), [w if i % 3 else "z" for i, w in enumerate(item)], sum([[w, "q"] for w in item], []), [w for w in item if w != "the"]]
        docs += [" ".join([text(40), *copy, text(40)]) for copy in copies]
    number: dict[str, int] = {}
    coded = lambda words: np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    codes = [coded(x) for x in items]
    want = set()
    for d, doc in enumerate(docs):
        words = coded(doc.split())
        want |= {(d, i, decontamination.align(item, words)[0] / (2 * len(item))) for i, item in enumerate(codes) if decontamination.align(item, words)[0] >= 0.4 * 2 * len(item)}
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert len(want) > 200 and {(r.doc_id, r.item_id, r.score) for r in decontamination.leaks(docs_of(spark, docs), table).collect()} == want


def test_decontamination_finds_copies_in_another_case(spark):
    items = ["el niño comió la piñata más allá del océano según él", "große straße über den weißen fluß", "Ο Οδυσσέας γύρισε στις Ιθάκης τους λόφους", "мы видели белую ночь над рекой"]
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in "five whole words in width")
    copies = [items[0].upper(), items[1].upper(), items[2].upper(), items[3].upper(), unicodedata.normalize("NFD", items[0].upper()), wide]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*items, "Five Whole Words In Width"])], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontamination.leaks(docs_of(spark, [*copies, *EDGE]), table).collect()}
    assert got == {(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 0, 1.0), (5, 4, 1.0)}


def test_decontamination_query_equals_brute_force(spark):
    words = lambda text: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    number: dict[str, int] = {}
    coded = lambda text: np.array([number.setdefault(w, len(number)) for w in words(text)], np.uint64)
    items = {r.item_id: coded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = coded(r.text)
        for i, item in items.items():
            if len(item) >= 3 and np.isin(item, text).mean() >= 0.4 and decontamination.align(item, text)[0] >= 0.4 * 2 * len(item):
                want.add((r.doc_id, i))
    assert want and {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()} == want


def test_decontamination_block_by_block(spark, monkeypatch):
    """In many blocks the same leaks, whatever the ids' type; each block's broadcast is gone before the next is made."""
    rng = random.Random(4)
    items = [" ".join(f"v{rng.randrange(500)}" for _ in range(20)) for _ in range(60)]
    docs = docs_of(spark, [*EDGE, *[f"pad {i} " * 5 + " ".join(items[i].split()[: 9 + i % 12]) for i in range(60)], items[3], items[3]])
    docs = docs.withColumns({c: F.lit("mine") for c in ("hash", "digest", "_cell", "_named", "_block", "score")}).withColumn("doc_id", F.col("doc_id").cast("int"))
    table = spark.createDataFrame([(f"i{i}", t, 1) for i, t in enumerate(items)] + [(None, items[5], 2), ("none", None, 3)], "item_id string, text string, score int")
    one = sorted(map(str, decontamination.leaks(docs, table).collect()))
    real, alive, seen = decontamination.blocks, [], []
    monkeypatch.setattr(decontamination, "blocks", lambda benchmark: real(benchmark, 200))
    context = type(spark.sparkContext)
    broadcast = context.broadcast

    def counted(self, value):
        out = broadcast(self, value)
        if isinstance(value, decontamination.Index):
            alive.append(out)
            destroy = out.destroy
            out.destroy = lambda *a: (alive.remove(out), destroy(*a))
            seen.append(len(alive))
        return out

    monkeypatch.setattr(context, "broadcast", counted)
    out = decontamination.leaks(docs, table)
    assert sorted(map(str, out.collect())) == one and len(one) > 40 and dict(out.dtypes)["doc_id"] == "int" and dict(out.dtypes)["item_id"] == "string"
    assert len(seen) > 20 and set(seen) == {1} and not alive
    leaking = {r.doc_id for r in out.collect()}
    kept = decontamination.clean(docs, table)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.doc_id for r in docs.collect()} - leaking)


def test_a_template_shared_by_items_is_no_seed():
    """Of 300 items that share 15 of 60 words none is aligned with a text that holds those words alone; with more of an item it is."""
    template = [f"t{k}" for k in range(15)]
    items = [[f"o{i}_{k}" for k in range(25)] + template + [f"p{i}_{k}" for k in range(20)] for i in range(300)]
    block = decontamination._block(pa.table({"item_id": list(range(300)), "text": [" ".join(w) for w in items]}))
    wanted = np.unique(block.grams)
    known = decontamination.index(block, wanted, np.ones(len(wanted), np.int64))
    text = " ".join(["x"] * 50 + template + ["y"] * 50)
    (_, _, rows, words), = decontamination._words(pa.array([text]))
    assert not np.isin(decontamination._grams(rows, words)[0], known.seeds).any()
    found = list(decontamination.hits(pa.array([text, text + " " + " ".join(items[7][:40])]), known))
    assert [(f[0], f[1]) for f in found] == [(1, 7)]


def test_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(0, 6, 20).astype(np.uint64)
        h = np.zeros((13, 21), int)
        for i in range(1, 13):
            for j in range(1, 21):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == h.max()
    items = [rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64) for _ in range(40)]
    texts = [rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64) for _ in range(40)]
    assert list(zip(*map(list, decontamination.align_many(items, texts)))) == [decontamination.align(a, b) for a, b in zip(items, texts)]


def plain_count(scores, word, unknown):
    """The tokens of the best cut by plain dynamic programming over all starts."""
    raw = word.encode("utf-8", "replace")
    best = [(0.0, 0)]
    for end in range(1, len(raw) + 1):
        options = [(best[s][0] + scores[raw[s:end]], best[s][1] - 1) for s in range(end) if raw[s:end] in scores]
        best.append(max([*options, (best[-1][0] + unknown, best[-1][1] - 1)]))
    return -best[-1][1]


WORDS = ["a", " the", "thethe", "then", " réeuxpa", "日本語", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x01", "", "the" * 40, "\ud800"]


def test_token_counts_equal_plain_dynamic_programming():
    scores = token_counts.load_scores()
    known = token_counts.Vocabulary(scores)
    want = [plain_count(scores, w, known.unknown) for w in WORDS]
    raws = [w.encode("utf-8", "replace") for w in WORDS]
    assert known.count(raws).tolist() == want == [known.count_long(r) for r in raws]
    counter = token_counts.Counter(known, most=3)
    for _ in range(3):
        assert counter.totals([[w] for w in WORDS]) == want and counter.totals([WORDS, []]) == [sum(want), 0]
    # a small vocabulary: ties between cuts, and bytes that are in no token
    rng = random.Random(6)
    for _ in range(20):
        few = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))): -float(rng.randrange(1, 5)) for _ in range(rng.randrange(9))}
        small = token_counts.Vocabulary(few)
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(60)]
        want = [plain_count(few, w, small.unknown) for w in words]
        assert small.count([w.encode() for w in words]).tolist() == want == [small.count_long(w.encode()) for w in words]


def test_token_counts_of_very_long_pre_tokens_in_bounded_memory():
    known = token_counts.Vocabulary(token_counts.load_scores())
    counter = token_counts.Counter(known)
    word = "abcdefghij" * 200_000
    tracemalloc.start()
    assert counter.totals([[word], ["a"]]) == [1_000_000, 1]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the vocabulary's tables and the word's bytes, not a node for each byte
    assert most < 60_000_000 and list(counter.stored) == ["a"]


def test_token_count_pieces_have_the_texts_pre_tokens(monkeypatch):
    import regex

    monkeypatch.setattr(token_counts, "PIECE", 40)
    for text in [*filter(None, EDGE[:9]), "a  b   c\n\n d" * 30, " " * 400, "x" + " " * 300 + "y", "it's  we'll\t1234 \u00a0 é!? " * 40, "word" * 100 + " z"]:
        parts = list(token_counts.pieces(text))
        assert "".join(parts) == text and [w for p in parts for w in regex.findall(token_counts.PRE_TOKEN, p)] == regex.findall(token_counts.PRE_TOKEN, text)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_token_counts_of_edge_texts(spark, kind):
    docs = docs_of(spark, EDGE).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit("mine") for c in ("n_tokens", "n_pre_tokens")})
    out = token_counts.counted(docs.unionByName(docs))
    assert out.columns == ["doc_id", "n_pre_tokens", "n_tokens"] and dict(out.dtypes)["doc_id"] == kind
    rows = {r.doc_id: (r.n_pre_tokens, r.n_tokens) for r in out.collect()}
    at = lambda i: rows[int(i) if kind == "int" else str(i)]
    assert len(rows) == len(EDGE) and at(0) == at(1) == (0, 0) and at(3) == at(4) and at(3)[1] > 0 and at(9)[0] == 40_001
    assert token_counts.counted(docs.limit(0)).count() == 0


def test_token_count_query_equals_plain_dynamic_programming(spark):
    scores = token_counts.load_scores()
    longest, known = max(map(len, scores)), {}

    def plain(word):
        if word not in known:
            raw, best = word.encode(), [(0.0, 0)]
            for end in range(1, len(raw) + 1):
                best.append(max((best[s][0] + scores[raw[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if raw[s:end] in scores))
            known[word] = -best[-1][1]
        return known[word]

    import regex

    got = {r.doc_id: (r.n_pre_tokens, r.n_tokens) for r in queries.op6_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = regex.findall(token_counts.PRE_TOKEN, r.text or "")
        assert got.pop(r.doc_id) == (len(words), sum(map(plain, words)))
    assert not got


def plain_descent(key, leaves):
    """The shard of a key by walking the tree node by node."""

    def draw(name, weight):
        bits = int(hashlib.md5(f"{'null' if key is None else key}/{name}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / weight

    left = [leaf for leaf in leaves if leaf[3] > 0]
    for level, kind in enumerate(("region", "rack", "shard")):
        weight = Counter()
        for leaf in left:
            weight[leaf[level]] += leaf[3]
        best = min(weight, key=lambda n: (draw(f"{kind}-{n}", weight[n]), n))
        left = [leaf for leaf in left if leaf[level] == best]
    return left[0][2]


def test_sharding_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, SF).collect()
    assert len(rows) == len(docs)
    two, three = sharding.tree(40), sharding.grown(sharding.tree(40))
    assert three == sharding.tree(41)
    flat = [(s, s, s, 1.0) for s in range(40)]
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), plain_descent(r.doc_id, two), plain_descent(r.doc_id, three))
        assert r.grown_shard in (r.shard, 40)
    # the tree decides: a draw over the shards alone gives other results
    assert sum(r.shard != plain_descent(r.doc_id, flat) for r in rows) > len(rows) / 2


def test_sharding_moves_only_in_subtrees_whose_weights_change(spark):
    before, after = sharding.tree(60, {9: 2.0}), sharding.tree(60, {9: 2.0, 27: 6.0, 33: 0.0})
    keys = spark.range(6000).select(F.col("id").cast("string").alias("id"), sharding.assign(F.col("id"), before).alias("a"), sharding.assign(F.col("id"), after).alias("b"))
    rows = keys.collect()
    region, rack = lambda s: s // 20, lambda s: s // 5
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(r.b == plain_descent(r.id, after) for r in rows[:300])
    for a, b in moved:
        # 27 and 33 are both in region 1, whose weight grows: keys come into it, and inside it only between the changed racks and others
        assert region(b) == 1 and (region(a) != 1 or rack(a) in (5, 6) or rack(b) in (5, 6))
    assert {r.a for r in rows} == set(range(60)) and 33 not in {r.b for r in rows}
    share = Counter(r.a for r in rows)
    assert 1.5 < share[9] / (sum(share.values()) / 61) < 2.6
    assert keys.select(sharding.assign(F.col("id"), []).alias("s")).distinct().collect()[0].s is None


def test_sharding_numbers_repeats_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 50)
    docs = docs_of(spark, ["same", "other"]).drop("source").withColumns({c: F.lit("mine") for c in ("n", "bin", "start", "from", "first", "size")})
    many = docs.filter("doc_id = 0").crossJoin(spark.range(2001).select()).unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") == 0, None).otherwise(F.lit("k")))
    rows = sharding.place(many, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 2003 and all(sorted(s) == list(range(len(s))) for s in by.values()) and {r.doc_id for r in rows} == {None, "k"}


@pytest.fixture(scope="module")
def learned(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_language_held_out(spark, learned):
    docs, _ = learned
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    model = language_id.fit(docs.filter(fitting.fold(4) != 2))
    edge = language_id.identify(docs_of(spark, [*EDGE, "123 !?"]).select("doc_id", "text"), model).collect()
    assert [r.lang_pred for r in edge if not re.search(r"[^\W\d_]", r.text or "")] == ["und"] * 5
    none = language_id.identify(docs.select("doc_id", "text").limit(3), language_id.fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_scorers_replace_clashing_columns_and_learn_a_repeated_id_once(spark, learned):
    docs, labels = learned
    clash = docs_of(spark, EDGE).withColumns({c: F.lit("mine") for c in ("score", "lang_pred", "ambiguous", "kind", "_x", "_share")})
    model = language_id.fit(docs.filter(fitting.fold(4) != 2))
    for out in (language_id.identify(clash, model), quality.score(clash, quality.fit(docs, labels)), toxicity.score(clash, toxicity.fit(docs, labels))):
        assert set(out.columns) >= {*clash.columns} and len(set(out.columns)) == len(out.columns)
        assert len(out.filter("score between 0.0 and 1.0").collect()) == len(EDGE)
    repeated = docs.unionByName(docs.filter("doc_id < 5").crossJoin(spark.range(300)).drop("id"))
    assert fitting.one_text_each(repeated, "doc_id", "lang").count() == docs.count()


def slope(loss, w, step=1e-5):
    """The gradient of a loss by differences."""
    out = np.zeros_like(w)
    for i in np.ndindex(w.shape):
        up, down = w.copy(), w.copy()
        up[i] += step
        down[i] -= step
        out[i] = (loss(up) - loss(down)) / (2 * step)
    return out


def test_language_decoding_and_gradient_equal_plain_formulas():
    rng = np.random.default_rng(0)
    code = language_id.codewords(4)
    model = language_id.Model(["a", "b", "c", "d"], code, rng.normal(size=(language_id.BUCKETS, code.shape[1])), rng.normal(size=code.shape[1]), rng.uniform(0.1, 2, code.shape[1]))
    texts = pa.array(["the cat sat", "el niño", "x", "", None, "ÅÄÖ 12"])
    x = language_id.trigram_features(texts)
    got = model.losses(texts)
    for r in range(len(texts)):
        for k in range(4):
            want = sum(model.trust[b] * math.log(1 + math.exp(-code[k, b] * (float(x[r] @ model.weights[:, b]) + model.bias[b]))) for b in range(code.shape[1]))
            assert math.isclose(got[r, k], want, rel_tol=1e-4, abs_tol=1e-5)
    x, aim, weight = rng.normal(size=(30, 5)), code[rng.integers(0, 4, 30)], rng.uniform(0, 1, 30)
    loss = lambda w: (np.log1p(np.exp(-aim * (x @ w[:-1] + w[-1]))) * weight[:, None]).sum() + language_id.DECAY / 2 * (w[:-1] ** 2).sum()
    w = rng.normal(size=(6, code.shape[1]))
    assert np.allclose(language_id.gradient(x, aim, weight)(w), slope(loss, w), atol=1e-6)


def test_quality_risk_and_gradient_equal_plain_formulas():
    rng = np.random.default_rng(1)
    p, u = rng.normal(size=(40, 4)) + 1, rng.normal(size=(60, 4))
    minus, plus = lambda x, w: np.log1p(np.exp(x @ w[:-1] + w[-1])).mean(), lambda x, w: np.log1p(np.exp(-(x @ w[:-1] + w[-1]))).mean()
    decay = lambda w: quality.DECAY / 2 * (w[:-1] ** 2).sum()
    signs = set()
    for prior in (0.3, 0.9):
        at = quality.risk_gradient(p, u, prior)
        negative = lambda w: minus(u, w) - prior * minus(p, w)
        for w in rng.normal(size=(8, 5)) * 2:
            risk, found = at(w)
            assert math.isclose(risk, negative(w), rel_tol=1e-3, abs_tol=1e-4)
            signs.add(risk >= 0)
            want = slope(lambda v: prior * plus(p, v) + negative(v) + decay(v) if risk >= 0 else -negative(v) + decay(v), w)
            assert np.allclose(found, want, atol=2e-4)
    assert signs == {True, False}


def test_quality_prior_from_positives_alone(spark, learned):
    rng = np.random.default_rng(5)
    for prior in (0.2, 0.5, 0.8):
        p = rng.normal(size=(3000, 5)) + 2
        u = rng.normal(size=(4000, 5)) + 2 * (rng.random(4000) < prior)[:, None]
        assert abs(quality.class_prior(p, u) - prior) < 0.1
    docs, labels = learned
    model = quality.fit(docs, labels.filter("quality = 1"))
    rows = quality.score(docs, model).join(labels, "doc_id").select("score", "quality").collect()
    assert 0.5 < model.prior < 0.95 and np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.9


def test_toxicity_words_penalty_and_gradient_equal_plain_formulas(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 15))) + (" vile Vile" if i % 3 == 0 and i % 7 else "") for i in range(400)]
    toxic = [int(i % 3 == 0) for i in range(400)]
    sample = spark.createDataFrame(list(zip(toxic, texts)), "toxic int, text string").repartition(3)
    sets, n, t = [set(x.lower().split()) for x in texts], 400.0, float(sum(toxic))

    def plain_gain(word):
        have = [int(word in s) for s in sets]
        a, m = float(sum(h and k for h, k in zip(have, toxic))), float(sum(have))
        cells = [(a, m * t / n), (m - a, m * (1 - t / n)), (t - a, (n - m) * t / n), (n - m - t + a, (n - m) * (1 - t / n))]
        return m, sum(o * math.log(max(o, 1e-9) / max(e, 1e-9)) for o, e in cells)

    want = [w for w in {w for s in sets for w in s} if plain_gain(w)[0] >= toxicity.LEAST_ROWS and plain_gain(w)[1] >= toxicity.LEAST_GAIN]
    assert "vile" in want and set(toxicity.choose_words(sample, 400, int(t))) == set(toxicity.word_keys(want))
    assert len(toxicity.choose_words(sample, 400, int(t), 1)) == 1

    x = rng.integers(0, 2, (30, 6)).astype(float)
    kinds, weight, mark = [np.array([0, 3]), np.array([1, 4, 5])], rng.uniform(0, 1, 30), rng.integers(0, 2, 30)
    difference = toxicity.swaps(x, kinds)
    rows = []
    for row in x:
        if row[[0, 3, 1, 4, 5]].any():
            moved = row.copy()
            moved[[3, 0]], moved[[4, 5, 1]] = row[[0, 3]], row[[1, 4, 5]]
            rows.append(row - moved)
    assert (difference[: len(rows)] == np.array(rows)).all() and len(difference) == len(rows) + 5 and (difference.sum(1) == 0).all()

    def loss(w):
        f = x @ w[:-1] + w[-1]
        return (weight * (np.logaddexp(0, f) - mark * f)).sum() + 10.0 / 2 * np.mean((difference @ w[:-1]) ** 2) + toxicity.DECAY / 2 * (w[:-1] ** 2).sum()

    w = rng.normal(size=7)
    assert np.allclose(toxicity.gradient(x, mark, weight, difference, 10.0)(w), slope(loss, w), atol=1e-6)


def test_toxicity_learns_beginnings_of_words_but_not_of_identity_terms(spark):
    rng = random.Random(1)
    texts = [f"plain words {rng.randrange(50)} about " + (f"scumble{i}x then christians" if i % 3 == 0 else f"tables{i} then muslims") for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts), marks)
    score = lambda t: float(model.score(pa.array([t]))[0])
    assert score("a scumblefish") > 0.5 > score("a tablefish")
    terms = [t for kind in toxicity.IDENTITY_TERMS for t in kind]
    parts = np.setdiff1d(toxicity.beginning_keys(terms), np.concatenate([toxicity.word_keys(terms)]))
    assert len(parts) > 40 and not np.isin(parts, model.keys).any()
    assert abs(score("tea for muslims") - score("tea for christians")) < 0.1


def test_letter_parts_equal_a_regex():
    texts = ["Ab abcd abcde ABCDEF éé abécdefghij", "", None, "x" * 9 + " " + "x" * 8]
    for first, data, bounds in textops.chunks(pa.array(texts, pa.string())):
        rows, found = textops.letter_parts(data, bounds, (4, 6))
        for r, text in enumerate(texts):
            words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
            want = len(set(words)) + sum(len({w[:k] for w in words if len(w) > k}) for k in (4, 6))
            assert len(np.unique(found[rows == r])) == want


@pytest.mark.parametrize("kind", ["int", "string"])
def test_trained_operators_with_ids_of_any_type_and_empty_tables(spark, learned, kind):
    docs, labels = (df.filter("doc_id < 300").withColumn("doc_id", F.col("doc_id").cast(kind)) for df in learned)
    clash = docs.withColumns({c: F.lit("mine") for c in ("quality", "toxic", "kind", "_share", "words")})
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs)).collect()} > {"en"}
    for operator in (quality, toxicity):
        model = operator.fit(clash, labels)
        rows = operator.score(clash, model).select("doc_id", "score").collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        again = operator.score(clash, operator.fit(clash.repartition(7), labels.repartition(3))).select("doc_id", "score").collect()
        assert dict(map(tuple, again)) == pytest.approx(dict(map(tuple, rows)))
        for none in (operator.fit(clash.limit(0), labels), operator.fit(clash, labels.limit(0)), operator.fit(clash.limit(0), labels.limit(0))):
            assert operator.score(docs.limit(0), none).count() == 0 and len({r.score for r in operator.score(docs.limit(9), none).select("score").collect()}) == 1


def test_codewords_are_apart():
    for k in (1, 2, 3, 4, 6, 9, 40):
        code = language_id.codewords(k)
        assert code.shape[0] == k and len({tuple(r) for r in code}) == k


def test_quality_held_out(spark, learned):
    _, labels = learned
    rows = queries.op8_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    model = quality.fit(docs_of(spark, EDGE), labels.limit(0))
    assert all(0 <= r.score <= 1 for r in quality.score(docs_of(spark, EDGE), model).collect())


def test_toxicity_held_out_and_neutral_mentions(spark, learned):
    docs, labels = learned
    rows = queries.op9_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9 and not [r for r in rows if r.toxic == 0 and r.predicted]
    insults = ["fool", "brute", "vile"]
    texts = [f"word{i % 37} plain text about {'muslims' if i % 4 else 'christians'} and {insults[i % 3] if i % 3 else 'tea'}" for i in range(300)]
    marks = spark.createDataFrame([(i, 0, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of(spark, texts), marks)
    score = lambda t: float(model.score(pa.array([t]))[0])
    assert abs(score("tea for muslims") - score("tea for christians")) < 0.05 and score("you brute") > 0.5 > score("tea for muslims")
    assert len(toxicity.score(docs_of(spark, EDGE), model).collect()) == len(EDGE)


def test_pipeline_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, tables.written(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(i == c for i, (_, c) in brute_classes(texts).items())
    assert decontamination.leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} <= set(texts) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mixing", "sharding"]


CLASH = ("score", "key", "hash", "digest", "size", "row", "of", "order", "node", "ident", "n", "_cell", "_named", "_digest", "source_size", "copies")


def edge_tables(spark, folder, docs):
    """A folder of tables with these documents."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "seven words of a benchmark item here"), (2, None), (3, ""), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_stages_with_edge_rows_and_clashing_columns(spark):
    folder = f"{tables.shared_folder(spark)}/edge-{tables.fresh()}"
    texts = [*EDGE, *[f"plain words of text number {i} that say this and that and {i * i} more" for i in range(30)], "so here are seven words of a benchmark item here and on", *["tie tie tie tie tie tie"] * 3]
    docs = docs_of(spark, texts, sources=["a", None, "b"])
    docs = docs.unionByName(docs.filter("doc_id in (0, 12, 13)")).unionByName(docs.filter("doc_id = 15").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumns({c: F.lit("mine") for c in CLASH}).withColumn("lang", F.lit(None).cast("string"))
    edge_tables(spark, folder, docs)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert all(r.score == "mine" and r.n == "mine" for r in out.collect())
        assert stage(spark, docs.limit(0), folder).count() == 0
    texts_of = lambda df: Counter(r.text for r in df.collect())
    kept = texts_of(stages["near_copies"](spark, docs, folder))
    assert kept["tie tie tie tie tie tie"] == 1 and kept[None] == 2 and kept[""] == kept["."] == 1 and max(kept[t] for t in texts if t) == 1
    clean = texts_of(stages["decontamination"](spark, docs, folder))
    assert texts_of(docs) - clean == Counter(["so here are seven words of a benchmark item here and on"]) and clean[None] == 2
    mixed = texts_of(stages["mixing"](spark, docs, folder))
    assert mixed[None] == 2 and mixed[""] == 1
    placed = stages["sharding"](spark, docs, folder).collect()
    assert len(placed) == docs.count()
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and final.count() >= 0


def test_pipeline_of_an_empty_table(spark):
    folder = f"{tables.shared_folder(spark)}/empty-{tables.fresh()}"
    edge_tables(spark, folder, docs_of(spark, ["x"]).limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0
