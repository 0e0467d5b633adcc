"""Embedding near-dedup by product quantisation.

Vectors of one label link when their cosine reaches the threshold. Unit vectors
are dealt to coarse inverted lists; in its list each has a residual cut into
subspaces, each subspace held as the code of its nearest centroid. A query looks
up distances from its own residual to the codes (asymmetric), keeps what can
still be near enough and reranks that by the exact cosine in double precision.

What the tables leave out: a member y with quantisation error e (known when it
is coded) can be within r of x only if the looked-up distance is at most r + e,
so the lookup loses nothing. Probes: a neighbour within r of x lies in another
list only if x is within r of the border with it. With `exact` all such lists are
probed and no link is lost. By default a narrower border is: an offset of
length r, spread over d directions, has about r / sqrt(d) along the border's
normal, and lists are probed up to PROBE_SIGMAS of that, or up to r where that
is less. d is measured around each list, as the number of directions that the
sample's nearest vectors vary in; where they vary in PROBE_SIGMAS ** 2 or fewer
the default is exact as well. Pairs in different lists are looked for
once, from the side with the higher list number.

Equal vectors of a label are counted before anything else and searched as one
vector of that weight, so a group of copies costs what one vector does. Lists
longer than CHUNK are cut, and members and queries meet chunk by chunk, so
a group's memory is bounded whatever its list; each group sends a count for each
vector and links to one vector for each local component, not its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tables, textops

COSINE = 0.98
#: Bound of the vectors that the lists and codes are fitted on.
MOST_FITTED = 16_384
MOST_LISTS, SUBSPACES, CODES, ROUNDS = 1024, 16, 256, 8
PROBE_SIGMAS = 4.0
#: The sample's vectors around a list that its directions are counted on.
AROUND = 64
CHUNK = 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        size = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


@dataclass
class Index:
    centres: np.ndarray  # lists x dimensions
    cuts: list[int]  # bounds of the subspaces
    books: list[np.ndarray]  # codes x the subspace's dimensions
    directions: np.ndarray  # around each list

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error) of unit vectors."""
        home = _nearest(unit, self.centres)
        rest = unit - self.centres[home]
        codes = np.zeros((len(unit), len(self.books)), np.uint8)
        error = np.zeros(len(unit))
        for s, book in enumerate(self.books):
            part = rest[:, self.cuts[s] : self.cuts[s + 1]]
            codes[:, s] = _nearest(part, book)
            error += ((part - book[codes[:, s]]) ** 2).sum(1)
        return home, codes, np.sqrt(error)

    def probes(self, unit: np.ndarray, home: np.ndarray, reach: float, exact: bool = False) -> np.ndarray:
        """Which lists of lower number than its own each vector probes, as a table of booleans."""
        square = (self.centres**2).sum(1)
        apart = square[None] - 2 * unit @ self.centres.T
        apart -= apart[np.arange(len(unit)), home][:, None]
        between = np.sqrt(np.maximum(square[home][:, None] + square[None] - 2 * self.centres[home] @ self.centres.T, 1e-12))
        border = reach
        if not exact:
            fewer = np.minimum(self.directions[home][:, None], self.directions[None])
            border = np.minimum(reach, PROBE_SIGMAS * reach / np.sqrt(fewer))
        near = apart / (2 * between) <= border + 1e-9
        near &= np.arange(len(self.centres))[None] < home[:, None]
        return near

    def lookup(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of each query's residual (to the members' list) to each member's code."""
        out = np.zeros((len(rest), len(codes)))
        for s, book in enumerate(self.books):
            part = rest[:, self.cuts[s] : self.cuts[s + 1]]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None]
            out += table[:, codes[:, s]]
        return np.maximum(out, 0)


def directions(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """In how many directions the sample varies around each centre.

    The square of the variances' sum over the sum of their squares (1 for a line, d for
    a ball in d dimensions) of the AROUND nearest vectors, corrected for their small number.
    """
    n = min(AROUND, len(sample))
    out = np.ones(len(centres))
    for i, centre in enumerate(centres if n > 2 else ()):
        near = sample[np.argpartition(((sample - centre) ** 2).sum(1), n - 1)[:n]]
        near = near - near.mean(0)
        total = (near**2).sum() / (n - 1)
        squares = ((near.T @ near / (n - 1)) ** 2).sum() - total**2 / (n - 1)
        out[i] = sample.shape[1] if squares * sample.shape[1] <= total**2 else total**2 / squares
    return np.clip(out, 1, sample.shape[1])


def fit(sample: np.ndarray, rows: int, seed: int = 11) -> Index:
    """An index from unit vectors; about sqrt(rows) lists, MOST_LISTS at most."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    centres = kmeans(sample, int(min(MOST_LISTS, len(sample), max(1, round(rows**0.5)))), rng)
    rest = sample - centres[_nearest(sample, centres)]
    cuts = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int).tolist()
    books = [kmeans(rest[:, a:b], min(CODES, len(rest)), rng) for a, b in zip(cuts, cuts[1:])]
    return Index(centres, cuts, books, directions(sample, centres))


def _units(blobs) -> np.ndarray:
    x = np.stack([np.frombuffer(b, np.float64) for b in blobs])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dims, raw, digest) of every row; raw and digest are null where the vector or its label can't link."""

    def run(batches):
        for batch in batches:
            dims, raw = [], []
            for vector, label in zip(batch.column("embedding"), batch.column("label")):
                x = None
                if vector.is_valid and label.is_valid and len(vector) and vector.values.null_count == 0:
                    x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(over="ignore"):
                        x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else None
                dims.append(None if x is None else len(x))
                raw.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label").cast(pa.string()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "dims", "raw"]
            )

    schema = tables.schema_with(embeddings, ["vec_id"], "label string, dims int, raw binary")
    rows = embeddings.select("vec_id", "embedding", "label").mapInArrow(textops.released(run), schema)
    return rows.withColumn("digest", F.unhex(F.sha2("raw", 256)))


def distinct(found: DataFrame) -> DataFrame:
    """(label, dims, digest, raw, weight, least, uid): each different vector of a label, its rows and their smallest vec_id."""
    once = found.filter("raw is not null").groupBy("label", "dims", "digest", "raw").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    return once.withColumn("uid", F.monotonically_increasing_id())


def _coded(valid: DataFrame, models, reach: float, exact: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for dims in set(batch.column("dims").to_pylist()):
                part = batch.filter(pa.array([d == dims for d in batch.column("dims").to_pylist()]))
                for at in range(0, len(part), 2048):
                    rows = part.slice(at, 2048)
                    unit = _units(rows.column("raw").to_pylist())
                    home, codes, error = models.value[dims].code(unit)
                    near = models.value[dims].probes(unit, home, reach, exact)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[rows.column(c) for c in ("uid", "label", "dims", "raw", "weight")],
                            pa.array(home, pa.int32()),
                            pa.array([c.tobytes() for c in codes], pa.binary()),
                            pa.array(error),
                            pa.array([np.flatnonzero(n).tolist() for n in near], pa.list_(pa.int32())),
                        ],
                        ["uid", "label", "dims", "raw", "weight", "home", "codes", "error", "probes"],
                    )

    schema = "uid long, label string, dims int, raw binary, weight long, home int, codes binary, error double, probes array<int>"
    return valid.select("uid", "label", "dims", "raw", "weight").mapInArrow(textops.released(run), schema)


def _searched(coded: DataFrame, models, cosine: float, reach: float) -> DataFrame:
    """(uid, n, up): partial link counts and links to one vector of each local component."""
    key = ["label", "dims", "list"]
    members = coded.withColumn("list", F.col("home"))
    asking = coded.withColumn("list", F.explode(F.concat(F.array("home"), "probes")))
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(CHUNK))).cast("int")
    sizes = asking.groupBy(*key).agg(F.count("*").alias("q"), F.count_if(F.col("home") == F.col("list")).alias("m")).filter("m > 0")
    # one row a list: sent to every task if few enough, so that a long list's vectors don't meet in one
    sizes = tables.small(sizes.select(*key, cut("m").alias("m_parts"), cut("q").alias("q_parts")), "sizes")
    dealt = lambda df, own, other: df.join(sizes, key).withColumn(f"{own}_part", F.pmod(F.xxhash64("uid"), F.col(f"{own}_parts")).cast("int")).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)))
    columns = ["uid", "raw", "weight", "home", "codes", "error", "member", *key, "m_part", "q_part"]
    both = (
        dealt(members, "m", "q").withColumn("member", F.lit(True)).select(*columns)
        .unionByName(dealt(asking, "q", "m").withColumn("member", F.lit(False)).withColumn("codes", F.lit(None).cast("binary")).select(*columns))
    )

    def run(group: pa.Table) -> pa.Table:
        none = pa.table({"uid": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "up": pa.array([], pa.int64())})
        member = group.column("member").to_numpy()
        if member.all() or not member.any():
            return none
        at, model = group.column("list")[0].as_py(), models.value[group.column("dims")[0].as_py()]
        uid, home, weight = (group.column(c).to_numpy() for c in ("uid", "home", "weight"))
        unit = _units(group.column("raw").to_pylist())
        order = np.argsort(uid, kind="stable")
        mine, asks = order[member[order]], order[~member[order]]
        codes = np.stack([np.frombuffer(c, np.uint8) for c in group.column("codes").take(pa.array(mine)).to_pylist()])
        limit = reach + group.column("error").to_numpy()[mine] + 1e-9
        n = np.zeros(len(uid), np.int64)
        left, right = [], []
        for a in range(0, len(asks), 256):
            q = asks[a : a + 256]
            maybe = model.lookup(unit[q] - model.centres[at], codes) <= limit[None] ** 2
            # in one list every pair is looked at once, from the higher uid
            maybe &= (home[q] != at)[:, None] | (uid[q][:, None] > uid[mine][None])
            i, j = np.nonzero(maybe)
            for b in range(0, len(i), 65_536):
                x, y = q[i[b : b + 65_536]], mine[j[b : b + 65_536]]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                left.append(x[near])
                right.append(y[near])
        x, y = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
        if not len(x):
            return none
        np.add.at(n, x, weight[y])
        np.add.at(n, y, weight[x])
        # the same vector may be here as member and as query
        ids, place = np.unique(uid, return_inverse=True)
        root = _forest(len(ids), place[x], place[y])
        count = np.bincount(place, weights=n, minlength=len(ids)).astype(np.int64)
        some = np.flatnonzero(count)
        return pa.table({"uid": ids[some], "n": count[some], "up": ids[root[some]]})

    return both.groupBy(*key, "m_part", "q_part").applyInArrow(run, "uid long, n long, up long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component under links a-b: rounds of hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def near_copies(embeddings: DataFrame, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine is at
    least `cosine`; `exact` loses none of the links, by more probes. vec_id keeps its type. Null, zero or empty vectors and those with null or
    non-finite components link with nothing; vectors of different lengths don't
    link; repeated rows are vectors of their own; a null vec_id is never a
    component's id unless alone; an empty table gives an empty result. Other columns are not read.
    """
    spark = embeddings.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine))
    found = prepared(embeddings)
    rows = tables.written(found.select("vec_id", "label", "digest"), "vectors")
    valid = tables.written(distinct(found), "distinct")
    fitted, total = {}, 0
    for r in valid.groupBy("dims").agg(F.count("*").alias("n"), F.sum("weight").alias("rows")).collect():
        total += r["rows"]
        part = F.pmod(F.xxhash64(F.lit("fit"), "digest"), F.lit(1 << 30)) / float(1 << 30)
        of_size = valid.filter(F.col("dims") == r["dims"])
        sample = of_size.filter(part < MOST_FITTED / r["n"]).orderBy("digest", "label").select("raw").toArrow()
        blobs = sample.column("raw").to_pylist() or [of_size.orderBy("digest", "label").first()["raw"]]
        fitted[r["dims"]] = fit(_units(blobs), r["n"])
    models = spark.sparkContext.broadcast(fitted)
    coded = tables.written(_coded(valid, models, reach, exact), "coded")
    counts = tables.written(_searched(coded, models, cosine, reach), "counts")
    together = tables.components(counts.filter("uid != up").select(F.col("uid").alias("a"), F.col("up").alias("b")))
    others = counts.groupBy("uid").agg(F.sum("n").alias("others"))
    placed = (
        valid.select("uid", "label", "digest", "weight", "least")
        .join(others, "uid", "left")
        .join(together.withColumnRenamed("node", "uid"), "uid", "left")
        .withColumn("component", F.coalesce("component", "uid"))
    )
    placed = tables.written(placed, "placed")
    # read from a table, so that adaptive execution can split a component that holds many vectors
    smallest = tables.written(placed.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    answer = placed.join(smallest, "component").select(
        F.concat_ws(" ", "label", F.hex("digest")).alias("vector"), "weight", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    answer = tables.written(answer, "answer")
    linkable = rows.filter("digest is not null").select("vec_id", F.concat_ws(" ", "label", F.hex("digest")).alias("vector"))
    linked = tables.skew_join(linkable, answer, "vector", "weight", total).select("vec_id", "n_links", "component_id")
    alone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept)


#: All links in SQL, over a table embeddings (vec_id, embedding, label): what near_copies(exact=True) gives, and the default where it loses none.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
n AS MATERIALIZED (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.root = l.x),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
