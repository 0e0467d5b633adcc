"""Sharding by a hierarchical weighted hash tree.

The tree is region / rack / shard; a node's weight is that of the shards below
it. A key descends level by level: each child of the node it has reached draws an
exponential variable whose rate is the child's weight, from a hash of the key
and the child's name, and the least draw wins. So a key costs as many hashes as the
nodes on its path have children, not as many as there are shards.

A change of a shard's weight changes the weights on its own path only: at each level keys move
only into or out of the child on that path, and all movement is confined to the
subtrees whose weights change. Keys that come into a region or rack are dealt among all
shards in it; therefore a shard added by grown() opens a region of its own, which
takes keys only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tables

SHARDS_PER_RACK, RACKS_PER_REGION = 5, 4
ROW_BYTES = 16
#: Equal rows are numbered in runs of this many.
RUN = 4096

Leaf = tuple[int, int, int, float]


def tree(shards: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """(region, rack, shard, weight) of each shard, filled rack by rack; weight 1 unless given."""
    racks = [s // SHARDS_PER_RACK for s in range(shards)]
    return [(r // RACKS_PER_REGION, r, s, float((weights or {}).get(s, 1.0))) for s, r in enumerate(racks)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one shard more, in a region and rack of its own."""
    region, rack, shard = (max((x[i] for x in leaves), default=-1) + 1 for i in range(3))
    return [*leaves, (region, rack, shard, weight)]


def assign(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that `key` (null is a key like any other) descends to.

    Shards of weight 0 or less get nothing. Ties between draws go to the node
    of the smaller number; without shards of weight the result is null.
    """
    known = F.coalesce(key.cast("string"), F.lit("null"))
    live = [x for x in leaves if x[3] > 0]
    if not live:
        return F.lit(None).cast("int")

    def node(kind: str, number: int, weight: float, at: int) -> Column:
        return F.struct(F.lit(f"{kind}-{number}").alias("name"), F.lit(weight).alias("weight"), F.lit(number).alias("number"), F.lit(at).alias("at"))

    def draw(child: Column) -> Column:
        # 52 bits of a hash as a number above 0 and below 1
        bits = F.conv(F.substring(F.md5(F.concat(known, F.lit("/"), child["name"]).cast("binary")), 1, 13), 16, 10)
        return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / child["weight"]

    def winner(children: Column) -> Column:
        return F.array_min(F.transform(children, lambda c: F.struct(draw(c).alias("draw"), c["number"].alias("number"), c["at"].alias("at"))))

    # children by their parent's place among the nodes of its level; all of it constants
    under: dict[int, dict[int, list[tuple[int, float]]]] = {}
    for region, rack, shard, weight in live:
        under.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
    regions, racks, shards = [], [], []
    for region, inner in sorted(under.items()):
        regions.append(node("region", region, sum(w for found in inner.values() for _, w in found), len(racks) + 1))
        mine = []
        for rack, found in sorted(inner.items()):
            shards.append(F.array(*[node("shard", s, w, 0) for s, w in sorted(found)]))
            mine.append(node("rack", rack, sum(w for _, w in found), len(shards)))
        racks.append(F.array(*mine))
    region = winner(F.array(*regions))
    rack = winner(F.element_at(F.array(*racks), region["at"]))
    return winner(F.element_at(F.array(*shards), rack["at"]))["number"]


def place(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text, ...).

    The law is `key`: doc_id and the shard count decide, and grown_shard is the
    shard under one shard more. size is the text's UTF-8 bytes plus 16. Slots
    count each shard's rows from 0 without gaps in the order of doc_id (null first), text_crc32 and size: equal
    rows are counted, the counts summed range by range of that order, and the
    rows of a count made anew, in runs that are tasks' work of their own,
    so no task holds a whole shard or all of a row's repeats. Null text counts as no bytes;
    a null doc_id is a key; doc_id keeps its type;
    repeated rows go to one shard and get a slot each; an empty table
    gives an empty result. Other columns of docs are not read.
    """
    raw, leaves = F.coalesce(F.col("text"), F.lit("")), tree(shards)
    slim = docs.select(
        "doc_id",
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        assign(F.col("doc_id"), leaves).cast("int").alias("shard"),
        assign(F.col("doc_id"), grown(leaves)).cast("int").alias("grown_shard"),
    )
    same = tables.written(slim.groupBy(*slim.columns).agg(F.count("*").alias("n")), "placed")
    order = [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size")]
    placed = tables.written(tables.before(same, order, place=F.col("n")), "ordered")
    # one row a shard
    starts = placed.groupBy(F.col("shard").alias("of")).agg(F.min("place").alias("start"))
    first = placed.join(F.broadcast(starts), F.col("shard").eqNullSafe(F.col("of"))).withColumn("first", F.col("place") - F.col("start"))
    last = F.col("first") + F.col("n") - 1
    few = first.filter(F.col("n") <= RUN).withColumn("slot", F.explode(F.sequence("first", last)))
    runs = first.filter(F.col("n") > RUN).withColumn("from", F.explode(F.sequence("first", last, F.lit(RUN).cast("long"))))
    many = runs.repartition(F.col("from")).withColumn("slot", F.explode(F.sequence("from", F.least(last, F.col("from") + RUN - 1))))
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return few.select(*columns).unionByName(many.select(*columns))


#: The same in SQL, over a table documents (doc_id, text): trees of 40 and of 41 shards, walked level by level.
SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS entries FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i))),
d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT row_, octet_length(raw) + 16 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
leaf AS (SELECT n, s AS shard, s // 5 AS rack, s // 20 AS region FROM (VALUES (40), (41)) AS t(n), range(41) AS r(s) WHERE s < n),
node AS (SELECT n, 'region' AS kind, -1 AS above, region AS number, count(*) AS weight FROM leaf GROUP BY ALL
         UNION ALL SELECT n, 'rack', region, rack, count(*) FROM leaf GROUP BY ALL UNION ALL SELECT n, 'shard', rack, shard, 1 FROM leaf),
draw AS (SELECT row_, n, kind, above, number, -ln((('0x' || substr(md5(k || '/' || kind || '-' || number), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS draw FROM d, node),
one AS (SELECT row_, n, arg_min(number, draw) AS region FROM draw WHERE kind = 'region' GROUP BY ALL),
two AS (SELECT row_, n, arg_min(number, draw) AS rack FROM one JOIN draw USING (row_, n) WHERE kind = 'rack' AND above = region GROUP BY ALL),
three AS (SELECT row_, n, arg_min(number, draw) AS shard FROM two JOIN draw USING (row_, n) WHERE kind = 'shard' AND above = rack GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, x.shard::INTEGER AS shard, row_number() OVER (PARTITION BY x.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, y.shard::INTEGER AS grown_shard
FROM d JOIN b USING (row_) JOIN three x ON x.row_ = d.row_ AND x.n = 40 JOIN three y ON y.row_ = d.row_ AND y.n = 41
"""
