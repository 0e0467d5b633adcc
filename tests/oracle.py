"""Runs registered queries beside their SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def database(sf_dir: str = SF):
    found = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return found


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: [(v is None, str(type(v)), v) for v in r])


def compare(spark, query, sql, sf_dir: str = SF, db=None):
    df = query(spark, sf_dir)
    db = db or database(sf_dir)
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    return sorted(df.columns) == sorted(names), got, want
