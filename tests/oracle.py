"""Rows of a Spark query beside those of its DuckDB SQL over the same files."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def of_spark(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple((n, _plain(r[n])) for n in names) for r in df.collect())


def of_duckdb(sql: str, sf_dir: str) -> Counter:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return Counter(tuple(sorted((n, _plain(v)) for n, v in zip(names, row, strict=True))) for row in found.fetchall())


def differences(df, sql: str, sf_dir: str) -> list:
    a, b = of_spark(df), of_duckdb(sql, sf_dir)
    return [("spark", list((a - b).items())[:2]), ("sql", list((b - a).items())[:2])] if a != b else []
