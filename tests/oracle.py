"""Runs queries in Spark and DuckDB and compares rows regardless of order."""

from __future__ import annotations

import glob
import os

import duckdb

TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con



def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    relation = con.sql(sql)
    want_types = {c: TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    got_types = dict(df.dtypes)
    if want_types != got_types:
        return f"schema: spark {got_types} sql {want_types}"
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    cols = sorted(relation.columns)
    want = [tuple(r) for r in relation.project(", ".join(f'"{c}"' for c in cols)).fetchall()]
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    if len(got) != len(want):
        return f"rows: spark {len(got)} sql {len(want)}"
    if not want:
        return "no rows"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} rows differ, first: spark {wrong[0][0]!r:.400} sql {wrong[0][1]!r:.400}" if wrong else None
