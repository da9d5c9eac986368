"""Compare a registered query with its DuckDB oracle, order aside."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    held = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return held


def rows(columns: list[str], found: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


def differs(spark, held, name: str, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    result = held.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {df.columns} against {names}"
    if ours != theirs:
        return f"{name}: {len(ours)} rows against {len(theirs)}; ours only {sorted(set(ours) - set(theirs))[:3]}, theirs only {sorted(set(theirs) - set(ours))[:3]}"
    return None
