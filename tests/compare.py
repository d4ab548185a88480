"""Compare a Spark result with DuckDB's on names, types and rows."""

from __future__ import annotations

import glob
import os

import duckdb

# Spark type -> DuckDB type
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
    "double": "DOUBLE", "boolean": "BOOLEAN",
}


def database(folder):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = [tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(tidy, key=_key)


def compare(df, db, sql):
    """Return a list of differences, empty when both agree."""
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    kinds = [str(c[1]) for c in found.description]
    expected = rows_of(names, found.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    ours = {n: TYPES.get(t, t) for n, t in df.dtypes}
    theirs = dict(zip(names, kinds))
    for n in names:
        if ours[n] != theirs[n]:
            problems.append(f"{n}: type {ours[n]} against {theirs[n]}")
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows against {len(expected)}")
    if actual != expected:
        a, e = set(actual), set(expected)
        problems.append(f"only ours {sorted(a - e, key=_key)[:3]}, only theirs {sorted(e - a, key=_key)[:3]}")
    return problems
