"""Side-by-side check of a query and its SQL, order-insensitive."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data), [names[i] for i in order]


SPARK_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(df, con, sql) -> list[str]:
    """Differences found; empty when columns, types and rows agree."""
    result = con.execute(sql)
    duck_names = [c[0] for c in result.description]
    duck_types = {c[0]: str(c[1]) for c in result.description}
    expected, want_names = rows(duck_names, result.fetchall())
    actual, got_names = rows(df.columns, df.collect())
    problems = []
    if want_names != got_names:
        return [f"columns {got_names} != {want_names}"]
    for name, kind in df.dtypes:
        if SPARK_KINDS.get(kind) != duck_types[name]:
            problems.append(f"type of {name}: {kind} vs {duck_types[name]}")
    if len(expected) != len(actual):
        problems.append(f"rows {len(actual)} != {len(expected)}")
    if expected != actual:
        gone, extra = set(expected) - set(actual), set(actual) - set(expected)
        problems.append(f"{len(extra)} unexpected, {len(gone)} missing")
        for label, some in (("spark", extra), ("duck ", gone)):
            for row in sorted(some)[:3]:
                problems.append(f"  {label}: {[(n, v[:120]) for n, v in zip(got_names, row)]}")
    return problems
