"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def kinds(con, sql):
    """Column -> type family of a SQL query."""
    found = con.execute(f"DESCRIBE {sql}").fetchall()
    return {row[0]: _family(row[1].lower()) for row in found}


def _family(kind: str) -> str:
    if kind.startswith(("decimal", "hugeint")):
        return kind
    for family, names in {
        "long": ("bigint", "long"),
        "int": ("integer", "int"),
        "double": ("double",),
        "string": ("varchar", "string"),
        "timestamp": ("timestamp_ntz", "timestamp"),
        "boolean": ("boolean",),
    }.items():
        if kind in names:
            return family
    return kind


def compare(df, con, sql):
    """Differences as text, empty when equal."""
    spark_kinds = {name: _family(kind) for name, kind in df.dtypes}
    sql_kinds = kinds(con, sql)
    if spark_kinds != sql_kinds:
        return f"schema: spark {spark_kinds} sql {sql_kinds}"
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        return ""
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return f"rows {len(got)} vs {len(want)}; only spark {only_got}; only sql {only_want}"
