"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def _value(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return float(v)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=str)


def assert_same(spark_df, sql: str, folder: str = DATA) -> None:
    c = connection(folder)
    relation = c.sql(sql)
    assert sorted(relation.columns) == sorted(spark_df.columns)
    types = {n: TYPES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types, strict=True)}
    assert types == {n: t for n, t in spark_df.dtypes if n in types}
    got, want = rows(spark_df.columns, spark_df.collect()), rows(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
