"""The registered queries against their SQL on the driver's smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def rows_of(columns, records):
    def plain(v):
        return round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v

    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in at]) for r in records)


def test_every_query_with_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        found = queries[name](spark, SF)
        expected = con.sql(text)
        assert sorted(found.columns) == sorted(expected.columns), name
        assert rows_of(found.columns, found.collect()) == rows_of(list(expected.columns), expected.fetchall()), name


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
