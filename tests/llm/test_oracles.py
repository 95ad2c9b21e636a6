"""Queries of the training-data operators against their SQL in DuckDB, over whole tables, however these are partitioned."""

import duckdb
import pytest

from larder.llm import queries
from larder.llm.common import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def wanted():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    known = {}

    def rows(name):
        if name not in known:
            found = con.execute(queries.ORACLE_SQL[name])
            names = [d[0] for d in found.description]
            known[name] = sorted(names), sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)
        return known[name]

    return rows


@pytest.mark.parametrize("parts", [None, 16])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, wanted, monkeypatch, name, parts):
    if parts:
        monkeypatch.setattr(queries, "read_table", lambda *a: read_table(*a).repartition(parts))
    got = queries.QUERIES[name](spark, SF)
    columns, want = wanted(name)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want
