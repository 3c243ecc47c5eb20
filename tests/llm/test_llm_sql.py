"""Corpus queries with SQL give what DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import registry


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda v: "" if v is None or v != v or str(v) in ("nan", "<NA>", "NaT") else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
