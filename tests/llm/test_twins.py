"""The operators' DuckDB twins give the queries' rows."""

import math

import duckdb
import pytest

from barloom.llm import queries, sql

SF = "/root/testdata/sf0.01"


def rows_of(frame):
    cols = sorted(frame.columns)
    text = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[cols].itertuples(index=False)), cols


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows_of(queries.queries()[name](spark, SF).toPandas()) == rows_of(db.execute(sql.oracle_sql()[name]).fetchdf())
