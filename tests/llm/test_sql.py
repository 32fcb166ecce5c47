"""Corpus queries against their SQL, on whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from fieldkpi.llm.oracle import ORACLE
from fieldkpi.llm.queries import QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.sql(ORACLE[name])
    kinds = dict(zip(result.columns, (str(t) for t in result.types)))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == kinds
    position = [result.columns.index(c) for c in columns]
    ours = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    theirs = sorted(str(tuple(r[i] for i in position)) for r in result.fetchall())
    assert ours and ours == theirs
