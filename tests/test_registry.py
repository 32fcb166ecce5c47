"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


# The optional corpus operators have tests of their own.
OWN = sorted(registry._QUERIES)


def test_every_query_has_a_check():
    assert set(OWN) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    kinds = dict(zip(result.columns, (str(t) for t in result.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds

    ours = ordered(tuple(r[c] for c in columns) for r in df.collect())
    position = [result.columns.index(c) for c in columns]
    theirs = ordered(tuple(r[i] for i in position) for r in result.fetchall())
    assert ours, "the check says nothing about an empty result"
    assert ours == theirs
    assert not any(isinstance(v, float) and math.isnan(v) for r in ours for v in r)


def test_entry(spark):
    assert len(registry.entry(spark).columns) == 38
