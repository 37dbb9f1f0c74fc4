"""Every registered query against its DuckDB twin on the smallest fixture (rows, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from bytelake.plans import catalog

from .conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NOT_SQL = {"sample_alias"}  # draws from alias tables, see test_alias_bloom.py


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "inf" if math.isinf(v) else repr(round(v, 6))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) - NOT_SQL == set(catalog.ORACLE) and set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, cur.fetchall())


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", ["token_weights", "corpus_profile", "encoding_audit", "reward_dataset", "doc_perplexity", "scale_sweep"])
def test_output_types_agree(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    cur = con.execute(f"SELECT * FROM ({E.oracle_sql()[key]}) LIMIT 0")
    duck = {d[0]: str(d[1]) for d in cur.description}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == duck


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 256 and df.columns == ["byte", "cnt", "freq", "weight"]
