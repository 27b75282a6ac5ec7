"""Every query of the registry that has SQL, against DuckDB on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quirekit.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_integer_ratio"):
        return str(v)
    return format(round(float(v), 4) + 0.0, ".4f")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in names] for r in df.collect())
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        at = {d[0]: i for i, d in enumerate(found.description)}
        assert sorted(at) == names
        assert rows == sorted([plain(r[at[c]]) for c in names] for r in found.fetchall())
    else:
        assert rows


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["file", "lines", "errors", "ref_len", "rate"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
