"""Every registered query of the library proper against DuckDB on the small tables."""

import math

import duckdb
import pytest

from fieldlab.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(v) for v in r]) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(repr([_plain(r[i]) for i in order]) for r in found.fetchall())
