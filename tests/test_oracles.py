"""Every query with an SQL equivalent gives its rows on the smallest tables."""

import math

import duckdb
import pytest

from marginalia.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    r = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)
    assert got == want


def test_every_query_is_registered_once():
    assert len(registry.QUERIES) >= 85
    assert set(registry.ORACLES) <= set(registry.QUERIES)
