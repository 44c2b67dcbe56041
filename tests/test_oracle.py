"""Every query that has SQL must give the same rows in DuckDB."""

import duckdb
import pytest

from evenfold.checks.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def same(a, b):
    for x, y in zip(a, b, strict=True):
        if isinstance(x, float) and isinstance(y, float):
            # Values are rounded; the last kept digit may fall either way.
            if abs(x - y) > 2e-6:
                return False
        elif x != y:
            return False
    return True


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    expected = ordered([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])
    got = ordered([tuple(r[c] for c in cols) for r in df.collect()])
    assert len(got) == len(expected)
    if got != expected:
        bad = [(x, y) for x, y in zip(got, expected, strict=True) if not same(x, y)]
        assert not bad, bad[:3]
