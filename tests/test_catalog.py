"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from quellwerk.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings pages labels conversations".split()


def norm(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=repr)


def test_mean_midway_between_two_rounded_ones(spark, duck):
    """On sf0.01 the mean tax is 0.0399315, so the sixth digit is that of the sum row by row."""
    large = DIR.replace("sf0.001", "sf0.01")
    want = duck.execute(catalog.ORACLES["q_summary_stats"].replace("lineitem", f"'{large}/lineitem.parquet'")).fetchall()
    got = catalog.QUERIES["q_summary_stats"](spark, large).collect()
    assert sorted(map(tuple, got)) == sorted(want)
