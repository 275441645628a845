"""Every property query against its SQL on the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from hearthspark.plans import place_queries  # noqa: E402, F401
from hearthspark.plans.queries import QUERIES, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found
    if name in SQL:
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = con.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert found == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
