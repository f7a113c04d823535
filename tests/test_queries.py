"""Every registered query with SQL gives what DuckDB gives for it."""

import duckdb
import pytest

import __spark_entry__
from siltstone.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows, columns):
    """Rows as sorted tuples, columns by name, numbers to nine digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def equal(frame, con, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert plain(frame.collect(), frame.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir, duck):
    equal(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r.severity for r in rows} == {"CRITICAL", "HIGH", "MEDIUM"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
