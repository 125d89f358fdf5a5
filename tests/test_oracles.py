"""Each engine query beside its SQL twin, over the smallest tables."""

import duckdb
import numpy as np
import pytest

from lodestone import queries as own

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = own.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, np.floating)):
        return f"{value:.6f}"
    return str(int(value)) if isinstance(value, (bool, int, np.integer)) else str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    df = own.queries()[name](spark, DIR)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = table(df.collect(), df.columns), table(cursor.fetchall(), columns)
    assert got == want


def test_every_query_without_a_twin_runs(spark):
    for name in sorted(set(own.queries()) - set(SQL)):
        assert own.queries()[name](spark, DIR).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
