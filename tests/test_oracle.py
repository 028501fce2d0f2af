"""Every query that has SQL against DuckDB on a small scale, row for row."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA
from verdara.plans.registry import QUERIES, SQL

SF = f"{DATA}/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), want.columns)


def test_ts_join_leaves_no_order_out(spark, duck):
    want = duck.sql("SELECT count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)").fetchall()[0]
    got = QUERIES["ts_join"](spark, SF)
    assert (got.count(), got.select("o_orderkey").distinct().count()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_formats_of_large_keys(spark, tmp_path):
    """Sizes beyond a terabyte and spans beyond a thousand years, which sf0.01 doesn't have."""
    path = str(tmp_path / "part.parquet")
    c = duckdb.connect()
    c.sql(f"COPY (SELECT p_partkey + 20000 * r AS p_partkey, p_name FROM '{SF}/part.parquet', range(8) t(r)) TO '{path}' (FORMAT parquet)")
    c.sql(f"CREATE VIEW part AS FROM '{path}'")
    got, want = QUERIES["formats"](spark, str(tmp_path)), c.sql(SQL["formats"])
    rows = table(want.fetchall(), want.columns)
    assert table(got.collect(), got.columns) == rows and all(any(part in v for r in rows for v in r) for part in (" TB", "about 1,"))
