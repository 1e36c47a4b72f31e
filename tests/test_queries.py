"""Every registered query against its SQL, at the smallest scale."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from kinweave.plans import queries as core
from kinweave.plans import reports  # noqa: F401  registers further queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(df, sql, data=DATA):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'").fetchall()
    r = c.cursor().execute(sql)
    names, rows = [x[0] for x in r.description], r.fetchall()
    got = df.toArrow()
    assert sorted(names) == sorted(got.column_names)
    norm = lambda v: round(v, 8) if isinstance(v, float) else v
    order = sorted(names)
    want = Counter(tuple(norm(row[names.index(n)]) for n in order) for row in rows)
    have = Counter(tuple(map(norm, row)) for row in zip(*[got.column(n).to_pylist() for n in order]))
    assert want == have


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, name):
    same(core.QUERIES[name](spark, DATA), core.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(e.queries()) and set(core.ORACLES) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_search_in_hosts_of_any_size(spark, tmp_path):
    """Hosts above the default cap of a group, and urls with no scheme or a second one."""
    from kinweave.plans.config import DEFAULT_CAP

    urls = ["http://a.Example.net/x"] * (DEFAULT_CAP + 1) + ["https://b.example.net/?to=http://c.example.com/"] * 2 + ["http://d.example.com/?to=http://e.example.net/", "f.example.net/y", "", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    same(core.QUERIES["search_literal"](spark, str(tmp_path)), core.ORACLES["search_literal"], tmp_path)
