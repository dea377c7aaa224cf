import sys

import duckdb
import pytest

import __spark_entry__ as entry
from webloom import plans

SF = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())


def test_without_the_llm_package(monkeypatch):
    real = entry.importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name, *a: None if name == "webloom.llm" else real(name, *a))
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) == set(plans.ORACLE_SQL)


def test_library_does_not_import_llm():
    import subprocess

    code = "import webloom.plans, webloom.api, webloom.streaming.feeds, sys; assert not [m for m in sys.modules if m.startswith('webloom.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10


@pytest.mark.parametrize("name", ["url_normalize", "link_counts", "bfs_depth", "term_df", "search_phrase", "search_boolean", "change_feed_last", "failure_classify"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = con.execute(plans.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(tuple(round(float(x), 6) if isinstance(x, float) else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)
