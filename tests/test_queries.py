"""Each query against its SQL in DuckDB on sf0.001."""

import duckdb
import pandas as pd
import pytest

from treemill.plans import catalog
from treemill.sources.adapter import Treebank

DATA = "/root/testdata/sf0.001"
TABLES = "documents benchmark events lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return int(x) if isinstance(x, float) and x.is_integer() else round(float(x), 6) if isinstance(x, float) else int(x) if hasattr(x, "__int__") and not isinstance(x, str) else x

    df = df[sorted(df.columns)]
    return sorted(map(repr, (tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_alignment_without_punctuation_only_deletes(spark):
    found = catalog.QUERIES["aligned_edits"](spark, DATA).agg({"inserted": "sum", "deleted": "sum"}).first()
    assert found["sum(inserted)"] == 0 and found["sum(deleted)"] > 0


def test_alignment_takes_every_sentence(spark):
    want = {r.sent_id for r in Treebank(spark, DATA).tokens.where("pos <> 'PUN'").select("sent_id").distinct().collect()}
    assert {r.sent_id for r in catalog.QUERIES["aligned_edits"](spark, DATA).select("sent_id").collect()} == want


def test_import_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, check=True)
    assert min(map(int, out.stdout.split())) >= 70
