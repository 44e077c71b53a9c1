from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from sievemark.plans import gating
from tools.check import TABLES, canonical
from tools.plans import shapes

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["duplicate_status", "near_document_links", "describe_measures", "macro_auroc", "decisions", "corruption_sweep", "closed_windows"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_statement_belongs_to_a_query_and_parses(db):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in entry.oracle_sql().items():
        assert db.execute("explain " + sql).fetchall(), name


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql_and_has_no_cross_join(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    assert not shapes(df._jdf.queryExecution().executedPlan().toString())
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)


@pytest.mark.parametrize("name", ["gate_rejections", "condition_confusion"])
def test_answers_without_a_score_search_no_neighbours(spark, db, monkeypatch, name):
    def search(*args, **kwargs):
        raise AssertionError("the result has no score in it")

    monkeypatch.setattr(gating, "kth_cosine", search)
    df = entry.queries()[name](spark, FOLDER)
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)
