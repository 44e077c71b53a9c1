from __future__ import annotations

import duckdb
import pytest
from fixtures_llm import AWKWARD, SCHEMA, documents
from pyspark.sql import functions as F

from sievemark.llm import mixing
from tools.check import canonical

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def against_sql(df):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    db.executemany("insert into documents values (?, ?, ?, ?, ?)", [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    cur = db.execute(mixing.oracle())
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    got = mixing.mix(df).select(*COLUMNS)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == want


def test_awkward_rows_equal_sql(spark):
    against_sql(documents(spark))
    out = mixing.mix(documents(spark, extra=["size", "taken", "_n"]))
    assert out.schema["size"].dataType.simpleString() == "bigint" and out.count() == len(AWKWARD)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "x", None, 1)], SCHEMA)).first().target == 0.0


@pytest.mark.parametrize("hot", [0.3, 0.95])
def test_many_sources_and_a_hot_one(spark, hot):
    rows = [
        (i, "w " * (1 + i * 7919 % 60), "x", "hot" if i % 100 < 100 * hot else f"s{i % 23:02d}", 0)
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    against_sql(df)
    out = mixing.mix(df)
    assert out.where("taken > 2 * size").isEmpty()
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= 30.5 and r.g <= 2 * r.s + 1e-6 for r in per)
    assert abs(sum(r.g for r in per) - 1.5 * sum(r.s for r in per)) < 1e-3
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in out.collect()}


def test_copies_are_rows(spark):
    df = documents(spark).where("size(split(text, ' ')) > 3")
    want = {i: n for i, n in mixing.mix(df).groupBy("doc_id").agg(F.sum("copies")).collect() if n}
    got = dict(mixing.mixed(df).groupBy("doc_id").count().collect())
    assert got == want and mixing.mixed(df).columns == df.columns
