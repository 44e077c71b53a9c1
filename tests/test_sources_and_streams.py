from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.operators import joins
from sievemark.plans.registry import Tables
from sievemark.plans.streams import log_monitor
from sievemark.session import checkpoint_root
from sievemark.sources import tables
from sievemark.streaming import jobs


def test_vector_store_appends_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    assert tables.read_vectors(spark, path).count() == 0
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("b", [2.0])], "key string, emb array<float>")
    tables.append_vectors(rows, path)
    tables.append_vectors(rows.unionByName(spark.createDataFrame([("c", [3.0])], rows.schema)), path)
    assert sorted(r.key for r in tables.read_vectors(spark, path).collect()) == ["a", "b", "c"]


def test_history_lines(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"stage": "head", "epoch": 1, "train_loss": 0.5, "note": 3}\n\n{"stage": "full", "epoch": 2}\n')
    rows = tables.read_history(spark, str(tmp_path / "h.jsonl")).orderBy("epoch").collect()
    assert [r.stage for r in rows] == ["head", "full"] and rows[1].train_loss is None


def test_optional_documents(spark, tmp_path):
    (tmp_path / "eval").mkdir()
    (tmp_path / "eval" / "m1.json").write_text(json.dumps({"test": {"macro_f1": 0.9}}, indent=2))
    schema = T.StructType().add("test", T.StructType().add("macro_f1", "double"))
    docs = tables.read_documents(spark, str(tmp_path), {"eval": schema, "ood": T.StructType().add("scorer", "string")})
    base = spark.createDataFrame([("m1",), ("m2",)], "model string")
    out = joins.optional_join(base, [docs["eval"].select("model", F.col("test.macro_f1").alias("f1")), docs["ood"]], "model")
    assert {r.model: (r.f1, r.scorer) for r in out.collect()} == {"m1": (0.9, None), "m2": (None, None)}


def test_partitioned_and_text_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 1), ("test", "b,\"q\"", 2)], "split string, name string, n int")
    tables.write_table(df, str(tmp_path / "p"), ["split"])
    assert tables.read_table(spark, str(tmp_path / "p"), ["name"]).count() == 2
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_alignment_errors(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, p int")
    b = spark.createDataFrame([(1, 0), (3, 1)], "id int, q int")
    with pytest.raises(ValueError):
        joins.align(a, b, "id")
    with pytest.raises(KeyError):
        joins.lookup_all(a, b, "id")
    assert joins.align(a, a.withColumnRenamed("p", "q"), "id").count() == 2
    many = spark.createDataFrame([(1, 5), (1, 4)], "id int, w int")
    assert sorted(map(tuple, joins.attach(a, many, "id").collect())) == [(1, 0, 4), (2, 1, None)]


def test_streams_over_several_files(spark, tmp_path):
    schema = "ts timestamp_ntz, user int, kind string, value double"
    for i in range(3):
        rows = [(f"2024-01-01 0{i}:{m:02d}:00", m % 4, "ok", float(m)) for m in range(0, 60, 5)]
        part = spark.createDataFrame(rows, "ts string, user int, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path), "in", 1)
    assert stream.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    timed = jobs.event_time(stream, "ts", "2 days")
    first = jobs.run_append(jobs.suppress_copies(timed.select("ts", "user"), ["user"]), "t-first")
    assert sorted(r.user for r in first.collect()) == [0, 1, 2, 3]
    monitor = jobs.log_monitor(timed, "ts", "90 minutes", "kind", F.col("value") > 50, "value")
    done = {r.start.strftime("%H:%M"): (r.n, r.failed) for r in jobs.run_update(monitor, "t-monitor", ["start", "kind"]).collect()}
    assert done == {"00:00": (18, 1), "01:30": (18, 2)}


def test_monitor_is_exact_beyond_a_sketch(spark, tmp_path):
    """40,000 values in one window are more than a sketch holds; kinds without a value count their requests."""
    n = 40_000
    value = F.when(F.col("id") < n, F.pmod(F.col("id") * 7919, F.lit(n)) + F.rand(3) / 2)
    kind = F.when(F.col("id") < n, F.lit("a")).when(F.col("id") < n + 3, F.lit("b"))
    rows = spark.range(n + 5).select(kind.alias("event_type"), value.alias("value"), F.expr("timestamp_seconds(1704067200 + id % 20000)").alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    values = sorted(r.value for r in spark.read.parquet(str(tmp_path / "events.parquet")).where("value is not null").collect())
    got = {r.event_type: (r.n, r.failed, r.p50, r.p95) for r in log_monitor(Tables(spark, str(tmp_path))).collect()}
    assert got["a"] == (n, sum(v > 80 for v in values), values[n // 2 - 1], values[n * 95 // 100 - 1])
    assert got["b"] == (3, 0, None, None) and got[None] == (2, 0, None, None)


def test_checkpoint_folder_comes_from_the_session(spark):
    root = checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
