"""Streaming forms of the gates, the request-log monitor and duplicate suppression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.operators.ordered import with_running_sums
from sievemark.session import scratch_path


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's Parquet files as a file stream with the table's own schema.

    The table may be one file in ``folder`` or a directory of files.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_time(events: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time as TIMESTAMP with a watermark.

    A zone-less type is rejected by the watermark; its values are read as UTC in any session zone.
    """
    instant = F.col(column).cast("timestamp")
    if isinstance(events.schema[column].dataType, T.TimestampNTZType):
        instant = F.from_utc_timestamp(instant, events.sparkSession.conf.get("spark.sql.session.timeZone"))
    return events.withColumn(column, instant).withWatermark(column, delay)


def gate_stream(rows: DataFrame, decide: Callable[[], Column], name: str = "decision") -> DataFrame:
    """The batch decision column on a stream: stateless, the same expression."""
    return rows.withColumn(name, decide())


def log_monitor(events: DataFrame, ts: str, window: str, kind: str, failed: Column, value: str) -> DataFrame:
    """Requests, failures and latency percentiles per window and kind.

    ``percentile_approx`` keeps a bounded sketch per window, so beyond some 10,000 values its percentiles are near
    ones; :func:`value_cells` and :func:`latencies` give exact ones for a larger state.
    """
    return events.groupBy(F.window(ts, window).alias("w"), kind).agg(
        F.count("*").alias("n"),
        F.sum(failed.cast("long")).alias("failed"),
        F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95)), 10000).alias("p"),
    ).select(
        F.col("w.start").alias("start"), kind, "n", "failed", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95")
    )


def value_cells(events: DataFrame, ts: str, window: str, kind: str, failed: Column, value: str) -> DataFrame:
    """Requests and failures per window, kind and value: what exact percentiles need.

    The state is a row for each distinct value of a window and kind, keyed by all three, so a busy kind is spread over
    all tasks. :func:`latencies` turns the drained cells into one row per window and kind.
    """
    cells = events.groupBy(F.window(ts, window).alias("w"), kind, value).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(failed.cast("long")), F.lit(0).cast("long")).alias("failed")
    )
    return cells.select(F.col("w.start").alias("start"), kind, value, "n", "failed")


def latencies(cells: DataFrame, kind: str, value: str, percents: dict[str, int]) -> DataFrame:
    """Requests, failures and exact percentiles (the value at rank ceil(n * percent / 100)) per window and kind.

    Values are put in order over all tasks; no window or kind is gathered in one. NULL values count as requests only.
    """
    known = cells.withColumn("known", F.when(F.col(value).isNotNull(), F.col("n")).otherwise(F.lit(0).cast("long")))
    run = with_running_sums(known, [value], ["n", "failed", "known"], ["start", kind])
    at = {name: F.expr(f"(known_total * {p} + 99) div 100 - 1") for name, p in percents.items()}
    before, upto = F.col("known_before"), F.col("known_before") + F.col("known")
    picks = [F.max(F.when((rank >= before) & (rank < upto), F.col(value))).alias(name) for name, rank in at.items()]
    return run.groupBy("start", kind).agg(F.max("n_total").alias("n"), F.max("failed_total").alias("failed"), *picks)


def suppress_copies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each content within the watermark; later copies are dropped."""
    return rows.dropDuplicatesWithinWatermark(keys)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Drain the available input into a Parquet table in the checkpoint folder and read it back."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-marks")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", marks)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drain in update mode: every batch is written under its number (a retried batch overwrites
    itself) and the newest state of each key wins."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", marks)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(out)
    others = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_s"))
    return newest.select(*keys, "_s.*")
