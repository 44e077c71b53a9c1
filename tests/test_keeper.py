from __future__ import annotations

import time
from datetime import datetime, timedelta

from sievemark.session import scratch_path
from sievemark.streaming import jobs, keeper

DAY = datetime(2024, 5, 1)
HOUR = 3_600_000
SCHEMA = "id long, k string, ts timestamp"


def drained(spark, batches):
    """Each batch is a file of its own, read one at a time in the order of writing."""
    folder = scratch_path(spark, "rows")
    for rows in batches:
        data = [(i, k, DAY + timedelta(hours=h)) for i, k, h in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their seconds
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "1 hour")
    out = jobs.run_append(keeper.point_to_kept(stream, ["k"], "id", "ts", 10 * HOUR), "pointers")
    return {r.id: r.duplicate_of for r in out.collect()}


def test_several_batches_late_rows_and_expiry(spark):
    got = drained(
        spark,
        [
            [(1, "a", 0), (2, "a", 1), (3, "b", 1)],
            [(4, "a", 9.5), (5, "b", 5), (6, "b", 6)],  # still within ten hours of the first
            [(7, "a", 10), (8, "a", 12)],  # ten hours on: kept anew
            [(9, "z", 40)],  # moves the watermark past every kept row
            [(10, "b", 2), (11, "a", 41)],  # late: dropped; state is gone, so kept
            [(12, "a", 42), (13, "z", 41)],
        ],
    )
    assert got == {1: None, 2: 1, 3: None, 4: 1, 5: 3, 6: 3, 7: None, 8: 7, 9: None, 11: None, 12: 11, 13: 9}


def test_order_within_a_batch_is_event_time(spark):
    assert drained(spark, [[(5, "a", 3), (4, "a", 1), (3, "a", 1), (2, "a", 12), (1, "a", 11)]]) == {3: None, 4: 3, 5: 3, 1: None, 2: 1}
