"""Copies on a stream: the first arrival of a content is kept, later ones point to it, and state expires.

Unlike dropping copies, every row comes out, with the id of the row it repeats. A kept row stands for its
content until ``horizon`` after its own event time; the next row from then on is kept anew. State is one id
and one time for each content, removed by an event-time timer once the watermark has passed the horizon.

Rows of one micro-batch are taken in event-time order, ties by id, so how files fall into batches does not
matter as long as batches follow each other in time. Rows behind the watermark are dropped by the engine. What
a task holds of one content is the times and ids of one micro-batch, which the source's trigger bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Keeper(StatefulProcessor):
    """One content: its kept row, and a timer that forgets it."""

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "id long, at long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = self.kept.get() if self.kept.exists() else None
        kept = first
        for at, row in sorted((r._at, r._id) for r in rows):
            if kept is None or at >= kept[1] + self.horizon:
                kept = (row, at)
                yield Row(_id=row, duplicate_of=None)
            else:
                yield Row(_id=row, duplicate_of=kept[0])
        if kept is not None and kept != first:
            if first is not None:
                self.handle.deleteTimer(first[1] + self.horizon)
            self.kept.update(kept)
            self.handle.registerTimer(kept[1] + self.horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def point_to_kept(rows: DataFrame, keys: list[str], row_id: str, ts: str, horizon_ms: int) -> DataFrame:
    """``(row_id, duplicate_of)`` of a stream with a watermark on ``ts``; NULL is kept.

    Sets the session's state store to RocksDB, which these timers need. Rows without a time, an id or a key
    belong to no content and are left out by the caller.
    """
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    slim = rows.select(*keys, F.col(row_id).alias("_id"), F.unix_millis(ts).alias("_at"), ts)
    found = slim.groupBy(*keys).transformWithState(Keeper(horizon_ms), "_id long, duplicate_of long", "Append", "EventTime")
    return found.withColumnRenamed("_id", row_id)
