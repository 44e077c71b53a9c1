"""What the operators of this folder share: batches of texts in tasks, and words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# bytes.split() and bytes.strip() without arguments know exactly the separators \x20 and \x09-\x0D
SPACES = b" \t\n\x0b\x0c\r"
# UTF-8 bytes that continue a code point: deleting them leaves one byte for each code point
CONTINUATION = bytes(range(0x80, 0xC0))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def with_columns(
    df: DataFrame,
    outputs: str | T.StructType,
    compute: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` plus the columns that ``compute`` makes of each Arrow batch, in its own partitions.

    A column of ``df`` that has the name of an output is replaced. ``keep`` limits the columns of
    ``df`` that are returned.
    """
    new = T.StructType.fromDDL(outputs) if isinstance(outputs, str) else outputs
    old = [f for f in df.schema if f.name not in new.names and (keep is None or f.name in keep)]
    kept = [f.name for f in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = compute(batch)
            columns = [batch.column(c) for c in kept] + [made[c] for c in new.names]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *new.names])

    return df.mapInArrow(run, T.StructType([*old, *new]))
