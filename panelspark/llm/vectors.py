"""Sums of dense count vectors that tasks hold, by a tree over chunks of the vectors."""

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

CHUNK = 4096            # counters in one row
FAN = 1024              # lots into which the tasks' rows are dealt before the last sum


def chunks(part: int, counts):
    """Rows (chunk, part, counts) of the chunks of a task's vector that are not zero."""
    for i in range(0, len(counts), CHUNK):
        c = counts[i:i + CHUNK]
        if c.any():
            yield i // CHUNK, part % FAN, zlib.compress(c.astype("<i8").tobytes(), 1)


def _add(table):
    total = np.zeros(CHUNK, dtype=np.int64)
    for c in table.column("counts"):
        one = np.frombuffer(zlib.decompress(c.as_py()), dtype="<i8")
        total[:len(one)] += one
    return zlib.compress(total.tobytes(), 1)


def tree_summed(rows: DataFrame) -> DataFrame:
    """(chunk, counts) of rows (chunk, part, counts): first by lot, then over the lots."""
    import pyarrow as pa

    def lot(key, table):
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_add(table)], pa.binary())})

    kind = "chunk int, counts binary"
    return rows.groupBy("chunk", "part").applyInArrow(lot, kind).groupBy("chunk").applyInArrow(lot, kind)


def dense(rows: DataFrame, n: int):
    """The vector of n counters on the driver; n has to be bounded by the caller."""
    out = np.zeros(-(-n // CHUNK) * CHUNK, dtype=np.int64)
    for r in tree_summed(rows.select("chunk", F.col("part"), "counts")).collect():
        out[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.counts), dtype="<i8")
    return out[:n]
