"""Counters of fixed number by hash, which tell what is very frequent in a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coppice.llm.common import stored

# Counters, as a power of two: 2 MB, whatever the corpus.
TABLE_BITS = 19
_SUM_AT_A_TIME = 8


def frequent_from(counts: np.ndarray, least: int) -> float:
    """The count above which a counter holds something frequent: ``least`` above the mean, and
    beyond what rare things that share a counter make by chance."""
    return float(counts.mean() + max(least, 8 * counts.mean() ** 0.5))


def added(tables: DataFrame) -> np.ndarray:
    """The tasks' tables added up, some at a time, level by level, so that no task holds many."""
    size = 1 << TABLE_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column("counts"):
                table += unpacked(data.as_py())
        yield pa.RecordBatch.from_pydict({"counts": pa.array([packed(table)], pa.binary())})

    n = tables.count()
    while n > _SUM_AT_A_TIME:
        n = -(-n // _SUM_AT_A_TIME)
        tables = stored(tables.repartition(n).mapInArrow(add, "counts binary"), "counts")
    total = np.zeros(size, np.int64)
    for row in tables.toLocalIterator():
        total += unpacked(row.counts)
    return total


def packed(table: np.ndarray) -> bytes:
    return (table.astype(np.uint32) if table.max() < 1 << 32 else table).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 << TABLE_BITS else np.int64).astype(np.int64)
