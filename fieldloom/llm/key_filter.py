"""A filter of fixed size for 64-bit keys, to pass by rows that can't join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24


def member_masks(keys: DataFrame):
    """A broadcast filter of the only (long) column of ``keys``."""
    name = keys.columns[0]
    cells = keys.selectExpr(f"`{name}` & {(1 << FILTER_BITS) - 1} AS cell").selectExpr("cell >> 5 AS word", "cell & 31 AS bit")
    words = cells.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, CAST(bit AS INT)))").alias("mask")).toArrow()
    masks = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint64)
    masks[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(masks.astype(np.uint32))


def may_contain(masks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for every key that is there, and for others with the share of the
    filter's bits that are set: the join that follows decides."""
    cell = keys.astype(np.int64) & ((1 << FILTER_BITS) - 1)
    return (masks[cell >> 5] >> (cell & 31).astype(np.uint32) & 1).astype(bool)


def passing(frame: DataFrame, masks, column: str) -> DataFrame:
    """The rows of ``frame`` whose ``column`` the filter lets through."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_contain(masks.value, batch[column].to_numpy(zero_copy_only=False))))

    return frame.mapInArrow(keep, frame.schema)
