"""Tables of fixed size over hashed slots, gathered slice by slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkernel import runs


#: A bitmap has so many bits at most (64 MB); beyond that more rows pass a filter than need to.
MOST_BITS = 29


def bits_for(count: int) -> int:
    """Bits of the slots of a bitmap for ``count`` keys: 16 slots a key, within fixed bounds."""
    return min(max((16 * count).bit_length(), 16), MOST_BITS)


def _slices(slice_bits: int, pack: bool):
    def row(part: int, cells: np.ndarray) -> pa.RecordBatch:
        cells = np.packbits(cells.astype(bool)) if pack else cells
        return pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int64()), pa.array([cells.tobytes()], pa.binary())], ["slice", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = None, None
        for batch in batches:
            part, slot, value = (batch[c].to_numpy() for c in ("slice", "slot", "value"))
            if not len(part):
                continue
            start, n = runs(np.concatenate(([True], part[1:] != part[:-1])))
            for s, k in zip(start, n, strict=True):
                if part[s] != held:
                    if cells is not None:
                        yield row(held, cells)
                    held, cells = part[s], np.zeros(1 << slice_bits, np.uint8)
                np.maximum.at(cells, slot[s : s + k], value[s : s + k].astype(np.uint8))
        if cells is not None:
            yield row(held, cells)

    return run


def dense_table(rows: DataFrame, bits: int, pack: bool) -> np.ndarray:
    """An array of 2 ** bits cells on the driver: the largest ``value`` (at most 255) of each ``slot``, or one bit.

    The size is fixed by ``bits``, whatever the input.
    """
    slice_bits = min(bits, 17)
    spark = rows.sparkSession
    dealt = rows.select(
        F.shiftright(F.col("slot"), slice_bits).cast("long").alias("slice"),
        F.col("slot").bitwiseAND((1 << slice_bits) - 1).cast("long").alias("slot"),
        F.col("value").cast("long").alias("value"),
    ).repartition(max(4, spark.sparkContext.defaultParallelism), "slice")
    cells = np.zeros((1 << bits) // (8 if pack else 1), np.uint8)
    step = (1 << slice_bits) // (8 if pack else 1)
    for part, raw in dealt.sortWithinPartitions("slice").mapInArrow(_slices(slice_bits, pack), "slice long, cells binary").collect():
        cells[part * step : (part + 1) * step] = np.frombuffer(raw, np.uint8)
    return cells


def has_bit(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
