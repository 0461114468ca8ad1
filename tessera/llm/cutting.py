"""The order of documents, and texts without ranges of their words or lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tessera.llm.textkernel import as_bytes


def order_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """``k1``, ``k2``: the order of documents. A null id comes first; equal ids are told apart by a hash of their text."""
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    first = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    # The sign of k2 tells a null id from the smallest long.
    second = F.when(F.col(id_col).isNull(), content.bitwiseOR(F.lit(-(2**63)).cast("long"))).otherwise(F.shiftrightunsigned(content, 1))
    return first, second


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    first, second = order_keys(id_col, text_col)
    return docs.select(first.alias("k1"), second.alias("k2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _marks(ranges: list[dict] | None, count: int) -> np.ndarray | None:
    """Marks of the units in the ranges; None if there are none."""
    if not ranges:
        return None
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, [r["start"] for r in ranges], 1)
    np.add.at(edge, [r["start"] + r["n"] for r in ranges], -1)
    return np.cumsum(edge[:-1]) > 0


def _keep(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept, cut = [], [], [], []
            for text, ranges in zip(as_bytes(pa.chunked_array([batch["__text"]])), batch["__ranges"].to_pylist(), strict=True):
                units = text.split() if kind == "word" else [x for x in text.split(b"\n") if x]
                marks = _marks(ranges, len(units))
                left = units if marks is None else [u for u, m in zip(units, marks.tolist(), strict=True) if not m]
                counts.append(len(units))
                removed.append(len(units) - len(left))
                kept.append((b" " if kind == "word" else b"\n").join(left))
                cut.append(marks is not None)
            names = [c for c in batch.schema.names if c not in ("__text", "__ranges")]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(cut)],
                [*names, "__n_units", "__n_removed", "__kept", "__sha", "__cut"],
            )

    return run


def without_ranges(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """All rows and columns of ``docs`` plus what is left of their texts.

    ranges: k1, k2, start and n (units) in any number and order; they may overlap. Added:
    ``__n_units`` and ``__n_removed`` (units of the text, and of those the removed ones),
    ``__kept`` (what is left, joined by one space or newline), ``__sha`` (its sha256) and
    ``__cut`` (whether the text has a range).
    """
    grouped = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("__ranges")).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    first, second = order_keys(id_col, text_col)
    keyed = docs.withColumns({"__k1": first, "__k2": second, "__text": F.coalesce(F.col(text_col), F.lit(""))})
    joined = keyed.join(grouped, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    fields = [f for f in joined.schema.fields if f.name not in ("__text", "__ranges")]
    added = [StructField("__n_units", LongType()), StructField("__n_removed", LongType()), StructField("__kept", StringType()), StructField("__sha", StringType()), StructField("__cut", BooleanType())]
    return joined.mapInArrow(_keep(kind), StructType([*fields, *added]))
