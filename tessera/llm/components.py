"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialise


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition -> a star per component of them, so chains shrink before any shuffle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = parent[min(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    for lo in range(0, len(pairs), 50_000):
        u, v = np.array(pairs[lo : lo + 50_000], np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _signature(df: DataFrame):
    return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp) for every vertex that a link touches: comp is the smallest vertex it reaches.

    Each round contracts the links of a partition to stars, then ties each vertex's larger
    neighbours to its smallest one, then its smaller ones; rounds end when nothing changes.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    edges = materialise(edges.distinct().mapInArrow(_contract, "u long, v long"), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialise(small.mapInArrow(_contract, "u long, v long").distinct(), "stars")
        now = _signature(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("v"), F.col("v").alias("comp")).union(edges.select("v", F.col("v").alias("comp")).distinct())
