"""Line dedup (1): winnowing over line hashes.

Of every window of ``width`` consecutive lines the line with the least hash (the first of
equals) is selected. Which one that is depends on the window's lines only, so two copies of
a run of ``width`` lines or more have a selected line, a fingerprint, at the same place:
that is winnowing's guarantee.

A fingerprint travels with its place and the digests of the ``width - 1`` lines on either
side. Positions are joined on the seed, the window that selected the fingerprint: each one
meets the earliest position with that seed, so a run that a third of all rows share costs one
row each and no pairs. A match is extended line by line both ways as far as the digests that
travelled agree; longer runs are the union of the matches of their fingerprints, which are at
most ``width`` lines apart. Runs that also start earlier are deleted.

Fingerprints whose hash occurs once in the whole input match nothing and stay at home; the
filter for them has no false negatives. Lines are compared by 128-bit blake2b digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm import textkernel as K
from tessera.llm.cutting import with_keys, without_ranges
from tessera.llm.storage import hot_split_join, materialise

#: Lines of the shortest run that is found.
WIDTH = 3
CHUNK_BYTES = 8 << 20
#: Bytes of a line's digest.
DIGEST = 16


def selected(units: K.Units, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, fingerprint): the first line of each window that lies in one text, and the line that it selects."""
    count = np.diff(units.first)
    windows = np.maximum(count - width + 1, 0)
    ahead = np.concatenate(([0], np.cumsum(windows)))
    text = np.repeat(np.arange(len(count)), windows)
    at = units.first[text] + np.arange(len(text)) - ahead[text]
    least, pick = units.hash[at], at.copy()
    for j in range(1, width):
        value = units.hash[at + j]
        better = value < least
        least, pick = np.where(better, value, least), np.where(better, at + j, pick)
    return at, pick


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.text_chunks(batches, "text", CHUNK_BYTES):
            units = K.units_of(K.as_bytes(table["text"]), "line")
            _, pick = selected(units, width)
            value, n = np.unique(K.mix(units.hash[np.unique(pick)]), return_counts=True)  # minima crowd at one end; mixed again they are spread
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["fingerprint", "n"])

    return run


def _digests(units: K.Units, which: np.ndarray) -> np.ndarray:
    """Row i: the digest of line i, for lines in ``which``."""
    lines = units.strings(which).dictionary_encode()
    each = b"".join([hashlib.blake2b(x, digest_size=DIGEST).digest() for x in lines.dictionary.to_pylist()])
    out = np.zeros((len(units.start), DIGEST), np.uint8)
    out[which] = np.frombuffer(each, np.uint8).reshape(-1, DIGEST)[lines.indices.to_numpy()]
    return out


def _binary(cells: np.ndarray) -> pa.Array:
    n, size = cells.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(cells))])


def _positions(width: int, bits: int, shared):
    """Texts -> one row per window whose fingerprint is marked: seed, document, place of the fingerprint, lines around it."""
    names = ["seed", "k1", "k2", "place", "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, reach = shared.value, np.arange(1 - width, width)
        for table in K.text_chunks(batches, "text", CHUNK_BYTES):
            units = K.units_of(K.as_bytes(table["text"]), "line")
            at, pick = selected(units, width)
            go = sketch.has_bit(bitmap, (K.mix(units.hash[pick]) >> np.uint64(64 - bits)).astype(np.int64))
            at, pick = at[go], pick[go]
            if not len(at):
                continue
            doc = np.searchsorted(units.first, pick, "right") - 1
            k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
            for lo in range(0, len(at), 50_000):
                a, p, d = at[lo : lo + 50_000], pick[lo : lo + 50_000], doc[lo : lo + 50_000]
                lines = p[:, None] + reach
                inside = (lines >= units.first[d][:, None]) & (lines < units.first[d + 1][:, None])
                lines = np.where(inside, lines, p[:, None])
                digest = _digests(units, np.unique(lines))
                around = np.where(inside[:, :, None], digest[lines], np.uint8(0)).reshape(len(p), -1)
                window = digest[a[:, None] + np.arange(width)].reshape(len(p), -1).tobytes()
                size = width * DIGEST
                seed = [hashlib.blake2b(window[i : i + size], digest_size=DIGEST).digest() for i in range(0, len(window), size)]
                yield pa.RecordBatch.from_arrays([pa.array(seed, pa.binary()), pa.array(k1[d]), pa.array(k2[d]), pa.array(p - units.first[d]), _binary(around)], names)

    return run


def _agree(mine: str, other: str, width: int, step: int) -> Column:
    """How many lines next to the fingerprint agree, one after the other, in one direction."""
    line = lambda c, j: F.substring(F.col(c), (width - 1 + step * j) * DIGEST + 1, DIGEST)
    edge, going, total = F.lit(bytes(DIGEST)), F.lit(True), F.lit(0)
    for j in range(1, width):
        going = going & (line(mine, j) == line(other, j)) & (line(mine, j) != edge)
        total = total + going.cast("int")
    return total


def repeated_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k1, k2, start, n): runs of lines of ``with_keys(docs)`` that also start earlier. Runs of one document may overlap."""
    spark = docs.sparkSession
    seen = docs.select("text").mapInArrow(_fingerprints(width), "fingerprint long, n long").groupBy("fingerprint").agg(F.sum("n").alias("n"))
    again = materialise(seen.filter("n > 1").select("fingerprint"), "fingerprints")
    bits = sketch.bits_for(again.count())
    marked = again.select(F.shiftrightunsigned("fingerprint", 64 - bits).alias("slot"), F.lit(1).alias("value"))
    shared = spark.sparkContext.broadcast(sketch.dense_table(marked, bits, pack=True))
    rows = materialise(docs.mapInArrow(_positions(width, bits, shared), "seed binary, k1 long, k2 long, place long, around binary"), "positions")
    first = rows.groupBy("seed").agg(F.min(F.struct("k1", "k2", "place", "around")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pairs = hot_split_join(rows, first, ["seed"], "size", rows.count()).filter("first is not null")
    pairs = pairs.filter(F.struct("k1", "k2", "place") > F.struct("first.k1", "first.k2", "first.place")).withColumn("other", F.col("first.around"))
    before, after = _agree("around", "other", width, -1), _agree("around", "other", width, 1)
    return pairs.select("k1", "k2", (F.col("place") - before).alias("start"), (before + after + 1).cast("long").alias("n"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """All rows and columns of ``docs`` plus n_lines, n_removed, kept_text and kept_sha256.

    Lines are what newlines separate; empty lines take no part. Lines of runs of ``width`` lines
    or more that also start earlier go. A text that loses no line is kept as it is, else its
    remaining lines are joined by newlines. Defined cases: a null text counts as empty; a null
    id comes before all ids; rows with equal id and text count as one document and keep the
    same; rows with equal id and other texts are ordered by a hash of the text; texts with
    fewer than ``width`` lines lose nothing; texts and lines may be of any length; an empty
    table gives an empty table. Columns of ``docs`` keep their values; names that begin with two
    underscores, and the names of the added columns, are reserved.
    """
    out = without_ranges(docs, repeated_runs(with_keys(docs, id_col, text_col), width), id_col, text_col, "line")
    kept = F.when(F.col("__cut"), F.col("__kept")).otherwise(F.coalesce(F.col(text_col), F.lit("")))
    return out.select(*docs.columns, F.col("__n_units").alias("n_lines"), F.col("__n_removed").alias("n_removed"), kept.alias("kept_text"), F.col("__sha").alias("kept_sha256"))
