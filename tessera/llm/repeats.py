"""Which windows of consecutive units also start earlier: exact, by super-k-mers.

A window is ``width`` consecutive units (words or lines) of one text. Its minimiser is the
least hash among its ``width - span + 1`` runs of ``span`` units. Consecutive windows that
share a minimiser form a super-k-mer and travel as one packed string to the bucket of that
minimiser, where sorting brings equal windows together; equal hashes are compared unit by
unit, so counting is exact.

Four steps keep hot content from piling up, none of which changes the result:

* each chunk of a task first resolves its own windows, so of a window at most one copy per
  chunk travels, whatever share of the rows has it;
* minimisers that occur once in the whole input cannot hold a repeated window; a bitmap (a
  filter without false negatives, of ``sketch.MOST_BITS`` at most) keeps them at home;
* minimisers with a large share of all occurrences (at most ``1 / HOT_SHARE`` by counting)
  are dealt by the window's own hash instead;
* a bucket is read as a stream, and a key with more than ``CHUNK_BYTES`` is not held: its
  windows go on as 128-bit digests, whose first places are found by an aggregation that
  combines before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm import textkernel as K
from tessera.llm.storage import hot_split_join, materialise

#: Bytes of text that one chunk, and of packed windows that one bucket, holds.
CHUNK_BYTES = 8 << 20
HOT_SHARE = 1 / 2048
HOT_FLOOR = 1000

_TRAVEL = "key long, k1 long, k2 long, start long, n long, packed binary"


class _Windows:
    """The windows of a list of pieces, each with its key (k1, k2) and the place of its first unit."""

    def __init__(self, pieces: list[bytes], k1: np.ndarray, k2: np.ndarray, base: np.ndarray, kind: str, width: int):
        order = np.lexsort((base, k2, k1))
        self.k1, self.k2, self.base, self.width = k1[order], k2[order], base[order], width
        self.units = units = K.units_of([pieces[i] for i in order], kind)
        count = np.diff(units.first)
        piece = np.repeat(np.arange(len(pieces)), np.maximum(count - width + 1, 0))
        self.piece = piece
        ahead = np.concatenate(([0], np.cumsum(np.maximum(count - width + 1, 0))))
        self.at = units.first[piece] + np.arange(len(piece)) - ahead[piece] if len(piece) else np.zeros(0, np.int64)
        self.place = self.base[piece] + self.at - units.first[piece]
        new = np.ones(len(pieces), bool)
        new[1:] = (self.k1[1:] != self.k1[:-1]) | (self.k2[1:] != self.k2[:-1])
        self.rank = np.cumsum(new)

    def hashes(self) -> np.ndarray:
        return K.window_hash(self.units.hash, self.width)[self.at]

    def minimisers(self, span: int) -> np.ndarray:
        return K.window_min(K.window_hash(self.units.hash, span), self.width - span + 1)[self.at]

    def resolve(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, later): windows that are the first of their content here, and those that start after an equal one."""
        n = len(h)
        first, later = np.ones(n, bool), np.zeros(n, bool)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if not same.any():
            return first, later
        head = np.arange(n)
        head[1:][same] = 0
        np.maximum.accumulate(head, out=head)
        follow = np.flatnonzero(head != np.arange(n))
        a, b = order[head[follow]], order[follow]
        equal = K.equal_windows(self.units, self.at[a], self.at[b], self.width)
        if not equal.all():  # equal hashes of unequal windows: settle their groups by content
            ids = K.unit_ids(self.units)
            for g in np.unique(head[follow[~equal]]):
                seen: dict[bytes, int] = {}
                for w in order[head == g]:
                    one = seen.setdefault(ids[self.at[w] : self.at[w] + self.width].tobytes(), w)
                    if one != w:
                        k = np.flatnonzero(b == w)
                        a[k], equal[k] = one, True
        a, b = a[equal], b[equal]
        first[b] = False
        ra, rb = self.rank[self.piece[a]], self.rank[self.piece[b]]
        later[b] = (rb > ra) | ((rb == ra) & (self.place[b] > self.place[a]))
        return first, later

    def ranges(self, mask: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Runs of consecutive marked windows of one piece (and one key): index of the first, number."""
        which = np.flatnonzero(mask)
        if not len(which):
            return which, which
        new = np.ones(len(which), bool)
        new[1:] = (np.diff(which) != 1) | (self.piece[which[1:]] != self.piece[which[:-1]])
        if key is not None:
            new[1:] |= key[which[1:]] != key[which[:-1]]
        start, n = K.runs(new)
        return which[start], n


def _windows(table: pa.Table, kind: str, width: int) -> _Windows:
    k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
    return _Windows(K.as_bytes(table["text"]), k1, k2, np.zeros(len(k1), np.int64), kind, width)


def _minimiser_counts(kind: str, width: int, span: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.text_chunks(batches, "text", CHUNK_BYTES):
            w = _windows(table, kind, width)
            if not len(w.at):
                continue
            m = w.minimisers(span)
            at, _ = w.ranges(np.ones(len(m), bool), m)
            value, n = np.unique(K.mix(m[at]), return_counts=True)  # minima crowd at one end; mixed again they are spread
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return count


def _travellers(kind: str, width: int, span: int, bits: int, shared):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        for table in K.text_chunks(batches, "text", CHUNK_BYTES):
            w = _windows(table, kind, width)
            if not len(w.at):
                continue
            h, m = w.hashes(), w.minimisers(span)
            first, later = w.resolve(h)
            at, n = w.ranges(later)
            yield _rows(w, at, n, w.k1[w.piece[at]], None)
            spread = K.mix(m)
            go = first & sketch.has_bit(bitmap, (spread >> np.uint64(64 - bits)).astype(np.int64))
            key = np.where(np.isin(spread, hot), h, m) if len(hot) else m
            at, n = w.ranges(go, key)
            for lo in range(0, len(at), 50_000):
                a, k = at[lo : lo + 50_000], n[lo : lo + 50_000]
                begin, end = w.units.start[w.at[a]], w.units.end[w.at[a] + k + width - 2]
                raw = w.units.raw
                yield _rows(w, a, k, key[a].view(np.int64), [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)])

    return send


def _rows(w: _Windows, at: np.ndarray, n: np.ndarray, key: np.ndarray, packed: list[bytes] | None) -> pa.RecordBatch:
    p = w.piece[at]
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(w.k1[p]), pa.array(w.k2[p]), pa.array(w.place[at]), pa.array(n.astype(np.int64)), pa.nulls(len(at), pa.binary()) if packed is None else pa.array(packed, pa.binary())],
        ["key", "k1", "k2", "start", "n", "packed"],
    )


def _bucket(kind: str, width: int):
    """Rows of a partition, sorted by key -> ranges of windows that start after an equal one; windows of a key that is too large, with their digests."""
    names = ["k1", "k2", "start", "n", "digest"]

    def windows(rows: pa.Table) -> _Windows:
        return _Windows(K.as_bytes(rows["packed"]), rows["k1"].to_numpy(), rows["k2"].to_numpy(), rows["start"].to_numpy(), kind, width)

    def ranges(w: _Windows, at: np.ndarray, n: np.ndarray, digest: list[bytes] | None) -> pa.RecordBatch:
        p = w.piece[at]
        return pa.RecordBatch.from_arrays([pa.array(w.k1[p]), pa.array(w.k2[p]), pa.array(w.place[at]), pa.array(n.astype(np.int64)), pa.nulls(len(at), pa.binary()) if digest is None else pa.array(digest, pa.binary())], names)

    def settle(rows: pa.Table) -> pa.RecordBatch:
        w = windows(rows)
        return ranges(w, *w.ranges(w.resolve(w.hashes())[1]), None)

    def pass_on(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 10_000):
            w = windows(rows.slice(lo, 10_000))
            begin, end = w.units.start[w.at].tolist(), w.units.end[w.at + width - 1].tolist()
            digest = [hashlib.blake2b(w.units.raw[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)]
            yield ranges(w, np.arange(len(w.at)), np.ones(len(w.at), np.int64), digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, large = [], 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            told = table.filter(pc.is_null(table["packed"]))
            if len(told):
                yield from told.select(names[:4]).append_column("digest", pa.nulls(len(told), pa.binary())).combine_chunks().to_batches()
            table = table.filter(pc.is_valid(table["packed"]))
            if large is not None and len(table):
                same = int(np.searchsorted(table["key"].to_numpy(), large, "right"))
                yield from pass_on(table.slice(0, same))
                table = table.slice(same)
                large = None if len(table) else large
            if not len(table):
                continue
            held.append(table)
            size += table.nbytes
            if size > CHUNK_BYTES:  # all but the last key are complete
                whole = pa.concat_tables(held).combine_chunks()
                key = whole["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield settle(whole.slice(0, cut))
                held = [whole.slice(cut)]
                size = held[0].nbytes
                if size > CHUNK_BYTES:
                    yield from pass_on(held[0])
                    held, size, large = [], 0, key[-1]
        if held:
            yield settle(pa.concat_tables(held))

    return run


def repeated_windows(docs: DataFrame, kind: str, width: int, span: int) -> DataFrame:
    """(k1, k2, start, n): ranges of windows of ``with_keys(docs)`` that also start earlier.

    docs: k1, k2, text. Earlier means a smaller (k1, k2), or the same one and an earlier
    start; rows with equal k1 and k2 are one document. Texts with fewer than ``width`` units
    have no window. Ranges of one document may overlap.
    """
    spark = docs.sparkSession
    counts = docs.mapInArrow(_minimiser_counts(kind, width, span), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = materialise(counts, "minimisers")
    number, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(HOT_FLOOR, int(total * HOT_SHARE))
    hot = np.array(sorted(r[0] for r in counts.filter(F.col("n") > limit).select("key").collect()), np.int64).view(np.uint64)
    bits = sketch.bits_for(number)
    bitmap = sketch.dense_table(counts.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"), F.lit(1).alias("value")), bits, pack=True)
    shared = spark.sparkContext.broadcast((bitmap, hot))
    sent = docs.mapInArrow(_travellers(kind, width, span, bits, shared), _TRAVEL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_bucket(kind, width), "k1 long, k2 long, start long, n long, digest binary")
    found = materialise(found, "found")
    return found.filter("digest is null").drop("digest").unionByName(_later(found.filter("digest is not null")))


def _later(windows: DataFrame) -> DataFrame:
    """Windows with a digest that start after the first one with that digest."""
    first = windows.groupBy("digest").agg(F.min(F.struct("k1", "k2", "start")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pairs = hot_split_join(windows, first, ["digest"], "size", windows.count())
    return pairs.filter(F.struct("k1", "k2", "start") > F.col("first")).select("k1", "k2", "start", "n")
