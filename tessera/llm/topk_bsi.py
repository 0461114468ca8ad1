"""Exact top-k search (4): a bit-sliced index over blocks of rows.

A block holds the high bits of each attribute as slices: one bit per row, 64 rows a word. For
a query the slices are added with bitmap arithmetic: each set bit of a weight contributes a
shifted copy of the attribute's slices (of their complements where the weight is negative),
and full adders reduce each bit position until one slice is left. The k best rows are then
selected from the most significant slice of the sum downward. The bits that the slices leave
out bound the error of a sum; rows near the boundary are resolved with exact products.

Vectors with a component beyond ``NARROW`` have no slices: they and what is compared with
them are scored with whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 256
#: Slices per attribute, rows of an index block, queries of a query block.
SLICES = 7
BLOCK_ROWS = 1 << 13
QUERY_ROWS = 1 << 12

#: Components of sliced vectors, and their number, are at most this large, so 64 bits hold every sum.
NARROW = 1 << 23
NARROW_DIMS = 1 << 15


class Block:
    """The index of some rows. x: integers, rows by attributes; ids: the rows' numbers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, slices: int = SLICES):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        n, self.dims = x.shape
        self.words = -(-n // 64)
        self.low = self.x.min(0) if n else np.zeros(self.dims, np.int64)
        high = (self.x.max(0) if n else self.low) - self.low
        self.shift = np.array([max(0, int(h).bit_length() - slices) for h in high], np.int64)
        self.bits = np.array([int(h).bit_length() - s for h, s in zip(high, self.shift, strict=True)], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.bits)))
        coarse = (self.x - self.low) >> self.shift
        flags = np.zeros((int(self.first[-1]), self.words * 64), bool)
        for d in range(self.dims):
            for b in range(self.bits[d]):
                flags[self.first[d] + b, :n] = (coarse[:, d] >> b) & 1
        packed = np.packbits(flags, axis=1, bitorder="little").view(np.uint64).reshape(len(flags), self.words)
        # Row 2 i is slice i and row 2 i + 1 its complement.
        self.slices = np.empty((2 * len(packed), self.words), np.uint64)
        self.slices[0::2], self.slices[1::2] = packed, ~packed
        live = np.zeros(self.words * 64, bool)
        live[:n] = True
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def partial(self, q: np.ndarray) -> tuple[dict[int, list[int]], int]:
        """For each bit position the slices to add; and the error of the sum, which is too low by at most that."""
        at: dict[int, list[int]] = {}
        error = 0
        for d in np.flatnonzero(q):
            weight, negative = abs(int(q[d])), int(q[d] < 0)
            shift, first = int(self.shift[d]), int(self.first[d])
            error += weight * ((1 << shift) - 1)
            for i in range(weight.bit_length()):
                if weight >> i & 1:
                    for b in range(int(self.bits[d])):
                        at.setdefault(i + b + shift, []).append(2 * (first + b) + negative)
        return at, error

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """Slices of the sum from position ``low`` up, that position, and the error."""
        at, error = self.partial(q)
        if not at:
            return [], 0, error
        low, out, carried, k = min(at), [], [], min(at)
        while k <= max(at) or carried:
            parts = [self.slices[at[k]]] if k in at else []
            stack = np.concatenate(parts + carried) if parts or carried else np.zeros((1, self.words), np.uint64)
            carried = []
            while len(stack) > 2:
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                ab = a ^ b
                carried.append((a & b) | (ab & c))
                stack = np.concatenate((ab ^ c, stack[3 * m :]))
            if len(stack) == 2:
                carried.append((stack[:1] & stack[1:]))
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0])
            k += 1
        return out, low, error

    def candidates(self, slices: list[np.ndarray], low: int, error: int, k: int, live: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best."""
        if int(np.bitwise_count(live).sum()) <= k:
            return self._rows(live)
        sure, tied, edge = np.zeros_like(live), live, 0
        for i in range(len(slices) - 1, -1, -1):
            more = sure | (tied & slices[i])
            n = int(np.bitwise_count(more).sum())
            if n >= k:
                tied, edge = tied & slices[i], edge | 1 << i
            else:
                sure, tied = more, tied & ~slices[i]
        # ``edge`` is the k-th largest coarse sum; rows below it by no more than the error may still be better.
        least = edge - (error >> low) - 1
        if least <= 0:
            return self._rows(live)
        above, equal = np.zeros_like(live), live
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        return self._rows(above | equal)

    def _rows(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, best first, ties to smaller ids."""
        live = self.live
        lo, hi = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right")
        if hi > lo:
            live = live.copy()
            for r in range(lo, hi):
                live[r >> 6] &= ~np.uint64(1 << (r & 63))
        slices, low, error = self.sums(q)
        rows = self.candidates(slices, low, error, k, live)
        score = self.x[rows] @ q
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


class Index:
    """Some rows as ``quantised`` gives them: a block of the narrow vectors, and the wide ones as lists."""

    def __init__(self, ids: np.ndarray, x: list[bytes], dims: int):
        plain = np.array([v[:1] == b"\0" for v in x], bool)
        cells = np.frombuffer(b"".join([v[1:] for v, p in zip(x, plain, strict=True) if p]), np.int64).reshape(int(plain.sum()), dims)
        narrow = (np.abs(cells) <= NARROW).all(1) & (dims <= NARROW_DIMS)
        sliced = plain.copy()
        sliced[plain] = narrow
        self.ids, self.x, self.sliced = ids, x, sliced
        self.block = Block(ids[sliced], cells[narrow])

    def top(self, query_id: int, x: bytes, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the query's own: highest score first, ties to smaller ids."""
        q, found = numbers(x), []
        exactly = np.arange(len(self.ids))
        if len(q) <= NARROW_DIMS and all(-NARROW <= c <= NARROW for c in q):
            ids, score = self.block.top(query_id, np.array(q, np.int64), k)
            found = list(zip(score.tolist(), ids.tolist(), strict=True))
            exactly = np.flatnonzero(~self.sliced)
        found += [(exact(q, numbers(self.x[i])), int(self.ids[i])) for i in exactly if self.ids[i] != query_id]
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def numbers(x: bytes) -> list[int]:
    return np.frombuffer(x, np.int64, offset=1).tolist() if x[:1] == b"\0" else [int(c) for c in x[1:].split()]


def exact(a: list[int], b: list[int]) -> int:
    """The inner product; beyond 64 bits the nearest number that they hold."""
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, x): whole numbers floor(scale * component) as bytes, of the vectors that are complete and finite.

    x holds 64-bit numbers; where one does not fit, x is the numbers as text after a byte of 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, x = [], []
            for v in batch["v"].to_pylist():
                with np.errstate(over="ignore"):
                    y = np.floor(scale * np.array(v, np.float64))
                dims.append(len(v))
                if (np.abs(y) < 2.0**62).all():
                    x.append(b"\0" + y.astype(np.int64).tobytes())
                else:  # the floor of a float product, as for others; an infinite product is taken exactly
                    x.append(b"\1" + " ".join(str(int(f)) if np.isfinite(f) else str(scale * int(c)) for f, c in zip(y.tolist(), v, strict=True)).encode())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(dims, pa.int64()), pa.array(x, pa.binary())], ["vec_id", "dims", "x"])

    v = F.col(vector_col)
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, dims long, x binary")


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(index) and len(asked):
            rows = Index(index["vec_id"].to_numpy(), index["x"].to_pylist(), key[2].as_py())
            for q, x in zip(asked["vec_id"].to_pylist(), asked["x"].to_pylist(), strict=True):
                found += [(q, i, s) for s, i in rows.top(q, x, k)]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest inner products with other rows.

    Blocks of the index meet blocks of queries on a grid; a cell is bounded by the two block
    sizes and yields k rows per query. Defined cases: vectors that are null, or hold a null
    or a component that is not finite, and rows without an id take no part; an empty vector
    has score 0; only vectors of one length meet; a query has no match in rows with its id;
    equal scores rank by id; repeated rows of ``vectors`` count once each, of ``queries``
    once; different vectors of one query id are one query, whose matches rank together; with
    fewer than k rows all are returned; an empty table gives an empty table; other columns are
    not read. Components may be of any size: scores are exact, and those beyond 64 bits are the
    nearest number that they hold.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale).dropDuplicates(["vec_id", "dims", "x"])
    n_rows, n_asked = vectors.count(), queries.count()
    blocks, sets = max(1, -(-n_rows // block_rows)), max(1, -(-n_asked // query_rows))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("block", deal(blocks, "vec_id", "x")).withColumn("part", every(sets))
    right = asked.withColumn("part", deal(sets, "vec_id", "x")).withColumn("block", every(blocks))
    keys = ["block", "part", "dims"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
