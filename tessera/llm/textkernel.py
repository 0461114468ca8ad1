"""Vectorised kernels on words, lines, windows and minimisers of a batch of texts.

A batch is held as one byte buffer; words are found, hashed and windowed with numpy, so
the cost of Python is per batch and not per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import tokens

#: The white space of the contract, and odd multipliers of the hash functions.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITE)] = True
_IS_NEWLINE = np.zeros(256, bool)
_IS_NEWLINE[0x0A] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX_A
    h ^= h >> np.uint64(29)
    h *= MIX_B
    h ^= h >> np.uint64(32)
    return h


class Units(NamedTuple):
    """Words (or lines) of some texts: byte ranges in ``raw``, hashes, and the first unit of each text."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def strings(self, which: np.ndarray) -> pa.Array:
        """The units as an Arrow array (each with its one separator)."""
        offsets = np.append(self.start, len(self.raw)).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw)])
        return every.take(pa.array(which))


def units_of(texts: list[bytes], kind: str = "word", lower: bool = False) -> Units:
    """Units of all texts; ``raw`` has exactly one separator after each unit.

    kind: ``word`` splits at white space, ``line`` at newlines (empty lines are no units).
    """
    sep_byte, table = (b" ", _IS_SPACE) if kind == "word" else (b"\n", _IS_NEWLINE)
    data = np.frombuffer(sep_byte.join([*texts, b""]) or b"", np.uint8)
    if lower:
        data = _LOWER[data]
    bound = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=bound[1:])
    sep = table[data]
    if len(data):
        keep = np.empty(len(data), bool)
        keep[0] = not sep[0]
        np.logical_not(sep[1:] & sep[:-1], out=keep[1:])
        if not keep.all():
            before = np.concatenate(([0], np.cumsum(keep)))
            bound = before[bound]
            data, sep = data[keep], sep[keep]
        if kind == "word" and sep.any():
            data = np.where(sep, np.uint8(0x20), data)
    end = np.flatnonzero(sep)
    start = np.concatenate((np.zeros(1, np.int64), end[:-1] + 1)) if len(end) else np.zeros(0, np.int64)
    first = np.searchsorted(start, bound)
    raw = data.tobytes()
    return Units(raw, start, end, first, _hashes(raw, start, end))


def _hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step."""
    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    eight = np.ndarray((len(padded) - 7,), np.uint64, padded.data, 0, (1,))
    length = end - start
    h = mix(length.astype(np.uint64) * STEP + (eight[start] & _MASKS[np.minimum(length, 8)]))
    at, todo = 8, np.flatnonzero(length > 8)
    while len(todo):
        part = eight[start[todo] + at] & _MASKS[np.minimum(length[todo] - at, 8)]
        h[todo] = mix(h[todo] * STEP + part)
        at += 8
        todo = todo[length[todo] > at]
    return h


def unit_ids(units: Units, which: np.ndarray | None = None) -> np.ndarray:
    """Numbers that are equal for equal units, by their bytes; -1 for units outside ``which``."""
    if which is None:
        which = np.arange(len(units.start))
    ids = np.full(len(units.start), -1, np.int32)
    ids[which] = units.strings(which).dictionary_encode().indices.to_numpy()
    return ids


def equal_windows(units: Units, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` units from ``a`` and from ``b`` on are the same, by their bytes."""
    used = np.zeros(len(units.start) + 1, np.int32)
    for side in (a, b):
        np.add.at(used, side, 1)
        np.add.at(used, side + width, -1)
    ids = unit_ids(units, np.flatnonzero(np.cumsum(used[:-1]) > 0))
    equal = np.ones(len(a), bool)
    for j in range(width):
        equal &= ids[a + j] == ids[b + j]
    return equal


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values (one shorter by width - 1)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, width):
        acc *= STEP
        acc += h[j : j + n]
    return mix(acc)


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; ``breaks`` marks elements that begin a new run."""
    start = np.flatnonzero(breaks)
    return start, np.diff(np.append(start, len(breaks)))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``limit`` bytes in ``column`` (one row at least); encoders of earlier tasks go."""
    tokens.release()
    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = np.array(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64) + 64
        while at < len(lengths):
            room = np.searchsorted(np.cumsum(lengths[at:]), limit - size, "right")
            take = max(int(room), 0 if held else 1)
            if take:
                held.append(batch.slice(at, take))
                size += int(lengths[at : at + take].sum())
                at += take
            if at < len(lengths) or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def as_bytes(column: pa.ChunkedArray) -> list[bytes]:
    """Values as bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
