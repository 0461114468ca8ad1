"""Quality classifier (3): an additive model with pairwise interactions.

Trees of two levels are boosted in turn over the features, and then over the pairs of
features that explain most of what is left. What a feature's trees say together is a lookup
table over its bins, so a score is a sum of table entries, added for all rows of a batch at
once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import textkernel as K

#: Labelled rows that a model is fitted on at most (those with the smallest hashes of their ids).
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
CHUNK_BYTES = 8 << 20
#: Bytes of texts whose features are found at a time: what is held beside them is some fifty times as large.
SLICE_BYTES = 1 << 20

#: Groups of bytes that are counted.
GROUPS = (b" \t\n\v\f\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()?", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~")

FEATURES = ("length", "upper", "digits", "plain_marks", "exclaims", "bars", "symbols", "other_bytes", "word_length", "long_words", "distinct_words", "repeated_neighbours", "words_a_line", "repeated_lines", "marked_words", "capital_words", "top_word")

_CLASS = np.full(256, len(GROUPS), np.uint8)
for _k, _g in enumerate(GROUPS):
    _CLASS[list(_g)] = _k


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text, and the count of each text's most frequent one."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start, count = K.runs(new)
    top = np.zeros(n)
    np.maximum.at(top, text[start], count)
    return np.bincount(text[start], minlength=n), top


def features(texts: list[bytes], limit: int = SLICE_BYTES) -> np.ndarray:
    """A row of numbers per text; the text is all they depend on, and at most ``limit`` bytes (or one text) are worked on at a time."""
    end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    out, at = np.zeros((len(texts), len(FEATURES))), 0
    while at < len(texts):
        room = limit + (end[at - 1] if at else 0)
        stop = max(int(np.searchsorted(end, room, "right")), at + 1)
        out[at:stop] = _features(texts[at:stop])
        at = stop
    return out


def _features(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    bytes_ = np.frombuffer(b"".join(texts), np.uint8)
    kinds = len(GROUPS) + 1
    count = np.bincount(np.repeat(np.arange(n), size) * kinds + _CLASS[bytes_], minlength=n * kinds).reshape(n, kinds)
    words, lines = K.units_of(texts), K.units_of(texts, "line")
    length = (words.end - words.start).astype(np.float64)
    n_words, n_lines = np.diff(words.first), np.diff(lines.first)
    raw = np.frombuffer(words.raw or b" ", np.uint8)
    head = _CLASS[raw[words.start]] if len(words.start) else np.zeros(0, np.uint8)
    tail = _CLASS[raw[words.end - 1]] if len(words.start) else np.zeros(0, np.uint8)
    again = np.zeros(len(words.hash))
    again[1:] = words.hash[1:] == words.hash[:-1]
    inner = words.first[:-1][n_words > 0]
    again[inner] = 0
    distinct, top = _distinct(words.hash, words.first)
    distinct_lines, _ = _distinct(lines.hash, lines.first)
    letters, w = np.maximum(size - count[:, 0], 1), np.maximum(n_words, 1)
    columns = [
        np.log1p(size),
        *(count[:, k] / letters for k in (1, 3, 4, 5, 6, 7, 8)),
        _per_text(length, words.first) / w,
        _per_text(length > 15, words.first) / w,
        distinct / w,
        _per_text(again, words.first) / w,
        n_words / np.maximum(n_lines, 1),
        1 - distinct_lines / np.maximum(n_lines, 1),
        _per_text(tail >= 5, words.first) / w,
        _per_text(head == 1, words.first) / w,
        top / w,
    ]
    return np.column_stack(columns)


class Model(NamedTuple):
    """Cut points and tables of each feature, coarse cut points and tables of pairs."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cut, x[:, k], "right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points: half at equal shares of the rows, half at equal steps of the value, which rare values need."""
    share = np.quantile(values, np.arange(1, bins) / bins, method="higher")
    step = np.linspace(values.min(), values.max(), bins + 1)[1:-1]
    return np.unique(np.concatenate((share, step)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Gain of cutting after each bin; sums along the first axis."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    part = lambda a, b: a * a / (b + ridge)
    return part(left_g, left_h) + part(g.sum() - left_g, h.sum() - left_h) - part(g.sum(), h.sum())


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Values per bin of a tree over one feature's bins."""
    if depth and len(g) > 1:
        gain = _gain(g, h, ridge)
        k = int(np.argmax(gain))
        if gain[k] > 1e-9:
            return np.concatenate((_tree(g[: k + 1], h[: k + 1], ridge, depth - 1), _tree(g[k + 1 :], h[k + 1 :], ridge, depth - 1)))
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values per cell of a tree that cuts one feature and then, on each side, the other; and its gain."""
    best = (np.zeros_like(g), 0.0)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        if a.shape[0] < 2:
            continue
        k = int(np.argmax(_gain(a.sum(1), b.sum(1), ridge)))
        out = np.empty_like(a)
        for rows in (slice(0, k + 1), slice(k + 1, None)):
            out[rows] = _tree(a[rows].sum(0), b[rows].sum(0), ridge, 1)
        gain = float((2 * out * a - out * out * (b + ridge / a.size)).sum())
        if gain > best[1]:
            best = (out.T if turn else out, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, bins: int = 32, n_pairs: int = 6, pair_rounds: int = 30, ridge: float = 2.0) -> Model:
    """Cyclic boosting; without rows, or with one label only, the model is a constant."""
    n, d = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    intercept = float(np.log(mean / (1 - mean)))
    cuts = [_quantiles(x[:, k], bins) if n else np.zeros(0) for k in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    coarse = [_quantiles(x[:, k], 8) if n else np.zeros(0) for k in range(d)]
    if not n or y.min() == y.max():
        return Model(intercept, cuts, tables, coarse, [], [])
    place = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    margin = np.full(n, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(d):
            g, h = slopes()
            size = len(tables[k])
            step = rate * _tree(np.bincount(place[k], g, size), np.bincount(place[k], h, size), ridge)
            tables[k] += step
            margin += step[place[k]]
    rough = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(rough[i] * b + rough[j], v, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(((-_grid_tree(cells(i, j, g), cells(i, j, h), ridge)[1], i, j) for i in range(d) for j in range(i)))
    pairs = [(i, j) for gain, i, j in ranked[:n_pairs] if gain < 0]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(pair_rounds):
        for (i, j), grid in zip(pairs, grids, strict=True):
            g, h = slopes()
            step = rate * _grid_tree(cells(i, j, g), cells(i, j, h), ridge)[0]
            grid += step
            margin += step[rough[i], rough[j]]
    return Model(intercept, cuts, tables, coarse, pairs, grids)


def held_out(id_col: str):
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in K.text_chunks(batches, "__text", CHUNK_BYTES):
        x = features(K.as_bytes(table["__text"]))
        flat = pa.array(x.ravel())
        yield pa.RecordBatch.from_arrays([table["__label"].combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("__label"))
    some = known.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text")).join(F.broadcast(some.select("__id").distinct()), "__id")
    # Of rows that repeat an id, the text with the smallest hash: one row per labelled row, so the bound is exact.
    one = found.groupBy("__id").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text"))).alias("__one"))
    rows = one.join(F.broadcast(some), "__id").select("__one.__text", "__label")
    got = rows.mapInArrow(_feature_rows, "label double, x array<double>").collect()
    got = sorted((r["label"], *r["x"]) for r in got)
    every = np.array(got, float).reshape(len(got), len(FEATURES) + 1)
    return fit(every[:, 1:], every[:, 0])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table in K.text_chunks(batches, "__text", CHUNK_BYTES):
            score = model.score(features(K.as_bytes(table["__text"])))
            out = table.drop_columns(["__text"]).append_column("__score", pa.array(score))
            yield from out.combine_chunks().to_batches()

    return run


def with_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows and columns of ``docs`` and a column ``__score``: 0 to 1, higher where label 1 is likelier.

    Defined cases: a null text counts as empty, and empty texts are scored like others; rows
    with a null id, and repeated rows, are scored; of rows with one id one is learnt, that whose
    text has the smallest hash; labels without a document, and null labels, are ignored; equal
    texts have equal scores; texts may be of any length; without labels the score is the same
    for all rows; an empty table gives an empty table; names that begin with two underscores are
    reserved.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of at most 63 bins
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    return docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(_score(shared), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more."""
    return with_score(docs, labels, **options).filter(F.col("__score") >= threshold).drop("__score")
