"""Packing (8): deficit round-robin over source queues, cut into sequences of equal length.

Each source is a queue of documents with a target share. A window of ``window_tokens`` credits
each queue that has work with its share; a queue sends documents from its head while its
credit covers them and carries the rest, its deficit, into the next window. What an empty
queue no longer takes goes to the others in proportion to their shares, so every window but
the last is full.

That has a closed form. Queue s with share w and Q tokens has sent min(Q, w v) tokens at the
virtual time v, the same for all queues; all queues together have then sent T(v), the sum
over them. A document is complete when its queue has sent ``served`` tokens, at v = served / w,
so its window is the first whose end is not before T(v). That is the round-robin itself, and
needs no order of execution: deficits pass between partitions in the prefix sums. The stream
of windows is then cut every ``length`` tokens, so only the last sequence has padding.

Prefix sums take two levels (groups of bounded size, then group totals), so no task holds a
queue, however much of the rows one source has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import materialise
from tessera.llm.tokens import END_ID, encoder

LENGTH = 1024
#: Tokens of a mixture window.
WINDOW_TOKENS = 1 << 18
#: Documents of a queue segment, and windows of a block, on average and at most.
SEGMENT_DOCS = 20_000
BLOCK_WINDOWS = 4096


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            ids = [encode(t or "") + end for t in batch["text"].to_pylist()]
            sizes = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k2"], batch["source"], sizes, pa.array(ids, pa.binary())], ["doc_id", "k2", "source", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """row (a number of its own), doc_id, k2 (a hash of the text), source, n_tokens, ids (little-endian uint16, end id included)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k2"), source.alias("source"), text.alias("text"))
    rows = rows.mapInArrow(_encode(vocabulary), "doc_id long, k2 long, source string, n_tokens long, ids binary")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")


def _sent(weights: dict[str, float], sums: DataFrame, total: int) -> tuple[Column, Column]:
    """Share of a row's queue, and the tokens that all queues have sent when the row's queue has sent ``served``.

    Terms: one per source of ``weights`` and one for all others together, whose shares are
    their tokens' and so run dry at the same time.
    """
    for name, weight in weights.items():
        if not 0 <= weight < float("inf"):
            raise ValueError(f"the weight of {name!r} is {weight}")
    sizes = dict(sums.filter(F.col("source").isin(list(weights))).groupBy("source").agg(F.sum("size")).collect()) if weights else {}
    all_ = float(max(total, 1))
    queues = [(weights[s], float(n)) for s, n in sizes.items()]
    rest = total - sum(sizes.values())
    queues.append((rest / all_, float(rest)))
    share = F.col("queue") / F.lit(all_)
    for name in sizes:
        share = F.when(F.col("source") == name, F.lit(float(weights[name]))).otherwise(share)
    time = F.col("served") / share
    sent = F.lit(0.0)
    for w, q in queues:
        if w > 0:
            sent = sent + F.least(F.lit(q), F.lit(w) * time)
    last = sum(q for w, q in queues if w == 0)  # queues of share 0 are served when no other has work, by size
    idle = F.lit(all_ - last) + F.col("served") / F.col("queue") * F.lit(last)
    return share, F.when(share > 0, sent).otherwise(idle) if last else sent


def plan(tokens: DataFrame, weights: dict[str, float] | None = None, window_tokens: int = WINDOW_TOKENS, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """(row, window, at): the mixture window and the place in the whole stream of each row of ``encode_documents``.

    weights: target shares of sources, in any unit; sources without one have their share of
    the tokens, and all by default, so that all queues run dry together. Sources that have no
    row are ignored; sources of weight 0 come when the others are empty; a weight below 0 or
    not finite is a ValueError.
    """
    totals = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("docs")).first()
    total, docs = totals["n"], totals["docs"]
    segments = max(1, docs // segment_docs + 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("k2"), F.col("row")]
    rows = tokens.select("row", "doc_id", "k2", "source", F.col("n_tokens").alias("n"), F.pmod(F.xxhash64("row"), F.lit(segments)).alias("segment"))
    inside = Window.partitionBy("source", "segment").orderBy(*order)
    sums = materialise(rows.groupBy("source", "segment").agg(F.sum("n").alias("size")), "sums")
    share, sent = _sent(weights or {}, sums, total)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("queue", F.sum("size").over(Window.partitionBy("source")))
    rows = rows.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(sums.select("source", "segment", "before", "queue"), ["source", "segment"])
    rows = rows.withColumn("served", F.col("before") + F.col("upto")).withColumn("share", share)
    rows = rows.withColumn("window", F.greatest(F.lit(0), F.ceil(sent / F.lit(float(window_tokens)) - 1e-9) - 1).cast("long"))
    rows = materialise(rows.select("row", "source", "n", "served", "window"), "windows")
    block = F.floor(F.col("window") / BLOCK_WINDOWS)
    sizes = rows.groupBy("window").agg(F.sum("n").alias("size")).withColumn("block", block)
    blocks = sizes.groupBy("block").agg(F.sum("size").alias("size"))
    blocks = blocks.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sizes.withColumn("near", near).join(blocks, "block").select("window", (F.col("near") + F.col("far")).alias("begin"))
    within = Window.partitionBy("window").orderBy("source", "served", "row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(begin, "window").select("row", "window", (F.col("begin") + F.col("ahead")).alias("at"))


def _cut(length: int, carry_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", *(["ids"] if carry_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, at, window, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "at", "window", "n_tokens", "ids")), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    k = min(length - offset, n - start)
                    part = wide[start : start + k].tobytes()
                    rows.append((doc, start, k, zlib.crc32(part), n, seq, offset, window, *([part] if carry_ids else [])))
                    start += k
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, window_tokens: int = WINDOW_TOKENS, weights: dict[str, float] | None = None, vocabulary: str = "byte_bpe_50k", with_ids: bool = False, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (and ids).

    A piece is a stretch of one document in one sequence. Defined cases: a null text counts
    as empty and has its end id; a null source is the source '' ; null ids are packed like
    others; repeated rows are packed once each; texts may be of any length; an empty table gives
    an empty table; other columns are not read. Weights are those of ``plan``. The vocabulary
    has at most 65,536 ids.
    """
    tokens = encode_documents(docs, id_col, text_col, source_col, vocabulary)
    where = plan(tokens, weights, window_tokens, segment_docs)
    # One plan at every size: a small ``where`` would be broadcast.
    rows = tokens.select("row", "doc_id", "n_tokens", "ids").join(where.hint("merge"), "row").select("doc_id", "n_tokens", "ids", "window", "at")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(_cut(length, with_ids), schema)
