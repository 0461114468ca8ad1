"""Token output (9): Arrow stream files with fixed-size-list batches of ids and masks.

Documents are encoded in ascending id order and their ids, each document ended by id 0, form
one stream per file, cut into rows of ``row_tokens``: a column ``tokens``
(fixed_size_list<uint16 or uint32>) and a column ``mask`` (fixed_size_list<bool>, false in
the padding of the last row). Rows have equal byte length and batches equal row count, so
any row is found by arithmetic and read without copying from a memory map. The metadata of the
schema has the width of a row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import fresh_path, materialise
from tessera.llm.tokens import END_ID, encoder

ROW_TOKENS = 2048
BATCH_ROWS = 64
#: Documents per file at most, on average; a file is the work of one task.
FILE_DOCS = 20_000
#: Rows of a batch of the index.
INDEX_ROWS = 10_000


def _schema(row_tokens: int) -> pa.Schema:
    return pa.schema(
        [pa.field("tokens", pa.list_(pa.field("item", pa.uint16(), nullable=False), row_tokens), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), row_tokens), False)],
        {"row_tokens": str(row_tokens)},
    )


class RowWriter:
    """Cuts a stream of ids into rows and writes them batch by batch."""

    def __init__(self, target, row_tokens: int, batch_rows: int):
        self.schema, self.width, self.room = _schema(row_tokens), row_tokens, row_tokens * batch_rows
        self.out = pa.ipc.new_file(target, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.room:
            every = np.concatenate(self.held)
            for at in range(0, len(every) - self.room + 1, self.room):
                self._write(every[at : at + self.room], self.room)
            self.held = [every[len(every) // self.room * self.room :]]
            self.size = len(self.held[0])

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(ids, pa.uint16()), type=self.schema.field(0).type)
        flags = pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field(1).type)
        self.out.write_batch(pa.RecordBatch.from_arrays([tokens, flags], schema=self.schema))

    def close(self) -> None:
        if self.size:
            every = np.concatenate(self.held)
            self._write(np.pad(every, (0, -len(every) % self.width)), len(every))
        self.out.close()


class RowReader:
    """Random access to the ids of a file: ``ids(start, n)``; batches stay in the memory map."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.width = int(self.file.schema.metadata[b"row_tokens"])
        self.at: tuple[int, np.ndarray] | None = None
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def _batch(self, k: int) -> np.ndarray:
        if self.at is None or self.at[0] != k:
            b = self.file.get_batch(k)
            ids = b["tokens"].flatten().to_numpy(zero_copy_only=True)
            if k == self.file.num_record_batches - 1:
                ids = ids[: b["mask"].flatten().true_count]
            self.at = (k, ids)
        return self.at[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, out = self.rows * self.width, []
        while n:
            part = self._batch(start // size)[start % size : start % size + n]
            if not len(part):
                raise ValueError(f"the file ends before {start}")
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _place(uri: str):
    """File system and path of a URI of the shared folder."""
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, row_tokens: int, batch_rows: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, part, at = None, None, None, 0
        ids_of, starts, sizes = [], [], []
        encode = encoder(name)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:  # a name of its own for each attempt: the manifest knows which one counts
                where, base = _place(folder)
                where.create_dir(base, recursive=True)
                part, path = batch["part"][0].as_py(), f"{folder}/{uuid.uuid4().hex}"
                sink = where.open_output_stream(f"{base}/{path.rpartition('/')[2]}.arrow")
                writer = RowWriter(sink, row_tokens, batch_rows)
            for text in batch["text"].to_pylist():
                ids = np.append(np.frombuffer(encode(text or ""), "<u2"), np.uint16(END_ID))
                writer.add(ids)
                starts.append(at)
                sizes.append(len(ids))
                at += len(ids)
            ids_of.append(batch["doc_id"])
        if writer is not None:
            writer.close()
            sink.close()
            index = pa.table([pa.chunked_array(ids_of), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "start", "n_tokens"])
            with where.open_output_stream(f"{base}/{path.rpartition('/')[2]}.index.arrow") as f, pa.ipc.new_file(f, index.schema) as out:
                out.write_table(index, max_chunksize=INDEX_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([len(starts)], pa.int64()), pa.array([at], pa.int64())], ["part", "path", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS, batch_rows: int = BATCH_ROWS, file_docs: int = FILE_DOCS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Write the files and return their manifest, one row per file: part, path, docs, tokens.

    Files are ranges of ids, numbered by ``part`` in ascending order; ``path``.arrow has the
    rows, ``path``.index.arrow the place of each document. The manifest is committed with its
    tasks, so files of failed attempts are never read. Defined cases: a null text counts as
    empty and has its end id; null ids come first; rows with equal ids are neighbours in
    order of their text; an empty table writes no file; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "arrow")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // file_docs))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id().cast("long"))
    done = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_write(folder, row_tokens, batch_rows, vocabulary), "part long, path string, docs long, tokens long")
    return materialise(done, "manifest")


def _open(uri: str):
    where, base = _place(uri)
    return pa.memory_map(base) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(base)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
            tokens, index = RowReader(_open(f"{path}.arrow")), pa.ipc.open_file(_open(f"{path}.index.arrow"))
            for k in range(index.num_record_batches):
                b = index.get_batch(k)
                start, size = b["start"].to_numpy(), b["n_tokens"].to_numpy()
                sums = [zlib.crc32(tokens.ids(s, n).astype("<u4").tobytes()) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(start + base), b["n_tokens"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return files.repartition(max(1, manifest.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
