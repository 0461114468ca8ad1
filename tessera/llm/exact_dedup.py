"""Exact dedup (7): tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to leaves; a leaf's digests, sorted and each once, are its run. In each round
``FAN_IN`` neighbouring runs become one: the partitions that hold them exchange stripes, that
is ranges of digests, so that each gets one stripe of all of them, merges it in digest order
and keeps the best row of each text. A round leaves a ``FAN_IN``-th of the runs, in as many
times the stripes; so the number of cells (run, stripe) stays the same, a cell is whole in one
partition, and its size is bounded however many rows there are. After the last round one run
is left, whose stripes hold each text once. A text that a third of all rows share is at
most ``FAN_IN`` rows of any merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import free_names, hot_split_join, materialise

#: Runs that one merge joins, and rows of a leaf on average.
FAN_IN = 8
LEAF_ROWS = 1 << 15

#: Fixed value: the characters that do not count, as a Java pattern.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def content_digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digests(docs: DataFrame, id_col: str, text_col: str, content: bool = False) -> DataFrame:
    """Per row: doc_id, row (its number), digest (sha256 of the normalised text), its length in bytes and the code points of the text.

    The table is written before it is read, so a row has the same number for every reader. With
    ``content``, rows have a digest of the text as it is too.
    """
    text, norm = F.coalesce(F.col(text_col), F.lit("")), normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(norm, 256).alias("digest"),
        F.octet_length(norm).alias("bytes"),
        F.char_length(text).cast("long").alias("points"),
        *([content_digest(text).alias("content")] if content else []),
    )
    return materialise(rows, "digests")


def leaves_for(rows: int, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> int:
    """A power of ``fan_in``, two rounds at least, with at most ``leaf_rows`` rows a leaf on average."""
    leaves = fan_in**2
    while leaves * leaf_rows < rows:
        leaves *= fan_in
    return leaves


def _merge(level: DataFrame) -> DataFrame:
    """Each cell's rows, sorted by digest, with the best row of each text."""
    cells = level.repartition("run", "stripe").sortWithinPartitions("run", "stripe", "digest", "bytes")
    return cells.groupBy("run", "stripe", "digest", "bytes").agg(F.max("best").alias("best"), F.sum("size").alias("size"))


def tree_merge(rows: DataFrame, leaves: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: digest, bytes, best and size.

    best: points, then the smallest id (bits flipped to make it the largest; rows without an id
    come last), then the smallest row. Digest and byte length are compared together at every
    level.
    """
    best = F.struct("points", F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))).alias("flipped"), F.bitwise_not(F.col("row")).alias("row"))
    run = F.pmod(F.xxhash64("row"), F.lit(leaves)).cast("long")
    level = _merge(rows.select("digest", "bytes", run.alias("run"), F.lit(0).cast("long").alias("stripe"), best.alias("best"), F.lit(1).cast("long").alias("size")))
    runs, stripes = leaves, 1
    while runs > 1:
        runs, stripes = runs // fan_in, stripes * fan_in
        share = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")  # of 2 ** 32
        level = _merge(level.withColumns({"run": F.floor(F.col("run") / fan_in), "stripe": F.shiftright(share * stripes, 32)}))
    return level.drop("run", "stripe")


def _grouped(rows: DataFrame) -> DataFrame:
    """The rows of ``digests`` with keep_id, size (null if alone) and kept."""
    total = rows.count()
    group = tree_merge(rows, leaves_for(total)).filter("size > 1")
    group = group.select("digest", "bytes", F.when(F.col("best.has_id"), F.bitwise_not(F.col("best.flipped"))).alias("keep_id"), F.bitwise_not(F.col("best.row")).alias("first"), "size")
    out = hot_split_join(rows, group, ["digest", "bytes"], "size", total)
    alone = F.col("size").isNull()
    return out.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "kept": alone | (F.col("row") == F.col("first"))})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; of equal texts the one with the most
    code points stays, then the smallest id. Defined cases: a null text counts as empty, and
    all empty texts are one group; a null id loses every tie and is its own keep_id only if
    no row with as many code points has an id; of rows with the same id and length one is kept
    (``kept`` is true once per group); texts may be of any length; an empty table gives an empty
    table; other columns are not read.
    """
    out = _grouped(digests(docs, id_col, text_col))
    return out.select("doc_id", "keep_id", F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row per text, as in ``exact_groups``.

    Rows are told apart by id and text; those that repeat both are one row afterwards. Texts
    are not written, only digests of them. Columns may have any names.
    """
    id_, content, turn, k, c = free_names(docs.columns, "id", "content", "turn", "k", "c")
    rows = _grouped(digests(docs, id_col, text_col, content=True)).filter("size > 1")
    told = materialise(rows.groupBy("doc_id", "content").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "told")
    gone = told.filter("not kept").select(F.col("doc_id").alias(k), F.col("content").alias(c))
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), content: content_digest(F.coalesce(F.col(text_col), F.lit("")))})
    kept = keyed.join(gone, F.col(id_).eqNullSafe(F.col(k)) & (F.col(content) == F.col(c)), "left_anti")
    if not told.filter("kept and n > 1").isEmpty():
        kept = kept.withColumn(turn, F.row_number().over(Window.partitionBy(id_, content).orderBy(F.lit(1)))).filter(F.col(turn) == 1).drop(turn)
    return kept.drop(id_, content)
