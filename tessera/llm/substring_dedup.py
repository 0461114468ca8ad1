"""Substring dedup (10): super-k-mer partitioning over windows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cutting import with_keys, without_ranges
from tessera.llm.repeats import repeated_windows

#: Words of a window, and words of the runs whose least hash is the minimiser.
WIDTH = 20
SPAN = 5


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """All rows and columns of ``docs`` plus what is left of their texts without windows that also start earlier.

    Added: ``__n_units`` and ``__n_removed`` (words of the text, and of those the removed
    ones), ``__kept`` (what is left, joined by one space), ``__sha`` (its sha256), ``__cut``
    (whether a window of it also starts earlier). Defined cases: a null text counts as empty
    and keeps nothing; a null id comes before all ids; rows with equal id and text count as
    one document and keep the same; rows with equal id and other texts are ordered by a hash
    of the text; texts with fewer than ``width`` words lose nothing; texts may be of any
    length; an empty table gives an empty table. Columns of ``docs`` keep their names and
    values; names that begin with two underscores are reserved.
    """
    found = repeated_windows(with_keys(docs, id_col, text_col), "word", width, span)
    ranges = found.select("k1", "k2", "start", (F.col("n") + (width - 1)).alias("n"))
    return without_ranges(docs, ranges, id_col, text_col, "word")
