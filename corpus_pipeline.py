"""A corpus pipeline of five operators: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes what a stage returns as Parquet in the shared folder and
gives it to the next one.

Defined for all stages: docs has at least doc_id, text, lang, source and n_chars, any of them
null in any row; a null text counts as empty; texts may be of any length; ids and whole rows
may repeat; other columns, whatever their names, are not passed on; an empty table gives an
empty table. What a stage does beyond that stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import drop_copies
from tessera.llm.jaccard_join import keep_one
from tessera.llm.packing import pack
from tessera.llm.quality_gam import keep_good
from tessera.llm.storage import materialise
from tessera.llm.substring_dedup import remove_repeats
from tessera.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The rows come from a fitted model and from tokenizers, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A row is judged by its text alone, so repeated rows stay or go together, and empty texts
    are judged like others; rows with a null id are judged too. Without labels all scores are one.
    """
    return keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the longest, then the smallest id.

    All empty texts are one text; a null id loses ties; of rows with one id and length one stays.
    """
    return drop_copies(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id, a null id before all others.

    Rows of one id and several texts are told apart by a digest of the text, and of equal rows
    one stays; rows without words have no copies and all stay.
    """
    ship(spark)
    return keep_one(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier; all rows stay, with what is left of their texts.

    Earlier is by id (null first), then by a hash of the text; equal rows count as one document
    and keep the same. A text that loses nothing, null too, stays as it is; n_chars is set anew
    where a text loses something.
    """
    ship(spark)
    out = remove_repeats(docs).withColumn("text", F.when(F.col("__cut"), F.col("__kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("__cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens.

    Every row is packed, repeated ones once each; empty texts have their end id; null sources
    are one source.
    """
    ship(spark)
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
