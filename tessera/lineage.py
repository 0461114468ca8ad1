"""Cutting the lineage of iterative jobs with tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and all tasks run on this machine, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _own.setdefault("dir", tempfile.mkdtemp(prefix="tessera-"))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; lost executors cost reruns only."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str, when: str = "true") -> tuple[DataFrame, int]:
    """``materialise`` for joins that never broadcast, and the number of rows where ``when`` holds, counted as they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count_if(F.expr(when)).alias("n")), label)
    return shuffled(out), seen.get["n"]


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that never broadcasts: small files can hold rows that take a hundred times their size in the driver."""
    return df.hint("merge")


def next_in_order(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: ``value`` of the next row in the order of all rows, null for the last one.

    Rows are dealt by ranges of the order and each range looks at its own rows; what follows a
    range's last row is the first row of the next range, of which there is one a range.
    """
    rows = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    first = rows.groupBy("__range").agg(F.min(F.struct(*order, value)).alias("__first"))
    follow = first.select("__range", F.lead(f"__first.{value}").over(Window.orderBy("__range")).alias("__follow"))  # one row a range
    inside = F.lead(F.struct(value)).over(Window.partitionBy("__range").orderBy(*order))
    out = rows.withColumn("__inside", inside).join(F.broadcast(follow), "__range")
    return out.withColumn(name, F.when(F.col("__inside").isNotNull(), F.col(f"__inside.{value}")).otherwise(F.col("__follow"))).drop("__range", "__inside", "__follow")
