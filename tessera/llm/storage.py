"""Tables in the shared checkpoint folder, and joins that survive a hot key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import materialise, shared_dir

__all__ = ["fresh_path", "free_names", "hot_split_join", "materialise", "shared_dir"]

#: A key that holds more than this share of the rows is hot; so there are at most 1 / share of them.
HOT_SHARE = 1 / 1024


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column of ``taken`` has already (in any case)."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{label}"


def hot_split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join to ``right`` (unique keys), with hot keys apart.

    ``weight`` is a column of ``right``: how many rows of ``left`` have the key. Keys above
    ``HOT_SHARE`` of ``total`` number at most ``1 / HOT_SHARE`` by counting, so broadcasting
    them is bounded whatever the size; the other keys go through an ordinary shuffle join.
    """
    limit = max(1000, int(total * HOT_SHARE))
    value = [c for c in right.columns if c not in keys]
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    mark = hot.select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in value], F.lit(True).alias("__hot"))
    step = left.join(F.broadcast(mark), keys, "left")
    kept = list(left.columns)
    direct = step.filter(F.col("__hot").isNotNull()).select(*kept, *[F.col(f"__hot_{c}").alias(c) for c in value])
    rest = step.filter(F.col("__hot").isNull()).select(*kept).join(cold, keys, "left").select(*kept, *value)
    return direct.unionByName(rest)
