"""A model: nodes, edges and the other tables of one or more snapshots."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema


def conform(df: DataFrame, table: str, model_id: str = "worktree") -> DataFrame:
    """``df`` with exactly the columns of ``table``; absent ones get their default or null."""
    from pyspark.sql.types import StructType

    out = []
    for field in StructType.fromDDL(schema.TABLES[table]).fields:
        if field.name in df.columns:
            column = F.col(field.name)
        elif field.name == "model_id":
            column = F.lit(model_id)
        else:
            column = F.lit(schema.DEFAULTS.get(field.name))
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)


@dataclass(frozen=True)
class Model:
    """Tables of ``schema.TABLES``; each is a lazy DataFrame."""

    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    coverage_lines: DataFrame
    results: DataFrame
    tasks: DataFrame
    file_state: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, model_id: str = "worktree", **tables: DataFrame) -> Model:
        """A model of the given tables; the others are empty."""
        return cls(**{f.name: conform(tables[f.name], f.name, model_id) if f.name in tables else spark.createDataFrame([], schema.TABLES[f.name]) for f in fields(cls)})

    @classmethod
    def load(cls, spark: SparkSession, folder: str, model_id: str | None = None) -> Model:
        """Tables of a folder; with ``model_id`` only that snapshot's partitions are read."""
        out = {}
        for f in fields(cls):
            df = spark.read.schema(schema.TABLES[f.name]).parquet(f"{folder}/v{schema.VERSION}/{f.name}")
            out[f.name] = df if model_id is None else df.filter(F.col("model_id") == model_id)
        return cls(**out)

    def save(self, folder: str) -> None:
        """Write the snapshots of this model; others in the folder stay as they are."""
        for f in fields(self):
            writer = getattr(self, f.name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("model_id").parquet(f"{folder}/v{schema.VERSION}/{f.name}")

    def at(self, model_id: str) -> Model:
        return Model(**{f.name: getattr(self, f.name).filter(F.col("model_id") == model_id) for f in fields(self)})

    def views(self) -> None:
        """Register every table as a temporary view."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f.name)

    def with_(self, **tables: DataFrame) -> Model:
        return replace(self, **{k: conform(v, k) for k, v in tables.items()})

    # Common slices.
    def kind(self, *kinds: str) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(*kinds))

    def links(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def files(self) -> DataFrame:
        """File nodes with their role."""
        return self.kind("file", "doc").withColumn("role", role())


def role(attrs: str = "attrs"):
    return F.get_json_object(attrs, "$.role")


def file_part(column: str):
    """The file's id of a symbol's id."""
    return F.substring_index(F.col(column), "#", 1)
