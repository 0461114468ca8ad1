"""A model made of the supplied tables, so that operators run on data of any scale.

Parts are files (brand is the package, brand and type the folder, type the concept). Every line
of an order is an edge to the next one: large lines import, others mention. Lines are symbols;
every event is a step to the next user: errors are calls, others references. Events are coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.lineage import next_in_order
from tessera.model import Model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> F.Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    role = F.when(F.col("p_size") % 5 == 0, "test").otherwise("code")
    folder = F.concat("p_brand", F.lit("/"), "p_type")
    return p.select(
        F.concat(F.lit("w:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("w:"), folder, F.lit("/")).alias("parent_id"), F.lit("file").alias("kind"),
        F.when(role == "test", "test file").otherwise("source file").alias("display_kind"), F.col("p_name").alias("name"), F.lit("w").alias("workspace_id"),
        F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("loc"), _text('{"role":"', role, '"}').alias("attrs"), F.col("p_brand").alias("package"), F.col("p_type").alias("concept"), folder.alias("folder"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the parts of consecutive lines of an order: imports from lines of 45 and more, else mentions."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.when(F.col("l_quantity") >= 45, "imports").otherwise("mentions").alias("kind")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", kind, F.lead("l_partkey").over(by).alias("next"))
    rows = rows.filter("next is not null and next <> l_partkey").groupBy("l_partkey", "next", "kind").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    at = lambda c: F.concat(F.lit("w:"), F.col(c).cast("string"))
    return rows.select(at("l_partkey").alias("src"), at("next").alias("dst"), "kind", "weight")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).filter("kind = 'imports'")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("w:"), F.col("l_partkey").cast("string"))
    local = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.concat(part, F.lit("#"), local).alias("id"), part.alias("parent_id"), F.lit("symbol").alias("kind"), F.lit("function").alias("display_kind"), local.alias("name"), F.lit("w").alias("workspace_id"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each event's user to the next one's, in order of time: (src, dst, kind) as user ids."""
    rows = next_in_order(table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type"), ["ts", "event_id"], "user_id", "next")
    kind = F.when(F.col("event_type") == "error", "calls").otherwise("references")
    return rows.filter("next is not null and next <> user_id").select(F.col("user_id").alias("src"), F.col("next").alias("dst"), kind.alias("kind")).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(spark, sf_dir).filter("kind = 'calls'").select("src", "dst")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_id"), F.get_json_object("props", "$.k").cast("int").alias("line"), F.when(F.col("value") >= 10, 1).otherwise(0).alias("hits"), F.col("event_type").alias("artifact"))


def model(spark: SparkSession, sf_dir: str) -> Model:
    f = files(spark, sf_dir)
    group = f.select(F.col("parent_id").alias("id"), F.lit("group").alias("kind"), F.col("folder").alias("name"), F.lit("w").alias("workspace_id"), F.col("folder").alias("path")).distinct()
    tops = f.select(F.concat(F.lit("w:"), "package", F.lit("/")).alias("id"), F.lit("group").alias("kind"), F.col("package").alias("name"), F.lit("w").alias("workspace_id"), F.col("package").alias("path")).distinct()
    packs = f.select(F.concat(F.lit("package:"), "package").alias("id"), F.lit("package").alias("kind"), F.col("package").alias("name"), F.lit("w").alias("workspace_id")).distinct()
    concepts = f.select(F.concat(F.lit("concept:"), "concept").alias("id"), F.lit("concept").alias("kind"), F.col("concept").alias("name"), F.lit("w").alias("workspace_id")).distinct()
    nodes = f.drop("package", "concept", "folder")
    for more in (group, tops, packs, concepts, symbols(spark, sf_dir)):
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    part_of = f.select(F.col("id").alias("src"), F.concat(F.lit("package:"), "package").alias("dst"), F.lit("part_of").alias("kind"))
    owns = f.select(F.concat(F.lit("concept:"), "concept").alias("src"), F.col("id").alias("dst"), F.lit("owns").alias("kind"))
    test = f.filter("attrs like '%test%'").select(F.col("id").alias("src"))
    tests = imports(spark, sf_dir).join(test, "src", "left_semi").select("src", "dst", F.lit("tests").alias("kind"))
    edges = steps(spark, sf_dir).unionByName(part_of, allowMissingColumns=True).unionByName(owns, allowMissingColumns=True).unionByName(tests, allowMissingColumns=True)
    return Model.of(spark, nodes=nodes, edges=edges, coverage_lines=coverage(spark, sf_dir))
