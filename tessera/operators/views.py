"""System views: the database, and texts that are made of views."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.model import Model


def database(columns: DataFrame, keys: DataFrame, uses: DataFrame) -> DataFrame:
    """One row per table: columns (keys first, then by name), foreign keys both ways, and who reads and writes it.

    columns: table, column, type, nullable, pk, unique, default; keys: table, column, to_table, to_column; uses: src, dst (table), kind, attrs.
    """
    shown = F.struct((~F.col("pk")).alias("rest"), F.lower("column").alias("key"), "column", "type", "nullable", "pk", "unique", "default")
    a = columns.groupBy("table").agg(F.array_sort(F.collect_list(shown)).alias("columns"))
    out = keys.groupBy("table").agg(F.array_sort(F.collect_set(F.struct("column", "to_table", "to_column"))).alias("references"))
    into = keys.groupBy(F.col("to_table").alias("table")).agg(F.array_sort(F.collect_set(F.struct(F.col("table").alias("from_table"), "column"))).alias("referenced_by"))
    used = uses.groupBy(F.col("dst").alias("table")).agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.struct("src", "attrs")))).alias(n) for k, n in (("reads_table", "readers"), ("writes_table", "writers"))])
    return a.join(out, "table", "left").join(into, "table", "left").join(used, "table", "left").orderBy(F.lower("table"))


def er_diagram(columns: DataFrame, keys: DataFrame) -> str:
    """A Mermaid entity diagram; names are held to what the grammar allows."""
    rows = columns.select("table", S.mermaid_id("table").alias("t"), S.mermaid_id("column").alias("c"), S.mermaid_id(F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown"))).alias("k"), "pk")
    out = ["erDiagram"]
    for r in rows.groupBy("t").agg(F.array_sort(F.collect_list(F.struct((~F.col("pk")).alias("o"), "c", "k", "pk"))).alias("x")).orderBy("t").toLocalIterator():
        out += [f"  {r['t']} {{", *[f"    {x['k']} {x['c']}{' PK' if x['pk'] else ''}" for x in r["x"]], "  }"]
    for r in keys.select(S.mermaid_id("to_table").alias("a"), S.mermaid_id("table").alias("b"), "column").distinct().orderBy("a", "b", "column").toLocalIterator():
        out.append(f'  {r["a"]} ||--o{{ {r["b"]} : "{r["column"]}"')
    return "\n".join(out)


def to_json(df: DataFrame, limit: int = 500) -> str:
    """Rows as JSON with two spaces of indent."""
    return json.dumps([r.asDict(True) for r in df.limit(limit).collect()], indent=2, default=str)


def to_markdown(df: DataFrame, limit: int = 100) -> str:
    columns = df.columns
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in df.limit(limit).toLocalIterator():
        lines.append("| " + " | ".join(str(x if x is not None else "").replace("|", "\\|").replace("\n", " ") for x in r) + " |")
    return "\n".join(lines)


def to_text(df: DataFrame, limit: int = 100) -> str:
    return "\n".join("  ".join("" if x is None else str(x) for x in r) for r in df.limit(limit).toLocalIterator())


# --- concept map ----------------------------------------------------------------------------------


def boxes(model: Model) -> DataFrame:
    """(box, file, via): the concept of each production file, else its deployable or package, else its folder."""
    from tessera.operators.binding import containers_of

    files = model.files().filter("role = 'code'").select("id", "parent_id")
    owned = model.links("owns").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("concept"))
    rest = containers_of(files, model.links("part_of"), model.kind("deployable", "package").select("id", "kind")).withColumnsRenamed({"file": "id"})
    return files.join(owned, "id", "left").join(rest, "id").select(F.coalesce("concept", "container").alias("box"), F.col("id").alias("file"), F.when(F.col("concept").isNotNull(), "concept").otherwise("container").alias("via"))


def concept_map(model: Model) -> dict[str, DataFrame]:
    """Boxes with sizes, tests, environment and HTTP calls, and what joins them: imports and calls by weight, and HTTP."""
    from tessera.operators.rollups import pair_weights

    box = boxes(model)
    one = box.select("file", "box")
    of = lambda column, name: F.substring_index(column, "#", 1).alias(name)
    symbols = model.kind("symbol").select(of("id", "file")).join(one, "file").groupBy("box").agg(F.count(F.lit(1)).alias("symbols"))
    tests = model.links("tests").select("src", of("dst", "file")).join(one, "file").groupBy("box").agg(F.countDistinct("src").alias("tests"))
    env = model.links("reads_env").select("dst", of("src", "file")).join(one, "file").groupBy("box").agg(F.sort_array(F.collect_set(F.substring_index("dst", ":", -1))).alias("env"))
    sizes = box.groupBy("box", "via").agg(F.count(F.lit(1)).alias("files"))
    pairs = pair_weights(model).unionByName(model.links("http_calls").select(of("src", "src"), of("dst", "dst"), "kind", "weight"))
    a, b = one.withColumnsRenamed({"file": "src", "box": "from_box"}), one.withColumnsRenamed({"file": "dst", "box": "to_box"})
    links = pairs.join(a, "src").join(b, "dst").filter("from_box <> to_box").groupBy("from_box", "to_box", "kind").agg(F.sum("weight").alias("weight"))
    return {"boxes": sizes.join(symbols, "box", "left").join(tests, "box", "left").join(env, "box", "left").na.fill(0, ["symbols", "tests"]), "links": links}


def symbol_details(model: Model) -> DataFrame:
    """Per outermost symbol: tests of it or what is inside it with their worst result, and its coverage."""
    from tessera.operators.rollups import symbol_coverage

    top = model.kind("symbol").select("id", F.concat(F.substring_index("id", "#", 1), F.lit("#"), F.substring_index(F.substring_index("id", "#", -1), ".", 1)).alias("top"))
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "skipped", 1).otherwise(0)
    worst = model.results.groupBy(F.col("test_node_id").alias("src")).agg(F.max(rank).alias("rank"))
    linked = model.links("tests").join(top, F.col("dst") == F.col("id")).select("src", "top").distinct().join(worst, "src", "left")
    tests = linked.groupBy("top").agg(F.count(F.lit(1)).alias("tests"), F.max("rank").alias("rank"))
    state = F.when(F.col("rank") == 2, "failed").when(F.col("rank") == 1, "skipped").when(F.col("rank") == 0, "passed")
    shown = top.filter("id = top").select("top")
    return shown.join(tests, "top", "left").join(symbol_coverage(model).select(F.col("symbol").alias("top"), "percent"), "top", "left").select(F.col("top").alias("id"), F.coalesce("tests", F.lit(0)).alias("tests"), state.alias("result"), "percent")


def review_markdown(groups: DataFrame, limit: int = 200) -> str:
    """A review text of grouped changes (group, group_kind, changes), most important groups first."""
    out = ["# Changes"]
    for g in groups.limit(limit).toLocalIterator():
        out += [f"\n## {g['group']} ({g['group_kind']})", *[f"- {c['kind']}: {c['summary']}" for c in g["changes"]]]
    return "\n".join(out)
