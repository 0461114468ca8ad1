"""Point lookups, filters and the SQL pass-through."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.model import Model

CONFIDENCE_FLOOR = 0.6
SQL_ROWS = 500
SQL_SECONDS = 5.0


def resolve(model: Model, ref: str) -> DataFrame:
    """Nodes that a reference names, of the best tier only: id, path (with ``#name``), name or id suffix."""
    path, _, inner = ref.strip("/").partition("#")
    nodes = model.nodes
    place = nodes.kind.isin("file", "doc", "group") & (F.rtrim(F.col("path"), F.lit("/")) == path)
    if inner:
        place = nodes.kind.isin("symbol", "test") & (F.col("path") == path) & F.col("id").endswith("#" + inner)
    named = (F.col("name") == ref) | F.col("id").endswith("#" + ref)
    tier = F.when(F.col("id") == ref, 1).when(place, 2).when(named, 3)
    hits = nodes.withColumn("tier", tier).filter("tier is not null")
    best = hits.withColumn("best", F.min("tier").over(Window.partitionBy(F.lit(1))))
    return best.filter("tier = best").drop("tier", "best").orderBy("id")


def scope(ids: Column, node_id: str, kind: str) -> Column:
    """Whether an id is the node or inside it."""
    mark = {"file": "#", "doc": "#", "symbol": ".", "test": ".", "workspace": ":", "group": ""}.get(kind)
    if mark is None:
        return ids == node_id
    return (ids == node_id) | ids.startswith(node_id + mark)


def children(model: Model, node_id: str) -> DataFrame:
    return model.nodes.filter(F.col("parent_id") == node_id).orderBy(F.coalesce("start_line", F.lit(0)), "name", "id")


def edges_of(model: Model, node_id: str, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Edges of a node with their other end; those below the floor only if they come from injection."""
    sure = (F.col("confidence") >= floor) | ((F.col("kind") == "calls") & (F.get_json_object("attrs", "$.via") == "injection"))
    out = model.edges.filter(F.col("src") == node_id).withColumn("direction", F.lit("out")).withColumn("other", F.col("dst"))
    into = model.edges.filter(F.col("dst") == node_id).withColumn("direction", F.lit("in")).withColumn("other", F.col("src"))
    ends = model.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("path").alias("other_path"), F.col("display_kind").alias("other_kind"))
    return out.unionByName(into).filter(sure).join(ends, "other", "left")


def top_edges(model: Model, node_id: str, per_group: int = 10) -> DataFrame:
    """The surest edges of each kind and direction."""
    best = Window.partitionBy("kind", "direction").orderBy(F.desc("confidence"), F.desc("weight"), "other")
    return edges_of(model, node_id).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= per_group)


def show(model: Model, ref: str, floor: float = CONFIDENCE_FLOOR) -> dict[str, DataFrame]:
    """All that is known about one node, by section; LookupError unless exactly one is named."""
    hits = resolve(model, ref).select("id", "kind").take(2)
    if len(hits) != 1:
        raise LookupError(f"{ref!r} names {len(hits)} nodes")
    node_id, kind = hits[0]
    return {
        "node": model.nodes.filter(F.col("id") == node_id),
        "children": children(model, node_id),
        "edges": edges_of(model, node_id, floor),
        "tests": model.links("tests").filter(scope(F.col("dst"), node_id, kind)),
        "diagnostics": model.diagnostics.filter(F.col("node_id") == node_id),
        "concepts": model.links("owns").filter(F.col("dst") == node_id).select(F.col("src").alias("concept")),
    }


def status(model: Model) -> dict[str, DataFrame]:
    """Counts of nodes by display kind, of open tasks and of diagnostics by kind, with examples and limits."""
    return {
        "nodes": model.nodes.groupBy("display_kind").agg(F.count(F.lit(1)).alias("n")),
        "tasks": model.tasks.filter("state = 'open'").groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        "diagnostics": model.diagnostics.groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        "examples": diagnostic_examples(model),
        "boundaries": boundaries(model),
        "cycles": model.diagnostics.filter("kind = 'cycle'").agg(F.countDistinct("detail").alias("cycles"), F.count(F.lit(1)).alias("members")),
    }


def diagnostic_examples(model: Model, per_kind: int = 3) -> DataFrame:
    paths = model.nodes.select(F.col("id").alias("node_id"), "path")
    order = Window.partitionBy("kind").orderBy(F.coalesce("path", F.lit("")), "node_id", "detail")
    rows = model.diagnostics.join(paths, "node_id", "left").withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("place") <= per_kind).select("kind", "node_id", "path", "detail", "place")


def boundaries(model: Model) -> DataFrame:
    """Where resolution ends: the ``[resolution=...]`` marks of diagnostics, counted."""
    mark = F.regexp_extract("detail", r"\[resolution=([^\]]*)\]", 1)
    return model.diagnostics.select("kind", mark.alias("boundary")).filter("boundary <> ''").groupBy("kind", "boundary").agg(F.count(F.lit(1)).alias("n"))


def set_diagnostics(old: DataFrame, new: DataFrame, kinds: list[str]) -> DataFrame:
    """``old`` with the rows of ``kinds`` replaced by ``new`` ones; a null detail only removes."""
    keys = new.filter(F.col("kind").isin(*kinds)).select("node_id", "kind").distinct()
    return old.join(keys, ["node_id", "kind"], "left_anti").unionByName(new.filter("detail is not null"), allowMissingColumns=True)


def route_filter(model: Model, needle: str) -> DataFrame:
    """Nodes whose attributes contain a piece of a route."""
    return model.nodes.filter(F.col("attrs").contains(needle)).orderBy("id")


def filter_endpoints(endpoints: DataFrame, path: str | None = None, method: str | None = None, handler: str | None = None, table: str | None = None) -> DataFrame:
    """Endpoints (path, method, handler, file, tables) that match all that is asked."""
    out = endpoints
    if path:
        out = out.filter(F.lower("path").contains(path.lower()))
    if method:
        out = out.filter(F.upper("method") == method.upper())
    if handler:
        out = out.filter(F.lower("handler").contains(handler.lower()) | F.lower("file").contains(handler.lower()))
    if table:
        out = out.filter(F.exists("tables", lambda t: F.lower(t).contains(table.lower())))
    return out


def filter_tables(tables: DataFrame, keys: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    """Tables (id, name) by a piece of name or id, and foreign keys (src, dst) with either end among them."""
    hit = tables.filter(F.lower("name").contains(needle.lower()) | F.lower("id").contains(needle.lower()))
    ids = hit.select(F.col("id").alias("t"))
    on = (F.col("t") == F.col("src")) | (F.col("t") == F.col("dst"))
    return hit, keys.join(F.broadcast(ids) if ids.limit(1001).count() <= 1000 else ids, on, "left_semi")


def list_tasks(model: Model, state: str = "open", limit: int = 50, offset: int = 0) -> DataFrame:
    from tessera.operators.graph import page

    nodes = model.nodes.select(F.col("id").alias("node_id"), "path", "name")
    rows = model.tasks.filter(F.col("state") == state).join(nodes, "node_id", "left")
    return page(rows, [F.coalesce("path", F.lit("")), F.col("id")], limit, offset)


class NotReadOnly(ValueError):
    pass


def check_read_only(spark: SparkSession, query: str) -> None:
    """Raise unless the parsed statement only reads."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("Command") and name != "ExplainCommand" or name.startswith(("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Set", "Load", "Truncate", "Replace", "Cache", "Uncache", "Refresh", "Add", "Analyze", "Repair")):
            raise NotReadOnly(f"only SELECT, WITH and EXPLAIN are allowed: {name}")
        children_ = node.children()
        todo += [children_.apply(i) for i in range(children_.size())]


def safe_sql(spark: SparkSession, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows of a read-only query over the model's views; limit is held to 1..500."""
    if offset < 0:
        raise ValueError("offset is negative")
    check_read_only(spark, query)
    out = spark.sql(query)
    return (out.offset(offset) if offset else out).limit(max(1, min(limit, SQL_ROWS)))


def run_sql(spark: SparkSession, query: str, limit: int = 50, offset: int = 0, seconds: float = SQL_SECONDS) -> dict:
    """A read-only query's result as a document; it is cancelled after ``seconds``."""
    tag = f"tessera-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        df = safe_sql(spark, query, limit, offset)
        rows = [r.asDict(True) for r in df.collect()]
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return {"query": query, "columns": df.columns, "row_count": len(rows), "rows": rows}
