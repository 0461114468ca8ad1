"""Aggregations over a model: edge merge, tests, coverage, counts, votes and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.model import Model, file_part, role
from tessera.operators.lookups import scope


def merge_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst", "kind", "source"), order: str = "seq") -> DataFrame:
    """One row per key: the highest confidence, its attributes (stated ones first, then the earliest), and how often it occurs."""
    rank = F.struct(F.col("confidence"), F.col("attrs").isNotNull().alias("stated"), (-F.col(order)).alias("early"))
    return edges.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max_by("attrs", rank).alias("attrs"), F.count(F.lit(1)).alias("weight"))


def tests_for(model: Model, node_id: str, kind: str) -> DataFrame:
    """Tests linked to a node or what is inside it, surest first."""
    links = model.links("tests").filter(scope(F.col("dst"), node_id, kind))
    return _tests(model, links.groupBy("src")).orderBy(F.desc("confidence"), F.coalesce("path", F.lit("")), F.coalesce("start_line", F.lit(0)), "id")


def tests_of_files(model: Model) -> DataFrame:
    """The same for every file at once: (file, test, confidence, sources, targets)."""
    links = model.links("tests").withColumn("file", file_part("dst"))
    return links.groupBy("file", F.col("src").alias("test")).agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("source")).alias("sources"), F.countDistinct("dst").alias("targets"))


def _tests(model: Model, grouped) -> DataFrame:
    links = grouped.agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("source")).alias("sources"), F.countDistinct("dst").alias("targets"))
    results = model.results.groupBy("test_node_id").agg(F.array_sort(F.collect_list(F.struct("artifact", "status", "duration_ms"))).alias("results"))
    nodes = model.nodes.select(F.col("id").alias("src"), "name", "path", "start_line")
    out = links.join(nodes, "src", "left").join(results.withColumnRenamed("test_node_id", "src"), "src", "left")
    return out.withColumnRenamed("src", "id")


def percent(part: Column, whole: Column) -> Column:
    """One digit after the point, halves to even; null without a whole."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, 1))


def coverage(lines: DataFrame, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Covered and known lines: a line counts as covered if any artifact hit it."""
    each = lines.groupBy(*dict.fromkeys((*by, "file_id", "line"))).agg(F.max("hits").alias("hits"))
    out = each.groupBy(*by).agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count(F.lit(1)).alias("lines"))
    files = lines.groupBy(*by).agg(F.sort_array(F.collect_set("artifact")).alias("artifacts"))
    return out.withColumn("percent", percent(F.col("covered"), F.col("lines"))).join(files, list(by))


def symbol_coverage(model: Model) -> DataFrame:
    """Coverage of each symbol's own line range."""
    spans = model.kind("symbol").filter("start_line is not null").select(F.col("id").alias("symbol"), file_part("id").alias("file_id"), "start_line", "end_line")
    inside = model.coverage_lines.join(spans, "file_id").filter("line between start_line and end_line")
    return coverage(inside, ("symbol",))


def coverage_edges(edges: DataFrame) -> DataFrame:
    """``tests`` edges of all artifacts as one per pair, with the largest weight."""
    return edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")).select("src", "dst", F.lit("tests").alias("kind"), F.lit("coverage").alias("source"), F.lit(1.0).alias("confidence"), "weight")


def replace_artifact(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of artifacts that ``new`` has replace the old rows of these artifacts only."""
    return old.join(new.select("artifact").distinct(), "artifact", "left_anti").unionByName(new, allowMissingColumns=True)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def grouped_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key alone and by all together, as grouping sets."""
    sets = [*[[F.col(k)] for k in keys], [F.col(k) for k in keys]]
    return df.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def pair_weights(model: Model, floor: float = 0.6) -> DataFrame:
    """Import and call weight between different files; injected calls below the floor do not count."""
    weak = (F.coalesce(F.get_json_object("attrs", "$.via"), F.lit("")) == "injection") & (F.col("confidence") < floor)
    rows = model.links("imports", "calls").filter(~weak).select(file_part("src").alias("src"), file_part("dst").alias("dst"), "kind", "weight")
    return rows.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def roll_up(volume: DataFrame, owner: DataFrame, up: DataFrame) -> DataFrame:
    """Weight between concepts and all their ancestors, from weight between files.

    volume: src, dst, kind, weight; owner: file, concept; up: id, ancestor. Pairs where one
    end is an ancestor of both are left out.
    """
    leaf = volume.join(owner.select(F.col("file").alias("src"), F.col("concept").alias("a")), "src").join(owner.select(F.col("file").alias("dst"), F.col("concept").alias("b")), "dst")
    leaf = leaf.filter("a <> b").groupBy("a", "b", "kind").agg(F.sum("weight").alias("weight"))
    left = up.select(F.col("id").alias("a"), F.col("ancestor").alias("from_id"))
    right = up.select(F.col("id").alias("b"), F.col("ancestor").alias("to_id"))
    rows = leaf.join(left, "a").join(right, "b").filter("from_id <> to_id")
    inside = up.filter("id <> ancestor")
    nested = inside.select(F.col("id").alias("from_id"), F.col("ancestor").alias("to_id")).union(inside.select(F.col("ancestor"), F.col("id")))
    return rows.join(nested.distinct(), ["from_id", "to_id"], "left_anti").groupBy("from_id", "to_id", "kind").agg(F.sum("weight").alias("weight"))


def subtree_files(owner: DataFrame, up: DataFrame) -> DataFrame:
    """Files that each concept or a descendant owns, and how many."""
    rows = owner.withColumnRenamed("concept", "id").join(up, "id").select(F.col("ancestor").alias("concept"), "file").distinct()
    return rows.groupBy("concept").agg(F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_list("file")).alias("members"))


def repository_metrics(model: Model) -> DataFrame:
    """One row of sizes, in one pass over the nodes."""
    kind, shown = F.col("kind"), F.col("display_kind")
    file_role = F.when(kind == "file", role())
    return model.nodes.agg(
        F.count_if(file_role == "code").alias("source_files"),
        F.count_if(file_role == "test").alias("test_files"),
        *[F.count_if((kind == "symbol") & (shown == k)).alias(name) for k, name in (("class", "classes"), ("function", "functions"), ("method", "methods"))],
        F.count_if((kind == "test") & (shown == "test case")).alias("test_cases"),
        *[F.count_if(kind == k).alias(f"{k}s") for k in ("deployable", "package", "concept")],
    )


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, votes): the value with most votes, ties to the smaller one."""
    n = votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(value))).alias("best"))
    return best.select(key, F.col(f"best.{value}").alias(value), (-F.col("best.minus")).alias("votes"))


def measures(changes: DataFrame, *by: str) -> DataFrame:
    """Additions, deletions, churn and state counts of changed files (state, additions, deletions, binary, lines_known)."""
    churn = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0)) + F.when(F.col("binary"), 1).otherwise(0)
    return changes.groupBy(*by).agg(
        F.sum(F.coalesce("additions", F.lit(0))).alias("additions"),
        F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"),
        F.sum(churn).alias("churn"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("added", "removed", "moved", "edited")],
        F.bool_and("lines_known").alias("lines_known"),
    )


def model_digest(model: Model) -> DataFrame:
    """A digest of all nodes and edges, as a bag: it does not depend on their order, and repeated rows count."""
    rows = [df.drop("model_id").select(F.concat(F.lit(kind), F.to_json(F.struct(*sorted(c for c in df.columns if c != "model_id")), {"ignoreNullFields": "false"})).alias("row")) for kind, df in (("n", model.nodes), ("e", model.edges))]
    return bag_digest(rows[0].union(rows[1]), "row")


def bag_digest(df: DataFrame, *columns: str, buckets: int = 4096) -> DataFrame:
    """The sha256 of the sha256s of all rows in order, taken by bucket of the leading digits first."""
    rows = df.select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")
    rows = rows.select(F.pmod(F.conv(F.substring("h", 9, 8), 16, 10).cast("long"), F.lit(buckets)).alias("inner"), bucket, F.concat_ws(":", "h", F.col("n").cast("string")).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    small = rows.groupBy("bucket", "inner").agg(joined("h").alias("h")).groupBy("bucket").agg(joined(F.concat_ws(":", F.col("inner").cast("string"), F.col("h"))).alias("h"))
    return small.agg(joined(F.concat_ws(":", F.col("bucket").cast("string"), F.col("h"))).alias("digest"))


def ordered_digest(df: DataFrame, *order: str) -> DataFrame:
    """The sha256 of all rows as JSON, in order; for small documents."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*df.columns)).alias("row"))))
    return df.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["row"]), "\n"), 256).alias("digest"))


def deployable_inputs(model: Model) -> DataFrame:
    """Files and packages of deployables: (deployable, input, via)."""
    ends = model.kind("deployable").select(F.col("id").alias("deployable"))
    files = model.links("part_of").withColumnRenamed("dst", "deployable").join(ends, "deployable", "left_semi").select("deployable", F.col("src").alias("input"), F.lit("part_of").alias("via"))
    packs = model.kind("package").select(F.col("id").alias("input"))
    stated = model.links("depends_on").withColumnsRenamed({"src": "deployable", "dst": "input"}).join(ends, "deployable", "left_semi").join(packs, "input", "left_semi").select("deployable", "input", F.lit("depends_on").alias("via"))
    inside = model.links("part_of").select(F.col("src").alias("file"), F.col("dst").alias("pack")).join(packs.withColumnRenamed("input", "pack"), "pack", "left_semi")
    over = files.join(inside, files["input"] == inside["file"]).select("deployable", F.col("pack").alias("input"), F.lit("member").alias("via"))
    return files.union(stated).union(over).distinct()


def system_overview(model: Model, externals: int = 10) -> dict[str, DataFrame]:
    owned = model.links("owns").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    kids = model.kind("concept").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    roots = model.kind("concept").filter("parent_id is null").select("id", "name").join(owned, "id", "left").join(kids, "id", "left").na.fill(0, ["files", "children"])
    return {
        "counts": counts(model.nodes, "kind"),
        "concepts": roots.orderBy("name", "id"),
        "containers": model.kind("deployable", "package").select("id", "kind", "name").orderBy("kind", "name", "id"),
        "externals": model.kind("external").select("id", "name").orderBy("name", "id").limit(externals),
    }


def prime(model: Model) -> dict[str, DataFrame]:
    """Where to look first: the most tested symbol, and the folder with most files."""
    tested = model.links("tests").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
    called = model.links("calls").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    symbols = model.kind("symbol").select("id", "name").join(tested, "id", "left").join(called, "id", "left").na.fill(0, ["tests", "calls"])
    folders = model.files().filter("path like '%/%'").groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    return {"symbol": symbols.orderBy(F.desc("tests"), F.desc("calls"), "id").limit(1), "folder": folders.orderBy(F.desc("files"), "folder").limit(1)}


def batches(files: DataFrame, size: int = 15) -> DataFrame:
    """Files (id, path) in path order, in numbered batches per folder."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    place = F.row_number().over(Window.partitionBy("folder").orderBy("path", "id")) - 1
    return files.withColumn("folder", folder).withColumn("batch", F.floor(place / size).cast("int"))


def ordinals(edges: DataFrame, *order: str) -> DataFrame:
    """0, 1, 2 ... for edges that repeat a pair."""
    return edges.withColumn("ordinal", F.row_number().over(Window.partitionBy("src", "dst").orderBy(*order)) - 1)


def attention(items: DataFrame) -> DataFrame:
    """Changed things in the order in which they need a look."""
    flags = [F.desc(c) for c in ("integrations", "untested", "structure", "relationships")]
    return items.orderBy(*flags, F.desc("churn"), F.lower("name"), "id")
