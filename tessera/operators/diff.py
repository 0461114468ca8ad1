"""Differences between two models, and what follows from them: moves, owners, groups, history."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.lineage import next_in_order
from tessera.model import Model, file_part
from tessera.operators.rollups import majority
from tessera.schema import CHANGE_KINDS


def sides(base: DataFrame, head: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join: keys, structs ``base`` and ``head`` of the values, and state added, removed, changed or same."""
    a = base.select(*keys, F.struct(*[F.col(v) for v in values]).alias("base"))
    b = head.select(*keys, F.struct(*[F.col(v) for v in values]).alias("head"))
    state = F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed").when(F.col("base").eqNullSafe(F.col("head")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").withColumn("state", state)


def set_difference(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """(key, state): added, removed or both."""
    a, b = base.select(key).distinct().withColumn("b", F.lit(1)), head.select(key).distinct().withColumn("h", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("both").alias("state"))


def move_pairs(base: DataFrame, head: DataFrame, key: str = "id", hash_col: str = "content_hash") -> DataFrame:
    """(from_id, to_id, hash): ids on one side only whose hash is unique among those of each side."""
    gone = base.filter(F.col(hash_col).isNotNull()).join(head.select(key), key, "left_anti")
    new = head.filter(F.col(hash_col).isNotNull()).join(base.select(key), key, "left_anti")
    one = lambda df, name: df.groupBy(F.col(hash_col).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(name)).filter("n = 1").drop("n")
    return one(gone, "from_id").join(one(new, "to_id"), "hash").select("from_id", "to_id", "hash")



def symbol_changes(base: Model, head: Model) -> DataFrame:
    """Symbols added, removed, moved with their file, or changed in signature or body."""
    values = ["name", "signature", "content_hash", "path"]
    files = move_pairs(base.kind("file"), head.kind("file"))
    moved = files.select(F.col("from_id").alias("file"), "to_id")
    old = base.kind("symbol").withColumn("file", file_part("id")).join(moved, "file", "left")
    old = old.withColumn("was", F.col("id")).withColumn("id", F.when(F.col("to_id").isNotNull(), F.concat("to_id", F.expr("substring(id, length(file) + 1)"))).otherwise(F.col("id")))
    a = old.select("id", "was", F.struct(*values[:3]).alias("base"), F.col("path").alias("base_path"))
    b = head.kind("symbol").select("id", F.struct(*values[:3]).alias("head"), F.col("path").alias("head_path"))
    both = a.join(b, "id", "full_outer")
    kind = (
        F.when(F.col("base").isNull(), "symbol-added")
        .when(F.col("head").isNull(), "symbol-removed")
        .when(~F.col("base").eqNullSafe(F.col("head")), "symbol-changed")
        .when(F.col("was") != F.col("id"), "symbol-moved")
    )
    signature = F.col("base.signature").eqNullSafe(F.col("head.signature"))
    return both.withColumn("kind", kind).filter("kind is not null").select("kind", "id", "was", F.when(~signature, "signature").when(F.col("kind") == "symbol-changed", "body").alias("what"))


def field_changes(base: DataFrame, head: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows added, removed or altered, with the names of the fields that differ."""
    both = sides(base, head, keys, fields).filter("state <> 'same'")
    differs = F.filter(F.array(*[F.when(~F.col(f"base.{f}").eqNullSafe(F.col(f"head.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return both.withColumn("fields", F.when(F.col("state") == "changed", differs).otherwise(F.array().cast("array<string>")))


def table_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Columns (table, column, type, nullable, pk, unique, default) added, removed or altered; tables by lower name."""
    low = lambda df: df.withColumn("table", F.lower("table"))
    base, head = low(base), low(head)
    out = field_changes(base, head, ["table", "column"], ["type", "nullable", "pk", "unique", "default"])
    tables = set_difference(base, head, "table").withColumnRenamed("state", "table_state")
    kind = F.when(F.col("table_state") == "added", "table-added").when(F.col("table_state") == "removed", "table-removed").otherwise("table-altered")
    return out.join(tables, "table").select(kind.alias("kind"), "table", "column", "state", "fields")


def endpoint_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Endpoints (method, path, handler, signature, body) added, removed or changed."""
    out = field_changes(base, head, ["method", "path"], ["handler", "signature", "body"])
    return out.select(F.concat(F.lit("endpoint-"), "state").alias("kind"), "method", "path", "fields")


def env_changes(base: Model, head: Model) -> DataFrame:
    names = lambda m: m.links("reads_env").select(F.element_at(F.split("dst", ":"), -1).alias("name"))
    return set_difference(names(base), names(head), "name").filter("state <> 'both'").select(F.concat(F.lit("env-"), "state").alias("kind"), "name")


def container_changes(base: Model, head: Model) -> DataFrame:
    """Deployables, packages and dependencies on one side only."""
    out = None
    for kind in ("deployable", "package"):
        part = set_difference(base.kind(kind), head.kind(kind), "id").filter("state <> 'both'").select(F.concat(F.lit(kind + "-"), "state").alias("kind"), "id")
        out = part if out is None else out.union(part)
    pair = lambda m: m.links("depends_on").select(F.concat("src", F.lit(" -> "), "dst").alias("id"))
    return out.union(set_difference(pair(base), pair(head), "id").filter("state <> 'both'").select(F.concat(F.lit("dependency-"), "state"), "id"))


def test_changes(base: Model, head: Model) -> DataFrame:
    return set_difference(base.kind("test"), head.kind("test"), "id").filter("state <> 'both'").select(F.concat(F.lit("test-"), "state").alias("kind"), "id")


def untested_changes(changes: DataFrame, head: Model) -> DataFrame:
    """Changed symbols that no test reaches directly, through an ancestor or through their file."""
    from tessera.operators.graph import parent_chain_tested

    return changes.filter("kind = 'symbol-changed'").join(parent_chain_tested(head), "id", "left_anti").select(F.lit("untested-change").alias("kind"), "id")


def render_changes(base: Model, head: Model) -> DataFrame:
    pair = lambda m: m.links("calls").filter(F.get_json_object("attrs", "$.via") == "jsx").select(F.concat("src", F.lit(" -> "), "dst").alias("id"))
    return set_difference(pair(base), pair(head), "id").filter("state <> 'both'").select(F.concat(F.lit("render-"), "state").alias("kind"), "id")


def edge_context(base: DataFrame, head: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, label, weight, attrs) of both sides with their state."""
    return sides(base, head, ["src", "dst", "kind", "label"], ["weight", "attrs"])


def relationship_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Relationships (src, dst, label, volume, via, at): added, removed, or changed in volume, mechanism or place."""
    out = field_changes(base, head, ["src", "dst", "label"], ["volume", "via", "at"])
    what = F.when(F.array_contains("fields", "via") | F.array_contains("fields", "at"), "integration").otherwise("relationship")
    return out.select(F.concat(what, F.lit("-"), "state").alias("kind"), "src", "dst", "label", "fields")


# --- concepts ------------------------------------------------------------------------------


def _pair_sets(frame: pd.DataFrame) -> pd.DataFrame:
    """Renames, then splits, then merges among concepts of one side only; larger sets first, then ids."""
    side = {s: {r.id: frozenset(r.files) for r in frame[frame["side"] == s].itertuples()} for s in ("base", "head")}
    out: list[tuple[str, list[str], list[str]]] = []
    used: set[tuple[str, str]] = set()
    for s in ("base", "head"):
        side[s] = {k: v for k, v in side[s].items() if v}
    by_set: dict[frozenset, list[str]] = {}
    for k, v in side["head"].items():
        by_set.setdefault(v, []).append(k)
    old_sets: dict[frozenset, list[str]] = {}
    for k, v in side["base"].items():
        old_sets.setdefault(v, []).append(k)
    for files, olds in sorted(old_sets.items(), key=lambda x: x[1]):
        if len(olds) == 1 and len(by_set.get(files, [])) == 1:
            out.append(("concept-renamed", olds, by_set[files]))
            used |= {("base", olds[0]), ("head", by_set[files][0])}
    for kind, one, many in (("concept-split", "base", "head"), ("concept-merged", "head", "base")):
        for k, files in sorted(side[one].items(), key=lambda x: (-len(x[1]), x[0])):
            if (one, k) in used or len(files) < 2:
                continue
            parts = sorted(p for p, f in side[many].items() if (many, p) not in used and f <= files)
            if len(parts) >= 2 and sum(len(side[many][p]) for p in parts) == len(files) == len(frozenset().union(*(side[many][p] for p in parts))):
                out.append((kind, *(([k], parts) if one == "base" else (parts, [k]))))
                used |= {(one, k), *((many, p) for p in parts)}
    return pd.DataFrame(out, columns=["kind", "before", "after"])


def concept_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(kind, before, after) of concepts (id, files) that exist on one side: renamed, split, merged.

    Concepts are the few boxes of an architecture map; those of one side only are settled together.
    """
    gone = base.join(head.select("id"), "id", "left_anti").withColumn("side", F.lit("base"))
    new = head.join(base.select("id"), "id", "left_anti").withColumn("side", F.lit("head"))
    rows = gone.unionByName(new).select("side", "id", "files", F.lit(1).alias("all"))
    return rows.groupBy("all").applyInPandas(lambda f: _pair_sets(f), "kind string, before array<string>, after array<string>")


def ownership_moves(base: DataFrame, head: DataFrame, changes: DataFrame) -> DataFrame:
    """Files (file, concept) whose owner changed, other than by a rename, split or merge."""
    names = changes.filter("kind = 'concept-renamed'").select(F.explode("before").alias("before"), F.element_at("after", 1).alias("renamed"))
    gone = changes.filter("kind <> 'concept-renamed'").select(F.explode(F.concat("before", "after")).alias("c")).distinct()
    a = base.select("file", F.col("concept").alias("before")).join(names, "before", "left").select("file", F.coalesce("renamed", "before").alias("before"))
    b = head.select("file", F.col("concept").alias("after"))
    moved = a.join(b, "file").filter("before <> after")
    return moved.join(gone.withColumnRenamed("c", "before"), "before", "left_anti").join(gone.withColumnRenamed("c", "after"), "after", "left_anti").select("file", "before", "after")


def provisional_owners(files: DataFrame, owner: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, concept, via) for files (id, path) without an owner: the majority of import neighbours, else of the nearest owned folder."""
    bare = files.join(owner.select(F.col("file").alias("id")), "id", "left_anti")
    both = imports.select(F.col("src").alias("id"), F.col("dst").alias("file")).union(imports.select(F.col("dst"), F.col("src"))).filter("id <> file")
    near = majority(both.join(bare.select("id"), "id", "left_semi").join(owner, "file"), "id", "concept").select("id", "concept", F.lit("imports").alias("via"))
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k - 1), "/"))
    folder = lambda df: df.withColumn("folder", F.explode(up)).withColumn("depth", F.size(F.split("folder", "/")) - F.when(F.col("folder") == "", 1).otherwise(0))
    known = folder(files.join(owner.select(F.col("file").alias("id"), "concept"), "id"))
    best = majority(known, "folder", "concept").select("folder", "concept")
    rest = folder(bare.join(near.select("id"), "id", "left_anti")).join(best, "folder")
    rest = rest.groupBy("id").agg(F.max_by("concept", "depth").alias("concept")).withColumn("via", F.lit("folder"))
    return near.unionByName(rest).withColumnRenamed("id", "file")


# --- groups and overview ------------------------------------------------------------------------


def rank(kind: Column) -> Column:
    """Place of a kind of change; unknown ones last."""
    place = F.array_position(F.array(*[F.lit(k) for k in CHANGE_KINDS]), kind)
    return F.when(place > 0, place - 1).otherwise(len(CHANGE_KINDS)).cast("int")


def ordered(changes: DataFrame) -> DataFrame:
    """Changes (kind, summary, before, after) in order of importance."""
    return changes.withColumn("rank", rank(F.col("kind"))).orderBy("rank", "summary", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))


def grouped(changes: DataFrame, concept: DataFrame, deployable: DataFrame, package: DataFrame) -> DataFrame:
    """Changes (kind, summary, file) under their concepts, else a deployable, a package, or the folder.

    The maps are (file, group). One row per group: name, kind of group, changes in order.
    """
    tier = lambda df, name: df.groupBy("file").agg(F.sort_array(F.collect_set("group")).alias(name))
    folder = F.regexp_extract(F.coalesce("file", F.lit("")), r"^[^:]*:?(.*)/[^/]*$", 1)
    out = changes.withColumn("rank", rank(F.col("kind"))).join(tier(concept, "c"), "file", "left").join(tier(deployable, "d"), "file", "left").join(tier(package, "p"), "file", "left")
    named = F.when(F.col("c").isNotNull(), F.col("c")).when(F.col("d").isNotNull(), F.slice("d", 1, 1)).when(F.col("p").isNotNull(), F.slice("p", 1, 1)).otherwise(F.array(F.when(folder == "", "(ungrouped)").otherwise(folder)))
    level = F.when(F.col("c").isNotNull(), "concept").when(F.col("d").isNotNull(), "deployable").when(F.col("p").isNotNull(), "package").otherwise("folder")
    rows = out.select(F.explode(named).alias("group"), level.alias("group_kind"), F.struct("rank", "summary", "kind", "file").alias("change"))
    each = rows.groupBy("group", "group_kind").agg(F.array_sort(F.collect_list("change")).alias("changes"))
    return each.withColumn("rank", F.col("changes")[0]["rank"]).orderBy("rank", "group")


def changed_files(base: Model, head: Model, lines: DataFrame) -> DataFrame:
    """Files with state added, removed, moved or edited and their line counts (path, additions, deletions, binary)."""
    pairs = move_pairs(base.kind("file"), head.kind("file"))
    both = sides(base.kind("file", "doc"), head.kind("file", "doc"), ["id"], ["content_hash", "path"]).filter("state <> 'same'")
    to = pairs.select(F.col("to_id").alias("id"), "from_id")
    gone = pairs.select(F.col("from_id").alias("id"))
    rows = both.join(gone, "id", "left_anti").join(to, "id", "left")
    state = F.when(F.col("from_id").isNotNull(), "moved").when(F.col("state") == "changed", "edited").otherwise(F.col("state"))
    rows = rows.select("id", F.coalesce("head.path", "base.path").alias("path"), state.alias("state"), "from_id")
    return rows.join(lines, "path", "left").withColumn("lines_known", F.col("additions").isNotNull()).na.fill({"binary": False})


def module_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(id, module): the deepest package directory (id, path) above a file, else its own directory."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k - 1), "/"))
    rows = files.select("id", "path", F.explode(up).alias("dir")).join(packages.select(F.col("id").alias("package"), F.rtrim(F.col("path"), F.lit("/")).alias("dir")), "dir", "left")
    best = rows.groupBy("id", "path").agg(F.max_by("package", F.when(F.col("package").isNotNull(), F.struct(F.length("dir"), F.col("package")))).alias("package"))
    return best.select("id", F.coalesce("package", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("module"))


def review_neighbourhood(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed nodes (id), their direct neighbours, and which is which."""
    a = edges.join(changed.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    b = edges.join(changed.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    near = a.union(b).distinct().join(changed, "id", "left_anti").withColumn("role", F.lit("neighbour"))
    return changed.select("id").distinct().withColumn("role", F.lit("changed")).unionByName(near)


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a Mermaid flowchart of nodes (id, name) and edges (src, dst); ids are made unique."""
    key = F.row_number().over(Window.partitionBy("plain").orderBy("id"))
    ids = nodes.withColumn("plain", S.mermaid_id("id")).withColumn("key", F.when(key == 1, F.col("plain")).otherwise(F.concat("plain", F.lit("_"), key.cast("string"))))
    lines = ids.select(F.lit(0).alias("o"), F.concat(F.lit("  "), "key", F.lit('["'), S.mermaid_label("name"), F.lit('"]')).alias("line"))
    a, b = ids.select(F.col("id").alias("src"), F.col("key").alias("a")), ids.select(F.col("id").alias("dst"), F.col("key").alias("b"))
    links = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").select(F.lit(1).alias("o"), F.concat(F.lit("  "), "a", F.lit(" --> "), "b").alias("line"))
    body = lines.union(links).agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("x"))
    return body.select(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))


# --- history -------------------------------------------------------------------------------


def history_points(log: DataFrame) -> DataFrame:
    """First-parent commits (place, sha, parents, subject) that count: merges, numbered squash commits, and all before the first merge."""
    merge = F.size("parents") > 1
    first = log.filter(merge).agg(F.min("place").alias("first"))
    rows = log.join(first, how="left")  # one row
    numbered = F.col("subject").rlike(r"\(#\d+\)\s*$")
    return rows.filter(F.col("first").isNull() | merge | numbered | (F.col("place") < F.col("first"))).drop("first")


def consecutive(points: DataFrame) -> DataFrame:
    """Pairs of neighbouring points (base, head), oldest first."""
    rows = next_in_order(points.select("sha", "place"), ["place"], "sha", "head").filter("head is not null")
    return rows.select(F.col("sha").alias("base"), "head", "place")


def projected_owner(files: DataFrame, today: DataFrame, imports: DataFrame) -> DataFrame:
    """Owners of an old snapshot's files (id, path, content_hash) from today's (path, content_hash, concept), by tiers.

    Same path, same content (majority), folder (majority), import neighbours (majority).
    """
    same = today.groupBy("path").agg(F.min("concept").alias("c1"))
    alike = majority(today.filter("content_hash is not null"), "content_hash", "concept").select("content_hash", F.col("concept").alias("c2"))
    dir_ = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folder = majority(today.withColumn("folder", dir_), "folder", "concept").select("folder", F.col("concept").alias("c3"))
    out = files.withColumn("folder", dir_).join(same, "path", "left").join(alike, "content_hash", "left").join(folder, "folder", "left")
    sure = out.withColumn("known", F.coalesce("c1", "c2", "c3"))
    both = imports.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(imports.select("dst", "src"))
    vote = majority(both.join(sure.select(F.col("id").alias("other"), F.col("known").alias("concept")).filter("concept is not null"), "other"), "id", "concept").select("id", F.col("concept").alias("c4"))
    via = F.when(F.col("c1").isNotNull(), "path").when(F.col("c2").isNotNull(), "content").when(F.col("c3").isNotNull(), "folder").when(F.col("c4").isNotNull(), "imports")
    return sure.join(vote, "id", "left").select("id", F.coalesce("known", "c4").alias("concept"), via.alias("via"), via.isin("folder", "imports").alias("provisional"))


def select_history(points: DataFrame, since: str | None = None, until: str | None = None, concept: str | None = None, limit: int = 50) -> DataFrame:
    """Points (at, sha, concepts) within inclusive bounds, newest first."""
    out = points.filter(S.within("at", since, until))
    if concept:
        out = out.filter(F.array_contains("concepts", concept))
    return out.orderBy(F.desc("at"), "sha").limit(max(0, limit))
