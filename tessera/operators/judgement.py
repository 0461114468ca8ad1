"""Concepts, tasks, answers and the check gate."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.lineage import materialise, shuffled
from tessera.model import Model

CONCEPT_SCHEMA = "id string, parent_id string, name string, kind string, files array<string>, ordinal int"
MOST_CHILDREN = 9


# --- concepts --------------------------------------------------------------------------------


def flatten_concepts(spark: SparkSession, document: dict) -> tuple[DataFrame, DataFrame]:
    """Concepts and relationships of a concept document (nested ``concepts`` and ``relationships``)."""
    rows: list[tuple] = []

    def walk(items: list[dict], parent: str | None) -> None:
        for k, c in enumerate(items):
            cid = c.get("id") or f"{parent or 'concept'}.{c['name'].lower()}"
            rows.append((cid, parent, c.get("name", cid), c.get("kind", "concept"), list(c.get("files", [])), k))
            walk(c.get("concepts", []), cid)

    walk(document.get("concepts", []), None)
    links = [(r["from"], r["to"], r.get("label", ""), r.get("via"), r.get("at"), k) for k, r in enumerate(document.get("relationships", []))]
    return spark.createDataFrame(rows, CONCEPT_SCHEMA), spark.createDataFrame(links, "src string, dst string, label string, via string, at string, ordinal int")


def project_concepts(concepts: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and ``owns`` and ``relates`` edges; repeated pairs get ordinals."""
    nodes = concepts.select("id", "parent_id", F.lit("concept").alias("kind"), F.col("kind").alias("display_kind"), "name")
    owns = concepts.select(F.col("id").alias("src"), F.explode("files").alias("dst"), F.lit("owns").alias("kind"), F.lit("agent").alias("source"), F.lit(0).alias("ordinal"), F.lit("{}").alias("attrs"))
    place = F.row_number().over(Window.partitionBy("src", "dst").orderBy("ordinal")) - 1
    relates = relationships.select("src", "dst", F.lit("relates").alias("kind"), F.lit("agent").alias("source"), place.alias("ordinal"), F.to_json(F.struct("label", "via", "at")).alias("attrs"))
    return nodes, owns.unionByName(relates)


def validate_concepts(concepts: DataFrame, relationships: DataFrame, files: DataFrame, volume: DataFrame, up: DataFrame) -> DataFrame:
    """Violations (rule, subject, detail); no row means the map is sound.

    files: id (production files); volume: src, dst (production imports and calls between files);
    up: id, ancestor of concepts. A pair of files of different concepts must be covered by a
    relationship between the concepts or ancestors of them.
    """
    out = lambda df, rule, subject, detail: df.select(F.lit(rule).alias("rule"), subject.alias("subject"), detail.alias("detail"))
    owned = concepts.select("id", F.explode("files").alias("file"))
    n = owned.groupBy("file").agg(F.countDistinct("id").alias("n"), F.array_join(F.sort_array(F.collect_set("id")), ", ").alias("who"))
    parents = concepts.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    twice = concepts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = concepts.select("id").distinct()
    ends = relationships.select(F.col("src").alias("id")).union(relationships.select("dst")).distinct()
    wide = concepts.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_CHILDREN)
    owner = owned.select("file", F.col("id").alias("concept"))
    a = volume.join(owner.select(F.col("file").alias("src"), F.col("concept").alias("a")), "src").join(owner.select(F.col("file").alias("dst"), F.col("concept").alias("b")), "dst").filter("a <> b").select("a", "b").distinct()
    told = relationships.select("src", "dst").distinct()
    covered = up.select(F.col("id").alias("a"), F.col("ancestor").alias("src")).join(told, "src").join(up.select(F.col("id").alias("b"), F.col("ancestor").alias("dst")), "dst").select("a", "b").distinct()
    parts = [
        out(files.join(owned.select(F.col("file").alias("id")), "id", "left_anti"), "unowned", F.col("id"), F.lit("no concept owns it")),
        out(n.filter("n > 1"), "owned-twice", F.col("file"), F.col("who")),
        out(owned.join(parents, "id", "left_semi").select("id").distinct(), "not-a-leaf", F.col("id"), F.lit("only leaves own files")),
        out(owned.join(files.select(F.col("id").alias("file")), "file", "left_anti"), "gone", F.col("file"), F.col("id")),
        out(twice, "id-twice", F.col("id"), F.col("n").cast("string")),
        out(ends.join(known, "id", "left_anti"), "unknown-end", F.col("id"), F.lit("a relationship names it")),
        out(relationships.filter("via is not null and at is null"), "integration-without-place", F.concat("src", F.lit(" -> "), "dst"), F.col("via")),
        out(a.join(covered, ["a", "b"], "left_anti"), "uncovered", F.concat("a", F.lit(" -> "), "b"), F.lit("code depends without a relationship")),
        out(wide, "many-children", F.coalesce("parent_id", F.lit("(top)")), F.col("n").cast("string")),
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def concept_work(files: DataFrame, owned: DataFrame, accepted: DataFrame) -> DataFrame:
    """What to look at again: unowned, changed since accepted, or gone files. files: id, content_hash; accepted: id, content_hash."""
    a = files.join(owned.select(F.col("file").alias("id")), "id", "left_anti").select("id", F.lit("unowned").alias("why"))
    b = files.alias("f").join(accepted.alias("a"), "id").filter(~F.col("f.content_hash").eqNullSafe(F.col("a.content_hash"))).select("id", F.lit("changed").alias("why"))
    c = owned.select(F.col("file").alias("id")).distinct().join(files, "id", "left_anti").select("id", F.lit("gone").alias("why"))
    return a.unionByName(b).unionByName(c)


def list_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    files = edges.filter("kind = 'owns'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    ends = edges.filter("kind = 'relates'").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("relationships"))
    return nodes.filter("kind = 'concept'").select("id", "parent_id", "name").join(files, "id", "left").join(ends, "id", "left").na.fill(0, ["files", "relationships"])


def stated_evidence(imports: DataFrame, calls: DataFrame, owner: DataFrame) -> DataFrame:
    """Pairs of concepts that only type imports or injected calls join."""
    soft_import = F.coalesce(F.get_json_object("attrs", "$.type_only"), F.lit("false")) == "true"
    soft_call = F.coalesce(F.get_json_object("attrs", "$.via"), F.lit("")) == "injection"
    rows = imports.select("src", "dst", soft_import.alias("soft")).unionByName(calls.select(F.substring_index("src", "#", 1).alias("src"), F.substring_index("dst", "#", 1).alias("dst"), soft_call.alias("soft")))
    both = rows.join(owner.select(F.col("file").alias("src"), F.col("concept").alias("a")), "src").join(owner.select(F.col("file").alias("dst"), F.col("concept").alias("b")), "dst").filter("a <> b")
    return both.groupBy("a", "b").agg(F.bool_and("soft").alias("soft"), F.count(F.lit(1)).alias("n")).filter("soft").drop("soft")


def override(structure: DataFrame, overrides: DataFrame) -> DataFrame:
    """Deployables and packages (id, kind, name) with overrides (id, action, kind, name): add, rename, remove."""
    both = structure.alias("s").join(overrides.alias("o"), "id", "full_outer").filter(F.coalesce(F.col("o.action"), F.lit("")) != "remove")
    return both.filter(F.col("s.kind").isNotNull() | (F.col("o.action") == "add")).select("id", F.coalesce("o.kind", "s.kind").alias("kind"), F.coalesce("o.name", "s.name").alias("name"))


def expand_screens(spark: SparkSession, screens: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Screen nodes, and ``sketches`` edges to the components of their region trees, weighted by how often they stand there."""
    rows, uses = [], []

    def walk(screen: str, region: dict) -> None:
        if region.get("component"):
            uses.append((screen, region["component"]))
        for part in region.get("regions", []):
            walk(screen, part)

    for s in screens:
        sid = f"screen:{s['id']}"
        rows.append((sid, "screen", s.get("name", s["id"]), s.get("route")))
        for region in s.get("regions", []):
            walk(sid, region)
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, path string")
    edges = spark.createDataFrame(uses, "src string, name string").groupBy("src", "name").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    return nodes, edges


def screen_references(uses: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sketches`` edges of names that mean one component, and diagnostics of the others."""
    n = components.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst"))
    rows = uses.join(n, "name", "left")
    good = rows.filter("n = 1").select("src", "dst", F.lit("sketches").alias("kind"), F.lit("agent").alias("source"), "weight")
    why = F.when(F.col("n").isNull(), "unknown component ").otherwise("ambiguous component ")
    return good, rows.filter("n is null or n > 1").select(F.col("src").alias("node_id"), F.lit("screens_invalid").alias("kind"), F.concat(why, "name").alias("detail"))


# --- tasks ------------------------------------------------------------------------------------


def refresh_tasks(tree: DataFrame, answers: DataFrame) -> DataFrame:
    """States of summary tasks, from the leaves up: done, open, or blocked by a child.

    tree: id, parent_id, name, kind, content_hash; answers: input_hash, summary. The hash of a
    node covers the names, kinds and summaries of its children and its own content, never an
    id or a path, so an answer serves every equal place. Rounds end at the root, however deep
    the tree is; nodes on a circle of parents have no leaf below and no row.
    """
    nodes = materialise(tree.select("id", "parent_id", "name", "kind", F.coalesce("content_hash", F.lit("")).alias("content_hash")), "tree")
    inner = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    known = None
    level = nodes.join(inner, "id", "left_anti").withColumn("inputs", F.lit(""))
    level = level.withColumn("ready", F.lit(True))
    rest = nodes.join(inner, "id", "left_semi")
    while True:
        hashed = level.withColumn("input_hash", F.sha1(F.concat_ws("\0", "kind", "name", "content_hash", "inputs")))
        done = hashed.join(answers, "input_hash", "left")
        state = F.when(~F.col("ready"), "blocked").when(F.col("summary").isNotNull(), "done").otherwise("open")
        step = materialise(done.select("id", "parent_id", "name", "kind", "input_hash", state.alias("state"), "summary"), "tasks")
        known = step if known is None else known.unionByName(step)
        if rest.isEmpty():
            break
        kids = known.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(
            F.count(F.lit(1)).alias("have"), F.bool_and(F.col("state") == "done").alias("ready"),
            F.to_json(F.array_sort(F.collect_list(F.struct("name", "kind", "summary")))).alias("inputs"),
        )
        want = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("want"))
        level = rest.join(kids, "id").join(want, "id").filter("have = want").drop("have", "want")
        level = materialise(level.select("id", "parent_id", "name", "kind", "content_hash", "inputs", "ready"), "level")
        if level.isEmpty():
            break
        rest = rest.join(level.select("id"), "id", "left_anti")
    return known


#: What a schema subset can ask of a value.
_KINDS = {"string": str, "object": dict, "array": list, "integer": int, "number": (int, float), "boolean": bool}


def schema_errors(value, rule: dict, at: str = "$") -> list[str]:
    """Where a JSON value breaks a schema (type, enum, required, properties, items, lengths)."""
    kind = _KINDS.get(rule.get("type", ""))
    if kind and (not isinstance(value, kind) or isinstance(value, bool) and rule["type"] in ("integer", "number")):
        return [f"{at}: not of type {rule['type']}"]
    out = []
    if "enum" in rule and value not in rule["enum"]:
        out.append(f"{at}: not one of {rule['enum']}")
    if isinstance(value, str):
        if len(value) < rule.get("minLength", 0) or len(value) > rule.get("maxLength", 1 << 60):
            out.append(f"{at}: length {len(value)}")
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in rule.get("required", []) if k not in value]
        known = rule.get("properties", {})
        if rule.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in value if k not in known]
        for k, r in known.items():
            if k in value:
                out += schema_errors(value[k], r, f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < rule.get("minItems", 0) or len(value) > rule.get("maxItems", 1 << 60):
            out.append(f"{at}: {len(value)} items")
        for i, x in enumerate(value):
            out += schema_errors(x, rule.get("items", {}), f"{at}[{i}]")
    return out


def submit(task: dict, answer: str, rule: dict, input_hash: str) -> dict:
    """A task with its answer; ValueError if it is stale, no JSON, or breaks the schema."""
    if task["input_hash"] != input_hash:
        raise ValueError("the task's inputs changed")
    value = json.loads(answer)
    errors = schema_errors(value, rule)
    if errors:
        raise ValueError("; ".join(errors))
    return task | {"state": "done", "answer": value}


def uncited(summaries: DataFrame) -> DataFrame:
    """Summaries (id, citations, evidence) that cite what is not evidence."""
    return summaries.withColumn("unknown", F.array_except("citations", "evidence")).filter(F.size("unknown") > 0)


def pack_parts(items: DataFrame, budget: int) -> DataFrame:
    """Greedy chunks of items (area, id, bytes) in order of id, each within ``budget`` bytes; larger items stand alone."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        part, used, out = 0, 0, []
        for size in frame["bytes"]:
            if used and used + size > budget:
                part, used = part + 1, 0
            used += size
            out.append(part)
        return frame.assign(part=out)

    return items.select("area", "id", "bytes").groupBy("area").applyInPandas(pack, "area string, id string, bytes long, part int")


def open_pairs(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of files (src, dst) that no chunk (area, part, id) holds together.

    Each pair meets the chunks of its first file, and those the second: never two files of a chunk that are no pair.
    """
    p = parts.select("area", "part", "id")
    a, b = shuffled(p.withColumnRenamed("id", "src")), shuffled(p.withColumnRenamed("id", "dst"))
    held = pairs.select("src", "dst").join(a, "src").join(b, ["area", "part", "dst"], "left_semi").select("src", "dst")
    return pairs.join(shuffled(held), ["src", "dst"], "left_anti")


# --- answers ------------------------------------------------------------------------------------


def causal_merge(answers: DataFrame) -> DataFrame:
    """Live answers per (kind, key): accepted ids less retired ones; rows may come in any order.

    answers: kind, key, acceptance, retires (array), generation, answer. One live id is
    accepted, several are a conflict, none is superseded; rows without an acceptance go by
    the highest generation.
    """
    causal = answers.filter("acceptance is not null")
    each = causal.groupBy("kind", "key").agg(F.collect_set("acceptance").alias("ids"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("retires", F.array().cast("array<string>"))))).alias("gone"), F.max("generation").alias("generation"))
    each = each.withColumn("live", F.sort_array(F.array_except("ids", "gone")))
    state = F.when(F.size("live") == 1, "accepted").when(F.size("live") > 1, "conflict").otherwise("superseded")
    text = causal.groupBy("kind", "key", F.col("acceptance").alias("one")).agg(F.min("answer").alias("answer"))
    new = each.withColumn("state", state).withColumn("one", F.when(F.size("live") == 1, F.col("live")[0])).join(text, ["kind", "key", "one"], "left").select("kind", "key", "state", "live", "generation", "answer")
    old = answers.filter("acceptance is null").join(each.select("kind", "key"), ["kind", "key"], "left_anti")
    old = old.groupBy("kind", "key").agg(F.max(F.struct("generation", "answer")).alias("x")).select("kind", "key", F.lit("accepted").alias("state"), F.array().cast("array<string>").alias("live"), F.col("x.generation").alias("generation"), F.col("x.answer").alias("answer"))
    return new.unionByName(old)


#: Older names of kinds and fields in concept documents.
KIND_NAMES = {"os": "terminal"}


def canonical_concepts(document: dict) -> dict:
    """A concept document with today's names of kinds and of the mechanism of a relationship."""

    def concept(c: dict) -> dict:
        out = {k: v for k, v in c.items() if k != "concepts"} | {"kind": KIND_NAMES.get(c.get("kind", "concept"), c.get("kind", "concept"))}
        return out | ({"concepts": [concept(x) for x in c["concepts"]]} if c.get("concepts") else {})

    links = [{("via" if k == "mechanism" else k): v for k, v in r.items()} for r in document.get("relationships", [])]
    return document | {"concepts": [concept(c) for c in document.get("concepts", [])], "relationships": links}


def merge_structure(rows: DataFrame) -> DataFrame:
    """One row per (kind, name) of structure answers from several workspaces: the owner's own comes first."""
    own = Window.partitionBy("kind", "name").orderBy(F.desc(F.col("workspace_id") == F.col("owner")), "workspace_id")
    return rows.withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")


def portable_id(node_id: Column, workspace: Column) -> Column:
    """An id that does not name its workspace, so caches can be shared."""
    return F.when(node_id.startswith(F.concat(workspace, F.lit(":"))), F.concat(F.lit("@"), F.expr("substring(id, length(workspace_id) + 1)"))).otherwise(node_id)


# --- check ------------------------------------------------------------------------------------

FINDING = ("kind", "path", "message", "title", "line")


def _finding(df: DataFrame, kind: str, path: Column, message: Column, title: str, line: Column | None = None) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), path.alias("path"), message.alias("message"), F.lit(title).alias("title"), (line if line is not None else F.lit(None)).cast("int").alias("line"))


def check(changed: DataFrame, files: DataFrame, summaries: DataFrame, owned: DataFrame, texts: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Findings about changed files (path); no row passes.

    files: path, content_hash; summaries: path, content_hash, text; owned: path; texts: path, line, text.
    Kinds: summary (none yet), stale (of another content), owner (no concept), secret.
    """
    now = files.join(changed, "path", "left_semi")
    none = now.join(summaries, "path", "left_anti")
    stale = now.alias("f").join(summaries.alias("s"), "path").filter(F.col("f.content_hash") != F.col("s.content_hash"))
    out = _finding(none, "summary", F.col("path"), F.lit("has no summary"), "Summary missing")
    out = out.unionByName(_finding(stale, "stale", F.col("path"), F.lit("its summary is of older content"), "Summary out of date"))
    out = out.unionByName(_finding(now.join(owned, "path", "left_anti"), "owner", F.col("path"), F.lit("no concept owns it"), "Owner missing"))
    secret = texts.join(changed, "path", "left_semi").withColumn("what", S.secret_kind("text")).filter("what is not null")
    out = out.unionByName(_finding(secret, "secret", F.col("path"), F.concat(F.lit("looks like a "), "what"), "Secret", F.col("line")))
    for pattern in ignored or []:
        out = out.filter(~F.col("path").rlike(S.glob_regex(pattern)))
    return out


def exit_code(findings: DataFrame) -> int:
    return int(not findings.isEmpty())


def projection_drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that stand only in the stored or only in the derived projection."""
    columns = derived.columns
    return stored.select(columns).exceptAll(derived).withColumn("side", F.lit("stored")).unionByName(derived.exceptAll(stored.select(columns)).withColumn("side", F.lit("derived")))


def context_block(model: Model, node_id: str, lines: int = 60) -> str:
    """A short Markdown text about one node and what is next to it."""
    from tessera.operators.lookups import show, top_edges

    parts = show(model, node_id)
    n = parts["node"].first()
    out = [f"# {n['name']} ({n['display_kind']})", f"`{n['id']}`"]
    if n["summary"] or n["doc"]:
        out.append(str(n["summary"] or n["doc"]).strip().splitlines()[0])
    for r in parts["children"].limit(lines).collect():
        out.append(f"- {r['display_kind']} {r['name']}")
    for r in top_edges(model, n["id"]).orderBy("direction", "kind", "place").limit(lines).collect():
        out.append(f"- {r['direction']} {r['kind']}: {r['other_name'] or r['other']}")
    for r in parts["diagnostics"].limit(5).collect():
        out.append(f"- {r['kind']}: {r['detail']}")
    return "\n".join(out[:lines])
