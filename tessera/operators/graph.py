"""Graph operators: hotspots, dependency matrix, orphans, reachability, cycles, ancestry."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.lineage import kept, shuffled
from tessera.model import Model, file_part, role

METRICS = ("fan_in", "fan_out", "loc", "symbols", "test_files")
#: Characters of a cycle's text at most.
DETAIL_CHARS = 500


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows in order; a negative limit or offset gives none."""
    if limit < 0 or offset < 0:
        return df.limit(0)
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


# --- containers ---------------------------------------------------------------------------


def members(model: Model, level: str) -> DataFrame:
    """(container, file): which files a container has; files may have several at level ``deployable``.

    Folders hold what is under their path, packages and deployables what is ``part_of`` them,
    concepts what they own directly.
    """
    files = model.files().select("id", "path", "workspace_id", "parent_id")
    if level == "file":
        return files.select(F.col("id").alias("container"), F.col("id").alias("file"))
    if level == "folder":
        up = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k - 1), "/")), lambda p: p != "")
        dirs = files.select("workspace_id", F.col("id").alias("file"), F.explode(up).alias("path"))
        groups = model.kind("group").select("workspace_id", F.col("id").alias("container"), F.rtrim(F.col("path"), F.lit("/")).alias("path"))
        return dirs.join(groups, ["workspace_id", "path"]).select("container", "file")
    if level == "concept":
        owns = model.links("owns")
        return owns.select(F.col("src").alias("container"), F.col("dst").alias("file"))
    if level in ("package", "deployable"):
        ends = model.kind(level).select(F.col("id").alias("dst"))
        return model.links("part_of").join(ends, "dst", "left_semi").select(F.col("dst").alias("container"), F.col("src").alias("file"))
    raise ValueError(f"unknown level: {level}")


def one_container(bridge: DataFrame) -> DataFrame:
    """One container per file, the largest id where there are several."""
    return bridge.groupBy("file").agg(F.max("container").alias("container")).select("container", "file")


def hotspots(model: Model, level: str = "file") -> DataFrame:
    """One row per container with production code: id, name, path and the metrics.

    fan_in counts import rows into the container from outside, fan_out the reverse.
    """
    files = model.files().select(F.col("id").alias("file"), "role", F.coalesce("loc", F.lit(0)).alias("loc"))
    bridge = members(model, level)
    imports = model.links("imports").select("src", "dst")
    known = files.select(F.col("file").alias("dst"))
    imports = imports.join(known, "dst", "left_semi").join(known.withColumnRenamed("dst", "src"), "src", "left_semi").select("src", "dst")
    into = bridge.withColumnRenamed("file", "dst").join(imports, "dst")
    inner = into.join(bridge.withColumnRenamed("file", "src"), ["container", "src"], "left_semi").groupBy("container").agg(F.count(F.lit(1)).alias("inner"))
    fan_in = into.groupBy("container").agg(F.count(F.lit(1)).alias("in"))
    fan_out = bridge.withColumnRenamed("file", "src").join(imports, "src").groupBy("container").agg(F.count(F.lit(1)).alias("out"))
    symbols = model.kind("symbol").select(file_part("id").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("symbols"))
    sizes = (
        bridge.join(files, "file")
        .join(symbols, "file", "left")
        .groupBy("container")
        .agg(
            F.sum(F.when(F.col("role").isin("code", "test"), F.col("loc")).otherwise(0)).alias("loc"),
            F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"),
            F.count_if(F.col("role") == "test").alias("test_files"),
            F.count_if(F.col("role") == "code").alias("code"),
        )
        .filter("code > 0")
    )
    rest = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col("inner"), F.lit(0))
    names = model.nodes.select(F.col("id").alias("container"), "name", "path")
    out = sizes.join(fan_in, "container", "left").join(fan_out, "container", "left").join(inner, "container", "left")
    return out.withColumns({"fan_in": rest("in"), "fan_out": rest("out")}).join(names, "container").select(F.col("container").alias("id"), "name", "path", *METRICS)


def top_hotspots(model: Model, metric: str, level: str = "file", limit: int = 20, offset: int = 0) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return page(hotspots(model, level), [F.desc(metric), F.coalesce("path", F.lit("")), F.col("id")], limit, offset)


# --- dependencies ----------------------------------------------------------------------------


def production_imports(model: Model, tests: bool = False) -> DataFrame:
    """Import rows between files (src, dst); without ``tests`` both ends are production code."""
    files = model.files()
    files = files if tests else files.filter("role = 'code'")
    ids = shuffled(files.select(F.col("id").alias("dst")))
    edges = model.links("imports").select("src", "dst")
    return edges.join(ids, "dst", "left_semi").join(ids.withColumnRenamed("dst", "src"), "src", "left_semi").select("src", "dst")


def dependency_matrix(model: Model, level: str = "package", tests: bool = False, at_most: int | None = None) -> DataFrame:
    """Cells (from_id, to_id, imports, files): import rows between containers, with the importing files.

    ``at_most`` keeps that many files a cell, in order; the count is of all.
    """
    bridge = members(model, level)
    if level in ("package", "concept"):
        bridge = one_container(bridge)
    left = bridge.select(F.col("container").alias("from_id"), F.col("file").alias("src"))
    right = bridge.select(F.col("container").alias("to_id"), F.col("file").alias("dst"))
    cells = production_imports(model, tests).join(left, "src").join(right, "dst").groupBy("from_id", "to_id")
    out = cells.agg(F.count(F.lit(1)).alias("imports"), F.sort_array(F.collect_set(F.concat("src", F.lit(" -> "), "dst"))).alias("files"))
    return out if at_most is None else out.withColumn("files", F.slice("files", 1, at_most))


def parse_forbid(spec: str) -> tuple[str, str]:
    """Both ends of ``FROM->TO`` or ``FROM:TO``."""
    for mark in ("->", ":"):
        a, found, b = spec.partition(mark)
        if found and a.strip() and b.strip():
            return a.strip(), b.strip()
    raise ValueError(f"not FROM->TO: {spec!r}")


def forbidden(model: Model, spec: str, level: str = "package") -> DataFrame:
    """Production imports from one container into another; no row means the rule holds."""
    a, b = parse_forbid(spec)
    bridge = members(model, level)
    nodes = model.nodes.select("id", "name")
    ends = []
    for ref in (a, b):
        hits = [r[0] for r in nodes.join(bridge.select(F.col("container").alias("id")).distinct(), "id", "left_semi").filter((F.col("id") == ref) | (F.col("name") == ref)).select("id").orderBy("id").take(2)]
        if len(hits) != 1:
            raise LookupError(f"{ref!r} names {'no' if not hits else 'more than one'} {level}")
        ends.append(hits[0])
    src = bridge.filter(F.col("container") == ends[0]).select(F.col("file").alias("src")).distinct()
    dst = bridge.filter(F.col("container") == ends[1]).select(F.col("file").alias("dst")).distinct()
    return production_imports(model).join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst").distinct()


def library_directories(model: Model) -> DataFrame:
    """Top-level directories (top) whose production files are imported by production files outside."""
    top = model.files().filter("role = 'code'").select(F.col("id"), F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).alias("top"))
    edges = production_imports(model).join(top.select(F.col("id").alias("dst"), F.col("top").alias("into")), "dst").join(top.select(F.col("id").alias("src"), F.col("top").alias("from")), "src")
    return edges.filter("into is not null and not (into <=> from)").select(F.col("into").alias("top")).distinct()


# --- fixpoints --------------------------------------------------------------------------------


def reach(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(seed, id, depth): what each seed reaches over (src, dst), itself at depth 0; least depths.

    Each round joins only the rows that the round before found. Lists of seeds advance together.
    """
    edges, _ = kept(edges.select("src", "dst").distinct(), "edges")
    found, _ = kept(seeds.select("seed", "id", F.lit(0).alias("depth")).distinct(), "seen")
    front, depth = found, 0
    while max_rounds is None or depth < max_rounds:
        depth += 1
        step = front.join(edges, front["id"] == edges["src"]).select("seed", F.col("dst").alias("id")).distinct()
        front, more = kept(step.join(shuffled(found), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if not more:
            break
        found = found.unionByName(front)
        if depth % 8 == 0:
            found, _ = kept(found, "seen")
    return shuffled(found)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs joined by a path of one edge or more, by doubling."""
    pairs, size = kept(edges.select("src", "dst").distinct(), "pairs")
    while True:
        further = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        pairs, now = kept(pairs.union(further).distinct(), "pairs")
        if now == size:
            return pairs
        size = now


def bounded_bfs(model: Model, seeds: DataFrame, kind: str = "calls", hops: int = 4) -> DataFrame:
    """Least depth at which each seed (id) reaches a node within ``hops``."""
    start = seeds.select(F.col("id").alias("seed"), "id")
    return reach(start, model.links(kind), hops)


def _trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (level, src, dst) left when nodes without an incoming or an outgoing edge are gone, again and again, and their number."""
    edges, size = kept(edges.select("level", "src", "dst").distinct(), "trim")
    while size:
        tails = edges.select("level", F.col("src").alias("dst")).distinct()
        heads = edges.select("level", F.col("dst").alias("src")).distinct()
        edges, now = kept(edges.join(tails, ["level", "dst"], "left_semi").join(heads, ["level", "src"], "left_semi").select("level", "src", "dst"), "trim")
        if now == size:
            break
        size = now
    return edges, size


def components(edges: DataFrame) -> DataFrame:
    """(level, id, scc): strongly connected components with a cycle; scc is their smallest member.

    Edges (level, src, dst) are trimmed first; then, round by round, colours spread forward to
    a fixpoint and each colour's root collects backward what has its colour, so no component is ever
    gathered in one task.
    """
    left, size = _trim(edges)
    loops, _ = kept(edges.filter("src = dst").select("level", F.col("src").alias("id"), F.col("src").alias("scc")).distinct(), "loops")
    done: DataFrame | None = None
    while size:
        nodes = left.select("level", F.col("src").alias("id")).union(left.select("level", F.col("dst").alias("id"))).distinct()
        colour, changed = kept(nodes.withColumn("colour", F.col("id")), "colour")
        while changed:
            new = left.join(colour.withColumnsRenamed({"id": "src"}), ["level", "src"]).select("level", F.col("dst").alias("id"), F.col("colour").alias("other"))
            new = new.groupBy("level", "id").agg(F.min("other").alias("other"))
            both, changed = kept(colour.join(new, ["level", "id"], "left").withColumn("next", F.least("colour", F.coalesce("other", "colour"))), "colour", "next < colour")
            colour = both.select("level", "id", F.col("next").alias("colour"))
        same = left.join(colour.withColumnsRenamed({"id": "src", "colour": "cs"}), ["level", "src"]).join(colour.withColumnsRenamed({"id": "dst", "colour": "cd"}), ["level", "dst"])
        same, _ = kept(same.filter("cs = cd").select("level", "src", "dst", F.col("cs").alias("colour")), "same")
        back = reach(
            colour.filter("id = colour").select(F.concat_ws("\0", "level", "colour").alias("seed"), F.concat_ws("\0", "level", "id").alias("id")),
            same.select(F.concat_ws("\0", "level", "dst").alias("src"), F.concat_ws("\0", "level", "src").alias("dst")),
        )
        part = lambda c, k: F.element_at(F.split(F.col(c), "\0"), k)
        one, _ = kept(back.select(part("id", 1).alias("level"), part("id", 2).alias("id"), part("seed", 2).alias("scc")).distinct(), "scc")
        done = one if done is None else done.unionByName(one)
        gone = one.select("level", "id")
        left = left.join(gone.withColumnRenamed("id", "src"), ["level", "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), ["level", "dst"], "left_anti")
        left, size = _trim(left)
    if done is None:
        return loops
    size = Window.partitionBy("level", "scc")
    done = done.withColumn("n", F.count(F.lit(1)).over(size)).filter("n > 1").drop("n")
    return done.unionByName(loops.join(shuffled(done), ["level", "id"], "left_anti"))


def cycle_edges(model: Model) -> DataFrame:
    """Edges between code files, their immediate folders, and their packages: (level, src, dst)."""
    edges = production_imports(model).distinct()
    parents = model.files().select(F.col("id").alias("file"), F.col("parent_id").alias("container")).join(model.kind("group").select(F.col("id").alias("container")), "container", "left_semi")
    edges, _ = kept(edges, "production")
    out = edges.select(F.lit("file").alias("level"), "src", "dst")
    for level, bridge in (("folder", parents), ("package", members(model, "package"))):
        a = shuffled(bridge.select(F.col("file").alias("src"), F.col("container").alias("a")))
        b = shuffled(bridge.select(F.col("file").alias("dst"), F.col("container").alias("b")))
        out = out.union(edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.lit(level), "a", "b").distinct())
    return out


def cycles(model: Model) -> DataFrame:
    """One row per cycle: level, scc, size, length and text of a shortest cycle through its first member by (name, id).

    Of the shortest ones the cycle whose members come first in that order, step by step.
    """
    edges, _ = kept(cycle_edges(model), "cycle-edges")
    comps, _ = kept(components(edges), "components")
    names = model.nodes.select("id", F.coalesce("name", "id").alias("name")).join(comps.select("id").distinct(), "id", "left_semi")
    return shortest_cycles(edges, comps, kept(names, "names")[0])


def shortest_cycles(edges: DataFrame, comps: DataFrame, names: DataFrame) -> DataFrame:
    """(level, scc, size, length, detail) of components (level, id, scc) of edges (level, src, dst); names: id, name.

    Distances from the first member and back to it come from breadth-first searches as joins;
    then all components walk along nodes whose two distances add up, a step a round.
    """
    comps, names = shuffled(comps), shuffled(names)
    member = comps.join(names, "id").select("level", "scc", F.struct("name", "id").alias("node"), "id")
    ends = lambda side: comps.select("level", "scc", F.col("id").alias(side))
    inner = edges.join(ends("src"), ["level", "src"]).join(ends("dst"), ["level", "scc", "dst"])
    key = F.concat_ws("\0", "level", "scc")
    inner, _ = kept(inner.select(key.alias("comp"), "src", "dst").distinct(), "inner")
    starts, _ = kept(member.groupBy("level", "scc", key.alias("comp")).agg(F.min("node").alias("start"), F.count(F.lit(1)).alias("size")), "starts")
    near = lambda to, back: _distances(starts.select("comp", F.col("start.id").alias("id")), inner.select("comp", F.col(to).alias("src"), F.col(back).alias("dst")))
    out, back = near("src", "dst"), near("dst", "src")
    # A cycle's length: a step out, and the way back from there.
    on = inner.join(out.select("comp", F.col("id").alias("src"), F.col("depth").alias("far")), ["comp", "src"]).join(back.select("comp", F.col("id").alias("dst"), F.col("depth").alias("left")), ["comp", "dst"])
    length = on.filter("far = 0").groupBy("comp").agg((F.min("left") + 1).alias("length"))
    on = on.join(shuffled(length), "comp").filter("far + left + 1 = length").join(names.withColumnsRenamed({"id": "dst", "name": "next"}), "dst")
    on, _ = kept(on.select("comp", "src", "far", F.struct(F.col("next").alias("name"), F.col("dst").alias("id")).alias("next")), "ways")
    paths = starts.join(length, "comp").select("*", F.col("start.id").alias("at"), F.array("start.name").alias("path"), F.lit(0).alias("far"))
    (paths, going), steps = kept(paths, "paths", "length > 0"), 0
    while going:
        step = paths.join(on.withColumnRenamed("src", "at"), ["comp", "at", "far"]).groupBy("comp").agg(F.min("next").alias("next"))
        grown = paths.join(step, "comp", "left")
        steps += 1
        paths, going = kept(grown.withColumns({"at": F.coalesce("next.id", "at"), "path": F.when(F.col("next").isNotNull(), F.concat("path", F.array("next.name"))).otherwise(F.col("path")), "far": F.col("far") + 1}).drop("next"), "paths", f"length > {steps}")
    return paths.select("level", "scc", "size", F.col("length").cast("int").alias("length"), F.substring(F.array_join("path", " → "), 1, DETAIL_CHARS).alias("detail"))


def _distances(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(comp, id, depth) from starts (comp, id) over edges (comp, src, dst)."""
    at = lambda c: F.concat_ws("\0", "comp", c)
    found = reach(starts.select(F.col("comp").alias("seed"), at("id").alias("id")), edges.select(at("src").alias("src"), at("dst").alias("dst")))
    return found.select(F.col("seed").alias("comp"), F.element_at(F.split("id", "\0"), -1).alias("id"), "depth")


def cycle_diagnostics(found: DataFrame, comps: DataFrame) -> DataFrame:
    """A diagnostic for each member of a cycle."""
    return comps.join(found, ["level", "scc"]).select(F.col("id").alias("node_id"), F.lit("cycle").alias("kind"), F.concat("level", F.lit(": "), "detail").alias("detail"))


# --- orphans ----------------------------------------------------------------------------------


def entries(model: Model) -> DataFrame:
    """Files (id) that deployables, HTML pages or a framework start."""
    flags = F.coalesce(F.get_json_object("attrs", "$.entry"), F.lit("false")).isin("true", "1")
    framework = F.coalesce(F.get_json_object("attrs", "$.framework_root"), F.lit("false")).isin("true", "1")
    named = model.kind("deployable").select(F.explode(F.from_json(F.coalesce(F.get_json_object("attrs", "$.entry_points"), F.lit("[]")), "array<string>")).alias("id"))
    return model.files().filter(flags | framework).select("id").union(named).distinct()


def unreferenced(model: Model) -> DataFrame:
    """Production files that no other production file imports, calls or references, entries aside."""
    code = model.files().filter("role = 'code'").select("id")
    own = lambda kind: model.links(kind).select(file_part("src").alias("a"), file_part("dst").alias("b"))
    used = own("imports").union(own("calls")).filter("a <> b").join(code.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    used = used.union(own("references").filter("a <> b").select(F.col("b").alias("id"))).union(entries(model)).distinct()
    return code.join(used, "id", "left_anti")


def test_only(model: Model) -> DataFrame:
    """Exported symbols whose callers are all in test files."""
    kind = model.files().select(F.col("id").alias("file"), "role")
    calls = model.links("calls").select(file_part("src").alias("file"), "dst").join(kind, "file")
    only = calls.groupBy("dst").agg(F.bool_and(F.col("role") == "test").alias("tests"), F.count(F.lit(1)).alias("callers")).filter("tests").select(F.col("dst").alias("id"), "callers")
    exported = F.coalesce(F.get_json_object("attrs", "$.exported"), F.lit("true")) != "false"
    symbols = model.kind("symbol").filter(exported).withColumn("file", file_part("id")).join(kind.filter("role = 'code'"), "file", "left_semi")
    return symbols.select("id", "name", "path").join(only, "id")


def initialisers(model: Model) -> DataFrame:
    """(src, dst): Python files, and the ``__init__.py`` files of the packages above them, which run first."""
    python = model.files().filter("path like '%.py'").select("id", "workspace_id", "path")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k - 1), "/"))
    init = python.filter("path like '%/__init__.py'").select(F.col("id").alias("dst"), "workspace_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
    rows = python.select(F.col("id").alias("src"), "workspace_id", F.explode(above).alias("folder")).join(init, ["workspace_id", "folder"])
    return rows.filter("src <> dst").select("src", "dst")


def reachable(model: Model) -> DataFrame:
    """Files that entries reach over imports, references and the initialisers of Python packages."""
    steps = model.links("imports", "references").select(file_part("src").alias("src"), file_part("dst").alias("dst")).filter("src <> dst")
    steps = steps.union(initialisers(model))
    code = model.files().select(F.col("id").alias("src"), "role")
    outside = steps.join(shuffled(code.filter("role <> 'code'")), "src", "left_semi").join(shuffled(model.links("references").select(file_part("dst").alias("dst")).distinct()), "dst", "left_semi").select(F.col("dst").alias("id"))
    seeds = entries(model).union(outside).distinct().select(F.lit("entries").alias("seed"), "id")
    return reach(seeds, steps).select("id")


def unreachable(model: Model) -> DataFrame:
    """Production files that no entry reaches; none if the model has no entry."""
    code = model.files().filter("role = 'code'").select("id")
    start = entries(model)
    if start.isEmpty():
        return code.limit(0)
    return code.join(shuffled(reachable(model)), "id", "left_anti").join(shuffled(start), "id", "left_anti")


def untested(model: Model, level: str = "package") -> DataFrame:
    """Containers with production code and no test file: id and the outside tests linked into them."""
    bridge = members(model, level)
    kind = model.files().select(F.col("id").alias("file"), "role")
    counts = bridge.join(kind, "file").groupBy("container").agg(F.count_if(F.col("role") == "code").alias("code"), F.count_if(F.col("role") == "test").alias("tests"))
    bare = counts.filter("code > 0 and tests = 0").select("container")
    links = model.links("tests").select("src", file_part("dst").alias("file")).join(bridge, "file").groupBy("container").agg(F.countDistinct("src").alias("outside_tests"))
    return bare.join(links, "container", "left").select(F.col("container").alias("id"), F.coalesce("outside_tests", F.lit(0)).alias("outside_tests"))


# --- ancestry ---------------------------------------------------------------------------------


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) over parent_id, each node its own ancestor at depth 0; cycles end."""
    seeds = nodes.select(F.col("id").alias("seed"), "id")
    parents = nodes.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    return reach(seeds, parents).select(F.col("seed").alias("id"), F.col("id").alias("ancestor"), "depth")


def parent_chain_tested(model: Model) -> DataFrame:
    """Symbols that a test covers directly, through an ancestor, or through their file."""
    tested = model.links("tests").select(F.col("dst").alias("ancestor")).distinct()
    up = ancestors(model.nodes.select("id", "parent_id"))
    symbols = model.kind("symbol").select("id")
    chain = up.join(tested, "ancestor", "left_semi").select("id").distinct()
    own = symbols.withColumn("ancestor", file_part("id")).join(tested, "ancestor", "left_semi").select("id")
    return symbols.join(chain.union(own).distinct(), "id", "left_semi")


def deployable_closure(model: Model) -> DataFrame:
    """(src, dst, via): ``part_of`` of deployables, direct or over imports."""
    direct = members(model, "deployable").select(F.col("container").alias("seed"), F.col("file").alias("id"))
    all_ = reach(direct, model.links("imports"))
    return all_.select(F.col("id").alias("src"), F.col("seed").alias("dst"), F.when(F.col("depth") == 0, "direct").otherwise("transitive").alias("via"))


def package_dependencies(model: Model) -> DataFrame:
    """``depends_on`` between packages that follow from imports across them."""
    cells = dependency_matrix(model, "package", tests=True)
    return cells.filter("from_id <> to_id").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def render_graph(model: Model) -> DataFrame:
    """Pairs of components where one renders the other: (src, dst, weight)."""
    jsx = F.get_json_object("attrs", "$.via") == "jsx"
    return model.links("calls").filter(jsx).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rendered_from(model: Model, roots: DataFrame) -> DataFrame:
    """Components that roots (id) render, directly or not."""
    return reach(roots.select(F.col("id").alias("seed"), "id"), render_graph(model))
