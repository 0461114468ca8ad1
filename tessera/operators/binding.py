"""Joins from facts to edges: imports, calls, injection, tests, tables, mentions, environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.lineage import kept, materialise, shuffled
from tessera.model import file_part

#: Lines of a bucket for range joins.
BUCKET_LINES = 256
#: Uses of tables that one task counts, about.
USES_A_TASK = 1 << 19
SOURCE_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".json")
#: Endings of a specifier that can stand for a TypeScript file.
JS_ENDINGS = (".js", ".jsx", ".mjs", ".mjsx", ".cjs", ".cjsx")


# --- ranges and ancestors --------------------------------------------------------------------


def innermost(points: DataFrame, spans: DataFrame, key: str = "file") -> DataFrame:
    """Points (key, line) with the smallest span (key, id, start_line, end_line) that holds them, ties to the smaller id.

    Spans are dealt into buckets of lines, so a large file is not compared with all its lines;
    of spans with the same lines only the smallest id takes part.
    """
    spans = spans.groupBy(key, "start_line", "end_line").agg(F.min("id").alias("id"))
    bucket = F.floor(F.col("line") / BUCKET_LINES)
    wide = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET_LINES), F.floor(F.col("end_line") / BUCKET_LINES))))
    near = shuffled(points.select(key, "line").distinct()).withColumn("bucket", bucket).join(wide, [key, "bucket"]).filter("line between start_line and end_line")
    best = near.groupBy(key, "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), F.col("id"))).alias("best"))
    return shuffled(points).join(best.select(key, "line", F.col("best.id").alias("symbol")), [key, "line"], "left")


def directories(path: Column) -> Column:
    """All directories above a path, the root as an empty text."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def nearest(nodes: DataFrame, up: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, nearest): the closest marked ancestor-or-self; up: id, ancestor, depth."""
    hit = up.join(marked.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    best = hit.groupBy("id").agg(F.min(F.struct("depth", "ancestor")).alias("best"))
    return nodes.select("id").join(best, "id").select("id", F.col("best.ancestor").alias("nearest"))


# --- imports ---------------------------------------------------------------------------------


def normalise_path(path: Column) -> Column:
    """A path without ``.`` and ``..``; null if it leaves the root."""
    out = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array(F.lit("\0"))),
    )
    return F.when(~F.exists(out, lambda s: s == "\0"), F.array_join(out, "/"))


def _beside(folder: str, spec: str) -> Column:
    """The normalised path of a relative specifier; ups before plain segments, as most are, need no lists."""
    plain = r"[^./][^/]*(?:/[^./][^/]*)*$"
    ups, depth = F.length(F.regexp_extract(spec, r"^((?:\.\./)*)", 1)) / 3, F.size(F.split(folder, "/"))
    rest = F.regexp_replace(spec, r"^(?:(?:\.\./)+|\./)", "")
    above = F.expr(f"substring_index({folder}, '/', cast(size(split({folder}, '/')) - length(regexp_extract({spec}, '^((?:[.][.]/)*)', 1)) / 3 as int))")
    whole = normalise_path(F.concat_ws("/", folder, spec))
    simple = F.col(folder).rlike("^" + plain) & F.col(spec).rlike(r"^(?:(?:\.\./)+|\./)" + plain)
    return F.when(~simple, whole).when(ups == depth, rest).when(ups < depth, F.concat(above, F.lit("/"), rest))


def _meant(path: Column) -> Column:
    """(stem, place) of the module paths that can mean a file; of the files that a stem means the least place is the best."""
    out = [F.struct(path.alias("stem"), F.lit(0).alias("place"))]

    def ending(end: str, place: int, *after: str) -> None:
        stem = F.substring(path, F.lit(1), F.length(path) - len(end))
        out.extend(F.when(F.endswith(path, F.lit(end)), F.struct(F.concat(stem, F.lit(x)).alias("stem"), F.lit(place).alias("place"))) for x in after or ("",))

    for k, e in enumerate((".ts", ".tsx")):
        ending(e, 1 + k, *JS_ENDINGS)
    for k, e in enumerate(SOURCE_ENDINGS):
        ending(e, 3 + k)
    for k, e in enumerate(SOURCE_ENDINGS[:4]):
        ending("/index" + e, 11 + k)
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(src, spec, dst): the file that each specifier means.

    imports: src, path, spec; files: id, path; aliases: prefix, target and, where they do not
    hold everywhere, root (of those whose root is above the importer the longest prefix wins,
    then the deepest root).
    Relative ones start at the importer's directory; bare ones go through aliases; dotted
    Python modules are tried from every directory above the importer. Files are listed under
    each stem that can mean them, so a specifier meets its file by one equality.
    """
    imports = materialise(imports.select("src", "path", "spec"), "asked")
    rows = imports.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    relative = F.col("spec").startswith("./") | F.col("spec").startswith("../") | F.col("spec").isin(".", "..")
    meant = files.select(F.col("id").alias("dst"), F.inline(_meant(F.col("path")))).groupBy("stem").agg(F.min(F.struct("place", "dst")).alias("best"))
    a = shuffled(rows.filter(relative & F.col("dir").isNotNull()).select("src", "spec", _beside("dir", "spec").alias("stem")))
    a = a.join(meant, "stem").select("src", "spec", F.col("best.dst").alias("dst"))
    rows = rows.filter(~relative)
    asked = rows.select("dir", "spec").distinct()
    dots = F.length(F.regexp_extract("spec", r"^(\.+)", 1))
    module = F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")
    python = asked.filter(F.col("spec").rlike(r"^\.*[A-Za-z_][\w.]*$"))
    base = F.reverse(directories(F.concat("dir", F.lit("/x"))))
    starts = F.when(dots > 0, F.slice(base, F.greatest(dots, F.lit(1)), 1)).otherwise(base)
    stems = F.flatten(F.transform(starts, lambda d: F.array(F.ltrim(F.concat(d, F.lit("/"), module, F.lit(".py")), F.lit("/")), F.ltrim(F.concat(d, F.lit("/"), module, F.lit("/__init__.py")), F.lit("/")))))
    b = python.select("dir", "spec", F.posexplode(stems).alias("place", "path")).withColumn("place", F.col("place") + 1000)
    out = b.join(files.select(F.col("id").alias("dst"), "path"), "path").select("dir", "spec", "place", "dst")
    if aliases is not None:
        aliases = aliases if "root" in aliases.columns else aliases.withColumn("root", F.lit(""))
        # Every beginning of a specifier, so that prefixes meet by equality.
        begins = F.transform(F.sequence(F.lit(0), F.length("spec")), lambda k: F.substring("spec", 1, k))
        hit = asked.withColumn("prefix", F.explode(begins)).join(aliases, "prefix")
        hit = hit.filter((F.col("root") == "") | (F.col("dir") == F.col("root")) | F.col("dir").startswith(F.concat("root", F.lit("/"))))
        hit = hit.groupBy("dir", "spec").agg(F.max(F.struct(F.length("prefix").alias("n"), F.length("root").alias("r"), "prefix", "target")).alias("best"))
        hit = hit.select("dir", "spec", "best.prefix", "best.target")
        stem = normalise_path(F.concat("target", F.expr("substring(spec, length(prefix) + 1)")))
        out = out.unionByName(hit.select("dir", "spec", stem.alias("stem")).join(meant, "stem").select("dir", "spec", (F.col("best.place") + 500).alias("place"), "best.dst"))
    known = out.groupBy("dir", "spec").agg(F.min(F.struct("place", "dst")).alias("best"))
    return a.unionByName(rows.join(known.select("dir", "spec", F.col("best.dst").alias("dst")), ["dir", "spec"]).select("src", "spec", "dst"))


def follow_reexports(asked: DataFrame, reexports: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """(file, name, target, local): where a name that a file exports is defined.

    asked: file, name; reexports: file, name (``*`` for all), target, local, and place where
    the order of statements is known (else targets are tried by name); exports: file, name of
    what files define themselves. A name ends at the first file that exports it: a named
    re-export is followed alone, else every star in turn, as deep as it goes. Names found
    nowhere have no row. Without ``exports`` a file that passes a name on to no other counts as
    the one that defines it.
    """
    state = ["file", "name", "target", "local"]
    place = F.col("place").cast("long") if "place" in reexports.columns else F.lit(0).cast("long")
    step = reexports.select(F.col("file").alias("target"), F.col("name").alias("key"), F.col("target").alias("next"), F.coalesce("local", "name").alias("as"), place.alias("place"))
    front = asked.filter("file is not null and name is not null").select("file", "name", F.col("file").alias("target"), F.col("name").alias("local"), F.array().cast("array<string>").alias("path")).distinct()
    known, ends = None, None
    while True:
        front = materialise(front, "reexports")
        if front.isEmpty():
            break
        known = front if known is None else materialise(known.unionByName(front).groupBy(*state).agg(F.min("path").alias("path")), "known")
        on = (front["target"] == step["target"]) & ((step["key"] == front["local"]) | ((step["key"] == "*") & (front["local"] != "default")))
        whole = F.col("local") == "*"
        if exports is None:
            end = front.join(step, on, "left_anti").unionByName(front.filter(whole)).distinct()
        else:
            own = exports.select(F.col("file").alias("target"), F.col("name").alias("local"))
            end = front.filter(~whole).join(own, ["target", "local"], "left_semi").select(*front.columns).unionByName(front.filter(whole))
        end = materialise(end, "ends")
        ends = end if ends is None else ends.unionByName(end)
        rows = front.join(step, on).select("file", "name", front["target"].alias("target"), "local", "path", "key", "next", "as", "place").join(end.select(*state), state, "left_anti")
        star = F.col("key") == "*"
        rows = rows.withColumn("named", F.max(~star).over(Window.partitionBy(*state))).filter("next is not null").filter(star != F.col("named"))
        local = F.when(star, F.col("local")).otherwise(F.col("as"))
        rows = rows.select("file", "name", F.col("next").alias("target"), local.alias("local"), F.concat("path", F.array(F.format_string("%020d\0%s\0%s", "place", "next", local))).alias("path"))
        # A place that is reached again goes on only if by a way that is tried earlier; a circle never is.
        before = known.select(*state, F.col("path").alias("before"))
        front = rows.groupBy(*state).agg(F.min("path").alias("path")).join(before, state, "left").filter("before is null or path < before").drop("before")
    if ends is None:
        return front.select(*state)
    return ends.groupBy("file", "name").agg(F.min(F.struct("path", "target", "local")).alias("best")).select("file", "name", "best.target", "best.local")


def import_edges(resolved: DataFrame, names: DataFrame) -> DataFrame:
    """Edges from statements (src, spec, dst, type_only) and resolved names (src, spec, target).

    Names that resolve decide; the module itself counts only when none does, and a module
    that was only passed through gets a ``references`` edge. weight is the number of statements.
    """
    named = resolved.join(names, ["src", "spec"]).select("src", "spec", F.col("target").alias("to"), "dst", "type_only")
    alone = resolved.join(names.select("src", "spec").distinct(), ["src", "spec"], "left_anti").select("src", "spec", F.col("dst").alias("to"), "dst", "type_only")
    rows = named.unionByName(alone)
    edges = rows.select("src", "to", "spec", "type_only").distinct().groupBy("src", F.col("to").alias("dst")).agg(F.count(F.lit(1)).cast("int").alias("weight"), F.bool_and("type_only").alias("type_only"))
    out = edges.select("src", "dst", F.lit("imports").alias("kind"), "weight", F.to_json(F.struct("type_only")).alias("attrs"))
    passed = rows.filter("to <> dst").select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return out.unionByName(passed.select("src", "dst", F.lit("references").alias("kind"), F.lit(1).alias("weight"), F.lit("{}").alias("attrs")))


# --- calls ------------------------------------------------------------------------------------


def bind_calls(calls: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and ``ambiguous_call`` diagnostics of calls (src, shape, scope, name).

    targets: scope, name, id, display_kind: what a name means in a file, class or module.
    One candidate makes an edge (0.6 through ``this``, at most 0.7 for a mere reference, which
    may only mean a function, method or component); several make a diagnostic.
    """
    rows = calls.join(targets, ["scope", "name"]).filter((F.col("shape") != "reference") | F.col("display_kind").isin("function", "method", "component"))
    each = rows.groupBy("src", "shape", "scope", "name").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.count(F.lit(1)).alias("n"))
    sure = F.when(F.col("shape") == "this", 0.6).when(F.col("shape") == "reference", 0.7).otherwise(1.0)
    one = each.filter(F.size("ids") == 1).select("src", F.col("ids")[0].alias("dst"), sure.alias("confidence"))
    edges = one.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).cast("int").alias("weight")).withColumn("kind", F.lit("calls"))
    many = each.filter(F.size("ids") > 1).select(F.col("src").alias("node_id"), F.lit("ambiguous_call").alias("kind"), F.concat("name", F.lit(": "), F.array_join("ids", ", ")).alias("detail"))
    return edges, many


def bind_injected(needs: DataFrame, typed: DataFrame, methods: DataFrame, built: DataFrame) -> DataFrame:
    """``calls`` edges through injected fields: (src, dst, confidence), the surest of each pair.

    needs: src, field, method (what is called on a field); typed: field, type (a known class);
    methods: type, method, id; built: field, type (an argument that constructors get). A
    constructor argument counts 0.7, a known type 0.6; a field without either takes every class
    that has all methods called on it, 0.4 shared among them.
    """
    direct = needs.join(typed, "field").join(methods, ["type", "method"]).select("src", F.col("id").alias("dst"), F.lit(0.6).alias("confidence"))
    given = needs.join(built, "field").join(methods, ["type", "method"]).select("src", F.col("id").alias("dst"), F.lit(0.7).alias("confidence"))
    rest = needs.join(typed.select("field").union(built.select("field")).distinct(), "field", "left_anti")
    wanted = rest.select("field", "method").distinct()
    size = wanted.groupBy("field").agg(F.count(F.lit(1)).alias("wanted"))
    fits = wanted.join(methods.select("type", "method").distinct(), "method").groupBy("field", "type").agg(F.count(F.lit(1)).alias("has")).join(size, "field").filter("has = wanted")
    n = fits.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    shaped = rest.join(fits.select("field", "type"), "field").join(n, "field").join(methods, ["type", "method"]).select("src", F.col("id").alias("dst"), (F.lit(0.4) / F.col("n")).alias("confidence"))
    return direct.unionByName(given).unionByName(shaped).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def csharp_imports(usings: DataFrame, declares: DataFrame, mentions: DataFrame) -> DataFrame:
    """Imports between C# files: usings (src, namespace) of declared types that the file mentions (1.0), other mentions 0.4.

    declares: file, namespace, type; mentions: src, type.
    """
    named = mentions.join(declares, "type").filter("src <> file")
    sure = named.join(usings, ["src", "namespace"], "left_semi").select("src", F.col("file").alias("dst")).distinct().withColumn("confidence", F.lit(1.0))
    once = declares.groupBy("type").agg(F.countDistinct("file").alias("n"), F.min("file").alias("dst")).filter("n = 1").select("type", "dst")
    weak = mentions.join(once, "type").filter("src <> dst").select("src", "dst").distinct().join(sure.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("confidence", F.lit(0.4))
    return sure.unionByName(weak)


# --- tests -----------------------------------------------------------------------------------

#: How sure each kind of link from a test is.
TEST_CONFIDENCE = {"call": 1.0, "this-call": 0.6, "import": 0.5, "naming": 0.8, "read": 1.0, "patch": 0.8, "launch": 1.0, "client": 0.9, "glob": 0.8, "subprocess": 0.8, "fixture": 1.0}


def link_tests(links: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tests`` edges from links (src, dst, how), and diagnostics of test files without any; tests: id, file, exempt."""
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in TEST_CONFIDENCE.items() for x in kv]), F.col("how"))
    edges = links.withColumn("confidence", sure).withColumn("source", F.when(F.col("how") == "naming", "naming").otherwise("treesitter"))
    edges = edges.groupBy("src", "dst", "source").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).cast("int").alias("weight")).withColumn("kind", F.lit("tests"))
    linked = edges.select(file_part("src").alias("file")).distinct()
    bare = tests.filter("not exempt").select("file").distinct().join(linked, "file", "left_anti")
    return edges, bare.select(F.col("file").alias("node_id"), F.lit("unmatched_test").alias("kind"), F.lit("no link to code").alias("detail"))


def inherit_helpers(edges: DataFrame, helpers: DataFrame) -> DataFrame:
    """Tests also test what the helpers they call (src, helper) are linked to, one level deep."""
    more = helpers.join(edges.select(F.col("src").alias("helper"), "dst", "confidence"), "helper").select("src", "dst", "confidence")
    return edges.select("src", "dst", "confidence").unionByName(more).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def fixture_closure(requests: DataFrame) -> DataFrame:
    """All fixtures that each test needs, from (src, fixture) of tests and fixtures."""
    from tessera.operators.graph import reach

    seeds = requests.select(F.col("src").alias("seed"), F.col("src").alias("id")).distinct()
    return reach(seeds, requests.select("src", F.col("fixture").alias("dst"))).filter("depth > 0").select(F.col("seed").alias("src"), F.col("id").alias("fixture"))


def match_results(results: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (rid, name, chain) matched to test nodes (id, name, chain), and diagnostics of the others.

    Tiers: the chain of names ends the result's chain; a bare name that occurs once; a name with
    ``${...}`` or ``%s`` holes as a pattern. Ties go to the smallest id, so only that one of the
    cases of a chain or name travels, and each distinct (name, chain) of results is matched once.
    """
    asked = results.select("name", "chain").distinct()
    # Every end of a chain, so that chains meet by equality.
    parts = F.split("chain", " > ")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), " > "))
    tails = cases.groupBy(F.col("chain").alias("tail")).agg(F.min("id").alias("id"))
    a = asked.select("name", "chain", F.explode(ends).alias("tail")).join(tails, "tail").select("name", "chain", "id", F.lit(1).alias("tier"), (-F.length("tail")).alias("o"))
    names = cases.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    b = asked.join(names.filter("n = 1").select("name", "id"), "name").select("name", "chain", "id", F.lit(2).alias("tier"), F.lit(0).alias("o"))
    holes = names.filter(F.col("name").rlike(r"\$\{|%[sdifjop#]"))
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"\$\{[^}]*\}|%[sdifjop#]", "\0"), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), "\0", ".*"), F.lit("$"))
    # A name meets the patterns that begin like it, up to their first hole.
    begin = F.regexp_extract("name", r"^(.*?)(?:\$\{|%[sdifjop#])", 1)
    begins = F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring("name", 1, k))
    c = asked.select("name", "chain", F.col("name").alias("got"), F.explode(begins).alias("begin")).join(holes.select("id", begin.alias("begin"), pattern.alias("pattern"), F.length("name").alias("len")), "begin").filter(F.expr("got rlike pattern")).select("name", "chain", "id", F.lit(3).alias("tier"), (-F.col("len")).alias("o"))
    best = a.unionByName(b).unionByName(c).groupBy(F.col("name").alias("best_name"), F.col("chain").alias("best_chain")).agg(F.min(F.struct("tier", "o", "id")).alias("best"))
    on = F.col("name").eqNullSafe(F.col("best_name")) & F.col("chain").eqNullSafe(F.col("best_chain"))
    results = shuffled(results)
    hit = results.join(best, on).withColumn("test_node_id", F.col("best.id")).drop("best", "best_name", "best_chain")
    miss = results.join(best, on, "left_anti").select(F.lit(None).cast("string").alias("node_id"), F.lit("unmapped_coverage").alias("kind"), F.col("name").alias("detail"))
    return hit, miss


# --- tables, mentions, environment, paths ------------------------------------------------------------


def use_tables(uses: DataFrame, tables: DataFrame) -> DataFrame:
    """reads_table / writes_table edges of uses (src, verb, name, line); tables: id, name, aliases.

    A name means a table by its name, its aliases (models), or its singular or plural form; the first
    in order of id wins. A schema's tables are few and each is used in many places, so they go to
    all tasks; uses are dealt by src before they are counted, ``USES_A_TASK`` to a task.
    """
    forms = F.array_distinct(F.concat(F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower), F.array(F.concat(F.lower("name"), F.lit("s")), F.regexp_replace(F.lower("name"), "s$", ""))))
    alias = tables.select("id", F.posexplode(forms).alias("place", "key")).groupBy("key").agg(F.min(F.struct("place", "id")).alias("best")).select("key", F.col("best.id").alias("dst"))
    uses, many = kept(uses.select("src", "verb", "name", "line"), "uses")
    uses = uses.repartition(1 + many // USES_A_TASK, "src")
    rows = uses.withColumn("key", F.lower(F.element_at(F.split("name", r"\."), -1))).join(F.broadcast(alias), "key")
    kind = F.when(F.upper("verb").isin("FROM", "JOIN", "SELECT", "READ"), "reads_table").otherwise("writes_table")
    return rows.groupBy("src", "dst", kind.alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("weight"), F.to_json(F.struct(F.sort_array(F.collect_set("line")).alias("locations"))).alias("attrs")).withColumn("source", F.lit("data"))


def mentions(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """``mentions`` edges of documents (src, text): by path 1.0, by a name that is unique 0.8."""
    paths = nodes.filter("path is not null and kind in ('file', 'doc', 'group')").select(F.col("id").alias("dst"), F.rtrim(F.col("path"), F.lit("/")).alias("key"))
    names = nodes.filter("kind = 'symbol'").select(F.col("id").alias("dst"), F.element_at(F.split("id", "#"), -1).alias("key"))
    names = names.unionByName(nodes.filter("kind = 'symbol'").select(F.col("id").alias("dst"), F.col("name").alias("key"))).distinct()
    once = names.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("dst", "key")
    key = F.regexp_replace(F.regexp_replace("text", r"(\(\))$", ""), r"^\./|/$|#.*$", "")
    rows = references.withColumn("key", key)
    out = rows.join(paths, "key").select("src", "dst", F.lit(1.0).alias("confidence")).unionByName(rows.join(once, "key").select("src", "dst", F.lit(0.8).alias("confidence")))
    return out.filter("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).withColumns({"kind": F.lit("mentions"), "source": F.lit("markdown")})


def read_env(reads: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ``reads_env`` edges and passthrough diagnostics of reads (src, name, default, place).

    declared: name. weight is the number of reads, the default the first that is stated; a
    name ``*`` passes the whole environment on.
    """
    own = reads.filter("name <> '*'")
    env = F.concat(F.lit("env:"), F.col("name"))
    first = F.min_by("default", F.when(F.col("default").isNotNull(), F.col("place")))
    edges = own.groupBy("src", "name").agg(F.count(F.lit(1)).cast("int").alias("weight"), first.alias("default"))
    edges = edges.select("src", env.alias("dst"), F.lit("reads_env").alias("kind"), "weight", F.to_json(F.struct("default")).alias("attrs"))
    nodes = own.select("name").union(declared.select("name")).distinct().select(env.alias("id"), F.lit("env").alias("kind"), "name")
    passed = reads.filter("name = '*'").select(F.col("src").alias("node_id"), F.lit("env_passthrough").alias("kind"), F.lit("the whole environment is passed on").alias("detail")).distinct()
    return nodes, edges, passed


def read_targets(reads: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): the file that a literal path (src, path, value) means.

    The reader's directory comes first; then, without leading ``../``, each directory above it.
    """
    value = F.regexp_replace("value", r"^(\.\./)+", "")
    up = F.reverse(directories(F.col("path")))
    here = F.array(normalise_path(F.concat_ws("/", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.col("value"))))
    rows = reads.select("src", "value", F.posexplode(F.concat(here, F.transform(up, lambda d: F.ltrim(F.concat(d, F.lit("/"), value), F.lit("/"))))).alias("place", "file"))
    hit = rows.join(files.select(F.col("path").alias("file"), F.col("id").alias("dst")), "file")
    return hit.groupBy("src", "value").agg(F.min(F.struct("place", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst")).distinct()


def html_references(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``references`` edges from pages (id, path, html) to scripts and styles of the repository."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)<(?:script|link|img)\b[^>]*?\b(?:src|href)\s*=\s*[\"']([^\"'#?]+)"), 1)
    rows = pages.select("id", "path", F.explode(found).alias("to")).filter(~F.col("to").rlike("^(?i)[a-z][a-z0-9+.-]*:|^//"))
    target = F.when(F.col("to").startswith("/"), F.ltrim(F.col("to"), F.lit("/"))).otherwise(normalise_path(F.concat_ws("/", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.col("to"))))
    return rows.withColumn("file", target).join(files.select(F.col("path").alias("file"), F.col("id").alias("dst")), "file").select(F.col("id").alias("src"), "dst", F.lit("references").alias("kind"), F.lit("html").alias("source")).distinct()


def containers_of(files: DataFrame, part_of: DataFrame, kinds: DataFrame) -> DataFrame:
    """(file, container): the smallest deployable, else the smallest package, else the folder, else the file."""
    rows = part_of.join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("container_kind")), "dst")
    each = rows.groupBy(F.col("src").alias("id")).agg(F.min(F.when(F.col("container_kind") == "deployable", F.col("dst"))).alias("d"), F.min(F.when(F.col("container_kind") == "package", F.col("dst"))).alias("p"))
    return files.join(each, "id", "left").select(F.col("id").alias("file"), F.coalesce("d", "p", "parent_id", "id").alias("container"))


def area_of(files: DataFrame, packages: DataFrame, deployables: DataFrame) -> DataFrame:
    """(id, area): the deepest package (id, path), else the first deployable (file, deployable), else ``other``."""
    rows = files.select("id", F.explode(directories(F.col("path"))).alias("dir")).join(packages.select(F.col("id").alias("package"), F.rtrim(F.col("path"), F.lit("/")).alias("dir")), "dir")
    deep = rows.groupBy("id").agg(F.max_by("package", F.length("dir")).alias("package"))
    first = deployables.groupBy(F.col("file").alias("id")).agg(F.min("deployable").alias("deployable"))
    return files.select("id").join(deep, "id", "left").join(first, "id", "left").select("id", F.coalesce("package", "deployable", F.lit("other")).alias("area"))


def disambiguate(symbols: DataFrame) -> DataFrame:
    """Ids of symbols (file, qualname, signature, place): repeated names get a hash of their signature, repeated signatures a number."""
    name = Window.partitionBy("file", "qualname")
    twin = Window.partitionBy("file", "qualname", "signature").orderBy("place")
    base = F.concat("file", F.lit("#"), "qualname")
    mark = F.concat(base, F.lit("~"), F.substring(F.sha1(F.coalesce("signature", F.lit(""))), 1, 8))
    rows = symbols.withColumns({"n": F.count(F.lit(1)).over(name), "k": F.row_number().over(twin)})
    out = F.when(F.col("n") == 1, base).when((F.col("k") == 1), mark).otherwise(F.concat(mark, F.lit("~"), F.col("k").cast("string")))
    return rows.withColumn("id", out).drop("n", "k")


def containment(files: DataFrame) -> DataFrame:
    """Group nodes of every directory above files (workspace_id, path), with their parents."""
    rows = files.select("workspace_id", F.explode(directories(F.col("path"))).alias("path")).filter("path <> ''").distinct()
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    at = lambda p: F.concat("workspace_id", F.lit(":"), p, F.lit("/"))
    return rows.select(at(F.col("path")).alias("id"), F.when(parent == "", F.col("workspace_id")).otherwise(at(parent)).alias("parent_id"), F.lit("group").alias("kind"), F.lit("folder").alias("display_kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "workspace_id", "path")


def next_route(path: Column) -> Column:
    """The route of an ``app/**/route.*`` file: groups and slots dropped, ``[x]`` as ``{x}``."""
    inner = F.regexp_extract(path, r"(?:^|/)app/(.*)route\.[a-z]+$", 1)
    parts = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    named = F.transform(parts, lambda s: F.regexp_replace(s, r"^\[{1,2}(?:\.\.\.)?([^\]]+)\]{1,2}$", "{$1}"))
    return F.when(path.rlike(r"(^|/)app/(.*/)?route\.[a-z]+$"), F.concat(F.lit("/"), F.array_join(named, "/")))
