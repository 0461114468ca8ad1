"""Edge families of a scan beyond direct imports and calls: re-exports, injection, fixtures, patches, launches, client routes, rendering.

All are joins of facts (``file``, ``src``, ``name``, ``value``, ``extra``, ``line``, and ``owner``, the node a fact
belongs to) with symbols and resolved imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import binding as B
from tessera.operators import http as H

VERB_NAMES = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def aliases(files: DataFrame) -> DataFrame:
    """(root, prefix, target) of the ``paths`` and ``baseUrl`` of tsconfig files (path, text); root is the folder they hold for."""
    some = files.filter(F.col("path").rlike(r"(^|/)(ts|js)config[^/]*\.json$"))
    options = F.from_json(S.jsonc("text"), "compilerOptions struct<baseUrl:string, paths:map<string, array<string>>>")
    rows = some.select(F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1).alias("root"), options.alias("o")).filter("o.compilerOptions is not null")
    base = B.normalise_path(F.concat_ws("/", "root", F.coalesce("o.compilerOptions.baseUrl", F.lit("."))))
    rows = rows.select("root", base.alias("base"), F.col("o.compilerOptions.baseUrl").alias("stated"), F.col("o.compilerOptions.paths").alias("paths"))
    star = lambda c: F.regexp_replace(c, r"\*.*$", "")
    named = rows.select("root", "base", F.explode("paths").alias("prefix", "to")).select("root", star(F.col("prefix")).alias("prefix"), F.concat_ws("/", F.nullif("base", F.lit("")), star(F.col("to")[0])).alias("target"))
    plain = rows.filter("stated is not null").select("root", F.lit("").alias("prefix"), F.when(F.col("base") == "", "").otherwise(F.concat("base", F.lit("/"))).alias("target"))
    return named.unionByName(plain).distinct()


def reexports(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Re-exports as ``binding.follow_reexports`` takes them, from facts and resolved specifiers."""
    rows = facts.join(found.select(F.col("src").alias("file"), F.col("spec").alias("name"), F.col("dst").alias("target")), ["file", "name"])
    return rows.select("file", F.col("value").alias("name"), "target", F.col("extra").alias("local"), F.col("line").alias("place"))


def named_imports(deep: DataFrame, found: DataFrame, passed_on: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, of, value, dst, target, local): where each imported name (src, of, value, extra) is defined, over re-exports."""
    at = deep.join(found.select("src", F.col("spec").alias("of"), "dst"), ["src", "of"]).select("src", "of", "value", "extra", "dst")
    own = symbols.filter("parent is null").select("file", "name").distinct()
    asked = at.select(F.col("dst").alias("file"), F.col("extra").alias("name")).join(passed_on.select("file").distinct(), "file", "left_semi").distinct()
    ends = B.follow_reexports(asked, passed_on, own)
    rows = at.join(ends.select(F.col("file").alias("dst"), F.col("name").alias("extra"), F.col("target").alias("to"), "local"), ["dst", "extra"], "left")
    return rows.select("src", "of", "value", "dst", F.coalesce("to", "dst").alias("target"), F.coalesce("local", "extra").alias("local"))


def injected_calls(calls: DataFrame, fields: DataFrame, symbols: DataFrame, scope: DataFrame) -> DataFrame:
    """``calls`` edges through fields of classes: what is called on a field that is set in a constructor or stated with a type.

    calls: facts of calls; fields: facts of fields; scope: scope (file), name, id of names that files know.
    """
    cls = F.concat("file", F.lit("#"), F.substring_index("src", ".", 1))
    on = F.regexp_extract("value", r"^(?:self\.|this\.)?([\w$]+)\.[\w$]+$", 1)
    needs = calls.filter("extra in ('this', 'member')").select(F.col("owner").alias("src"), F.concat(cls, F.lit("."), on).alias("field"), F.col("name").alias("method"))
    said = fields.select("file", F.concat(cls, F.lit("."), F.col("name")).alias("field"), F.element_at(F.split(F.regexp_replace("value", r"[<\[|].*$|\s", ""), r"\."), -1).alias("name")).distinct()
    classes = symbols.filter("display_kind in ('class', 'interface', 'record', 'struct')").select("id", "name", "file")
    near = scope.select(F.col("scope").alias("file"), "name", F.col("id").alias("near"))
    once = classes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).filter("n = 1").select("name", "only")
    typed = said.join(near.join(classes.select(F.col("id").alias("near")), "near", "left_semi"), ["file", "name"], "left").join(once, "name", "left")
    typed = typed.select("field", F.coalesce("near", "only").alias("type"))
    known = typed.filter("type is not null").distinct()
    methods = symbols.filter("display_kind = 'method'").select(F.col("parent_id").alias("type"), F.col("name").alias("method"), "id")
    asked = needs.join(typed.select("field").distinct(), "field", "left_semi")
    none = known.limit(0)
    out = B.bind_injected(asked, known, methods, none)
    return out.filter("src <> dst").select("src", "dst", F.lit("calls").alias("kind"), "confidence", F.lit('{"via":"injection"}').alias("attrs"))


def csharp_edges(facts, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` between C# files, by their usings and the types they name. facts: kind -> facts."""
    sharp = files.filter("lang = 'csharp'").select("file")
    spaces = facts("namespace").select("file", F.col("name").alias("namespace")).distinct()
    types = symbols.filter("parent is null and display_kind in ('class', 'interface', 'record', 'struct', 'enum')").join(sharp, "file", "left_semi")
    declares = types.join(spaces, "file").select("file", "namespace", F.col("name").alias("type")).distinct()
    usings = facts("using").select(F.col("file").alias("src"), F.col("name").alias("namespace"))
    usings = usings.union(spaces.select("file", "namespace")).distinct()  # a file sees its own namespace
    plain = lambda c: F.regexp_replace(c, r"[<\[?].*$", "")
    named = facts("construct").select("file", F.col("name").alias("type")).union(facts("field").select("file", plain(F.col("value")))).union(facts("call").filter("extra = 'member'").select("file", F.substring_index("value", ".", 1)))
    mentions = named.join(sharp, "file", "left_semi").select(F.col("file").alias("src"), "type").distinct()
    return B.csharp_imports(usings, declares, mentions).select("src", "dst", F.lit("imports").alias("kind"), "confidence")


def fixture_links(asked: DataFrame, symbols: DataFrame, files: DataFrame, calls: DataFrame, code: DataFrame) -> DataFrame:
    """Links of tests to what the fixtures they ask for call. asked: facts of parameters; files: file, path; calls: src, dst."""
    folder = lambda p: F.regexp_extract(p, r"^(?:(.*)/)?[^/]*$", 1)
    fixtures = symbols.filter("display_kind = 'fixture'").join(files.select("file", "path"), "file")
    own = fixtures.select(F.col("file").alias("at"), "name", "id", F.lit(0).alias("far"))
    shared = fixtures.filter(F.col("path").rlike(r"(^|/)conftest\.py$")).select(folder("path").alias("at"), "name", "id")
    rows = asked.select("owner", "file", "name").join(files.select("file", "path"), "file")
    up = B.directories(F.col("path"))
    by_folder = rows.select("owner", "name", F.posexplode(F.reverse(up)).alias("far", "at")).join(shared, ["at", "name"]).select("owner", "name", "id", (F.col("far") + 1).alias("far"))
    here = rows.select("owner", "name", F.col("file").alias("at")).join(own, ["at", "name"]).select("owner", "name", "id", "far")
    best = here.unionByName(by_folder).filter("owner <> id").groupBy("owner", "name").agg(F.min(F.struct("far", "id")).alias("best"))
    needs = B.fixture_closure(best.select(F.col("owner").alias("src"), F.col("best.id").alias("fixture")))
    tests = symbols.filter("kind = 'test'").select(F.col("id").alias("src"))
    reached = needs.join(tests, "src", "left_semi").join(calls.select(F.col("src").alias("fixture"), "dst"), "fixture")
    return reached.join(code.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit("fixture").alias("how"))


def patch_links(patches: DataFrame, files: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """Links of tests to the symbols (else files) that dotted names of patches mean."""
    parts = F.split("name", r"\.")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("spec"), F.array_join(F.slice(parts, k + 1, F.size(parts)), ".").alias("rest"), k.alias("k")))
    rows = patches.filter(F.col("name").rlike(r"^[A-Za-z_][\w.]*$")).join(files.select("file", "path"), "file").select("owner", "name", "path", F.inline(cut))
    found = B.resolve_imports(rows.select(F.col("owner").alias("src"), "path", "spec").distinct(), targets).withColumnRenamed("src", "owner")
    at = rows.join(found, ["owner", "spec"])
    exact = symbols.select(F.col("file").alias("dst"), F.col("qualname").alias("rest"), "id")
    hit = at.join(exact, ["dst", "rest"], "left").withColumn("to", F.when(F.col("rest") == "", F.col("dst")).otherwise(F.col("id"))).filter("to is not null")
    best = hit.groupBy("owner", "name").agg(F.max(F.struct("k", "to")).alias("best"))
    return best.select(F.col("owner").alias("src"), F.col("best.to").alias("dst"), F.lit("patch").alias("how"))


def launch_links(launches: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """Links of tests to tracked files that they start as programs."""
    rows = launches.filter(F.col("name").rlike(r"\.\w+$")).join(files.filter("role = 'test'").select("file", "path"), "file")
    return B.read_targets(rows.select(F.col("owner").alias("src"), "path", F.col("name").alias("value")), targets).select("src", "dst", F.lit("launch").alias("how"))


def visit_links(visits: DataFrame, routes: DataFrame, scope: DataFrame, files: DataFrame) -> DataFrame:
    """Links of tests to the components (else files) of the client routes that they visit."""
    shown = routes.join(scope.select(F.col("scope").alias("file"), F.col("name").alias("value"), "id"), ["file", "value"], "left").join(files.select("file", "role"), "file")
    table = shown.select(F.col("name").alias("path"), F.coalesce("id", "file").alias("def"), F.col("extra").alias("redirect"), (F.col("role") == "test").alias("test"))
    table = table.withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))).distinct()
    hit = H.match_visits(visits.select(F.col("owner").alias("visit"), F.col("name").alias("path")).distinct(), table)
    return hit.filter("def is not null").select(F.col("visit").alias("src"), F.col("def").alias("dst"), F.lit("client").alias("how")).distinct()


def render_edges(renders: DataFrame, scope: DataFrame) -> DataFrame:
    """``calls`` edges of components to those whose tags they hold."""
    known = scope.select(F.col("scope").alias("file"), "name", F.col("id").alias("dst"))
    rows = renders.join(known, ["file", "name"]).groupBy(F.col("owner").alias("src"), "name").agg(F.collect_set("dst").alias("to"), F.count(F.lit(1)).alias("n")).filter(F.size("to") == 1)
    edges = rows.select("src", F.col("to")[0].alias("dst"), "n").filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").cast("int").alias("weight"))
    return edges.select("src", "dst", F.lit("calls").alias("kind"), "weight", F.lit(0.9).alias("confidence"), F.lit('{"via":"jsx"}').alias("attrs"))


def file_routes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes (handler, method, path) of the verbs that ``app/**/route`` files define."""
    rows = files.select("file", B.next_route(F.col("path")).alias("path")).filter("path is not null")
    return rows.join(symbols.filter("parent is null").filter(F.col("name").isin(*VERB_NAMES)).select("file", "name", "id"), "file").select(F.col("id").alias("handler"), F.col("name").alias("method"), "path")


def merged(calls: DataFrame) -> DataFrame:
    """Calls of several families as one edge per pair: the surest, with its attributes, and the weights together."""
    rows = calls.withColumns({"weight": F.coalesce("weight", F.lit(1)), "attrs": F.coalesce("attrs", F.lit("{}"))})
    best = F.max(F.struct("confidence", (F.col("attrs") == "{}").alias("plain"), "attrs")).alias("best")
    out = rows.groupBy("src", "dst", "kind").agg(best, F.sum("weight").cast("int").alias("weight"))
    return out.select("src", "dst", "kind", F.col("best.confidence").alias("confidence"), "weight", F.col("best.attrs").alias("attrs"))

