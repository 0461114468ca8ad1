"""From a repository's files to a model: parse, resolve, link, and derive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import wiring as W
from tessera.functions import scalars as S
from tessera.lineage import materialise
from tessera.model import Model, file_part
from tessera.operators import binding as B
from tessera.operators import http as H
from tessera.operators import rollups as R
from tessera.parse import braces
from tessera.parse import python_ast as P
from tessera.sources import documents as M
from tessera.sources import files as FS
from tessera.sources import schemas as T


def tracked_texts(spark: SparkSession, root: str, workspace: str = "root", ignore: str = "") -> DataFrame:
    """Tracked files of a work tree on a local disk, with their texts: workspace_id, path, text."""
    paths = FS.enumerate_repo(spark, root, workspace)
    texts = FS.read_folder(spark, root).select("path", "content", "size", "mtime_ns")
    out = paths.join(texts, "path")
    return FS.drop_ignored(out, ignore) if ignore else out


def scan(files: DataFrame, model_id: str = "worktree") -> Model:
    """A model of files (workspace_id, path, content).

    Python, JavaScript, TypeScript, Vue and C# are parsed; facts of other languages can be
    joined in with ``binding``. All texts are read once; what is parsed is written once, and every edge family is a join of it
    (``wiring`` has those of re-exports, injection, fixtures, patches, launches, client routes and rendering).
    """
    spark = files.sparkSession
    first = F.substring_index(F.decode(F.substring("content", 1, 200), "utf-8"), "\n", 1)
    base = files.withColumns({"id": S.file_id("workspace_id", "path"), "r": FS.classify(F.col("path"), first), "content_hash": S.blob_id("content"), "text": F.try_validate_utf8(F.col("content").cast("string"))})
    base = base.select("id", "workspace_id", "path", "content_hash", F.col("r.role").alias("role"), F.col("r.lang").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = materialise(base.withColumn("loc", F.size(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n"))), "files")
    parsed = materialise(P.parse_files(base.filter("lang = 'python'")).unionByName(braces.parse_files(base)), "parsed")
    symbols = materialise(P.symbols(parsed), "symbols")
    place = base.select(F.col("id").alias("file"), "path", "workspace_id", "role", "lang")
    ids = symbols.select("file", F.col("qualname").alias("src"), F.col("id").alias("owner")).dropDuplicates(["file", "src"])

    def facts(kind: str) -> DataFrame:
        """Facts of a kind with the node they belong to: the innermost definition, else the file."""
        rows = P.facts(parsed, kind).join(ids, ["file", "src"], "left")
        return rows.withColumn("owner", F.coalesce("owner", "file"))

    # nodes
    parent = F.when(F.col("path").contains("/"), F.concat("workspace_id", F.lit(":"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("/"))).otherwise(F.col("workspace_id"))
    shown = F.when(F.col("role") == "test", "test file").when(F.col("role") == "doc", "doc").when(F.col("role") == "code", "source file").otherwise("file")
    nodes = base.select("id", parent.alias("parent_id"), F.when(F.col("role") == "doc", "doc").otherwise("file").alias("kind"), shown.alias("display_kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "workspace_id", "path", "lang", "loc", "content_hash", F.to_json(F.struct("role")).alias("attrs"), F.when(F.col("role") == "doc", M.title(F.col("text"))).alias("doc"))
    nodes = nodes.unionByName(B.containment(base.select("workspace_id", "path")), allowMissingColumns=True)
    nodes = nodes.unionByName(symbols.join(place.select("file", "path", "workspace_id", "lang"), "file").select("id", "parent_id", "kind", "display_kind", "name", "workspace_id", "path", "start_line", "end_line", "lang", "content_hash", "signature", "doc"), allowMissingColumns=True)
    nodes = nodes.unionByName(base.select("workspace_id").distinct().select(F.col("workspace_id").alias("id"), F.lit("workspace").alias("kind"), F.col("workspace_id").alias("name"), "workspace_id"), allowMissingColumns=True)

    # imports and calls
    said = facts("import").join(place.select("file", "path"), "file")
    again = facts("reexport").join(place.select("file", "path"), "file")
    asked = said.unionByName(again).select(F.col("file").alias("src"), "path", F.col("name").alias("spec")).distinct()
    deep = said.filter("extra is not null").select(F.col("file").alias("src"), "path", F.concat("name", F.when(F.col("name").rlike(r"\.$"), "").otherwise("."), "extra").alias("spec"), F.col("name").alias("of"), "value", "extra")
    targets = base.select("id", "path")
    found = materialise(B.resolve_imports(asked.union(deep.select("src", "path", "spec")).distinct(), targets, W.aliases(base)), "imports")
    defined = materialise(W.named_imports(deep, found, W.reexports(again, found), symbols), "defined")
    module = deep.join(found, ["src", "spec"]).select("src", F.col("of").alias("spec"), F.col("dst").alias("target"))
    module = module.union(defined.filter("target <> dst").select("src", "of", "target")).distinct()
    direct = found.join(asked.select("src", "spec"), ["src", "spec"], "left_semi").withColumn("type_only", F.lit(False))
    passed = module.select("src", "spec", F.col("target").alias("dst")).distinct().join(direct.select("src", "spec"), ["src", "spec"], "left_anti").withColumn("type_only", F.lit(False))
    imports = B.import_edges(direct.unionByName(passed), module)
    top = symbols.filter("parent is null").select(F.col("file").alias("target"), F.col("name").alias("local"), "id", "display_kind")
    names = defined.join(top, ["target", "local"]).select(F.col("src").alias("scope"), F.col("value").alias("name"), "id", "display_kind")
    local = symbols.filter("parent is null").select(F.col("file").alias("scope"), "name", "id", "display_kind")
    scope = local.unionByName(names).distinct()
    own = symbols.filter("parent is not null").select(F.concat("file", F.lit("#"), "parent").alias("scope"), "name", "id", "display_kind")
    used = facts("call").withColumn("shape", F.col("extra"))
    cls = F.concat("file", F.lit("#"), F.substring_index("src", ".", 1))
    calls, ambiguous = B.bind_calls(used.filter("shape <> 'member'").select(F.col("owner").alias("src"), "shape", F.when(F.col("shape") == "this", cls).otherwise(F.col("file")).alias("scope"), "name"), local.unionByName(names).unionByName(own).distinct())
    built = facts("construct").select(F.col("owner").alias("src"), F.lit("name").alias("shape"), F.col("file").alias("scope"), "name")
    calls = calls.filter("src <> dst").unionByName(B.bind_calls(built, scope)[0].filter("src <> dst"))
    calls = calls.unionByName(W.injected_calls(used, facts("field"), symbols, scope), allowMissingColumns=True).unionByName(W.render_edges(facts("render"), scope), allowMissingColumns=True)
    calls = materialise(W.merged(calls), "calls")
    sharp = W.csharp_edges(facts, symbols, place).join(imports.filter("kind = 'imports'").select("src", "dst"), ["src", "dst"], "left_anti")
    imports = imports.unionByName(sharp, allowMissingColumns=True)

    # HTTP
    routers = facts("router").select(F.concat("file", F.lit("#"), "name").alias("router"), F.coalesce("value", F.lit("")).alias("prefix"))
    mounts = facts("mount").join(deep.select(F.col("src").alias("file"), F.col("value").alias("child_name"), "of").join(found.select(F.col("src").alias("file"), F.col("spec").alias("of"), F.col("dst").alias("child_file")), ["file", "of"]), ["file"], "left").filter(F.col("child_name").isNull() | (F.substring_index("name", ".", 1) == F.col("child_name")))
    mounts = mounts.select(F.concat("file", F.lit("#"), "extra").alias("parent"), F.concat(F.coalesce("child_file", "file"), F.lit("#"), F.substring_index("name", ".", -1)).alias("child"), F.col("value").alias("extra")).distinct()
    side = F.split(F.coalesce("extra", F.lit("")), r"\|")  # of a decorator the router; of a call router|handler
    given = F.when(F.size(side) > 1, side[1]).when(F.col("src") == "", side[0]).otherwise(F.col("src"))
    handler = F.when(given == "", F.col("owner")).otherwise(F.concat("file", F.lit("#"), given))
    routes = facts("route").select(handler.alias("handler"), F.col("name").alias("method"), F.col("value").alias("path"), F.concat("file", F.lit("#"), side[0]).alias("router"))
    full = materialise(H.full_routes(routes, H.expand_mounts(routers, mounts)).unionByName(W.file_routes(place, symbols)).distinct(), "routes")
    wanted = facts("client").select(F.col("owner").alias("caller"), F.col("name").alias("method"), F.col("value").alias("path"))
    matched = materialise(H.match_calls(wanted, full), "http")
    web = matched.select(F.col("caller").alias("src"), F.col("handler").alias("dst"), F.lit("http_calls").alias("kind"), "confidence", "weight", F.to_json(F.struct("method", F.col("route").alias("path"))).alias("attrs"))

    # tests
    tests = symbols.filter("kind = 'test'").select("id", "file")
    code = nodes.filter("kind = 'symbol'").select("id").union(base.filter("role = 'code'").select("id"))
    by_call = calls.join(tests.select(F.col("id").alias("src")), "src", "left_semi").join(code.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.when(F.col("confidence") < 1, "this-call").otherwise("call").alias("how"))
    test_files = base.filter("role = 'test'").select(F.col("id").alias("src"), "path")
    by_import = imports.filter("kind = 'imports'").join(test_files.select("src"), "src", "left_semi").join(base.filter("role = 'code'").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit("import").alias("how"))
    stem = lambda p: F.regexp_replace(F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[a-z]+$", ""), r"^test_|_test$|\.(test|spec)$", "")
    one = base.filter("role = 'code'").groupBy(stem(F.col("path")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst")).filter("n = 1")
    by_name = test_files.withColumn("stem", stem(F.col("path"))).join(one, "stem").select("src", "dst", F.lit("naming").alias("how"))
    reads = B.read_targets(facts("read").join(place.filter("role = 'test'"), "file").select(F.col("owner").alias("src"), "path", F.col("name").alias("value")), targets).select("src", "dst", F.lit("read").alias("how"))
    exempt = F.col("path").rlike(r"(^|/)conftest\.py$")
    more_links = W.fixture_links(facts("fixture"), symbols, place, calls, code)
    in_test = lambda kind: facts(kind).join(place.filter("role = 'test'").select("file"), "file", "left_semi")
    for part in (W.patch_links(in_test("patch"), place, symbols, targets), W.launch_links(facts("launch"), place, targets), W.visit_links(in_test("visit"), facts("client-route"), scope, place)):
        more_links = more_links.unionByName(part)
    by_client = web.join(tests.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", F.lit("client").alias("how"))
    linked, lonely = B.link_tests(by_call.unionByName(by_import).unionByName(by_name).unionByName(reads).unionByName(more_links).unionByName(by_client).distinct(), base.filter("role = 'test'").select("id", F.col("id").alias("file"), exempt.alias("exempt")))

    # environment, tables, documents, manifests
    shown_routes = full.groupBy(F.col("handler").alias("id")).agg(F.to_json(F.array_sort(F.collect_set(F.struct("method", "path")))).alias("routes"))
    reads_env = facts("env").select(F.col("owner").alias("src"), "name", F.col("value").alias("default"), F.col("line").alias("place"))
    env_nodes, env_edges, passthrough = B.read_env(reads_env, M.dotenv(base).select("name"))
    declared = materialise(T.read_schemas(base.filter("role in ('code', 'test') or lang in ('sql', 'prisma')")), "schemas")
    columns, keys = T.merge_declarations(declared)
    table_of = lambda c: F.concat(F.lit("table:"), S.id_name(c))
    aliases = declared.groupBy(F.lower("name").alias("name")).agg(F.sort_array(F.collect_set("model")).alias("aliases"))
    tables = aliases.select(table_of("name").alias("id"), "name", "aliases")
    used_tables = B.use_tables(T.read_table_uses(base.filter("role = 'code'")).withColumnRenamed("id", "src"), tables)
    table_nodes = tables.select("id", F.lit("table").alias("kind"), F.lit("table").alias("display_kind"), "name")
    column_nodes = columns.select(S.column_id(table_of("table"), "column").alias("id"), table_of("table").alias("parent_id"), F.lit("column").alias("kind"), F.lit("column").alias("display_kind"), F.col("column").alias("name"), F.to_json(F.struct("type", "nullable", "pk", "unique", "default")).alias("attrs"))
    foreign = keys.select(S.column_id(table_of("table"), "column").alias("src"), S.column_id(table_of("to_table"), F.coalesce(F.nullif("to_column", F.lit("")), F.lit("id"))).alias("dst"), F.lit("foreign_key").alias("kind"), F.lit("data").alias("source"))
    items = materialise(M.manifests(base), "manifests")
    more_nodes, more_edges = M.manifest_edges(items, base.select("id", "path"))
    told = B.mentions(M.references(base.filter("role = 'doc'")), nodes)

    all_nodes = nodes
    for part in (env_nodes, table_nodes, column_nodes, more_nodes):
        all_nodes = all_nodes.unionByName(part, allowMissingColumns=True)
    attrs = F.when(F.col("routes").isNotNull(), F.concat(F.lit('{"http_routes":'), "routes", F.lit("}"))).otherwise(F.coalesce("attrs", F.lit("{}")))
    all_nodes = all_nodes.join(shown_routes, "id", "left").withColumn("attrs", attrs).drop("routes")
    edges = imports
    for part in (calls, linked, web, env_edges, used_tables, foreign, more_edges, told, B.html_references(base.filter("lang = 'html'").withColumnRenamed("text", "html"), targets)):
        edges = edges.unionByName(part, allowMissingColumns=True)
    diagnostics = P.parse_errors(parsed)
    for part in (ambiguous, lonely, passthrough, H.unmatched(wanted, matched)):
        diagnostics = diagnostics.unionByName(part)
    state = base.select("path", F.lit(0).alias("mtime_ns"), F.octet_length("text").alias("size"), "content_hash", F.lit(P.VERSION).alias("parser_version"))
    edges = edges.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "weight": F.coalesce("weight", F.lit(1)), "source": F.coalesce("source", F.lit("treesitter"))})
    tables = {"nodes": all_nodes, "edges": edges, "diagnostics": diagnostics}
    return Model.of(spark, model_id, **{k: materialise(v, k) for k, v in tables.items()}, file_state=state)


def ingest(model: Model, lines: DataFrame, results: DataFrame | None = None) -> Model:
    """A model with coverage rows (and test results) of artifacts; they replace rows of the same artifacts."""
    from tessera.sources import artifacts as A

    files = model.files().select("id", "path")
    good, bad = A.map_coverage(lines, files)
    tests = model.kind("test").select("id", "name", "path", F.element_at(F.split("id", "#"), -1).alias("chain"))
    spans = model.kind("symbol").filter("start_line is not null").select(file_part("id").alias("file"), "id", "start_line", "end_line")
    linked = A.context_edges(lines, files, tests.select("id", "path", "name"), spans)
    out = {"coverage_lines": R.replace_artifact(model.coverage_lines.drop("model_id"), good), "edges": model.edges.filter("source <> 'coverage'").drop("model_id").unionByName(R.coverage_edges(linked), allowMissingColumns=True), "diagnostics": model.diagnostics.drop("model_id").unionByName(bad)}
    if results is not None:
        hit, miss = B.match_results(results.withColumn("rid", F.concat_ws("|", "artifact", "chain")), tests)
        out["results"] = R.replace_artifact(model.results.drop("model_id"), hit.select("test_node_id", "status", "duration_ms", "artifact"))
        out["diagnostics"] = out["diagnostics"].unionByName(miss)
    return model.with_(**out)
