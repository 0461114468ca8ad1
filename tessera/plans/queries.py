"""Registered queries of the engine over the supplied tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.model import Model
from tessera.operators import diff, graph, http, lookups, rollups, search
from tessera.plans import projection as P
from tessera.plans.projection import table
from tessera.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Common table expressions of the projection.
G_FILE = """g_file AS (
    SELECT 'w:' || p_partkey::VARCHAR AS id, p_name AS name, p_brand || '/' || p_type AS folder, p_brand AS package, p_type AS concept,
           p_brand || '/' || p_type || '/' || p_partkey::VARCHAR AS path,
           CASE WHEN p_size % 5 = 0 THEN 'test' ELSE 'code' END AS role, p_size AS loc FROM part)"""
G_IMPORT = """g_lead AS (
    SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nx FROM lineitem
), g_import AS (
    SELECT 'w:' || l_partkey::VARCHAR AS src, 'w:' || nx::VARCHAR AS dst, count(*)::INTEGER AS weight FROM g_lead
    WHERE l_quantity >= 45 AND nx IS NOT NULL AND nx <> l_partkey GROUP BY l_partkey, nx)"""
G_PROD = """g_prod AS (
    SELECT i.src, i.dst, a.package AS sp, b.package AS dp, a.folder AS sf, b.folder AS df FROM g_import i
    JOIN g_file a ON a.id = i.src JOIN g_file b ON b.id = i.dst WHERE a.role = 'code' AND b.role = 'code')"""
G_CALL = """g_step AS (
    SELECT user_id, event_type, lead(user_id) OVER (ORDER BY ts, event_id) AS nx FROM events
), g_call AS (
    SELECT DISTINCT user_id AS src, nx AS dst FROM g_step WHERE event_type = 'error' AND nx IS NOT NULL AND nx <> user_id)"""
BASE = f"WITH RECURSIVE {G_FILE}, {G_IMPORT}, {G_PROD}"


def _hotspot_sql(level: str, metric: str) -> str:
    key = {"file": "id", "folder": "folder", "package": "package"}[level]
    ident = {"file": "k", "folder": "'w:' || k || '/'", "package": "'package:' || k"}[level]
    named = {"file": "any_value(f.name)", "folder": "k", "package": "k"}[level]
    path = {"file": "any_value(f.path)", "folder": "k", "package": "NULL"}[level]
    keep = "WHERE role = 'code'" if level == "file" else ""
    return f"""{BASE}, e AS (
        SELECT a.{key} AS s, b.{key} AS d FROM g_import i JOIN g_file a ON a.id = i.src JOIN g_file b ON b.id = i.dst
    ), fi AS (SELECT d AS k, count(*) AS n FROM e WHERE s <> d GROUP BY d), fo AS (SELECT s AS k, count(*) AS n FROM e WHERE s <> d GROUP BY s),
    sy AS (SELECT 'w:' || l_partkey::VARCHAR AS id, count(*) AS n FROM lineitem GROUP BY l_partkey),
    f AS (SELECT g_file.*, {key} AS k, coalesce(sy.n, 0) AS n FROM g_file LEFT JOIN sy USING (id) {keep}),
    m AS (SELECT k, {named} AS name, {path} AS path, sum(loc)::BIGINT AS loc, sum(f.n)::BIGINT AS symbols, count(*) FILTER (role = 'test') AS test_files, count(*) FILTER (role = 'code') AS code
          FROM f GROUP BY k)
    SELECT {ident} AS id, name, path::VARCHAR AS path, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out, loc, symbols, test_files
    FROM m LEFT JOIN fi USING (k) LEFT JOIN fo USING (k) WHERE code > 0
    ORDER BY {metric} DESC, coalesce(path, ''), id LIMIT 20"""


_FOLDERS = f"""{BASE}, top AS (SELECT id, folder AS k FROM g_file UNION ALL SELECT id, package FROM g_file),
    fi AS (SELECT b.k, count(*) AS n FROM g_import i JOIN top b ON b.id = i.dst WHERE NOT EXISTS (SELECT 1 FROM top a WHERE a.id = i.src AND a.k = b.k) GROUP BY b.k),
    fo AS (SELECT a.k, count(*) AS n FROM g_import i JOIN top a ON a.id = i.src WHERE NOT EXISTS (SELECT 1 FROM top b WHERE b.id = i.dst AND a.k = b.k) GROUP BY a.k),
    sy AS (SELECT 'w:' || l_partkey::VARCHAR AS id, count(*) AS n FROM lineitem GROUP BY l_partkey),
    m AS (SELECT k, sum(loc)::BIGINT AS loc, sum(coalesce(sy.n, 0))::BIGINT AS symbols, count(*) FILTER (role = 'test') AS test_files, count(*) FILTER (role = 'code') AS code
          FROM top JOIN g_file USING (id) LEFT JOIN sy USING (id) GROUP BY k)
    SELECT 'w:' || k || '/' AS id, k AS name, k AS path, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out, loc, symbols, test_files
    FROM m LEFT JOIN fi USING (k) LEFT JOIN fo USING (k) WHERE code > 0 ORDER BY fan_in DESC, path, id LIMIT 20"""


def _hotspots(name: str, metric: str, level: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.top_hotspots(P.model(spark, sf_dir), metric, level)

    run.__name__ = name
    query(_FOLDERS if level == "folder" else _hotspot_sql(level, metric))(run)


for _metric in graph.METRICS[:4]:
    _hotspots(f"hotspots_{_metric}", _metric, "file")
_hotspots("hotspots_folder", "fan_in", "folder")
_hotspots("hotspots_package", "fan_in", "package")


@query(f"""{BASE} SELECT 'package:' || sp AS from_id, 'package:' || dp AS to_id, count(*) AS imports, count(DISTINCT src || dst) AS pairs FROM g_prod GROUP BY sp, dp""")
def deps_matrix_package(spark, sf_dir):
    out = graph.dependency_matrix(P.model(spark, sf_dir), "package")
    return out.select("from_id", "to_id", "imports", F.size("files").cast("long").alias("pairs"))


@query(f"""{BASE} SELECT 'w:' || sf || '/' AS from_id, 'w:' || df || '/' AS to_id, count(*) AS imports FROM g_prod GROUP BY sf, df
    UNION ALL SELECT 'w:' || sp || '/', 'w:' || dp || '/', count(*) FROM g_prod GROUP BY sp, dp
    UNION ALL SELECT 'w:' || sp || '/', 'w:' || df || '/', count(*) FROM g_prod GROUP BY sp, df
    UNION ALL SELECT 'w:' || sf || '/', 'w:' || dp || '/', count(*) FROM g_prod GROUP BY sf, dp""")
def deps_matrix_folder(spark, sf_dir):
    return graph.dependency_matrix(P.model(spark, sf_dir), "folder").select("from_id", "to_id", "imports")


@query(f"""{BASE} SELECT DISTINCT src, dst FROM g_prod WHERE sp = 'Brand#1' AND dp = 'Brand#2'""")
def deps_forbid(spark, sf_dir):
    return graph.forbidden(P.model(spark, sf_dir), "Brand#1->Brand#2")


@query(f"""{BASE} SELECT id FROM g_file WHERE role = 'code' AND id NOT IN (SELECT dst FROM g_prod WHERE src <> dst)""")
def orphans_unreferenced(spark, sf_dir):
    return graph.unreferenced(P.model(spark, sf_dir))


@query(f"""{BASE}, t AS (SELECT i.src, b.package FROM g_import i JOIN g_file a ON a.id = i.src JOIN g_file b ON b.id = i.dst WHERE a.role = 'test'),
    b AS (SELECT folder, any_value(package) AS package FROM g_file GROUP BY folder HAVING count(*) FILTER (role = 'code') > 0 AND count(*) FILTER (role = 'test') = 0)
    SELECT 'w:' || b.folder || '/' AS id, (SELECT count(DISTINCT i.src) FROM g_import i JOIN g_file a ON a.id = i.src JOIN g_file f ON f.id = i.dst WHERE a.role = 'test' AND f.folder = b.folder) AS outside_tests FROM b
    UNION ALL SELECT 'w:' || package || '/', (SELECT count(DISTINCT src) FROM t WHERE t.package = p.package) FROM (SELECT package FROM g_file GROUP BY package HAVING count(*) FILTER (role = 'code') > 0 AND count(*) FILTER (role = 'test') = 0) p""")
def orphans_untested(spark, sf_dir):
    return graph.untested(P.model(spark, sf_dir), "folder")


@query(f"""WITH RECURSIVE {G_IMPORT}, seeds AS (SELECT 'w:' || p_partkey::VARCHAR AS id FROM part WHERE p_size = 1),
    r AS (SELECT id FROM seeds UNION SELECT i.dst FROM r JOIN g_import i ON i.src = r.id) SELECT id FROM r""")
def reachability(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").filter("p_size = 1").select(F.lit("all").alias("seed"), F.concat(F.lit("w:"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.reach(seeds, P.imports(spark, sf_dir)).select("id")


@query(f"""{BASE}, e AS (SELECT DISTINCT src, dst FROM g_prod), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT a.src AS id, min(a.dst) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def cycles_scc(spark, sf_dir):
    edges = graph.production_imports(P.model(spark, sf_dir)).distinct().select(F.lit("file").alias("level"), "src", "dst")
    return graph.components(edges).select("id", "scc")


@query(f"""{BASE}, e AS (SELECT DISTINCT src, dst FROM g_prod), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
    c AS (SELECT a.src AS id, min(a.dst) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
    st AS (SELECT scc, count(*) AS size, arg_min(c.id, (f.name, c.id)) AS start FROM c JOIN g_file f ON f.id = c.id GROUP BY scc),
    w AS (SELECT st.scc, e.dst AS id, 1 AS depth FROM st JOIN e ON e.src = st.start JOIN c ON c.id = e.dst AND c.scc = st.scc
          UNION SELECT w.scc, e.dst, w.depth + 1 FROM w JOIN st ON st.scc = w.scc AND w.id <> st.start JOIN e ON e.src = w.id JOIN c ON c.id = e.dst AND c.scc = w.scc WHERE w.depth < 40)
    SELECT st.scc, any_value(size) AS size, min(w.depth)::INTEGER AS length FROM st JOIN w ON w.scc = st.scc AND w.id = st.start GROUP BY st.scc""")
def cycle_summary(spark, sf_dir):
    return graph.cycles(P.model(spark, sf_dir)).filter("level = 'file'").select("scc", "size", "length")


@query(f"""WITH RECURSIVE {G_CALL}, r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT g.dst, r.depth + 1 FROM r JOIN g_call g ON g.src = r.id WHERE r.depth < 4)
    SELECT id, min(depth)::INTEGER AS depth FROM r GROUP BY id""")
def bfs_depth4(spark, sf_dir):
    seeds = spark.range(1, 2).select(F.col("id").alias("seed"), "id")
    return graph.reach(seeds, P.calls(spark, sf_dir), 4).select("id", "depth")


@query("""SELECT n_name AS id, n_name AS ancestor, 0 AS depth FROM nation UNION ALL SELECT n_name, r_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT r_name, r_name, 0 FROM region""")
def ancestor_closure(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id"))
    return graph.ancestors(tree.unionByName(r.select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent_id"))))


@query("""WITH v AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b, count(*) AS n FROM orders JOIN customer c ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier s ON s_suppkey = l_suppkey
        WHERE c.c_nationkey <> s.s_nationkey GROUP BY 1, 2),
    u AS (SELECT n_nationkey AS k, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey),
    x AS (SELECT u1.name AS a1, u1.region AS a2, u2.name AS b1, u2.region AS b2, n FROM v JOIN u u1 ON u1.k = a JOIN u u2 ON u2.k = b),
    y AS (SELECT a1 AS f, b1 AS t, n FROM x UNION ALL SELECT a1, b2, n FROM x WHERE a2 <> b2 UNION ALL SELECT a2, b1, n FROM x WHERE a2 <> b2 UNION ALL SELECT a2, b2, n FROM x WHERE a2 <> b2)
    SELECT f AS from_id, t AS to_id, sum(n)::BIGINT AS weight FROM y GROUP BY f, t""")
def concept_rollup(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    volume = pairs.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit("calls").alias("kind")).agg(F.count(F.lit(1)).alias("weight"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    owner = n.select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("concept"))
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id"))
    up = graph.ancestors(tree.unionByName(r.select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent_id"))))
    return rollups.roll_up(volume, owner, up).select("from_id", "to_id", "weight")


@query(f"""{BASE} SELECT i.dst AS file, i.src AS test, 1.0::DOUBLE AS confidence, count(*) AS targets FROM g_import i JOIN g_file a ON a.id = i.src WHERE a.role = 'test' GROUP BY i.dst, i.src""")
def tests_for(spark, sf_dir):
    return rollups.tests_of_files(P.model(spark, sf_dir)).select("file", "test", "confidence", "targets")


@query("""WITH c AS (SELECT user_id::VARCHAR AS file_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS line, max(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS hits FROM events GROUP BY 1, 2)
    SELECT file_id, count(*) FILTER (hits > 0) AS covered, count(*) AS lines, round_even(100.0::DOUBLE * count(*) FILTER (hits > 0) / count(*), 1) AS percent FROM c GROUP BY file_id""")
def coverage_rollup(spark, sf_dir):
    return rollups.coverage(P.coverage(spark, sf_dir)).select("file_id", "covered", "lines", "percent")


@query("""SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst, max(event_id) AS weight FROM events GROUP BY 1, 2""")
def coverage_union_merge(spark, sf_dir):
    edges = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("int").alias("dst"), F.col("event_id").alias("weight"))
    return rollups.coverage_edges(edges).select("src", "dst", "weight")


@query("""SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1""")
def results_status(spark, sf_dir):
    return rollups.counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"), "status")


@query(f"""WITH {G_FILE}, k AS (SELECT CASE role WHEN 'test' THEN 'test file' ELSE 'source file' END AS display_kind FROM g_file UNION ALL SELECT 'function' FROM lineitem)
    SELECT display_kind, count(*) AS n FROM k GROUP BY 1""")
def status_counts(spark, sf_dir):
    return lookups.status(P.model(spark, sf_dir))["nodes"].filter("display_kind is not null")


@query("""WITH r AS (SELECT event_type AS kind, user_id::VARCHAR AS node_id, event_id::VARCHAR AS detail FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY node_id, detail) AS place FROM r) SELECT kind, node_id, detail, place::INTEGER AS place FROM p WHERE place <= 3""")
def diagnostics_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("detail"))
    return lookups.diagnostic_examples(Model.of(spark, diagnostics=rows)).select("kind", "node_id", "detail", "place")


@query(f"""WITH {G_FILE}, {G_IMPORT}, hub AS (SELECT dst AS id FROM g_import GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)
    SELECT 'in' AS direction, src AS other, weight FROM g_import JOIN hub ON dst = id UNION ALL SELECT 'out', dst, weight FROM g_import JOIN hub ON src = id""")
def show_edges(spark, sf_dir):
    m = P.model(spark, sf_dir)
    hub = m.links("imports").groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").first()[0]
    return lookups.edges_of(m, hub).filter("kind = 'imports'").select("direction", "other", "weight")


@query(f"""WITH {G_FILE} SELECT id, path FROM g_file WHERE id = 'w:7'""")
def resolve_ref(spark, sf_dir):
    return lookups.resolve(P.model(spark, sf_dir), "w:7").select("id", "path")


@query("""SELECT 'w:1#' || l_orderkey::VARCHAR || '.' || l_linenumber::VARCHAR || '.' || l_suppkey::VARCHAR AS id FROM lineitem WHERE l_partkey = 1 UNION ALL SELECT 'w:1'""")
def descendant_scope(spark, sf_dir):
    m = P.model(spark, sf_dir)
    return m.nodes.filter(lookups.scope(F.col("id"), "w:1", "file")).select("id")


_WORDS = "list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), 'áàâäãåéèêëíìîïóòôöõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn'), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"""WITH d AS (SELECT doc_id AS id, {_WORDS} AS ts FROM documents), s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, avg(len(ts)) FILTER (len(ts) > 0) AS mean FROM d),
    t AS (SELECT id, len(ts) AS len, unnest(ts) AS term FROM d),
    h AS (SELECT id, any_value(len) AS len, w, count(*)::DOUBLE AS tf FROM t JOIN (SELECT unnest(['the', 'on']) AS w) ON starts_with(term, w) GROUP BY id, w),
    f AS (SELECT w, count(*) AS df FROM h GROUP BY w),
    sc AS (SELECT id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS k FROM h JOIN f USING (w), s GROUP BY id)
    SELECT id, round(score, 6)::DOUBLE AS score FROM sc WHERE k = 2""")
def search_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("doc"))
    return search.search_documents(docs, "the on", {"doc": 1.0}).select("id", F.round("score", 6).alias("score"))


_PATH = "regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"


@query(f"""SELECT page_id, coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), ''), '') || '/' ||
    array_to_string(list_transform(list_filter(string_split({_PATH}, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^:[A-Za-z_]') THEN '{{' || regexp_extract(s, '^:([A-Za-z_][A-Za-z0-9_]*)', 1) || '}}' ELSE s END), '/') AS path FROM pages""")
def http_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.http_normalise("url").alias("path"))


@query("""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^(?i:https?)://([^/?#]+)', 1)) AS place FROM pages), h AS (SELECT *, string_split(place, ':')[1] AS host FROM u)
    SELECT page_id, url, place <> '' AND host NOT IN ('localhost', '127.0.0.1', '0.0.0.0', '::1')
    AND len(list_filter(['.local', '.test', '.example', '.invalid', '.localhost'], lambda e: ends_with(host, e))) = 0 AS outside FROM h""")
def external_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", S.is_external_url("url").alias("outside"))


def _routes(spark, sf_dir):
    routes = table(spark, sf_dir, "part").select(F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("handler"), F.when(F.col("p_partkey") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/"), F.regexp_replace("p_brand", "#", ""), F.lit("/{id}/s"), (F.col("p_size") % 10).cast("string")).alias("path"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("caller"), F.when(F.col("o_orderkey") % 2 == 0, "get").otherwise("post").alias("method"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "/v1/api/Brand").otherwise("/api/Brand"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/:key/s"), (F.col("o_custkey") % 10).cast("string"), F.lit("?page=1")).alias("path"))
    return calls, routes


@query("""WITH r AS (SELECT 'h' || p_partkey::VARCHAR AS handler, CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/api/' || replace(p_brand, '#', '') || '/{id}/s' || (p_size % 10)::VARCHAR AS route FROM part),
    c AS (SELECT o_custkey::VARCHAR AS caller, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN o_orderkey % 3 = 0 THEN '/v1/api/Brand' ELSE '/api/Brand' END || (o_orderkey % 50)::VARCHAR || '/{key}/s' || (o_custkey % 10)::VARCHAR AS path, count(*)::INTEGER AS weight FROM orders GROUP BY 1, 2, 3),
    m AS (SELECT c.*, r.handler, r.route, row_number() OVER (PARTITION BY caller, c.method, path ORDER BY length(route), handler, route) AS place,
          CASE WHEN starts_with(path, '/v1') THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence
          FROM c JOIN r ON c.method = r.method AND replace(replace(path, '/v1', ''), '{key}', '{id}') = route)
    SELECT caller, method, path, handler, route, confidence, weight FROM m WHERE place = 1""")
def http_best_match(spark, sf_dir):
    return http.match_calls(*_routes(spark, sf_dir))


@query("""SELECT p_partkey, p_name AS label, substr(sha1('h' || chr(0) || 'GET' || chr(0) || '/' || p_partkey::VARCHAR), 1, 12) AS endpoint FROM part""")
def route_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.route_label("p_name", F.lit("h")).alias("label"), S.endpoint_id(F.lit("h"), F.lit("GET"), F.concat(F.lit("/"), F.col("p_partkey").cast("string"))).alias("endpoint"))


_HALF = "SELECT doc_id AS id, md5(text) AS content_hash FROM documents WHERE doc_id % 2 ="


def _half(spark, sf_dir, k):
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == k).select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("content_hash"))


@query(f"""WITH a AS ({_HALF} 0), b AS ({_HALF} 1), x AS (SELECT content_hash, min(id) AS id FROM a GROUP BY 1 HAVING count(*) = 1), y AS (SELECT content_hash, min(id) AS id FROM b GROUP BY 1 HAVING count(*) = 1)
    SELECT x.id AS from_id, y.id AS to_id, content_hash AS hash FROM x JOIN y USING (content_hash)""")
def move_pairs(spark, sf_dir):
    return diff.move_pairs(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'both' END AS state FROM a FULL JOIN b ON a.id = b.id""")
def node_set_diff(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return diff.set_difference(l.filter("l_shipdate < timestamp_ntz '1995-06-01'").select(F.col("l_partkey").alias("id")), l.filter("l_shipdate >= timestamp_ntz '1998-01-01'").select(F.col("l_partkey").alias("id")), "id")


@query("""WITH a AS (SELECT p_partkey AS path, p_brand AS handler, p_type AS signature FROM part WHERE p_partkey % 10 <> 1), b AS (SELECT p_partkey AS path, CASE WHEN p_size < 5 THEN 'x' ELSE p_brand END AS handler, p_type AS signature FROM part WHERE p_partkey % 10 <> 2)
    SELECT 'endpoint-' || CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(a.path, b.path) AS path FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.handler <> b.handler""")
def endpoint_changes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("GET").alias("method"), F.col("p_partkey").alias("path"), F.col("p_brand").alias("handler"), F.col("p_type").alias("signature"), F.lit("").alias("body"), "p_size")
    head = p.filter("path % 10 <> 2").withColumn("handler", F.when(F.col("p_size") < 5, "x").otherwise(F.col("handler")))
    return diff.endpoint_changes(p.filter("path % 10 <> 1"), head).select("kind", "path")


@query("""WITH a AS (SELECT lower(n_name) AS t, n_regionkey AS k FROM nation WHERE n_nationkey <> 3), b AS (SELECT lower(n_name) AS t, CASE WHEN n_nationkey % 5 = 0 THEN 9 ELSE n_regionkey END AS k FROM nation WHERE n_nationkey <> 4)
    SELECT CASE WHEN a.t IS NULL THEN 'table-added' WHEN b.t IS NULL THEN 'table-removed' ELSE 'table-altered' END AS kind, coalesce(a.t, b.t) AS table FROM a FULL JOIN b ON a.t = b.t WHERE a.t IS NULL OR b.t IS NULL OR a.k <> b.k""")
def table_changes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = lambda df, k: df.select(F.col("n_name").alias("table"), F.lit("id").alias("column"), k.cast("string").alias("type"), F.lit(True).alias("nullable"), F.lit(False).alias("pk"), F.lit(False).alias("unique"), F.lit("").alias("default"))
    base = rows(n.filter("n_nationkey <> 3"), F.col("n_regionkey"))
    head = rows(n.filter("n_nationkey <> 4"), F.when(F.col("n_nationkey") % 5 == 0, 9).otherwise(F.col("n_regionkey")))
    return diff.table_changes(base, head).select("kind", "table")


@query("""WITH v AS (SELECT o_custkey AS k, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS place FROM v)
    SELECT k AS o_custkey, v AS o_orderpriority, n AS votes FROM r WHERE place = 1""")
def majority_owner(spark, sf_dir):
    return rollups.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(f"""{BASE}, e AS (SELECT src AS id, dst AS o FROM g_import UNION ALL SELECT dst, src FROM g_import), v AS (SELECT e.id, f.concept, count(*) AS n FROM e JOIN g_file f ON f.id = e.o JOIN g_file me ON me.id = e.id WHERE me.role = 'test' AND f.role = 'code' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, concept) AS place FROM v) SELECT id AS file, concept FROM r WHERE place = 1""")
def provisional_owner(spark, sf_dir):
    f = P.files(spark, sf_dir).withColumn("role", F.get_json_object("attrs", "$.role"))
    owner = f.filter("role = 'code'").select(F.col("id").alias("file"), "concept")
    return diff.provisional_owners(f.select("id", "path"), owner, P.imports(spark, sf_dir)).filter("via = 'imports'").select("file", "concept")


@query("""SELECT p_partkey AS file, p_type AS before, p_brand AS after FROM part WHERE p_type <> p_brand""")
def ownership_moves(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    none = spark.createDataFrame([], "kind string, before array<string>, after array<string>")
    return diff.ownership_moves(p.select(F.col("p_partkey").alias("file"), F.col("p_type").alias("concept")), p.select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("concept")), none)


@query("""WITH a AS (SELECT l_suppkey AS src, l_returnflag AS dst, count(*) AS volume FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), b AS (SELECT l_suppkey AS src, l_returnflag AS dst, count(*) AS volume FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2)
    SELECT 'relationship-' || CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst WHERE a.volume IS DISTINCT FROM b.volume""")
def relationship_volume(spark, sf_dir):
    rows = lambda df: df.groupBy(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("dst")).agg(F.count(F.lit(1)).alias("volume")).withColumns({"label": F.lit(""), "via": F.lit(""), "at": F.lit("")})
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return diff.relationship_changes(rows(l.filter("l_linenumber <= 3")), rows(l.filter("l_linenumber > 3"))).select("kind", "src", "dst")


@query("""SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS kind, l_linestatus AS source, max(l_discount) AS confidence, arg_max(l_suppkey::VARCHAR, (l_discount, -l_linenumber * 1000000 - l_suppkey)) AS attrs, count(*) AS weight FROM lineitem GROUP BY 1, 2, 3, 4""")
def edge_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("source"), F.col("l_discount").alias("confidence"), F.col("l_suppkey").cast("string").alias("attrs"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("seq"))
    return rollups.merge_edges(rows)


@query("""WITH f AS (SELECT p_partkey, unnest([p_brand, p_brand || '/' || p_type]) AS dir FROM part), c AS (SELECT DISTINCT p_brand || '/' || p_type AS dir FROM part WHERE p_size < 10)
    SELECT p_partkey AS id, max(c.dir) AS module FROM f JOIN c USING (dir) GROUP BY 1""")
def prefix_container(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    folder = F.concat("p_brand", F.lit("/"), "p_type")
    packs = p.filter("p_size < 10").select(folder.alias("id"), folder.alias("path")).distinct()
    files = p.select(F.col("p_partkey").alias("id"), F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return diff.module_of(files, packs).join(packs.select(F.col("id").alias("module")), "module", "left_semi").select("id", "module")


@query("""SELECT p_partkey AS id, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_brand || '/' || p_partkey::VARCHAR, p_partkey) - 1) // 15)::INTEGER AS batch FROM part""")
def batch_files(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return rollups.batches(files).select("id", "batch")


@query("""SELECT l_orderkey AS src, l_partkey AS dst, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) - 1 AS ordinal FROM lineitem""")
def ordinal_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_suppkey", "l_linenumber")
    return rollups.ordinals(rows, "l_linenumber", "l_suppkey").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{24,}')) AS token FROM documents),
    e AS (SELECT doc_id, token, -sum((n / length(token)) * log2(n / length(token))) AS entropy FROM (SELECT doc_id, token, c, count(*)::DOUBLE AS n FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS c FROM t) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT doc_id, token, regexp_matches(token, '^[0-9A-Fa-f]+$') AS is_hex, contains(token, '/') AS has_slash, round(entropy, 6) AS entropy,
    NOT contains(token, '/') AND NOT regexp_matches(token, '^[0-9A-Fa-f]+$') AND regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]') AND entropy >= 4.2 AS secret FROM e""")
def secret_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.long_tokens("text")).alias("token")).distinct()
    return rows.select("doc_id", "token", F.col("token").rlike(r"^[0-9A-Fa-f]+$").alias("is_hex"), F.col("token").contains("/").alias("has_slash"), F.round(S.entropy("token"), 6).alias("entropy"), S.is_secret_token("token").alias("secret"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2""")
def safe_sql(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tessera_lineitem")
    return lookups.safe_sql(spark, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM tessera_lineitem GROUP BY 1, 2", limit=500)


@query("""WITH l AS (SELECT o_orderkey AS sha, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, o_orderstatus = 'P' AS merge, o_orderpriority = '1-URGENT' AS numbered FROM orders),
    p AS (SELECT sha, place FROM l WHERE merge OR numbered OR place < coalesce((SELECT min(place) FROM l WHERE merge), place + 1))
    SELECT lag(sha) OVER (ORDER BY place) AS base, sha AS head FROM p QUALIFY base IS NOT NULL""")
def history_points(spark, sf_dir):
    """Orders as commits of one branch: partly shipped ones are merges, urgent ones squashed pull requests."""
    parents = F.array_repeat(F.lit("x"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1))
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Change (#"), F.col("o_orderkey").cast("string"), F.lit(")"))).otherwise("Change")
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.struct("o_orderdate", "o_orderkey").alias("place"), parents.alias("parents"), subject.alias("subject"))
    return diff.consecutive(diff.history_points(log)).select("base", "head")


@query("""SELECT o_orderkey AS sha FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def history_select(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("sha"))
    return diff.select_history(points, "1996-01-01", "1996-01-31", limit=100).select("sha")


@query("""WITH s AS (SELECT l_partkey AS id, bool_and(l_orderkey % 10 <> 0) AS only_tests, count(*) AS callers FROM lineitem GROUP BY 1) SELECT 'c#' || id::VARCHAR AS id, callers FROM s WHERE only_tests""")
def test_only_symbols(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    caller = F.when(F.col("l_orderkey") % 10 != 0, "t#f").otherwise("c#f")
    calls = l.select(caller.alias("src"), F.concat(F.lit("c#"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("kind"))
    files = spark.createDataFrame([("c", "file", '{"role":"code"}'), ("t", "file", '{"role":"test"}')], "id string, kind string, attrs string")
    symbols = table(spark, sf_dir, "part").select(F.concat(F.lit("c#"), F.col("p_partkey").cast("string")).alias("id"), F.lit("symbol").alias("kind"), F.lit("{}").alias("attrs"))
    return graph.test_only(Model.of(spark, nodes=files.unionByName(symbols), edges=calls)).select("id", "callers")


@query(f"""WITH RECURSIVE {G_FILE}, {G_IMPORT}, seeds AS (SELECT id FROM g_file WHERE loc = 1), r AS (SELECT id FROM seeds UNION SELECT i.dst FROM r JOIN g_import i ON i.src = r.id)
    SELECT id FROM g_file WHERE role = 'code' AND id NOT IN (SELECT id FROM r)""")
def orphans_unreachable(spark, sf_dir):
    m = P.model(spark, sf_dir)
    entry = F.when((F.col("kind") == "file") & (F.col("loc") == 1), F.concat(F.regexp_replace("attrs", r"\}$", ""), F.lit(',"entry":true}'))).otherwise(F.col("attrs"))
    return graph.unreachable(m.with_(nodes=m.nodes.withColumn("attrs", entry)))


@query("""WITH t AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), n AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal >= 9950)
    SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT k FROM t) OR c_nationkey IN (SELECT k FROM n)""")
def parent_chain_tested(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    symbols = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.lit("symbol").alias("kind"))
    tops = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("file").alias("kind"))
    a = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    b = c.filter("c_acctbal >= 9950").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    tests = a.union(b).distinct().select(F.lit("t").alias("src"), "dst", F.lit("tests").alias("kind"))
    out = graph.parent_chain_tested(Model.of(spark, nodes=symbols.union(tops), edges=tests))
    return out.select(F.expr("substring(id, 2)").cast("long").alias("id"))


@query("""WITH s AS (SELECT p_brand AS file, p_partkey AS id, p_size * 10 AS a, p_size * 10 + p_partkey % 40 AS b FROM part), p AS (SELECT DISTINCT p_brand AS file, p_size * 10 + p_partkey % 25 AS line FROM part)
    SELECT file, line::INTEGER AS line, arg_min(id, (b - a) * 10000000 + id) AS symbol FROM p JOIN s USING (file) WHERE line BETWEEN a AND b GROUP BY file, line""")
def innermost_symbol(spark, sf_dir):
    from tessera.operators.binding import innermost

    p = table(spark, sf_dir, "part")
    start = F.col("p_size") * 10
    spans = p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), start.alias("start_line"), (start + F.col("p_partkey") % 40).alias("end_line"))
    points = p.select(F.col("p_brand").alias("file"), (start + F.col("p_partkey") % 25).cast("int").alias("line")).distinct()
    return innermost(points, spans).filter("symbol is not null").select("file", "line", "symbol")


@query("""WITH a AS (SELECT o_custkey AS key, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR END AS gone FROM orders),
    l AS (SELECT key, id FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.key = a.key AND b.gone = a.id))
    SELECT k.key, CASE count(l.id) WHEN 0 THEN 'superseded' WHEN 1 THEN 'accepted' ELSE 'conflict' END AS state, count(l.id)::INTEGER AS live FROM (SELECT DISTINCT key FROM a) k LEFT JOIN l ON l.key = k.key GROUP BY k.key""")
def causal_merge(spark, sf_dir):
    from tessera.operators.judgement import causal_merge as merge

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("string")
    gone = F.when((F.col("o_orderkey") % 3 == 0) & before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders").select(F.lit("k").alias("kind"), F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("acceptance"), gone.alias("retires"), F.lit(1).alias("generation"), F.lit("x").alias("answer"))
    return merge(rows).select("key", "state", F.size("live").alias("live"))


@query("""SELECT user_id::VARCHAR AS src, 'env:' || event_type AS dst, count(*)::INTEGER AS weight FROM events GROUP BY 1, 2""")
def env_reads(spark, sf_dir):
    from tessera.operators.binding import read_env

    reads = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("default"), F.col("event_id").alias("place"))
    return read_env(reads, spark.createDataFrame([], "name string"))[1].select("src", "dst", "weight")


@query("""SELECT l_orderkey AS src, CASE WHEN l_returnflag = 'N' THEN 'reads_table' ELSE 'writes_table' END AS kind, 't:' || lower(l_linestatus) AS dst, count(*)::INTEGER AS weight FROM lineitem GROUP BY 1, 2, 3""")
def table_uses(spark, sf_dir):
    from tessera.operators.binding import use_tables

    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.when(F.col("l_returnflag") == "N", "FROM").otherwise("INSERT").alias("verb"), F.concat(F.lit("public."), "l_linestatus").alias("name"), F.col("l_linenumber").alias("line"))
    tables = spark.createDataFrame([("t:o", "o", None), ("t:f", "F", None)], "id string, name string, aliases array<string>")
    return use_tables(uses, tables).select("src", "kind", "dst", "weight")


@query("""SELECT DISTINCT l_orderkey AS src, 's#' || l_partkey::VARCHAR AS dst, 0.8::DOUBLE AS confidence FROM lineitem WHERE l_partkey % 2 = 0""")
def mentions(spark, sf_dir):
    from tessera.operators.binding import mentions as link

    name = lambda c: F.when(F.col(c) % 2 == 0, F.concat(F.lit("S"), F.col(c).cast("string"))).otherwise("S1")  # noqa: E731  odd ones share a name, which then means nothing
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.concat(F.lit("s#"), F.col("p_partkey").cast("string")).alias("id"), F.lit("symbol").alias("kind"), name("p_partkey").alias("name"), F.lit(None).cast("string").alias("path"))
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("src"), name("l_partkey").alias("text"))
    return link(said, nodes).select(F.col("src").cast("long").alias("src"), "dst", "confidence")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    from tessera.streaming.artifacts import windowed

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(events, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT coalesce(p_brand, '') AS brand, coalesce(p_type, '') AS type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_brand, p_type))""")
def grouped_counts(spark, sf_dir):
    out = rollups.grouped_counts(table(spark, sf_dir, "part"), "p_brand", "p_type")
    return out.select(F.coalesce("p_brand", F.lit("")).alias("brand"), F.coalesce("p_type", F.lit("")).alias("type"), "n")


@query("""SELECT n_name AS name, regexp_replace(lower(n_name), '[^a-z0-9_.-]+', '_', 'g') AS key, 'w:table:' || regexp_replace(lower(n_name), '[^a-z0-9_.-]+', '_', 'g') AS id FROM nation""")
def table_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), S.id_name("n_name").alias("key"), S.table_id(F.lit("w"), F.col("n_name")).alias("id"))


@query("""SELECT doc_id, sha1('blob ' || octet_length(encode(text))::VARCHAR || chr(0) || text) AS blob FROM documents""")
def blob_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.blob_id(F.encode("text", "utf-8")).alias("blob"))


@query("""SELECT regexp_extract(unnest(regexp_extract_all(html, '(?i)href="[^"]*"')), '(?i)href="([^"]*)"', 1) AS href, count(*) AS n FROM pages GROUP BY 1""")
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), 1)).alias("href"))
    return rollups.counts(links, "href")
