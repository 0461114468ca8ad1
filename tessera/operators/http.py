"""Linking of HTTP clients to handlers, mount prefixes, and client routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.lineage import materialise

#: Depth at which redirects end.
REDIRECTS = 3


def expand_mounts(routers: DataFrame, mounts: DataFrame) -> DataFrame:
    """(router, prefix): every full prefix of a router. routers: router, prefix; mounts: parent, child, extra.

    A router with several parents has several prefixes; chains go on as far as there are
    mounts, and end where a router would be above itself.
    """
    top = routers.join(mounts.select(F.col("child").alias("router")).distinct(), "router", "left_anti")
    level = top.select("router", S.join_path(F.lit(""), F.col("prefix")).alias("prefix"), F.array("router").alias("seen"))
    level = materialise(level, "mounts")
    out = level
    while not level.isEmpty():
        down = level.join(mounts, (level["router"] == mounts["parent"]) & ~F.array_contains("seen", mounts["child"])).select(F.col("child"), F.col("prefix").alias("above"), "extra", "seen")
        level = down.join(routers, down["child"] == routers["router"]).select("router", S.join_path(S.join_path(F.col("above"), F.coalesce("extra", F.lit(""))), F.col("prefix")).alias("prefix"), F.array_sort(F.concat("seen", F.array("router"))).alias("seen")).distinct()
        level = materialise(level, "mounts")
        out = out.union(level)
    return out.select("router", "prefix").distinct()


def full_routes(routes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Routes (handler, method, path, router) with the prefixes of their routers; routes without one stay."""
    out = routes.join(prefixes, "router", "left")
    return out.select("handler", F.upper("method").alias("method"), S.http_normalise(S.join_path(F.coalesce("prefix", F.lit("")), F.col("path"))).alias("path")).distinct()


def _shape(path: Column | str) -> Column:
    """Segments of a path, with every parameter as ``{}``."""
    return F.transform(S.segments(path), lambda x: F.when(S.is_param(x), F.lit("{}")).otherwise(x))


def _ends(shape: Column, longest: Column) -> Column:
    """(end, k) for the last k segments, k from 1 to ``longest``."""
    return F.transform(F.sequence(F.lit(1), longest), lambda k: F.struct(F.array_join(F.slice(shape, F.size(shape) - k + 1, k), "/").alias("end"), k.alias("k")))


def match_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """The best route of each call: caller, method, path, handler, route, confidence, weight.

    calls: caller, method, path; routes: handler, method, path. Paths are aligned at their
    ends: parameters match parameters only, literals must be equal. Longer matches win, then
    more literals, fewer extra segments, the shorter route, and the smaller handler. Paths
    without a literal and external URLs take no part.

    An alignment is the equality of one path's shape with an end of the other's, so rows meet
    by equality of (method, end), of which a path has as many as segments. Only the best
    route of each end travels, and each distinct path is matched once.
    """
    c = calls.select("caller", F.upper("method").alias("method"), S.http_normalise("path").alias("path")).groupBy("caller", "method", "path").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    c = c.filter(S.has_literal("path") & ~S.is_external_url("path"))
    r = routes.select("handler", F.upper("method").alias("method"), S.http_normalise("path").alias("route")).distinct().filter(S.has_literal("route"))
    r = r.select("method", _shape("route").alias("shape"), F.struct(F.length("route").alias("size"), "handler", "route").alias("to"))
    r = r.groupBy("method", "shape").agg(F.min("to").alias("to"))
    p = c.select("method", "path").distinct().withColumn("shape", _shape("path"))
    n, least = F.size("shape"), F.min(F.struct("extra", "to"))
    literals = lambda end: F.size(F.filter(F.split(end, "/"), lambda s: s != "{}"))
    # The route is an end of the path (or all of it), or the path is an end of the route.
    whole = r.select("method", F.array_join("shape", "/").alias("end"), "to")
    longer = p.select("method", "path", n.alias("n"), F.inline(_ends(F.col("shape"), n)))
    kept = longer.join(whole, ["method", "end"]).select("method", "path", "end", "k", (F.col("n") - F.col("k")).alias("extra"), "to")
    ends = r.filter(n > 1).select("method", "to", n.alias("n"), F.inline(_ends(F.col("shape"), n - 1)))
    ends = ends.select("method", "end", "k", "to", (F.col("n") - F.col("k")).alias("extra")).groupBy("method", "end", "k").agg(least.alias("best"))
    omitted = p.select("method", "path", F.array_join("shape", "/").alias("end")).join(ends, ["method", "end"]).select("method", "path", "end", "k", F.col("best.extra").alias("extra"), F.col("best.to").alias("to"))
    rank = F.struct((-F.col("k")).alias("k"), (-literals(F.col("end"))).alias("literals"), "extra", "to")
    best = kept.unionByName(omitted).groupBy("method", "path").agg(F.min(rank).alias("best"))
    confidence = F.when(F.col("path") == F.col("best.to.route"), 1.0).when(F.col("best.extra") == 0, 0.9).otherwise(0.8)
    return c.join(best, ["method", "path"]).select("caller", "method", "path", F.col("best.to.handler").alias("handler"), F.col("best.to.route").alias("route"), confidence.alias("confidence"), "weight")


def unmatched(calls: DataFrame, matched: DataFrame) -> DataFrame:
    """A diagnostic for each call that found no route."""
    rows = calls.select("caller", F.upper("method").alias("method"), S.http_normalise("path").alias("path")).distinct()
    rows = rows.join(matched.select("caller", "method", "path"), ["caller", "method", "path"], "left_anti")
    why = F.when(S.is_external_url("path"), "external").when(~S.has_literal("path"), "dynamic-path").otherwise("no-route")
    return rows.select(F.col("caller").alias("node_id"), F.lit("unmatched_http_call").alias("kind"), F.concat("method", F.lit(" "), "path", F.lit(" [resolution="), why, F.lit("]")).alias("detail"))


def match_visits(visits: DataFrame, routes: DataFrame) -> DataFrame:
    """Client routes that visits open: visit, target, def. visits: visit, path (``*`` for holes); routes: path, def, redirect, test.

    Paths of one length match segment by segment, a parameter or hole anything; routes with
    fewer parameters and longer static parts win, those of test files last; redirects
    are followed three times.
    """
    v = visits.withColumn("vs", S.segments("path")).withColumn("n", F.size("vs"))
    r = routes.withColumn("rs", S.segments(S.http_normalise("path"))).withColumn("n", F.size("rs")).withColumnRenamed("path", "target")
    hole = lambda x: S.is_param(x) | (x == "*")
    # Rows meet by the literal parts: each visit is read through each pattern of holes that routes of its length have.
    through = F.expr("array_join(transform(rs, (x, k) -> case when substring(mask, k + 1, 1) = '1' then '*' else x end), '/')")
    mask = lambda segments: F.array_join(F.transform(segments, lambda x: F.when(hole(x), "1").otherwise("0")), "")
    r = r.withColumn("mask", mask(F.col("rs"))).withColumn("key", through)
    plain, holed = v.filter(~F.exists("vs", hole)), v.filter(F.exists("vs", hole))
    seen = plain.join(r.select("n", "mask").distinct(), "n").withColumn("key", F.expr("array_join(transform(vs, (x, k) -> case when substring(mask, k + 1, 1) = '1' then '*' else x end), '/')")).join(r, ["n", "mask", "key"])
    ok = F.forall(F.zip_with("vs", "rs", lambda a, b: hole(a) | hole(b) | (a == b)), lambda x: x)
    met = seen.select("visit", "path", "target", "def", "redirect", "test", "rs").unionByName(holed.join(r, "n").filter(ok).select("visit", "path", "target", "def", "redirect", "test", "rs"))
    params = F.size(F.filter("rs", hole))
    static = F.length(F.array_join(F.filter("rs", lambda x: ~hole(x)), ""))
    order = Window.partitionBy("visit", "path").orderBy("test", params, F.desc(static), "target", "def")
    hit = met.withColumn("place", F.row_number().over(order)).filter("place = 1").select("visit", "path", "target", "def", "redirect")
    onward = routes.select(F.col("path").alias("redirect"), F.col("def").alias("next_def"), F.col("redirect").alias("next"))
    for _ in range(REDIRECTS):
        hit = hit.join(onward, "redirect", "left").select("visit", "path", F.coalesce(F.when(F.col("next_def").isNotNull(), F.col("redirect")), "target").alias("target"), F.coalesce("next_def", "def").alias("def"), F.col("next").alias("redirect"))
    return hit.drop("redirect").distinct()


def endpoints(routes: DataFrame, http_calls: DataFrame, calls: DataFrame, imports: DataFrame, table_uses: DataFrame, hops: int = 4) -> DataFrame:
    """One row per (handler, method, path): callers, code with depth, and tables with least depth.

    Code is what the handler calls within ``hops``, and files its file imports at depth 1 where
    nothing of them is reached yet. Ties of ``via`` go to the smallest node.
    """
    from tessera.operators.graph import reach

    handlers = routes.select("handler").distinct()
    seen = materialise(reach(handlers.select(F.col("handler").alias("seed"), F.col("handler").alias("id")), calls, hops), "called")
    owner = F.substring_index(F.col("handler"), "#", 1)
    extra = handlers.withColumn("src", owner).join(imports.select("src", "dst"), "src").select(F.col("handler").alias("seed"), F.col("dst").alias("id"), F.lit(1).alias("depth"))
    extra = extra.distinct().join(seen.select("seed", F.substring_index("id", "#", 1).alias("id")).distinct(), ["seed", "id"], "left_anti")
    code = materialise(seen.unionByName(extra), "code")
    uses = table_uses.select(F.col("src").alias("id"), "table", "mode")
    tables = code.join(uses, "id").groupBy("seed", "table", "mode").agg(F.min(F.struct("depth", F.col("id").alias("via"))).alias("best"))
    tables = tables.groupBy(F.col("seed").alias("handler")).agg(F.array_sort(F.collect_list(F.struct("table", "mode", F.col("best.depth").alias("depth"), F.col("best.via").alias("via"), (F.col("best.depth") == 0).alias("direct")))).alias("tables"))
    reached = code.filter("depth > 0").groupBy(F.col("seed").alias("handler")).agg(F.array_sort(F.collect_set(F.struct("depth", "id"))).alias("code"))
    callers = http_calls.groupBy("handler", "method", F.col("route").alias("path")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    out = routes.select("handler", "method", "path").distinct().join(callers, ["handler", "method", "path"], "left").join(reached, "handler", "left").join(tables, "handler", "left")
    return out.withColumn("id", S.endpoint_id("handler", "method", "path")).orderBy("path", "method", "handler")
