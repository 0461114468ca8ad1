"""Work that follows the input: rows between operators, and what the driver gets."""

from pyspark.sql import functions as F

from tessera.lineage import kept
from tessera.model import Model
from tessera.operators import binding as B
from tessera.operators import graph as G
from tessera.operators import judgement as J


def plans(plan):
    """All operators of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return plans(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return plans(plan.plan())
    children = plan.children()
    return [plan] + [x for i in range(children.size()) for x in plans(children.apply(i))]


def most_rows(df):
    """The rows of a result, and the most that any operator gave on the way to it."""
    out = df.collect()
    counts = [p.metrics().get("numOutputRows") for p in plans(df._jdf.queryExecution().executedPlan())]
    return out, max(c.get().value() for c in counts if c.isDefined())


def test_open_pairs_of_a_large_chunk(spark):
    n = 2000
    parts = spark.range(n).select(F.lit("a").alias("area"), F.lit(0).alias("part"), F.col("id").cast("string").alias("id"))
    pairs = spark.createDataFrame([("1", "2"), ("3", "gone"), ("gone", "3"), ("4", "4")], "src string, dst string")
    out, most = most_rows(J.open_pairs(pairs, parts))
    assert sorted(map(tuple, out)) == [("3", "gone"), ("gone", "3")] and most <= n


def test_results_of_many_cases_of_one_name(spark):
    n = 2000
    cases = spark.range(n).select("id", F.lit("runs").alias("name"), F.lit("C > runs").alias("chain"))
    cases = cases.union(spark.createDataFrame([(n + 1, "adds %s", "D > adds %s"), (n, "adds %s", "E > adds %s"), (n + 2, "once", "F > once")], "id long, name string, chain string"))
    results = spark.range(n).select("id", F.lit("runs").alias("name"), F.lit("T > C > runs").alias("chain"))
    results = results.union(spark.createDataFrame([(n, "adds 1", "adds 1"), (n + 1, "once", None), (n + 2, "lost", "lost"), (n + 3, None, "F > once"), (n + 4, None, None)], "id long, name string, chain string")).withColumnRenamed("id", "rid")
    hit, miss = B.match_results(results, cases)
    out, most = most_rows(hit.select("rid", "test_node_id"))
    assert sorted(map(tuple, out)) == [*((i, 0) for i in range(n)), (n, n), (n + 1, n + 2), (n + 3, n + 2)] and most <= 2 * n
    assert sorted(str(r["detail"]) for r in miss.collect()) == ["None", "lost"]


def broadcasts(df):
    df.collect()
    return [p.nodeName() for p in plans(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "BroadcastExchangeExec"]


def test_reach_sends_no_rows_to_the_driver(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "src string, dst string")
    found = G.reach(spark.createDataFrame([("s", "a")], "seed string, id string"), edges)
    kinds = found.select("id").join(edges.select(F.col("src").alias("id")), "id")
    assert sorted(r["id"] for r in kinds.collect()) == ["a", "b", "c"] and broadcasts(kinds) == []


def test_rows_are_counted_as_they_are_kept(spark):
    rows = spark.range(10)
    assert kept(rows, "some")[1] == 10 and kept(rows, "few", "id < 3")[1] == 3
    none, n = kept(rows.filter("id > 20").join(rows, "id"), "none")
    assert n == 0 and none.count() == 0


def test_production_imports_send_no_files_to_the_driver(spark):
    nodes = spark.createDataFrame([(i, "file", '{"role":"%s"}' % r) for i, r in (("a", "code"), ("b", "code"), ("t", "test"))], "id string, kind string, attrs string")
    model = Model.of(spark, nodes=nodes, edges=spark.createDataFrame([("a", "b", "imports"), ("t", "a", "imports")], "src string, dst string, kind string"))
    out = G.production_imports(model)
    assert [tuple(r) for r in out.collect()] == [("a", "b")] and broadcasts(out) == []


def test_spans_of_the_same_lines(spark):
    n = 2000
    spans = spark.range(n).select(F.lit("f").alias("file"), "id", F.lit(1).alias("start_line"), F.lit(20).alias("end_line")).union(spark.createDataFrame([("f", n, 5, 6), ("f", n + 1, 5, 6)], "file string, id long, start_line int, end_line int"))
    points = spark.createDataFrame([("f", k) for k in range(1, 22)], "file string, line int")
    out, most = most_rows(B.innermost(points, spans))
    assert {r["line"]: r["symbol"] for r in out} == {k: n if k in (5, 6) else 0 if k < 21 else None for k in range(1, 22)} and most <= n + 2


def test_endings_of_imports(spark):
    files = spark.createDataFrame([(p, p) for p in ("a/x.ts", "a/x.tsx", "a/x.js", "a/y.jsx", "a/z/index.ts", "a/z.json", "a/w/index.tsx", "a/v.mjs.ts", "top.ts")], "id string, path string")
    want = {"./x": "a/x.ts", "./x.js": "a/x.js", "./x.mjs": "a/x.ts", "./y": "a/y.jsx", "./y.js": None, "./z": "a/z.json", "./w": "a/w/index.tsx", "./v.mjs": "a/v.mjs.ts", "../top": "top.ts", "../../top": None, "./x.ts": "a/x.ts", "././x": "a/x.ts", ".././a/x": "a/x.ts", "../a/./z/../y": "a/y.jsx", ".//x": "a/x.ts", "..": None}
    asked = spark.createDataFrame([("i", "a/i.ts", s) for s in want], "src string, path string, spec string")
    out, most = most_rows(B.resolve_imports(asked, files))
    assert {r["spec"]: r["dst"] for r in out} == {k: v for k, v in want.items() if v}
    assert most_rows(B.resolve_imports(spark.range(3000).select(F.lit("i").alias("src"), F.lit("a/i.ts").alias("path"), F.concat(F.lit("./m"), "id").alias("spec")), files))[1] <= 3000


def test_uses_of_one_table_are_dealt_by_their_source(spark, monkeypatch):
    monkeypatch.setattr(B, "USES_A_TASK", 100, raising=False)
    uses = spark.range(1000).select((F.col("id") % 250).alias("src"), F.lit("FROM").alias("verb"), F.lit("public.Orders").alias("name"), F.col("id").cast("int").alias("line"))
    out = B.use_tables(uses, spark.createDataFrame([("t:o", "orders", None)], "id string, name string, aliases array<string>"))
    assert {(r["src"], r["weight"]) for r in out.collect()} == {(k, 4) for k in range(250)} and out.rdd.getNumPartitions() == 11
