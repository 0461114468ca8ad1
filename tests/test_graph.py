import random

import pytest
from pyspark.sql import functions as F

from tessera.model import Model
from tessera.operators import graph as G


def build(spark, roles, imports, packages=None, names=None):
    """A model of files ``path -> role`` and import pairs of paths."""
    nodes = [("w:" + p, "w:" + p.rpartition("/")[0] + "/", "file", (names or {}).get(p, p.rpartition("/")[2]), p, 10, f'{{"role":"{r}"}}') for p, r in roles.items()]
    dirs = sorted({p.rpartition("/")[0] for p in roles if "/" in p})
    nodes += [(f"w:{d}/", None, "group", d, d, None, "{}") for d in dirs]
    edges = [("w:" + a, "w:" + b, "imports") for a, b in imports]
    for pack, files in (packages or {}).items():
        nodes.append((pack, None, "package", pack, None, None, "{}"))
        edges += [("w:" + f, pack, "part_of") for f in files]
    n = spark.createDataFrame(nodes, "id string, parent_id string, kind string, name string, path string, loc int, attrs string").selectExpr("*", "'w' AS workspace_id")
    return Model.of(spark, nodes=n, edges=spark.createDataFrame(edges, "src string, dst string, kind string"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    roles = {"a/x.py": "code", "a/y.py": "code", "b/z.py": "code", "b/test_z.py": "test", "c/lonely.py": "code"}
    return build(spark, roles, [("a/x.py", "b/z.py"), ("a/y.py", "b/z.py"), ("b/z.py", "a/x.py"), ("b/test_z.py", "b/z.py"), ("a/x.py", "a/y.py")], {"pa": ["a/x.py", "a/y.py"], "pb": ["b/z.py", "b/test_z.py"]})


def test_hotspots_of_files_and_folders(small):
    got = {r["id"]: (r["fan_in"], r["fan_out"]) for r in G.hotspots(small, "file").collect()}
    assert got == {"w:a/x.py": (1, 2), "w:a/y.py": (1, 1), "w:b/z.py": (3, 1), "w:c/lonely.py": (0, 0)}
    got = {r["id"]: (r["fan_in"], r["fan_out"], r["test_files"]) for r in G.hotspots(small, "folder").collect()}
    assert got == {"w:a/": (1, 2, 0), "w:b/": (2, 1, 1), "w:c/": (0, 0, 0)}
    assert [r["id"] for r in G.top_hotspots(small, "fan_in", limit=1).collect()] == ["w:b/z.py"]
    assert G.top_hotspots(small, "fan_in", limit=-1).count() == 0


def test_matrix_and_forbidden(small):
    assert rows(G.dependency_matrix(small), "from_id", "to_id", "imports") == [("pa", "pa", 1), ("pa", "pb", 2), ("pb", "pa", 1)]
    assert rows(G.forbidden(small, "pb->pa"), "src", "dst") == [("w:b/z.py", "w:a/x.py")]
    with pytest.raises(LookupError):
        G.forbidden(small, "pa->nowhere")
    with pytest.raises(ValueError):
        G.forbidden(small, "pa")


def test_orphans(small):
    assert rows(G.unreferenced(small), "id") == [("w:c/lonely.py",)]
    assert rows(G.untested(small, "package"), "id", "outside_tests") == [("pa", 0)]
    assert G.unreachable(small).count() == 0


def test_cycles_and_witness(spark, small):
    got = rows(G.cycles(small), "level", "size", "detail")
    assert got == [("file", 3, "x.py → z.py → x.py"), ("folder", 2, "a → b → a"), ("package", 2, "pa → pb → pa")]
    none = build(spark, {"a/x.py": "code"}, [])
    assert G.cycles(none).count() == 0


def brute_scc(edges):
    nodes = {x for e in edges for x in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}
    seen = {}
    for n in nodes:
        todo, got = list(to[n]), set()
        while todo:
            x = todo.pop()
            if x not in got:
                got.add(x)
                todo += to[x]
        seen[n] = got
    return sorted((n, min(m for m in seen[n] if n in seen[m])) for n in nodes if n in seen[n])


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = sorted({(f"n{r.randrange(14):02}", f"n{r.randrange(14):02}") for _ in range(22)})
    df = spark.createDataFrame([("file", a, b) for a, b in edges], "level string, src string, dst string")
    assert rows(G.components(df), "id", "scc") == brute_scc(edges)


def test_reach_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a")], "seed string, id string")
    assert rows(G.reach(seeds, edges), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(G.reach(seeds, edges, 1), "id") == [("a",), ("b",)]
    assert G.closure(edges).count() == 12


def test_ancestors_end_on_cycles(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, parent_id string")
    assert rows(G.ancestors(nodes), "id", "ancestor") == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]


def test_initialisers_run_before_modules(spark):
    m = build(spark, {"a/__init__.py": "code", "a/b/__init__.py": "code", "a/b/x.py": "code", "c/y.py": "code", "d/__init__.py": "code", "e/z.py": "code"}, [("a/__init__.py", "c/y.py")])
    entry = m.nodes.withColumn("attrs", F.when(F.col("path") == "a/b/x.py", F.lit('{"role":"code","entry":true}')).otherwise(F.col("attrs")))
    m = m.with_(nodes=entry)
    assert sorted(r["id"] for r in G.reachable(m).collect()) == ["w:a/__init__.py", "w:a/b/__init__.py", "w:a/b/x.py", "w:c/y.py"]
    assert sorted(r["id"] for r in G.unreachable(m).collect()) == ["w:d/__init__.py", "w:e/z.py"]


def test_witness_is_the_first_of_the_shortest_cycles(spark):
    r = random.Random(8)
    n = 14
    pairs = sorted({(r.randrange(n), r.randrange(n)) for _ in range(34)})
    name = [f"n{r.randrange(6)}" for _ in range(n)]
    edges = [(a, b) for a, b in pairs if a != b]
    after = {a: [b for x, b in edges if x == a] for a in range(n)}
    reach = {}
    for a in range(n):
        todo, seen = list(after[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        reach[a] = seen
    comps = {}
    for a in range(n):
        if a in reach[a]:
            comps.setdefault(min(b for b in range(n) if b in reach[a] and a in reach[b]), []).append(a)
    want = set()
    for scc, members in comps.items():
        start = min(members, key=lambda x: (name[x], f"{x:02}"))
        ways = [[start]]
        while ways:
            done = [w for w in ways if start in after[w[-1]]]
            if done:
                best = min(done, key=lambda w: [(name[x], f"{x:02}") for x in w])
                want.add((f"{scc:02}", len(members), len(best), " → ".join(name[x] for x in [*best, start])))
                break
            ways = [[*w, x] for w in ways for x in after[w[-1]] if x in members and x not in w]
    e = spark.createDataFrame([("file", f"{a:02}", f"{b:02}") for a, b in edges], "level string, src string, dst string")
    names = spark.createDataFrame([(f"{k:02}", v) for k, v in enumerate(name)], "id string, name string")
    got = {tuple(x)[1:] for x in G.shortest_cycles(e, G.components(e), names).collect()}
    assert got == want and want
