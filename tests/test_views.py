from tessera.model import Model
from tessera.operators import diff as D
from tessera.operators import views as V


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_views(spark):
    nodes = spark.createDataFrame(
        [("w:a/x.py", "w:a/", "file", '{"role":"code"}', 1, 1), ("w:b/y.py", "w:b/", "file", '{"role":"code"}', 1, 1), ("w:a/x.py#K", "w:a/x.py", "symbol", "{}", 1, 9), ("w:a/x.py#K.m", "w:a/x.py#K", "symbol", "{}", 2, 3), ("w:t.py", None, "file", '{"role":"test"}', 1, 1)],
        "id string, parent_id string, kind string, attrs string, start_line int, end_line int",
    )
    edges = spark.createDataFrame([("c", "w:a/x.py", "owns", 1), ("w:a/x.py", "w:b/y.py", "imports", 2), ("w:t.py#t", "w:a/x.py#K.m", "tests", 1), ("w:a/x.py#K", "env:A", "reads_env", 1), ("w:b/y.py", "w:a/x.py#K.m", "http_calls", 1)], "src string, dst string, kind string, weight int")
    results = spark.createDataFrame([("w:t.py#t", "passed", "1"), ("w:t.py#t", "failed", "2")], "test_node_id string, status string, artifact string")
    lines = spark.createDataFrame([("w:a/x.py", 2, 1, "1"), ("w:a/x.py", 8, 0, "1")], "file_id string, line int, hits int, artifact string")
    m = Model.of(spark, nodes=nodes, edges=edges, results=results, coverage_lines=lines)
    got = V.concept_map(m)
    assert rows(got["boxes"].select("box", "files", "symbols", "tests"), "box", "files", "symbols", "tests") == [("c", 1, 2, 1), ("w:b/", 1, 0, 0)]
    assert rows(got["links"], "from_box", "to_box", "kind", "weight") == [("c", "w:b/", "imports", 2), ("w:b/", "c", "http_calls", 1)]
    assert rows(V.symbol_details(m), "id", "tests", "result", "percent") == [("w:a/x.py#K", 1, "failed", 50.0)]


def test_database_and_texts(spark):
    columns = spark.createDataFrame([("users", "name", "text", True, False, False, None), ("users", "id", "int", False, True, False, None), ("posts", "user", "int", True, False, False, None)], '`table` string, `column` string, type string, nullable boolean, pk boolean, `unique` boolean, `default` string')
    keys = spark.createDataFrame([("posts", "user", "users", "id")], "`table` string, `column` string, to_table string, to_column string")
    uses = spark.createDataFrame([("f", "users", "reads_table", "{}")], "src string, dst string, kind string, attrs string")
    got = {r["table"]: r for r in V.database(columns, keys, uses).collect()}
    assert [c["column"] for c in got["users"]["columns"]] == ["id", "name"] and got["users"]["referenced_by"][0]["from_table"] == "posts" and got["users"]["readers"][0]["src"] == "f"
    assert 'users ||--o{ posts : "user"' in V.er_diagram(columns, keys)
    assert V.to_markdown(keys).splitlines()[0] == "| table | column | to_table | to_column |"
    changes = spark.createDataFrame([("symbol-changed", "run changed", "w:a/x.py"), ("table-added", "users", None)], "kind string, summary string, file string")
    maps = spark.createDataFrame([("w:a/x.py", "Core")], "file string, `group` string")
    text = V.review_markdown(D.grouped(changes, maps, maps.limit(0), maps.limit(0)))
    assert text.index("(ungrouped)") < text.index("## Core (concept)")
