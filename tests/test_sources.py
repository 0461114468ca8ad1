import subprocess

import pytest

from tessera.parse import python_ast as P
from tessera.sources import artifacts as A
from tessera.sources import documents as M
from tessera.sources import files as S
from tessera.sources import schemas as T


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


LCOV = "SF:a.ts\nDA:1,0\nDA:1,3\nDA:2,0\nend_of_record\nSF:gone.ts\nDA:1,1\nend_of_record\n"
COVERAGE = '{"meta":{"format":3},"files":{"a.py":{"executed_lines":[1],"missing_lines":[2],"contexts":{"1":["t.py::test_a|run",""]}}}}'
JUNIT = '<testsuites><testsuite name="s"><testsuite name="in"><testcase name="a" time="0.5"/></testsuite><testcase name="b"><failure/></testcase><testcase name="c"><skipped/></testcase></testsuite></testsuites>'


def test_artifacts(spark):
    texts = spark.createDataFrame([("1", LCOV), ("2", COVERAGE)], "artifact string, text string")
    got = A.coverage_rows(texts)
    assert rows(got.na.fill("-"), "path", "line", "hits", "context") == [("a.py", 1, 1, "t.py::test_a"), ("a.py", 2, 0, "-"), ("a.ts", 1, 3, "-"), ("a.ts", 2, 0, "-"), ("gone.ts", 1, 1, "-")]
    assert rows(A.lcov_lines(texts.filter("artifact = '1'")), "path", "line", "hits") == [("a.ts", 1, 3), ("a.ts", 2, 0), ("gone.ts", 1, 1)]
    good, bad = A.map_coverage(got, spark.createDataFrame([("w:a.ts", "a.ts"), ("w:a.py", "a.py")], "id string, path string"))
    assert good.count() == 4 and bad.count() == 1
    assert [(n, c, s, d) for n, c, _, s, d in A.parse_junit(JUNIT)] == [("a", "s > in > a", "passed", 500.0), ("b", "s > b", "failed", None), ("c", "s > c", "skipped", None)]
    with pytest.raises(A.UnknownFormat):
        A.detect("nothing")


def test_ddl_and_orms(spark):
    sql = "CREATE TABLE \"users\" (id serial PRIMARY KEY, mail text NOT NULL UNIQUE, -- CREATE TABLE no (x int)\n price NUMERIC(10,2) DEFAULT 0, org int REFERENCES orgs(id));\nALTER TABLE users ADD FOREIGN KEY (org) REFERENCES orgs (id);"
    (t,) = T.parse_ddl(sql)
    assert [(c["name"], c["type"], c["nullable"], c["pk"], c["unique"]) for c in t["columns"]] == [("id", "serial", False, True, False), ("mail", "text", False, False, True), ("price", "NUMERIC(10,2)", True, False, False), ("org", "int", True, False, False)]
    assert len(t["keys"]) == 2
    alchemy = "class U(Base):\n    __tablename__ = 'u'\n    id: Mapped[int] = mapped_column(primary_key=True)\n    o = Column(Integer, ForeignKey('orgs.id'), nullable=False)\n"
    (u,) = T.parse_sqlalchemy(alchemy)
    assert u["name"] == "u" and [c["pk"] for c in u["columns"]] == [True, False] and u["keys"] == [{"column": "o", "table": "orgs", "target": "id"}]
    (d,) = T.parse_django("class Post(models.Model):\n    title = models.CharField(max_length=9)\n    author = models.ForeignKey('auth.User', null=True)\n", "blog")
    assert d["name"] == "blog_post" and [c["name"] for c in d["columns"]] == ["id", "title", "author_id"]
    (p, q) = T.parse_prisma("model User {\n  id Int @id\n  mail String? @unique @map(\"e_mail\")\n  posts Post[]\n  @@map(\"users\")\n}\nmodel Post {\n  id Int @id\n  userId Int\n  user User @relation(fields: [userId], references: [id])\n}\n")
    assert p["name"] == "users" and p["columns"][1]["name"] == "e_mail" and q["keys"] == [{"column": "userId", "table": "users", "target": "id"}]
    (e,) = T.parse_typeorm("@Entity('cats')\nexport class Cat {\n  @PrimaryGeneratedColumn()\n  id: number;\n\n  @Column({ nullable: true })\n  name: string;\n\n  @ManyToOne(() => Owner)\n  owner: Owner;\n}\n")
    assert e["name"] == "cats" and [c["name"] for c in e["columns"]] == ["id", "name"] and e["keys"][0]["column"] == "ownerId"
    (f,) = T.parse_ef_core('[Table("dogs")]\npublic class Dog\n{\n    [Key]\n    public int Id { get; set; }\n    public string? Name { get; set; }\n}\n')
    assert f["name"] == "dogs" and [c["pk"] for c in f["columns"]] == [True, False]
    columns, keys = T.merge_declarations(T.read_schemas(spark.createDataFrame([("a.sql", sql), ("b.sql", "CREATE TABLE USERS (id int, extra text);")], "path string, text string")))
    assert rows(columns, "table", "column")[:2] == [("users", "extra"), ("users", "id")] and keys.count() == 1


def test_table_uses():
    source = "q = 'SELECT a FROM users u JOIN orgs o'\n# 'DELETE FROM none'\nx = \"delete from logs\"\nUser.objects.create()\n"
    assert T.table_uses(source) == [("DELETE", "logs", 3), ("FROM", "users", 1), ("JOIN", "orgs", 1), ("WRITE", "User", 4)]


def test_markdown_and_env(spark):
    docs = spark.createDataFrame([("d", "d.md", "---\ntitle: T\n---\n# H\n```\n`no`\n```\nSee `a.py` and [x](b.md).\n"), ("e", "e.md", "```\n# no\n```\n# Yes\n")], "id string, path string, text string")
    assert rows(docs.select("id", M.title(docs.text).alias("t")), "id", "t") == [("d", "T"), ("e", "Yes")]
    assert rows(M.references(docs), "text") == [("a.py",), ("b.md",)]
    env = spark.createDataFrame([(".env.example", "A=1\n# B=2\nexport C='x'\n"), (".env", "S=1")], "path string, text string")
    assert rows(M.dotenv(env), "name", "value", "line") == [("A", "1", 1), ("C", "x", 3)]
    compose = "services:\n  db:\n    image: postgres:16\n  web:\n    build: .\n    environment:\n      - KEY=1\n    depends_on: [db]\n"
    assert M.env_declared("docker-compose.yml", compose) == [("KEY", "compose")]
    assert M.parse_manifest("docker-compose.yml", compose) == [("external", "db", "", None, []), ("deployable", "web", "", None, ["db"])]


def test_manifests(spark):
    docker = "FROM python\nWORKDIR /srv\nCOPY app/ ./app/\nCMD [\"python\", \"app/main.py\"]\n"
    assert M.docker_entry(docker) == "app/main.py"
    files = spark.createDataFrame([("w:p/package.json", "p/package.json", '{"name":"p","scripts":{"start":"x"},"dependencies":{"q":"1","stripe":"2"}}'), ("w:q/package.json", "q/package.json", '{"name":"q"}'), ("w:p/a.ts", "p/a.ts", "")], "id string, path string, text string")
    nodes, edges = M.manifest_edges(M.manifests(files), files)
    assert rows(nodes, "id") == [("deployable:p",), ("external:Stripe",), ("package:q",)]
    assert ("deployable:p", "package:q", "depends_on") in rows(edges, "src", "dst", "kind") and ("w:p/a.ts", "deployable:p", "part_of") in rows(edges, "src", "dst", "kind")


def test_ignore_rules(spark):
    import re

    rules = [(re.compile(p), n, d) for p, n, d in S.parse_ignore("build/\n*.log\n!keep.log\n/top\n")]
    hit = lambda p: S.ignored(p, rules)
    assert [hit(p) for p in ("a/build/x", "build", "x.log", "a/keep.log", "top/x", "a/top", "build/keep.log")] == [True, False, True, False, True, False, True]
    df = spark.createDataFrame([("a/build/x.bin",), ("a/build/x.py",), ("z.log",)], "path string")
    assert rows(S.drop_ignored(df, "build/\n*.log\n"), "path") == [("a/build/x.py",)]


def test_roles(spark):
    df = spark.createDataFrame([("a/x.py",), ("tests/test_x.py",), ("README.md",), ("img.png",), ("Dockerfile",), ("a.spec.ts",)], "path string")
    got = [tuple(r[0]) for r in df.select(S.classify(df.path)).collect()]
    assert got == [("code", "python"), ("test", "python"), ("doc", None), ("other", None), ("code", "dockerfile"), ("test", "typescript")]


def test_git(spark, tmp_path):
    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    run("add", "."), run("commit", "-m", "first")
    (tmp_path / "a.txt").write_text("one\n2\n3\n")
    run("add", "."), run("commit", "-m", "second (#4)")
    assert rows(S.enumerate_repo(spark, root), "path", "mode") == [("a.txt", "100644")]
    assert rows(S.enumerate_repo(spark, root, ref="HEAD~1"), "path") == [("a.txt",)]
    log = S.git_log(spark, root)
    assert rows(log.select("place", S.pull_request(log.subject).alias("pr")).na.fill(0), "place", "pr") == [(0, 0), (1, 4)]
    assert rows(S.line_stats(spark, root, "HEAD~1", "HEAD"), "additions", "deletions") == [(2, 1)]
    assert S.worktrees(spark, root).count() == 1


def test_change_detection(spark):
    now = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "path string, content_hash string, parser_version int")
    old = spark.createDataFrame([("a", "1", 1), ("b", "9", 1), ("c", "3", 0)], "path string, content_hash string, parser_version int")
    assert rows(S.to_parse(now, old), "path") == [("b",), ("c",)]
    assert S.fingerprint(now) == S.fingerprint(now.orderBy("path")) != S.fingerprint(old)


SOURCE = '''
import os
from .lib import helper as h

BASE = "/api"
router = APIRouter(prefix="/v1")

class Store(Protocol):
    def __init__(self, db: Db):
        self.db = db

    def run(self, n):
        self.save(n)
        return os.environ.get("KEY", "d") + os.environ["OTHER"]

@router.get(BASE + "/items/{id}")
def items(id):
    if id:
        where = "a"
    else:
        where = "b"
    open(where)
    requests.get(f"/x/{id}")
    return h(items)
'''


def test_python_front_end(spark):
    symbols, facts, bad = P.parse("w:m.py", SOURCE)
    assert not bad and [(s["qualname"], s["display_kind"]) for s in symbols] == [("Store", "class"), ("Store.__init__", "method"), ("Store.run", "method"), ("items", "function")]
    said = {(f["fact"], f["src"], f["name"], f["value"]) for f in facts}
    assert {("env", "Store.run", "KEY", "d"), ("env", "Store.run", "OTHER", None), ("route", "items", "GET", "/api/items/{id}"), ("router", "", "router", "/v1"), ("client", "items", "GET", "/x/{id}"), ("field", "Store", "db", "Db"), ("import", "", ".lib", "h")} <= said
    assert not [f for f in facts if f["fact"] == "read"]
    parsed = P.parse_files(spark.createDataFrame([("w:m.py", SOURCE, "code"), ("w:bad.py", "def (", "code")], "id string, text string, role string"))
    assert rows(P.symbols(parsed), "id", "parent_id")[1] == ("w:m.py#Store.__init__", "w:m.py#Store")
    assert rows(P.parse_errors(parsed), "node_id") == [("w:bad.py",)]


def test_streaming(spark, tmp_path):
    from tessera.streaming import artifacts as St

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.lcov").write_text(LCOV)
    query = St.ingest(St.watch(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    events = spark.createDataFrame([(1, "2024-01-01 00:01:00", "a", 2.0), (1, "2024-01-01 00:12:00", "a", 3.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["col"]).col("ts").cast("timestamp"))
    assert rows(St.windowed(events), "n", "total") == [(1, 2.0), (1, 3.0)]
    assert rows(St.sessions(events), "n") == [(2,)]
