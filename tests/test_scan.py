from tessera.operators import graph, lookups, rollups
from tessera.scan import ingest, scan

FILES = {
    "app/__init__.py": "",
    "app/store.py": "import os\n\nclass Store:\n    def load(self):\n        return self.query('SELECT a FROM users')\n\n    def query(self, q):\n        return os.getenv('DSN')\n",
    "app/api.py": "from .store import Store\nfrom fastapi import APIRouter\n\nrouter = APIRouter(prefix='/v1')\n\n@router.get('/users/{id}')\ndef users(id):\n    return make()\n\ndef make():\n    return Store()\n",
    "app/client.py": "import requests\n\ndef fetch(i):\n    return requests.get(f'/v1/users/{i}')\n",
    "tests/test_store.py": "from app.store import Store\n\ndef test_load():\n    assert Store().load() is None\n",
    "tests/test_none.py": "def test_nothing():\n    pass\n",
    "web/api.ts": "import { url } from './base';\n\nexport function load(id: string) {\n  return fetch(`/v1/users/${id}`);\n}\n",
    "web/base.ts": "export const url = () => { return process.env.DSN ?? 'x'; };\n",
    "db/001.sql": "CREATE TABLE users (id int PRIMARY KEY, a text);",
    "README.md": "# App\n\nSee `app/store.py` and `fetch`.\n",
    "bad.py": "def (\n",
    ".env.example": "DSN=x\nOTHER=y\n",
    "pyproject.toml": '[project]\nname = "app"\ndependencies = ["boto3>=1"]\n',
}


def test_scan(spark):
    files = spark.createDataFrame([("w", p, bytearray(t.encode())) for p, t in FILES.items()], "workspace_id string, path string, content binary")
    m = scan(files)
    edges = {(r["src"], r["dst"], r["kind"]): r for r in m.edges.collect()}
    assert m.edges.count() == m.edges.select("src", "dst", "kind", "source").distinct().count()
    for e in [
        ("w:app/api.py", "w:app/store.py", "imports"), ("w:tests/test_store.py", "w:app/store.py", "imports"), ("w:app/api.py#users", "w:app/api.py#make", "calls"), ("w:app/api.py#make", "w:app/store.py#Store", "calls"),
        ("w:app/store.py#Store.load", "w:app/store.py#Store.query", "calls"), ("w:tests/test_store.py#test_load", "w:app/store.py#Store", "tests"), ("w:app/client.py#fetch", "w:app/api.py#users", "http_calls"),
        ("w:app/store.py#Store.query", "env:DSN", "reads_env"), ("w:app/store.py", "table:users", "reads_table"), ("w:README.md", "w:app/store.py", "mentions"), ("w:README.md", "w:app/client.py#fetch", "mentions"),
        ("w:app/api.py", "package:app", "part_of"), ("w:web/api.ts#load", "w:app/api.py#users", "http_calls"), ("w:web/api.ts", "w:web/base.ts", "imports"), ("w:web/base.ts#url", "env:DSN", "reads_env"), ("package:app", "external:AWS", "depends_on"),
    ]:
        assert e in edges, e
    assert edges["w:app/store.py#Store.load", "w:app/store.py#Store.query", "calls"]["confidence"] == 0.6
    assert edges["w:app/client.py#fetch", "w:app/api.py#users", "http_calls"]["confidence"] == 0.9
    found = {(r["node_id"], r["kind"]) for r in m.diagnostics.collect()}
    assert ("w:bad.py", "parse_error") in found and ("w:tests/test_none.py", "unmatched_test") in found
    ids = [r["id"] for r in m.nodes.select("id").collect()]
    assert len(ids) == len(set(ids)) and {"env:OTHER", "table:users", "table:users#a", "w:app/", "w:app/api.py#users"} <= set(ids)
    assert "/v1/users/{id}" in lookups.resolve(m, "w:app/api.py#users").first()["attrs"]
    assert graph.top_hotspots(m, "fan_in", limit=1).first()["id"] == "w:app/store.py"
    lines = spark.createDataFrame([("cov", "app/store.py", 5, 1, "tests/test_store.py::test_load"), ("cov", "app/store.py", 8, 0, None), ("cov", "gone.py", 1, 1, None)], "artifact string, path string, line int, hits int, context string")
    results = spark.createDataFrame([("junit", "test_load", "tests.test_store > test_load", None, "passed", 3.0)], "artifact string, name string, chain string, file string, status string, duration_ms double")
    more = ingest(m, lines, results)
    assert rollups.coverage(more.coverage_lines).first()["percent"] == 50.0
    assert [(r["test_node_id"], r["status"]) for r in more.results.collect()] == [("w:tests/test_store.py#test_load", "passed")]
    assert ("w:tests/test_store.py#test_load", "w:app/store.py#Store.load") in {(r["src"], r["dst"]) for r in more.edges.filter("source = 'coverage'").collect()}


WIRED = {
    "lib/tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@core/*": ["core/*"]}},\n}\n',
    "lib/core/a.ts": "export function make() { return 1; }\nexport function other() { return 2; }\n",
    "lib/core/barrel.ts": "export { make as build } from './a';\nexport * from './deep';\n",
    "lib/core/deep.ts": "export { other } from './a';\n",
    "lib/use.ts": "import { build, other } from '@core/barrel';\nimport { make } from 'core/a';\nexport function go() { return build() + other() + make(); }\n",
    "lib/app/api/items/[id]/route.ts": "export async function GET() { return 1; }\n",
    "lib/page.tsx": "import { Card } from './card';\nexport function Page() { return <Card/>; }\nexport const routes = [{ path: '/home/:id', component: Page }];\n",
    "lib/card.tsx": "export function Card() { return <div/>; }\n",
    "lib/home.spec.ts": "it('opens', () => { cy.visit('/home/5'); });\n",
    "svc/repo.py": "class Repo:\n    def save(self, x):\n        return x\n",
    "svc/work.py": "from svc.repo import Repo\n\nclass Work:\n    def __init__(self, repo: Repo):\n        self.repo = repo\n\n    def run(self):\n        return self.repo.save(1)\n",
    "svc/tool.py": "print(1)\n",
    "svc/__init__.py": "",
    "tests/conftest.py": "import pytest\nfrom svc.work import Work\n\n@pytest.fixture\ndef base():\n    return Work(None)\n\n@pytest.fixture\ndef work(base):\n    return base\n",
    "tests/test_work.py": "import subprocess\nfrom unittest.mock import patch\n\ndef test_run(work):\n    with patch('svc.repo.Repo.save'):\n        subprocess.run(['python', 'svc/tool.py'])\n",
    "net/Store.cs": "namespace Net.Data;\npublic class Store\n{\n    public int Load() { return 1; }\n}\n",
    "net/Main.cs": "using Net.Data;\nnamespace Net.App;\npublic class Main\n{\n    private readonly Store store;\n    public int Go() { var s = new Store(); return store.Load(); }\n}\n",
}


def test_wired_facts(spark):
    files = spark.createDataFrame([("w", p, bytearray(t.encode())) for p, t in WIRED.items()], "workspace_id string, path string, content binary")
    m = scan(files)
    edges = {(r["src"], r["dst"], r["kind"]): r for r in m.edges.collect()}
    for e in [
        ("w:lib/use.ts", "w:lib/core/a.ts", "imports"), ("w:lib/use.ts#go", "w:lib/core/a.ts#make", "calls"), ("w:lib/use.ts#go", "w:lib/core/a.ts#other", "calls"), ("w:lib/use.ts", "w:lib/core/barrel.ts", "references"),
        ("w:lib/core/barrel.ts", "w:lib/core/a.ts", "imports"), ("w:lib/page.tsx#Page", "w:lib/card.tsx#Card", "calls"), ("w:svc/work.py#Work.run", "w:svc/repo.py#Repo.save", "calls"), ("w:net/Main.cs#Main.Go", "w:net/Store.cs#Store.Load", "calls"),
        ("w:net/Main.cs", "w:net/Store.cs", "imports"), ("w:tests/test_work.py#test_run", "w:svc/repo.py#Repo.save", "tests"), ("w:tests/test_work.py#test_run", "w:svc/tool.py", "tests"), ("w:tests/test_work.py#test_run", "w:svc/work.py#Work", "tests"),
        ("w:lib/home.spec.ts#opens", "w:lib/page.tsx#Page", "tests"),
    ]:
        assert e in edges, (e, sorted(k for k in edges if k[0] == e[0]))
    assert edges["w:lib/page.tsx#Page", "w:lib/card.tsx#Card", "calls"]["attrs"] == '{"via":"jsx"}'
    assert edges["w:svc/work.py#Work.run", "w:svc/repo.py#Repo.save", "calls"]["confidence"] == 0.6
    assert "/api/items/{id}" in lookups.resolve(m, "w:lib/app/api/items/[id]/route.ts#GET").first()["attrs"]
    assert m.edges.count() == m.edges.select("src", "dst", "kind", "source").distinct().count()
