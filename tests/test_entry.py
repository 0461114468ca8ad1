"""What the driver imports, with and without the training-data folders."""

import json
import os
import shutil
import subprocess
import sys

from tessera import cli
from test_graph import build


def test_names_agree():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 50


def test_entry_stands_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()), len(e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    llm, all_ = out.stdout.split()[-2:]
    assert llm == "0" and int(all_) > 50, out.stderr


def test_commands(spark, tmp_path, capsys):
    m = build(spark, {"a/x.py": "code", "b/y.py": "code"}, [("a/x.py", "b/y.py"), ("b/y.py", "a/x.py")], {"pa": ["a/x.py"], "pb": ["b/y.py"]})
    m.save(str(tmp_path))
    do = lambda *a: cli.main(["--model", str(tmp_path), "--format", "json", *a], spark)
    assert do("hotspots", "--limit", "1") == 0
    assert json.loads(capsys.readouterr().out)[0]["fan_in"] == 1
    assert do("deps", "--forbid", "pa->pb") == 1 and do("deps", "--forbid", "pa->none") == 1 and do("deps", "--forbid", "pa") == 2
    capsys.readouterr()
    assert do("query", "SELECT count(*) AS n FROM edges") == 0
    assert json.loads(capsys.readouterr().out) == [{"n": 4}]
    assert do("query", "DROP TABLE nodes") == 2 and do("show", "nothing") == 1 and do("orphans") == 0
