"""Python front end: symbols and facts of source texts, by the standard library's ``ast``."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1

SYMBOLS = "file string, qualname string, parent string, kind string, display_kind string, name string, start_line int, end_line int, signature string, doc string, content_hash string, place int"
FACTS = "file string, fact string, src string, name string, value string, extra string, line int"
PARSED = f"file string, error boolean, symbols array<struct<{', '.join(c.replace(' ', ':', 1) for c in SYMBOLS.split(', '))}>>, facts array<struct<{', '.join(c.replace(' ', ':', 1) for c in FACTS.split(', '))}>>"

#: Verbs of route decorators and of client calls.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
CLIENTS = ("requests", "httpx", "session", "client", "http")
#: Alternatives that one string expression may stand for.
MOST_VALUES = 64


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class _Reader(ast.NodeVisitor):
    """Collects symbols and facts; ``scope`` is the stack of enclosing definitions."""

    def __init__(self, file: str, source: str, is_test: bool):
        self.file, self.lines, self.is_test = file, source.splitlines(), is_test
        self.scope: list[tuple[str, str]] = []
        self.symbols: list[dict] = []
        self.facts: list[dict] = []
        self.constants: list[dict[str, set[str] | None]] = [{}]
        self.env_names, self.os_names = set(), {"os"}

    # helpers
    @property
    def owner(self) -> str:
        return ".".join(n for n, _ in self.scope)

    def fact(self, fact: str, name: str, value: str | None = None, extra: str | None = None, line: int | None = None) -> None:
        self.facts.append({"file": self.file, "fact": fact, "src": self.owner, "name": name, "value": value, "extra": extra, "line": line})

    def values(self, node: ast.AST | None) -> set[str] | None:
        """All texts an expression can be; None if unknown or too many."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return {node.value}
        if isinstance(node, ast.Name):
            for frame in reversed(self.constants):
                if node.id in frame:
                    return frame[node.id]
            return None
        if isinstance(node, ast.IfExp):
            return self._all([self.values(node.body), self.values(node.orelse)], lambda parts: parts[0] | parts[1])
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return self._all([self.values(node.left), self.values(node.right)], lambda p: {a + b for a in p[0] for b in p[1]})
        if isinstance(node, ast.JoinedStr):
            out = {""}
            for part in node.values:
                if isinstance(part, ast.FormattedValue):
                    got = self.values(part.value) or {"{" + (ast.unparse(part.value) if isinstance(part.value, ast.Name) else "value") + "}"}
                else:
                    got = {part.value}
                out = {a + b for a in out for b in got}
                if len(out) > MOST_VALUES:
                    return None
            return out
        return None

    def _all(self, parts, join):
        if any(p is None for p in parts):
            return None
        out = join(parts)
        return out if len(out) <= MOST_VALUES else None

    def assign(self, name: str, value: ast.AST | None) -> None:
        self.constants[-1][name] = self.values(value)

    def forget(self, body: list[ast.stmt]) -> None:
        """Names that a branch can write are unknown after it."""
        for s in body:
            for n in ast.walk(s):
                if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                    self.constants[-1][n.id] = None

    # definitions
    def _define(self, node, kind: str, display: str) -> None:
        parent = self.owner
        name = f"{parent}.{node.name}" if parent else node.name
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        if isinstance(node, ast.ClassDef):
            signature = f"class {node.name}" + (f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else "")
        else:
            signature = f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        body = "\n".join(self.lines[node.body[0].lineno - 1 : node.end_lineno])
        self.symbols.append({"file": self.file, "qualname": name, "parent": parent or None, "kind": kind, "display_kind": display, "name": node.name, "start_line": start, "end_line": node.end_lineno, "signature": signature, "doc": ast.get_docstring(node), "content_hash": hashlib.sha1(body.encode()).hexdigest(), "place": len(self.symbols)})

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        test = self.is_test and node.name.startswith("Test")
        self._define(node, "test" if test else "symbol", "test suite" if test else "class")
        self.fact("class", node.name, ",".join(filter(None, map(_dotted, node.bases))) or None, "protocol" if any((_dotted(b) or "").endswith("Protocol") for b in node.bases) else None, node.lineno)
        self._body(node, "class")

    def visit_FunctionDef(self, node) -> None:
        inside = self.scope[-1][1] if self.scope else ""
        test = self.is_test and node.name.startswith("test") and inside in ("", "class")
        fixture = any((_dotted(d.func if isinstance(d, ast.Call) else d) or "").endswith("fixture") for d in node.decorator_list)
        self._define(node, "test" if test else "symbol", "test case" if test else "fixture" if fixture else "method" if inside == "class" else "function")
        if test or fixture:
            self.scope.append((node.name, "function"))
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                if a.arg not in ("self", "cls"):
                    self.fact("fixture", a.arg, line=a.lineno)
            self.scope.pop()
        self._routes(node)
        if node.name == "__init__" and inside == "class":
            self._fields(node)
        self._body(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def _body(self, node, kind: str) -> None:
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append((node.name, kind))
        frame: dict[str, set[str] | None] = {}
        if kind == "function":
            frame = {a.arg: None for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)}
        self.constants.append(frame)
        for s in node.body:
            self.visit(s)
        self.constants.pop()
        self.scope.pop()

    def _fields(self, node) -> None:
        hints = {a.arg: ast.unparse(a.annotation) for a in node.args.args if a.annotation}
        for s in ast.walk(node):
            if isinstance(s, (ast.Assign, ast.AnnAssign)):
                target = s.targets[0] if isinstance(s, ast.Assign) else s.target
                if isinstance(target, ast.Attribute) and getattr(target.value, "id", "") == "self":
                    kind = ast.unparse(s.annotation) if isinstance(s, ast.AnnAssign) else hints.get(getattr(s.value, "id", "")) or (_dotted(s.value.func) if isinstance(s.value, ast.Call) else None)
                    if kind:
                        self.fact("field", target.attr, kind, line=s.lineno)

    def _routes(self, node) -> None:
        for d in node.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute)):
                continue
            path = self.values(d.args[0] if d.args else next((k.value for k in d.keywords if k.arg in ("path", "rule")), None))
            verb, router = d.func.attr, _dotted(d.func.value)
            methods = next((k.value for k in d.keywords if k.arg == "methods"), None)
            if verb in VERBS:
                names = [verb.upper()]
            elif verb in ("route", "api_route"):
                names = [m.value.upper() for m in methods.elts if isinstance(m, ast.Constant)] if isinstance(methods, (ast.List, ast.Tuple, ast.Set)) else ["GET"]
            else:
                continue
            for p in sorted(path or ()):
                for n in names:
                    self.scope.append((node.name, "function"))
                    self.fact("route", n, p, router, d.lineno)
                    self.scope.pop()

    # statements
    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.fact("import", a.name, a.asname or a.name.partition(".")[0], line=node.lineno)
            if a.name == "os":
                self.os_names.add(a.asname or "os")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        spec = "." * node.level + (node.module or "")
        for a in node.names:
            self.fact("import", spec, a.asname or a.name, a.name, node.lineno)
            if spec == "os" and a.name in ("environ", "getenv"):
                self.env_names.add(a.asname or a.name)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for t in node.targets:
            if isinstance(t, ast.Name):
                self._router(t.id, node.value)
                self.assign(t.id, node.value)
            else:
                self.forget([ast.Assign([t], node.value)])

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value:
            self.visit(node.value)
        if isinstance(node.target, ast.Name):
            self.assign(node.target.id, node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.visit(node.value)
        if isinstance(node.target, ast.Name):
            self.constants[-1][node.target.id] = None

    def _branches(self, node, bodies: list[list[ast.stmt]]) -> None:
        before = dict(self.constants[-1])
        for body in bodies:
            self.constants[-1] = dict(before)
            for s in body:
                self.visit(s)
        self.constants[-1] = before
        for body in bodies:
            self.forget(body)

    def visit_If(self, node: ast.If) -> None:
        self.visit(node.test)
        self._branches(node, [node.body, node.orelse])

    def visit_For(self, node) -> None:
        self.visit(node.iter)
        self.forget([node])
        self._branches(node, [node.body, node.orelse])

    visit_AsyncFor = visit_For

    def visit_While(self, node: ast.While) -> None:
        self.visit(node.test)
        self.forget(node.body)
        self._branches(node, [node.body, node.orelse])

    def visit_Try(self, node) -> None:
        self._branches(node, [node.body, *(h.body for h in node.handlers), node.orelse])
        for s in node.finalbody:
            self.visit(s)

    visit_TryStar = visit_Try

    def _router(self, name: str, value: ast.AST) -> None:
        if isinstance(value, ast.Call) and (_dotted(value.func) or "").rpartition(".")[2] in ("APIRouter", "Blueprint", "FastAPI", "Flask", "Starlette"):
            prefix = next((self.values(k.value) for k in value.keywords if k.arg in ("prefix", "url_prefix")), None) or {""}
            self.fact("router", name, sorted(prefix)[0], line=value.lineno)

    # expressions
    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name:
            head, _, rest = name.partition(".")
            shape = "this" if head in ("self", "cls") and rest else "member" if rest else "name"
            self.fact("call", rest.rpartition(".")[2] or head if shape != "name" else head, name, shape, node.lineno)
            self._special(node, name)
        for a in (*node.args, *(k.value for k in node.keywords)):
            if isinstance(a, ast.Name):
                self.fact("call", a.id, a.id, "reference", a.lineno)
        self.generic_visit(node)

    def _special(self, node: ast.Call, name: str) -> None:
        first = self.values(node.args[0]) if node.args else None
        owner, _, last = name.rpartition(".")
        env = (owner in {f"{o}.environ" for o in self.os_names} or owner in self.env_names) and last == "get" or last == "getenv" and (owner in self.os_names or name in self.env_names)
        if env and first:
            default = self.values(node.args[1]) if len(node.args) > 1 else None
            for v in sorted(first):
                self.fact("env", v, sorted(default)[0] if default else None, line=node.lineno)
        elif last in ("open", "read_text", "read_bytes", "spec_from_file_location"):
            inner = node.func.value if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call) else None
            where = self.values(inner.args[0]) if inner is not None and inner.args else first
            for v in sorted(where or ()):
                self.fact("read", v, line=node.lineno)
        elif last == "patch" and first:
            for v in sorted(first):
                self.fact("patch", v, line=node.lineno)
        elif last in VERBS and owner.rpartition(".")[2] in CLIENTS:
            for v in sorted(first or ()):
                self.fact("client", last.upper(), v, line=node.lineno)
            if not first:
                self.fact("client-unresolved", last.upper(), line=node.lineno)
        elif last in ("include_router", "register_blueprint", "mount"):
            prefix = next((self.values(k.value) for k in node.keywords if k.arg in ("prefix", "url_prefix")), None) or (first if last == "mount" else None) or {""}
            child = _dotted(node.args[1] if last == "mount" and len(node.args) > 1 else node.args[0]) if node.args else None
            if child:
                self.fact("mount", child, sorted(prefix)[0], owner, node.lineno)
        elif last == "add_url_rule" and first:
            view = next((_dotted(k.value) for k in node.keywords if k.arg == "view_func"), None)
            for v in sorted(first):
                self.fact("route", "GET", v, view, node.lineno)
        elif last in ("run", "Popen", "check_output", "check_call", "call") and owner == "subprocess" and node.args:
            argv = [self.values(e) for e in node.args[0].elts] if isinstance(node.args[0], (ast.List, ast.Tuple)) else [first]
            for v in sorted(x for got in argv for x in got or ()):
                self.fact("launch", v, line=node.lineno)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        name = _dotted(node.value)
        if isinstance(node.ctx, ast.Load) and (name in {f"{o}.environ" for o in self.os_names} or name in self.env_names):
            for v in sorted(self.values(node.slice) or ()):
                self.fact("env", v, line=node.lineno)
        self.generic_visit(node)


def parse(file: str, source: str, is_test: bool = False) -> tuple[list[dict], list[dict], bool]:
    """Symbols, facts, and whether the text could not be read."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [], [], True
    reader = _Reader(file, source, is_test)
    reader.visit(tree)
    return reader.symbols, reader.facts, False


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file (id, text, role): error, symbols and facts as arrays of structs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f, text, role in zip(frame["id"], frame["text"], frame["role"], strict=True):
                symbols, facts, bad = parse(f, text or "", role == "test")
                rows.append((f, bad, symbols, facts))
            yield pd.DataFrame(rows, columns=["file", "error", "symbols", "facts"])

    return files.select("id", "text", "role").mapInPandas(run, PARSED)


def symbols(parsed: DataFrame) -> DataFrame:
    """Symbol and test nodes with their ids."""
    from tessera.operators.binding import disambiguate

    rows = disambiguate(parsed.select(F.explode("symbols").alias("s")).select("s.*"))
    parents = rows.groupBy("file", "qualname").agg(F.min("id").alias("parent_id")).withColumnRenamed("qualname", "parent")
    return rows.join(parents, ["file", "parent"], "left").withColumn("parent_id", F.coalesce("parent_id", "file"))


def facts(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.select(F.explode("facts").alias("f")).select("f.*").filter(F.col("fact") == kind)


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error").select(F.col("file").alias("node_id"), F.lit("parse_error").alias("kind"), F.lit("the text could not be parsed").alias("detail"))


def dump(file: str, source: str) -> str:
    """Symbols and facts as JSON lines, for golden tests."""
    found, said, _ = parse(file, source)
    return "\n".join(json.dumps(x, sort_keys=True) for x in [*found, *said])
