"""Front ends for languages with braces: JavaScript, TypeScript, Vue components and C#.

They read declarations and the facts that resolution needs from masked text (comments blanked,
strings kept as holes), by patterns and matching braces. That is less than a full grammar:
what a pattern does not see is left out, never guessed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.parse.python_ast import PARSED

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_WORD = r"[A-Za-z_$][\w$]*"

#: Words before a bracket that are no calls.
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "super", "import", "require", "constructor", "foreach", "using", "lock", "nameof", "sizeof", "when", "fixed"}
_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


class Source:
    """A text with its masked twin of equal length, line numbers, and where braces close."""

    def __init__(self, text: str):
        self.text = text

        def blank(m: re.Match) -> str:
            keep = m[0][0] in "\"'`"
            inner = re.sub(r"[^\n]", " ", m[0])
            return m[0][0] + inner[1:-1] + m[0][0] if keep and len(m[0]) > 1 else inner

        self.masked = _SKIP.sub(blank, text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.close: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[{}()\[\]]", self.masked):
            c = m[0]
            if c in "{([":
                stack.append((c, m.start()))
            elif stack and {"}": "{", ")": "(", "]": "["}[c] == stack[-1][0]:
                self.close[stack.pop()[1]] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def string(self, at: int) -> str | None:
        """The literal that starts at or after white space from ``at``; template holes become parameters."""
        m = re.compile(r"\s*([\"'`])").match(self.text, at)
        if not m:
            return None
        end = self.masked.find(m[1], m.end())
        value = self.text[m.end() : end]
        return re.sub(r"\$\{\s*(?:[\w$.]*?\.)?([\w$]+)[^}]*\}", r"{\1}", value) if m[1] == "`" else value

    def body(self, at: int) -> tuple[int, int] | None:
        """The first block from ``at`` before a statement ends, as (open, close)."""
        m = re.compile(r"[^{};]*\{").match(self.masked, at)
        if m and (end := self.close.get(m.end() - 1)) is not None:
            return m.end() - 1, end
        return None


class _Tree:
    def __init__(self, file: str, source: Source):
        self.file, self.source = file, source
        self.found: list[tuple[int, int, str, str, str, str]] = []  # start, end, name, kind, display, signature
        self.facts: list[dict] = []
        self.names: set[int] = set()  # where methods are declared: no calls

    def add(self, start: int, end: int, name: str, display: str, kind: str = "symbol", signature: str = "") -> None:
        self.found.append((start, end, name, kind, display, " ".join(signature.split())))

    def nest(self) -> list[dict]:
        """Symbols with qualified names: each inside the smallest span around it."""
        out, stack = [], []
        for start, end, name, kind, display, signature in sorted(set(self.found), key=lambda x: (x[0], -x[1])):
            while stack and stack[-1][1] < end:
                stack.pop()
            parent = stack[-1][2] if stack else None
            mark = " > " if kind == "test" and stack and stack[-1][3] == "test" else "."
            full = f"{parent}{mark}{name}" if parent else name
            body = self.source.text[start : end + 1]
            out.append({"file": self.file, "qualname": full, "parent": parent, "kind": kind, "display_kind": display, "name": name, "start_line": self.source.line(start), "end_line": self.source.line(end), "signature": signature, "doc": self._doc(start), "content_hash": hashlib.sha1(body.encode()).hexdigest(), "place": len(out)})
            stack.append((start, end, full, kind))
        self.spans = [(s["start_line"], s["end_line"], s["qualname"]) for s in out]
        return out

    def _doc(self, start: int) -> str | None:
        m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:@\w+[^\n]*\s*|export\s+|default\s+|\[[^\]]*\]\s*)*$", self.source.text[max(0, start - 2000) : start], re.S)
        return " ".join(re.sub(r"(?m)^\s*\* ?", "", m[1]).split()) if m else None

    def fact(self, fact: str, name: str, value: str | None = None, extra: str | None = None, at: int = 0) -> None:
        line = self.source.line(at)
        inside = [s for s in self.spans if s[0] <= line <= s[1]]
        owner = min(inside, key=lambda s: (s[1] - s[0], s[2]))[2] if inside else ""
        self.facts.append({"file": self.file, "fact": fact, "src": owner, "name": name, "value": value, "extra": extra, "line": line})


def parse_script(file: str, text: str, is_test: bool = False) -> tuple[list[dict], list[dict], bool]:
    """Symbols and facts of a JavaScript or TypeScript text."""
    s = Source(text)
    t = _Tree(file, s)
    m_ = s.masked
    for m in re.finditer(rf"\b(class|interface|enum)\s+({_WORD})[^{{;]*\{{", m_):
        if (end := s.close.get(m.end() - 1)) is not None:
            t.add(m.start(), end, m[2], m[1], signature=text[m.start() : m.end() - 1])
            if m[1] == "class":
                for k in re.finditer(rf"(?m)^\s*(?:(?:public|private|protected|static|async|override|get|set|readonly)\s+)*(#?{_WORD})\s*(?:<[^>(]*>)?\(", m_[m.end() : end]):
                    a = m.end() + k.start(1)
                    close = s.close.get(m.end() + k.end() - 1)
                    block = s.body(close + 1) if close and re.match(r"\s*(?::[^{;=]*)?\{", m_[close + 1 :]) else None
                    if block and k[1] not in _KEYWORDS - {"constructor"}:
                        t.names.add(a)
                        t.add(a, block[1], k[1], "method", signature=text[a : close + 1])
    for m in re.finditer(rf"\bfunction\s*\*?\s*({_WORD})\s*(?:<[^>(]*>)?\(", m_):
        close = s.close.get(m.end() - 1)
        block = s.body(close + 1) if close else None
        if block:
            t.add(m.start(), block[1], m[1], _shown(m[1], m_[block[0] : block[1]]), signature=text[m.start() : close + 1])
    for m in re.finditer(rf"\b(?:const|let|var)\s+({_WORD})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^>(]*>)?(\(|{_WORD}\s*=>|function\b)", m_):
        at = m.start(2)
        close = s.close.get(at) if m_[at] == "(" else at
        arrow = re.compile(r"\s*(?::[^={]*)?=>\s*|[^{]*").match(m_, (close or at) + 1)
        if m_[at] == "(" and "=>" not in arrow[0]:
            continue
        block = s.body(arrow.end()) if m_[arrow.end() : arrow.end() + 1] == "{" or m[2] == "function" else None
        end = block[1] if block else next((i for i in range(arrow.end(), len(m_)) if m_[i] in ";\n" and not any(o < i < c for o, c in s.close.items() if o >= at)), len(m_) - 1)
        t.add(m.start(), end, m[1], _shown(m[1], m_[at:end]), signature=text[m.start() : (close or at) + 1])
    for m in re.finditer(r"\b(describe|context|it|test)(?:\.(?:only|skip|each\([^)]*\)))?\s*\(", m_):
        name = s.string(m.end())
        end = s.close.get(m.end() - 1)
        if is_test and name is not None and end:
            t.add(m.start(), end, name, "test suite" if m[1] in ("describe", "context") else "test case", "test", m[1])
    symbols = t.nest()
    for m in re.finditer(r"\bimport\s+(type\s+)?([^;'\"]*?)\bfrom\s*[\"']|\bimport\s*[\"']|\bimport\s*\(\s*[\"']|\brequire\s*\(\s*[\"']", m_):
        spec = s.string(m.end() - 1)
        names = re.findall(rf"({_WORD})(?:\s+as\s+({_WORD}))?", re.sub(r"\btype\s+", "", m[2] or ""))
        for name, local in names or [(None, None)]:
            t.fact("import", spec, local or name, name, m.start())
    for m in re.finditer(r"\bexport\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*[\"']", m_):
        spec = s.string(m.end() - 1)
        for name, shown in re.findall(rf"(\*|{_WORD})(?:\s+as\s+({_WORD}))?", m[1]):
            t.fact("reexport", spec, shown or name, name, m.start())
    for m in re.finditer(r"\b(?:process\.env|import\.meta\.env)(?:\.(\w+)|\[\s*(?=[\"']))", m_):
        name = m[1] or s.string(m.end())
        default = re.compile(r"\s*\]?\s*(?:\?\?|\|\|)\s*(?=[\"'`])").match(m_, m.end() if m[1] else m_.find("]", m.end()))
        t.fact("env", name, s.string(default.end()) if default else None, at=m.start())
    for m in re.finditer(rf"\b(?:({_WORD})\s*\.\s*)?({_WORD})\s*(?:<[^>()]*>)?\(", m_):
        owner, name = m[1], m[2]
        if name in _KEYWORDS or m.start(2) in t.names or re.search(r"\bfunction\s*\*?\s*$", m_[: m.start()]):
            continue
        first = s.string(m.end())
        args = text[m.end() : s.close.get(m.end() - 1, m.end())]
        if name == "fetch" and first is not None:
            verb = re.search(r"method\s*:\s*[\"'](\w+)", args)
            t.fact("client", (verb[1] if verb else "GET").upper(), first, at=m.start())
        elif name in _VERBS and first is not None and first.startswith(("/", "http")):
            if owner in ("axios", "ky", "http", "api", "client", "$http", "request"):
                t.fact("client", name.upper(), first, at=m.start())
            else:
                handler = re.findall(rf"({_WORD}(?:\.{_WORD})*)\s*$", args.rstrip().rstrip(","))
                t.fact("route", name.upper(), first, f"{owner}|{handler[-1] if handler else ''}", m.start())
        elif name == "use" and owner and first is not None:
            child = re.search(rf"({_WORD})\s*$", args)
            if child:
                t.fact("mount", child[1], first, owner, m.start())
        elif name == "visit" and owner == "cy" and first is not None:
            t.fact("visit", re.sub(r"\{[^}]*\}", "*", first), at=m.start())
        elif name in ("readFileSync", "readFile") and first is not None:
            t.fact("read", first, at=m.start())
        t.fact("call", name, f"{owner}.{name}" if owner else name, "this" if owner == "this" else "member" if owner else "name", m.start())
    for m in re.finditer(rf"\{{\s*path\s*:\s*(?=[\"'`])", m_):
        end = s.close.get(m.start(), m.end())
        rest = text[m.end() : end]
        shown = re.search(rf"\b(?:component|element)\s*:\s*(?:<)?({_WORD}|\(\)\s*=>\s*import\([\"']([^\"']+))", rest)
        redirect = re.search(r"\bredirect\s*:\s*[\"']([^\"']+)", rest)
        t.fact("client-route", s.string(m.end()), (shown[2] or shown[1]) if shown else None, redirect[1] if redirect else None, m.start())
    for m in re.finditer(r"<Route\b[^>]*?\bpath=(?=[\"'])", m_):
        shown = re.compile(rf"[^>]*?element=\{{\s*<({_WORD})").search(text, m.end())
        t.fact("client-route", s.string(m.end()), shown[1] if shown else None, at=m.start())
    if "</" in text or "/>" in text:
        for m in re.finditer(r"(?<![\w.])<([A-Z][\w.]*)[\s/>]", m_):
            t.fact("render", m[1].rpartition(".")[2], at=m.start())
    return symbols, t.facts, False


def _shown(name: str, body: str) -> str:
    return "component" if name[:1].isupper() and re.search(r"<[A-Za-z>/]", body) else "function"


def parse_vue(file: str, text: str, is_test: bool = False) -> tuple[list[dict], list[dict], bool]:
    """Script blocks at their lines, what the template renders, and links to the API."""
    symbols: list[dict] = []
    facts: list[dict] = []
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S):
        more, said, _ = parse_script(file, "\n" * text.count("\n", 0, m.start(1)) + m[1], is_test)
        symbols += [x | {"place": len(symbols) + x["place"]} for x in more]
        facts += said
    template = re.search(r"<template\b[^>]*>(.*)</template>", text, re.S)
    if template:
        first = text.count("\n", 0, template.start(1)) + 1
        for m in re.finditer(r"<([A-Z]\w*|[a-z]+(?:-[a-z0-9]+)+)\b", template[1]):
            name = "".join(p.capitalize() for p in m[1].split("-")) if "-" in m[1] else m[1]
            facts.append({"file": file, "fact": "render", "src": "", "name": name, "value": None, "extra": None, "line": first + template[1].count("\n", 0, m.start())})
        for m in re.finditer(r"\bhref=\"(/api/[^\"]*)\"", template[1]):
            facts.append({"file": file, "fact": "client", "src": "", "name": "GET", "value": m[1], "extra": None, "line": first + template[1].count("\n", 0, m.start())})
    return symbols, facts, False


_TEST_MARKS = r"\b(Fact|Theory|Test|TestCase|TestMethod|DataTestMethod)\b"


def parse_csharp(file: str, text: str, is_test: bool = False) -> tuple[list[dict], list[dict], bool]:
    """Types, members, test attributes, usings, routes of attributes and of minimal APIs, settings that are read."""
    s = Source(text)
    t = _Tree(file, s)
    m_ = s.masked
    types: list[tuple[int, int, str, str]] = []
    for m in re.finditer(rf"\b(class|interface|record|struct|enum)\s+({_WORD})[^{{;]*\{{", m_):
        end = s.close.get(m.end() - 1)
        if end is None:
            continue
        t.add(m.start(), end, m[2], m[1], signature=text[m.start() : m.end() - 1])
        marks = re.search(r"((?:\[[^\]]*\]\s*)+)(?:\w+\s+)*$", m_[: m.start()])
        types.append((m.end(), end, m[2], text[marks.start(1) : marks.end(1)] if marks else ""))
    routes = []
    for start, end, owner, marks in types:
        prefix = re.search(r"\bRoute\(\"([^\"]*)\"", marks)
        base = (prefix[1] if prefix else "").replace("[controller]", owner.removesuffix("Controller").lower())
        for k in re.finditer(rf"(?m)^\s*((?:\[[^\]\n]*\]\s*)*)(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|partial)\s+)+(?:[\w<>\[\],.?]+\s+)?({_WORD})\s*(?:<[^>(]*>)?\(", m_[start:end]):
            a, close = start + k.start(2), s.close.get(start + k.end() - 1)
            if close is None or k[2] in _KEYWORDS:
                continue
            block = s.body(close + 1) if re.match(r"\s*(?:where[^{]*)?\{", m_[close + 1 :]) else None
            arrow = re.compile(r"\s*=>[^;]*;").match(m_, close + 1)
            if not block and not arrow:
                continue
            attrs = text[start + k.start(1) : start + k.end(1)]
            t.names.add(a)
            test = re.search(_TEST_MARKS, attrs)
            t.add(a, block[1] if block else arrow.end() - 1, k[2], "test case" if test else "method", "test" if test else "symbol", text[a : close + 1])
            for v, inner in re.findall(r"\bHttp(Get|Post|Put|Patch|Delete)(?:\(\"([^\"]*)\")?", attrs):
                routes.append((v.upper(), "/".join(x.strip("/") for x in (base, inner) if x), a))
        for k in re.finditer(rf"\b(?:private|protected|public)\s+(?:readonly\s+)([\w<>]+)\s+({_WORD})\s*;", m_[start:end]):
            routes.append(("", f"{k[2]}={k[1]}", start + k.start()))
    symbols = t.nest()
    for verb, path, at in routes:
        if verb:
            t.fact("route", verb, "/" + path.strip("/"), at=at)
        else:
            name, _, kind = path.partition("=")
            t.fact("field", name, kind, at=at)
    for m in re.finditer(r"\bMap(Get|Post|Put|Patch|Delete)\s*\(", m_):
        if (path := s.string(m.end())) is not None:
            t.fact("route", m[1].upper(), path, at=m.start())
    for m in re.finditer(r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", m_):
        t.fact("using", m[1], at=m.start())
    for m in re.finditer(r"\bnamespace\s+([\w.]+)", m_):
        t.fact("namespace", m[1], at=m.start())
    for m in re.finditer(r"\bEnvironment\.GetEnvironmentVariable\s*\(|\b[Cc]onfiguration\s*\[", m_):
        if name := s.string(m.end()):
            t.fact("env", name, at=m.start())
    for m in re.finditer(rf"\bnew\s+({_WORD})", m_):
        t.fact("construct", m[1], at=m.start())
    for m in re.finditer(rf"\b(?:({_WORD})\s*\.\s*)?({_WORD})\s*(?:<[\w, ]*>)?\(", m_):
        if m[2] not in _KEYWORDS and m.start(2) not in t.names:
            t.fact("call", m[2], f"{m[1]}.{m[2]}" if m[1] else m[2], "this" if m[1] == "this" else "member" if m[1] else "name", m.start())
    return symbols, t.facts, False


PARSERS = {"javascript": parse_script, "typescript": parse_script, "tsx": parse_script, "vue": parse_vue, "csharp": parse_csharp}


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file (id, text, role, lang) of these languages, as the Python front end has them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f, text, role, lang in zip(frame["id"], frame["text"], frame["role"], frame["lang"], strict=True):
                symbols, facts, bad = PARSERS[lang](f, text or "", role == "test")
                rows.append((f, bad, symbols, facts))
            yield pd.DataFrame(rows, columns=["file", "error", "symbols", "facts"])

    return files.filter(files.lang.isin(*PARSERS)).select("id", "text", "role", "lang").mapInPandas(run, PARSED)
