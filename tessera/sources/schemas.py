"""Database schemas: SQL DDL and five ORM dialects, as rows of tables with columns."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMN = "name string, type string, nullable boolean, pk boolean, unique boolean, default string"
TABLE = f"path string, name string, model string, columns array<struct<{COLUMN.replace(' string', ':string').replace(' boolean', ':boolean')}>>, keys array<struct<column:string,table:string,target:string>>"


def _column(name: str, kind: str = "", nullable: bool = True, pk: bool = False, unique: bool = False, default: str | None = None) -> dict:
    return {"name": name, "type": kind, "nullable": nullable and not pk, "pk": pk, "unique": unique, "default": default}


def _table(name: str, model: str | None, columns: list[dict], keys: list[tuple[str, str, str]]) -> dict:
    return {"name": name, "model": model, "columns": columns, "keys": [dict(zip(("column", "table", "target"), k, strict=True)) for k in keys]}


# --- SQL -------------------------------------------------------------------------------------

_NAME = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w$]+)'
_QUALIFIED = rf"{_NAME}(?:\s*\.\s*{_NAME})*"


def _plain(name: str) -> str:
    return re.findall(_NAME, name)[-1].strip('"`[]')


def mask_comments(sql: str) -> str:
    """Comments as blanks of equal length; strings are left alone."""
    return re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", lambda m: m[0] if m[0][0] == "'" else re.sub(r"[^\n]", " ", m[0]), sql, flags=re.S)


def _body(text: str, at: int) -> tuple[str, int]:
    """What the bracket at ``at`` holds, and where it ends."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


def _items(body: str) -> list[str]:
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            out.append(body[last:i].strip())
            last = i + 1
    return [x for x in [*out, body[last:].strip()] if x]


def _names(text: str) -> list[str]:
    return [_plain(n) for n in re.findall(_NAME, text)]


def parse_ddl(sql: str) -> list[dict]:
    """Tables of CREATE TABLE and ALTER TABLE ... FOREIGN KEY statements."""
    text, tables = mask_comments(sql), {}
    for m in re.finditer(rf"\bCREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QUALIFIED})\s*\(", text, re.I):
        columns, keys, pks, uniques = [], [], set(), set()
        for item in _items(_body(text, m.end() - 1)[0]):
            rule = re.sub(rf"^CONSTRAINT\s+{_NAME}\s+", "", item, flags=re.I)
            if k := re.match(r"PRIMARY\s+KEY\s*\(([^)]*)\)", rule, re.I):
                pks |= set(_names(k[1]))
            elif k := re.match(rf"UNIQUE\s*(?:{_NAME}\s*)?\(([^)]*)\)", rule, re.I):
                names = _names(k[1])
                uniques |= set(names if len(names) == 1 else [])
            elif k := re.match(rf"FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", rule, re.I):
                target = _names(k[3] or "") or [""] * len(_names(k[1]))
                keys += [(c, _plain(k[2]), t) for c, t in zip(_names(k[1]), target, strict=False)]
            elif re.match(r"(CHECK|EXCLUDE|INDEX|KEY)\b", rule, re.I):
                continue
            elif k := re.match(rf"({_NAME})\s+([A-Za-z_][\w ]*?(?:\s*\([^)]*\))?(?:\s*\[\])?)(?=\s+(?:NOT|NULL|PRIMARY|UNIQUE|DEFAULT|REFERENCES|CHECK|CONSTRAINT|COLLATE|GENERATED|AUTO_INCREMENT|IDENTITY)\b|\s*$)", item, re.I):
                rest = item[k.end() :]
                default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|[^\s,(]+(?:\([^)]*\))?)", rest, re.I)
                columns.append(_column(_plain(k[1]), k[2].strip(), not re.search(r"\bNOT\s+NULL\b", rest, re.I), bool(re.search(r"\bPRIMARY\s+KEY\b", rest, re.I)), bool(re.search(r"\bUNIQUE\b", rest, re.I)), default[1] if default else None))
                if r := re.search(rf"\bREFERENCES\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", rest, re.I):
                    keys.append((_plain(k[1]), _plain(r[1]), (_names(r[2] or "") or [""])[0]))
        for c in columns:
            c["pk"] |= c["name"] in pks
            c["unique"] |= c["name"] in uniques
            c["nullable"] &= not c["pk"]
        tables[_plain(m[1])] = _table(_plain(m[1]), None, columns, keys)
    for m in re.finditer(rf"\bALTER\s+TABLE\s+(?:ONLY\s+)?({_QUALIFIED})\s+ADD\s+(?:CONSTRAINT\s+{_NAME}\s+)?FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", text, re.I):
        name = _plain(m[1])
        target = _names(m[4] or "") or [""] * len(_names(m[2]))
        keys = [(c, _plain(m[3]), t) for c, t in zip(_names(m[2]), target, strict=False)]
        tables.setdefault(name, _table(name, None, [], []))["keys"] += _table("", None, [], keys)["keys"]
    return list(tables.values())


# --- ORMs ----------------------------------------------------------------------------------------


def _text(node: ast.AST | None):
    return node.value if isinstance(node, ast.Constant) else None


def _called(node: ast.AST) -> str:
    f = node.func if isinstance(node, ast.Call) else node
    return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""


def parse_sqlalchemy(source: str) -> list[dict]:
    out = []
    for cls in (n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.ClassDef)):
        name, columns, keys = None, [], []
        for s in cls.body:
            target = s.targets[0] if isinstance(s, ast.Assign) else s.target if isinstance(s, ast.AnnAssign) else None
            if not isinstance(target, ast.Name) or s.value is None:
                continue
            if target.id == "__tablename__":
                name = _text(s.value)
            elif isinstance(s.value, ast.Call) and _called(s.value) in ("Column", "mapped_column"):
                call, hint = s.value, ast.unparse(s.annotation) if isinstance(s, ast.AnnAssign) else ""
                option = {k.arg: _text(k.value) for k in call.keywords}
                args = [a for a in call.args if not isinstance(a, ast.Constant)]
                shown = _text(call.args[0]) if call.args and isinstance(call.args[0], ast.Constant) else target.id
                for a in args:
                    if _called(a) == "ForeignKey" and isinstance(a, ast.Call) and a.args and isinstance(_text(a.args[0]), str):
                        table, _, column = _text(a.args[0]).rpartition(".")
                        keys.append((shown, table.rpartition(".")[2], column))
                kinds = [ast.unparse(a) for a in args if _called(a) != "ForeignKey"]
                inner = re.sub(r"^Mapped\[(.*)\]$", r"\1", hint)
                optional = bool(re.search(r"Optional\[|\|\s*None", inner))
                default = next((str(option[k]) for k in ("default", "server_default") if option.get(k) is not None), None)
                columns.append(_column(shown, kinds[0] if kinds else re.sub(r"Optional\[(.*)\]|\s*\|\s*None", r"\1", inner), option.get("nullable", optional if hint else True), bool(option.get("primary_key")), bool(option.get("unique")), default))
        if name:
            out.append(_table(name, cls.name, columns, keys))
    return out


def parse_django(source: str, app: str = "") -> list[dict]:
    out = []
    for cls in (n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.ClassDef)):
        if not any(ast.unparse(b) in ("models.Model", "Model") for b in cls.bases):
            continue
        name, columns, keys = f"{app}_{cls.name.lower()}" if app else cls.name.lower(), [], []
        for s in cls.body:
            if isinstance(s, ast.ClassDef) and s.name == "Meta":
                name = next((_text(a.value) for a in s.body if isinstance(a, ast.Assign) and getattr(a.targets[0], "id", "") == "db_table"), name)
            if not (isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and isinstance(s.targets[0], ast.Name)):
                continue
            kind, field, option = _called(s.value), s.targets[0].id, {k.arg: _text(k.value) for k in s.value.keywords}
            if kind in ("ForeignKey", "OneToOneField") and s.value.args:
                to = _text(s.value.args[0]) or ast.unparse(s.value.args[0])
                field = option.get("db_column") or f"{field}_id"
                keys.append((field, to.rpartition(".")[2].lower(), "id"))
            elif not kind.endswith("Field") or kind == "ManyToManyField":
                continue
            default = option.get("default")
            columns.append(_column(option.get("db_column") or field, kind, bool(option.get("null")), bool(option.get("primary_key")), bool(option.get("unique")) or kind == "OneToOneField", None if default is None else str(default)))
        if not any(c["pk"] for c in columns):
            columns.insert(0, _column("id", "AutoField", False, True))
        out.append(_table(name, cls.name, columns, keys))
    return out


def parse_prisma(source: str) -> list[dict]:
    models = {m[1]: m[2] for m in re.finditer(r"^model\s+(\w+)\s*\{(.*?)^\}", re.sub(r"//[^\n]*", "", source), re.S | re.M)}
    mapped = {m: (re.search(r'@@map\(\s*"([^"]+)"', body) or [None, m])[1] for m, body in models.items()}
    out = []
    for model, body in models.items():
        columns, keys, shown = [], [], {}
        ids = set(_names((re.search(r"@@id\(\s*\[([^\]]*)\]", body) or ["", ""])[1]))
        lines = [re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$", x) for x in body.splitlines()]
        for m in filter(None, lines):
            field, kind, many, optional, rest = m.groups()
            if kind in models or many:
                continue
            shown[field] = (re.search(r'(?<!@)@map\(\s*"([^"]+)"', rest) or [None, field])[1]
            default = re.search(r"@default\(((?:[^()]|\([^)]*\))*)\)", rest)
            columns.append(_column(shown[field], kind, bool(optional), "@id" in rest.replace("@@id", "") or field in ids, "@unique" in rest, default[1] if default else None))
        for m in filter(None, lines):
            relation = re.search(r"@relation\(.*?fields:\s*\[([^\]]*)\].*?references:\s*\[([^\]]*)\]", m[5])
            if m[2] in models and relation:
                keys += [(shown.get(a, a), mapped[m[2]], b) for a, b in zip(_names(relation[1]), _names(relation[2]), strict=False)]
        out.append(_table(mapped[model], model, columns, keys))
    return out


def parse_typeorm(source: str) -> list[dict]:
    out = []
    for m in re.finditer(r"@Entity\(([^)]*)\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*\{(.*?)^\}", source, re.S | re.M):
        named = re.search(r"['\"]([^'\"]+)['\"]", m[1])
        columns, keys = [], []
        for d in re.finditer(r"((?:@\w+\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*)+)(?:public\s+|private\s+|readonly\s+)*(\w+)([?!])?\s*:\s*([\w\[\]<>| ]+)", m[3]):
            marks, field, optional, kind = d.groups()
            if re.search(r"@(Column|PrimaryColumn|PrimaryGeneratedColumn|CreateDateColumn|UpdateDateColumn)\b", marks):
                name = re.search(r"name:\s*['\"]([^'\"]+)['\"]", marks)
                default = re.search(r"default:\s*([^,}]+)", marks)
                columns.append(_column(name[1] if name else field, kind.strip(), bool(re.search(r"nullable:\s*true", marks)) or optional == "?", "@Primary" in marks, bool(re.search(r"unique:\s*true", marks)), default[1].strip().strip("'\"") if default else None))
            elif r := re.search(r"@(?:ManyToOne|OneToOne)\(\s*\(\)\s*=>\s*(\w+)", marks):
                join = re.search(r"@JoinColumn\(.*?name:\s*['\"]([^'\"]+)['\"]", marks, re.S)
                keys.append((join[1] if join else f"{field}Id", r[1].lower(), "id"))
        out.append(_table(named[1] if named else m[2].lower(), m[2], columns, keys))
    return out


def parse_ef_core(source: str) -> list[dict]:
    sets = {m[1]: m[2] for m in re.finditer(r"DbSet<(\w+)>\s+(\w+)", source)}
    out = []
    for m in re.finditer(r"((?:\[[^\]]*\]\s*)*)public\s+(?:partial\s+|sealed\s+)?class\s+(\w+)[^{]*\{(.*?)^\}", source, re.S | re.M):
        table = re.search(r'\[Table\("([^"]+)"', m[1])
        if not table and m[2] not in sets:
            continue
        columns, keys = [], []
        for p in re.finditer(r"((?:\[[^\]]*\]\s*)*)public\s+(?:virtual\s+|required\s+)?([\w<>\[\]]+)(\?)?\s+(\w+)\s*\{\s*get;", m[3]):
            marks, kind, optional, field = p.groups()
            if kind in sets or kind.startswith(("ICollection", "List", "IEnumerable")):
                continue
            name = re.search(r'\[Column\("([^"]+)"', marks)
            pk = "[Key]" in marks or field in ("Id", f"{m[2]}Id")
            columns.append(_column(name[1] if name else field, kind, bool(optional) and "[Required]" not in marks, pk))
            owner = field[:-2]
            if field.endswith("Id") and owner in sets and not pk:
                keys.append((name[1] if name else field, sets[owner].lower(), "id"))
        out.append(_table(table[1] if table else sets[m[2]], m[2], columns, keys))
    return out


def parse_schema(path: str, source: str) -> list[dict]:
    """Tables of a file, by its ending and what it mentions; none where it cannot be read."""
    try:
        if path.endswith(".sql"):
            return parse_ddl(source)
        if path.endswith(".prisma"):
            return parse_prisma(source)
        if path.endswith(".py"):
            if "models.Model" in source:
                return parse_django(source, path.split("/")[-2] if path.endswith("models.py") and "/" in path else "")
            return parse_sqlalchemy(source) if "__tablename__" in source else []
        if path.endswith((".ts", ".js")) and "@Entity" in source:
            return parse_typeorm(source)
        if path.endswith(".cs") and ("DbSet<" in source or "[Table(" in source):
            return parse_ef_core(source)
    except SyntaxError:
        pass
    return []


def read_schemas(files: DataFrame) -> DataFrame:
    """Tables declared in files (path, text): one row per table with its columns and foreign keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p, **t} for p, s in zip(frame["path"], frame["text"], strict=True) for t in parse_schema(p, s or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "model", "columns", "keys"])

    return files.select("path", "text").mapInPandas(run, TABLE)


def merge_declarations(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns (table, column, type, nullable, pk, unique, default) and keys (table, column, to_table, to_column), of all declarations together.

    Tables are told apart in lower case; nullable needs all declarations, pk and unique one;
    type and default are the first stated, by path. Keys to unknown tables stay, as stubs.
    """
    rows = tables.select("path", F.lower("name").alias("table"), F.explode("columns").alias("c")).select("path", "table", "c.*")
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("path")))
    columns = rows.groupBy("table", F.lower("name").alias("column")).agg(first("type").alias("type"), F.bool_and("nullable").alias("nullable"), F.bool_or("pk").alias("pk"), F.bool_or("unique").alias("unique"), first("default").alias("default"))
    keys = tables.select(F.lower("name").alias("table"), F.explode("keys").alias("k")).select("table", F.lower("k.column").alias("column"), F.lower("k.table").alias("to_table"), F.lower("k.target").alias("to_column")).distinct()
    models = tables.filter("model is not null").select(F.lower("model").alias("to_table"), F.lower("name").alias("real"))
    keys = keys.join(models.distinct(), "to_table", "left").select("table", "column", F.coalesce("real", "to_table").alias("to_table"), "to_column")
    return columns, keys


#: Statements and calls that read or write a table.
_USES = (
    (r"\b(FROM|JOIN)\s+([\w.\"`\[\]]+)", 1, 2), (r"\b(INSERT)\s+INTO\s+([\w.\"`\[\]]+)", 1, 2), (r"\b(UPDATE)\s+([\w.\"`\[\]]+)\s+SET\b", 1, 2), (r"\b(DELETE)\s+FROM\s+([\w.\"`\[\]]+)", 1, 2),
)
_ORM = (
    (r"\b(\w+)\.objects\.(?:filter|get|all|exclude|first|count)\b", "READ"), (r"\b(\w+)\.objects\.(?:create|update|delete|bulk_create)\b", "WRITE"), (r"\.query\(\s*(\w+)\s*[,)]", "READ"), (r"\bselect\(\s*(\w+)\s*[,)]", "READ"),
    (r"\bprisma\.(\w+)\.(?:find\w*|count|aggregate)\b", "READ"), (r"\bprisma\.(\w+)\.(?:create|update|upsert|delete)\w*\b", "WRITE"), (r"\bgetRepository\(\s*(\w+)\s*\)", "READ"), (r"\.from\(\s*['\"](\w+)['\"]\s*\)", "READ"),
)


def table_uses(source: str) -> list[tuple[str, str, int]]:
    """(verb, name, line) of SQL in string literals and of ORM calls; comments do not count."""
    text = re.sub(r"(?m)^\s*(#|//).*$", "", source)
    out = set()
    for m in re.finditer(r"\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`", text, re.S):
        literal, line = next((g for g in m.groups() if g is not None), ""), text.count("\n", 0, m.start()) + 1
        if not re.search(r"\b(SELECT|INSERT|UPDATE|DELETE|FROM)\b", literal, re.I):
            continue
        deleted = {d.start(2) for d in re.finditer(_USES[3][0], literal, re.I)}
        for pattern, verb, name in _USES:
            for u in re.finditer(pattern, literal, re.I):
                if u[verb].upper() == "FROM" and u.start(name) in deleted:
                    continue
                out.add((u[verb].upper(), _plain(u[name]), line + literal.count("\n", 0, u.start())))
    for pattern, verb in _ORM:
        out |= {(verb, m[1], text.count("\n", 0, m.start()) + 1) for m in re.finditer(pattern, text)}
    return sorted(out)


def read_table_uses(files: DataFrame) -> DataFrame:
    """(id, verb, name, line) of files (id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *u) for i, s in zip(frame["id"], frame["text"], strict=True) for u in table_uses(s or "")]
            yield pd.DataFrame(rows, columns=["id", "verb", "name", "line"])

    return files.select("id", "text").mapInPandas(run, "id string, verb string, name string, line int")
