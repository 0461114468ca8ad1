"""Markdown, environment and manifest files."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_CHARS = 20_000

# --- Markdown ----------------------------------------------------------------------------------


def front_title(text: Column) -> Column:
    block = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, r"(?m)^title:\s*(.*)$", 1), r"^[\"']|[\"']$", "")), F.lit(""))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?ms)^(```|~~~).*?^\1[^\n]*$", "")


def title(text: Column) -> Column:
    """The title of the front matter, else the first heading outside fences."""
    heading = F.regexp_extract(without_fences(text), r"(?m)^#{1,6}\s+(.+?)\s*#*\s*$", 1)
    return F.coalesce(front_title(text), F.nullif(heading, F.lit("")))


def references(documents: DataFrame) -> DataFrame:
    """(src, text): code spans and link targets of documents (id, text) outside fences."""
    body = without_fences(F.coalesce("text", F.lit("")))
    spans = F.regexp_extract_all(body, F.lit(r"`([^`\n]+)`"), 1)
    links = F.regexp_extract_all(body, F.lit(r"\]\(([^)\s]+)[^)]*\)"), 1)
    return documents.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.concat(spans, links))).alias("text"))


def index_rows(documents: DataFrame) -> DataFrame:
    """Rows for the search index: the title as the name, a bounded body as the text."""
    return documents.select("id", F.coalesce(title(F.col("text")), "path").alias("name"), "path", F.substring("text", 1, SEARCH_CHARS).alias("doc"))


# --- environment --------------------------------------------------------------------------------


def dotenv(files: DataFrame) -> DataFrame:
    """Declared names of example files (path, text): path, name, value, line; private files are not read."""
    example = F.col("path").rlike(r"(^|/)\.env\.(example|sample)$")
    rows = files.filter(example).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("k", "line_text"))
    name = F.regexp_extract("line_text", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    value = F.regexp_replace(F.trim(F.regexp_extract("line_text", r"=(.*)$", 1)), r"^[\"']|[\"']$", "")
    return rows.select("path", name.alias("name"), value.alias("value"), (F.col("k") + 1).alias("line")).filter("name <> ''")


def _rows(frames: Iterator[pd.DataFrame], parse, columns: list[str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(p, *r) for p, t in zip(frame["path"], frame["text"], strict=True) for r in parse(p, t or "")]
        yield pd.DataFrame(rows, columns=columns)


def parse_yaml(text: str):
    """The mappings, lists and scalars of simple YAML (no anchors, no flow mappings over several lines)."""
    lines = []
    for raw in text.splitlines():
        bare = re.sub(r"(?:^|\s)#[^'\"]*$", "", raw).rstrip()
        if bare.strip() and bare.strip() != "---":
            lines.append((len(bare) - len(bare.lstrip(" ")), bare.strip()))

    def scalar(s: str):
        s = s.strip()
        if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in re.split(r",\s*(?=(?:[^\"']*[\"'][^\"']*[\"'])*[^\"']*$)", s[1:-1]) if x.strip()]
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s.lower(), int(s) if re.fullmatch(r"-?\d+", s) else s)

    def block(at: int, depth: int):
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] >= depth:
            indent, line = lines[at]
            if line.startswith("- ") or line == "-":
                out = out if isinstance(out, list) else []
                rest = line[2:].strip()
                if re.match(r"[\w.\"'-]+:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                elif rest:
                    value, at = scalar(rest), at + 1
                else:
                    value, at = block(at + 1, indent + 1)
                out.append(value)
            else:
                key, _, rest = line.partition(":")
                out = out if isinstance(out, dict) else {}
                if rest.strip() in ("|", ">", "|-", ">-"):
                    at += 1
                    part = []
                    while at < len(lines) and lines[at][0] > indent:
                        part.append(lines[at][1])
                        at += 1
                    value = "\n".join(part)
                elif rest.strip():
                    value, at = scalar(rest), at + 1
                else:
                    nested = at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("- "))
                    value, at = block(at + 1, lines[at + 1][0]) if nested else (None, at + 1)
                out[str(scalar(key))] = value
            if at < len(lines) and lines[at][0] < indent:
                break
        return out, at

    return block(0, lines[0][0])[0] if lines else None


def env_declared(path: str, text: str) -> list[tuple[str, str]]:
    """(name, kind) that compose files and wrangler configurations declare."""
    name = path.rpartition("/")[2]
    out: list[tuple[str, str]] = []
    try:
        if re.search(r"compose[^/]*\.ya?ml$", name):
            for service in ((parse_yaml(text) or {}).get("services") or {}).values():
                env = (service or {}).get("environment") or {}
                names = env if isinstance(env, dict) else [str(x).partition("=")[0] for x in env]
                out += [(n, "compose") for n in names]
            out += [(n, "compose") for n in re.findall(r"\$\{(\w+)[^}]*\}", text)]
        elif name == "wrangler.toml":
            doc = tomllib.loads(text)
            out += [(n, "wrangler") for n in doc.get("vars", {})]
            out += [(n, "wrangler") for e in doc.get("env", {}).values() for n in e.get("vars", {})]
    except (ValueError, AttributeError, IndexError):
        return []
    return list(dict.fromkeys(out))


def declared_env(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInPandas(lambda f: _rows(f, env_declared, ["path", "name", "kind"]), "path string, name string, kind string")


# --- manifests --------------------------------------------------------------------------------

#: Images and packages that stand for services outside the code base.
SERVICES = {"postgres": "PostgreSQL", "mysql": "MySQL", "mariadb": "MariaDB", "redis": "Redis", "rabbitmq": "RabbitMQ", "mongo": "MongoDB", "kafka": "Kafka", "elasticsearch": "Elasticsearch", "nginx": "nginx", "minio": "MinIO", "stripe": "Stripe", "openai": "OpenAI", "boto3": "AWS", "sentry-sdk": "Sentry"}

ITEM = "path string, kind string, name string, root string, entry string, requires array<string>"


def parse_manifest(path: str, text: str) -> list[tuple[str, str, str, str | None, list[str]]]:
    """(kind, name, root, entry, requires) that a manifest declares; none where it cannot be read."""
    root, _, name = path.rpartition("/")
    base = root.rpartition("/")[2]
    try:
        if name == "package.json":
            doc = json.loads(text)
            needs = sorted({*doc.get("dependencies", {}), *doc.get("devDependencies", {})})
            entry = doc.get("main") or (list(doc["bin"].values())[0] if isinstance(doc.get("bin"), dict) and doc["bin"] else doc.get("bin"))
            runs = any(k in doc.get("scripts", {}) for k in ("start", "serve")) or "bin" in doc
            return [("deployable" if runs else "package", doc.get("name") or base, root, entry if isinstance(entry, str) else None, needs)]
        if name == "pyproject.toml":
            doc = tomllib.loads(text)
            project = doc.get("project", {})
            title_ = project.get("name") or doc.get("tool", {}).get("poetry", {}).get("name") or base
            needs = sorted({re.match(r"[\w.-]+", d)[0].lower() for d in project.get("dependencies", []) if re.match(r"[\w.-]+", d)})
            out = [("package", title_, root, None, needs)]
            return out + [("deployable", s, root, str(target).partition(":")[0], []) for s, target in sorted(project.get("scripts", {}).items())]
        if name == "Dockerfile" or name.startswith("Dockerfile."):
            return [("deployable", base or "image", root, docker_entry(text), [])]
        if re.search(r"compose[^/]*\.ya?ml$", name):
            out = []
            for service, spec in ((parse_yaml(text) or {}).get("services") or {}).items():
                spec = spec or {}
                image = str(spec.get("image") or "").rpartition("/")[2].partition(":")[0]
                after = spec.get("depends_on") or []
                needs = sorted(after)
                kind = "external" if not spec.get("build") and any(image.startswith(s) for s in SERVICES) else "deployable"
                out.append((kind, service, root, None, needs))
            return out
        if name in ("wrangler.toml",):
            doc = tomllib.loads(text)
            return [("deployable", doc.get("name", base), root, doc.get("main"), [])]
        if name.startswith("vite.config."):
            return [("deployable", base or "web", root, "index.html", [])]
        if name.endswith(".csproj"):
            needs = [re.split(r"[\\/]", x)[-1].removesuffix(".csproj") for x in re.findall(r'<ProjectReference\s+Include="([^"]+)"', text)] + re.findall(r'<PackageReference\s+Include="([^"]+)"', text)
            runs = "Microsoft.NET.Sdk.Web" in text or re.search(r"<OutputType>\s*Exe", text)
            return [("deployable" if runs else "package", name.removesuffix(".csproj"), root, "Program.cs" if runs else None, sorted(needs))]
    except (ValueError, AttributeError, TypeError, KeyError, IndexError):
        return []
    return []


def docker_entry(text: str) -> str | None:
    """The file that the last stage starts, traced back through its COPY instructions where they are literal."""
    copies, start, where = [], None, "/"
    for line in re.sub(r"\\\r?\n", " ", text).splitlines():
        verb, _, rest = line.strip().partition(" ")
        verb = verb.upper()
        if verb == "FROM":
            copies, start, where = [], None, "/"
        elif verb == "WORKDIR":
            where = rest.strip() if rest.startswith("/") else f"{where.rstrip('/')}/{rest.strip()}"
        elif verb in ("COPY", "ADD") and "--from" not in rest:
            words = [w for w in rest.split() if not w.startswith("--")]
            if len(words) >= 2:
                to = words[-1] if words[-1].startswith("/") else f"{where.rstrip('/')}/{words[-1].removeprefix('./')}"
                copies += [(w, to) for w in words[:-1]]
        elif verb in ("CMD", "ENTRYPOINT"):
            try:
                words = json.loads(rest)
            except ValueError:
                words = rest.split()
            if verb == "ENTRYPOINT" or start is None:
                start = words
    for word in start or []:
        if re.search(r"\.(py|js|mjs|cjs|ts|rb|php)$", word):
            full = word if word.startswith("/") else f"{where.rstrip('/')}/{word.removeprefix('./')}"
            for src, to in reversed(copies):
                if to.rstrip("/") == full:
                    return src
                if full.startswith(to.rstrip("/") + "/"):
                    inner = full[len(to.rstrip("/")) + 1 :]
                    return inner if src in (".", "./") else f"{src.rstrip('/')}/{inner}" if not re.search(r"\.\w+$", src) else src
            return word.removeprefix("./")
    return None


def manifests(files: DataFrame) -> DataFrame:
    """What the manifests among files (path, text) declare."""
    known = F.col("path").rlike(r"(^|/)(package\.json|pyproject\.toml|wrangler\.toml|Dockerfile[^/]*|[^/]*compose[^/]*\.ya?ml|vite\.config\.[a-z]+|[^/]+\.csproj)$")
    return files.filter(known).select("path", "text").mapInPandas(lambda f: _rows(f, parse_manifest, ["path", "kind", "name", "root", "entry", "requires"]), ITEM)


def manifest_edges(items: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of deployables, packages and external services, and ``part_of`` and ``depends_on`` edges.

    A file belongs to every item whose root is above it and deepest among its kind.
    """
    from tessera.operators.binding import directories

    ident = F.concat("kind", F.lit(":"), "name")
    nodes = items.select(ident.alias("id"), "kind", "name", F.col("root").alias("path"), F.to_json(F.struct(F.filter(F.array("entry"), lambda e: e.isNotNull()).alias("entry_points"))).alias("attrs")).dropDuplicates(["id"])
    inside = files.select(F.col("id").alias("src"), F.explode(directories(F.col("path"))).alias("root")).join(items.filter("kind <> 'external'").select("root", "kind", ident.alias("dst")), "root")
    deepest = inside.groupBy("src", "kind").agg(F.max(F.struct(F.length("root").alias("n"), "root")).alias("best"))
    part = inside.join(deepest, ["src", "kind"]).filter(F.col("root") == F.col("best.root")).select("src", "dst", F.lit("part_of").alias("kind"), F.lit("manifest").alias("source"))
    needs = items.select(ident.alias("src"), F.explode("requires").alias("need"))
    own = items.select(F.col("name").alias("need"), ident.alias("dst")).dropDuplicates(["need"])
    service = F.create_map(*[F.lit(x) for k, v in SERVICES.items() for x in (k, "external:" + v)])
    found = needs.join(own, "need", "left").withColumn("dst", F.coalesce("dst", F.try_element_at(service, F.lower("need")))).filter("dst is not null and src <> dst")
    outside = found.filter("dst like 'external:%'").select(F.col("dst").alias("id"), F.lit("external").alias("kind"), F.substring_index("dst", ":", -1).alias("name"), F.lit(None).cast("string").alias("path"), F.lit("{}").alias("attrs"))
    nodes = nodes.unionByName(outside).dropDuplicates(["id"])
    return nodes, part.unionByName(found.select("src", "dst", F.lit("depends_on").alias("kind"), F.lit("manifest").alias("source")).distinct())
