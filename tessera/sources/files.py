"""Files of a repository: enumeration, ignore rules, roles, change detection, history and line counts.

Git itself runs on the driver, in bounded listings; contents are read where they are parsed.
"""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S

TREE = "workspace_id string, path string, mode string, blob string"

#: Languages by ending, and names and first lines that tell a language.
LANGUAGES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "vue": "vue", "cs": "csharp", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "scala": "scala", "sql": "sql", "prisma": "prisma", "sh": "shell", "bash": "shell", "ps1": "powershell", "css": "css", "scss": "css", "html": "html",
}
DOC_ENDINGS = ("md", "mdx", "rst", "adoc", "txt")
BUILD_NAMES = {"Dockerfile": "dockerfile", "Makefile": "make", "Jenkinsfile": "groovy", "Rakefile": "ruby", "Gemfile": "ruby"}
SHEBANGS = {"python": "python", "node": "javascript", "bash": "shell", "sh": "shell", "ruby": "ruby", "perl": "perl"}
TEST_PATH = r"(^|/)(tests?|__tests__|spec|e2e)/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$|\.(test|spec)\.[a-z]+$|Tests?\.cs$"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, errors="surrogateescape").stdout


def enumerate_repo(spark: SparkSession, root: str, workspace: str = "root", ref: str | None = None) -> DataFrame:
    """Tracked files (workspace_id, path, mode, blob) of the work tree or of a commit; submodules become workspaces of their own."""
    rows, todo = [], [(root, workspace, ref)]
    while todo:
        top, ws, at = todo.pop()
        listing = _git(top, "ls-tree", "-r", "-z", at) if at else _git(top, "ls-files", "-s", "-z")
        for item in filter(None, listing.split("\0")):
            head, _, path = item.partition("\t")
            parts = head.split()
            mode, blob = parts[0], parts[2] if at else parts[1]
            if mode == "160000":
                if not at:
                    todo.append((f"{top}/{path}", f"{ws}/{path}", None))
                continue
            rows.append((ws, path, mode, blob))
    return spark.createDataFrame(rows, TREE)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files (path, content, size, mtime_ns) of a plain folder, on any store Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.expr(f"substring(path, length('{folder.rstrip('/')}') + instr(path, '{folder.rstrip('/')}') + 1)").alias("path"), "content", F.col("length").alias("size"), (F.unix_micros(F.col("modificationTime")) * 1000).alias("mtime_ns"))


# --- ignore rules ----------------------------------------------------------------------------


def parse_ignore(text: str) -> list[tuple[str, bool, bool]]:
    """Rules of a gitignore text as (regular expression, negated, directories only)."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip("\r\n")
        if not line.strip() or line.startswith("#"):
            continue
        line = re.sub(r"(?<!\\)\s+$", "", line)
        negated = line.startswith("!")
        pattern = line[1:] if negated else line
        pattern = pattern[1:] if pattern.startswith("\\") else pattern
        only_dirs, pattern = pattern.endswith("/"), pattern.rstrip("/")
        if "/" in pattern:
            pattern = pattern.lstrip("/")
        else:
            pattern = "**/" + pattern
        rules.append((S.glob_regex(pattern), negated, only_dirs))
    return rules


def ignored(path: str, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    """Whether a file is ignored: directories from the top first, then the last rule that matches."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        part, is_dir, verdict = "/".join(parts[:k]), k < len(parts), False
        for pattern, negated, only_dirs in rules:
            if (is_dir or not only_dirs) and pattern.match(part):
                verdict = not negated
        if verdict:
            return True
    return False


def drop_ignored(files: DataFrame, text: str, keep_source: bool = True) -> DataFrame:
    """Files that the rules leave; production source stays in any case if ``keep_source``."""
    rules = parse_ignore(text)

    @F.pandas_udf("boolean")
    def hit(paths: pd.Series) -> pd.Series:
        compiled = [(re.compile(p), n, d) for p, n, d in rules]
        return paths.map(lambda p: ignored(p, compiled))

    source = F.coalesce(classify(F.col("path"))["role"] == "code", F.lit(False)) if keep_source else F.lit(False)
    return files.filter(~hit("path") | source)


# --- roles ---------------------------------------------------------------------------------


def classify(path: Column, first_line: Column | None = None) -> Column:
    """Struct of role (code, test, doc, other) and language, by path and, without an ending, the first line."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    lang = F.coalesce(F.try_element_at(pairs(BUILD_NAMES), name), F.try_element_at(pairs(LANGUAGES), ending))
    if first_line is not None:
        program = F.regexp_extract(first_line, r"^#!.*?([a-z]+)[0-9.]*\s*$", 1)
        lang = F.coalesce(lang, F.when(~name.contains("."), F.try_element_at(pairs(SHEBANGS), program)))
    role = F.when(ending.isin(*DOC_ENDINGS), "doc").when(lang.isNotNull() & path.rlike(TEST_PATH), "test").when(lang.isNotNull() & ~lang.isin("html", "css"), "code").otherwise("other")
    return F.struct(role.alias("role"), lang.alias("lang"))


def heavy_directories(files: DataFrame, least: int = 100) -> DataFrame:
    """Outermost directories that are collections of documents: many files, few of code, at least half documents. files: path, role."""
    from tessera.operators.binding import directories

    rows = files.select("role", F.explode(directories(F.col("path"))).alias("dir")).filter("dir <> ''")
    n = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "code").alias("code"), F.count_if(F.col("role") == "doc").alias("docs"))
    heavy = n.filter((F.col("n") > least) & (F.col("code") * 10 <= F.col("n")) & (F.col("docs") * 2 >= F.col("n"))).select("dir")
    above = heavy.select(F.col("dir"), F.explode(directories(F.col("dir"))).alias("up")).join(heavy.withColumnRenamed("dir", "up"), "up", "left_semi").select("dir").distinct()
    return heavy.join(above, "dir", "left_anti")


def hashed(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Files (path, content, size, mtime_ns) with git's blob id; contents with known size and time are not hashed, private env files never."""
    private = F.col("path").rlike(r"(^|/)\.env(\.[^/]*)?$") & ~F.col("path").rlike(r"\.env\.(example|sample|template)$")
    if known is None:
        return files.withColumn("content_hash", F.when(~private, S.blob_id("content")))
    old = known.select("path", F.col("size").alias("s"), F.col("mtime_ns").alias("m"), F.col("content_hash").alias("h"))
    rows = files.join(old, "path", "left")
    same = (F.col("s") == F.col("size")) & (F.col("m") == F.col("mtime_ns"))
    return rows.withColumn("content_hash", F.when(same, F.col("h")).when(~private, S.blob_id("content"))).drop("s", "m", "h")


def to_parse(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content or parser is new: (path, content_hash, parser_version)."""
    return now.join(stored.select("path", "content_hash", "parser_version"), ["path", "content_hash", "parser_version"], "left_anti")


def fingerprint(now: DataFrame) -> str:
    """One value that is equal for equal states of all files."""
    from tessera.operators.rollups import bag_digest

    return bag_digest(now, "path", "content_hash", "parser_version").first()[0]


def with_cache(files: DataFrame, cache: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of all files, and the new ones for the cache; equal contents are parsed once for all snapshots.

    Keys: file_id, content_hash, lang, is_test, parser_version.
    """
    keys = ["file_id", "content_hash", "lang", "is_test", "parser_version"]
    new = parse(files.join(cache.select(keys), keys, "left_anti"))
    old = cache.join(files.select(keys), keys, "left_semi")
    return old.unionByName(new), new


# --- history ------------------------------------------------------------------------------------


def git_log(spark: SparkSession, root: str, branch: str | None = None) -> DataFrame:
    """First-parent commits, oldest first: place, sha, parents, at, subject."""
    branch = branch or default_branch(root)
    text = _git(root, "log", "--first-parent", "--reverse", "--format=%H%x1f%P%x1f%cI%x1f%s%x1e", branch)
    rows = []
    for k, item in enumerate(filter(None, (x.strip("\n") for x in text.split("\x1e")))):
        sha, parents, at, subject = item.split("\x1f")
        rows.append((k, sha, parents.split(), at, subject))
    return spark.createDataFrame(rows, "place long, sha string, parents array<string>, at string, subject string").withColumn("at", F.to_timestamp("at"))


def default_branch(root: str) -> str:
    names = _git(root, "branch", "--format=%(refname:short)").split()
    return next((n for n in ("main", "master", "trunk") if n in names), "HEAD")


def pull_request(subject: Column) -> Column:
    """The number in a squash or merge subject."""
    n = F.regexp_extract(subject, r"\(#(\d+)\)\s*$|^Merge pull request #(\d+)", 0)
    return F.regexp_extract(n, r"(\d+)", 1).try_cast("int")


def parse_numstat(text: str) -> list[tuple[str, int | None, int | None, bool]]:
    out = []
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) == 3:
            binary = parts[0] == "-"
            path = re.sub(r"\{[^{}]* => ([^{}]*)\}", r"\1", parts[2]).replace("//", "/")
            path = path.rpartition(" => ")[2]
            out.append((path, None if binary else int(parts[0]), None if binary else int(parts[1]), binary))
    return out


def parse_hunks(text: str) -> dict[str, tuple[list[int], list[int]]]:
    """Added and deleted line numbers per path, of a diff without context."""
    out: dict[str, tuple[list[int], list[int]]] = {}
    path = None
    for line in text.splitlines():
        if line.startswith("+++ "):
            path = line[4:].removeprefix("b/")
            if path == "/dev/null":
                path = None
        elif line.startswith("--- ") and line[4:] != "/dev/null":
            path = line[4:].removeprefix("a/")
        elif path and (m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)):
            a, n, b, k = (int(x) if x is not None else 1 for x in m.groups())
            added, deleted = out.setdefault(path, ([], []))
            added += range(b, b + k)
            deleted += range(a, a + n)
    return out


def line_stats(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """Changed paths: additions, deletions, binary, and the line numbers on either side."""
    numbers = parse_numstat(_git(root, "diff", "--numstat", "-M", base, head))
    hunks = parse_hunks(_git(root, "diff", "--unified=0", "-M", base, head))
    rows = [(p, a, d, b, *hunks.get(p, ([], []))) for p, a, d, b in numbers]
    return spark.createDataFrame(rows, "path string, additions int, deletions int, binary boolean, added array<int>, deleted array<int>")


def worktrees(spark: SparkSession, root: str) -> DataFrame:
    """Work trees and branches: path, branch, head."""
    rows, item = [], {}
    for line in [*_git(root, "worktree", "list", "--porcelain").splitlines(), ""]:
        if line:
            k, _, v = line.partition(" ")
            item[k] = v
        elif item:
            rows.append((item.get("worktree"), item.get("branch", "").removeprefix("refs/heads/") or None, item.get("HEAD")))
            item = {}
    seen = {r[1] for r in rows}
    for line in _git(root, "branch", "--format=%(refname:short) %(objectname)").splitlines():
        name, _, sha = line.rpartition(" ")
        if name not in seen:
            rows.append((None, name, sha))
    return spark.createDataFrame(rows, "path string, branch string, head string")


