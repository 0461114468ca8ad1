"""Coverage and test result artifacts: lcov, coverage.py JSON and JUnit XML."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 << 20
LINES = "artifact string, path string, line int, hits int, context string"
RESULTS = "artifact string, name string, chain string, file string, status string, duration_ms double"


class UnknownFormat(ValueError):
    pass


def detect(text: str) -> str:
    """lcov, coverage-py or junit, by content."""
    head = text.lstrip()[:4096]
    if head.startswith("{") and '"files"' in text and '"meta"' in text:
        return "coverage-py"
    if head.startswith("<") and ("<testsuite" in head or "<testcase" in head):
        return "junit"
    if any(line.startswith("SF:") for line in text.splitlines()) and "DA:" in text:
        return "lcov"
    raise UnknownFormat("not lcov, coverage.py JSON or JUnit XML")


def parse_lcov(text: str) -> list[tuple[str, int, int]]:
    """(path, line, hits); a line given twice takes the larger count."""
    best: dict[tuple[str, int], int] = {}
    path = None
    for line in text.splitlines():
        if line.startswith("SF:"):
            path = line[3:].strip()
        elif line.startswith("DA:") and path:
            number, hits = line[3:].split(",")[:2]
            key = (path, int(number))
            best[key] = max(best.get(key, 0), int(float(hits)))
        elif line.strip() == "end_of_record":
            path = None
    return [(p, n, h) for (p, n), h in sorted(best.items())]


def parse_coverage_py(text: str) -> list[tuple[str, int, int, str | None]]:
    """(path, line, hits, context): executed lines once per context, missing ones with 0 hits."""
    out = []
    for path, f in sorted(json.loads(text)["files"].items()):
        contexts = f.get("contexts", {})
        for n in f.get("executed_lines", []):
            names = [c.rpartition("|")[0] or c for c in contexts.get(str(n), []) if c]
            out += [(path, n, 1, c) for c in names] or [(path, n, 1, None)]
        out += [(path, n, 0, None) for n in f.get("missing_lines", [])]
    return out


def parse_junit(text: str) -> list[tuple[str, str, str | None, str, float | None]]:
    """(name, chain of suites and name, file, status, milliseconds); nested suites count, failures win over skips."""
    out = []

    def walk(node: ET.Element, chain: list[str]) -> None:
        for child in node:
            if child.tag.endswith("testsuite"):
                walk(child, [*chain, child.get("name", "")])
            elif child.tag.endswith("testcase"):
                kinds = {c.tag.rpartition("}")[2] for c in child}
                status = "failed" if kinds & {"failure", "error"} else "skipped" if "skipped" in kinds else "passed"
                name = child.get("name", "")
                full = [c for c in [*chain, *(child.get("classname", "").split(" > ") if child.get("classname") else []), name] if c]
                seconds = child.get("time")
                out.append((name, " > ".join(full), child.get("file"), status, float(seconds) * 1000 if seconds else None))

    root = ET.fromstring(text)
    walk(root if root.tag.endswith("testsuites") else _wrap(root), [])
    return out


def _wrap(root: ET.Element) -> ET.Element:
    top = ET.Element("testsuites")
    top.append(root)
    return top


def _parse(kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["artifact"], frame["text"], strict=True):
                found = detect(text)
                if kind == "lines" and found == "lcov":
                    rows += [(path, *r, None) for r in parse_lcov(text)]
                elif kind == "lines" and found == "coverage-py":
                    rows += [(path, *r) for r in parse_coverage_py(text)]
                elif kind == "results" and found == "junit":
                    rows += [(path, *r) for r in parse_junit(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (LINES if kind == "lines" else RESULTS).split(", ")])

    return run


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts (artifact, text) of a file or folder; larger ones than the limit are an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    big = F.raise_error(F.concat(F.lit("too large: "), F.col("path")))
    return raw.select(F.col("path").alias("artifact"), F.when(F.col("length") > MAX_BYTES, big).otherwise(F.decode("content", "utf-8")).alias("text"))


def coverage_rows(texts: DataFrame) -> DataFrame:
    """Covered lines of all lcov and coverage.py artifacts; each file is parsed in one task, many at once."""
    return texts.mapInPandas(_parse("lines"), LINES)


def result_rows(texts: DataFrame) -> DataFrame:
    return texts.mapInPandas(_parse("results"), RESULTS)


def lcov_lines(texts: DataFrame) -> DataFrame:
    """lcov with built-in functions only, for very many small artifacts: artifact, path, line, hits."""
    section = F.explode(F.split("text", r"(?m)^end_of_record\s*$"))
    rows = texts.select("artifact", section.alias("s")).withColumn("path", F.trim(F.regexp_extract("s", r"(?m)^SF:(.*)$", 1))).filter("path <> ''")
    rows = rows.select("artifact", "path", F.explode(F.regexp_extract_all("s", F.lit(r"(?m)^DA:(\d+,\d+)"), 1)).alias("d"))
    part = F.split("d", ",")
    return rows.groupBy("artifact", "path", part[0].cast("int").alias("line")).agg(F.max(part[1].cast("int")).alias("hits"))


def map_coverage(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as coverage_lines of known files (id, path), and diagnostics of paths that are not tracked."""
    known = files.select(F.col("id").alias("file_id"), "path")
    good = rows.join(known, "path").select("file_id", "line", "hits", "artifact").distinct()
    bad = rows.select("path", "artifact").distinct().join(known, "path", "left_anti")
    return good, bad.select(F.lit(None).cast("string").alias("node_id"), F.lit("unmapped_coverage").alias("kind"), F.concat("artifact", F.lit(": "), "path").alias("detail"))


def context_edges(rows: DataFrame, files: DataFrame, tests: DataFrame, spans: DataFrame) -> DataFrame:
    """``tests`` edges of coverage contexts: the test (id, file path, name) to the innermost symbol of each line it ran."""
    from tessera.operators.binding import innermost

    said = rows.filter("context is not null and hits > 0").withColumn("test_name", F.element_at(F.split("context", r"::|\."), -1))
    named = tests.select(F.col("id").alias("src"), F.col("name").alias("test_name"))
    once = named.groupBy("test_name").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src")).filter("n = 1").drop("n")
    lines = said.join(once, "test_name").join(files.select(F.col("id").alias("file"), "path"), "path").select("src", "file", "line", "artifact")
    hit = innermost(lines, spans).filter("symbol is not null")
    return hit.groupBy("src", F.col("symbol").alias("dst"), "artifact").agg(F.countDistinct("line").cast("int").alias("weight"))
