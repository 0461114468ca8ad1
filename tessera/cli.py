"""Commands over a saved model: ``python -m tessera.cli --model FOLDER COMMAND ...``.

Exit codes: 0 fine, 1 nothing found or a rule is broken, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import Model
from tessera.operators import diff, graph, lookups, rollups, search
from tessera.operators.views import to_json, to_markdown, to_text

FORMATS = {"text": to_text, "markdown": to_markdown, "json": to_json}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--model", required=True, help="folder of saved models")
    p.add_argument("--at", default="worktree", help="which snapshot")
    p.add_argument("--format", choices=FORMATS, default="text")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, aliases: tuple[str, ...] = ()) -> None:
        c = sub.add_parser(name, aliases=aliases)
        for flag, kind in options:
            if kind is bool:
                c.add_argument(flag, action="store_true")
            elif flag.startswith("--"):
                c.add_argument(flag, type=type(kind), default=kind)
            else:
                c.add_argument(flag, type=kind)

    window = (("--limit", 20), ("--offset", 0))
    command("hotspots", ("--by", "fan_in"), ("--level", "file"), *window)
    command("orphans", ("--kind", "unreferenced"), aliases=("dead",))
    command("cycles")
    command("deps", ("--level", "package"), ("--forbid", ""), ("--include-tests", bool), aliases=("layers",))
    command("tests-for", ("ref", str))
    command("coverage")
    command("search", ("words", str), *window)
    command("show", ("ref", str), ("--section", "edges"))
    command("status", ("--section", "nodes"))
    command("tasks", ("--state", "open"), *window)
    command("query", ("sql", str), *window)
    command("diff", ("base", str), ("head", str))
    command("metrics")
    return p


def run(model: Model, args: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, bool]:
    """Rows of a command, and whether having any is a failure."""
    match args.command:
        case "hotspots":
            return graph.top_hotspots(model, args.by, args.level, args.limit, args.offset), False
        case "orphans" | "dead":
            kinds = {"unreferenced": graph.unreferenced, "test-only": graph.test_only, "unreachable": graph.unreachable, "untested": graph.untested}
            return kinds[args.kind](model), args.kind == "unreferenced"
        case "cycles":
            return graph.cycles(model).orderBy("level", "detail"), True
        case "deps" | "layers":
            if args.forbid:
                return graph.forbidden(model, args.forbid, args.level).orderBy("src", "dst"), True
            return graph.dependency_matrix(model, args.level, args.include_tests).orderBy("from_id", "to_id"), False
        case "tests-for":
            hits = lookups.resolve(model, args.ref).select("id", "kind").take(2)
            if len(hits) != 1:
                raise LookupError(f"{args.ref!r} names {len(hits)} nodes")
            return rollups.tests_for(model, *hits[0]), False
        case "coverage":
            return rollups.coverage(model.coverage_lines).orderBy("file_id"), False
        case "search":
            return search.search_nodes(model, args.words, None, args.limit, args.offset), False
        case "show":
            return lookups.show(model, args.ref)[args.section], False
        case "status":
            return lookups.status(model)[args.section], False
        case "tasks":
            return lookups.list_tasks(model, args.state, args.limit, args.offset), False
        case "query":
            model.views()
            return lookups.safe_sql(spark, args.sql, args.limit, args.offset), False
        case "metrics":
            return rollups.repository_metrics(model), False
        case "diff":
            base, head = Model.load(spark, args.model, args.base), Model.load(spark, args.model, args.head)
            rows = diff.symbol_changes(base, head).select("kind", F.col("id").alias("summary"))
            for part in (diff.container_changes(base, head), diff.test_changes(base, head), diff.env_changes(base, head).withColumnRenamed("name", "id")):
                rows = rows.unionByName(part.select("kind", F.col("id").alias("summary")))
            return diff.ordered(rows.withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")})).select("kind", "summary"), False
    raise ValueError(args.command)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        rows, bad = run(Model.load(spark, args.model, args.at), args, spark)
        text = FORMATS[args.format](rows)
    except LookupError as e:
        print(e, file=sys.stderr)
        return 1
    except (ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 2
    if text:
        print(text)
    return int(bad and not rows.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
