"""Schemas of a model: one snapshot of a code base as tables, told apart by ``model_id``."""

from __future__ import annotations

VERSION = 1

TABLES = {
    "nodes": "model_id string, id string, parent_id string, kind string, display_kind string, name string, workspace_id string, path string, start_line int, end_line int, lang string, loc int, content_hash string, signature string, doc string, summary string, summary_source string, attrs string",
    "edges": "model_id string, src string, dst string, kind string, source string, confidence double, weight int, attrs string, ordinal int",
    "diagnostics": "model_id string, node_id string, kind string, detail string",
    "coverage_lines": "model_id string, file_id string, line int, hits int, artifact string",
    "results": "model_id string, test_node_id string, status string, duration_ms double, artifact string",
    "tasks": "model_id string, id string, kind string, node_id string, input_hash string, state string, depends_on array<string>, inputs string",
    "file_state": "model_id string, path string, mtime_ns bigint, size bigint, content_hash string, parser_version int",
}

#: Columns that get a value when a row is built without them.
DEFAULTS = {"confidence": 1.0, "weight": 1, "ordinal": 0, "source": "treesitter", "attrs": "{}"}

#: Kinds of changes between two models, most important first.
CHANGE_KINDS = (
    "concept-added", "concept-removed", "concept-renamed", "concept-split", "concept-merged", "ownership-moved",
    "relationship-added", "relationship-removed", "relationship-changed", "integration-added", "integration-removed",
    "deployable-added", "deployable-removed", "package-added", "package-removed", "dependency-added", "dependency-removed",
    "table-added", "table-removed", "table-altered", "endpoint-added", "endpoint-removed", "endpoint-changed",
    "env-added", "env-removed", "file-moved", "symbol-added", "symbol-removed", "symbol-moved", "symbol-changed",
    "test-added", "test-removed", "untested-change", "render-added", "render-removed", "provisional-owner",
)
