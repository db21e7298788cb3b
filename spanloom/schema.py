"""Relations of a code graph and their Spark schemas."""

from __future__ import annotations

VERSION = "4"

FILES = "path string, abs_path string, language string, size bigint, mtime bigint, is_test boolean"
NODES = "id string, name string, file string, line int, `column` int"
EDGES = "src string, dst string, kind string, file string, line int, call_file string, call_line int"
RAW_EDGES = "src string, callee_name string, kind string, file string, line int"
SINKS = "src string, callee_name string, pkg string, file string, line int"
IMPORTS = "file string, ord int, short_name string, full_path string, alias string"
MOD_MAP = "module string, path string"
FILE_MODULES = "file string, module string, path string"
VAR_MAP = "file string, var string, type string"
ANNOTATIONS = "id string, node_id string, key string, value string, source string, evidence string"
MANIFEST = "path string, mtime bigint"
PARSE_ERRORS = "file string, language string, error string"

#: what a file owns, by the column that names it; the rest follows from these
OWNED = {"files": "path", "nodes": "file", "calls": "file", "sinks": "file", "imports": "file", "modules": "file", "vars": "file", "parse_errors": "file"}

TABLES = {
    "files": FILES, "nodes": NODES, "calls": RAW_EDGES, "sinks": SINKS, "imports": IMPORTS, "modules": FILE_MODULES, "vars": VAR_MAP, "parse_errors": PARSE_ERRORS,
    "edges": EDGES, "mod_map": MOD_MAP, "annotations": ANNOTATIONS, "manifest": MANIFEST,
}
