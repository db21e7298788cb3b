"""Languages the engine knows: fixed values."""

from __future__ import annotations

from dataclasses import dataclass

NAME_TAGS = ("identifier", "name", "type_identifier", "property_identifier", "field_identifier")
CALLEE_TAGS = ("identifier", "property_identifier", "field_identifier", "name")
_JS = ("function_declaration", "class_declaration", "method_definition", "lexical_declaration", "variable_declaration")
_C = ("function_definition", "function_declaration")


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    declarations: tuple[str, ...]
    calls: tuple[str, ...] = ("call_expression",)
    callees: tuple[str, ...] = CALLEE_TAGS
    tests: tuple[str, ...] = ()
    names: tuple[str, ...] = NAME_TAGS


# fixed values: extensions, element names and marks of test files by language
LANGUAGES = {
    x.name: x
    for x in (
        Language("go", (".go",), ("function_declaration", "method_declaration", "type_spec"), tests=("_test.go",)),
        Language("python", (".py",), ("function_definition", "class_definition"), ("call",), tests=("test_", "_test.py")),
        Language("rust", (".rs",), ("function_item", "struct_item", "enum_item", "trait_item", "impl_item"), callees=(*CALLEE_TAGS, "scoped_identifier"), tests=("test",)),
        Language("javascript", (".js", ".jsx", ".mjs", ".cjs"), _JS, callees=(*CALLEE_TAGS, "member_expression"), tests=(".test.", ".spec.")),
        Language("typescript", (".ts", ".tsx", ".mts", ".cts"), (*_JS, "interface_declaration", "enum_declaration", "type_alias_declaration"), callees=(*CALLEE_TAGS, "member_expression"), tests=(".test.", ".spec.")),
        Language("java", (".java",), ("method_declaration", "class_declaration", "interface_declaration", "enum_declaration", "constructor_declaration", "field_declaration"), ("method_invocation", "object_creation_expression"), tests=("Test.java", "Tests.java")),
        Language("c", (".c", ".h"), _C),
        Language("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), (*_C, "class_specifier", "struct_specifier")),
    )
}
BY_EXTENSION = {e: x.name for x in LANGUAGES.values() for e in x.extensions}

# fixed values: directories that a scan leaves out
SKIP_DIRS = (".git", ".svn", ".hg", "node_modules", "vendor", "dist", "build", "target", ".idea", ".vscode", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".egg-info", ".venv", "venv")

# fixed values: elements that open a scope in any language, beside its declarations
CALLABLES = frozenset(("function_declaration", "function_definition", "function_item", "method_declaration", "method_definition", "constructor_declaration", "arrow_function"))
