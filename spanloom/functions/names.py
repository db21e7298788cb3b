"""Column expressions over names, paths and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(file: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), column.cast("string"))


def package(callee: Column) -> Column:
    """What stands before the first dot, unless the dot comes first; else the whole name."""
    return F.when(F.instr(callee, ".") > 1, F.substring_index(callee, ".", 1)).otherwise(callee)


def object_of(callee: Column) -> Column:
    """The part before the first dot; empty without a dot."""
    return F.when(F.instr(callee, ".") > 0, F.substring_index(callee, ".", 1)).otherwise(F.lit(""))


def method_of(callee: Column) -> Column:
    """The part behind the first dot; the whole name without a dot."""
    return F.substr(callee, F.instr(callee, F.lit(".")) + 1)


def module_path(module: Column, extension: str) -> Column:
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(extension))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The path without its last part; "." without a slash."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_word(text: Column, word: str) -> Column:
    """Whether the word stands alone in the text, in any case; words are of ASCII letters, digits and _."""
    import re

    return text.rlike(rf"(?i)(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])" if "\\E" not in word else rf"(?i)(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def package_contains(pkg: Column, pattern: str) -> Column:
    """Reachability's match: everything for "" and "*", else contained in any case."""
    return F.lit(True) if pattern in ("", "*") else F.contains(F.lower(pkg), F.lit(pattern.lower()))


def package_listed(pkg: Column, pattern: str) -> Column:
    """The listing's match: equal or contained in any case."""
    return F.contains(F.lower(pkg), F.lit(pattern.lower()))


def symbol_listed(pkg: Column, callee: Column, pattern: str) -> Column:
    """The match of one symbol's listing: the package equal, or the callee containing it, in any case."""
    return (F.lower(pkg) == pattern.lower()) | F.contains(F.lower(callee), F.lit(pattern.lower()))
