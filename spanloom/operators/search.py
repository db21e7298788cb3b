"""Tiered symbol search: the first tier with a hit answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, CAMEL, SUBSTRING = 1, 2, 3


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a shell pattern; None if it is malformed.

    ``*`` and ``?`` don't cross a slash, ``[...]`` may be negated by ``^``, a
    backslash takes the next character literally.
    """
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            k += 1
            if k == len(pattern):
                return None
            out += re.escape(pattern[k])
        elif c == "[":
            end, k = k, k + 1
            negated = pattern[k : k + 1] == "^"
            k += negated
            body = ""
            while k < len(pattern) and (pattern[k] != "]" or not body):
                if pattern[k] == "\\":
                    k += 1
                if k >= len(pattern):
                    return None
                body += pattern[k] if pattern[k] == "-" else re.escape(pattern[k])
                k += 1
            if k >= len(pattern) or not body or body.startswith("-") or body.endswith("-"):
                return None
            out += f"[{'^' if negated else ''}{body}]"
            del end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def camel_regex(query: str) -> str | None:
    """The letters of the query in order among a name's capitals; None if it has others."""
    return "(?s)" + ".*".join(query) if re.fullmatch(r"[A-Z]+", query) else None


def prefix(nodes: DataFrame, text: str) -> DataFrame:
    """Names that start with the text; reaches a Parquet scan as StringStartsWith."""
    return nodes.where(F.col("name").startswith(text))


def glob(nodes: DataFrame, pattern: str) -> DataFrame:
    regex = glob_regex(pattern)
    return nodes.where(F.lit(False)) if regex is None else nodes.where(F.col("name").rlike(regex))


def exact(nodes: DataFrame, name: str, ignore_case: bool = False) -> DataFrame:
    return nodes.where(F.lower("name") == name.lower()) if ignore_case else nodes.where(F.col("name") == name)


def camel(nodes: DataFrame, query: str) -> DataFrame:
    regex = camel_regex(query) if len(query) >= 2 else None
    return nodes.where(F.lit(False)) if regex is None else nodes.where(F.col("name").rlike(regex))


def substring(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower())))


def tier(name: str, ignore_case: bool) -> Column:
    """The best tier that a row's name is in; null for none."""
    same = F.lower("name") == name.lower() if ignore_case else F.col("name") == name
    found = F.when(same, EXACT)
    regex = camel_regex(name) if len(name) >= 2 and name.upper() == name else None
    if regex:
        found = found.when(F.col("name").rlike(regex), CAMEL)
    return found.when(F.contains(F.lower("name"), F.lit(name.lower())), SUBSTRING)


def query(nodes: DataFrame, name: str, ignore_case: bool = False) -> DataFrame:
    """The nodes a search finds, as a set.

    A pattern that only ends in ``*`` asks for a prefix (without a hit and with
    ignore_case, once more with its first letter in upper case); one with other
    marks is a glob.  Both are final.  Else exact names are looked up first: the
    filter reaches the scan, and if there is one, that is the answer.  If not,
    one pass gives every row its best tier, and a one-row aggregate keeps the
    best that occurs.
    """
    if not name:
        return nodes.where(F.lit(False))
    if name.endswith("*") and not re.search(r"[*?\[]", name[:-1]):
        text = name[:-1]
        found = prefix(nodes, text)
        if not ignore_case or not text:
            return found
        again = prefix(nodes, text[:1].upper() + text[1:])
        none = found.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
        return found.unionByName(again.join(F.broadcast(none.where("none")), how="left_semi", on=F.lit(True)))
    if re.search(r"[*?\[]", name):
        return glob(nodes, name)
    same = exact(nodes, name, ignore_case)
    if not same.isEmpty():
        return same
    ranked = nodes.withColumn("tier", tier(name, ignore_case)).where("tier is not null")
    best = ranked.agg(F.min("tier").alias("best"))
    return ranked.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best")
