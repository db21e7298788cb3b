"""Symbol search in the shape of grep: hits joined to the lines they stand on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.names import base_name, has_word, trimmed
from spanloom.operators import search


@dataclass
class GrepOptions:
    pattern: str = ""
    paths: tuple[str, ...] = (".",)
    ignore_case: bool = False
    word: bool = False
    invert: bool = False
    count: bool = False
    quiet: bool = False
    files_only: bool = False
    only_matching: bool = False
    no_filename: bool = False
    text: bool = False
    max_count: int = 0
    before: int = 0
    after: int = 0
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())


_FLAGS = {"i": "ignore_case", "w": "word", "v": "invert", "c": "count", "q": "quiet", "l": "files_only", "o": "only_matching", "h": "no_filename", "t": "text"}
_LONG = {"ignore-case": "i", "word-regexp": "w", "invert-match": "v", "count": "c", "quiet": "q", "silent": "q", "files-with-matches": "l", "only-matching": "o", "no-filename": "h", "text": "t"}
_VALUES = {"m": "max_count", "A": "after", "B": "before"}
_LONG_VALUES = {"max-count": "m", "after-context": "A", "before-context": "B", "context": "C", "regexp": "e", "include": "include", "exclude": "exclude"}


def parse(args: list[str]) -> GrepOptions:
    """Flags as grep takes them: combined short ones, values attached or apart; the last -e wins."""
    o, rest, given, k = GrepOptions(), [], False, 0

    def value(flag: str, text: str) -> None:
        nonlocal given
        if flag == "e":
            o.pattern, given = text, True
        elif flag in ("include", "exclude"):
            setattr(o, flag, (*getattr(o, flag), text))
        elif flag == "C":
            o.before = o.after = int(text)
        else:
            setattr(o, _VALUES[flag], int(text))

    while k < len(args):
        a = args[k]
        k += 1
        if a == "--":
            rest += args[k:]
            break
        if a.startswith("--"):
            name, eq, text = a[2:].partition("=")
            if name in _LONG:
                setattr(o, _FLAGS[_LONG[name]], True)
            elif name in _LONG_VALUES:
                if not eq:
                    text, k = args[k], k + 1
                value(_LONG_VALUES[name], text)
        elif a.startswith("-") and len(a) > 1:
            for at, c in enumerate(a[1:], 1):
                if c in _FLAGS:
                    setattr(o, _FLAGS[c], True)
                elif c in "emABC":
                    text = a[at + 1 :]
                    if not text:
                        text, k = args[k], k + 1
                    value(c, text)
                    break
        else:
            rest.append(a)
    if not given and rest:
        o.pattern = rest.pop(0)
    o.paths = tuple(rest) or (".",)
    return o


def lines_of(files: DataFrame) -> DataFrame:
    """(file, line, content) of (file, text): 1-based lines, trimmed."""
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("file", (F.col("pos") + 1).alias("line"), trimmed(F.col("raw")).alias("content"))


def distinct_places(hits: DataFrame) -> DataFrame:
    """One hit for each file and line: the first by column, id and name."""
    first = F.row_number().over(W.partitionBy("file", "line").orderBy("column", "id", "name"))
    return hits.withColumn("nth", first).where("nth = 1").drop("nth")


def with_content(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """Hits with the line they stand on: none for a file that can't be read, "" behind its end."""
    known = hits.join(lines.select("file").distinct(), "file", "left_semi")
    return known.join(lines.select("file", "line", "content"), ["file", "line"], "left").fillna("", ["content"])


def path_filter(path: Column, wanted: tuple[str, ...]) -> Column:
    """A prefix of the path, with or without ./ before it, or its base name; "." alone keeps all."""
    if all(p == "." for p in wanted):
        return F.lit(True)
    keep = F.lit(False)
    for p in wanted:
        p = p.removeprefix("./")
        keep = keep | path.startswith(p) | path.startswith("./" + p) | (base_name(path) == p)
    return keep


def hits(nodes: DataFrame, lines: DataFrame, o: GrepOptions) -> DataFrame:
    """(file, line, column, name, content): what the options leave of a search, before any format."""
    found = search.query(nodes, o.pattern, o.ignore_case)
    got = with_content(distinct_places(found), lines).where(path_filter(F.col("file"), o.paths))
    if o.word:
        got = got.where(has_word(F.col("content"), o.pattern) | has_word(F.col("name"), o.pattern))
    if o.invert:
        got = distinct_places(found).join(got.select("file", "line"), ["file", "line"], "left_anti").withColumn("content", F.lit(""))
    got = got.select("file", "line", "column", "name", "content")
    return got.orderBy("file", "line").limit(o.max_count) if o.max_count else got


def text_hits(lines: DataFrame, o: GrepOptions) -> DataFrame:
    """Lines that match the pattern as a regular expression: the fallback without symbols."""
    pattern = f"(?i){o.pattern}" if o.ignore_case else o.pattern
    match = F.col("content").rlike(rf"\b(?:{pattern})\b" if o.word else pattern)
    got = lines.where(~match if o.invert else match).where(path_filter(F.col("file"), o.paths))
    for globs, keep in ((o.include, True), (o.exclude, False)):
        if globs:
            inside = F.lit(False)
            for g in globs:
                inside = inside | base_name(F.col("file")).rlike(search.glob_regex(g) or "(?!)")
            got = got.where(inside if keep else ~inside)
    return got.orderBy("file", "line").limit(o.max_count) if o.max_count else got


def context(got: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """Hits with ``block``, the lines around joined by line feeds, and ``separated``:
    whether a separator stands before, as the groups don't touch."""
    around = got.select("file", F.col("line").alias("at"), F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"))
    blocks = around.join(lines, ["file", "line"]).groupBy("file", F.col("at").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("block"))
    out = got.join(blocks, ["file", "line"], "left").fillna("", ["block"])
    last = F.lag("line").over(W.partitionBy("file").orderBy("line"))
    # only the first hit of a file needs the order of files
    first_file = got.agg(F.min("file").alias("first_file"))
    out = out.withColumn("last", last).join(F.broadcast(first_file))
    apart = F.when(F.col("last").isNull(), F.col("file") != F.col("first_file")).otherwise(F.col("last") + after + 1 < F.col("line") - before)
    return out.select("file", "line", "name", "block", apart.alias("separated"))


def printed(got: DataFrame, o: GrepOptions) -> DataFrame:
    """(file, line, printed): one printed line for each hit."""
    if o.files_only:
        text = F.col("file")
    elif o.only_matching:
        text = F.lit(o.pattern)
    else:
        content = F.when(F.col("content") == "", F.col("name")).otherwise(F.col("content"))
        parts = ([] if o.no_filename else [F.col("file"), F.lit(":")]) + [F.col("line").cast("string"), F.lit(":"), content]
        text = F.concat(*parts)
    return got.select("file", "line", text.alias("printed"))


def any_hit(nodes: DataFrame, lines: DataFrame, o: GrepOptions) -> bool:
    """Whether a call finds anything: what its exit code says."""
    o = replace(o, count=False, quiet=False)
    return not grep(nodes, lines, o).isEmpty()


def grep(nodes: DataFrame, lines: DataFrame, o: GrepOptions) -> DataFrame:
    """The printed lines of a call, in order; the count alone with ``count``."""
    if o.text:
        got = text_hits(lines, o).withColumn("name", F.lit(""))
    else:
        got = hits(nodes, lines, o)
        if not (o.count or o.quiet) and search.query(nodes, o.pattern, o.ignore_case).isEmpty():
            got = text_hits(lines, o).withColumn("name", F.lit(""))
    if o.count:
        return got.agg(F.count(F.lit(1)).cast("string").alias("printed"))
    if o.quiet:
        return got.limit(0).select(F.lit("").alias("printed"))
    if (o.before or o.after) and not (o.text or o.files_only or o.only_matching):
        rows = context(got, lines, o.before, o.after)
        text = F.concat(F.when(F.col("separated"), "--\n").otherwise(""), F.col("block"))
        return rows.orderBy("file", "line").select(text.alias("printed"))
    return printed(got, o).orderBy("file", "line").select("printed")
