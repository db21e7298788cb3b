"""Syntax trees in XML to nodes, raw calls and sinks.

A document is ``<sources><source name=...>TREE</source>...</sources>``.  The walk
of one file is the only step that isn't a column expression, as trees recurse:
an Arrow-batched map parses each file's document and returns one tagged row
type, from which the three relations are filters.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from spanloom.functions.names import package
from spanloom.sources.langs import CALLABLES, LANGUAGES, Language

WALKED = "file string, ord int, kind string, id string, name string, line int, `column` int, src string"


def _text(e: ET.Element) -> str:
    """An element's own name: its attribute, else its character data without its children's."""
    own = e.get("name") or ""
    return own or "".join([e.text or "", *(c.tail or "" for c in e)]).strip()


def name_of(e: ET.Element, tags: tuple[str, ...], intent: bool = False) -> str:
    """The name of a declaration.

    First its own attribute; then, among its identifiers and then among all its
    children in order, the first with a text of its own or a name inside.  With
    ``intent`` the child marked as the name comes before all.
    """
    if e.tag in tags and e.get("name"):
        return e.get("name")
    inside = lambda c: (_text(c) if c.tag in tags else "") or name_of(c, tags)
    marked = [c for c in e if c.get("field") == "name"] if intent else []
    order = [*marked, *e.findall("identifier"), *e]
    return next(filter(None, map(inside, order)), "")


def dotted_of(e: ET.Element) -> str:
    """First and last name of a qualified element, with a dot; "" if it has fewer than two."""
    parts = [x for x in (_text(c) if c.tag == "identifier" else dotted_of(c) for c in e) if x]
    return f"{parts[0]}.{parts[-1]}" if len(parts) > 1 else ""


def callee_of(e: ET.Element, tags: tuple[str, ...]) -> str:
    """What a call names: the first child that settles it."""
    for c in e:
        found = c.tag in tags and _text(c)
        if not found and c.tag in ("member_expression", "field_expression", "attribute", "field_access"):
            found = dotted_of(c)
        if not found and c.tag in ("member_expression", "field_expression", "scoped_identifier"):
            found = name_of(c, tags)
        if found:
            return found
    return ""


@dataclass
class Walk:
    """The rows of one file, in the order of its tree."""

    file: str
    lang: Language
    intent: bool = False
    rows: list[tuple] = field(default_factory=list)
    first: dict[str, str] = field(default_factory=dict)

    def add(self, kind: str, name: str, e: ET.Element, src: str) -> None:
        line, column = int(e.get("srow", 0)) + 1, int(e.get("scol", 0)) + 1
        self.rows.append((self.file, len(self.rows), kind, f"{self.file}:{line}:{column}", name, line, column, src))

    def visit(self, root: ET.Element) -> list[tuple]:
        todo = [(root, "")]
        while todo:  # not recursive: trees can be deep
            e, scope = todo.pop()
            declares = e.tag in self.lang.declarations
            if declares or e.tag in CALLABLES:
                name = name_of(e, self.lang.names, self.intent)
                scope = name or scope
                if declares and name:
                    self.add("node", name, e, "")
                    self.first.setdefault(name, self.rows[-1][3])
            if e.tag in self.lang.calls and (callee := callee_of(e, self.lang.callees)):
                src = self.first.get(scope, "") if scope else ""
                if "." in callee:
                    self.add("sink", callee, e, src)
                elif src:
                    self.add("call", callee, e, src)
            todo.extend((c, scope) for c in reversed(e))
        return self.rows


def walk(xml: str | bytes, file: str, language: str, intent: bool = False) -> list[tuple]:
    """The rows of the first source of a document; an unknown language is an error."""
    if language not in LANGUAGES:
        raise ValueError(f"unsupported language: {language}")
    source = ET.fromstring(xml).find("source")
    return [] if source is None else [r for tree in source for r in Walk(file, LANGUAGES[language], intent).visit(tree)]


def walked(files: DataFrame, intent: bool = False) -> DataFrame:
    """One row type for all findings, from (file, language, xml).  A document that can't be
    read gives one row of kind ``error`` with the reason, and harms no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0].strip("`") for x in WALKED.split(", ")]
        for b in batches:
            rows = []
            for file, language, xml in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows += walk(xml or "<sources/>", file, language, intent)
                except (ET.ParseError, ValueError) as e:
                    rows.append((file, 0, "error", "", str(e), 0, 0, language))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return files.select("file", "language", "xml").mapInArrow(run, WALKED)


_SOURCE = re.compile(r"<source\b[^>]*?\bname=(\"[^\"]*\"|'[^']*').*?(?=<source\b|</sources>|\Z)", re.S)


def _sources(xml: str) -> list[tuple[str, str]]:
    """(name, document) of every source; those of a broken document are cut out one by one, so
    that each stands or fails on its own."""
    try:
        return [(s.get("name"), f"<sources>{ET.tostring(s, 'unicode')}</sources>") for s in ET.fromstring(xml or "<sources/>").iter("source")]
    except ET.ParseError:
        return [(unescape(m.group(1)[1:-1]), f"<sources>{m.group(0)}</sources>") for m in _SOURCE.finditer(xml)]


def batch_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(file, language, xml) of every source in (xml) that names a file's abs_path.

    Sources of other names are left out; each document holds many sources.  A
    source that can't be read becomes an error row of its file in ``walked``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for xml in b.column(0).to_pylist():
                rows = _sources(xml)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["abs_path", "xml"])

    return documents.select("xml").mapInArrow(run, "abs_path string, xml string").join(files.select("abs_path", F.col("path").alias("file"), "language"), "abs_path").select("file", "language", "xml")


def register_sql(spark) -> None:
    """The SQL table function ``ast_walk(file, language, xml)``: the rows of a tree, by kind."""

    @udtf(returnType=WALKED)
    class AstWalk:
        def eval(self, file: str, language: str, xml: str):
            try:
                yield from walk(xml or "<sources/>", file, language)
            except (ET.ParseError, ValueError) as e:
                yield file, 0, "error", "", str(e), 0, 0, language

    spark.udtf.register("ast_walk", AstWalk)


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'node'").select("id", "name", "file", "line", "column")


def calls_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'call'").select("src", F.col("name").alias("callee_name"), F.lit("calls").alias("kind"), "file", "line")


def sinks_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'sink'").select("src", F.col("name").alias("callee_name"), package(F.col("name")).alias("pkg"), "file", "line")


def errors_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'error'").select("file", F.col("src").alias("language"), F.col("name").alias("error"))
