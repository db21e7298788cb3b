"""Command line: ``python -m spanloom.cli VERB ...``; an index is a folder that Spark can write."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import tools
from spanloom.build import derived, extract
from spanloom.functions.names import package_contains
from spanloom.operators import aggregates, graph, grep, search
from spanloom.sources import ast_xml, store
from spanloom.sources.langs import LANGUAGES
from spanloom.sources.scan import read_texts, scan
from spanloom.streaming import watch

INDEX = ".spanloom"


def find_index(start: str = ".") -> str | None:
    """The index folder of the nearest directory above."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, INDEX)):
            return os.path.join(at, INDEX)
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)


def session() -> SparkSession:
    s = SparkSession.builder.appName("spanloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def show(rows: DataFrame, *cols: str) -> None:
    """Rows as tab-separated lines, fetched partition by partition."""
    for r in rows.select(*cols).toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def lines(index: dict[str, DataFrame], hits: DataFrame | None = None) -> DataFrame:
    """The live lines of the indexed files, or of those that have hits, read where the rows are."""
    files = index["files"].select("abs_path", F.col("path").alias("file"))
    if hits is not None:
        files = files.join(hits.select("file").distinct(), "file", "left_semi").select("abs_path", "file")
    return grep.lines_of(read_texts(files))


def run(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="spanloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("index", "watch"):
        v = verbs.add_parser(verb)
        v.add_argument("path")
        v.add_argument("trees", help="folder of syntax trees in XML; their sources are named by absolute path")
        v.add_argument("--intent", action="store_true")
    for verb in ("list", "serve"):
        verbs.add_parser(verb)
    v = verbs.add_parser("query")
    v.add_argument("name")
    for flag in ("-i", "--callers", "--callees"):
        v.add_argument(flag, action="store_true")
    verbs.add_parser("outline").add_argument("file")
    v = verbs.add_parser("sinks")
    v.add_argument("name", nargs="?", default="")
    v.add_argument("--pkg", default="")
    v = verbs.add_parser("reachable")
    v.add_argument("name")
    v.add_argument("--pkg", default="*")
    verbs.add_parser("grep", add_help=False)
    verbs.add_parser("setup")
    if args and args[0].startswith("grep") and args[0] != "grep":  # grepFLAGS stands for grep -FLAGS
        args = ["grep", "-" + args[0][4:].lstrip("-"), *args[1:]]
    o, rest = p.parse_known_args(args[:1] if args[:1] == ["grep"] else args)
    if o.verb == "grep":
        rest = args[1:]
    elif rest:
        p.error(f"unknown arguments: {rest}")
    spark = session()
    if o.verb in ("index", "watch"):
        return _index(spark, o)
    folder = find_index()
    if folder is None:
        print("no index here or above; run index first", file=sys.stderr)
        return 1
    index = store.load(spark, folder)
    nodes = index["nodes"]
    if o.verb == "setup":  # the languages of the index, and the elements a tree of each must name
        for r in aggregates.languages(index["files"]).orderBy("language").collect():
            print(r["language"], ",".join(LANGUAGES[r["language"]].declarations), sep="\t")
        return 0
    if o.verb == "list":
        show(aggregates.summary(index["files"], nodes, index["edges"]), "kind", "cnt")
        show(aggregates.distribution(nodes).orderBy("letter"), "letter", "cnt")
    elif o.verb == "serve":
        tools.main(index)
    elif o.verb == "query":
        hits = search.query(nodes, o.name, o.i)
        show(hits.orderBy("file", "line"), "name", "file", "line", "column", "id")
        if o.callers:
            show(graph.callers(index["edges"], nodes, hits).orderBy("dst", "caller_id"), "dst", "caller_name", "file", "line")
        if o.callees:
            show(graph.callees(index["edges_by_src"], nodes, hits).orderBy("src", "callee_id"), "src", "callee_name", "file", "line")
    elif o.verb == "outline":
        show(aggregates.outline(nodes, o.file), "line", "name", "file")
    elif o.verb == "sinks":
        if o.name:
            show(aggregates.symbol_listing(search.query(nodes, o.name, True), index["sinks"], o.pkg).orderBy("id"), "id", "name", "cnt")
        else:
            show(aggregates.package_listing(index["sinks"], o.pkg).orderBy(F.desc("cnt"), "pkg"), "pkg", "cnt")
    elif o.verb == "reachable":
        if index["sinks"].where(package_contains(F.col("pkg"), o.pkg)).isEmpty():
            return 0
        found = graph.reachable(index["edges"], index["sinks"], search.query(nodes, o.name, True), o.pkg)
        show(graph.rendered(found, nodes).orderBy("start", "depth", "shown"), "start", "shown")
    else:
        g = grep.parse(rest)
        hits = search.query(nodes, g.pattern, g.ignore_case)
        whole = g.text or hits.isEmpty()
        found = None if whole else hits
        if g.quiet:  # the exit code alone
            return 0 if grep.any_hit(nodes, lines(index, found), g) else 1
        show(grep.grep(nodes, lines(index, found), g), "printed")
    return 0


def _index(spark: SparkSession, o: argparse.Namespace) -> int:
    folder = os.path.join(os.path.abspath(o.path), INDEX)

    def inputs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        documents = spark.read.text(o.trees, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("xml"))
        return files, ast_xml.batch_files(documents, files)

    store.save(extract(*inputs(scan(spark, o.path, texts=True)), o.intent), folder)
    index = store.load(spark, folder)
    store.save(derived(index), folder)  # from the stored tables, so that texts are read once
    index = store.load(spark, folder)
    show(aggregates.summary(index["files"], index["nodes"], index["edges"]), "kind", "cnt")
    if o.verb == "watch":
        again = lambda written: extract(*inputs(scan(spark, o.path, texts=True).join(written, "path", "left_semi")), o.intent)
        spark.streams.addListener(watch.Errors(lambda name, error: print(f"{name}: {error}", file=sys.stderr)))
        watch.watch(spark, o.path, folder, os.path.join(folder, "_state"), again).awaitTermination()
    return 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
