"""The engine on small graphs, texts and trees with known answers."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom import tools
from spanloom.build import build, extract
from spanloom.functions.names import dir_name, has_word, method_of, object_of, package, trimmed
from spanloom.operators import aggregates, graph, grep, imports, resolve, search
from spanloom.sources import ast_xml, store
from spanloom.sources.scan import TreeChanges, changed, scan
from spanloom.streaming import watch
from spanloom.tools import Tools

NODES = "id string, name string, file string, line int, `column` int"
EDGES = "src string, dst string, kind string, file string, line int"
ALL_EDGES = EDGES + ", call_file string, call_line int"
SINKS = "src string, callee_name string, pkg string, file string, line int"
TEXT = {"lane.go": "package lane\n\nfunc Overtake(turn string) bool {\n\treturn Fetch(turn)\n}\n\nfunc Moving(p string) bool {\n\treturn Overtake(p)\n}\n", "map/map.go": "package map\n\n\n\nfunc Fetch(q string) bool {\n"}


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("lane.go", 3, "Overtake"), ("lane.go", 8, "Moving"), ("lane.go", 15, "keeper"), ("map/map.go", 5, "Fetch"), ("map/map.go", 12, "Enter")]
    frame = spark.createDataFrame
    lines = grep.lines_of(frame(list(TEXT.items()), "file string, text string"))
    return {
        "nodes": frame([(f"{f}:{n}:1", x, f, n, 1) for f, n, x in nodes], NODES),
        "edges": frame([("lane.go:8:1", "lane.go:3:1", "calls", "lane.go", 9), ("lane.go:3:1", "map/map.go:5:1", "calls", "lane.go", 4)], EDGES),
        "sinks": frame([("map/map.go:5:1", "sql.Fetch", "sql", "map/map.go", 6), ("lane.go:3:1", "os.ReadFile", "os", "lane.go", 5), ("", "log.Print", "log", "lane.go", 1)], SINKS),
        "lines": lines,
    }


def names(df):
    return sorted(r["name"] for r in df.collect())


@pytest.mark.parametrize("query, ci, want", [
    ("Overtake", False, ["Overtake"]), ("overtake", True, ["Overtake"]), ("verta", False, ["Overtake"]), ("Over*", False, ["Overtake"]), ("over*", False, []),
    ("over*", True, ["Overtake"]), ("Nowhere", False, []), ("", False, []), ("*", True, ["Overtake", "Enter", "Moving", "Fetch", "keeper"]), ("?oving", False, ["Moving"]), ("[EF]*e*", False, ["Enter", "Fetch"]),
    ("[^E]*e[!-", False, []), ("OVE", False, ["Overtake"]), ("E", False, ["Overtake", "Enter", "Fetch", "keeper"]), ("e", True, ["Overtake", "Enter", "Fetch", "keeper"]),
])
def test_search(g, query, ci, want):
    assert names(search.query(g["nodes"], query, ci)) == sorted(want)


def test_prefix_reaches_the_scan(spark, g, tmp_path):
    g["nodes"].write.parquet(f"{tmp_path}/n")
    plan = search.query(spark.read.parquet(f"{tmp_path}/n"), "Over*").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,Over)" in plan


def test_camel_is_a_subsequence_of_capitals(spark):
    n = spark.createDataFrame([("1", "HTTPServerConfig", "f", 1, 1), ("2", "hatStand", "f", 2, 1), ("3", "SamplingParams", "f", 3, 1)], NODES)
    assert names(search.camel(n, "HSC")) == ["HTTPServerConfig"] and names(search.camel(n, "SP")) == ["SamplingParams"] and names(search.camel(n, "S1")) == [] and names(search.camel(n, "S")) == []


def test_callers_and_callees(g):
    at = lambda i: g["nodes"].where(F.col("id") == i)
    assert [r["caller_name"] for r in graph.callers(g["edges"], g["nodes"], at("lane.go:3:1")).collect()] == ["Moving"]
    assert [r["callee_name"] for r in graph.callees(g["edges"], g["nodes"], at("lane.go:3:1")).collect()] == ["Fetch"]
    dangling = g["edges"].unionByName(g["edges"].limit(1).withColumn("src", F.lit("gone")))
    assert graph.callers(dangling, g["nodes"], at("lane.go:3:1")).count() == 1
    assert graph.sinks_with_caller(g["sinks"], g["nodes"]).where("caller_name is null").count() == 1
    assert graph.node_by_id(g["nodes"], "lane.go:8:1").first()["name"] == "Moving"


@pytest.mark.parametrize("pattern, want", [
    ("os", [["lane.go:8:1", "lane.go:3:1", "os.ReadFile"]]), ("sql", [["lane.go:8:1", "lane.go:3:1", "map/map.go:5:1", "sql.Fetch"]]), ("none", []),
    ("*", [["lane.go:8:1", "lane.go:3:1", "map/map.go:5:1", "sql.Fetch"], ["lane.go:8:1", "lane.go:3:1", "os.ReadFile"]]),
])
def test_reachable(g, pattern, want):
    found = graph.reachable(g["edges"], g["sinks"], g["nodes"].where("name = 'Moving'"), pattern)
    assert sorted(r["path"] for r in found.collect()) == sorted(want)


def test_reach_is_bounded_and_shortest(spark):
    e = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}", "calls", "f", 0) for k in range(99)] + [("n000", "n001", "calls", "f", 1), ("n002", "n000", "calls", "f", 1)], EDGES)
    start = spark.createDataFrame([("n000",)], "id string")
    assert {r["node"]: r["depth"] for r in graph.reach(e, start, 10).collect()} == {f"n{k:03}": k + 1 for k in range(10)}
    two = spark.createDataFrame([("a", "c", "calls", "f", 0), ("a", "b", "calls", "f", 0), ("b", "d", "calls", "f", 0), ("c", "d", "calls", "f", 0)], EDGES)
    both = graph.reach(two, spark.createDataFrame([("a",), ("c",)], "id string"))
    assert sorted((r["start"], r["path"]) for r in both.where("node = 'd'").collect()) == [("a", ["a", "b", "d"]), ("c", ["c", "d"])]


def test_paths_by_name(g):
    found = graph.rendered(graph.reachable(g["edges"], g["sinks"], g["nodes"].where("name = 'Moving'"), "os"), g["nodes"])
    assert [r["shown"] for r in found.collect()] == ["Moving -> Overtake -> os.ReadFile"]


def test_groups(spark, g):
    assert dict(map(tuple, aggregates.distribution(g["nodes"]).collect())) == {"O": 1, "E": 1, "K": 1, "M": 1, "F": 1}
    assert dict(map(tuple, aggregates.sinks_by_package(g["sinks"]).collect())) == {"sql": 1, "os": 1, "log": 1}
    assert [r["cnt"] for r in aggregates.package_listing(g["sinks"], "LO").collect()] == [1]
    assert [tuple(r)[1:] for r in aggregates.symbol_listing(g["nodes"], g["sinks"], "fetch").collect()] == [("Fetch", 1)]
    assert [(r["line"], r["name"]) for r in aggregates.outline(g["nodes"], "lane.go").collect()] == [(3, "Overtake"), (8, "Moving"), (15, "keeper")]
    assert dict(map(tuple, aggregates.summary(g["lines"].select("file").distinct(), g["nodes"], g["edges"]).collect())) == {"files": 2, "nodes": 5, "edges": 2}
    files = spark.createDataFrame([("go",), ("go",), ("rust",)], "language string")
    assert [r[0] for r in aggregates.missing_languages(files, spark.createDataFrame([("go",)], "language string")).collect()] == ["rust"]


@pytest.mark.parametrize("args, want", [
    (["Overtake"], ["lane.go:3:func Overtake(turn string) bool {"]), (["Moving"], ["lane.go:8:return Overtake(p)"]), (["keeper"], ["lane.go:15:keeper"]), (["-c", "NothingOfThisName"], ["0"]), (["-v", "Overtake"], []),
    (["-h", "Moving"], ["8:return Overtake(p)"]), (["-o", "Mov*"], ["Mov*"]), (["-l", "Fetch"], ["map/map.go"]), (["-q", "Moving"], []), (["-w", "Moving"], ["lane.go:8:return Overtake(p)"]), (["Moving", "./map"], []),
    (["-m1", "e"], ["lane.go:3:func Overtake(turn string) bool {"]), (["-C", "1", "Overtake"], ["\nfunc Overtake(turn string) bool {\nreturn Fetch(turn)"]), (["-t", "Over.*p"], ["lane.go:8:return Overtake(p)"]), (["-i", "RETURN F"], ["lane.go:4:return Fetch(turn)"]),
])
def test_grep(g, args, want):
    assert [r["printed"] for r in grep.grep(g["nodes"], g["lines"], grep.parse(args)).collect()] == want


def test_grep_flags():
    o = grep.parse(["-inwA3", "-B", "2", "-e", "x", "-e", "y", "--include=*.go", "--max-count", "5", "a", "b"])
    assert (o.pattern, o.paths, o.ignore_case, o.word, o.after, o.before, o.include, o.max_count) == ("y", ("a", "b"), True, True, 3, 2, ("*.go",), 5)
    assert grep.parse(["-C2", "p"]).before == 2 and grep.parse(["p"]).paths == (".",)


def test_grep_separators(g):
    rows = grep.context(grep.hits(g["nodes"], g["lines"], grep.GrepOptions(pattern="*")), g["lines"], 0, 1).orderBy("file", "line").collect()
    assert [(r["line"], r["separated"]) for r in rows] == [(3, False), (8, True), (15, True), (5, True), (12, True)]


def test_names(spark):
    df = spark.createDataFrame([("a.b.c",), (".x",), ("plain",), ("",)], "c string")
    assert [tuple(r) for r in df.select(package(F.col("c")), object_of(F.col("c")), method_of(F.col("c"))).collect()] == [("a", "a", "b.c"), (".x", "", "x"), ("plain", "", "plain"), ("", "", "")]
    df = spark.createDataFrame([("a/b/c",), ("x",)], "c string")
    assert [r[0] for r in df.select(dir_name(F.col("c"))).collect()] == ["a/b", "."]
    df = spark.createDataFrame([("  say AND_x and \t",), ("candy",)], "c string")
    assert [tuple(r) for r in df.select(has_word(F.col("c"), "and"), trimmed(F.col("c"))).collect()] == [(True, "say AND_x and"), (False, "candy")]


def code(spark, language, text):
    return imports.code_lines(spark.createDataFrame([("f", language, text)], "file string, language string, text string"))


def test_imports_of_python(spark):
    c = code(spark, "python", "from map.car_table import CarTable\nfrom utils.keeper import widen, narrow as nar\n# from x import y\nimport os\nimport solar.pv as pv\nfrom a import *\n")
    assert [tuple(r)[1:] for r in imports.imports(c).orderBy("ord").collect()] == [(0, "CarTable", "map/car_table.py", ""), (1, "widen", "utils/keeper.py", ""), (2, "narrow", "utils/keeper.py", "nar"), (3, "pv", "solar/pv.py", "solar.pv")]
    assert {r["module"]: r["path"] for r in imports.file_modules(c).collect()} == {"map.car_table": "map/car_table.py", "utils.keeper": "utils/keeper.py", "os": "os.py", "solar.pv": "solar/pv.py", "a": "a.py"}


def test_imports_of_java_go_and_rust(spark):
    j = code(spark, "java", "import com.foo.CarTable;\nimport static java.util.*;\nint x;\nfoo.bar();")
    assert {r["module"]: r["path"] for r in imports.file_modules(j, intent=True).collect()} == {"com.foo.CarTable": "com/foo/CarTable.java", "java.util.*": "java/util/"}
    assert [r["short_name"] for r in imports.imports(j, intent=True).collect()] == ["CarTable"] and imports.imports(j).count() == 2
    go = code(spark, "go", 'import (\n\t"ours/map"\n\t"ours/utils"\n\tmaps "github.com/someone/maps"\n)\nimport "fmt"')
    assert {r["module"]: r["path"] for r in imports.file_modules(go).collect()} == {"map": "ours/map/", "utils": "ours/utils/", "maps": "github.com/someone/maps", "fmt": "fmt/", "import": "fmt"}
    assert imports.imports(go).count() == 0
    r = code(spark, "rust", "use crate::map::CarTable;\nlet x = 1;\nuse std::io}")
    assert [tuple(x)[2:4] for x in imports.imports(r).orderBy("ord").collect()] == [("CarTable", "crate/map.rs"), ("io", "std.rs")]


def test_a_very_long_line_ends_the_file(spark):
    c = code(spark, "python", "import a\n" + "x" * 70_000 + "\nimport b")
    assert [r["module"] for r in imports.file_modules(c).collect()] == ["a"]
    whole = imports.code_lines(spark.createDataFrame([("f", "python", "import a\n" + "x" * 70_000 + "\nimport b")], "file string, language string, text string"), intent=True)
    assert sorted(r["module"] for r in imports.file_modules(whole).collect()) == ["a", "b"]


def test_variable_types(spark):
    of = lambda language, text, **o: {r["var"]: r["type"] for r in imports.var_map(code(spark, language, text), **o).collect()}
    assert of("python", "table = CarTable()") == {"table": "CarTable"} and of("python", "def f(table: CarTable, n: int):") == {"table": "CarTable"}
    assert of("java", "CarTable carTable = new CarTable();\nString result = carTable.carOf(id);") == {"carTable": "CarTable", "result": "String"}
    assert of("python", "x: List[Car] = []") == {"x": "List"} and of("python", "x: List[Car] = []", intent=True) == {"x": "Car"}
    assert of("python", "a = B(1)\na = C(2)") == {"a": "C"}


def test_module_map_of_nodes(spark):
    n = spark.createDataFrame([(f,) for f in ("map/car_table.py", "service/road_service.py", "com/foo/CarTable.java", "com/foo/CarService.java", "pkg/__init__.py", "root.go")], "file string")
    assert {r["module"]: r["path"] for r in imports.node_modules(n).collect()} == {
        "map.car_table": "map/car_table.py", "service.road_service": "service/road_service.py", "com.foo.CarTable": "com/foo/CarTable.java", "com.foo.CarService": "com/foo/CarService.java", "pkg": "pkg/__init__.py", "map": "map/", "service": "service/", "foo": "com/foo/",
    }


RAW = "src string, callee_name string, kind string, file string, line int"


@pytest.mark.parametrize("callee, file, nodes, imps, vars_, want", [
    ("carTable.carOf", "service/A.java", [("map/CarTable.java", 15, "carOf"), ("service/A.java", 3, "carOf")], [("CarTable", "map/CarTable.java", "")], [], "map/CarTable.java:15:1"),
    ("widen", "a.go", [("a.go", 10, "widen"), ("b.go", 5, "widen")], [("b", "b.go", "")], [], "a.go:10:1"),
    ("table.carOf", "s.py", [("map/table.py", 10, "carOf")], [("CarTable", "map/table.py", "")], [("table", "CarTable")], "map/table.py:10:1"),
    ("list.fetch", "s.py", [("map/table.py", 8, "fetch")], [("CarTable", "map/table.py", "")], [("list", "CarTable")], "map/table.py:8:1"),
    ("load", "s.py", [("y.py", 2, "load"), ("x.py", 1, "load")], [("nothing", "z.py", ""), ("other", "x.py", ""), ("load", "y.py", "")], [], "x.py:1:1"),
    ("missing", "s.py", [("y.py", 2, "load")], [("load", "y.py", "")], [], None),
])
def test_resolution(spark, callee, file, nodes, imps, vars_, want):
    frame = spark.createDataFrame
    n = frame([(f"{f}:{k}:1", x, f, k, 1) for f, k, x in nodes], NODES)
    i = frame([(file, k, *x) for k, x in enumerate(imps)], "file string, ord int, short_name string, full_path string, alias string")
    v = frame([(file, *x) for x in vars_], "file string, var string, type string")
    found = resolve.resolve(frame([("caller", callee, "calls", file, 7)], RAW), n, i, frame([], "module string, path string"), v).collect()
    assert [(r["dst"], r["line"], r["call_line"]) for r in found] == ([(want, 0, 7)] if want else [])


def test_trees_of_other_shapes():
    doc = lambda body: f'<sources><source name="x"><m>{body}</m></source></sources>'
    assert ast_xml.walk("<sources/>", "f", "go") == []
    with pytest.raises(ValueError, match="unsupported"):
        ast_xml.walk("<sources/>", "f", "cobol")
    method = '<method_declaration srow="0" scol="0"><type_identifier>Car</type_identifier><identifier>loving</identifier></method_declaration>'
    assert ast_xml.walk(doc(method), "f", "java")[0][4] == "loving"
    call = '<call srow="1" scol="2"><attribute><identifier>obj</identifier><identifier>method</identifier></attribute></call>'
    assert [(r[2], r[4], r[7]) for r in ast_xml.walk(doc(call), "f", "python")] == [("sink", "obj.method", "")]
    field = '<field_declaration srow="0" scol="0"><type_identifier>T</type_identifier><variable_declarator><identifier field="name">x</identifier></variable_declarator></field_declaration>'
    assert ast_xml.walk(doc(field), "f", "java")[0][4] == "T"


SOURCE = {"app.py": "from lib import keeper\nclass Store:\n    pass\n", "lib.py": "def keeper():\n    pass\n", "notes.md": "x", "node_modules/a.js": "x", "foo_test.go": "x", ".git/b.py": "x"}


@pytest.fixture
def tree(tmp_path):
    for f, t in SOURCE.items():
        p = tmp_path / "src" / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(t)
    return str(tmp_path / "src")


def test_scan(spark, tree):
    rows = {r["path"]: r for r in scan(spark, tree, texts=True).collect()}
    assert rows.keys() == {"app.py", "lib.py", "foo_test.go"}
    assert rows["foo_test.go"]["is_test"] and not rows["app.py"]["is_test"] and rows["app.py"]["language"] == "python"
    assert rows["lib.py"]["text"] == SOURCE["lib.py"] and rows["lib.py"]["size"] == len(SOURCE["lib.py"]) and rows["lib.py"]["abs_path"] == f"{tree}/lib.py"


def test_scan_finds_every_name(spark, tmp_path):
    names = ["pkg/__init__.py", "pkg/__main__.py", "pkg/a.py", "_vendor/b.py", ".github/deep/c.py", "pkg/D.Py", "_x.go", ".hidden.rs", "top.JS"]
    for n in [*names, "vendor/no.py", "pkg/build/no.py", "pkg/.git/no.py", "readme.md", "pkg/.py"]:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x = 1 # \xff")
    got = {r["path"]: r for r in scan(spark, str(tmp_path), texts=True).collect()}
    assert got.keys() - {"pkg/.py"} == set(names) and got["pkg/D.Py"]["language"] == "python" and got["top.JS"]["text"] == "x = 1 # \ufffd"
    assert scan(spark, str(tmp_path / "vendor")).count() == 1 and scan(spark, str(tmp_path / "nothing")).count() == 0


def element(tag, row, *body):
    return f'<{tag} srow="{row}" scol="0">{"".join(body)}</{tag}>'


def tree_of(name):
    ident = lambda n: f"<identifier>{n}</identifier>"
    body = {"app.py": element("function_definition", 1, ident("main"), element("call", 2, ident("keeper"))), "lib.py": element("function_definition", 0, ident("keeper"))}[name]
    return f'<sources><source name="{name}">{element("module", 0, body)}</source></sources>'


def trees_of(spark, files):
    return spark.createDataFrame([(f, "python", tree_of(f)) for f in files], "file string, language string, xml string")


def test_build_save_and_load(spark, tree, tmp_path):
    files = scan(spark, tree, texts=True).where("language = 'python'")
    built = build(files, trees_of(spark, ("app.py", "lib.py")))
    assert [tuple(r) for r in built["edges"].collect()] == [("app.py:2:1", "lib.py:1:1", "calls", "lib.py", 0, "app.py", 3)]
    store.save(built, f"{tmp_path}/index")
    back = store.load(spark, f"{tmp_path}/index")
    assert Counter(map(tuple, back["nodes"].collect())) == Counter(map(tuple, built["nodes"].collect())) and back["annotations"].count() == 0 and back["edges_by_src"].count() == 1
    new = spark.createDataFrame([("1", "lib.py:1:1", "owner", "me", "hand", "")], store.TABLES["annotations"])
    store.save({"annotations": store.annotate(back, new)}, f"{tmp_path}/index")
    store.save({"annotations": store.annotate(store.load(spark, f"{tmp_path}/index"), new.withColumn("value", F.lit("you")))}, f"{tmp_path}/index")
    again = store.load(spark, f"{tmp_path}/index")
    assert [r["value"] for r in store.annotations_of(again, "lib.py:1:1").collect()] == ["you"] and again["nodes"].count() == 2
    assert len(os.listdir(f"{tmp_path}/index/_versions")) <= 2 * 2  # with checksums
    store.export_json({"nodes": back["nodes"]}, f"{tmp_path}/json")
    assert os.path.isdir(f"{tmp_path}/json/nodes")
    store.save({}| {"manifest": back["manifest"]}, f"{tmp_path}/index", version="2")
    with pytest.raises(ValueError, match="index again"):
        store.load(spark, f"{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"{tmp_path}/none")


def test_lookups_reach_the_scan(spark, g, tmp_path):
    full = g["edges"].withColumn("call_file", F.col("file")).withColumn("call_line", F.col("line"))
    store.save({"nodes": g["nodes"], "edges": full}, f"{tmp_path}/i")
    index = store.load(spark, f"{tmp_path}/i")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,Moving)" in plan(search.query(index["nodes"], "Moving"))
    assert "EqualTo(dst,x)" in plan(graph.callers_of(index["edges"], index["nodes"], "x")) and "EqualTo(src,x)" in plan(graph.callees_of(index["edges_by_src"], index["nodes"], "x"))


def test_walk_in_sql(spark):
    ast_xml.register_sql(spark)
    spark.createDataFrame([("lib.py", "python", tree_of("lib.py")), ("bad.py", "python", "<a")], "file string, language string, xml string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT w.kind, w.id, w.file FROM sources s, LATERAL ast_walk(s.file, s.language, s.xml) w").collect()
    assert Counter(map(tuple, rows)) == Counter([("node", "lib.py:1:1", "lib.py"), ("error", "", "bad.py")])


def test_batch_documents(spark):
    both = tree_of("app.py").replace("</sources>", "") + tree_of("lib.py").replace("<sources>", "")
    files = spark.createDataFrame([("p/lib.py", "lib.py", "python"), ("p/bad.py", "bad.py", "python")], "path string, abs_path string, language string")
    half = tree_of("lib.py").replace("</sources>", '<source name="bad.py"><m></source></sources>')
    for text, errors in ((both, []), (half, ["p/bad.py"])):
        rows = ast_xml.walked(ast_xml.batch_files(spark.createDataFrame([(text,)], "xml string"), files))
        assert [r["id"] for r in ast_xml.nodes_of(rows).collect()] == ["p/lib.py:1:1"] and [r["file"] for r in ast_xml.errors_of(rows).collect()] == errors


def test_manifests(spark):
    m = lambda rows: spark.createDataFrame(rows, "path string, mtime bigint")
    assert dict(map(tuple, changed(m([("a", 1), ("b", 1), ("c", 1)]), m([("b", 2), ("c", 1), ("d", 1)])).collect())) == {"a": "remove", "b": "write", "d": "create"}


@pytest.fixture
def live(spark, tmp_path):
    root = tmp_path / "live"
    root.mkdir()

    def put(**files):
        for n, text in files.items():
            (root / f"{n}.py").write_text(text)

    def source(text):  # a tree of a tiny language: a line is ``def name`` or a call's name
        el = lambda tag, row, inner: f'<{tag} srow="{row}" scol="0">{inner}</{tag}>'
        ident, body = (lambda n: f"<identifier>{n}</identifier>"), []
        for k, line in enumerate(text.splitlines()):
            if line.startswith("def "):
                body.append([k, line[4:], ""])
            elif body and line and not line.startswith(("from", "import")):
                body[-1][2] += el("call", k, ident(line))
        return f'<sources><source name="x">{el("module", 0, "".join(el("function_definition", k, ident(n) + calls) for k, n, calls in body))}</source></sources>'

    def inputs(files):
        files = files.withColumn("xml", F.udf(source)("text"))
        return files, files.select(F.col("path").alias("file"), "language", "xml")

    def fresh():
        return build(*inputs(scan(spark, str(root), texts=True)))

    def again(written):
        return extract(*inputs(scan(spark, str(root), texts=True).join(written, "path", "left_semi")))

    def same(index, names=("files", "nodes", "edges", "sinks", "imports", "mod_map", "manifest")):
        want = fresh()
        return all(Counter(map(tuple, index[n].select(*want[n].columns).collect())) == Counter(map(tuple, want[n].collect())) for n in names)

    return root, put, fresh, again, same


def test_updates_give_what_a_fresh_build_gives(spark, live, tmp_path):
    root, put, fresh, again, same = live
    index = f"{tmp_path}/index"
    put(lib="def help\n", app="from lib import help\ndef main\nhelp\n", other="import lib\ndef main\nmain\n")
    store.save(fresh(), index)
    for writes, removed in (({"lib": "\n\ndef help\ndef more\n"}, []), ({}, ["lib"]), ({"lib": "def help\nmore\ndef more\n", "new": "from lib import more\ndef x\nmore\n"}, ["other"]), ({}, ["app"])):
        put(**writes)
        for n in removed:
            (root / f"{n}.py").unlink()
        events = [(f"{n}.py", "write", 1) for n in writes] + [(f"{n}.py", "remove", 1) for n in removed]
        before = store.load(spark, index)
        rows = before["nodes"].count()
        watch.apply_events(spark, index, spark.createDataFrame(events, "path string, op string, mtime long"), again)
        assert same(store.load(spark, index)) and before["nodes"].count() == rows  # an open version stays whole


def test_watch(spark, live, tmp_path):
    root, put, fresh, again, same = live
    index, state = f"{tmp_path}/index", f"{tmp_path}/state"
    put(lib="def help\n", app="from lib import help\ndef main\nhelp\n")
    store.save({k: v.limit(0) for k, v in fresh().items()}, index)
    paths = lambda: {r["path"] for r in store.load(spark, index)["files"].collect()}

    def wait(want):
        end = time.time() + 90
        while time.time() < end and paths() != want:
            time.sleep(0.5)
        assert paths() == want

    q = watch.watch(spark, str(root), index, state, again)
    try:
        wait({"lib.py", "app.py"})
    finally:
        q.stop()
    (root / "lib.py").unlink()  # while nobody looks
    put(late="def y\n")
    q = watch.watch(spark, str(root), index, state, again)
    try:
        wait({"app.py", "late.py"})
    finally:
        q.stop()
    assert same(store.load(spark, index))
    spark.dataSource.register(TreeChanges)
    assert spark.read.format("tree_changes").option("path", str(root)).load().count() == 2


def test_errors_of_a_stream_are_told(spark, live, tmp_path):
    root, put, *_ = live
    put(a="def x\n")
    told = []
    listener = watch.Errors(lambda name, error: told.append(error))
    spark.streams.addListener(listener)
    try:
        q = watch.watch(spark, str(root), f"{tmp_path}/none", f"{tmp_path}/state", lambda written: {})
        with pytest.raises(Exception, match="no index"):
            q.awaitTermination(60)
        end = time.time() + 20
        while not told and time.time() < end:
            time.sleep(0.2)
        assert "no index" in told[0]
    finally:
        spark.streams.removeListener(listener)


def test_events(spark):
    e = spark.createDataFrame([("a", "write", 1), ("a", "remove", 2), ("b", "remove", 1), ("b", "create", 3)], "path string, op string, mtime bigint")
    assert dict(map(tuple, watch.last_events(e).collect())) == {"a": "remove", "b": "create"}
    n = lambda k: spark.range(k)
    assert [watch.needs_rebuild(n(a), n(b)).first()["rebuild"] for a, b in ((20, 9), (20, 10), (9, 20))] == [True, False, True]


def test_tools(g):
    t = Tools(g)
    call = lambda tool, **args: json.loads(next(t.serve([json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": args}})])))
    text = lambda r: json.loads(r["result"]["content"][0]["text"])
    assert text(call("find_symbol", name="Moving"))["symbols"][0]["id"] == "lane.go:8:1"
    assert text(call("find_callers", nodeId="lane.go:3:1")) == {"count": 1, "callers": [{"caller_name": "Moving", "file": "lane.go", "line": 9}]}
    assert text(call("find_callees", nodeId="lane.go:3:1"))["callees"][0]["callee_name"] == "Fetch"
    assert text(call("get_outline", file="map.go"))["count"] == 2
    assert call("find_symbol")["error"]["code"] == -32000 and call("nothing")["error"]["code"] == -32601
    lines = ["", "not json", json.dumps({"id": 2, "method": "tools/list"}), json.dumps({"id": 3, "method": "nothing"}), json.dumps({"id": 4, "method": "tools/call"}), json.dumps({"method": "notifications/initialized"}), json.dumps({"id": 5, "method": "initialize"})]
    got = [json.loads(x) for x in t.serve(lines)]
    assert [x["id"] for x in got] == [2, 3, 4, 5] and len(got[0]["result"]["tools"]) == 4 and got[1]["error"]["code"] == -32601 and got[2]["error"]["code"] == -32602


def test_pages_of_symbols_at_one_place(spark, monkeypatch):
    monkeypatch.setattr(tools, "PAGE", 2)
    t = Tools({"nodes": spark.createDataFrame([(str(k), "Same", "f", 1, 1) for k in (3, 1, 4, 0, 2)], NODES).repartition(3)})
    assert [r["id"] for offset in (0, 2, 4) for r in t.find_symbol("Same", offset=offset)["symbols"]] == ["0", "1", "2", "3", "4"]


def test_command_line(spark, tree, tmp_path, monkeypatch, capsys):
    from spanloom import cli

    (tmp_path / "trees").mkdir()
    for f in ("app.py", "lib.py"):
        (tmp_path / "trees" / f"{f}.xml").write_text(tree_of(f).replace(f'name="{f}"', f'name="{tree}/{f}"'))
    assert cli.run(["index", tree, f"{tmp_path}/trees"]) == 0
    monkeypatch.chdir(tree)
    capsys.readouterr()

    def out(*args):
        assert cli.run(list(args)) == 0
        return capsys.readouterr().out.splitlines()

    assert out("query", "keeper", "--callers") == ["keeper\tlib.py\t1\t1\tlib.py:1:1", "lib.py:1:1\tmain\tlib.py\t0"]
    assert out("outline", "app.py") == ["2\tmain\tapp.py"] and out("list")[:3] == ["files\t3", "nodes\t2", "edges\t1"]
    assert out("grep", "keeper") == ["lib.py:1:def keeper():"] and out("grep", "-c", "main") == ["1"] and out("grep-c", "main") == ["1"] and out("setup")[0].startswith("go\tfunction_declaration") and out("grep", "-h", "class S") == ["2:class Store:"]
    assert cli.run(["grep", "-q", "main"]) == 0 and cli.run(["grep", "-q", "nothing at all"]) == 1
    assert out("sinks") == [] and out("reachable", "main", "--pkg", "os") == []
    monkeypatch.chdir("/")
    assert cli.run(["list"]) == 1
