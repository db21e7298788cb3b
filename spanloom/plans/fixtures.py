"""Small syntax trees for the queries over trees, with the rows they must give."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from spanloom.session import shared_dir, store_uri


def _e(tag: str, at: tuple[int, int], *children: str, text: str = "", field: str = "") -> str:
    mark = f' field="{field}"' if field else ""
    return f'<{tag}{mark} srow="{at[0]}" scol="{at[1]}">{text}{"".join(children)}</{tag}>'


def _id(name: str, at: tuple[int, int], field: str = "") -> str:
    return _e("identifier", at, text=name, field=field)


def _doc(path: str, tree: str) -> str:
    return f'<sources><source name="{path}">{tree}</source></sources>'


# class Store: def load: Query(); db.fetch(x)   /   def main: load(); os.path.join()   /   json.dumps() at the top
PYTHON = _doc("/a/app.py", _e("module", (0, 0),
    _e("class_definition", (1, 0), _id("Store", (1, 6), "name"), _e("block", (2, 4),
        _e("function_definition", (2, 4), _id("load", (2, 8), "name"), _e("block", (3, 8),
            _e("call", (3, 8), _id("Query", (3, 8)), _e("argument_list", (3, 13))),
            _e("call", (4, 8), _e("attribute", (4, 8), _id("db", (4, 8)), _id("fetch", (4, 11))), _e("argument_list", (4, 16), _id("x", (4, 17)))))))),
    _e("function_definition", (6, 0), _id("main", (6, 4), "name"), _e("block", (7, 4),
        _e("call", (7, 4), _id("load", (7, 4)), _e("argument_list", (7, 8))),
        _e("call", (8, 4), _e("attribute", (8, 4), _e("attribute", (8, 4), _id("os", (8, 4)), _id("path", (8, 7))), _id("join", (8, 12))), _e("argument_list", (8, 16))))),
    _e("call", (10, 0), _e("attribute", (10, 0), _id("json", (10, 0)), _id("dumps", (10, 5))))))
# class Service { void run() { helper.go(); new Task(); } }
JAVA = _doc("/a/Service.java", _e("program", (0, 0),
    _e("class_declaration", (0, 0), _id("Service", (0, 6), "name"), _e("class_body", (0, 14),
        _e("method_declaration", (1, 2), _e("void_type", (1, 2), text="void"), _id("run", (1, 7), "name"), _e("block", (1, 13),
            _e("method_invocation", (2, 4), _id("helper", (2, 4), "object"), _id("go", (2, 11), "name")),
            _e("object_creation_expression", (3, 4), _e("type_identifier", (3, 8), text="Task"))))))))
BROKEN = "<sources><source>"

NODES = [("app.py:2:1", "Store", 2), ("app.py:3:5", "load", 3), ("app.py:7:1", "main", 7), ("Service.java:1:1", "Service", 1), ("Service.java:2:3", "run", 2)]
CALLS = [("app.py:3:5", "Query", 4), ("app.py:7:1", "load", 8), ("Service.java:2:3", "helper", 3)]
SINKS = [("app.py:3:5", "db.fetch", "db", 5), ("app.py:7:1", "os.path.join", "os", 9), ("", "json.dumps", "json", 11)]


def trees(spark: SparkSession) -> DataFrame:
    rows = [("app.py", "python", PYTHON), ("Service.java", "java", JAVA), ("none.go", "go", "<sources/>"), ("bad.py", "python", BROKEN)]
    return spark.createDataFrame(rows, "file string, language string, xml string")


EDGES = [("app.py:7:1", "app.py:3:5", "calls", "app.py", 0, "app.py", 8)]
MODULES = [("app", "app.py"), ("Service", "Service.java"), ("db", "db.py"), ("os.path", "os/path.py")]


def files(spark: SparkSession) -> DataFrame:
    rows = [("app.py", "/a/app.py", "python", 9, 1, False, "from db import fetch\nimport os.path\n"), ("Service.java", "/a/Service.java", "java", 9, 1, False, "class Service {}")]
    return spark.createDataFrame(rows, "path string, abs_path string, language string, size long, mtime long, is_test boolean, text string")


#: (path, language, is_test) of the files in a small tree that a scan must find
TREE = [("pkg/__init__.py", "python", False), ("pkg/__main__.py", "python", False), ("_vendor/b.py", "python", False), (".github/deep/c.py", "python", False), ("pkg/D.Py", "python", False), ("_x_test.go", "go", True), ("top.RS", "rust", False)]
PASSED_OVER = ["vendor/no.py", "pkg/build/no.py", ".git/no.py", "readme.md"]


def tree(spark: SparkSession) -> str:
    """A new folder with that tree and what a scan passes over."""
    root = f"{shared_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    fs, base = pafs.FileSystem.from_uri(store_uri(root))
    for name in [*(t[0] for t in TREE), *PASSED_OVER]:
        fs.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(b"x = 1")
    return root
