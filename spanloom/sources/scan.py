"""Source trees as tables of files, texts and lines."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spanloom.functions.names import base_name
from spanloom.session import store_uri
from spanloom.sources.langs import BY_EXTENSION, LANGUAGES, SKIP_DIRS


def language_of(path: Column) -> Column:
    """By the extension in lower case; null for an unknown one."""
    known = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.try_element_at(known, F.lower(F.concat(F.lit("."), F.substring_index(base_name(path), ".", -1))))


def is_test(path: Column, language: Column) -> Column:
    """Whether the base name has a mark of its language's test files anywhere."""
    found = F.lit(False)
    for x in LANGUAGES.values():
        for mark in x.tests:
            found = found | ((language == x.name) & F.contains(base_name(path), F.lit(mark)))
    return F.coalesce(found, F.lit(False))


def in_skipped_dir(path: Column) -> Column:
    """Whether a directory on the way to the file is one that scans leave out."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(dirs, lambda d: d.isin(*SKIP_DIRS))


FILES_READ = "path string, abs_path string, size bigint, mtime bigint, text string"
#: a task's rows go out when they hold so many characters
BATCH_CHARS = 16_000_000


def _listed(fs, folder: str, deep: bool = True) -> Iterator:
    """What a folder holds, without the directories that scans leave out and what is below them."""
    for x in sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.base_name):
        if x.type != pafs.FileType.Directory:
            yield x
        elif x.base_name not in SKIP_DIRS:
            yield x
            if deep:
                yield from _listed(fs, x.path)


def scan(spark: SparkSession, root: str, texts: bool = False) -> DataFrame:
    """(path, abs_path, language, size, mtime, is_test[, text]) of the known files below root.

    The driver lists two levels; each directory there is a row whose task lists
    what is below and, if asked, reads the contents.  Spark's own file readers
    would pass over every name that begins with ``_`` or ``.``.  Extensions
    count in any case.  Bytes that are no UTF-8 are replaced; a file that goes
    away meanwhile is left out.  mtime is in nanoseconds.
    """
    uri = store_uri(root)
    fs, base = pafs.FileSystem.from_uri(uri)
    base = base.rstrip("/")
    store = "" if uri.startswith("file:") else uri.split(":")[0] + "://"
    first = list(_listed(fs, base, False))
    second = [x for d in first if d.type == pafs.FileType.Directory for x in _listed(fs, d.path, False)]
    rows = [(x.path, x.type == pafs.FileType.Directory) for x in second] + [(x.path, False) for x in first if x.type != pafs.FileType.Directory]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        out, held = [], 0
        names = [x.split()[0] for x in FILES_READ.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=names)
        for b in batches:
            for top, is_dir in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for x in _listed(fs, top) if is_dir else [fs.get_file_info(top)]:
                    if x.type != pafs.FileType.File or os.path.splitext(x.base_name)[1].lower() not in BY_EXTENSION:
                        continue
                    text = None
                    if texts:
                        try:
                            with fs.open_input_file(x.path) as f:
                                text = f.read().decode("utf-8", "replace")
                        except FileNotFoundError:
                            continue
                    out.append((x.path[len(base) + 1 :], store + x.path, x.size, x.mtime_ns, text))
                    held += len(text or "") + 100
                    if held > BATCH_CHARS:
                        yield batch(out)
                        out, held = [], 0
        if out:
            yield batch(out)

    tops = spark.createDataFrame(rows, "top string, is_dir boolean").repartition(max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism)))
    found = tops.mapInArrow(read, FILES_READ).withColumn("language", language_of(F.col("path")))
    found = found.withColumn("is_test", is_test(F.col("path"), F.col("language")))
    return found.select("path", "abs_path", "language", "size", "mtime", "is_test", *(["text"] if texts else []))


def read_texts(files: DataFrame) -> DataFrame:
    """(file, text) of (abs_path, file); files that are not there any more are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = pafs.FileSystem.from_uri(store_uri(path))
                if fs.get_file_info(at).type == pafs.FileType.File:
                    with fs.open_input_file(at) as f:
                        yield pa.RecordBatch.from_pydict({"file": [file], "text": [f.read().decode("utf-8", "replace")]})

    return files.select("abs_path", "file").mapInArrow(run, "file string, text string")


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, op): what differs between two manifests (path, mtime): create, write or remove."""
    met = before.select("path", F.col("mtime").alias("old")).join(now.select("path", F.col("mtime").alias("new")), "path", "full")
    op = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "write")
    return met.select("path", op.alias("op")).where("op is not null")


class _Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


def _snapshot(root: str) -> dict[str, tuple[int, int]]:
    found = {}
    for d, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if x not in SKIP_DIRS]
        for n in names:
            if os.path.splitext(n)[1].lower() in BY_EXTENSION:
                p = os.path.join(d, n)
                try:
                    s = os.stat(p)
                except OSError:
                    continue
                found[os.path.relpath(p, root)] = (s.st_mtime_ns, s.st_size)
    return found


class _Changes(DataSourceStreamReader):
    """Offsets carry the number of a snapshot; a batch is the difference of two.

    Snapshots lie in the folder ``state``, so a stream that starts again from
    its checkpoint goes on from the last one, and removals meanwhile show.
    """

    def __init__(self, root: str, state: str):
        self.root, self.state = root, state
        os.makedirs(state, exist_ok=True)
        if not self._numbers():
            self._write(0, {})

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(self.state) if n.endswith(".json"))

    def _write(self, number: int, found: dict) -> None:
        path = os.path.join(self.state, f"{number}.json")
        with open(path + ".tmp", "w") as f:
            json.dump(found, f)
        os.replace(path + ".tmp", path)

    def _read(self, number: int) -> dict[str, tuple[int, int]]:
        with open(os.path.join(self.state, f"{number}.json")) as f:
            return {p: tuple(x) for p, x in json.load(f).items()}

    def initialOffset(self) -> dict:
        return {"n": self._numbers()[0]}

    def latestOffset(self) -> dict:
        now, last = _snapshot(self.root), self._numbers()[-1]
        if now != self._read(last):
            last += 1
            self._write(last, now)
        return {"n": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = self._read(start["n"]), self._read(end["n"])
        rows = [(p, "remove", 0) for p in a.keys() - b.keys()]
        rows += [(p, "write" if p in a else "create", b[p][0]) for p in b if a.get(p) != b[p]]
        return [_Files(sorted(rows))]

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["n"]:
                os.remove(os.path.join(self.state, f"{n}.json"))


class _Listing(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def read(self, partition) -> Iterator[tuple]:
        for p, (mtime, _) in sorted(_snapshot(self.root).items()):
            yield p, "create", mtime


class TreeChanges(DataSource):
    """Format ``tree_changes``: (path, op, mtime) of a local tree, as a batch or a stream.

    Spark's file stream sees new files only; this one compares snapshots, so
    rewritten and removed files come too.  The driver watches the tree; a
    stream keeps its snapshots in the folder of the option ``state``.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "path string, op string, mtime bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options["path"], self.options["state"])
