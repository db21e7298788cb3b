"""Token ids in Arrow stream files of fixed-size lists.

The ids of all documents, each ended by an end id, run on in ascending order of
doc_id.  A file holds one range of documents: its ids in sequences of equal
length, ``ids`` (fixed-size list of uint16 or uint32) and ``mask`` (fixed-size
list of bool: false for the padding behind the file's last id).  Batches are
uncompressed, so a memory-mapped file gives any sequence without a copy: value
k of the file is element k mod length of sequence k div length.  Beside it,
``<name>.index.arrow`` has doc_id, offset (first value) and n_tokens.

A task writes under names of its own attempt and reports them; only reported
files belong to the output, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.batches import make_room, parts
from spanloom.session import cut, shared_dir

BATCH_SEQUENCES = 256
#: text for one file where the caller names no number of files
FILE_BYTES = 256 << 20


#: code points by kind, in the writing of RE2: white space, the part of it that is not a space, and
#: those whose kind no Unicode version in use disputes
BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK_NOT_SPACE = BLANK.replace(" ", "", 1)
SETTLED = r"\x{2}-\x{377}\x{384}-\x{50f}\x{1e00}-\x{1eff}\x{2000}-\x{206f}\x{20a0}-\x{20ac}\x{2100}-\x{2189}\x{2190}-\x{23ff}\x{2500}-\x{27bf}\x{3000}-\x{3020}\x{3041}-\x{3096}\x{30a0}-\x{30ff}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}\x{1f300}-\x{1f5ff}\x{1f600}-\x{1f64f}"
MARK = "\x01"


class ByteEncoder:
    """Byte-level BPE ids of whole texts by the tokenizers library.

    The library cuts a text before it merges, and always around a run of letters
    with the space before it, except where the run follows an apostrophe or two
    white characters of which the last is no space.  So texts are cut into such
    runs (there with what they follow) and what lies between; Arrow finds the
    distinct parts of a batch, each new one goes through the library once, and
    the ids are gathered for the whole batch.  Texts that hold an added token,
    the cut mark or a character of disputed kind go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.hard = "|".join([f"[^{SETTLED}]", *added])
        before = str(self.library.pre_tokenizer)
        self.simple = self.library.normalizer is None and "ByteLevel" in before and "use_regex=True" in before and "add_prefix_space=False" in before
        run = r"\p{L}+"
        self.parts = rf"[{BLANK}]+[{BLANK_NOT_SPACE}]{run}|[{BLANK}]*[^{BLANK}\p{{L}}\p{{N}}]*'{run}| ?{run}"
        # one Latin word, after a space or not, is one piece of text to the library's BPE
        self.letters = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
        self.alphabet = _byte_alphabet()
        self._known: dict[str, bytes] = {"": b""}

    def _run(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of the parts, new ones kept."""
        known = self._known
        found = list(map(known.get, parts))
        at = [k for k, x in enumerate(found) if x is None]
        make_room(known, len(at))
        rest, bpe, letters, alphabet = [], self.library.model.tokenize, self.letters, self.alphabet
        for k in at:
            p = parts[k]
            if letters(p):
                ids = [x.id for x in bpe(p.encode().decode("latin-1").translate(alphabet))]
                known[p] = found[k] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(k)
        for k, ids in zip(rest, self._run([parts[k] for k in rest]), strict=True):
            known[parts[k]] = found[k] = ids
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none) as unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = pc.match_substring_regex(texts, self.hard) if self.simple else pa.array([True] * len(texts), pa.bool_())
        whole = iter(self._run(texts.filter(hard).to_pylist()))
        marked = pc.replace_substring_regex(texts.filter(pc.invert(hard)), self.parts, f"{MARK}\\0{MARK}")
        cuts = pc.split_pattern(marked, MARK)
        found = cuts.flatten().dictionary_encode()
        ids = self._learn(found.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.cumsum(sizes) - sizes
        which = found.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        values = np.frombuffer(b"".join(ids), "<u4")[np.repeat(firsts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[cuts.offsets.to_numpy() - cuts.offsets[0].as_py()] if len(cuts) else np.zeros(1, np.int64)
        easy = iter(range(len(cuts)))
        return [np.frombuffer(next(whole), "<u4") if h else values[bounds[k := next(easy)] : bounds[k + 1]] for h in hard.to_pylist()]


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: visible Latin-1 ones for themselves, others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


#: schemes of Spark's stores by the names they have in pyarrow
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def _uri(path: str) -> str:
    """A path as pyarrow names it."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return "file://" + path
    if scheme not in SCHEMES:
        raise ValueError(f"token files can't be written to {scheme}, only to {', '.join(SCHEMES)}")
    return re.sub(r"^file:/+", "file:///", f"{SCHEMES[scheme]}:{rest}")


def _store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))


class _Writer:
    """One file and its index; values go out in whole batches of sequences."""

    def __init__(self, folder: str, length: int, kind: np.dtype):
        self.name = f"part-{uuid.uuid4().hex}"
        self.fs, base = _store(folder)
        self.path = f"{base}/{self.name}"
        self.length, self.kind = length, kind
        self.item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(self.item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.fs.open_output_stream(self.path + ".arrow")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.rest, self.held, self.total = [], 0, 0
        self.docs: list[tuple] = []
        self.index_sink = self.fs.open_output_stream(self.path + ".index.arrow")
        self.index = pa.ipc.new_stream(self.index_sink, self.index_schema)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH_SEQUENCES * self.length:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.rest) if self.rest else np.empty(0, self.kind)
        step = BATCH_SEQUENCES * self.length
        for at in range(0, len(values) if last else len(values) // step * step, step):
            part = values[at : at + step]
            pad = -len(part) % self.length
            mask = pa.array(np.arange(len(part) + pad) < len(part))
            part = np.concatenate([part, np.zeros(pad, self.kind)]) if pad else part
            cols = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(part, self.item), mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        left = values[len(values) // step * step :]
        self.rest, self.held = ([] if last else [left]), 0 if last else len(left)

    def _flush_index(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=self.index_schema))
        self.docs = []

    def close(self) -> None:
        self._flush(True)
        if self.docs:
            self._flush_index()
        for x in (self.out, self.sink, self.index, self.index_sink):
            x.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, length: int = 2048, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write the files.

    Returns the manifest, one row a file: file, first_id, last_id, n_docs,
    n_tokens, start (ids of all files before it).

    Null text counts as empty: its document is the end id alone.  Rows with one
    id are documents of their own, next to each other, in the order of their
    texts' checksums, so a rerun gives each the same place; a null id comes
    first.  An empty table writes no file.  Other columns are not read.

    Without ``files`` there is one for FILE_BYTES of text, so a task's sort and
    file stay bounded as the input grows; equal rows share one.
    """
    spark = docs.sparkSession
    kind = np.dtype("<u2") if _vocabulary(tokenizer_path, end_id) <= 1 << 16 else np.dtype("<u4")
    if files is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, w, first, last, n = encoder(tokenizer_path), None, None, None, 0
        end = np.asarray([end_id], kind)
        for b in batches:
            for part in parts(b):
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    if w is None:
                        w, first = _Writer(folder, length, kind), doc_id
                    last, n = doc_id, n + 1
                    w.add(doc_id, np.concatenate([ids.astype(kind), end]))
        if w is not None:
            w.close()
            yield pa.RecordBatch.from_pydict({"range": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [w.name], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": [n], "n_tokens": [w.total]})

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")), F.xxhash64("text"), F.col("text").isNull()]
    own = own.repartitionByRange(files, *order).sortWithinPartitions(*order)
    written = cut(own.mapInArrow(run, "range int, file string, first_id long, last_id long, n_docs long, n_tokens long"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return written.select("file", "first_id", "last_id", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def _vocabulary(path: str, end_id: int) -> int:
    return max(encoder(path).library.get_vocab_size(with_added_tokens=True), end_id + 1)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    ids_crc32 is over the ids, the end id included, as little-endian unsigned
    32-bit integers.  One file is open at a time, batch by batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _read(folder, name, start, id_col)

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(max(files, manifest.count()), "file").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def _values(fs, path: str) -> Iterator[np.ndarray]:
    """The unpadded ids of a file, batch by batch."""
    with fs.open_input_file(path + ".arrow") as f, pa.ipc.open_stream(f) as stream:
        for batch in stream:
            ids = batch.column("ids").flatten().to_numpy()
            mask = batch.column("mask").flatten()
            yield ids if mask.true_count == len(mask) else ids[mask.to_numpy(zero_copy_only=False)]


def _read(folder: str, name: str, start: int, id_col: str) -> Iterator[pa.RecordBatch]:
    fs, base = _store(folder)
    path = f"{base}/{name}"
    values, held, at = _values(fs, path), np.empty(0, "<u4"), 0  # held: ids from value at on
    with fs.open_input_file(path + ".index.arrow") as f, pa.ipc.open_stream(f) as index:
        for batch in index:
            ids, offsets, sizes = (batch.column(k).to_pylist() for k in range(3))
            crcs = []
            for offset, n in zip(offsets, sizes, strict=True):
                while at + len(held) < offset + n:
                    held, at = np.concatenate([held[offset - at :], next(values).astype("<u4")]), offset
                crcs.append(zlib.crc32(held[offset - at : offset - at + n].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([start + x for x in offsets], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])


def sequence(folder: str, name: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the k-th sequence of a file: a view of the mapped file where the store is local."""
    fs, base = _store(folder)
    local = fs.type_name == "local"
    f = pa.memory_map(f"{base}/{name}.arrow") if local else fs.open_input_file(f"{base}/{name}.arrow")
    for batch in pa.ipc.open_stream(f):
        if k < batch.num_rows:
            return batch.column("ids")[k].values.to_numpy(), batch.column("mask")[k].values.to_numpy(zero_copy_only=False)
        k -= batch.num_rows
    raise IndexError(k)


def output_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder of the session."""
    folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    return folder
