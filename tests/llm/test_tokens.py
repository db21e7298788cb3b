import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_data import HARD
from spanloom.llm.pieces import PieceModel, load
from spanloom.llm.streaming_encoder import Encoder, Viterbi, decode_documents, encode_digests, encode_documents
from spanloom.llm.token_counts import PrefixCounts, count_tokens
from spanloom.llm.token_files import encoder as byte_encoder
from spanloom.llm.token_files import output_folder, read_token_files, sequence, write_token_files

MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
BPE = Tokenizer.from_file(BYTES)
texts = st.lists(st.sampled_from(list("abcdeéß ▁\n\t.,!<s>0x12_' 日本語🙂́\x1c\x85²½") + ["the", "ing", "  ", "<0x41>", "</s>", "<|endoftext|>", "'s"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(0, 40), st.integers(0, 15))
def test_counts_at_every_prefix(text, at, budget):
    c = PrefixCounts(load(MODEL))
    pre = c.prefixes(text)
    at = min(at, len(text))
    assert pre[at] == len(SP.encode(text[:at])) and c.total(text) == len(SP.encode(text))
    assert c.fit(text, budget) == max(k for k in range(len(text) + 1) if pre[k] <= budget)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_encoding_and_decoding(text):
    e = Encoder(load(MODEL))
    ids = e.encode(text).tolist()
    assert ids == SP.encode(text) and e.model.decode(ids) == SP.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4))
def test_byte_encoding(found):
    got = [x.tobytes() for x in byte_encoder(BYTES).encode(pa.array(found))]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in BPE.encode_batch(found, add_special_tokens=False)]


def test_pieces_against_plain_merging():
    """Pairs by the ranks of merges are pairs by merging."""
    m, r = load(MODEL), random.Random(3)
    names = [p for p in m.ids if m.reachable(p)]
    for _ in range(3000):
        a, b = r.choice(names), r.choice(names)
        assert m._pair(a, b) == (m.merged(a + b) == [a, b])


def test_stream_commits_early_with_a_bounded_window():
    m, v, most, ids = load(MODEL), None, 0, []
    v = Viterbi(m)
    text = "▁" + "abcdefghij" * 300
    for c in text:
        ids += v.feed(c)
        most = max(most, len(v.buffer))
    assert most <= 6 * m.longest
    assert ids + v.end() == SP.encode(text[1:])


class Unigram:
    """The parts of a PieceModel that a search with scores needs."""

    kind, has_bytes, unk, floor, longest = "unigram", False, 0, -20.0, 4

    def __init__(self, seed):
        import ahocorasick

        r = random.Random(seed)
        self.ids, self.scores, self.pairs = {}, {}, {}
        for k, p in enumerate(sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(30)})):
            self.ids[p], self.scores[p] = k + 1, -r.random() * 10
        a = ahocorasick.Automaton()
        for p in self.ids:
            a.add_word(p, (len(p), p))
        a.make_automaton()
        self.found = a.iter


@pytest.mark.parametrize("seed", range(20))
def test_unigram_search_is_the_best_of_all_splits(seed):
    m = Unigram(seed)
    text = "".join(random.Random(seed).choice("abcd") for _ in range(60))
    v = Viterbi(m)
    got = v.feed(text) + v.end()
    best = [0.0] + [-1e9] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - 4), i):
            t = text[j:i]
            s = m.scores.get(t, m.floor if i - j == 1 else None)
            if s is not None:
                best[i] = max(best[i], best[j] + s)
    by_id = {k: p for p, k in m.ids.items()}
    assert sum(m.scores[by_id[x]] if x else m.floor for x in got) == pytest.approx(best[-1])


def key(rows):
    return Counter(map(tuple, rows))


def test_count_query(spark, hard, empty):
    got = key(count_tokens(hard, MODEL, limit=100).collect())
    want = key((i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 100, None) for i, t, *_ in HARD)
    assert key((*r[:4], None) for r in got.elements()) == want
    assert all(r[4] == len(t or "") or r[3] for r in got.elements() for i, t, *_ in HARD if i == r[0] and r[1] == len((t or "").encode()))
    assert count_tokens(empty, MODEL).count() == 0


def test_encode_query(spark, hard, empty):
    rows = encode_documents(hard, MODEL).collect()
    assert key((r[0], tuple(r["ids"])) for r in rows) == key((i, tuple(SP.encode(t or ""))) for i, t, *_ in HARD)
    assert {r["doc_id"] for r in rows if not r["round_trip"]} == {9}  # a space mark in a text comes back as a space
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    assert key((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in encode_digests(hard, MODEL).collect()) == key((i, len(SP.encode(t or "")), crc(SP.encode(t or ""))) for i, t, *_ in HARD)
    back = decode_documents(encode_documents(hard, MODEL), MODEL)
    assert key(back.collect()) == key((i, (t or "").replace("▁", " ")) for i, t, *_ in HARD)
    assert encode_documents(empty, MODEL).count() == 0


def test_token_files_round_trip(spark, hard, empty):
    folder = output_folder(spark)
    manifest = write_token_files(hard, BYTES, folder, files=3, length=64)
    got = read_token_files(spark, manifest, folder).orderBy("start").collect()
    rows = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {i: [] for i, *_ in rows}
    for i, t, *_ in rows:
        ids[i].append([*BPE.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for x in ids[r["doc_id"]]]
    first = manifest.orderBy("start").first()
    values, mask = sequence(folder, first["file"], 0)
    assert len(values) == 64 and values.dtype == np.uint16 and mask.sum() == min(64, first["n_tokens"])
    assert write_token_files(empty, BYTES, folder).count() == 0
    assert read_token_files(spark, write_token_files(empty, BYTES, folder), folder).count() == 0


def test_model_tables():
    m = PieceModel(MODEL)
    assert m.kind == "bpe" and m.plain and m.cut_spaces and m.cut_letters and m.longest == 16


def test_token_files_of_rows_with_one_id_keep_their_places(spark):
    rows = [(5, f"text {k}") for k in range(40)] + [(None, "a"), (None, "b"), (1, None), (1, "")]
    seen = []
    for parts in (1, 5, 3):
        folder = output_folder(spark)
        manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), BYTES, folder, files=4, length=16)
        assert manifest.count() > 2  # one id is split among files
        seen.append(Counter(map(tuple, read_token_files(spark, manifest, folder).collect())))
    assert seen[0] == seen[1] == seen[2]


def test_token_files_know_their_stores():
    from spanloom.llm.token_files import _uri

    with pytest.raises(ValueError, match="only to"):
        _uri("ftp://host/x")
    assert [_uri(x) for x in ("/tmp/x", "file:/tmp/x", "s3a://bucket/x")] == ["file:///tmp/x", "file:///tmp/x", "s3://bucket/x"]
