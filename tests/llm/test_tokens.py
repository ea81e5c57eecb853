"""Token operators against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from knotwork.llm import packing, token_count, token_store
from knotwork.llm.encoding import ChunkEncoder
from knotwork.llm.queries import tokenizer

WORD, BYTE = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")
TEXTS = [
    "", None, "Hello, world! It's fine.", "  two  blanks\n\n and\tlines \r\n", "a<|endoftext|>b <|startoftext|>", "naïve café Ωmega ΣΑΣ ǅ İ", "é x̸ ​",
    "x" * 3000, "日本語 テキスト 123 ½", "it'll we've they're", "\x1c\x1d odd \x1e\x1f", " nb sp　", "👩‍👩‍👧 emoji!!", " ", "\n", "word " * 6000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(spark, docs):
    got = {r.doc_id: r for r in token_count.token_counts(docs, BYTE, limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library(BYTE, t))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), i


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 's\n\t<|>é1½日 ́ ,.!")), max_size=40) | st.text(max_size=30))
def test_counts_of_any_text(text):
    assert token_count.counter(BYTE).count(text) == len(library_byte.encode(text, add_special_tokens=False).ids)


library_byte, library_word, own_word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), ChunkEncoder(WORD)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBΣ 's\n\t<|>é1½日 ́ẞ ,.!\x1c")), max_size=40) | st.text(max_size=30))
def test_chunked_ids_of_any_text(text):
    got = np.frombuffer(own_word.encode([text], any(c in text for c in "\x1c\x1d\x1e\x1f"))[0], "<u4").tolist()
    assert got == library_word.encode(text, add_special_tokens=False).ids


def test_remembering_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr("knotwork.llm.encoding.REMEMBERED", 5)
    own = ChunkEncoder(WORD)
    for text in ["a b c d", "e f a b", "g h i j k l m n", "a b c d e f g"]:
        assert np.frombuffer(own.encode([text], False)[0], "<u4").tolist() == library_word.encode(text, add_special_tokens=False).ids


def test_store_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, WORD)
    blocks = spark.read.parquet(path)
    got = token_store.read_store(blocks).orderBy("start").collect()
    start = 0
    order = sorted([*range(len(TEXTS)), 2])
    assert [r.doc_id for r in got] == order
    for r in got:
        ids = np.array([*library(WORD, TEXTS[r.doc_id]), 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    whole = [*library(WORD, TEXTS[9]), 1]
    assert token_store.fetch(blocks, 9, 1, 3) == whole[1:3]
    assert token_store.fetch(blocks, 12345, 0, 3) == []


def test_store_of_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    token_store.write_store(docs.limit(0), path, WORD)
    assert token_store.read_store(spark.read.schema(token_store.BLOCK_SCHEMA).parquet(path)).count() == 0


@given(st.integers(1, 32), st.data())
def test_bit_packing(width, data):
    ids = data.draw(st.lists(st.integers(0, 2**width - 1), max_size=60))
    raw = token_store.pack(np.array(ids, "<u4"), width)
    assert len(raw) == -(-len(ids) * width // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_store.unpack(raw, width, a, b).tolist() == ids[a:b]


@given(st.lists(st.integers(1, 40), max_size=12), st.integers(1, 64))
def test_fill_is_closest(lengths, capacity):
    counts = {n: lengths.count(n) for n in lengths}
    chosen = packing.closest_fill(counts, capacity)
    assert all(n <= counts[k] for k, n in chosen.items())
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


def check_pieces(rows, texts_by_row, window=4096):
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
    for doc_id, ids in texts_by_row.items():
        pieces = sorted(whole.pop(doc_id), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids)
        at = 0
        for r in pieces:
            own = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(own.tobytes())
            at += r.length
    assert not whole
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return [sum(n for _, n in own) for own in sequences.values()]


def test_packing_takes_each_id_once(spark, docs):
    rows = packing.pack_sequences(docs.limit(len(TEXTS)), WORD).collect()
    sizes = check_pieces(rows, {i: [*library(WORD, t), 2] for i, t in enumerate(TEXTS)})
    assert all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack_sequences(docs.limit(0), WORD).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=80))
def test_packer_leaves_no_padding(lengths):
    packer = packing.Packer(0, 64)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
    packer.finish()
    row = type("Row", (), {})
    rows = []
    for piece in packer.out:
        r = row()
        r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset = piece
        rows.append(r)
    sizes = check_pieces(rows, {i: list(range(n)) for i, n in enumerate(lengths)}, 64)
    assert all(n & (n - 1) == 0 for n in sizes)
    assert sum(n != 64 for n in sizes) <= 6


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_repeated_rows_and_null_ids_are_documents_each(spark, tmp_path):
    texts = ["one two three", "one two three", None, "", "x y", "x y z " * 3000]
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[4]), (8, texts[3]), (9, texts[5])]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, length long, shard string").repartition(3)
    counts = sorted(((r.doc_id, r.n_tokens) for r in token_count.token_counts(docs, BYTE).collect()), key=repr)
    assert counts == sorted(((i, len(library(BYTE, t))) for i, t in rows), key=repr)
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, WORD)
    got = token_store.read_store(spark.read.parquet(path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 7, 7, 8, 9]
    want = sorted(((i, crc([*library(WORD, t), 1])) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=repr) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(6)]
    pieces = packing.pack_sequences(docs, WORD).collect()
    held = {}
    for r in pieces:
        held[r.doc_id, r.doc_tokens] = held.get((r.doc_id, r.doc_tokens), 0) + r.length
    sizes = {}
    for i, t in rows:
        n = len(library(WORD, t)) + 1
        sizes[i, n] = sizes.get((i, n), 0) + n
    assert held == sizes
    none = docs.limit(0)
    assert token_count.token_counts(none, BYTE).count() == 0


def test_identifiers_of_a_whole_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    encoded = {i: e.ids for i, e in zip(rows, library_word.encode_batch([t or "" for t in rows.values()], add_special_tokens=False), strict=True)}
    path = str(tmp_path / "store")
    token_store.write_store(table, path, WORD)
    at = 0
    for r in token_store.read_store(spark.read.parquet(path)).orderBy("doc_id").collect():
        ids = [*encoded[r.doc_id], 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    pieces = packing.pack_sequences(table, WORD).collect()
    check_pieces(pieces, {i: [*ids, 2] for i, ids in encoded.items()})
    for r in token_count.token_counts(table, BYTE).collect():
        assert r.n_tokens == len(library_byte.encode(rows[r.doc_id], add_special_tokens=False).ids)


def test_another_kind_of_tokenizer_goes_to_the_library_whole():
    own = ChunkEncoder(BYTE)
    assert not own.by_chunk
    for text in ["Hello  world", "a<|endoftext|>b", ""]:
        assert np.frombuffer(own.encode([text], False)[0], "<u4").tolist() == library_byte.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        token_count.counter(WORD)
