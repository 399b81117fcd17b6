import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidebar.llm import bpe, simple8b


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe(docs, rows, library):
    got = bpe.encode_and_decode(docs).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted([(r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in got], key=repr) == sorted(want, key=repr)


def test_bpe_digests(docs, rows, library):
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_and_decode(docs, digests_only=True).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 's\n\t　\u0085é日1.!" + "<|endoftext|>"), max_size=60), st.integers(1, 400))
def test_chunks_agree_with_the_library(piece, times):
    from tokenizers import Tokenizer

    import pyarrow as pa

    from tidebar.llm.words import utf8

    plain = bpe.encoder(bpe.tokenizer_path())
    text = (piece + " word ") * times
    got = bpe.ChunkedEncoder(plain).encode(*utf8(pa.array([text])))[0].tolist()
    assert isinstance(plain.library, Tokenizer)
    assert got == plain.library.encode(text, add_special_tokens=False).ids


def test_chunks_are_reused():
    import pyarrow as pa

    from tidebar.llm.words import utf8

    passage = " ".join(f"word{k}" for k in range(4000))
    chunked = bpe.ChunkedEncoder(bpe.encoder(bpe.tokenizer_path()))
    chunked.encode(*utf8(pa.array(["first " + passage, "another beginning " + passage])))
    assert chunked.encoded < 0.7 * chunked.chunks


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=150), max_size=6))
def test_simple8b_round_trip(texts):
    sizes = np.array([len(x) for x in texts], np.int64)
    ids = np.array([v for x in texts for v in x], np.uint64)
    words, starts, escapes = simple8b.pack(ids, sizes)
    assert np.array_equal(simple8b.unpack(words, starts, sizes, escapes), ids)
    for d, own in enumerate(texts):  # each document alone
        a, b = starts[d], starts[d + 1]
        inside = escapes[(escapes >= a) & (escapes < b)] - a
        assert simple8b.unpack(words[a:b], np.array([0, b - a]), sizes[d : d + 1], inside).tolist() == own


def test_files(spark, docs, rows, library, tmp_path):
    path = f"file://{tmp_path}/ids"
    simple8b.write_ids(docs, path)
    got = sorted(simple8b.read_ids(spark, path, digests_only=True).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t, *_) in zip(got, order, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = {(r.doc_id, tuple(r.ids)) for r in simple8b.read_ids(spark, path).collect()}
    assert all((i, (*library.encode(t or "", add_special_tokens=False).ids, 0)) in whole for i, t, *_ in rows)


def test_empty(spark, empty, tmp_path):
    assert bpe.encode_and_decode(empty).collect() == []
    path = f"file://{tmp_path}/ids"
    simple8b.write_ids(empty, path)
    assert simple8b.read_ids(spark, path).collect() == []
