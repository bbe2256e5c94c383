import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from photocat.llm import bpe

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH).rank, special_tokens={})


def test_same_ids_as_the_library(library):
    rng = random.Random(3)
    alphabet = "ab'stmdrevl 's  \n\t\r  é1２٣!.-'’ñ中𝒜😀\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", " ", "  ", "'", "a'", "x" * 5000, "!" * 700, "'s's're", "a  'll b", "İǅ" * 300]
    v = bpe.ranks(PATH)
    for t, got in zip(texts, bpe.encode_texts([t.encode() for t in texts], v), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode_ordinary(t), t
        assert bpe.decode_ids(got, bpe.token_ends(got, v), v) == t.encode()


def test_scan_width_does_not_matter():
    points = np.frombuffer("it's  a 12\n\nx' 'll!".encode("utf-32-le"), dtype="<u4")
    first = np.zeros(len(points), dtype=bool)
    first[[0, 7]] = True
    one = bpe.piece_starts(points, first).tolist()
    assert all(bpe.piece_starts(points, first, w).tolist() == one for w in (1, 2, 3, 5, 7, 100))


def test_cache_is_bounded_and_changes_nothing(monkeypatch):
    texts = [f"word{i} other{i * 7}".encode() for i in range(500)]
    want = bpe.encode_texts(texts, bpe.Ranks(PATH))
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    small = bpe.Ranks(PATH)
    assert [x for t in texts for x in bpe.encode_texts([t], small)] == want
    assert len(small.pieces) <= 20


def test_query(real, odd, library):
    for docs in (real[0], odd[0]):
        want = sorted((str(r.doc_id), hashlib.sha256(np.array(library.encode_ordinary(r.text or ""), dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
        assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs.select("doc_id", "text"), PATH).collect()) == want
        got = bpe.decode(bpe.encode(docs, PATH), PATH)
        assert set(got.columns) == (set(docs.columns) - {"text"}) | {"ids", "bytes"}
        assert sorted(r.bytes.decode() for r in got.collect()) == sorted(r.text or "" for r in docs.collect())


def test_offsets_that_do_not_fit_are_refused():
    v = bpe.ranks(PATH)
    ids = bpe.encode_texts([b"some words"], v)[0]
    with pytest.raises(ValueError):
        bpe.decode_ids(ids, bpe.token_ends(ids, v)[4:] + b"\0\0\0\0", v)


def test_memory_follows_the_slice_and_not_the_batch():
    text = " ".join(f"w{i % 300}" for i in range(5_000))

    def peak(n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n)], names=["doc_id", "text"])
        tracemalloc.start()
        rows = sum(out.num_rows for out in bpe._encode_batches(iter([batch]), PATH))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most

    one = bpe.SLICE // len(text)
    peak(one)  # fixed tables are made
    assert peak(4 * one) < 1.5 * peak(one)
