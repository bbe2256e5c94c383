"""Piecewise hashes against a plain version: boundaries byte by byte, edits by the textbook table."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photocat.llm import piecewise as p

MASK = (1 << 64) - 1


def plain_mix(h):
    h = (h ^ h >> 32) * 0xFF51AFD7ED558CCD & MASK
    h = (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 32


def plain_zeros(data, k):
    """Zero bits of the window's hash that ends at byte k; bytes before the text count as zero bytes."""
    h = 0
    for back in range(p.WINDOW):
        h += ((data[k - back] if k >= back else 0) + 1) * int(p._ROLL[back])
    h = plain_mix(h & MASK)
    return 64 if h == 0 else (h & -h).bit_length() - 1


def plain_chunks(data, bits):
    ends = [k + 1 for k in range(len(data)) if plain_zeros(data, k) >= bits]
    ends += [len(data)] if data and (not ends or ends[-1] < len(data)) else []
    out, start = [], 0
    for end in ends:
        value = sum((c + 1) * pow(p._BASE, k, 1 << 64) for k, c in enumerate(data[start:end])) & MASK
        out.append(plain_mix(value + end - start & MASK) >> 52)
        start = end
    return out


def plain_print(data):
    bits = p.FIRST_BITS
    while sum(plain_zeros(data, k) >= bits for k in range(len(data))) >= p.MAX_CHUNKS:
        bits += 1
    return bits, plain_chunks(data, bits), plain_chunks(data, bits + 1)


def plain_likeness(a, b):
    def alike(x, y):
        if not x and not y:
            return 1.0
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for k, d in enumerate(y):
                new.append(row[k] + 1 if c == d else max(row[k + 1], new[-1]))
            row = new
        return 2 * row[-1] / (len(x) + len(y))

    shared = [alike(x, y) for i, x in enumerate(a[1:]) for j, y in enumerate(b[1:]) if a[0] + i == b[0] + j]
    return max(shared, default=0.0)


def samples():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgé😀 ") for _ in range(rng.randint(1, 9)))
    texts = ["", "x", "ab", "a" * 500, "ab" * 900, "\0" * 40, "é" * 30]
    for n in (3, 10, 40, 150, 600):
        texts += [" ".join(word() for _ in range(n)) for _ in range(3)]
    return texts + [texts[-1][: len(texts[-1]) // 2] + texts[-2], texts[-1] + " tail"]


def test_prints_and_likeness_equal_the_plain_version():
    texts = [t.encode() for t in samples()]
    got, want = p.prints(texts), [plain_print(t) for t in texts]
    for k, (bits, one, two) in enumerate(want):
        assert got.level[k] + p.FIRST_BITS == bits
        assert [c for c in got.chunks[0][k] if c >= 0] == one and [c for c in got.chunks[1][k] if c >= 0] == two
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    values = p.likeness(got.take([i for i, _ in pairs]), got.take([j for _, j in pairs]))
    assert np.allclose(values, [plain_likeness(want[i], want[j]) for i, j in pairs], atol=1e-12)
    back = p.parsed(got.written())
    assert (back.level == got.level).all() and all((x == y).all() for x, y in zip(back.chunks, got.chunks, strict=True))


def test_a_text_longer_than_a_step_is_hashed_whole(monkeypatch):
    text = samples()[-1].encode() * 3
    want = p.prints([text]).written()
    monkeypatch.setattr(p, "STEP", 100)
    monkeypatch.setattr(p, "_UP", p._powers(p._BASE, 100))
    assert p.prints([text]).written() == want
    assert p.prints([text[:-1] + b"#"]).written() != want


def test_long_and_repeating_texts():
    for text in (b"ab" * 2_000_000, b"a" * 3_000_000, b"".join(b"%d " % k for k in range(400_000))):
        got = p.prints([text])
        assert 1 <= (got.chunks[0] >= 0).sum() <= p.MAX_CHUNKS and p.likeness(got, got)[0] == 1


def brute(rows):
    """(doc_id, n_chars, sha, prints, likeness) in the order of ids, null first."""
    out = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        one = p.prints([x.encode() for x in (a, e, b)])
        near = [float(p.likeness(one.take([0]), one.take([k]))[0]) for k in (1, 2)]
        out.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), *one.written()[:2], *near))
    return out


def result(df):
    rows = p.edited(df).select("doc_id", "n_chars", F.sha2("edited_text", 256), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return [tuple(r) for r in rows.collect()]


def test_all_documents(spark, real):
    rows = sorted((r["doc_id"], r["text"] or "") for r in real[1])
    assert sorted(result(real[0])) == brute(rows)
    got = {r.doc_id: r for r in p.op11_piecewise_hash(spark, "/root/testdata/sf0.001").collect()}
    assert np.median([r.near_edited for r in got.values()]) > 0.4 > 0.05 > np.median([r.near_next for r in got.values()])


@pytest.mark.parametrize("n", [1, 2, 40])
def test_few_rows_and_ties(spark, n):
    texts = samples()
    rows = [(k, texts[k % len(texts)]) for k in range(n)]
    assert sorted(result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_odd_rows(spark, odd):
    docs, rows = odd
    got = result(docs)
    assert len(got) == len(rows) and {r[0] for r in got} == {r[0] for r in rows}
    # rows with one id stand in the order of a hash of their text; both rows 1 are equal, so the first is followed by its like
    assert sum(r[0] == 1 and r[6] == 1.0 for r in got) >= 1
    assert all(r[3] == "4::" for r in got if r[0] in (2, 3))
    assert result(docs.limit(0)) == []


def test_a_third_of_all_rows_without_an_id(spark):
    rows = [(None if k % 3 == 0 else k, f"text number {k} of many, of its own kind {k * 7919}") for k in range(900)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(got) == 900 and sum(r[0] is None for r in got) == 300
    known = [r for r in brute([(k, t) for k, t in rows if k is not None])[:-1]]
    assert set(known) <= set(got)


def test_columns_of_fingerprints(spark):
    texts = samples()
    df = spark.createDataFrame([(t, texts[-1]) for t in texts] + [(None, "")], "fingerprint string, other string")
    df = p.with_fingerprint(p.with_fingerprint(df, "fingerprint", "one"), "other", "two")
    got = df.select("one", p.likeness_of(F.col("one"), F.col("two")).alias("near")).collect()
    own = p.prints([t.encode() for t in texts])
    assert [r.one for r in got] == own.written() + ["4::"]
    assert [r.near for r in got][:-1] == p.likeness(own, own.take([len(texts) - 1] * len(texts))).tolist() and got[-1].near == 1.0
