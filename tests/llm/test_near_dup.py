import random
import tracemalloc

import numpy as np
import pyarrow as pa

from photocat.llm import near_dup
from photocat.llm.shingles import labelled, word_hashes


def runs(t):
    words = (t or "").split()
    out, seen = [], {}
    for k in range(max(len(words) - 4, min(len(words), 1))):
        w = tuple(words[k : k + 5])
        seen[w] = seen.get(w, 0) + 1
        out.append((w, seen[w]))
    return out


def similarity(a, b):
    """Longest common subsequence of labelled runs, by the textbook table."""
    x, y = runs(a), runs(b)
    row = [0] * (len(y) + 1)
    for p in x:
        before = 0
        for j, q in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if p == q else max(row[j], row[j - 1])
    return row[-1] / max(1, len(x) + len(y) - row[-1])


def brute(rows):
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if set(runs(a)) & set(runs(b)) and similarity(a, b) >= 0.8:
                root[find(a)] = find(b)
    smallest = {}
    for d, t in rows:
        k = find(t or "")
        smallest[k] = d if smallest.get(k) is None else smallest[k] if d is None else min(smallest[k], d)
    return sorted(((d, smallest[find(t or "")]) for d, t in rows), key=str)


def result(docs):
    return sorted(((r.doc_id, r.class_id) for r in near_dup.classes(docs).collect()), key=str)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, passage = [], " ".join(word() for _ in range(60))
    for _ in range(25):
        first = [word() for _ in range(rng.randint(3, 90))]
        rows.append(" ".join(first))
        for _ in range(rng.randint(0, 6)):
            copy = list(first)
            for _ in range(rng.randint(0, 1 + len(copy) // 30)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            rows.append(" ".join(copy))
        rows += [rows[-1]] * rng.randint(0, 2) + [f"{passage} {' '.join(first[:40])}"]
        half = len(first) // 2
        rows.append(" ".join(first[half:] + first[:half]))
    return [(k * 7 % 1009, t) for k, t in enumerate(rows)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(docs) == brute(rows)



def test_odd_rows(spark, odd):
    docs, rows = odd
    want = {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8}
    assert result(docs) == sorted([(None, None) if r[0] is None else (r[0], want[r[0]]) for r in rows], key=str)
    out = near_dup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, 4, 5, 7, 8, None], key=str)


def test_different_texts_without_an_id_or_with_one_id_all_stay(spark):
    texts = [f"a text about matter {k} and nothing else, number {k * 31}" for k in range(6)]
    rows = [(None, texts[0], "a"), (None, texts[1], "b"), (None, texts[2], "c"), (5, texts[3], "a"), (5, texts[4], "b"), (5, texts[4], "b"), (6, texts[4], "c"), (None, texts[3], "d"), (7, texts[5], "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    kept = [tuple(r) for r in near_dup.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[0], "a"), (None, texts[1], "b"), (None, texts[2], "c"), (5, texts[3], "a"), (5, texts[4], "b"), (7, texts[5], "e")], key=str)
    found = near_dup.classes(docs)
    assert found.select("root").distinct().count() == 6 == len(kept)
    assert {(r.doc_id, r.class_id) for r in found.collect()} == {(None, None), (5, 5), (6, 5), (None, 5), (7, 7)}


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs alone in their group, whose similarity lies just above 0.8: at least 98 of 100 are found."""
    rng = random.Random(21)
    rows, pairs = [], 0
    while pairs < 300:
        n = rng.choice([30, 60, 120, 250])
        a = [f"p{pairs}x{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), max(1, round(n * 0.02))):
            b[at] = "changed"
        while similarity(" ".join(a), " ".join(b)) > 0.83:
            b.append(f"more{len(b)}")
        if similarity(" ".join(a), " ".join(b)) >= 0.8:
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    found = near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found.where("class_id <> doc_id").count() >= 0.98 * pairs


def test_large_groups_of_copies(spark):
    """A group of near copies larger than a block, each differing from the others, and one of equal texts."""
    rng = random.Random(9)
    first = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = [(k, " ".join(first[: k % 100] + [f"x{k}"] + first[k % 100 + 1 :])) for k in range(2500)] + [(5000 + k, "equal words in all of these texts") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(docs) == sorted([(k, 0 if k < 5000 else 5000) for k, _ in rows], key=str)


def test_alignment_is_the_textbook_one():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b)) :][:1] = []
            b.insert(rng.randrange(len(b) + 1), rng.choice("abc"))
        a, b = " ".join(a), " ".join(b)
        value, at = labelled([a.encode(), b.encode()])
        assert near_dup.similar(value[: at[1]], value[at[1] :]) == (similarity(a, b) >= 0.8 - 1e-12)


def test_hashes_do_not_depend_on_neighbours_or_chunks():
    texts = [b"a b c d e f a b c d e", b"", b"x", b"a b c d e f a b c d e"]
    value, at = labelled(texts)
    assert value[at[0] : at[1]].tolist() == value[at[3] : at[4]].tolist() == labelled(texts[:1])[0].tolist()
    assert len(set(value[: at[1]].tolist())) == at[1]
    assert (word_hashes(texts)[0] == word_hashes(texts, 4)[0]).all()


def test_estimate_is_near():
    rng = np.random.default_rng(0)
    n = 400
    for same in (300, 355, 390):
        common = rng.integers(0, 2**63, same, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, n - same, dtype=np.uint64)]) for _ in range(2))
        m = near_dup.range_minima(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        got = (m[0] == m[1]).sum() / ((m[0] | m[1]) > 0).sum()
        assert abs(got - same / (2 * n - same)) < 0.25


def test_memory_follows_the_slice_and_not_the_batch():
    text = " ".join(f"w{i}" for i in range(5_000))

    def peak(n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"{k} {text}" for k in range(n)])], names=["doc_id", "text"])
        tracemalloc.start()
        rows = sum(out.num_rows for out in near_dup._sketch_batches(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most

    one = near_dup.SLICE // len(text)
    peak(one)  # fixed tables are made
    assert peak(4 * one) < 1.5 * peak(one)
