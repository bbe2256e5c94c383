import math
import re
import zlib
from collections import Counter

import numpy as np

from photocat.llm import lm


def words(t):
    return [*re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def brute(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(words(t)), sum(w in c for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for d, t in rows]


def check(docs, rows):
    got = lm.score(docs, lm.train(docs.filter(~lm.held_out(docs.doc_id)), 100), 100).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    want = brute(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    return got


def test_base_scores(real, odd):
    got = check(real[0], [(r["doc_id"], r["text"]) for r in real[1]])
    check(odd[0], [(r[0], r[1]) for r in odd[1]])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the model predicts unseen texts better


def test_blocks_do_not_matter(real):
    docs = real[0]
    one = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, 1), 1).collect()}
    many = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, 1 << 30), 100 * lm.BLOCK_BYTES).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=0.02) for k in one)


def test_one_pass_scores_like_a_trained_model(real, odd):
    for docs, size in ((real[0], 100), (odd[0], 100), (real[0], 40 * lm.BLOCK_BYTES), (real[0].filter(lm.held_out(real[0].doc_id)), 100), (real[0].limit(0), 0)):
        two = lm.score(docs, lm.train(docs.filter(~lm.held_out(docs.doc_id)), size), size).collect()
        key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6))
        for g, w in zip(sorted(lm.train_and_score(docs, size).collect(), key=key), sorted(two, key=key), strict=True):
            assert g[:5] == w[:5] and math.isclose(g.base_score, w.base_score, rel_tol=1e-12) and math.isclose(g.score, w.score, rel_tol=1e-12)


def test_the_query_sends_bigrams_once_and_stores_no_filter(spark):
    """Texts by block (written once, read twice), requests with counts by part, answers by block."""
    plan = lm.op3_lm_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part") == 1 and plan.count("Exchange hashpartitioning(block") == 3 and "ExistingRDD" not in plan


def test_counts_of_any_size_travel():
    counts = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert (lm._counts_read(lm._counts_packed(counts), len(counts)) == counts).all() and len(lm._counts_packed(counts)) == 7 + 3 * 8


def test_filter_rounds_counts_down_and_rarely_invents():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(1, 400, len(hashes))
    bits, size = 3, 1 << 17
    rows = [row for b in lm._packed(lm.BIGRAMS, hashes, counts, bits) for row in b.to_pylist()]
    out = np.zeros((1 << bits, size // 8), dtype=np.uint8)
    for r in rows:
        merged = lm._merge_part(lm.pa.Table.from_pylist([r], schema=lm.COUNT_SCHEMA))
        for seg in lm._segments(merged.to_batches(), size, 1):
            out[seg.column("part")[0].as_py()] = np.frombuffer(seg.column("bits")[0].as_py(), dtype=np.uint8)
    got = lm.probe(out.ravel(), hashes, bits, size, 1)
    true = np.where(counts > 1, 2.0 ** lm.level(counts), 0)
    assert (got >= true).all() and (got == true).mean() > 0.9
    strange = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (lm.probe(out.ravel(), strange, bits, size, 1) > 0).mean() < 0.05


def exact(rows):
    """{id: score} with bigram counts rounded down to powers of two."""
    pairs = lambda t: list(zip([None, *words(t)], words(t), strict=False))
    c = Counter(w for _, t in rows for w in words(t))
    two = Counter(p for _, t in rows for p in pairs(t))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    level = lambda k: 2 ** (k.bit_length() - 1) if k else 0
    return {d: sum(math.log10(lm.SHARE * min(level(two[a, w]), c[a]) / c[a] + (1 - lm.SHARE) * p(w)) for a, w in pairs(t)) for d, t in rows}


def test_the_filter_grows_and_keeps_bigrams_seen_once(spark):
    rng = np.random.default_rng(2)
    # once as few texts and once as many; most bigrams are seen once
    for texts in (20, 2000):
        rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.2, 60) % 5000)) for k in range(texts)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        size = sum(len(t) for _, t in rows)
        model, each = lm.train(docs, size, 1), lm.bits_per_entry(lm.hashes_for(size))
        bits = sum(8 * len(r.bits) for r in model.parts.collect() if r.bits)
        two = Counter(p for _, t in rows for p in zip([None, *words(t)], words(t), strict=False))
        entries = sum(k.bit_length() for k in two.values())
        assert entries * each <= bits <= entries * each + 8 * 64
        got, want = {r.doc_id: r.score for r in lm.score(docs, model, 1).collect()}, exact(rows)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=0.02) for k in want)


def test_words_after_a_history_weigh_one_at_most_at_production_load(spark, real):
    """The filter as full as on a large corpus. Over all words together false answers add nothing, so held-out texts do not
    look better than with exact counts."""
    train = [(r["doc_id"], r["text"] or "") for r in real[1] if r["doc_id"] % 10]
    held = [(r["doc_id"], r["text"] or "") for r in real[1] if r["doc_id"] % 10 == 0]
    size = sum(len(t.encode()) for _, t in train + held)
    docs = spark.createDataFrame(train, "doc_id bigint, text string")
    model = lm.train(docs, size, 1)
    c = Counter(w for _, t in train for w in words(t))
    p = lambda w: (c[w] + 0.1) / (model.n + 0.1 * (model.v + 1))
    assert 0 < model.false_rate < 1e-3
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(held, "doc_id bigint, text string"), model, size).collect()}
    roomy = {r.doc_id: r for r in lm.score(spark.createDataFrame(held, "doc_id bigint, text string"), lm.train(docs, size), size).collect()}
    tokens = sum(r.n_tokens for r in got.values())
    tight, wide = (sum(r.score for r in x.values()) / tokens for x in (got, roomy))
    assert abs(tight - wide) < 0.002 and tight > sum(r.base_score for r in got.values()) / tokens
    # all words after words seen once, from the filter itself
    segments = {r.part: np.frombuffer(bytes(r.bits), dtype=np.uint8) for r in model.parts.collect() if r.bits is not None}
    vocabulary = sorted(c, key=str)
    tok = np.array([lm.END if w is None else lm.tokens([w.encode()])[0][0] for w in vocabulary], dtype=np.uint64)
    once = [w for w in vocabulary if w is not None and c[w] == 1][:40]
    weights = []
    for w in once:
        pairs = lm.mixed(lm.tokens([w.encode()])[0][0] * lm.STEP + tok * lm.MIX_1)
        found = np.zeros(len(pairs))
        part = (pairs >> np.uint64(64 - model.part_bits)).astype(np.int64)
        for k, bits in segments.items():
            here = part == k
            found[here] = lm.probe(bits, (pairs[here] << np.uint64(model.part_bits)), 0, len(bits) * 8, 0, model.hashes)
        z = 1 + lm.SHARE * model.v * model.false_rate
        weights.append(sum((lm.SHARE * np.minimum(found, 1) + (1 - lm.SHARE) * np.array([p(x) for x in vocabulary])) / z))
    assert 0.9 < np.mean(weights) <= 1.02
