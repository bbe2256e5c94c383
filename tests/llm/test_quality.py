from collections import Counter

import numpy as np

from photocat.llm import quality


def base(t):
    import re

    t = t or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_rules(spark, real, odd):
    for docs in (real[0], odd[0]):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
        assert got == Counter((r.doc_id, *base(r.text)) for r in docs.collect())


def test_repeated_words_of_large_vocabularies():
    words = [b"w%d" % (i % 9000) for i in range(30_000)]
    assert quality.repeated_words(words) == 30_000
    assert quality.repeated_words([b"w%d" % i for i in range(9000)]) == 0


def plain_mcd(x):
    """Two starts, two concentration steps each, then the better one to its end; distances in bins as in the operator."""
    n, share = len(x), int(np.ceil(len(x) * quality.SHARE))
    mid = np.array([np.sort(np.ceil(c * 64) / 64)[(n + 1) // 2 - 1] for c in x.T])
    mad = np.array([np.sort(np.ceil(np.abs(np.ceil(c * 64) / 64 - m) * 64) / 64)[(n + 1) // 2 - 1] for c, m in zip(x.T, mid, strict=True)])
    tril = np.tril_indices(quality.DIM)
    first = np.diag(1 / np.maximum(mad * 1.4826, quality.FLOORS))[tril]
    solve = lambda y: quality._solve(len(y), y.sum(0), y.T @ y)

    def far(m, w):
        full = np.zeros((quality.DIM, quality.DIM))
        full[tril] = w
        return np.square((x - m) @ full.T).sum(1)

    def step(e):
        bins = np.floor(np.log2(1 + far(*e[:2])) * quality.BINS_PER_DOUBLING)
        return solve(x[bins <= np.sort(bins)[share - 1]])

    found = [(mid, first, np.inf), solve(x)]
    for _ in range(2):
        found = [step(e) for e in found]
    e = min(found, key=lambda f: f[2])
    for _ in range(quality.MAX_STEPS):
        now = step(e)
        if not now[2] < e[2] - 1e-9:
            break
        e = now
    return far(*e[:2]) * quality._spread_factor()


def test_outliers_against_plain_numpy(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for k in range(500):
        lang, source = ("en", "a") if k % 5 else ("de", ["b", "c", None][k % 3])
        words = [str(w) for w in rng.choice(vocabulary, rng.integers(30, 200))]
        words = [w.capitalize() + "." if rng.random() < 0.1 else w for w in words]
        if k % 9 == 0:
            words = [w + "###" for w in words]
        rows.append((k, " ".join(words), lang, source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    vector = {r.doc_id: [r[x] for x in quality.X] for r in quality._grouped(quality.measure(docs, ["doc_id", "lang", "source"])).collect()}
    groups = {"a": [k for k, _, lang, _ in rows if lang == "en"], "~": [k for k, _, lang, _ in rows if lang == "de"]}
    for members in groups.values():
        fit = [k for k in members if not got[k].base_failed]
        if len(fit) < quality.MIN_GROUP:
            continue
        far = dict(zip(fit, plain_mcd(np.array([vector[k] for k in fit])), strict=True))
        for k in fit:
            assert np.isclose(got[k].distance, far[k], rtol=1e-6, atol=1e-9)
            assert got[k].kept == (far[k] <= quality.CUTOFF)
    assert all(not got[k].kept for k in groups["a"] if k % 9 == 0)
    assert sum(got[k].kept for k in groups["a"] if k % 9) >= 0.98 * sum(k % 9 != 0 for k in groups["a"])


def test_filter_keeps_columns(odd, spark):
    docs, rows = odd
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {1, 5, 6, 7, None}
    assert sum(r.doc_id == 1 for r in out.collect()) == 2
