import math

import numpy as np
import pytest

from photocat.llm import embed_dup


def brute(rows):
    """{id: (links, component)} for rows of distinct ids, and vectors of one length."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    ids = [i for i, _ in good]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            low = min([label[a], *(label[b] for b in np.flatnonzero(near[a]))])
            changed, label[a] = changed or low < label[a], low
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (int(near[a].sum()), label[a]) for a, i in enumerate(ids)}


def result(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    return {r.vec_id: (r.n_links, r.component_id) for r in embed_dup.near_duplicates(df).collect()}


def vectors(n, d=64, seed=0):
    return np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)


def test_groups_and_copies(spark):
    base = vectors(300)
    rng = np.random.default_rng(1)
    rows = [base]
    rows += [base[:40] + 0.2 * rng.standard_normal((40, 64)) for _ in range(3)]
    rows += [np.repeat(base[50:51], 700, axis=0), base[60:70] * 3]
    rows = [(k * 3, [float(x) for x in v]) for k, v in enumerate(np.concatenate(rows).astype(np.float32))]
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    assert result(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    v = [float(x) for x in vectors(1)[0]]
    rows = [(1, None), (2, [0.0] * 64), (3, [math.nan, *v[1:]]), (4, [None, *v[1:]]), (5, v), (6, v), (7, [x * 1e30 for x in v]), (8, [])]
    assert result(spark, rows, "double") == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (0, 8)}
    df = spark.createDataFrame([(None, v), (9, v), (9, v), (10, v[:9])], "vec_id bigint, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 9, False), (9, 2, 9, True), (9, 2, 9, True), (10, 0, 10, True)], key=str)


@pytest.mark.parametrize("m", [64, 512, 2048])
def test_recall_at_the_threshold(m):
    """Pairs at a cosine of exactly 0.9 share two pivots in well over nine tenths of cases."""
    x = vectors(4000, seed=3).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = vectors(4000, seed=4).astype(np.float64)
    n -= (n * x).sum(1)[:, None] * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * n / np.linalg.norm(n, axis=1)[:, None]
    pivots = vectors(m, seed=5).astype(np.float64)
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    a, b = embed_dup.nearest(x, pivots), embed_dup.nearest(y, pivots)
    assert np.mean([len(set(p) & set(q)) >= 2 for p, q in zip(a, b, strict=True)]) >= 0.92


@pytest.mark.parametrize("cosine", [0.75, 0.92, 0.99])
def test_links_inside_a_large_group(spark, cosine):
    """A third of the rows are different near copies of one vector. At 0.75 most of them are not linked, but each has a partner."""
    rng = np.random.default_rng(7)
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    g = 700
    c, own, other = unit(vectors(1, seed=6)), unit(vectors(g, seed=8)), unit(vectors(g, seed=9))
    near = math.sqrt(cosine) * c + math.sqrt(1 - cosine) * own
    v = np.concatenate([vectors(2 * g), near, unit(near) + 0.35 * other if cosine < 0.9 else vectors(0)])
    rows = [(int(i), [float(x) for x in v[i].astype(np.float32)]) for i in rng.permutation(len(v))]
    want = brute(rows)
    got = result(spark, rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values()) > 0


@pytest.mark.parametrize("m", [4096, 8192, embed_dup.MAX_PIVOTS])
def test_recall_with_the_most_pivots(m):
    rng = np.random.default_rng(10)
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    x = unit(vectors(2000, seed=11).astype(np.float64))
    n = rng.standard_normal((2000, 64))
    n = unit(n - (n * x).sum(1)[:, None] * x)
    pivots = embed_dup.random_pivots(m, 64)
    a, b = embed_dup.nearest(x, pivots), embed_dup.nearest(0.9 * x + math.sqrt(1 - 0.81) * n, pivots)
    got = np.mean([len(set(p) & set(q)) >= 2 for p, q in zip(a, b, strict=True)])
    assert got >= 0.93


def test_two_lengths(spark):
    """Rows of every length link among themselves."""
    tall = vectors(120, seed=12)
    flat = vectors(60, d=24, seed=13)
    rng = np.random.default_rng(14)
    parts = [tall, np.concatenate([flat, flat[:30] + 0.1 * rng.standard_normal((30, 24)), flat[:5]])]
    rows = [[(1000 * p + k, [float(x) for x in v]) for k, v in enumerate(part.astype(np.float32))] for p, part in enumerate(parts)]
    want = brute(rows[0]) | brute(rows[1])
    assert sum(n for n, _ in want.values()) > 70
    assert result(spark, rows[0] + rows[1]) == want


def test_prefixes_keep_their_order_and_pairs_have_one_list():
    rng = np.random.default_rng(15)
    v, pivots = vectors(50).astype(np.float64), embed_dup.random_pivots(128, 64)
    got = embed_dup.nearest(v, pivots)
    assert (got == np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, : embed_dup.PREFIX]).all()
    a, b = (np.array([rng.permutation(12)[:7] for _ in range(200)]) for _ in range(2))
    counts = embed_dup.shared_counts(np.concatenate([a, b]))[:200, 200:]
    for k in range(200):
        both = set(a[k]) & set(b[k])
        assert counts[k, k] == len(both)
        want = min(both, key=lambda p: (a[k].tolist().index(p) + b[k].tolist().index(p), p))
        assert embed_dup.foremost(a[k : k + 1], b[k : k + 1])[0] == embed_dup.foremost(b[k : k + 1], a[k : k + 1])[0] == want


def test_sql_with_planted_links(spark, tmp_path):
    """The oracle's SQL over the given vectors with near copies, odd vectors and equal ones among them."""
    import duckdb

    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").limit(150).collect()
    rng = np.random.default_rng(16)
    rows = [(r.vec_id, list(r.embedding)) for r in given]
    top = max(i for i, _ in rows)
    rows += [(top + 1 + k, [float(np.float32(x)) for x in np.array(v) + 0.25 * np.std(v) * rng.standard_normal(len(v))]) for k, (_, v) in enumerate(rows[:60])]
    rows += [(top + 100 + k, rows[k % 7][1]) for k in range(20)] + [(top + 200, [0.0] * 64), (top + 201, None), (top + 202, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    res = con.execute(embed_dup.OP2_SQL)
    names = [d[0] for d in res.description]
    want = {tuple(dict(zip(names, r))[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in res.fetchall()}
    got = {tuple(r) for r in embed_dup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert got == want and sum(r[1] > 0 for r in got) > 80
