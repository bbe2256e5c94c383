import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from photocat.llm import mixing


def fill(budget, nodes):
    """Water filling by repeated rounds: {name: (capacity, weight)} to {name: share}."""
    got, left, rest = {}, dict(nodes), budget
    while True:
        weight = sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if w > 0 and c * weight <= rest * w]
        if not full:
            break
        k = min(full, key=lambda k: (left[k][0] / left[k][1], k))
        got[k] = left.pop(k)[0]
        rest -= got[k]
    return got | {k: rest * w // weight if weight else 0 for k, (_, w) in left.items()}


def brute(rows, percent, epochs, weights, seed="t"):
    leaf = defaultdict(list)
    for d, t, lang, source, *_ in rows:
        leaf[(source or "")[-1:], lang or "", source or ""].append((d, len((t or "").split())))
    supply = {k: sum(n for _, n in v) for k, v in leaf.items()}
    up = lambda depth: {p: sum(n * epochs for k, n in supply.items() if k[:depth] == p) for p in {k[:depth] for k in supply}}
    share = {(): sum(supply.values()) * percent // 100}
    for depth, name in enumerate(("domain", "lang", "source"), 1):
        capacity = up(depth)
        for parent in {k[: depth - 1] for k in capacity}:
            kids = {k: (c, weights.get(name, {}).get(k[-1], 1)) for k, c in capacity.items() if k[:-1] == parent}
            share |= fill(share[parent], kids)
    out = []
    for k, docs in leaf.items():
        whole = share[k] // supply[k] if supply[k] else 0
        rest, upto = share[k] - whole * supply[k], 0
        key = lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()  # noqa: B023, E731
        ordered = sorted(docs, key=lambda x: key(x[0]))
        for d, n in ordered:
            upto = sum(m for e, m in ordered if key(e) <= key(d))
            out.append((d, n, whole + (upto <= rest)))
    return Counter(out)


def check(spark, docs, rows, percent, epochs, weights):
    got = mixing.mix(docs, percent=percent, max_epochs=epochs, weights=weights, seed="t").collect()
    want = brute(rows, percent, epochs, weights)
    assert Counter((r.doc_id, r.n_tokens, r.times) for r in got) == want
    again = mixing.repeated(docs, percent=percent, max_epochs=epochs, weights=weights, seed="t")
    assert again.columns == docs.columns
    assert Counter(r.doc_id for r in again.collect()) == +Counter({d: sum(t * c for (e, _, t), c in want.items() if e == d) for d in {e for e, _, _ in want}})


def test_against_brute_force(spark, real, odd):
    rows = [tuple(r.values()) for r in real[1]]
    for percent, epochs, weights in ((60, 1, {}), (100, 3, {"lang": {"en": 9, "de": 1}}), (250, 2, {"source": {"src1": 0}}), (90, 1, {"domain": {"0": 5}})):
        check(spark, real[0], rows, percent, epochs, weights)
    check(spark, odd[0], [(r[0], "" if r[1] is None else r[1], *r[2:]) for r in odd[1]], 70, 2, {})


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("x", "en", "a", 10), ("x", "en", "b", 1000), ("x", "de", "c", 1000), ("y", "en", "d", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply bigint")
    got = {r.source: r.got for r in mixing.allot(df, 20, 1, {}).collect()}
    # 602 tokens: 301 a domain, 150 a language; what source a lacks of its 75 goes to b
    assert got == {"a": 10, "b": 140, "c": 150, "d": 301}


def test_one_large_leaf(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = mixing.mix(docs, percent=37, max_epochs=1, weights={}, seed="t").agg(F.sum(F.col("times") * 3)).first()[0]
    assert 22_200 - 3 < got <= 22_200
