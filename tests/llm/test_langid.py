import time

import numpy as np
from pyspark.sql import functions as F

from photocat.llm import langid


def test_trigrams_stay_inside_texts():
    bucket, first = langid.trigrams([b"abcd", b"", b"ab", b"ABCD"])
    assert first.tolist() == [0, 4, 4, 6, 10]
    assert (bucket == langid.BUCKETS).tolist() == [False, False, True, True, True, True, False, False, True, True]
    assert bucket[:2].tolist() == bucket[6:8].tolist()


def test_held_out_accuracy(real):
    docs, rows = real
    langs, logs = langid.train(docs.filter("doc_id % 3 <> 0"))
    held = docs.filter("doc_id % 3 = 0").select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    got = {r.doc_id: r.lang for r in langid.identify(held, langs, logs).collect()}
    assert np.mean([got[r["doc_id"]] == r["lang"] for r in rows if r["doc_id"] % 3 == 0]) >= 0.95


def plain(rows, ll, langs):
    """The fusion over plain rows (declared, host) with log-likelihoods."""
    rows = [(d, h or None) for d, h in rows]
    k = len(langs)
    suffix = [h.split(".")[-1] if h and "." in h else None for _, h in rows]
    domain = [".".join(h.split(".")[-2:]) if h else None for _, h in rows]
    vote = [int(np.argmax(x)) if any(x) else None for x in ll]
    total = np.bincount([v for v in vote if v is not None], minlength=k).astype(float)
    out = []
    for r, (declared, host) in enumerate(rows):
        own = np.eye(k)[vote[r]] if vote[r] is not None else np.zeros(k)

        def tally(values, mine):
            if mine is None:
                return np.zeros(k)
            return np.bincount([v for v, x in zip(vote, values, strict=True) if x == mine and v is not None], minlength=k) - own  # noqa: B023

        d, h = tally(domain, domain[r]), tally([h for _, h in rows], host)
        prior = (d + langid.KAPPA * (total + 1) / (total.sum() + k)) / (d.sum() + langid.KAPPA)
        prior = (h + langid.KAPPA * prior) / (h.sum() + langid.KAPPA)
        score = langid.TEMPER * ll[r] + np.log(prior)
        for values, mine in (([x for x, _ in rows], declared), (suffix, suffix[r])):
            if mine is not None:
                score = score + np.log((tally(values, mine) + langid.ALPHA) / (total - own + langid.ALPHA * len({x for x in values if x is not None})))
        p = np.exp(score - score.max())
        out.append((langs[int(np.argmax(score))], float(1 / p.sum())))
    return out


def test_fusion_against_plain_numpy(spark, real):
    docs, rows = real
    langs, logs = langid.train(docs)
    hosts = ["a.example.de", "b.example.de", "x.com", "solo", None, ""]
    cut = [(k, r["text"][: (k * 13) % 40], [r["lang"], None, "xx"][k % 3], hosts[(k // 2) % 6]) for k, r in enumerate(rows)] + [(900, None, None, None), (901, "", "en", "x.com"), (1, "ab", "de", "x.com")]
    df = spark.createDataFrame(cut, "doc_id bigint, text string, declared string, host string")
    ll = langid.likelihoods([(t or "").encode() for _, t, _, _ in cut], logs)
    want = sorted((i, p[0], round(p[1], 9)) for (i, *_), p in zip(cut, plain([(d, h) for _, _, d, h in cut], ll, langs), strict=True))
    assert sorted((r.doc_id, r.lang, round(r.posterior, 9)) for r in langid.identify(df, langs, logs).collect()) == want


def test_markup_and_address(spark):
    page = '<!DOCTYPE html><HTML class="x" Lang=\'DE-de\'><style>p{}</style><script>var a="<p>";</script><p>Hallo<br>Welt</p>'
    row = spark.createDataFrame([(page, "https://WWW.Example.org:80/x"), (None, "not an address"), ("plain", None)], "html string, url string")
    got = row.select(langid.declared_in(F.col("html")), F.trim(langid.visible(F.col("html"))), langid.host_of(F.col("url"))).collect()
    assert got[0][0] == "de" and got[0][1].split() == ["Hallo", "Welt"] and got[0][2] == "www.example.org"
    assert tuple(got[1]) == (None, None, None) and tuple(got[2]) == (None, "plain", None)


def test_number_of_the_document(spark):
    urls = [("http://a.example/en/12/", 12), ("http://a.example/en/7.html?p=3#x", 7), ("https://a.example/5/about", None), ("x", None), (None, None)]
    df = spark.createDataFrame(urls, "url string, want bigint")
    assert all(r[0] == r[1] for r in df.select(langid.document_in(F.col("url")), "want").collect())


def test_markup_of_a_megabyte_takes_linear_time(spark):
    pages = ["<" * 1_000_000, "<script " * 120_000, "<script>" * 120_000, "<html " * 160_000, "<html" + " " * 1_000_000, "<p>word</p>" * 90_000]
    began = time.monotonic()
    got = spark.createDataFrame([(p,) for p in pages], "html string").select(langid.visible(F.col("html")), langid.declared_in(F.col("html"))).collect()
    assert time.monotonic() - began < 30
    assert got[0][0] == pages[0] and got[2][0].strip() == "" and got[5][0].split() == ["word"] * 90_000


def test_columns_of_the_same_names_and_odd_rows(spark, odd, real):
    docs = odd[0].withColumns({"lang_": F.lit(1), "posterior": F.lit("theirs"), "ll": F.lit("theirs"), "host_labels": F.lit(2)})
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    langs, logs = langid.train(real[0])
    got = langid.identify(rows, langs, logs).collect()
    assert len(got) == len(odd[1]) and all(r.lang in langs for r in got)
