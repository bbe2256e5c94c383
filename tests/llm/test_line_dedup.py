from photocat.llm import line_dedup


def brute(rows, min_sites):
    import re

    worded = lambda x: re.search("[^ \t-\r]", x)
    sites, first = {}, {}
    for d, t, _, s, *_ in rows:
        for x in set((t or "").split("\n")) if t is not None else ():
            if worded(x):
                sites.setdefault(x, set()).update([] if s is None else [s])
                first[x] = d if first.get(x) is None else first[x] if d is None else min(first[x], d)
    out = []
    for d, t, *_ in rows:
        gone = {x for r in rows if r[0] == d and r[1] is not None for x in r[1].split("\n") if worded(x) and len(sites[x]) >= min_sites and first[x] != d}
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if x not in gone]
        out.append((d, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def check(spark, docs, rows, n):
    got = line_dedup.remove_boilerplate(docs, min_sites=n).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n)


def test_against_brute_force(spark):
    rows = [(k, "\n".join([f"own {k}", *(f"line {j}" for j in range(60) if k % 60 <= j), "", " "]), "en", f"s{k % 37}" if k % 11 else None) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for n in (2, 30, 36):  # sketches alone, and counts near the threshold
        check(spark, docs, rows, n)


def test_odd_rows(spark, odd):
    docs, rows = odd
    rows = [*rows, *((20 + k, "shared\nown %d" % k, "en", f"z{k}", 1, "x") for k in range(4)), (None, "shared", "en", "zz", 1, "x"), (23, "shared", None, "z3", 1, "x")]
    check(spark, spark.createDataFrame(rows, docs.schema), rows, 3)


def test_columns(spark, odd):
    docs = odd[0].withColumnRenamed("node", "gone").withColumn("n_lines", docs_one()).withColumn("key", docs_one())
    assert line_dedup.remove_boilerplate(docs, counts=False).columns == docs.columns
    assert line_dedup.remove_boilerplate(docs).columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]


def docs_one():
    from pyspark.sql import functions as F

    return F.lit(1)
