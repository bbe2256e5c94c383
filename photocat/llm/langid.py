"""Language identification by Bayesian fusion of evidence.

Text: a naive Bayes model over hashed byte trigrams, counted over all labelled documents. Its likelihood is tempered,
since neighbouring trigrams depend on each other. Markup: how often a declared language goes with a text of each
language. Address suffix: likewise. Host: a prior from the languages of the other texts of the host, smoothed towards
its registered domain and that towards all texts; a row's own vote is left out. The last three come from grouped
aggregation over all rows of what the text alone says, and the posterior is their product.

Defined results: a null or empty text, a null or malformed address and a missing declaration are no evidence; ties go
to the language that comes first; without labelled documents the language is null; repeated rows and ids are judged
row by row; empty tables give no rows; further columns are left out by ``identify``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import fixed, small_or_plain, table, text_slices, utf8

BUCKETS = 1 << 15
SMOOTH = 0.05
#: Share of the text's log-likelihood that counts.
TEMPER = 0.2
#: Weight, in texts, of the level above in the priors, and of an even spread in the tables of declared languages and suffixes.
KAPPA = 5.0
ALPHA = 1.0
#: A row is kept if its language is at least this sure.
LEAST = 0.5


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte position, BUCKETS where less than three bytes are left; first position of each text and the end)"""
    data = np.frombuffer(b"".join(texts) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    for back in (1, 2):
        last = ends - back
        bucket[last[last >= np.concatenate([[0], ends[:-1]])]] = BUCKETS
    return bucket, np.concatenate([[0], ends]).astype(np.int64)


def _count_batches(batches):
    counts: dict[str, np.ndarray] = {}
    for part in text_slices(batches):
        bucket, first = trigrams(utf8(part.column("text")))
        lang = np.array(part.column("lang").to_pylist(), dtype=object)
        owner = np.repeat(np.arange(len(lang)), np.diff(first))
        for name in set(lang.tolist()):
            mine = bucket[(lang == name)[owner]] if len(set(lang.tolist())) > 1 else bucket
            counts[name] = counts.get(name, 0) + np.bincount(mine, minlength=BUCKETS + 1)[:BUCKETS]
    for name, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c.astype("<i8").tobytes()], pa.binary())], names=["lang", "counts"])


def _sum_counts(rows: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for raw in rows.column("counts").to_pylist():
        total += np.frombuffer(raw, dtype="<i8")
    return pa.table([rows.column("lang").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language; the last row is for no trigram). ``labelled``: text, lang."""
    sums = labelled.filter("lang is not null").select("text", "lang").mapInArrow(_count_batches, "lang string, counts binary")
    found = sorted((r[0], np.frombuffer(r[1], dtype=np.int64)) for r in sums.groupBy("lang").applyInArrow(_sum_counts, "lang string, counts binary").toLocalIterator())
    table_ = np.zeros((BUCKETS + 1, len(found)), dtype=np.float64)
    for k, (_, c) in enumerate(found):
        table_[:BUCKETS, k] = np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS))
    return [x for x, _ in found], table_


def likelihoods(texts: list[bytes], logs: np.ndarray) -> np.ndarray:
    """(texts, languages) log-likelihoods."""
    bucket, first = trigrams(texts)
    out = np.zeros((len(texts), logs.shape[1]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k in range(logs.shape[1]):
            out[some, k] = np.add.reduceat(logs[:, k][bucket], first[:-1][some])
    return out


def _evidence(rows: DataFrame, logs: np.ndarray) -> DataFrame:
    """The rows with ``ll``, the log-likelihood by language, in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        for part in text_slices(batches):
            ll = likelihoods(utf8(part.column("text")), shared.value)
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(ll.tolist(), pa.list_(pa.float64()))], names=[*names, "ll"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", ll array<double>")


def host_of(url):
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def document_in(url):
    """The number that the path of a page's address ends in, up to an extension."""
    return F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("bigint")


def declared_in(html):
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html[^<>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")))


def visible(html):
    """The text outside of markup. A script or style that nothing closes goes to the end, and a tag ends before the next one
    starts, so every match moves on and a page takes linear time."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\z)|<[^<>]*>", " ")


def identify(rows: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """The rows with ``lang``, ``posterior`` and ``text_lang`` in place of the text. ``rows``: ids, text, declared,
    host (null where there is none)."""
    k = len(langs)
    rows = _evidence(rows, logs) if k else rows.drop("text").withColumn("ll", F.lit(None).cast("array<double>"))
    if not k:
        return rows.withColumns({"lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")}).drop("ll")
    labels = F.element_at("host_labels", -1)
    best = lambda scores: F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i")) for i, s in enumerate(scores)]))
    ll = [F.col("ll")[i] for i in range(k)]
    rows = rows.withColumn("host", F.nullif(F.col("host"), F.lit(""))).withColumn("host_labels", F.split("host", r"\."))
    rows = rows.withColumns({
        "suffix": F.when(F.size("host_labels") > 1, labels),
        "domain": F.when(F.size("host_labels") > 1, F.concat_ws(".", F.slice("host_labels", -2, 2))).otherwise(F.col("host")),
        "vote": F.when(F.exists("ll", lambda x: x != 0), -best(ll)["i"]),
    }).drop("host_labels")
    rows = fixed(rows)
    votes = lambda: [F.count(F.when(F.col("vote") == i, 1)) for i in range(k)]
    for name in ("declared", "suffix", "host", "domain"):
        counts = fixed(rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.array(*votes()).alias(f"n_{name}")))
        rows = rows.join(small_or_plain(counts), name, "left")
    total = rows.agg(*[x.alias(f"v{i}") for i, x in enumerate(votes())]).first()
    kinds = {name: rows.select(name).filter(F.col(name).isNotNull()).distinct().count() for name in ("declared", "suffix")}
    n_all = sum(total)

    own = lambda i: (F.coalesce(F.col("vote"), F.lit(-1)) == i).cast("double")
    any_own = F.col("vote").isNotNull().cast("double")
    scores = []
    for i in range(k):
        n = lambda name: F.greatest(F.lit(0.0), F.coalesce(F.col(f"n_{name}")[i].cast("double"), F.lit(0.0)) - F.when(F.col(name).isNotNull(), own(i)).otherwise(0.0))  # noqa: B023, E731
        size = lambda name: F.greatest(F.lit(0.0), F.coalesce(F.aggregate(F.col(f"n_{name}"), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) - F.when(F.col(name).isNotNull(), any_own).otherwise(0.0))
        overall = F.lit((total[i] + 1.0) / (n_all + k))
        domain = (n("domain") + KAPPA * overall) / (size("domain") + KAPPA)
        prior = (n("host") + KAPPA * domain) / (size("host") + KAPPA)
        given = lambda name: F.when(F.col(name).isNull(), 0.0).otherwise(F.log((n(name) + ALPHA) / (F.lit(float(total[i])) - own(i) + ALPHA * max(1, kinds[name]))))  # noqa: B023, E731
        scores.append(TEMPER * ll[i] + F.log(prior) + given("declared") + given("suffix"))
    rows = rows.withColumn("scores", F.array(*scores))
    s = [F.col("scores")[i] for i in range(k)]
    rows = rows.withColumn("top", best(s))
    names = F.array(*[F.lit(x) for x in langs])
    spread = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top.s")))
    return rows.withColumns({"lang": F.get(names, -F.col("top.i")), "posterior": 1 / spread, "text_lang": F.get(names, F.col("vote"))})


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and every page (those have a page_id, and the doc_id that their address ends in).
    Documents have no markup and no address; their source is their host."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, logs = train(docs)
    none = F.lit(None)
    rows = docs.select("doc_id", none.cast("bigint").alias("page_id"), "text", none.cast("string").alias("declared"), F.col("source").alias("host"))
    rows = rows.unionByName(pages.select(document_in(F.col("url")).alias("doc_id"), "page_id", visible(F.col("html")).alias("text"), declared_in(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host")))
    out = identify(rows, langs, logs)
    return out.select("doc_id", "page_id", "lang", "posterior", "text_lang", F.coalesce(F.col("posterior") >= LEAST, F.lit(False)).alias("kept"))
