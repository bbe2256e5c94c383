"""Quality rules: base rules on words, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. Per language and source, the minimum covariance
determinant estimate (mean and covariance of the half-set with the smallest determinant) is found by
concentration steps over all rows; a text is rejected when its Mahalanobis distance is too large.

A concentration step is one aggregate: rows get their distance to the present estimate, and counts, sums and
products are gathered per group and distance bin (combined before the shuffle, a few hundred bins a group).
The nearest bins that hold the wanted share of the rows give the next estimate. No group is ever gathered.

Defined results: a null text is the empty text and fails the base rules; null language or source is a group of
its own; groups of fewer than ``min_group`` rows are pooled per language, and a pool that is still smaller judges
nothing (its rows keep the base verdict); repeated rows and ids are judged row by row; an empty table gives no rows;
further columns are kept by ``filter_quality`` and may have any name.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.llm.common import fixed, small_or_plain, text_slices, utf8

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops"]
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?"
UPPER = bytes(range(65, 91))

#: Smallest standard deviation of each component of the vector, in its own unit; keeps a group of equal texts from rejecting everything else.
FLOORS = (0.06, 0.25, 0.30, 0.30, 0.25, 0.25)
DIM = len(FLOORS)
#: Squared distance: the value a normal vector of six components exceeds once in a million.
CUTOFF = 38.3
#: Share of a group's rows in the half-set.
SHARE = 0.75
MIN_GROUP = 60
MAX_STEPS = 8
BINS_PER_DOUBLING = 16


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    base = np.uint64(len(seen))
    if len(seen) ** size < 2**64:
        key = ids[:n].copy()
        for k in range(1, size):
            key = key * base + ids[k : n + k]
    else:  # one word more at a time, numbered anew so that the keys stay exact
        key = ids[:n].copy()
        for k in range(1, size):
            key = np.unique(key * base + ids[k : n + k], return_inverse=True)[1].astype(np.uint64)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts[inverse] > 1)
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(mark, often, 1)
    np.add.at(mark, often + size, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def text_stats(b: bytes) -> tuple[int, ...]:
    """The values named in STATS, of one UTF-8 text."""
    words = b.split()
    bare = b.translate(None, SPACE)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        len(words),
        len(bare.decode("utf-8", "replace")),
        len(b) - len(b.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(b) - len(b.translate(None, UPPER)),
        len(b) - len(b.translate(None, STOPS)),
    )


def _stats_of_batches(batches):
    for part in text_slices(batches):
        columns = list(zip(*map(text_stats, utf8(part.column("text"))), strict=True))
        kept = [(n, part.column(n)) for n in part.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(c, pa.int64()) for c in columns], names=[n for n, _ in kept] + STATS)


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the statistics of every whole text, without the text."""
    df = docs.select(*keys, "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"] + [f"{s} bigint" for s in STATS])
    return df.mapInArrow(_stats_of_batches, schema)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list:
    """Transformed statistics. Shares are drawn towards their usual value where a text is short, and logarithms even out
    their tails. Rounded, so that sums do not depend on the order of the rows."""
    share = lambda k, n, usual, weight, scale: F.log1p(scale * (F.col(k) + usual * weight) / (F.col(n) + weight))
    parts = [
        F.log((F.col("word_chars") + 100.0) / (F.col("n_words") + 20.0)),
        share("n_symbols", "word_chars", 0.0, 50.0, 100.0),
        share("n_dup_lines", "n_lines", 0.0, 6.0, 20.0),
        share("n_repeat_words", "n_words", 0.0, 30.0, 20.0),
        share("n_upper", "word_chars", 0.03, 100.0, 50.0),
        share("n_stops", "word_chars", 0.03, 100.0, 50.0),
    ]
    return [(F.round(p * 1024) / 1024).alias(f"x{i}") for i, p in enumerate(parts)]


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
GROUP = ["g_lang", "g_source"]


def _grouped(stats: DataFrame) -> DataFrame:
    """Statistics with their vector and their group; null is a value of its own, written with a leading mark."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return stats.select("*", *_vector(), named(F.col("lang")).alias("g_lang"), named(F.col("source")).alias("g_source"), base_failed().alias("base_failed"))


def _pooled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of small groups belong to their language's pool."""
    return rows.join(small_or_plain(sizes), GROUP, "left").withColumn("g_source", F.when(F.col("n_group") >= MIN_GROUP, F.col("g_source")).otherwise("~")).drop("n_group")


def _distance() -> F.Column:
    """Squared length of W (x - m), W the lower triangle kept row by row in ``w``."""
    total, at = None, 0
    for i in range(DIM):
        row = None
        for j in range(i + 1):
            term = F.col("w")[at] * (F.col(X[j]) - F.col("m")[j])
            row, at = term if row is None else row + term, at + 1
        total = row * row if total is None else total + row * row
    return total


def _moments() -> list:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i, j in PAIRS]]


def _solve(n: float, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, whitening triangle and log determinant of the covariance whose variances are at least the floors."""
    m = s / n
    c = p / n - np.outer(m, m)
    floor = np.square(FLOORS)
    scale = np.sqrt(np.maximum(np.diag(c), 1e-12))
    r = c / np.outer(scale, scale)
    wide = np.sqrt(np.maximum(np.diag(c), floor))
    c = (0.95 * r + 0.05 * np.eye(DIM)) * np.outer(wide, wide)
    c[np.diag_indices(DIM)] = wide**2
    w = np.linalg.inv(np.linalg.cholesky(c))
    return m, w[np.tril_indices(DIM)], float(np.linalg.slogdet(c)[1])


ESTIMATE = "g_lang string, g_source string, start int, n_all bigint, m array<double>, w array<double>, logdet double"


def _estimates(batches):
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            p = np.zeros((DIM, DIM))
            for i, j in PAIRS:
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
            m, w, logdet = _solve(r["n"], np.array([r[f"s{i}"] for i in range(DIM)]), p)
            out.append((r["g_lang"], r["g_source"], r["start"], r["n_all"], m, w, logdet))
        yield pd.DataFrame(out, columns=["g_lang", "g_source", "start", "n_all", "m", "w", "logdet"])


def _first_estimates(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Two starts a group: 0 from medians and median deviations (found in a count of values), 1 from all rows."""
    values = rows.select(*GROUP, F.posexplode(F.array(*X)).alias("i", "x")).groupBy(*GROUP, "i", "x").agg(F.count("*").alias("k"))

    def median(of: DataFrame, x: str, name: str) -> DataFrame:
        """The smallest value that half of the group's rows do not exceed, from counts of values in steps of 1/64."""
        upto = of.groupBy(*GROUP, "i", (F.ceil(F.col(x) * 64) / 64).alias("v")).agg(F.sum("k").alias("k"))
        upto = upto.selectExpr("*", "sum(k) over (partition by g_lang, g_source, i order by v) as upto", "sum(k) over (partition by g_lang, g_source, i) as total")
        return upto.filter("2 * upto >= total").groupBy(*GROUP, "i").agg(F.min("v").alias(name))

    values = values.groupBy(*GROUP, "i", (F.ceil(F.col("x") * 64) / 64).alias("x")).agg(F.sum("k").alias("k"))
    mid = median(values, "x", "mid")
    mad = median(values.join(mid, [*GROUP, "i"]).withColumn("away", F.abs(F.col("x") - F.col("mid"))), "away", "mad")
    centre = mid.join(mad, [*GROUP, "i"]).groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("i", "mid", "mad"))).alias("c"))
    wide = [F.greatest(F.col("c")[i]["mad"] * 1.4826, F.lit(FLOORS[i])) for i in range(DIM)]
    robust = centre.join(sizes.withColumnRenamed("n_group", "n_all"), GROUP).select(
        *GROUP, F.lit(0).alias("start"), "n_all", F.col("c.mid").alias("m"),
        F.array(*[(1 / wide[i]) if i == j else F.lit(0.0) for i in range(DIM) for j in range(i + 1)]).alias("w"), F.lit(float("inf")).alias("logdet"),
    )
    classic = rows.groupBy(*GROUP).agg(*_moments()).withColumns({"start": F.lit(1), "n_all": F.col("n")}).mapInPandas(_estimates, ESTIMATE)
    return robust.unionByName(classic)


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step for every group and start."""
    d2 = _distance()
    near = (
        rows.join(small_or_plain(estimates), GROUP)
        .withColumn("bin", F.floor(F.log2(1 + d2) * BINS_PER_DOUBLING))
        .groupBy(*GROUP, "start", "n_all", "bin").agg(*_moments())
        .selectExpr("*", "sum(n) over (partition by g_lang, g_source, start order by bin rows unbounded preceding) - n as before")
        .filter(F.col("before") < F.ceil(F.col("n_all") * SHARE))
    )
    sums = [F.sum(c).alias(c) for c in near.columns if c[0] in "nsp" and c not in ("n_all", "start")]
    return near.groupBy(*GROUP, "start", "n_all").agg(*sums).mapInPandas(_estimates, ESTIMATE)


def _best(estimates: DataFrame) -> DataFrame:
    """The start with the smallest determinant."""
    return estimates.groupBy(*GROUP).agg(F.min_by(F.struct("start", "n_all", "m", "w", "logdet"), F.struct("logdet", "start")).alias("b")).select(*GROUP, "b.*")


def _spread_factor() -> float:
    """Makes the covariance of the nearest ``SHARE`` of normal rows that of all of them (Monte Carlo, fixed seed)."""
    d2 = np.sort(np.square(np.random.default_rng(7).standard_normal((200_000, DIM))).sum(1))
    return float(d2[: int(len(d2) * SHARE)].mean() / DIM)


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group sizes, estimates): minimum covariance determinant estimates over all rows that pass the base rules."""
    rows = fixed(_grouped(stats).filter(~F.col("base_failed")).select(*GROUP, *X))
    sizes = fixed(rows.groupBy(*GROUP).agg(F.count("*").alias("n_group")).filter(F.col("n_group") >= MIN_GROUP))
    rows = fixed(_pooled(rows, sizes))
    pools = fixed(rows.groupBy(*GROUP).agg(F.count("*").alias("n_group")).filter(F.col("n_group") >= MIN_GROUP))
    estimates = fixed(_first_estimates(rows.join(small_or_plain(pools.select(*GROUP)), GROUP, "left_semi"), pools))
    for k in range(2):
        estimates = fixed(_step(rows, estimates))
    estimates = fixed(_best(estimates))
    for _ in range(MAX_STEPS):  # a group takes a step's estimate while that makes its determinant smaller
        now = _step(rows, estimates).select(*GROUP, F.struct("start", "n_all", "m", "w", "logdet").alias("now"))
        both = small_or_plain(estimates).join(now, GROUP).withColumn("moved", F.col("now.logdet") < F.col("logdet") - 1e-9)
        pick = lambda c: F.when(F.col("moved"), F.col("now")[c]).otherwise(F.col(c)).alias(c)
        both = fixed(both.select(*GROUP, "moved", *[pick(c) for c in ("start", "n_all", "m", "w", "logdet")]))
        estimates = both.drop("moved")
        if not both.filter("moved").limit(1).count():
            break
    return sizes, estimates


def _verdict(grouped: DataFrame, sizes: DataFrame, estimates: DataFrame) -> DataFrame:
    """``distance`` (null where nothing judges the row) and ``kept``."""
    judged = _pooled(grouped, sizes).join(small_or_plain(estimates.select(*GROUP, "m", "w")), GROUP, "left")
    far = _distance() * F.lit(_spread_factor())
    return judged.withColumn("distance", far).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its statistics, ``base_failed``, ``distance`` and ``kept``."""
    stats = fixed(measure(docs, ["doc_id", "lang", "source"]))
    return _verdict(_grouped(stats), *fit(stats)).select("doc_id", *STATS, "base_failed", "distance", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. The text is read twice: once to estimate, once to filter."""
    sizes, estimates = fit(measure(docs, ["lang", "source"]))
    row = docs.select(F.struct("*").alias("row"), "lang", "source", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" if f.name != "row" else f"row {_ddl(f.dataType)}" for f in row.schema if f.name != "text")
    stats = row.mapInArrow(_stats_of_batches, kinds + "".join(f", {s} bigint" for s in STATS))
    return _verdict(_grouped(stats), sizes, estimates).filter("kept").select("row.*")


def _ddl(kind) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kind.fields) + ">"


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    from photocat.llm.common import table

    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


