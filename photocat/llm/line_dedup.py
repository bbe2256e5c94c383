"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Per line digest, a HyperLogLog sketch of its sites is merged by
aggregation (partial sketches before the shuffle). Lines whose estimate is near the threshold get an exact distinct
count. A line at or over the threshold stays in the document with the smallest id that holds it and leaves all others.

Defined results: a null text has no lines and stays null; lines without a word are never removed; a line counts once
a document; null sites are no site; documents that share an id share their lines' fate; a null id counts as the largest
id and its rows keep no line that another document holds; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import table

MIN_SITES = 10
#: log2 of the sketch's registers; the relative standard error is 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 11
#: Estimates within this share of the threshold (over four standard errors) are counted exactly.
NEAR = 0.15


def has_word(line):
    return line.rlike(r"[^ \t-\r]")


def line_key(line):
    return F.unhex(F.md5(line))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, site, key): the different lines with a word of each document."""
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), has_word), line_key))
    return docs.select("doc_id", "site", F.explode(keys).alias("key"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key, first_doc): lines on at least ``min_sites`` sites and the smallest id among their documents."""
    lines = _lines(docs)
    merged = lines.groupBy("key").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min("doc_id").alias("first_doc"))
    guess = merged.select("key", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    sure = guess.filter(F.col("sites") > min_sites * (1 + NEAR)).select("key", "first_doc")
    near = guess.filter(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("key", "first_doc")
    counted = lines.join(near, "key").filter("site is not null").groupBy("key", "first_doc", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("key", "first_doc").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("key", "first_doc"))


COUNTS = ("n_lines", "n_removed")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """The rows with boilerplate lines taken out of ``text``. With ``counts``, ``n_lines`` and ``n_removed`` (in place
    of columns with these names) tell how many lines there were and went."""
    slim = docs.select("doc_id", F.col(site).alias("site"), "text")
    gone = (
        _lines(slim).drop("site").join(boilerplate(slim, min_sites), "key").filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy("doc_id").agg(F.collect_set("key").alias("gone")).select(F.col("doc_id").alias("gone_id"), "gone")
    )
    row = docs.select(F.struct("*").alias("row"))
    joined = row.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")), "left")
    lines = F.split(F.col("row.text"), "\n")
    stays = F.filter(lines, lambda x: ~(has_word(x) & F.array_contains(F.col("gone"), line_key(x))))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines))
    out = joined.withColumn("left", F.when(F.col("gone").isNotNull(), stays))
    same = [(F.coalesce(F.array_join("left", "\n"), F.col("row.text")) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if not counts or c not in COUNTS]
    went = F.when(F.col("left").isNull(), 0).otherwise(n - F.size("left"))
    return out.select(*same, *([n.cast("long").alias("n_lines"), went.cast("long").alias("n_removed")] if counts else []))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with boilerplate lines removed."""
    return remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP8_SQL = f"""
WITH lines AS (
  SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), spread AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE regexp_matches(line, '[^ \\t-\\r]')
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT doc_id, list(DISTINCT line) AS gone FROM lines JOIN spread USING (line)
  WHERE doc_id IS DISTINCT FROM first_doc GROUP BY doc_id
), cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(g.gone, x), false)) AS kept
  FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_removed,
       array_to_string(kept, chr(10)) AS text
FROM cut
"""
