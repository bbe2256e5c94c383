"""Registered existing-caption queries over the words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.operators import text_blocks
from photocat.plans.registry import query
from photocat.plans.views import load

WORD_CHARS, ALNUM = "[^\\pL\\pN\\pM]", "[^\\pL\\pN]"


def _words(spark, sf):
    return load(spark, sf, "words").withColumnRenamed("doc_id", "photo_id")


@query(
    "x1_assemble_ocr_lines",
    "words",
    """SELECT doc_id AS photo_id, line_no, string_agg(word, ' ' ORDER BY pos) AS text, cast(floor(sum(conf * greatest(1, length(word))) / sum(greatest(1, length(word))) * 1000000 + 0.501) AS bigint) AS conf_ppm
 FROM words GROUP BY doc_id, line_no""",
)
def _(spark, sf):
    lines = text_blocks.assemble_lines(_words(spark, sf))
    # whole millionths, nudged off the exact halves that two summation orders would round apart
    return lines.select("photo_id", "line_no", "text", F.floor(F.col("conf") * 1000000 + 0.501).alias("conf_ppm"))


G = f""", g AS (SELECT doc_id AS photo_id, block_no, line_no, conf, CASE WHEN length(regexp_replace(word, '{WORD_CHARS}', '', 'g')) >= 0.5 * length(trim(word, E' \\n\\t\\r'))
   THEN length(regexp_replace(word, '{ALNUM}', '', 'g')) ELSE 0 END AS g FROM words),
 lines AS (SELECT photo_id, block_no, line_no, cast(sum(CASE WHEN conf >= 0.5 THEN g ELSE 0 END) AS bigint) AS sure, cast(sum(CASE WHEN conf >= 0.6 THEN g ELSE 0 END) AS bigint) AS fair,
   cast(sum(g) AS bigint) AS glyphs FROM g GROUP BY photo_id, block_no, line_no)"""


@query("x2_count_word_glyphs", "words", G + " SELECT photo_id, line_no, sure, fair, glyphs FROM lines")
def _(spark, sf):
    return text_blocks.line_glyphs(_words(spark, sf)).select("photo_id", "line_no", "sure", "fair", "glyphs")


@query(
    "x3_filter_ocr_lines",
    "words",
    G
    + """, t AS (SELECT *, 4 + line_no % 12 AS thickness, sure >= 2 AND 4 + line_no % 12 >= 10 AS reads FROM lines),
 b AS (SELECT photo_id, block_no, bool_or(reads) AS block_reads FROM t GROUP BY photo_id, block_no)
 SELECT t.photo_id, line_no, reads FROM t JOIN b ON b.photo_id = t.photo_id AND b.block_no = t.block_no
 WHERE reads OR (block_reads AND thickness >= 5 AND (glyphs >= 2 OR fair >= 1))""",
)
def _(spark, sf):
    lines = text_blocks.line_glyphs(_words(spark, sf)).withColumns({"thickness": 4 + F.col("line_no") % 12, "short_side": F.lit(1000)})
    return text_blocks.filter_lines(lines).select("photo_id", "line_no", "reads")


# two columns of lines, in paragraphs of five
BOXES = """, l AS (SELECT DISTINCT doc_id AS photo_id, line_no, line_no % 2 AS col, cast(floor(line_no / 2) AS bigint) AS i FROM words),
 boxes AS (SELECT photo_id, line_no, col * 600.0 + i % 3 * 10 AS x, i * 12.0 + cast(floor(i / 5) AS bigint) * 30 + col * 3 AS y, 100.0 + i % 4 * 5 AS w, 8.0 + i % 3 * 2 AS h, col, i FROM l)"""


def _boxes(spark, sf):
    lines = _words(spark, sf).select("photo_id", "line_no").distinct()
    c, i = F.col("line_no") % 2, F.floor(F.col("line_no") / 2)
    return lines.select(
        "photo_id", "line_no", (c * 600.0 + i % 3 * 10).alias("x"), (i * 12.0 + F.floor(i / 5) * 30 + c * 3).alias("y"),
        (100.0 + i % 4 * 5).alias("w"), (8.0 + i % 3 * 2).alias("h"),
    )


@query(
    "x4_group_text_blocks",
    "words",
    BOXES
    + """, k AS (SELECT *, min(line_no) OVER (PARTITION BY photo_id, col, floor(i / 5)) AS block FROM boxes)
 SELECT photo_id, block, cast(min(x) AS double) AS x, cast(min(y) AS double) AS y, cast(max(x + w) - min(x) AS double) AS w, cast(max(y + h) - min(y) AS double) AS h, count(*) AS n_lines
 FROM k GROUP BY photo_id, block""",
)
def _(spark, sf):
    return text_blocks.block_boxes(text_blocks.group_text_blocks(_boxes(spark, sf)))


BLOCKS = """, bl AS (SELECT doc_id AS photo_id, block_no AS block, cast(5 + block_no * 7 % 30 AS double) AS height, count(DISTINCT line_no) AS n_lines,
   cast(block_no * 37 % 100 AS double) AS contrast, cast(block_no % 50 AS double) AS chroma, cast(block_no * 13 % 100 AS double) / 100 AS along FROM words GROUP BY doc_id, block_no)"""


@query(
    "x5_main_block",
    "words",
    BLOCKS
    + """, m AS (SELECT photo_id, block AS main, height AS mh, contrast AS mc FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY height * n_lines DESC, contrast DESC, block) AS rn FROM bl) AS x WHERE rn = 1)
 SELECT b.photo_id, block, CASE WHEN block = main THEN 'main' WHEN (along < 0.25 OR along > 0.75) AND height <= 0.6 * mh AND contrast <= 0.7 * mc AND chroma <= 25 THEN 'other' ELSE 'caption' END AS role
 FROM bl b JOIN m ON m.photo_id = b.photo_id""",
)
def _(spark, sf):
    b = F.col("block_no")
    blocks = _words(spark, sf).select("photo_id", "block_no", "line_no").distinct().groupBy("photo_id", "block_no").agg(F.count(F.lit(1)).alias("n_lines"))
    blocks = blocks.select(
        "photo_id", b.alias("block"), (5 + b * 7 % 30).cast("double").alias("height"), "n_lines", (b * 37 % 100).cast("double").alias("contrast"),
        (b % 50).cast("double").alias("chroma"), ((b * 13 % 100).cast("double") / 100).alias("along"),
    )
    return text_blocks.main_block(blocks).select("photo_id", "block", "role")


SCORE = """, sc AS (SELECT *, coalesce(lower(make) = 'plustek', false) OR coalesce(software LIKE '%Scan %', false) OR model LIKE 'Perfection%' AS scanner FROM analysis),
 ev AS (SELECT *, CASE WHEN NOT band_found THEN 0.0 ELSE CASE WHEN abs(angle) >= 0.12 THEN 2.0 ELSE 0.0 END + CASE WHEN edge_blur >= 1.5 THEN 1.0 ELSE 0.0 END
    + CASE WHEN color_drift >= 2.0 THEN 1.0 ELSE 0.0 END + CASE WHEN noise >= 1.5 THEN 1.5 WHEN noise >= 0.3 THEN 1.0 ELSE 0.0 END
    + CASE WHEN scanner THEN 2.0 WHEN dpi >= 300 AND NOT has_camera_tags THEN 0.5 ELSE 0.0 END END AS score FROM sc),
 dc AS (SELECT *, CASE WHEN has_record AND has_original THEN 'A' WHEN band_found AND has_marker THEN 'B'
    WHEN band_found AND (reads_text OR looks_written) THEN CASE WHEN score >= 2.0 THEN 'C' ELSE 'B' END WHEN text_over_photo THEN 'D' END AS "case" FROM ev)"""


def decided(spark, sf):
    a = load(spark, sf, "analysis").withColumn("verified", F.col("has_record") & F.col("has_original"))
    return text_blocks.decide_case(text_blocks.scan_evidence(a))


@query(
    "x6_scan_evidence_score",
    "analysis",
    SCORE
    + """ SELECT photo_id, cast(score AS double) AS score, CASE WHEN band_found THEN concat_ws(', ', CASE WHEN abs(angle) >= 0.12 THEN 'tilted' END, CASE WHEN edge_blur >= 1.5 THEN 'soft edge' END,
   CASE WHEN color_drift >= 2.0 THEN 'lighting drift' END, CASE WHEN noise >= 1.5 THEN 'paper grain' WHEN noise >= 0.3 THEN 'grain' END,
   CASE WHEN scanner THEN 'scanner' WHEN dpi >= 300 AND NOT has_camera_tags THEN 'high dpi, no camera data' END) ELSE '' END AS cues FROM ev""",
)
def _(spark, sf):
    return text_blocks.scan_evidence(load(spark, sf, "analysis")).select("photo_id", "score", F.array_join("cues", ", ").alias("cues"))


@query("x7_decide_case", "analysis", SCORE + ' SELECT photo_id, "case" FROM dc')
def _(spark, sf):
    return decided(spark, sf).select("photo_id", "case")


@query(
    "x8_weak_reads_flag",
    "words",
    """, l AS (SELECT doc_id AS photo_id, line_no, sum(conf * greatest(1, length(word))) / sum(greatest(1, length(word))) AS conf FROM words GROUP BY doc_id, line_no)
 SELECT photo_id, min(conf) < 0.6 AS weak FROM l GROUP BY photo_id""",
)
def _(spark, sf):
    return text_blocks.weak_reads(text_blocks.assemble_lines(_words(spark, sf)))
