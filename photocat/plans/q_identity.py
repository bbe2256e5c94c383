"""Registered identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.operators import identity
from photocat.plans.registry import query
from photocat.plans.views import load


@query("p1_quick_fingerprint", "", "SELECT doc_id, substr(sha256(strlen(text) || '|' || text), 1, 32) AS fingerprint FROM documents")
def _(spark, sf):
    d = load(spark, sf, "documents").withColumn("content", F.encode("text", "UTF-8"))
    return d.select("doc_id", identity.quick_fingerprint(F.col("content"), F.octet_length("content")).alias("fingerprint"))


@query("p2_full_fingerprint", "", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", identity.full_fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"))


GROUPS = """, g AS (SELECT content_hash, count(*) AS copies, arg_min(path, mtime_ns) AS keeper, (count(*) - 1) * max(size_bytes) AS spare_bytes
   FROM photos GROUP BY content_hash HAVING count(*) > 1)"""


@query("p3_duplicate_groups", "photos", GROUPS + " SELECT content_hash, copies, keeper, cast(spare_bytes AS bigint) AS spare_bytes FROM g")
def _(spark, sf):
    return identity.duplicate_groups(load(spark, sf, "photos"))


@query("p3_duplicate_members", "photos", GROUPS + " SELECT p.content_hash, p.path, p.path = g.keeper AS keep FROM photos p JOIN g ON g.content_hash = p.content_hash")
def _(spark, sf):
    return identity.duplicate_members(load(spark, sf, "photos"))


PROVENANCE = """, prov AS (SELECT *, CASE WHEN coalesce(save_mode, CASE WHEN payload_mode = 'copy' THEN 'copy' END) = 'copy' THEN 'copy' WHEN save_mode = 'overwrite' THEN 'in place'
   WHEN has_record AND has_original THEN 'in place' WHEN has_record OR has_payload OR has_marker THEN 'unknown' ELSE 'not ours' END AS provenance FROM analysis)"""


@query("p4_classify_provenance", "analysis", PROVENANCE + " SELECT photo_id, provenance FROM prov")
def _(spark, sf):
    return identity.classify_provenance(load(spark, sf, "analysis")).select("photo_id", "provenance")


@query(
    "p5_outputs_of",
    "outputs sources",
    """, o AS (SELECT * FROM outputs WHERE source_key IS NULL OR source_key <> substr(sha256(lower(path)), 1, 24)),
 k AS (SELECT o.output_no, s.photo_id FROM o JOIN sources s ON o.source_key = substr(sha256(lower(s.path)), 1, 24)),
 h AS (SELECT DISTINCT o.output_no, s.photo_id FROM o JOIN sources s ON o.photo_hash = s.whole_hash OR o.photo_hash = s.crop_hash
   WHERE o.save_mode <> 'overwrite' AND NOT o.has_original AND o.output_no NOT IN (SELECT output_no FROM k))
 SELECT output_no, photo_id, 'key' AS matched_by FROM k UNION ALL SELECT output_no, photo_id, 'hash' FROM h""",
)
def _(spark, sf):
    return identity.outputs_of(load(spark, sf, "outputs"), load(spark, sf, "sources"))


@query(
    "p6_backup_versions",
    "backups",
    """SELECT photo_id, count(*) AS backups, arg_min(backup_no, version * 100000000 + backup_no) AS oldest, arg_max(backup_no, version * 100000000 + backup_no) AS newest
 FROM (SELECT photo_id, backup_no, CASE WHEN backup_no % 4 = 0 THEN 1 ELSE 1 + backup_no % 4 END AS version FROM backups) AS b GROUP BY photo_id""",
)
def _(spark, sf):
    return identity.backup_versions(load(spark, sf, "backups"))


# the record of each captioned photo: the original it had
RECORDS = ", rec AS (SELECT photo_id, size_bytes, content_hash, photo_id % 4 = 0 AS captioned FROM photos WHERE format <> 'PNG')"
FOUND = RECORDS + """, found AS (SELECT r.photo_id, r.captioned, arg_max(b.backup_no, b.version * 100000000 + b.backup_no) AS backup_no, max(b.version) AS version
   FROM rec r JOIN backups b ON b.photo_id = r.photo_id AND b.size_bytes = r.size_bytes AND b.content_hash = r.content_hash GROUP BY r.photo_id, r.captioned)"""


def _records(spark, sf):
    return load(spark, sf, "photos").where("format <> 'PNG'").select(
        "photo_id", "size_bytes", "content_hash", (F.col("photo_id") % 4 == 0).alias("captioned")
    )


@query("p7_find_original_backup", "photos backups", FOUND + " SELECT photo_id, backup_no, version FROM found WHERE NOT captioned")
def _(spark, sf):
    return identity.find_original_backup(_records(spark, sf), load(spark, sf, "backups"))


@query(
    "p8_plan_backup",
    "photos backups",
    FOUND
    + """, cur AS (SELECT p.photo_id, arg_max(b.backup_no, b.version * 100000000 + b.backup_no) AS backup_no FROM photos p JOIN backups b ON b.photo_id = p.photo_id
     AND b.size_bytes = p.size_bytes AND b.content_hash = p.content_hash GROUP BY p.photo_id),
 free AS (SELECT photo_id, min(n) AS n FROM (SELECT photo_id, unnest(range(1, 7)) AS n FROM photos) AS c
   WHERE NOT EXISTS (SELECT 1 FROM backups b WHERE b.photo_id = c.photo_id AND b.version = c.n) GROUP BY photo_id)
 SELECT p.photo_id, coalesce(f.backup_no, c.backup_no) AS reuse_no, f.backup_no IS NOT NULL AND NOT coalesce(f.captioned, false) AS is_original,
   CASE WHEN f.backup_no IS NULL AND c.backup_no IS NULL THEN free.n END AS next_version
 FROM photos p LEFT JOIN found f ON f.photo_id = p.photo_id LEFT JOIN cur c ON c.photo_id = p.photo_id LEFT JOIN free ON free.photo_id = p.photo_id""",
)
def _(spark, sf):
    return identity.plan_backup(load(spark, sf, "photos"), _records(spark, sf), load(spark, sf, "backups"))


@query(
    "p9_verify_output",
    "outputs pixel_checks",
    """SELECT c.output_no, c.orientation, CASE WHEN c.orientation >= 5 THEN c.width = o.canvas_h AND c.height = o.canvas_w ELSE c.width = o.canvas_w AND c.height = o.canvas_h END
   AND (c.pixel_hash = o.output_hash OR coalesce(c.pixel_hash = o.photo_hash, false)) AS ok FROM pixel_checks c JOIN outputs o ON o.output_no = c.output_no""",
)
def _(spark, sf):
    return identity.verify_output(load(spark, sf, "outputs"), load(spark, sf, "pixel_checks"))


@query(
    "p10_lossy_similarity",
    "",
    """, d AS (SELECT vec_id, list_transform(embedding, lambda x: (cast(x AS double) - round(cast(x AS double), 1)) * 127.5) AS d FROM embeddings),
 m AS (SELECT vec_id, list_avg(list_transform(d, lambda x: abs(x))) AS mad, list_avg(list_transform(d, lambda x: x * x)) AS mse FROM d)
 SELECT vec_id, round(mad, 6) AS mad, round(10 * log10(65025.0 / mse), 6) AS psnr, mad < 6 AND 10 * log10(65025.0 / mse) > 28 AS same_picture FROM m""",
)
def _(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("reference", F.col("embedding").cast("array<double>"))
    e = e.withColumn("written", F.transform("reference", lambda x: F.round(x, 1)))
    s = identity.lossy_similarity(e, "reference", "written", 2.0)
    return s.select("vec_id", F.round("mad", 6).alias("mad"), F.round("psnr", 6).alias("psnr"), "same_picture")


def _version(spark, sf, name):
    k = F.col("file_no")
    later = name == "scan_after"
    return load(spark, sf, name).select(
        "path", "size_bytes", "mtime_ns", "file_id", (3000 + (k % 7 if later else k % 7)).alias("width"), F.lit(2000).alias("height"),
        (1 + (F.when(k % 6 == 0, k % 8) .otherwise(k % 5) if later else k % 5)).alias("orientation"), F.lit(None).cast("string").alias("profile"), "file_no",
    )


RESULTS = """, res AS (SELECT path, size_bytes, mtime_ns, file_id, CASE WHEN file_no % 4 = 0 THEN 6 ELSE 7 END AS version, file_no % 3 = 0 AS ocr, 'result ' || file_no AS result FROM scan_before)"""


def _results(spark, sf):
    n = F.col("file_no")
    return load(spark, sf, "scan_before").select(
        "path", "size_bytes", "mtime_ns", "file_id", F.when(n % 4 == 0, 6).otherwise(7).alias("version"), (n % 3 == 0).alias("ocr"),
        F.concat(F.lit("result "), n.cast("string")).alias("result"),
    )


@query(
    "p11_carry_results_forward",
    "scan_before scan_after",
    RESULTS
    + """ SELECT r.path, a.size_bytes, a.mtime_ns, a.file_id, r.result FROM res r JOIN scan_before b ON b.path = r.path JOIN scan_after a ON a.path = r.path
 WHERE 1 + b.file_no % 5 = 1 + CASE WHEN a.file_no % 6 = 0 THEN a.file_no % 8 ELSE a.file_no % 5 END AND a.file_no % 7 = b.file_no % 7""",
)
def _(spark, sf):
    r = identity.carry_results_forward(_results(spark, sf), _version(spark, sf, "scan_before"), _version(spark, sf, "scan_after"))
    return r.select("path", "size_bytes", "mtime_ns", "file_id", "result")


@query(
    "p12_incremental_analysis",
    "scan_before scan_after",
    RESULTS
    + """, u AS (SELECT a.path, r.result AS stored FROM scan_after a LEFT JOIN res r ON r.path = a.path AND r.size_bytes = a.size_bytes AND r.mtime_ns = a.mtime_ns
     AND r.file_id = a.file_id AND r.version = 7 AND r.ocr) SELECT path, coalesce(stored, 'analyzed') AS result FROM u""",
)
def _(spark, sf):
    def analyze(rows):
        return rows.withColumns({"version": F.lit(7), "ocr": F.lit(True), "result": F.lit("analyzed")})

    return identity.incremental_analysis(load(spark, sf, "scan_after"), _results(spark, sf), 7, True, analyze).select("path", "result")
