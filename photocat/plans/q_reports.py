"""Registered reports and file queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from photocat.functions import text
from photocat.operators import normalize, reports
from photocat.plans import date_sql as ds
from photocat.plans.q_batches import ENTRIES, PLAN, _entries, _plan
from photocat.plans.q_metadata import CERTAINTY, FIELDS, KEYWORDS, MARKER
from photocat.plans.registry import query
from photocat.plans.views import load
from photocat.session import work_dir
from photocat.sources import files

AS_OF = ds.AS_OF
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(c):
    return F.date_format(c, STAMP)


def sql_stamp(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query(
    "r1_natural_sort",
    "",
    """SELECT p_partkey AS photo_id, array_to_string(list_transform(regexp_extract_all(lower(p_name || ' ' || p_partkey), '\\d+|[^\\d]+'),
   lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN '0' || lpad(cast(length(regexp_replace(r, '^0*(\\d+)$', '\\1')) AS varchar), 4, '0') || regexp_replace(r, '^0*(\\d+)$', '\\1') ELSE '1' || r END), '|') AS sort_key FROM part""",
)
def _(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("photo_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    return reports.natural_sort(p, "name").select("photo_id", F.array_join(text.natural_key(F.col("name")), "|").alias("sort_key"))


@query(
    "r2_recent_log",
    "log_rows",
    f"SELECT seq, {sql_stamp('time')} AS time, ok, source, notes, ms FROM log_rows",
)
def _(spark, sf):
    log = reports.recent_log(load(spark, sf, "log_rows"))
    return log.select("seq", stamp("time").alias("time"), "ok", "source", "notes", "ms")


@query(
    "r3_status_by_folder",
    "analysis",
    PLAN
    + """, f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, status FROM plan)
 SELECT folder, status, count(*) AS photos, cast(grouping(folder, status) AS bigint) AS level FROM f GROUP BY ROLLUP (folder, status)""",
)
def _(spark, sf):
    return reports.status_by_folder(_plan(spark, sf))


@query(
    "r4_keyword_facets",
    "tags",
    KEYWORDS
    + f""" SELECT keyword_key, count(*) AS photos, arg_min(keyword, row(photo_id, src_rank, item)) AS keyword FROM keywords WHERE NOT {MARKER} GROUP BY keyword_key""",
)
def _(spark, sf):
    return reports.keyword_facets(load(spark, sf, "tags"))


@query(
    "r5_people_index",
    "regions",
    f""", u AS (SELECT o_custkey AS photo_id, max(o_orderdate) AS used_at FROM orders GROUP BY o_custkey),
 n AS (SELECT photo_id, lower(trim(name)) AS person, min(region_no) AS region_no, arg_min(name, region_no) AS name FROM regions WHERE trim(name) <> '' GROUP BY photo_id, lower(trim(name)))
 SELECT person, count(*) AS photos, arg_min(name, n.photo_id) AS name, {sql_stamp('max(used_at)')} AS last_used FROM n LEFT JOIN u ON u.photo_id = n.photo_id GROUP BY person""",
)
def _(spark, sf):
    used = load(spark, sf, "orders").select(F.col("o_custkey").alias("photo_id"), F.col("o_orderdate").alias("used_at"))
    return reports.people_index(load(spark, sf, "regions"), used).withColumn("last_used", stamp("last_used"))


@query(
    "r6_neighbours",
    "regions",
    """, o AS (SELECT photo_id, lower(trim(name)) AS a, lead(lower(trim(name))) OVER (PARTITION BY photo_id ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, x + w / 2, y + h / 2, region_no) AS b
   FROM regions WHERE name <> '') SELECT least(a, b) AS person_1, greatest(a, b) AS person_2, count(*) AS times FROM o WHERE a <> b GROUP BY 1, 2""",
)
def _(spark, sf):
    return reports.neighbours(load(spark, sf, "regions"))


@query(
    "r7_photos_by_period",
    "tags",
    CERTAINTY
    + ", alld AS (SELECT p.photo_id, f.value, c.certainty FROM (SELECT DISTINCT photo_id FROM first) p LEFT JOIN first f ON f.photo_id = p.photo_id AND f.field = 'date' LEFT JOIN certain c ON c.photo_id = p.photo_id), "
    + ds.parsed("q", "alld", "photo_id, value, certainty", "value")
    + ", "
    + ds.cut("c2", "q", "photo_id", "certainty")
    + """, d AS (SELECT CASE WHEN known AND NOT no_year THEN y // 10 * 10 END AS decade, CASE WHEN known AND NOT no_year THEN y END AS year, CASE WHEN known AND NOT no_year THEN m END AS month, known AND (gy OR gm OR gd OR no_year) AS guessed FROM c2)
 SELECT cast(decade AS bigint) AS decade, cast(year AS bigint) AS year, cast(month AS bigint) AS month, guessed, count(*) AS photos, cast(grouping(decade, year, month, guessed) AS bigint) AS level
 FROM d GROUP BY GROUPING SETS ((), (decade), (decade, year), (decade, year, month), (guessed), (decade, guessed), (decade, year, guessed), (decade, year, month, guessed))""",
)
def _(spark, sf):
    tags = load(spark, sf, "tags")
    return reports.photos_by_period(normalize.normalize_fields(tags), normalize.date_certainty(tags, AS_OF), AS_OF)


@query(
    "r8_source_coverage",
    "tags",
    FIELDS
    + """, p AS (SELECT DISTINCT photo_id FROM first), fl AS (SELECT unnest(['title', 'caption', 'notes', 'creator', 'sublocation', 'city', 'state', 'country', 'date', 'digitized']) AS field),
 g AS (SELECT fl.field, coalesce(f.tag, 'none') AS tag, count(*) AS photos FROM p CROSS JOIN fl LEFT JOIN first f ON f.photo_id = p.photo_id AND f.field = fl.field GROUP BY 1, 2)
 SELECT field, tag, photos, round(photos / sum(photos) OVER (PARTITION BY field), 6) AS share FROM g""",
)
def _(spark, sf):
    return reports.source_coverage(normalize.normalize_fields(load(spark, sf, "tags")))


@query(
    "r9_restorable_space",
    "backups",
    """SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS backups, cast(sum(size_bytes) AS bigint) AS bytes,
   min(CASE WHEN backup_no % 4 = 0 THEN 1 ELSE 1 + backup_no % 4 END) AS first_version, max(CASE WHEN backup_no % 4 = 0 THEN 1 ELSE 1 + backup_no % 4 END) AS last_version FROM backups GROUP BY 1""",
)
def _(spark, sf):
    return reports.restorable_space(load(spark, sf, "backups"))


@query(
    "r10_inventory_diff",
    "scan_before scan_after",
    """, c AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
     WHEN a.size_bytes = b.size_bytes AND a.mtime_ns = b.mtime_ns AND a.file_id = b.file_id THEN 'unchanged' WHEN a.size_bytes = b.size_bytes AND a.content_hash = b.content_hash THEN 'touched' ELSE 'changed' END AS change
   FROM scan_before b FULL JOIN scan_after a ON a.path = b.path),
 g AS (SELECT b.content_hash, min(b.path) AS from_path FROM c JOIN scan_before b ON b.path = c.path WHERE change = 'removed' GROUP BY b.content_hash)
 SELECT c.path, CASE WHEN g.from_path IS NOT NULL THEN 'moved' ELSE change END AS change, g.from_path FROM c LEFT JOIN scan_after a ON a.path = c.path AND c.change = 'added'
   LEFT JOIN g ON g.content_hash = a.content_hash""",
)
def _(spark, sf):
    return reports.inventory_diff(load(spark, sf, "scan_before"), load(spark, sf, "scan_after"))


@query(
    "r10_inventory_counts",
    "scan_before scan_after",
    """, a AS (SELECT path, size_bytes FROM scan_before), b AS (SELECT path, size_bytes FROM scan_after)
 SELECT 'kept' AS part, count(*) AS files FROM (SELECT * FROM a INTERSECT SELECT * FROM b) AS x UNION ALL SELECT 'only before', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) AS y
 UNION ALL SELECT 'only now', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) AS z""",
)
def _(spark, sf):
    return reports.inventory_counts(load(spark, sf, "scan_before"), load(spark, sf, "scan_after"))


# -- files ---------------------------------------------------------------------------------------------


@query("s1_scan_inventory", "photos", "SELECT 'format=' || format AS folder, sum(strlen(path) + 1)::BIGINT AS size_bytes, true AS named, true AS fresh FROM photos GROUP BY format")
def _(spark, sf):
    # a file per format, with the paths of its photos as lines, then listed as files
    out, began = work_dir(spark) + "/archive", datetime.now()
    load(spark, sf, "photos").select("format", "path").repartition("format").write.partitionBy("format").text(out)
    found = files.scan_inventory(spark, out, recursive=True, extensions=[".txt"])
    named = F.col("path").endswith(F.col("name")) & F.col("name").rlike(r"^format=[A-Z]+/part-[^/]*[.]txt$")
    fresh = F.col("mtime") >= F.lit(began.replace(microsecond=0)) - F.expr("INTERVAL 2 SECONDS")
    return found.select(F.substring_index("name", "/", 1).alias("folder"), "size_bytes", named.alias("named"), fresh.alias("fresh"))


@query(
    "s2_skip_managed_paths",
    "photos",
    """SELECT photo_id, path FROM photos WHERE path NOT LIKE '%/_originals/%' AND path NOT LIKE '%/.cache/%' AND path NOT LIKE '/archive/box03/%' AND path NOT LIKE '/archive/box07/%'""",
)
def _(spark, sf):
    photos = load(spark, sf, "photos").select("photo_id", "path")
    marked = photos.where("path LIKE '/archive/box07/%'").select(F.lit("/archive/box07/.backups-here").alias("path")).distinct()
    return files.skip_managed_paths(photos, {"subfolderName": "Captioned", "fixedFolder": "/archive/box03"}, marked)


@query(
    "s3_dedup_requested_paths",
    "photos backups",
    """, r AS (SELECT path, photo_id AS request_no, 'photo' AS name FROM photos UNION ALL SELECT path, backup_no, 'backup' FROM backups UNION ALL SELECT path, photo_id + 5, 'again' FROM photos)
 SELECT path, min(request_no) AS request_no, arg_min(name, row(request_no, name)) AS name FROM r GROUP BY path""",
)
def _(spark, sf):
    p, b = load(spark, sf, "photos"), load(spark, sf, "backups")
    r = p.select("path", F.col("photo_id").alias("request_no"), F.lit("photo").alias("name"))
    r = r.unionByName(b.select("path", F.col("backup_no").alias("request_no"), F.lit("backup").alias("name")))
    return files.dedup_requested_paths(r.unionByName(p.select("path", (F.col("photo_id") + 5).alias("request_no"), F.lit("again").alias("name"))))


@query(
    "s4_read_tag_dump",
    "",
    """SELECT c_custkey AS photo_id, 'XMP-dc:Title' AS tag, 0 AS item, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'IFD0:Rating', 0, '1.50' FROM customer
 UNION ALL SELECT c_custkey, 'XMP-dc:Subject', 0, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'XMP-dc:Subject', 1, '7.0' FROM customer
 UNION ALL SELECT c_custkey, 'XMP-mwg-rs:RegionInfo', 0, '{"W":"10.50"}' FROM customer""",
)
def _(spark, sf):
    c = load(spark, sf, "customer")
    doc = F.concat(
        F.lit('{"XMP-dc:Title": "'), "c_name", F.lit('", "IFD0:Rating": 1.50, "XMP-dc:Subject": ["'), "c_mktsegment",
        F.lit('", 7.0], "XMP-mwg-rs:RegionInfo": {"W": 10.50}}'),
    )
    return files.tags_of(c.select(F.col("c_custkey").alias("photo_id"), doc.alias("doc")))


@query(
    "s5_tag_listing",
    "tags",
    "SELECT photo_id, tag, item, value FROM tags WHERE value IS NOT NULL AND tag NOT LIKE 'File:%'",
)
def _(spark, sf):
    return files.tag_listing(load(spark, sf, "tags"))


@query(
    "s5_tag_listing_whole",
    "tags",
    "SELECT photo_id, tag, item, value FROM tags WHERE value IS NOT NULL AND tag NOT LIKE 'File:%'",
)
def _(spark, sf):
    return files.tag_listing(load(spark, sf, "tags"))


@query("s6_read_job_log", "log_rows", f"SELECT seq, {sql_stamp('time')} AS time, source, notes, ms FROM log_rows WHERE ok")
def _(spark, sf):
    # log files whose lines for failed jobs break off
    out, log = work_dir(spark) + "/log", load(spark, sf, "log_rows")
    line = F.when(F.col("ok"), F.to_json(F.struct("seq", "time", "ok", "source", "notes", "ms"))).otherwise(F.concat(F.lit('{"seq": '), "seq", F.lit(', "time"')))
    log.select(line).write.text(out)
    return files.read_job_log(spark, out).select("seq", stamp("time").alias("time"), "source", "notes", "ms")


@query("s7_write_job_log", "log_rows", f"SELECT seq, {sql_stamp('time')} AS time, ok, source, notes, ms, true AS fits FROM log_rows")
def _(spark, sf):
    # small rolls, in two appends; what is read back tells whether its roll stayed within its size and one record
    out, log = work_dir(spark) + "/log", load(spark, sf, "log_rows")
    for half in (0, 1):
        files.write_job_log(log.where(F.col("seq") % 2 == half), out, 20_000)
    fits = files.log_rolls(spark, out).agg((F.max("bytes") < 20_000 + 300).alias("fits"))
    read = files.read_job_log(spark, out).select("seq", stamp("time").alias("time"), "ok", "source", "notes", "ms")
    return read.withColumn("fits", F.lit(fits.first()[0]))


@query(
    "s8_export_report_csv",
    "log_rows",
    """SELECT seq, source, CASE WHEN regexp_matches(notes, '^[=+@-]') THEN '''' || notes ELSE notes END AS notes,
   CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN '' ELSE 'say "' || notes || '",' || chr(10) || 'and more' END AS cell, ms FROM log_rows""",
)
def _(spark, sf):
    rows = load(spark, sf, "log_rows")
    cell = F.when(F.col("seq") % 3 == 0, None).when(F.col("seq") % 3 == 1, "").otherwise(F.concat(F.lit('say "'), "notes", F.lit('",\nand more')))
    report, out = rows.select("seq", "source", "notes", cell.alias("cell"), "ms"), work_dir(spark) + "/report"
    files.export_report_csv(report, out)
    return files.read_report_csv(spark, out, report.schema)


@query(
    "s9_read_drafts",
    "drafts",
    """SELECT path, size_bytes AS size, cast(mtime_ns AS varchar) AS mtime_ns, quick_hash AS hash, '{"n":' || draft_no || '}' AS state, epoch(updated)::DOUBLE AS updated FROM drafts""",
)
def _(spark, sf):
    d, out = load(spark, sf, "drafts"), work_dir(spark) + "/drafts"
    stat = F.struct(F.col("size_bytes").alias("size"), F.col("mtime_ns").cast("string").alias("mtime_ns"))
    ident = F.struct(F.col("size_bytes").alias("size"), F.col("quick_hash").alias("hash"))
    state, updated = F.struct(F.col("draft_no").alias("n")), F.unix_timestamp(F.col("updated").cast("timestamp")).cast("double")
    d.select("path", stat.alias("stat"), ident.alias("ident"), state.alias("state"), updated.alias("updated")).write.json(out)
    return files.read_drafts(spark, out).select("path", "stat.size", "stat.mtime_ns", "ident.hash", "state", "updated")
