"""Catalogue-shaped views over the test tables.

Every view is one SQL text that both engines run on the whole base tables. In Spark the table
placeholders become parquet scans; in the oracle they are the registered tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

# tags each customer row gives: tag, value expression (NULL or blank where the photo has none)
CUSTOMER_TAGS = [
    ("XMP-dc:Title", """CASE WHEN c_custkey % 3 = 0 THEN c_name END"""),
    ("XMP-dc:Title-de", """CASE WHEN c_custkey % 4 = 1 THEN 'Bild ' || c_name END"""),
    ("IPTC:ObjectName", """CASE WHEN c_custkey % 2 = 0 THEN 'Object ' || cast(c_custkey AS string) END"""),
    ("XMP-photoshop:Headline", """CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END"""),
    ("IFD0:ImageDescription", """CASE WHEN c_custkey % 3 = 0 THEN '{"shape": [' || cast(c_custkey AS string) || ', 90, 3]}' ELSE 'Print ' || c_mktsegment END"""),
    ("IFD0:XPComment", """'Comment ' || cast(c_nationkey AS string)"""),
    ("ExifIFD:UserComment", """CASE WHEN c_custkey % 4 <> 3 THEN ' Notes on ' || c_name || ' in the ' || c_mktsegment || ' box ' END"""),
    ("XMP-iptcCore:Location", """CASE WHEN c_custkey % 6 = 0 THEN 'Dock ' || c_nationkey END"""),
    ("XMP-photoshop:City", """CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END"""),
    ("IPTC:City", """'City ' || cast(c_nationkey AS string)"""),
    ("IPTC:CodedCharacterSet", """CASE WHEN c_custkey % 2 = 0 THEN 'UTF8' END"""),
    ("File:FileSize", """cast(c_custkey AS string)"""),
    ("XMP-photoshop:DateCreated", """CASE WHEN c_custkey % 7 <> 0 THEN CASE c_custkey % 12 WHEN 0 THEN y || ':' || m || ':' || d || ' 00:00:00' WHEN 1 THEN y || '-' || m WHEN 2 THEN y WHEN 3 THEN substr(y, 1, 3) || '0s' WHEN 4 THEN 'circa ' || y WHEN 5 THEN m || '/' || d || '/' || y WHEN 6 THEN mon || '. ' || d || ', ' || y WHEN 7 THEN d || ' ' || mon || ' ' || y WHEN 8 THEN y || ':' || m || ':00 00:00:00' WHEN 9 THEN '0000:00:00 00:00:00' WHEN 10 THEN 'Summer ' || y ELSE y || m || d END END"""),
    ("ExifIFD:DateTimeOriginal", """CASE WHEN c_custkey % 3 <> 1 THEN cast(1900 + c_custkey % 120 AS string) || ':' || lpad(cast(1 + c_custkey % 12 AS string), 2, '0') || ':' || lpad(cast(1 + c_custkey % 28 AS string), 2, '0') || CASE WHEN c_custkey % 5 = 2 THEN ' 17:01:07' ELSE ' 00:00:00' END END"""),
]
# tags each order row gives: tag expression, value expression
ORDER_TAGS = [
    ("""CASE WHEN o_orderkey % 3 = 0 THEN 'IPTC:Keywords' ELSE 'XMP-dc:Subject' END""", """CASE o_orderkey % 8 WHEN 0 THEN 'DATE: Y!M~' WHEN 1 THEN 'Vision Analyzed' WHEN 2 THEN 'back' WHEN 3 THEN 'Scan 2024' WHEN 4 THEN 'Scandinavia' WHEN 5 THEN upper(o_orderpriority) ELSE o_orderpriority END"""),
    ("""CASE WHEN o_custkey % 5 = 0 THEN 'IPTC:By-line' ELSE 'XMP-dc:Creator' END""", """CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Smith, John' ELSE 'John Smith' END WHEN 1 THEN ' ' ELSE 'Clerk ' || cast(o_orderkey % 10 AS string) END"""),
]
_CUSTOMER_PARTS = """(SELECT *, cast(1900 + c_custkey % 120 AS string) AS y, lpad(cast(1 + c_custkey % 12 AS string), 2, '0') AS m,
  lpad(cast(1 + c_custkey % 28 AS string), 2, '0') AS d,
  substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (c_custkey % 12) AS int), 3) AS mon FROM {customer}) AS b"""


def _tags_spark() -> str:
    """The tag dump from one scan of each table."""
    entry = "struct({0} AS tag, cast({1} AS bigint) AS item, {2} AS value)"
    c = ", ".join(entry.format(f"'{tag}'", 0, v) for tag, v in CUSTOMER_TAGS)
    o = ", ".join(entry.format(tag, "o_orderkey", v) for tag, v in ORDER_TAGS)
    return (
        f"SELECT c_custkey AS photo_id, inline(array({c})) FROM {_CUSTOMER_PARTS}"
        f" UNION ALL SELECT o_custkey, inline(array({o})) FROM {{orders}}"
    )


def _tags_duckdb() -> str:
    parts = [f"SELECT c_custkey AS photo_id, '{tag}' AS tag, cast(0 AS bigint) AS item, {v} AS value FROM {_CUSTOMER_PARTS}" for tag, v in CUSTOMER_TAGS]
    parts += [f"SELECT o_custkey, {tag}, o_orderkey, {v} FROM {{orders}}" for tag, v in ORDER_TAGS]
    return " UNION ALL ".join(parts)


VIEWS = {
    # metadata dump, one row per tag value
    "tags_spark": _tags_spark(),
    "tags_duckdb": _tags_duckdb(),
    # file inventory: repeated contents, an unsupported format, managed folders, several pages
    "photos": """
SELECT c_custkey AS photo_id,
       '/archive/box' || lpad(cast(c_nationkey AS string), 2, '0')
         || CASE WHEN c_custkey % 17 = 0 THEN '/_originals' WHEN c_custkey % 19 = 0 THEN '/.cache' ELSE '' END
         || '/IMG_' || lpad(cast(c_custkey AS string), 6, '0')
         || CASE c_custkey % 6 WHEN 0 THEN '.TIF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png'
                               WHEN 3 THEN '.tiff' WHEN 4 THEN '.JPEG' ELSE '.heic' END AS path,
       CASE c_custkey % 6 WHEN 0 THEN 'TIFF' WHEN 3 THEN 'TIFF' WHEN 2 THEN 'PNG' WHEN 5 THEN 'HEIC'
                          ELSE 'JPEG' END AS format,
       cast(3000 + c_custkey % 7 * 100 AS bigint) AS width,
       cast(2000 + c_custkey % 5 * 100 AS bigint) AS height,
       cast(1 + c_custkey % 8 AS bigint) AS orientation,
       cast(1 + CASE WHEN c_custkey % 23 = 0 THEN 2 ELSE 0 END AS bigint) AS pages,
       cast(1000000 + c_custkey % 60 AS bigint) AS size_bytes,
       cast(1700000000000000000 + c_custkey * 1000 AS bigint) AS mtime_ns,
       cast(c_custkey * 7 AS bigint) AS file_id,
       'h' || lpad(cast(c_custkey % 60 AS string), 5, '0') AS content_hash
FROM {customer}""",
    # dates as people and programs write them
    "date_texts": """
SELECT k AS text_no, CASE k % 26
    WHEN 0 THEN y || ':' || m || ':' || d || ' 00:00:00'    WHEN 1 THEN y || '-' || m || '-' || d || 'T10:30:00+02:00'
    WHEN 2 THEN y || '/' || m || '/' || d                   WHEN 3 THEN y || m || d
    WHEN 4 THEN mon || ' ' || d || ', ' || y                WHEN 5 THEN d || '-' || mon || '-' || y
    WHEN 6 THEN d || 'th of ' || mon || 'e, ' || y          WHEN 7 THEN wd || ', ' || mon || '. ' || d || ', ' || y
    WHEN 8 THEN m || '/' || d || '/' || y                   WHEN 9 THEN d || '.' || m || '.' || y
    WHEN 10 THEN m || '-' || d || '-' || y                  WHEN 11 THEN m || '/' || y
    WHEN 12 THEN mon || ' ' || y                            WHEN 13 THEN substr(y, 1, 3) || '0s'
    WHEN 14 THEN 'circa  ' || y                             WHEN 15 THEN 'Summer ' || y
    WHEN 16 THEN 'early ' || mon || ' of ' || y             WHEN 17 THEN y || ':' || m || ':00 00:00:00'
    WHEN 18 THEN y || ':00:00'                              WHEN 19 THEN '0000:00:00 00:00:00'
    WHEN 20 THEN 'unknown'                                  WHEN 21 THEN y || '-' || m || '-' || d || ' 12:34 nonsense'
    WHEN 22 THEN y || '-' || m || '-' || d || ' 12:34 p.m.' WHEN 23 THEN m || '/' || d || '/' || y || ' 10:00'
    WHEN 24 THEN y || '?'                                   ELSE NULL END AS value,
  CASE k % 9 WHEN 0 THEN 'Y!M!D!' WHEN 1 THEN 'Y!M~' WHEN 2 THEN 'Y~' WHEN 3 THEN 'Y?M!D!' WHEN 4 THEN 'Y!M!D?'
             WHEN 5 THEN 'Y?' WHEN 6 THEN 'Y~M!D!' WHEN 7 THEN 'Y!D!' ELSE NULL END AS pattern,
  CASE k % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS level, k % 5 = 0 AS estimate
FROM (SELECT o_orderkey AS k, cast(1900 + o_orderkey % 130 AS string) AS y,
             lpad(cast(1 + o_orderkey % 13 AS string), 2, '0') AS m, lpad(cast(1 + o_orderkey % 31 AS string), 2, '0') AS d,
             substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (o_orderkey % 12) AS int), 3) AS mon,
             substr('MonTueWedThuFriSatSun', cast(1 + 3 * (o_orderkey % 7) AS int), 3) AS wd FROM {orders}) AS b""",
    # one face region per order
    "regions": """
SELECT o_custkey AS photo_id, o_orderkey AS region_no,
       CASE WHEN o_orderkey % 4 = 0 THEN 'MP' ELSE 'MWG' END AS source,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Person ' || cast(o_orderkey % 9 AS string) END AS name,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey % 9 * 100 + o_orderkey % 7 AS double) / 1000 END AS x,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey % 3 * 300 + o_orderkey % 20 AS double) / 1000 END AS y,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(40 + o_orderkey % 30 AS double) / 1000 END AS w,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(50 + o_orderkey % 40 AS double) / 1000 END AS h
FROM {orders}""",
    # people listed without a region
    "listed": """
SELECT o_custkey AS photo_id, o_orderkey AS item,
       CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN 'PERSON ' || cast(o_orderkey % 9 AS string)
            ELSE 'Guest ' || cast(o_orderkey % 5 AS string) END AS name
FROM {orders}""",
    # hierarchical keyword paths
    "paths": """
SELECT o_custkey AS photo_id, o_orderkey AS item,
       CASE o_orderkey % 5 WHEN 0 THEN 'People|Person ' || cast(o_orderkey % 9 AS string)
            WHEN 1 THEN 'Media|Scan|' || o_orderpriority WHEN 2 THEN 'Scan|Scandinavia'
            WHEN 3 THEN 'Dates|DATE: Y!M~' ELSE 'Places|' || o_orderpriority END AS path
FROM {orders}""",
    # edits of text fields and dates; NULL clears
    "edits": """
SELECT o_custkey AS photo_id, o_orderkey AS edit_seq, o_orderdate AS edited_at,
       CASE o_orderkey % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'city' WHEN 2 THEN 'notes' WHEN 3 THEN 'date'
            WHEN 4 THEN 'creator' ELSE 'caption' END AS field,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 6 = 3 THEN '1952-06'
            WHEN o_orderkey % 9 = 4 THEN 'base64:' || cast(o_orderkey AS string)
            WHEN o_orderkey % 9 = 5 THEN 'line one' || chr(10) || 'line two ' || cast(o_orderkey AS string)
            WHEN o_orderkey % 9 = 6 THEN 'bell' || chr(7) || cast(o_orderkey AS string)
            ELSE 'edit  ' || cast(o_orderkey AS string) END AS value
FROM {orders}""",
    # edited keyword lists, one row per keyword
    "typed_edits": """
SELECT c_custkey AS photo_id, 'creator' AS field, CASE c_custkey % 7 WHEN 0 THEN '["Smith, John","Jones, Mary","Lee, Ann"]' WHEN 1 THEN '["ACME; Inc."," Jane "," "]'
  WHEN 2 THEN '"One, Name"' WHEN 3 THEN '[]' WHEN 4 THEN '["a' || chr(92) || 'nb"]' WHEN 5 THEN 'null' ELSE '["a",3]' END AS value, cast(1 AS bigint) AS edited_at, 4 * c_custkey AS edit_seq FROM {customer}
UNION ALL SELECT c_custkey, 'date', CASE c_custkey % 8 WHEN 0 THEN '{"iso":"1952-06","level":"month"}' WHEN 1 THEN '{"iso":" 1952","level":"circa"}' WHEN 2 THEN '{"iso":"1952-06-14","level":"day","estimate":true}'
  WHEN 3 THEN '{"iso":"1952","level":"day"}' WHEN 4 THEN 'null' WHEN 5 THEN '{"iso":"1952-13","level":"month"}' WHEN 6 THEN '{"iso":"1960-05-06","level":"day","pattern":"y!m!d~"}' ELSE '{"level":"month"}' END, 1, 4 * c_custkey + 1
  FROM {customer} WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'title', '" Title ' || c_custkey || '"', 2, 4 * c_custkey + 2 FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'title', '"old"', 1, 4 * c_custkey + 3 FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'keywords', '["Sea","sea"," ","Boat "]', 1, 4 * c_custkey FROM {customer} WHERE c_custkey % 5 = 0""",
    "keyword_edits": """
SELECT o_custkey AS photo_id, o_orderkey AS item, o_custkey % 2 = 0 AS edited,
       CASE o_orderkey % 4 WHEN 0 THEN 'Family' WHEN 1 THEN 'family' WHEN 2 THEN o_orderpriority
            ELSE 'DATE: Y!' END AS keyword
FROM {orders}""",
    # face edits keyed by region number; a negative key is a new face
    "face_edits": """
SELECT o_custkey AS photo_id, o_orderkey AS edit_no,
       CASE WHEN o_orderkey % 13 = 0 THEN 'new:' || cast(o_orderkey AS string)
            ELSE cast(o_orderkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS string) END AS face_key,
       o_orderkey % 3 <> 0 AS has_name,
       CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Renamed ' || cast(o_orderkey % 12 AS string) END END AS name,
       o_orderkey % 4 = 0 AS has_box,
       CASE WHEN o_orderkey % 4 = 0 THEN cast(o_orderkey % 70 AS double) / 100 END AS x,
       CASE WHEN o_orderkey % 4 = 0 THEN cast(o_orderkey % 60 AS double) / 100 END AS y,
       CASE WHEN o_orderkey % 4 = 0 THEN cast(0.05 AS double) END AS w,
       CASE WHEN o_orderkey % 4 = 0 THEN cast(0.06 AS double) END AS h,
       o_orderkey % 10 = 0 AS deleted,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Person ' || cast((o_orderkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) % 9 AS string) END AS was_name,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey % 9 * 100 + o_orderkey % 7 + CASE WHEN o_orderkey % 23 = 0 THEN 60 ELSE 2 END AS double) / 1000 END AS was_x,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey % 3 * 300 + o_orderkey % 20 AS double) / 1000 END AS was_y,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(40 + o_orderkey % 30 AS double) / 1000 END AS was_w,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(50 + o_orderkey % 40 AS double) / 1000 END AS was_h
FROM {orders}""",
    # job journal: entries of a batch change state over time
    "journal": """
SELECT user_id AS batch_id, event_id % 25 AS idx, ts, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'staged' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done'
                       WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS state,
       event_id % 3 AS epoch, value AS ms,
       CASE WHEN event_id % 3 <> 1 THEN '/archive/box' || lpad(cast(user_id % 25 AS string), 2, '0') || '/IMG_'
            || lpad(cast(event_id % 25 AS string), 6, '0') || '.tif' END AS path,
       CASE WHEN event_type = 'purchase' THEN '/out/box' || cast(user_id % 25 AS string) || '/IMG_'
            || lpad(cast(event_id % 25 AS string), 6, '0') || '.tif' END AS out_path,
       CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN '/backups/' || cast(event_id AS string) || '.tif' END AS backup,
       CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Truncated file' WHEN 1 THEN '=SUM(A1)'
            ELSE 'disk full' END END AS error
FROM {events}""",
    "backups": """
SELECT o_custkey AS photo_id, 1 + o_orderkey % 4 AS version, o_orderkey AS backup_no,
       cast(1000000 + (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 60 AS bigint) AS size_bytes,
       'h' || lpad(cast((o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 60 AS string), 5, '0') AS content_hash,
       o_orderkey % 6 = 0 AS captioned,
       '/archive/_originals/IMG_' || lpad(cast(o_custkey AS string), 6, '0') || '-original'
         || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '-' || cast(1 + o_orderkey % 4 AS string) END || '.tif' AS path
FROM {orders}""",
    "analysis": """
SELECT p_partkey AS photo_id,
       CASE WHEN p_size % 7 = 0 THEN 'copy' WHEN p_size % 7 = 1 THEN 'overwrite' ELSE NULL END AS save_mode,
       CASE WHEN p_size % 11 = 0 THEN 'copy' WHEN p_size % 11 = 1 THEN 'other' ELSE NULL END AS payload_mode,
       p_size % 5 = 0 AS has_record, p_size % 11 < 3 AS has_payload, p_size % 3 = 0 AS has_marker,
       p_size % 10 = 0 AS has_original,
       p_size % 4 <> 0 AS band_found, cast(1 + p_size % 4 AS bigint) AS n_bands,
       cast(p_partkey % 30 AS double) / 100 AS angle, cast(p_partkey % 25 AS double) / 10 AS edge_blur,
       cast(p_partkey % 40 AS double) / 10 AS color_drift, cast(p_partkey % 22 AS double) / 10 AS noise,
       CASE WHEN p_partkey % 9 = 0 THEN 'Perfection V600' ELSE p_brand END AS model,
       CASE WHEN p_partkey % 14 = 3 THEN 'Plustek' WHEN p_partkey % 3 = 0 THEN 'Canon' END AS make,
       CASE WHEN p_partkey % 15 = 4 THEN 'EPSON Scan 2' WHEN p_partkey % 2 = 0 THEN 'Editor 5' END AS software,
       cast(p_partkey % 12 * 50 AS bigint) AS dpi, p_partkey % 4 = 1 AS has_camera_tags,
       p_partkey % 3 <> 0 AS reads_text, p_partkey % 5 = 0 AS looks_written, p_partkey % 13 = 0 AS text_over_photo,
       cast(p_partkey % 100 AS double) / 100 AS edge_confidence, cast(p_partkey % 80 AS double) / 80 AS min_line_confidence,
       p_partkey % 29 <> 0 AS readable, p_partkey % 31 = 0 AS unsupported, cast(1 + p_partkey % 8 AS bigint) AS pages,
       cast(p_partkey % 41 AS bigint) AS size_bytes,
       CASE p_partkey % 4 WHEN 0 THEN 'cannot identify image file' WHEN 1 THEN 'Premature end of JPEG'
            WHEN 2 THEN 'permission denied' ELSE NULL END AS error,
       p_partkey % 17 = 0 AS uses_draft, p_partkey % 34 = 0 AS draft_erases, p_partkey % 19 = 0 AS names_missing,
       cast(p_partkey % 51 AS bigint) % 3 AS dropped_faces,
       '/archive/' || p_brand || '/IMG_' || lpad(cast(p_partkey AS string), 6, '0') || '.tif' AS path
FROM {part}""",
    # stored drafts, one per order
    "drafts": """
SELECT o_orderkey AS draft_no, o_custkey AS photo_id,
       '/archive/box/IMG_' || lpad(cast(o_custkey AS string), 6, '0') || '.tif' AS path,
       cast(1000000 + (o_custkey + o_orderkey % 2) % 60 AS bigint) AS size_bytes,
       cast(1700000000000000000 + o_custkey * 1000 + o_orderkey % 3 AS bigint) AS mtime_ns,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'h' || lpad(cast((o_custkey + o_orderkey % 2) % 60 AS string), 5, '0') END AS quick_hash,
       CASE WHEN o_orderkey % 4 <> 0 THEN 's' || cast(o_orderkey % 50 AS string) END AS state_hash,
       o_orderkey % 3 <> 0 AS has_details, o_orderkey % 7 = 0 AS has_caption_edits,
       CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS updated, o_orderdate AS file_time
FROM {orders}""",
    # crop and canvas chosen for each photo
    "layouts": """
SELECT c_custkey AS photo_id, cast(1 + c_custkey % 8 AS bigint) AS orientation,
       cast(3000 AS double) AS up_w, cast(2000 AS double) AS up_h,
       cast(c_custkey % 5 * 100 AS double) AS sx, cast(c_custkey % 4 * 50 AS double) AS sy,
       cast(3000 - c_custkey % 7 * 300 AS double) AS sw, cast(2000 - c_custkey % 3 * 200 AS double) AS sh,
       cast(c_custkey % 3 * 20 AS double) AS px, cast(c_custkey % 2 * 30 AS double) AS py,
       cast(3000 AS double) AS cw, cast(2400 AS double) AS ch
FROM {customer}""",
    # two inventory scans of the same archive
    "scan_before": """
SELECT c_custkey AS file_no, '/archive/box' || cast(c_nationkey AS string) || '/IMG_' || cast(c_custkey AS string) || '.tif' AS path,
       cast(1000 + c_custkey % 90 AS bigint) AS size_bytes, cast(c_custkey * 10 AS bigint) AS mtime_ns,
       cast(c_custkey AS bigint) AS file_id, 'c' || cast(c_custkey AS string) AS content_hash
FROM {customer}""",
    "scan_after": """
SELECT c_custkey AS file_no, '/archive/box' || cast(c_nationkey AS string) || CASE WHEN c_custkey % 8 = 0 THEN '/moved' ELSE '' END
         || '/IMG_' || cast(c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 100000000 ELSE 0 END AS string) || '.tif' AS path,
       cast(1000 + c_custkey % 90 + CASE WHEN c_custkey % 11 = 0 THEN 5 ELSE 0 END AS bigint) AS size_bytes,
       cast(c_custkey * 10 + CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 0 END AS bigint) AS mtime_ns,
       cast(c_custkey + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS bigint) AS file_id,
       'c' || cast(c_custkey + CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 15 = 0 THEN 900000000 ELSE 0 END AS string) AS content_hash
FROM {customer}""",
    # records found in written files
    "outputs": """
SELECT o_orderkey AS output_no, '/archive/out/IMG_' || lpad(cast(o_orderkey AS string), 7, '0') || '.tif' AS path,
       CASE o_orderkey % 4 WHEN 0 THEN NULL
            WHEN 1 THEN substr({sha(}lower('/archive/out/IMG_' || lpad(cast(o_orderkey AS string), 7, '0') || '.tif'){)sha}, 1, 24)
            WHEN 2 THEN substr({sha(}lower('/archive/src/IMG_' || cast(o_custkey AS string) || '.tif'){)sha}, 1, 24)
            ELSE 'gone' END AS source_key,
       CASE WHEN o_orderkey % 5 = 0 THEN 'overwrite' ELSE 'copy' END AS save_mode,
       o_orderkey % 9 = 0 AS has_original,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'p' || cast(o_custkey AS string) END AS photo_hash,
       'q' || cast(o_orderkey AS string) AS output_hash,
       cast(3000 + o_orderkey % 2 * 100 AS bigint) AS canvas_w, cast(2000 AS bigint) AS canvas_h
FROM {orders}""",
    "sources": """
SELECT c_custkey AS photo_id, '/archive/src/IMG_' || cast(c_custkey AS string) || '.tif' AS path,
       'p' || cast(c_custkey AS string) AS whole_hash, 'p' || cast(c_custkey + 1 AS string) AS crop_hash
FROM {customer}""",
    # reads of written files: the pixel hash found at each quarter turn or flip
    "pixel_checks": """
SELECT o_orderkey AS output_no, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 1 + o_orderkey % 8 END AS orientation,
       cast(CASE WHEN o_orderkey % 3 <> 0 AND 1 + o_orderkey % 8 > 4 THEN 2000 ELSE 3000 + o_orderkey % 2 * 100 END AS bigint) AS width,
       cast(CASE WHEN o_orderkey % 3 <> 0 AND 1 + o_orderkey % 8 > 4 THEN 3000 + o_orderkey % 2 * 100
                 WHEN o_orderkey % 10 = 0 THEN 1999 ELSE 2000 END AS bigint) AS height,
       CASE o_orderkey % 4 WHEN 0 THEN 'q' || cast(o_orderkey AS string) WHEN 1 THEN 'p' || cast(o_custkey AS string)
            ELSE 'x' || cast(o_orderkey AS string) END AS pixel_hash
FROM {orders}""",
    # one region document per order
    "region_docs": """
SELECT o_orderkey AS photo_id, cast(1 + o_orderkey % 8 AS bigint) AS orientation,
       '{"RegionList": [{"Name": "Ann ' || cast(o_orderkey % 9 AS string) || '", "Type": "Face", "Area": {"X": "0.'
         || cast(3 + o_orderkey % 4 AS string) || '", "Y": "0.5", "W": "0.1", "H": "0.2", "Unit": "'
         || CASE WHEN o_orderkey % 4 = 0 THEN 'pixel' ELSE 'normalized' END || '"}}, {"Name": "Rex", "Type": "'
         || CASE WHEN o_orderkey % 3 = 0 THEN 'Pet' ELSE 'face' END || '", "Area": {"X": "0.2", "Y": "bad", "W": "0.1", "H": "0.1"}}]}' AS mwg,
       '{"Regions": [{"PersonDisplayName": "Ann ' || cast(o_orderkey % 9 AS string) || '", "Rectangle": "0.'
         || cast(25 + o_orderkey % 50 AS string) || ', 0.4, 0.1, ' || CASE WHEN o_orderkey % 6 = 0 THEN '-0.2' ELSE '0.2' END || '"}]}' AS mp
FROM {orders}""",
    # save log lines
    "log_rows": """
SELECT event_id AS seq, ts AS time, event_type <> 'error' AS ok, '/archive/IMG_' || cast(user_id AS string) || '.tif' AS source,
       CASE event_type WHEN 'view' THEN '=cmd' WHEN 'click' THEN '-2' WHEN 'error' THEN '@x' ELSE 'saved' END AS notes,
       cast(round(value) AS bigint) AS ms
FROM {events}""",
    # recognized words of each document, six to a line; the words come from the text
    "words_spark": """
SELECT doc_id, cast(pos AS bigint) AS pos, word, cast(floor(pos / 6) AS bigint) AS line_no,
       cast(floor(pos / 24) AS bigint) AS block_no, cast((length(word) * 37 + pos * 13) % 100 AS double) / 100 AS conf
FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, word) FROM {documents}) AS w""",
    "words_duckdb": """
SELECT doc_id, pos, word, cast(floor(pos / 6) AS bigint) AS line_no, cast(floor(pos / 24) AS bigint) AS block_no,
       cast((length(word) * 37 + pos * 13) % 100 AS double) / 100 AS conf
FROM (SELECT doc_id, unnest(list) AS word, cast(unnest(range(len(list))) AS bigint) AS pos
      FROM (SELECT doc_id, string_split(text, ' ') AS list FROM {documents}) AS l) AS w""",
}


def _fill(text: str, tables: dict[str, str]) -> str:
    for name, target in tables.items():
        text = text.replace("{" + name + "}", target)
    return text


def _text(name: str, engine: str) -> str:
    text = VIEWS.get(f"{name}_{engine}") or VIEWS[name]
    # the one function spelled differently in the two engines
    opening, closing = ("sha2(", ", 256)") if engine == "spark" else ("sha256(", ")")
    return text.replace("{sha(}", opening).replace("{)sha}", closing)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or base table) over the parquet files in ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_fill(_text(name, "spark"), {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def oracle(names: list[str], body: str) -> str:
    """The oracle's SQL: the named views as WITH entries, then the body."""
    entries = [f"{n} AS ({_fill(_text(n, 'duckdb'), {t: t for t in TABLES})})" for n in names]
    body = body.strip()
    if body.startswith(","):
        entries.append(body[1:].strip())
        return ("WITH RECURSIVE " if " JOIN turn t " in body else "WITH ") + ",\n".join(entries)
    return ("WITH " + ",\n".join(entries) + "\n" if entries else "") + body
