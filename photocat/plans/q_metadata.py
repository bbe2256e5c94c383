"""Registered metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.functions import dates, text
from photocat.functions import fixed_values as fixed
from photocat.operators import normalize, people
from photocat.plans import date_sql as ds
from photocat.plans.registry import query
from photocat.plans.views import load

AS_OF = ds.AS_OF

_SOURCES = ", ".join(
    f"('{field}', '{tag}', {i * 100 + j})"
    for field, sources in fixed.FIELD_SOURCES.items()
    for i, s in enumerate(sources)
    for j, tag in enumerate([f"{g}:{s[5:]}" for g in fixed.EXIF_GROUPS] if s.startswith("EXIF:") else [s])
)
SHAPE = """regexp_matches(value, '^\\s*\\{"shape":')"""
CLEAN = "nullif(regexp_replace(replace(value, chr(13), ''), '^\\s+|\\s+$', '', 'g'), '')"
CANDIDATES = f""", src(field, source_tag, rank) AS (VALUES {_SOURCES}),
 cand AS (SELECT t.photo_id, s.field, t.tag, t.item, t.value,
     s.rank + CASE WHEN t.tag <> s.source_tag THEN 50 ELSE 0 END AS rank
   FROM tags t JOIN src s ON t.tag = s.source_tag OR (s.source_tag LIKE 'XMP%' AND starts_with(t.tag, s.source_tag || '-'))
   WHERE trim(t.value) <> '')"""
FIELDS = (
    CANDIDATES
    + f""", listed AS (SELECT photo_id, field, tag, rank,
     CASE WHEN field = 'creator' AND bool_or(contains(value, ',')) THEN string_agg({CLEAN}, '; ' ORDER BY item)
       ELSE string_agg({CLEAN}, ', ' ORDER BY item) END AS value
   FROM cand WHERE NOT (field = 'caption' AND tag LIKE '%:ImageDescription' AND {SHAPE}) GROUP BY photo_id, field, tag, rank),
 first AS (SELECT * FROM (SELECT photo_id, field, tag, value,
     row_number() OVER (PARTITION BY photo_id, field ORDER BY
       CASE WHEN field IN ('date', 'digitized') AND NOT regexp_matches(value, '[1-9]') THEN 1 ELSE 0 END, rank, tag) AS rn
   FROM listed) AS x WHERE rn = 1)"""
)


def _wide(names, suffix, what):
    return ", ".join(f"max(CASE WHEN field = '{n}' THEN {what} END) AS {n}{suffix}" for n in names)


@query("m1_coalesce_fields", "tags", FIELDS + f" SELECT photo_id, {_wide(fixed.TEXT_FIELDS, '', 'value')} FROM first GROUP BY photo_id")
def _(spark, sf):
    return normalize.normalize_fields(load(spark, sf, "tags")).select("photo_id", *fixed.TEXT_FIELDS)


@query(
    "m2_expand_tag_candidates",
    "tags",
    CANDIDATES + " SELECT field, tag, rank, count(*) AS present FROM cand GROUP BY field, tag, rank",
)
def _(spark, sf):
    c = normalize.expand_tag_candidates(load(spark, sf, "tags"))
    return c.groupBy("field", "tag", "rank").agg(F.count(F.lit(1)).alias("present"))


@query(
    "m3_present",
    "tags",
    "SELECT tag, count(*) AS tag_rows, cast(sum(CASE WHEN trim(value) <> '' THEN 1 ELSE 0 END) AS bigint) AS present FROM tags GROUP BY tag",
)
def _(spark, sf):
    t = load(spark, sf, "tags")
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("tag_rows"), F.count_if(text.present(F.col("value"))).alias("present"))


@query(
    "m4_field_provenance",
    "tags",
    FIELDS + f" SELECT photo_id, {_wide(fixed.TEXT_FIELDS, '_tag', 'tag')} FROM first GROUP BY photo_id",
)
def _(spark, sf):
    f = normalize.normalize_fields(load(spark, sf, "tags"))
    return f.select("photo_id", *[n + "_tag" for n in fixed.TEXT_FIELDS])


@query(
    "m5_coalesce_date_fields",
    "tags",
    FIELDS + f" SELECT photo_id, {_wide(['date'], '', 'value')}, {_wide(['date'], '_tag', 'tag')} FROM first GROUP BY photo_id",
)
def _(spark, sf):
    return normalize.normalize_fields(load(spark, sf, "tags")).select("photo_id", "date", "date_tag")


@query(
    "m6_lang_alt_text",
    "",
    """SELECT c_custkey AS photo_id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment
         WHEN c_custkey % 2 = 0 THEN 'a' || chr(10) || 'b' END AS title, c_mktsegment || ', ' || c_name AS listed FROM customer""",
)
def _(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    langs = F.create_map(
        F.lit("x-default"), F.when(k % 3 == 0, F.concat(F.lit("  "), F.col("c_name"))).otherwise(""),
        F.lit("de"), F.when(k % 3 == 1, F.col("c_mktsegment")).otherwise(""),
        F.lit("fr"), F.when(k % 2 == 0, F.lit(" a\r\nb ")).otherwise(" "),
    )
    listed = F.array(F.concat(F.lit(" "), F.col("c_mktsegment")), F.lit("  "), F.col("c_name"))
    return c.select(k.alias("photo_id"), text.lang_alt_text(langs).alias("title"), text.list_text(listed).alias("listed"))


@query(
    "m7_repair_mojibake",
    "",
    "SELECT doc_id AS photo_id, length(text) AS chars, md5(text) AS digest FROM documents",
)
def _(spark, sf):
    docs = load(spark, sf, "documents")
    plain = F.col("lang") == "en"
    damaged = docs.select(
        F.col("doc_id").alias("photo_id"),
        F.lit("IPTC:Caption-Abstract").alias("tag"),
        F.when(plain, F.col("text")).otherwise(text.mangle_utf8(F.col("text"))).alias("value"),
    )
    charset = docs.where(plain).select(
        F.col("doc_id").alias("photo_id"), F.lit("IPTC:CodedCharacterSet").alias("tag"), F.lit("UTF8").alias("value")
    )
    fixed_tags = normalize.repair_iptc(damaged.unionByName(charset)).where("tag = 'IPTC:Caption-Abstract'")
    return fixed_tags.select("photo_id", F.length("value").cast("long").alias("chars"), F.md5("value").alias("digest"))


KEYWORDS = """, kw AS (SELECT photo_id, lower(trim(value)) AS keyword_key, CASE WHEN tag = 'XMP-dc:Subject' THEN 0 ELSE 1 END AS src_rank,
   item, trim(value) AS keyword FROM tags WHERE tag IN ('XMP-dc:Subject', 'IPTC:Keywords') AND trim(value) <> ''),
 keywords AS (SELECT photo_id, keyword_key, src_rank, item, keyword FROM (SELECT *, row_number() OVER (
   PARTITION BY photo_id, keyword_key ORDER BY src_rank, item) AS rn FROM kw) AS x WHERE rn = 1)"""
MARKER = "(keyword_key LIKE 'date:%' OR keyword_key LIKE '% analyzed' OR keyword_key IN ('back', 'negative'))"


@query("m8_merge_keywords", "tags", KEYWORDS + " SELECT photo_id, src_rank, item, keyword FROM keywords")
def _(spark, sf):
    return normalize.merge_keywords(load(spark, sf, "tags")).select("photo_id", "src_rank", "item", "keyword")


@query(
    "m9_split_join_creators",
    "tags",
    CANDIDATES
    + """, c AS (SELECT *, dense_rank() OVER (PARTITION BY photo_id ORDER BY rank, tag) AS r FROM cand WHERE field = 'creator')
 SELECT photo_id, CASE WHEN bool_or(value LIKE '%,%') THEN string_agg(trim(value), '; ' ORDER BY item)
   ELSE string_agg(trim(value), ', ' ORDER BY item) END AS creators FROM c WHERE r = 1 GROUP BY photo_id""",
)
def _(spark, sf):
    return normalize.join_creators(normalize.split_creators(load(spark, sf, "tags")))


@query("m10_drop_marker_keywords", "tags", KEYWORDS + f" SELECT photo_id, keyword FROM keywords WHERE NOT {MARKER}")
def _(spark, sf):
    return normalize.drop_marker_keywords(normalize.merge_keywords(load(spark, sf, "tags"))).select("photo_id", "keyword")


@query(
    "m11_exclude_keywords",
    "tags paths",
    KEYWORDS
    + """ SELECT photo_id, keyword FROM keywords k WHERE NOT regexp_matches(keyword_key, '^(scan|people)([^\\pL\\pN\\pM]|$)')
   AND NOT EXISTS (SELECT 1 FROM paths p WHERE p.photo_id = k.photo_id
     AND regexp_matches(lower(p.path), '^(scan|people)([^\\pL\\pN\\pM]|$)')
     AND lower(trim(list_extract(string_split(p.path, '|'), -1))) = k.keyword_key)""",
)
def _(spark, sf):
    k = normalize.merge_keywords(load(spark, sf, "tags"))
    return normalize.exclude_keywords(k, load(spark, sf, "paths"), ["scan", "people"]).select("photo_id", "keyword")


CERTAINTY = (
    FIELDS
    + KEYWORDS
    + """, mark AS (SELECT photo_id, keyword AS marker FROM (SELECT *, row_number() OVER (PARTITION BY photo_id
     ORDER BY src_rank, item) AS rn FROM kw WHERE regexp_matches(keyword, '(?i)^\\s*DATE:\\s*Y[!?~@](M[!?~@])?(D[!?~@])?\\s*$')) AS x WHERE rn = 1),
 orig AS (SELECT photo_id, value AS original FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY rank) AS rn
   FROM cand WHERE field = 'date' AND tag LIKE '%DateTimeOriginal') AS x WHERE rn = 1),
 both_dates AS (SELECT f.photo_id, f.value, o.original, upper(trim(substr(trim(m.marker), 6))) AS certainty
   FROM first f JOIN orig o ON o.photo_id = f.photo_id JOIN mark m ON m.photo_id = f.photo_id WHERE f.field = 'date'), """
    + ds.parsed("fd", "both_dates", "photo_id, value, original, certainty", "value")
    + ", "
    + ds.parsed("od", "both_dates", "photo_id, original", "original")
    + """, certain AS (SELECT fd.photo_id, fd.certainty FROM fd JOIN od ON fd.photo_id = od.photo_id
   WHERE fd.y = od.y AND (fd.m IS NULL OR fd.m = od.m) AND (fd.d IS NULL OR fd.d = od.d)
   AND NOT regexp_matches(substr(od.original, 11), '[1-9]'))"""
)


@query("m12_date_certainty", "tags", CERTAINTY + " SELECT photo_id, certainty FROM certain")
def _(spark, sf):
    return normalize.date_certainty(load(spark, sf, "tags"), AS_OF)


@query(
    "m13_location_line",
    "tags",
    FIELDS
    + """, w AS (SELECT photo_id, max(CASE WHEN field = 'sublocation' THEN value END) AS a, max(CASE WHEN field = 'city' THEN value END) AS b
   FROM first GROUP BY photo_id) SELECT photo_id, concat_ws(', ', a, b) AS location FROM w""",
)
def _(spark, sf):
    return normalize.location_line(normalize.normalize_fields(load(spark, sf, "tags")))


@query("m14_source_key", "photos", "SELECT photo_id, substr(sha256(lower(path)), 1, 24) AS source_key FROM photos")
def _(spark, sf):
    return normalize.add_source_key(load(spark, sf, "photos").select("photo_id", "path")).select("photo_id", "source_key")


@query(
    "m15_scan_image_facts",
    "photos",
    """SELECT photo_id, format, pages, orientation, CASE WHEN orientation >= 5 THEN height ELSE width END AS upright_width,
   CASE WHEN orientation >= 5 THEN width ELSE height END AS upright_height, size_bytes, mtime_ns FROM photos""",
)
def _(spark, sf):
    return normalize.image_facts(load(spark, sf, "photos"))


@query(
    "m15_facts_from_tags",
    "",
    """SELECT c_custkey AS photo_id, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS channels, CASE c_custkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 8 ELSE 8 END AS bits,
   CASE c_custkey % 6 WHEN 0 THEN 300 WHEN 1 THEN 600 WHEN 2 THEN 300 WHEN 3 THEN 305 END AS dpi, CASE c_custkey % 3 WHEN 0 THEN 'LZW' WHEN 2 THEN 'Deflate/Inflate' END AS compression FROM customer""",
)
def _(spark, sf):
    # TIFF, JPEG and PNG dumps; some resolutions per centimetre or metre, some without a unit
    k = F.col("c_custkey")
    rows = [
        (k % 3 == 0, "IFD0:SamplesPerPixel", F.lit("3")), (k % 3 == 1, "File:ColorComponents", F.lit("1")), (k % 3 == 0, "IFD0:BitsPerSample", F.lit("16 16 16")),
        (k % 3 == 1, "File:BitsPerSample", F.lit(" 8 ")), (k % 3 == 2, "PNG:BitDepth", F.lit("8")), (k % 3 == 0, "IFD0:Compression", F.lit("LZW")), (k % 3 == 2, "PNG:Compression", F.lit("Deflate/Inflate")),
        (k % 6 == 0, "IFD0:XResolution", F.lit("300")), (k % 6 == 0, "IFD0:ResolutionUnit", F.lit("inches")), (k % 6 == 3, "IFD0:XResolution", F.lit("120")), (k % 6 == 3, "IFD0:ResolutionUnit", F.lit("cm")),
        (k % 6 == 1, "JFIF:XResolution", F.lit("600")), (k % 6 == 4, "JFIF:XResolution", F.lit("1")), (k % 6 == 4, "JFIF:ResolutionUnit", F.lit("None")),
        (k % 6 == 2, "PNG:PixelsPerUnitX", F.lit("11811")), (k % 6 == 2, "PNG:PixelUnits", F.lit("meters")), (k % 6 == 5, "PNG:PixelsPerUnitX", F.lit("undef")), (k % 6 == 5, "File:FileSize", F.lit("9")),
    ]
    tags = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(t).alias("tag"), v.alias("value"))) for cond, t, v in rows]))
    dump = load(spark, sf, "customer").select(k.alias("photo_id"), F.inline(tags)).withColumn("item", F.lit(0))
    return normalize.facts_from_tags(dump)


@query(
    "m16_array_shape_note",
    "tags",
    f"SELECT photo_id, {SHAPE} AS shape_note FROM tags WHERE tag = 'IFD0:ImageDescription'",
)
def _(spark, sf):
    t = load(spark, sf, "tags").where("tag = 'IFD0:ImageDescription'")
    return t.select("photo_id", text.is_shape_note(F.col("value")).alias("shape_note"))


@query(
    "m17_route_output_format",
    "photos",
    """SELECT photo_id, 'JPEG' AS jpeg_format, CASE WHEN format = 'JPEG' THEN regexp_extract(path, '\\.[A-Za-z]+$') ELSE '.jpg' END AS jpeg_ext,
   format AS same_format, CASE WHEN format = 'HEIC' THEN NULL ELSE regexp_extract(path, '\\.[A-Za-z]+$') END AS same_ext FROM photos""",
)
def _(spark, sf):
    p = load(spark, sf, "photos")
    jf, je = normalize.route_output_format(F.col("format"), "jpg", F.col("path"))
    sf_, se = normalize.route_output_format(F.col("format"), "same", F.col("path"))
    return p.select("photo_id", jf.alias("jpeg_format"), je.alias("jpeg_ext"), sf_.alias("same_format"), se.alias("same_ext"))


@query(
    "photo_overview",
    "tags regions",
    FIELDS
    + """, base AS (SELECT photo_id, max(CASE WHEN field = 'title' THEN value END) AS title, max(CASE WHEN field = 'title' THEN tag END) AS title_tag,
   max(CASE WHEN field = 'city' THEN value END) AS city, max(CASE WHEN field = 'city' THEN tag END) AS city_tag,
   max(CASE WHEN field = 'date' THEN value END) AS value, max(CASE WHEN field = 'date' THEN tag END) AS date_tag FROM first GROUP BY photo_id), """
    + ds.parsed("p", "base", "photo_id, title, title_tag, city, city_tag, value, date_tag", "value")
    + f""", people AS (SELECT photo_id, string_agg(name, ', ' ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, x + w / 2, y + h / 2, region_no) AS people
   FROM regions WHERE name <> '' GROUP BY photo_id)
 SELECT p.photo_id, title, title_tag, city, city_tag, CASE WHEN y IS NULL THEN {ds.rough('value')} ELSE {ds.in_words()} END AS date_text,
   date_tag, people FROM p LEFT JOIN people ON people.photo_id = p.photo_id""",
)
def _(spark, sf):
    f = normalize.normalize_fields(load(spark, sf, "tags"))
    f = f.withColumn("date_text", dates.rendered_date(F.col("date"), AS_OF))
    named = people.named(load(spark, sf, "regions"))
    names = people.names_in_order(named, "lr").select("photo_id", F.array_join("names", ", ").alias("people"))
    keep = ["photo_id", "title", "title_tag", "city", "city_tag", "date_text", "date_tag"]
    return f.select(*keep).join(names, "photo_id", "left")
