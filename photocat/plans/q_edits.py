"""Registered change-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.functions import dates
from photocat.functions import fixed_values as fixed
from photocat.operators import edits, normalize
from photocat.plans import date_sql as ds
from photocat.plans.q_metadata import FIELDS, KEYWORDS
from photocat.plans.q_people import FOLD, XYWH, sql_iou  # noqa: F401
from photocat.plans.registry import query
from photocat.plans.views import load

AS_OF = ds.AS_OF
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
LATEST = """, lt AS (SELECT photo_id, field, edit_seq, value FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, field
   ORDER BY edited_at DESC, edit_seq DESC) AS rn FROM edits) AS x WHERE rn = 1)"""
NAMES = fixed.TEXT_FIELDS + ["date"]
BASE = FIELDS + ", base AS (SELECT photo_id, " + ", ".join(
    f"max(CASE WHEN field = '{n}' THEN value END) AS {n}" for n in NAMES
) + " FROM first GROUP BY photo_id)"
AFTER = (
    ", ew AS (SELECT photo_id, "
    + ", ".join(f"max(CASE WHEN field = '{n}' THEN 1 END) AS has_{n}, max(CASE WHEN field = '{n}' THEN {STRIP.format('value')} END) AS new_{n}" for n in NAMES)
    + " FROM lt GROUP BY photo_id), after AS (SELECT b.photo_id, "
    + ", ".join(f"CASE WHEN has_{n} = 1 THEN nullif(new_{n}, '') ELSE b.{n} END AS {n}" for n in NAMES)
    + ", CASE WHEN has_date = 1 AND new_date <> '' THEN 'Y!M!' END AS certainty FROM base b LEFT JOIN ew ON ew.photo_id = b.photo_id)"
)


def _fields(spark, sf):
    return normalize.normalize_fields(load(spark, sf, "tags")).select("photo_id", *NAMES)


def _latest(spark, sf):
    return edits.latest_edit(load(spark, sf, "edits"))


@query(
    "e1_validate_edits",
    "edits",
    f"""SELECT photo_id, edit_seq, {STRIP.format('value')} AS value, concat_ws('; ',
   CASE WHEN field <> 'date' AND regexp_matches(value, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'control characters' END,
   CASE WHEN field NOT IN ('date', 'caption', 'notes') AND contains(value, chr(10)) THEN 'line breaks' END,
   CASE WHEN field <> 'date' AND starts_with(value, 'base64:') THEN 'starts with base64:' END) AS errors FROM edits""",
)
def _(spark, sf):
    e = edits.validate_edits(load(spark, sf, "edits"), AS_OF)
    return e.select("photo_id", "edit_seq", "value", F.array_join("errors", "; ").alias("errors"))


@query(
    "e1_validate_date_edits",
    "date_texts",
    f""", d AS (SELECT text_no, level, estimate, pattern, substr('1952-06-31', 1, CASE text_no % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS iso FROM date_texts)
 SELECT text_no, concat_ws('; ', CASE WHEN length(iso) <> CASE level WHEN 'day' THEN 10 WHEN 'month' THEN 7 ELSE 4 END THEN 'does not fit the level' END,
   CASE WHEN length(iso) = 10 THEN 'not a date' END) AS errors FROM d""",
)
def _(spark, sf):
    n = F.col("text_no") % 4
    iso = F.when(n == 0, "1952").when(n == 1, "1952-06").otherwise("1952-06-31")
    d = edits.validate_date_edits(load(spark, sf, "date_texts").withColumn("iso", iso), AS_OF)
    return d.select("text_no", F.array_join("errors", "; ").alias("errors"))


@query(
    "e1_validate_keyword_edits",
    "keyword_edits",
    """, u AS (SELECT photo_id, item, keyword, row_number() OVER (PARTITION BY photo_id, lower(keyword) ORDER BY item) AS rn FROM keyword_edits
   WHERE keyword <> 'DATE: Y!') SELECT photo_id, item, keyword, '' AS errors FROM u WHERE rn = 1""",
)
def _(spark, sf):
    k = edits.validate_keyword_edits(load(spark, sf, "keyword_edits"))
    return k.select("photo_id", "item", "keyword", F.array_join("errors", "; ").alias("errors"))


@query(
    "e1_validate_face_edits",
    "face_edits",
    """SELECT photo_id, face_key, CASE WHEN x + w > 1 + 1e-6 OR y + h > 1 + 1e-6 THEN 'the box is outside the photo' ELSE '' END AS errors
 FROM face_edits WHERE NOT (face_key LIKE 'new:%' AND (deleted OR (coalesce(name, '') = '' AND x IS NULL)))""",
)
def _(spark, sf):
    f = edits.validate_face_edits(load(spark, sf, "face_edits"))
    return f.select("photo_id", "face_key", F.array_join("errors", "; ").alias("errors"))


@query("e2_latest_edit", "edits", LATEST + " SELECT photo_id, field, edit_seq, value FROM lt")
def _(spark, sf):
    return _latest(spark, sf)


@query("e3_apply_edits", "tags edits", BASE + LATEST + AFTER + f" SELECT photo_id, {', '.join(NAMES)}, certainty FROM after")
def _(spark, sf):
    return edits.apply_edits(_fields(spark, sf), load(spark, sf, "edits"))


# date edits: one per photo, some clearing
DATE_EDITS = """, de AS (SELECT c_custkey AS photo_id, CASE WHEN c_custkey % 6 <> 0 THEN CASE c_custkey % 4 WHEN 0 THEN '1952' WHEN 1 THEN '1952-06'
     ELSE cast(1900 + c_custkey % 120 AS varchar) || '-' || lpad(cast(1 + c_custkey % 12 AS varchar), 2, '0') || '-' || lpad(cast(1 + c_custkey % 28 AS varchar), 2, '0') END END AS iso,
   CASE WHEN c_custkey % 6 <> 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'Y~' WHEN 1 THEN 'Y!M!' ELSE 'Y!M!D!' END END AS pattern FROM customer WHERE c_acctbal > 0)"""


def _date_edits(spark, sf):
    k = F.col("c_custkey")
    whole = F.format_string("%04d-%02d-%02d", 1900 + k % 120, 1 + k % 12, 1 + k % 28)
    iso = F.when(k % 4 == 0, "1952").when(k % 4 == 1, "1952-06").otherwise(whole)
    level = F.when(k % 4 == 0, "year").when(k % 4 == 1, "month").otherwise("day")
    return load(spark, sf, "customer").where("c_acctbal > 0").select(
        k.alias("photo_id"), F.when(k % 6 != 0, iso).alias("iso"),
        F.when(k % 6 != 0, dates.level_pattern(level, k % 4 == 0)).alias("pattern"),
    )


MARK = "regexp_matches(keyword, '(?i)^\\s*DATE:\\s*Y[!?~@](M[!?~@])?(D[!?~@])?\\s*$')"
KEYWORDS_AFTER = (
    KEYWORDS
    + DATE_EDITS
    + f""", ke AS (SELECT photo_id, item, keyword FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, lower(keyword) ORDER BY item) AS rn
     FROM keyword_edits WHERE edited AND keyword <> 'DATE: Y!') AS x WHERE rn = 1),
 ka AS (SELECT photo_id, 0 AS branch, keyword FROM ke
   UNION ALL SELECT photo_id, 0, keyword FROM keywords k WHERE NOT {MARK} AND NOT EXISTS (SELECT 1 FROM ke WHERE ke.photo_id = k.photo_id)
   UNION ALL SELECT photo_id, 1, 'DATE: ' || pattern FROM de WHERE pattern IS NOT NULL
   UNION ALL SELECT photo_id, 1, keyword FROM keywords k WHERE {MARK} AND NOT EXISTS (SELECT 1 FROM de WHERE de.photo_id = k.photo_id))"""
)


def _keywords_after(spark, sf):
    ke = edits.validate_keyword_edits(load(spark, sf, "keyword_edits").where("edited"))
    own = normalize.merge_keywords(load(spark, sf, "tags"))
    return own, edits.keywords_after(own, ke, _date_edits(spark, sf))


@query("e4_keywords_after", "tags keyword_edits", KEYWORDS_AFTER + " SELECT photo_id, branch, keyword FROM ka")
def _(spark, sf):
    return _keywords_after(spark, sf)[1].select("photo_id", "branch", "keyword")


FACES_AFTER = """, fa AS (SELECT coalesce(r.photo_id, e.photo_id) AS photo_id, coalesce(cast(r.region_no AS varchar), e.face_key) AS face_key,
   trim(CASE WHEN e.has_name OR r.region_no IS NULL THEN coalesce(e.name, '') ELSE r.name END) AS name,
   CASE WHEN coalesce(e.has_box, false) OR r.region_no IS NULL THEN e.x ELSE r.x END AS x, CASE WHEN coalesce(e.has_box, false) OR r.region_no IS NULL THEN e.y ELSE r.y END AS y,
   CASE WHEN coalesce(e.has_box, false) OR r.region_no IS NULL THEN e.w ELSE r.w END AS w, CASE WHEN coalesce(e.has_box, false) OR r.region_no IS NULL THEN e.h ELSE r.h END AS h
   FROM regions r FULL JOIN face_edits e ON e.photo_id = r.photo_id AND e.face_key = cast(r.region_no AS varchar)
   WHERE (r.region_no IS NOT NULL OR e.face_key LIKE 'new:%') AND NOT coalesce(e.deleted, false)),
 faces_after AS (SELECT * FROM fa WHERE name <> '' OR x IS NOT NULL)"""


def _faces(spark, sf):
    return load(spark, sf, "regions").withColumn("face_key", F.col("region_no").cast("string"))


def _faces_after(spark, sf):
    return edits.faces_after(_faces(spark, sf), load(spark, sf, "face_edits"))


@query("e5_faces_after", "regions face_edits", FACES_AFTER + " SELECT photo_id, face_key, name, x, y, w, h FROM faces_after")
def _(spark, sf):
    return _faces_after(spark, sf)


@query(
    "e6_propagate_hierarchy",
    "tags keyword_edits paths",
    KEYWORDS_AFTER
    + f""", kept AS (SELECT DISTINCT photo_id, lower(trim(keyword)) AS leaf FROM ka),
 gone AS (SELECT DISTINCT photo_id, keyword_key AS leaf FROM keywords k WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.photo_id = k.photo_id AND kept.leaf = k.keyword_key)),
 pl AS (SELECT *, lower(trim(list_extract(string_split(path, '|'), -1))) AS leaf, list_extract(string_split(path, '|'), -1) AS last FROM paths),
 j AS (SELECT p.*, g.leaf IS NOT NULL AS is_gone, CASE WHEN p.leaf LIKE '%-%' AND EXISTS (SELECT 1 FROM kept k WHERE k.photo_id = p.photo_id AND k.leaf = 'family') THEN 'Family' END AS new_name,
    d.photo_id IS NOT NULL AS dated FROM pl p LEFT JOIN gone g ON g.photo_id = p.photo_id AND g.leaf = p.leaf LEFT JOIN de d ON d.photo_id = p.photo_id)
 SELECT photo_id, item, CASE WHEN new_name IS NOT NULL AND is_gone THEN substr(path, 1, length(path) - length(last)) || new_name ELSE path END AS path
 FROM j WHERE NOT (dated AND {MARK.replace('keyword', 'last')}) AND ((new_name IS NOT NULL AND is_gone) OR NOT is_gone)""",
)
def _(spark, sf):
    before, after = _keywords_after(spark, sf)
    paths = load(spark, sf, "paths")
    # priorities such as "3-MEDIUM" were renamed to Family
    renames = before.where("keyword_key LIKE '%-%'").select("photo_id", F.col("keyword_key").alias("old_key"), F.lit("Family").alias("new_name"))
    return edits.propagate_hierarchy(paths, before, after, renames, _date_edits(spark, sf))


_SPEC = ", ".join(
    f"('{field}', '{name}', '{role}')"
    for field, (p, m, f) in fixed.MIRROR_SPEC.items()
    for role, tags in (("primary", [p]), ("mirror", m), ("fallback", f))
    for t in tags
    for name in ([f"{g}:{t[5:]}" for g in fixed.EXIF_GROUPS] if t.startswith("EXIF:") else [t])
)
SQUEEZE = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"
PLAN = (
    f""", spec(field, tag, role) AS (VALUES {_SPEC}),
 have AS (SELECT photo_id, tag, value AS old FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, tag ORDER BY item, value) AS rn FROM tags WHERE value IS NOT NULL) AS x WHERE rn = 1),
 wp AS (SELECT l.photo_id, l.field, s.tag, s.role, coalesce({STRIP.format('l.value')}, '') AS v, h.old, f.value AS was FROM lt l JOIN spec s ON s.field = l.field
   LEFT JOIN have h ON h.photo_id = l.photo_id AND h.tag = s.tag LEFT JOIN first f ON f.photo_id = l.photo_id AND f.field = l.field),
 plan AS (SELECT photo_id, field, tag, CASE WHEN v = '' AND old IS NOT NULL THEN 'delete' WHEN v <> '' AND (role = 'primary' OR (role = 'mirror' AND old IS NOT NULL)
     OR (role = 'fallback' AND old IS NOT NULL AND was <> '' AND {SQUEEZE.format('old')} = {SQUEEZE.format('was')})) THEN 'set' END AS action, v FROM wp)"""
)


def _mirrored(spark, sf, tags):
    return edits.mirror_fields(_latest(spark, sf), tags, normalize.normalize_fields(tags, edits.COMPARED_FIELDS, all_photos=False))


@query(
    "e7_mirror_fields",
    "tags edits",
    FIELDS + LATEST + PLAN + " SELECT photo_id, field, tag, action, CASE WHEN action = 'set' THEN v END AS value, '' AS note FROM plan WHERE action IS NOT NULL",
)
def _(spark, sf):
    return _mirrored(spark, sf, load(spark, sf, "tags"))


@query(
    "e8_date_tag_updates",
    "tags",
    DATE_EDITS
    + """, t AS (SELECT photo_id, max(CASE WHEN tag = 'ExifIFD:DateTimeOriginal' THEN value END) AS dto,
     max(CASE WHEN tag = 'XMP-photoshop:DateCreated' THEN value END) AS created FROM tags GROUP BY photo_id),
 j AS (SELECT d.*, dto, created, CASE WHEN length(iso) = 4 THEN iso || ':06:15' WHEN length(iso) = 7 THEN replace(iso, '-', ':') || ':15' ELSE replace(iso, '-', ':') END AS day
   FROM de d LEFT JOIN t ON t.photo_id = d.photo_id),
 k AS (SELECT *, pattern = 'Y!M!D!' AND dto IS NOT NULL AND substr(dto, 1, 10) = day AS keeps FROM j)
 SELECT photo_id, 'ExifIFD:DateTimeOriginal' AS tag, CASE WHEN iso IS NULL THEN 'delete' ELSE 'set' END AS action, CASE WHEN iso IS NOT NULL THEN day || ' 00:00:00' END AS value
   FROM k WHERE (iso IS NULL AND dto IS NOT NULL) OR (iso IS NOT NULL AND NOT keeps)
 UNION ALL SELECT photo_id, 'XMP-photoshop:DateCreated', 'delete', NULL FROM k WHERE iso IS NULL AND created IS NOT NULL
 UNION ALL SELECT photo_id, 'XMP-photoshop:DateCreated', 'set', replace(iso, '-', ':') FROM k WHERE iso IS NOT NULL""",
)
def _(spark, sf):
    return edits.date_tag_updates(_date_edits(spark, sf), load(spark, sf, "tags"), AS_OF)


@query(
    "e9_list_people_sync",
    "regions face_edits listed",
    FACES_AFTER
    + """, touched AS (SELECT photo_id, face_key FROM face_edits WHERE (coalesce(has_name, false) OR deleted) AND face_key NOT LIKE 'new:%'),
 oldn AS (SELECT DISTINCT r.photo_id, lower(r.name) AS key FROM regions r JOIN touched t ON t.photo_id = r.photo_id AND t.face_key = cast(r.region_no AS varchar) WHERE r.name <> ''),
 final AS (SELECT DISTINCT photo_id, lower(name) AS key FROM faces_after WHERE name <> ''),
 gone AS (SELECT * FROM oldn o WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.photo_id = o.photo_id AND f.key = o.key)),
 newn AS (SELECT e.photo_id, lower(trim(e.name)) AS key, min(trim(e.name)) AS new_name FROM face_edits e JOIN faces_after f ON f.photo_id = e.photo_id AND f.face_key = e.face_key
   WHERE e.has_name AND NOT e.deleted AND trim(e.name) <> '' GROUP BY e.photo_id, lower(trim(e.name))),
 rows_ AS (SELECT photo_id, item, trim(name) AS name, lower(trim(name)) AS key FROM listed WHERE trim(name) <> ''),
 kept AS (SELECT r.*, row_number() OVER (PARTITION BY photo_id, key ORDER BY item) AS rn FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.photo_id = r.photo_id AND g.key = r.key))
 SELECT k.photo_id, k.item, CASE WHEN rn = 1 THEN coalesce(n.new_name, k.name) ELSE k.name END AS name FROM kept k LEFT JOIN newn n ON n.photo_id = k.photo_id AND n.key = k.key
 UNION ALL SELECT photo_id, NULL, new_name FROM newn n WHERE NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.photo_id = n.photo_id AND r.key = n.key)
   AND EXISTS (SELECT 1 FROM rows_ r WHERE r.photo_id = n.photo_id)""",
)
def _(spark, sf):
    return edits.list_people_sync(load(spark, sf, "listed"), _faces(spark, sf), _faces_after(spark, sf), load(spark, sf, "face_edits"))


_PAIRS = " UNION ALL ".join(f"SELECT photo_id, '{n}' AS field, {SQUEEZE.format(n)} AS v FROM {{0}}" for n in fixed.TEXT_FIELDS)


@query(
    "e10_check_written_text",
    "tags edits",
    BASE + LATEST + AFTER + f""", want AS ({_PAIRS.format('after')}), got AS ({_PAIRS.format('base')})
 SELECT w.photo_id, w.field FROM want w JOIN lt ON lt.photo_id = w.photo_id AND lt.field = w.field JOIN got g ON g.photo_id = w.photo_id AND g.field = w.field WHERE w.v <> g.v""",
)
def _(spark, sf):
    f = _fields(spark, sf)
    return edits.check_text_fields(edits.apply_edits(f, load(spark, sf, "edits")), f, _latest(spark, sf))


@query(
    "e10_check_written_dates",
    "tags edits",
    BASE
    + LATEST
    + AFTER
    + ", wd AS (SELECT a.photo_id, a.date AS value, a.certainty, b.date AS got FROM after a JOIN lt ON lt.photo_id = a.photo_id AND lt.field = 'date' JOIN base b ON b.photo_id = a.photo_id), "
    + ds.parsed("g", "wd", "photo_id, value, got, certainty", "got")
    + f""" SELECT photo_id, 'date' AS field FROM g WHERE coalesce(value, '') <> coalesce({ds.iso()}, {SQUEEZE.format('got')})""",
)
def _(spark, sf):
    f = normalize.normalize_fields(load(spark, sf, "tags"), ["date"]).select("photo_id", "date", F.lit(None).cast("string").alias("certainty"))
    return edits.check_dates(edits.apply_edits(f, load(spark, sf, "edits")), f, _latest(spark, sf), AS_OF)


@query(
    "e10_check_written_keywords",
    "tags keyword_edits",
    KEYWORDS_AFTER
    + """, a AS (SELECT DISTINCT photo_id, lower(keyword) AS k FROM ka), b AS (SELECT photo_id, keyword_key AS k FROM keywords)
 SELECT DISTINCT photo_id, 'keywords' AS field FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) AS d""",
)
def _(spark, sf):
    before, after = _keywords_after(spark, sf)
    return edits.check_keyword_sets(after, before)


@query(
    "e10_check_written_faces",
    "regions face_edits",
    FACES_AFTER
    + f""", c AS (SELECT photo_id, lower(name) AS k, count(*) AS n FROM faces_after GROUP BY photo_id, lower(name)),
 d AS (SELECT photo_id, lower(name) AS k, count(*) AS n FROM regions GROUP BY photo_id, lower(name))
 SELECT DISTINCT photo_id, 'faces' AS field FROM ((SELECT * FROM c EXCEPT SELECT * FROM d) UNION ALL (SELECT * FROM d EXCEPT SELECT * FROM c)
   UNION ALL SELECT photo_id, face_key, 0 FROM faces_after a WHERE name <> '' AND x IS NOT NULL AND NOT EXISTS
     (SELECT 1 FROM regions b WHERE b.photo_id = a.photo_id AND b.name = a.name AND {sql_iou()} > 0.95)) AS u""",
)
def _(spark, sf):
    return edits.check_faces(_faces_after(spark, sf), _faces(spark, sf))


@query(
    "e11_before_image",
    "tags edits",
    FIELDS
    + LATEST
    + PLAN
    + """, touched AS (SELECT DISTINCT p.photo_id, p.tag, replace(replace(replace(h.old, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS old
   FROM plan p JOIN have h ON h.photo_id = p.photo_id AND h.tag = p.tag WHERE p.action IS NOT NULL)
 SELECT photo_id, '{' || string_agg('"' || tag || '":"' || old || '"', ',' ORDER BY tag) || '}' AS before FROM touched GROUP BY photo_id""",
)
def _(spark, sf):
    tags = load(spark, sf, "tags")
    return edits.before_image(tags, _mirrored(spark, sf, tags))


@query(
    "e12_describe_changes",
    "tags edits",
    FIELDS
    + LATEST
    + """ SELECT l.photo_id, l.field, l.field || ': ' || coalesce(f.value, '(none)') || ' -> ' || coalesce(l.value, '(none)') AS change
 FROM lt l LEFT JOIN first f ON f.photo_id = l.photo_id AND f.field = l.field""",
)
def _(spark, sf):
    return edits.describe_changes(_fields(spark, sf), _latest(spark, sf))


@query(
    "e13_edit_count",
    "edits face_edits",
    """, a AS (SELECT DISTINCT photo_id, field AS what FROM edits UNION ALL SELECT DISTINCT photo_id, 'face ' || face_key FROM face_edits)
 SELECT photo_id, count(*) AS edits FROM a GROUP BY photo_id""",
)
def _(spark, sf):
    return edits.edit_count(load(spark, sf, "edits"), load(spark, sf, "face_edits"))


@query(
    "e14_draft_validity",
    "drafts photos",
    """, inv AS (SELECT '/archive/box/IMG_' || lpad(cast(photo_id AS varchar), 6, '0') || '.tif' AS path, size_bytes, mtime_ns, content_hash FROM photos WHERE format <> 'PNG')
 SELECT draft_no, d.path, CASE WHEN i.path IS NULL THEN 'missing' WHEN d.size_bytes = i.size_bytes AND d.mtime_ns = i.mtime_ns THEN 'valid'
   WHEN d.size_bytes = i.size_bytes AND d.quick_hash = i.content_hash THEN 'valid by content' ELSE 'stale' END AS status FROM drafts d LEFT JOIN inv i ON i.path = d.path""",
)
def _(spark, sf):
    inv = load(spark, sf, "photos").where("format <> 'PNG'").select(
        F.concat(F.lit("/archive/box/IMG_"), F.lpad(F.col("photo_id").cast("string"), 6, "0"), F.lit(".tif")).alias("path"),
        "size_bytes", "mtime_ns", F.col("content_hash").alias("quick_hash"),
    )
    return edits.draft_validity(load(spark, sf, "drafts"), inv)


@query(
    "e15_prune_drafts",
    "drafts",
    "SELECT draft_no, photo_id FROM drafts WHERE coalesce(updated, file_time) >= TIMESTAMP '2000-01-01' - INTERVAL 60 DAY",
)
def _(spark, sf):
    return edits.prune_drafts(load(spark, sf, "drafts"), "2000-01-01").select("draft_no", "photo_id")


@query(
    "e16_clear_superseded_drafts",
    "drafts",
    """, s AS (SELECT c_custkey AS photo_id, 's' || (c_custkey % 50) AS saved, c_custkey % 2 = 0 AS is_copy, c_custkey % 3 = 0 AS unhashed, c_custkey % 5 = 0 AS written FROM customer WHERE c_acctbal > 0)
 SELECT draft_no, d.photo_id, CASE WHEN s.saved IS NULL THEN 'keep' WHEN coalesce(d.state_hash = s.saved, false) AND is_copy AND has_details THEN 'keep details'
   WHEN coalesce(d.state_hash = s.saved, false) OR (unhashed AND d.state_hash IS NULL AND NOT is_copy) OR (written AND NOT is_copy AND has_details AND NOT has_caption_edits) THEN 'delete'
   ELSE 'keep' END AS action FROM drafts d LEFT JOIN s ON s.photo_id = d.photo_id""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    saves = load(spark, sf, "customer").where("c_acctbal > 0").select(
        k.alias("photo_id"), F.concat(F.lit("s"), (k % 50).cast("string")).alias("state_hash"), (k % 2 == 0).alias("is_copy"),
        (k % 3 == 0).alias("unhashed"), (k % 5 == 0).alias("details_written"),
    )
    return edits.clear_superseded_drafts(load(spark, sf, "drafts"), saves)


@query(
    "e17_stat_change",
    "scan_before scan_after",
    """SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
   WHEN a.size_bytes = b.size_bytes AND a.mtime_ns = b.mtime_ns AND a.file_id = b.file_id THEN 'unchanged'
   WHEN a.size_bytes = b.size_bytes AND a.content_hash = b.content_hash THEN 'touched' ELSE 'changed' END AS change
 FROM scan_before b FULL JOIN scan_after a ON a.path = b.path""",
)
def _(spark, sf):
    return edits.stat_change(load(spark, sf, "scan_before"), load(spark, sf, "scan_after"))
