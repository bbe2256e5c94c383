"""Registered caption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.functions import captions as cf
from photocat.functions import dates, text
from photocat.functions.captions import group, lit, tok
from photocat.operators import captions, normalize, people
from photocat.plans import date_sql as ds
from photocat.plans.q_metadata import FIELDS, KEYWORDS, MARKER
from photocat.plans.q_people import LABELS, ROWS
from photocat.plans.registry import query
from photocat.plans.views import load

AS_OF = ds.AS_OF

_COLS = ["title", "city", "sublocation", "creator", "notes"]
CF = (
    FIELDS
    + ", cb AS (SELECT photo_id, "
    + ", ".join(f"max(CASE WHEN field = '{n}' THEN value END) AS {n}" for n in _COLS + ["date"])
    + " FROM first GROUP BY photo_id), "
    + ds.parsed("cp", "cb", "photo_id, title, city, sublocation, creator, notes, date", "date")
    + """, ppl AS (SELECT photo_id, list(name ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, x + w / 2, y + h / 2, region_no) AS l
     FROM regions WHERE name <> '' GROUP BY photo_id), cf AS (SELECT cp.photo_id, """
    + ", ".join(f"coalesce(trim({n}), '') AS {n}" for n in _COLS)
    + f""", CASE WHEN y IS NULL THEN {ds.rough('date')} ELSE {ds.in_words()} END AS date_text,
   CASE WHEN l IS NULL THEN '' WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[-1] END AS names
   FROM cp LEFT JOIN ppl ON ppl.photo_id = cp.photo_id)"""
)


def _fields(spark, sf):
    f = normalize.normalize_fields(load(spark, sf, "tags")).withColumn("date_text", dates.rendered_date(F.col("date"), AS_OF))
    n = people.names_in_order(people.named(load(spark, sf, "regions"))).select("photo_id", text.join_names(F.col("names")).alias("names"))
    return f.select("photo_id", *_COLS, "date_text").join(n, "photo_id", "left")


TEMPLATE = {
    "band": [
        tok("title"), lit("\n"), tok("date_text"), group(lit(", "), tok("city")), lit("\n"), tok("names"),
        group(lit(" (photo: "), tok("creator", case="upper"), lit(")")),
    ],
    "foot": [group(tok("sublocation"), group(lit(" - "), tok("city"))), lit(" "), tok("notes", max=30)],
}
# the notes are ASCII words; 30 characters, the cut at a word end near it
NOTES30 = """CASE WHEN length(notes) > 30 THEN regexp_replace(CASE WHEN regexp_matches(substr(notes, 29, 2), '^[\\pL\\pN\\pM]{2}$')
   AND length(regexp_extract(substr(notes, 1, 29), '(?s)^(.*)[ \\n]', 1)) >= 0.6 * 29 THEN regexp_extract(substr(notes, 1, 29), '(?s)^(.*)[ \\n]', 1)
   ELSE substr(notes, 1, 29) END, '\\s+$', '') || '…' ELSE notes END"""


@query(
    "c1_render_captions",
    "tags regions",
    CF
    + f""" SELECT photo_id, 'band' AS block, concat_ws(chr(10), nullif(title, ''), nullif(date_text || CASE WHEN city <> '' THEN ', ' || city ELSE '' END, ''),
     nullif(trim(names || CASE WHEN creator <> '' THEN ' (photo: ' || upper(creator) || ')' ELSE '' END), '')) AS caption FROM cf
 UNION ALL SELECT photo_id, 'foot', trim(CASE WHEN sublocation <> '' THEN sublocation || CASE WHEN city <> '' THEN ' - ' || city ELSE '' END ELSE '' END
   || ' ' || {NOTES30}) FROM cf""",
)
def _(spark, sf):
    return captions.render_captions(_fields(spark, sf), TEMPLATE)


OPTIONS_SQL = (
    KEYWORDS
    + ROWS
    + LABELS.replace("Front row, L–R: ", "Front: ").replace("Back row, L–R: ", "Back: ").replace("Middle row, L–R: ", "Middle: ")
    + """, line AS (SELECT r.photo_id, r.row_no, list(name ORDER BY cx DESC, -cy DESC, region_no DESC) AS l FROM rowed r GROUP BY r.photo_id, r.row_no),
 said AS (SELECT l.photo_id, max(n_rows) AS n_rows, string_agg(label || CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], '; ') || ' & ' || l[-1] END,
     ' / ' ORDER BY l.row_no) AS by_rows FROM line l JOIN labelled b ON b.photo_id = l.photo_id AND b.row_no = l.row_no GROUP BY l.photo_id),
 flat AS (SELECT photo_id, bool_and(x IS NOT NULL) AS placed, list(name ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, -(x + w / 2), -(y + h / 2), CASE WHEN x IS NULL THEN region_no ELSE -region_no END) AS l
   FROM regions WHERE name <> '' GROUP BY photo_id),
 who AS (SELECT f.photo_id, len(l) AS n, CASE WHEN placed AND n_rows > 1 THEN by_rows WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], '; ') || ' & ' || l[-1] END AS names
   FROM flat f LEFT JOIN said s ON s.photo_id = f.photo_id),
 few AS (SELECT photo_id, string_agg(keyword, ' + ' ORDER BY src_rank, item) AS words FROM keywords k WHERE NOT regexp_matches(keyword_key, '^(scan|people)([^\\pL\\pN\\pM]|$)')
   AND NOT """
    + MARKER
    + """ AND NOT EXISTS (SELECT 1 FROM paths p WHERE p.photo_id = k.photo_id AND regexp_matches(lower(p.path), '^(scan|people)([^\\pL\\pN\\pM]|$)')
     AND lower(trim(list_extract(string_split(p.path, '|'), -1))) = k.keyword_key) GROUP BY photo_id),
 dt AS (SELECT c_custkey AS photo_id, c_custkey % 5 AS k FROM customer)
 SELECT dt.photo_id, 'all' AS block, concat_ws(chr(10), nullif(coalesce(names, '') || CASE WHEN n IS NOT NULL THEN ' (' || n || ')' ELSE '' END, ''), words,
   CASE k WHEN 0 THEN 'around June 14, 1952' WHEN 1 THEN 'June 1952' WHEN 2 THEN 'around 1952' WHEN 3 THEN 'June 14' ELSE 'June 14, 1952' END || ', 1952-06-14') AS caption
 FROM dt LEFT JOIN who USING (photo_id) LEFT JOIN few USING (photo_id)"""
)


@query("c1_caption_options", "tags regions paths", OPTIONS_SQL)
def _(spark, sf):
    k = F.col("c_custkey") % 5
    rating = F.when(k == 0, "Y!M!D~").when(k == 1, "Y!M!D?").when(k == 2, "Y~").when(k == 3, "Y?M!D!")
    fields = load(spark, sf, "customer").select(F.col("c_custkey").alias("photo_id"), F.lit("1952:06:14").alias("date"), rating.alias("rated"))
    who = tok("names", rows=True, order="rl", sep="; ", last=" & ", row_sep=" / ", labels=["Front: ", " Middle: ", "", "Back: "])
    items = [
        who, group(lit(" ("), tok("names.count"), lit(")")), lit("\n"), tok("keywords", sep=" + ", exclude=["scan", "people"]), lit("\n"),
        tok("date", as_of=AS_OF, certainty="rated", circa="around "), lit(", "), tok("date", as_of=AS_OF, fmt="yyyy-mm-dd"),
    ]
    sources = captions.Sources(fields, load(spark, sf, "regions"), normalize.merge_keywords(load(spark, sf, "tags")), load(spark, sf, "paths"))
    return captions.render_captions(sources, {"all": items})


@query(
    "c2_optional_group",
    "tags regions",
    CF
    + """ SELECT photo_id, trim(title || CASE WHEN city <> '' THEN ' (' || city || CASE WHEN sublocation <> '' THEN ', ' || sublocation ELSE '' END || ')' ELSE '' END) AS nested,
   trim(title || CASE WHEN sublocation <> '' THEN ' at ' || sublocation ELSE '' END) AS rendered_inside FROM cf""",
)
def _(spark, sf):
    nested = [tok("title"), group(lit(" ("), tok("city"), group(lit(", "), tok("sublocation")), lit(")"))]
    inside = [tok("title"), group(lit(" at "), group(tok("sublocation")))]
    return _fields(spark, sf).select("photo_id", cf.caption(nested).alias("nested"), cf.caption(inside).alias("rendered_inside"))


@query(
    "c3_text_case",
    "",
    """SELECT p_partkey AS photo_id, upper(p_name) AS upper_case, lower(p_name) AS lower_case, array_to_string(list_transform(string_split(p_name, ' '),
   lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title_case FROM part""",
)
def _(spark, sf):
    n = F.col("p_name")
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("photo_id"), *[text.text_case(n, c).alias(c + "_case") for c in ("upper", "lower", "title")]
    )


def _cut_sql(n):
    head, space = f"substr(text, 1, {n - 1})", f"length(regexp_extract(substr(text, 1, {n - 1}), '(?s)^(.*)[ \\n]', 1))"
    return f"""CASE WHEN length(text) > {n} THEN regexp_replace(CASE WHEN regexp_matches(substr(text, {n - 1}, 2), '^[\\pL\\pN\\pM]{{2}}$')
   AND {space} >= 0.6 * {n - 1} AND regexp_matches({head}, '[ \\n]') THEN substr(text, 1, {space}) ELSE {head} END, '\\s+$', '') || '…' ELSE text END"""


@query(
    "c4_truncate_words",
    "",
    f"SELECT doc_id, md5({_cut_sql(200)}) AS cut_200, {_cut_sql(20)} AS cut_20, substr(text, 1, 1) AS cut_1, md5(text) AS whole FROM documents",
)
def _(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.md5(text.truncate_words(t, 200)).alias("cut_200"), text.truncate_words(t, 20).alias("cut_20"),
        text.truncate_words(t, 1).alias("cut_1"), F.md5(text.truncate_words(t, 0)).alias("whole"),
    )


@query(
    "c5_tidy_lines",
    "",
    """, l AS (SELECT c_custkey AS photo_id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS a, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS b,
   CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'end' END AS c FROM customer)
 SELECT photo_id, CASE WHEN a = '' AND b = '' THEN c WHEN a = '' THEN b || CASE WHEN c <> '' THEN chr(10) || chr(10) || c ELSE '' END
   WHEN b = '' THEN a || CASE WHEN c <> '' THEN chr(10) || chr(10) || c ELSE '' END
   ELSE a || chr(10) || chr(10) || b || CASE WHEN c <> '' THEN chr(10) || chr(10) || c ELSE '' END END AS tidy FROM l""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    mark = F.lit(text.EMPTY_MARK)
    lines = [
        F.when(k % 2 == 0, mark).otherwise(F.col("c_name")), F.lit(""),
        F.when(k % 3 == 0, F.concat(F.lit(" "), mark, F.lit(" "))).otherwise(F.col("c_mktsegment")), F.lit(""),
        F.when(k % 5 == 0, mark).otherwise(F.lit("end")),
    ]
    return load(spark, sf, "customer").select(k.alias("photo_id"), text.tidy_lines(F.concat_ws("\n", *lines)).alias("tidy"))


@query("c6_markup_to_plain", "", "SELECT doc_id, md5(text) AS plain, length(text) AS chars FROM documents")
def _(spark, sf):
    styled = F.concat(F.lit("**"), text.escape_markup(F.col("text")), F.lit("*"))
    plain = text.markup_to_plain(styled)
    return load(spark, sf, "documents").select("doc_id", F.md5(plain).alias("plain"), F.length(plain).cast("long").alias("chars"))


COVERAGE = (
    CF
    + """, cov AS (SELECT photo_id, 'band' AS block, 'title' AS token, false AS expected FROM cf WHERE title = ''
 UNION ALL SELECT photo_id, 'band', 'date_text', false FROM cf WHERE date_text = '' UNION ALL SELECT photo_id, 'band', 'city', true FROM cf WHERE city = ''
 UNION ALL SELECT photo_id, 'band', 'names', false FROM cf WHERE names = '' UNION ALL SELECT photo_id, 'band', 'creator', true FROM cf WHERE creator = ''
 UNION ALL SELECT photo_id, 'foot', 'sublocation', true FROM cf WHERE sublocation = '' UNION ALL SELECT photo_id, 'foot', 'city', true FROM cf WHERE city = ''
 UNION ALL SELECT photo_id, 'foot', 'notes', false FROM cf WHERE notes = '')"""
)


@query("c7_caption_coverage", "tags regions", COVERAGE + " SELECT photo_id, block, token, expected FROM cov")
def _(spark, sf):
    return captions.caption_coverage(_fields(spark, sf), TEMPLATE)


@query("c7_coverage_totals", "tags regions", COVERAGE + " SELECT block, token, count(*) AS photos FROM cov GROUP BY block, token")
def _(spark, sf):
    return captions.coverage_totals(captions.caption_coverage(_fields(spark, sf), TEMPLATE))


@query(
    "c8_safe_file_name",
    "",
    """, n AS (SELECT doc_id, regexp_replace(regexp_replace(replace(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'con.' || text WHEN 2 THEN '.. <a>:' || text ELSE ' ' END,
     chr(10), ' '), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name FROM documents),
 c AS (SELECT doc_id, CASE WHEN strlen(name) > 200 THEN regexp_replace(substr(name, 1, list_max(list_filter(range(1, 201), lambda i: strlen(substr(name, 1, i)) <= 200))),
     '^[ .]+|[ .]+$', '', 'g') ELSE name END AS name FROM n)
 SELECT doc_id, CASE WHEN name = '' THEN 'doc' || doc_id WHEN upper(split_part(name, '.', 1)) = 'CON' THEN '_' || name ELSE name END AS file_name FROM c""",
)
def _(spark, sf):
    k, t = F.col("doc_id") % 4, F.col("text")
    raw = F.when(k == 0, t).when(k == 1, F.concat(F.lit("con."), t)).when(k == 2, F.concat(F.lit(".. <a>:"), t)).otherwise(" ")
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return load(spark, sf, "documents").select("doc_id", text.safe_file_name(raw, stem).alias("file_name"))


DEST = """, d AS (SELECT photo_id, path, format, regexp_extract(path, '^(.*)/[^/]*$', 1) AS src, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM photos),
 dest AS (SELECT photo_id, src || '/captioned/' || stem || '-captioned' || CASE WHEN format = 'JPEG' THEN regexp_extract(path, '\\.[A-Za-z]+$') ELSE '.jpg' END AS copy_dest,
   CASE WHEN format = 'HEIC' THEN NULL ELSE src || '/' || stem || '-captioned' || regexp_extract(path, '\\.[A-Za-z]+$') END AS same_dest FROM d)"""


@query("c9_plan_destinations", "photos", DEST + " SELECT photo_id, copy_dest, same_dest FROM dest")
def _(spark, sf):
    p = load(spark, sf, "photos")
    copy = captions.plan_destinations(p, {"location": "subfolder", "outputFormat": "jpeg"}, [tok("stem"), lit("-captioned")])
    same = captions.plan_destinations(p, {"location": "same"}, [tok("stem")])
    return copy.select("photo_id", F.col("dest").alias("copy_dest")).join(same.select("photo_id", F.col("dest").alias("same_dest")), "photo_id")


WANTED = """, w AS (SELECT o_orderkey AS photo_id, o_orderkey AS idx, 'IMG_' || (o_custkey % 50) || CASE WHEN o_custkey % 97 = 0 THEN '-5' ELSE '' END AS name FROM orders),
 taken AS (SELECT DISTINCT lower('/out/IMG_' || (p_partkey % 70) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || (2 + p_partkey % 90) END || '.tif') AS path FROM part)"""


def _wanted(spark, sf):
    w = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("photo_id"), F.col("o_orderkey").alias("idx"), F.lit("/out").alias("folder"),
        F.concat(F.lit("IMG_"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_custkey") % 97 == 0, "-5").otherwise("")).alias("name"),
        F.lit(".tif").alias("ext"),
    )
    k = F.col("p_partkey")
    taken = load(spark, sf, "part").select(
        F.concat(F.lit("/out/IMG_"), (k % 70).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("-"), (2 + k % 90).cast("string"))), F.lit(".tif")).alias("path"),
        k.alias("owner_id"),
    )
    return w, taken


COLLISIONS = (
    WANTED
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY idx) AS k, lower('/out/' || name || '.tif') IN (SELECT path FROM taken) AS on_disk FROM w),
 own AS (SELECT DISTINCT lower('/out/' || name || '.tif') AS path FROM r WHERE k = 1 AND NOT on_disk),
 want AS (SELECT *, CASE WHEN on_disk THEN k ELSE k - 1 END AS pos FROM r),
 most AS (SELECT name, max(pos) + 100 AS top FROM want GROUP BY name),
 free AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS pos FROM (SELECT name, unnest(generate_series(2, top)) AS n FROM most) AS g
   WHERE lower('/out/' || name || '-' || n || '.tif') NOT IN (SELECT path FROM taken) AND lower('/out/' || name || '-' || n || '.tif') NOT IN (SELECT path FROM own)),
 final AS (SELECT w.photo_id, '/out/' || w.name || CASE WHEN w.pos > 0 THEN '-' || f.n ELSE '' END || '.tif' AS dest FROM want w LEFT JOIN free f ON f.name = w.name AND f.pos = w.pos)"""
)


@query("c10_resolve_name_collisions", "", COLLISIONS + " SELECT photo_id, dest FROM final")
def _(spark, sf):
    return captions.resolve_name_collisions(*_wanted(spark, sf))


@query(
    "c11_overwrite_policy",
    "",
    WANTED
    + """, owners AS (SELECT lower('/out/IMG_' || (p_partkey % 70) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || (2 + p_partkey % 90) END || '.tif') AS path, min(p_partkey) AS owner_id
   FROM part GROUP BY 1)
 SELECT photo_id, CASE WHEN o.path IS NULL THEN 'write' ELSE 'conflict' END AS ask, CASE WHEN o.path IS NULL THEN 'write' WHEN o.owner_id = photo_id THEN 'replace' ELSE 'count up' END AS overwrite
 FROM w LEFT JOIN owners o ON o.path = lower('/out/' || name || '.tif')""",
)
def _(spark, sf):
    w, taken = _wanted(spark, sf)
    planned = w.withColumn("dest", F.concat("folder", F.lit("/"), "name", "ext"))
    taken = taken.groupBy("path").agg(F.min("owner_id").alias("owner_id"))
    ask = captions.overwrite_policy(planned, taken, "ask").select("photo_id", F.col("decision").alias("ask"))
    over = captions.overwrite_policy(planned, taken, "overwrite").select("photo_id", F.col("decision").alias("overwrite"))
    return ask.join(over, "photo_id")
