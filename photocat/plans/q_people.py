"""Registered face and people queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.functions import boxes, text
from photocat.operators import normalize, people
from photocat.plans.registry import query
from photocat.plans.views import load

XYWH = ["x", "y", "w", "h"]


def sql_iou(a="a", b="b", pa="", pb=""):
    ax, ay, aw, ah = (f"{a}.{pa}{c}" for c in XYWH)
    bx, by, bw, bh = (f"{b}.{pb}{c}" for c in XYWH)
    inter = (
        f"greatest(0.0, least({ax} + {aw}, {bx} + {bw}) - greatest({ax}, {bx}))"
        f" * greatest(0.0, least({ay} + {ah}, {by} + {bh}) - greatest({ay}, {by}))"
    )
    return (
        f"(CASE WHEN {ax} IS NULL OR {bx} IS NULL THEN 0.0 WHEN {aw} * {ah} + {bw} * {bh} - {inter} > 0"
        f" THEN {inter} / ({aw} * {ah} + {bw} * {bh} - {inter}) ELSE 0.0 END)"
    )


def sql_orient(o="orientation", x="x", y="y", w="w", h="h"):
    r, b = f"1 - {x} - {w}", f"1 - {y} - {h}"
    table = {2: (r, y, w, h), 3: (r, b, w, h), 4: (x, b, w, h), 5: (y, x, h, w), 6: (b, x, h, w), 7: (b, r, h, w), 8: (y, r, h, w)}
    return [
        f"(CASE {o} " + " ".join(f"WHEN {k} THEN {t[i]}" for k, t in table.items()) + f" ELSE {(x, y, w, h)[i]} END)"
        for i in range(4)
    ]


def r6(e, name):
    return f"round({e}, 6) AS {name}"


_NUM = "cast('0.' || cast(3 + photo_id % 4 AS varchar) AS double)"
_EXPECTED = f"""SELECT photo_id, orientation, 'mwg:0' AS region_id, 'MWG' AS source, 'Ann ' || (photo_id % 9) AS name,
   CASE WHEN photo_id % 4 <> 0 THEN {_NUM} - 0.1 / 2 END AS x, CASE WHEN photo_id % 4 <> 0 THEN 0.5 - 0.2 / 2 END AS y, 0.1 AS w, 0.2 AS h FROM region_docs
 UNION ALL SELECT photo_id, orientation, 'mwg:1', 'MWG', 'Rex', NULL, NULL, 0.1, 0.1 FROM region_docs WHERE photo_id % 3 <> 0
 UNION ALL SELECT photo_id, orientation, 'mp:0', 'MP', 'Ann ' || (photo_id % 9),
   CASE WHEN photo_id % 6 <> 0 THEN cast('0.' || (25 + photo_id % 50) AS double) END, CASE WHEN photo_id % 6 <> 0 THEN 0.4 END, 0.1, 0.2 FROM region_docs"""
_O = sql_orient(x="cast(x AS double)", y="cast(y AS double)", w="cast(w AS double)", h="cast(h AS double)")


@query(
    "f1_explode_regions",
    "region_docs",
    f", e AS ({_EXPECTED}) SELECT photo_id, region_id, source, name, "
    + ", ".join(r6(f"CASE WHEN x IS NOT NULL THEN {v} END", n) for v, n in zip(_O, XYWH))
    + " FROM e",
)
def _(spark, sf):
    docs = load(spark, sf, "region_docs").withColumns({"width": F.lit(3000), "height": F.lit(2000)})
    r = people.explode_regions(docs)
    return r.select("photo_id", "region_id", "source", "name", *[F.round(c, 6).alias(c) for c in XYWH])


_JOINED = ", r AS (SELECT r.*, p.orientation, p.width, p.height FROM regions r JOIN photos p ON p.photo_id = r.photo_id WHERE r.x IS NOT NULL)"


def _with_photo(spark, sf):
    r = load(spark, sf, "regions").where("x IS NOT NULL")
    return r.join(load(spark, sf, "photos").select("photo_id", "orientation", "width", "height"), "photo_id")


@query("f2_orient_box", "regions photos", _JOINED + " SELECT region_no, " + ", ".join(r6(v, n) for v, n in zip(sql_orient(), XYWH)) + " FROM r")
def _(spark, sf):
    b = _with_photo(spark, sf).withColumn("b", boxes.orient(F.col("orientation"), *[F.col(c) for c in XYWH]))
    return b.select("region_no", *[F.round(F.col("b")[c], 6).alias(c) for c in XYWH])


@query(
    "f3_unorient_box",
    "regions photos",
    _JOINED + " SELECT region_no, " + ", ".join(r6(v, n) for v, n in zip(sql_orient("(CASE orientation WHEN 6 THEN 8 WHEN 8 THEN 6 ELSE orientation END)"), XYWH)) + " FROM r",
)
def _(spark, sf):
    b = _with_photo(spark, sf).withColumn("b", boxes.unorient(F.col("orientation"), *[F.col(c) for c in XYWH]))
    return b.select("region_no", *[F.round(F.col("b")[c], 6).alias(c) for c in XYWH])


_DECLARED = """, d AS (SELECT photo_id, orientation, cast(width AS double) AS width, cast(height AS double) AS height,
   CASE WHEN photo_id % 3 = 0 THEN height WHEN photo_id % 3 = 1 THEN width * 0.5 END AS applied_w,
   CASE WHEN photo_id % 3 = 0 THEN width WHEN photo_id % 3 = 1 THEN height * 0.5 END AS applied_h, photo_id % 10 = 0 AS rotated FROM photos)"""


def _declared(spark, sf):
    third = F.col("photo_id") % 3
    return load(spark, sf, "photos").select(
        "photo_id", "orientation", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"),
        F.when(third == 0, F.col("height").cast("double")).when(third == 1, F.col("width") * 0.5).alias("applied_w"),
        F.when(third == 0, F.col("width").cast("double")).when(third == 1, F.col("height") * 0.5).alias("applied_h"),
        (F.col("photo_id") % 10 == 0).alias("rotated"),
    )


@query(
    "f4_region_frame",
    "photos",
    _DECLARED
    + """ SELECT photo_id, CASE WHEN orientation >= 5 AND applied_w IS NOT NULL AND NOT rotated
     AND abs(ln(applied_w / applied_h) - ln(height / width)) < abs(ln(applied_w / applied_h) - ln(width / height)) THEN 1
     ELSE cast(orientation AS int) END AS frame FROM d""",
)
def _(spark, sf):
    frame = boxes.region_frame(*[F.col(c) for c in ("orientation", "applied_w", "applied_h", "width", "height", "rotated")])
    return _declared(spark, sf).select("photo_id", frame.alias("frame"))


@query(
    "f5_dims_mismatch",
    "photos",
    _DECLARED
    + """ SELECT photo_id, coalesce((abs(applied_w - width) / width > 0.01 OR abs(applied_h - height) / height > 0.01)
     AND (orientation < 5 OR abs(applied_w - height) / height > 0.01 OR abs(applied_h - width) / width > 0.01), false) AS mismatch FROM d""",
)
def _(spark, sf):
    off = boxes.dims_mismatch(*[F.col(c) for c in ("orientation", "applied_w", "applied_h", "width", "height")])
    return _declared(spark, sf).select("photo_id", off.alias("mismatch"))


@query(
    "f6_iou",
    "regions face_edits",
    f"""SELECT r.region_no, round({sql_iou('r', 'e', '', 'was_')}, 6) AS iou FROM regions r JOIN face_edits e
     ON e.photo_id = r.photo_id AND e.face_key = cast(r.region_no AS varchar)""",
)
def _(spark, sf):
    e = load(spark, sf, "face_edits").select("photo_id", "face_key", *[F.col("was_" + c).alias("r" + c) for c in XYWH])
    r = load(spark, sf, "regions").withColumn("face_key", F.col("region_no").cast("string"))
    return r.join(e, ["photo_id", "face_key"]).select("region_no", F.round(boxes.iou(), 6).alias("iou"))


FOLD = f""", fold AS (SELECT a.photo_id, a.region_no, min(b.region_no) AS into_no FROM regions a JOIN regions b
   ON a.photo_id = b.photo_id AND a.source = 'MP' AND b.source = 'MWG' AND lower(a.name) = lower(b.name)
   AND ({sql_iou()} > 0.5 OR (a.name <> '' AND (a.x IS NULL OR b.x IS NULL))) GROUP BY a.photo_id, a.region_no),
 kept AS (SELECT r.* FROM regions r WHERE NOT EXISTS (SELECT 1 FROM fold f WHERE f.photo_id = r.photo_id AND f.region_no = r.region_no)),
 onto AS (SELECT photo_id, region_no, into_no FROM (SELECT a.photo_id, a.region_no, b.region_no AS into_no,
     row_number() OVER (PARTITION BY a.photo_id, a.region_no ORDER BY CASE b.source WHEN 'MWG' THEN 0 ELSE 1 END, b.region_no) AS rn
   FROM kept a JOIN kept b ON a.photo_id = b.photo_id AND a.name = '' AND b.name <> '' AND {sql_iou()} > 0.5) AS x WHERE rn = 1),
 faces AS (SELECT k.* FROM kept k WHERE NOT EXISTS (SELECT 1 FROM onto o WHERE o.photo_id = k.photo_id AND o.region_no = k.region_no))"""


@query("f7_dedup_regions_across_sources", "regions", FOLD + " SELECT photo_id, region_no FROM kept")
def _(spark, sf):
    return people.dedup_regions_across_sources(load(spark, sf, "regions")).select("photo_id", "region_no")


@query("f7_folded_into", "regions", FOLD + " SELECT photo_id, region_no, into_no FROM fold")
def _(spark, sf):
    return people.fold_sources(load(spark, sf, "regions"))


@query("f8_suppress_unnamed_on_named", "regions", FOLD + " SELECT photo_id, region_no, name FROM faces")
def _(spark, sf):
    return people.settled_faces(load(spark, sf, "regions")).select("photo_id", "region_no", "name")


PII = """, pii AS (SELECT photo_id, item, trim(name) AS name, row_number() OVER (PARTITION BY photo_id, lower(trim(name)) ORDER BY item) AS rn
   FROM listed l WHERE trim(name) <> '' AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = l.photo_id AND lower(f.name) = lower(trim(l.name)))),
 everyone AS (SELECT photo_id, region_no, source, name, x, y, w, h FROM faces
   UNION ALL SELECT photo_id, item, 'listed', name, NULL, NULL, NULL, NULL FROM pii WHERE rn = 1)"""


def _everyone(spark, sf):
    kept = people.settled_faces(load(spark, sf, "regions"))
    return people.append_listed_people(kept, load(spark, sf, "listed"))


@query("f9_append_listed_people", "regions listed", FOLD + PII + " SELECT photo_id, region_no, source, name FROM everyone")
def _(spark, sf):
    return _everyone(spark, sf).select("photo_id", "region_no", "source", "name")


@query(
    "f9_face_keys",
    "regions",
    FOLD
    + """, via AS (SELECT r.photo_id, r.region_no, r.source, f.into_no, coalesce(f.into_no, r.region_no) AS via FROM regions r
   LEFT JOIN fold f ON f.photo_id = r.photo_id AND f.region_no = r.region_no),
 home AS (SELECT v.*, o.into_no AS onto_no, coalesce(o.into_no, v.via) AS face FROM via v LEFT JOIN onto o ON o.photo_id = v.photo_id AND o.region_no = v.via)
 SELECT photo_id, face AS region_no, string_agg(lower(source) || ':' || region_no, '+' ORDER BY
   CASE WHEN onto_no IS NOT NULL THEN 2 WHEN into_no IS NOT NULL THEN 1 ELSE 0 END,
   CASE WHEN onto_no IS NULL THEN 0 WHEN into_no IS NOT NULL THEN 0 WHEN source = 'MWG' THEN 0 ELSE 1 END,
   via, CASE WHEN into_no IS NOT NULL THEN 1 ELSE 0 END, region_no) AS face_key FROM home GROUP BY photo_id, face""",
)
def _(spark, sf):
    return people.face_keys(load(spark, sf, "regions"))


@query(
    "f10_region_warnings",
    "regions listed photos",
    FOLD
    + PII
    + _DECLARED
    + """, n AS (SELECT photo_id, bool_or(name <> '' AND x IS NULL) AS unplaced FROM everyone GROUP BY photo_id)
 SELECT d.photo_id, concat_ws('; ', CASE WHEN coalesce((abs(applied_w - width) / width > 0.01 OR abs(applied_h - height) / height > 0.01)
     AND (orientation < 5 OR abs(applied_w - height) / height > 0.01 OR abs(applied_h - width) / width > 0.01), false) THEN 'region dimensions mismatch' END,
   CASE WHEN unplaced THEN 'names without positions' END, CASE WHEN n.photo_id IS NULL THEN 'no face regions' END) AS warnings
 FROM d LEFT JOIN n ON n.photo_id = d.photo_id""",
)
def _(spark, sf):
    w = people.region_warnings(_everyone(spark, sf), _declared(spark, sf))
    return w.select("photo_id", F.array_join("warnings", "; ").alias("warnings"))


@query(
    "f11_order_names",
    "regions",
    """SELECT photo_id, region_no, row_number() OVER (PARTITION BY photo_id ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END,
     x + w / 2, y + h / 2, region_no) AS left_right,
   row_number() OVER (PARTITION BY photo_id ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, -(x + w / 2), -(y + h / 2),
     CASE WHEN x IS NULL THEN region_no ELSE -region_no END) AS right_left FROM regions WHERE name <> ''""",
)
def _(spark, sf):
    n = people.named(load(spark, sf, "regions"))
    lr = people.order_names(n, "lr").select("photo_id", "region_no", F.col("pos").alias("left_right"))
    rl = people.order_names(n, "rl").select("photo_id", "region_no", F.col("pos").alias("right_left"))
    return lr.join(rl, ["photo_id", "region_no"])


ROWS = """, pos AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM regions WHERE name <> '' AND x IS NOT NULL),
 steps AS (SELECT *, lag(cy) OVER (PARTITION BY photo_id ORDER BY -cy, region_no) - cy AS gap,
     row_number() OVER (PARTITION BY photo_id ORDER BY -cy, region_no) AS place FROM pos),
 limits AS (SELECT photo_id, greatest(0.6 * median(h), least(1.2 * median(h), 2.5 * median(gap))) AS cut FROM steps GROUP BY photo_id),
 rowed AS (SELECT s.*, 1 + sum(CASE WHEN gap >= cut THEN 1 ELSE 0 END) OVER (PARTITION BY s.photo_id ORDER BY place
     ROWS UNBOUNDED PRECEDING) AS row_no FROM steps s JOIN limits l ON l.photo_id = s.photo_id)"""


@query("f12_cluster_rows", "regions", ROWS + " SELECT photo_id, region_no, cast(row_no AS bigint) AS row_no FROM rowed")
def _(spark, sf):
    return people.cluster_rows(people.named(load(spark, sf, "regions"))).select("photo_id", "region_no", "row_no")


@query(
    "f13_cluster_rows_k",
    "regions",
    ROWS
    + """, top AS (SELECT photo_id, place FROM (SELECT photo_id, place, row_number() OVER (PARTITION BY photo_id ORDER BY gap DESC, place) AS r
   FROM steps WHERE gap IS NOT NULL) AS g WHERE r <= 2)
 SELECT s.photo_id, s.region_no, 1 + count(t.place) AS row_no FROM steps s LEFT JOIN top t ON t.photo_id = s.photo_id AND t.place <= s.place
 GROUP BY s.photo_id, s.region_no""",
)
def _(spark, sf):
    return people.cluster_rows_k(people.named(load(spark, sf, "regions")), 3).select("photo_id", "region_no", "row_no")


LABELS = """, rows_of AS (SELECT photo_id, max(row_no) AS n_rows FROM rowed GROUP BY photo_id),
 labelled AS (SELECT r.photo_id, r.row_no, n_rows, CASE WHEN n_rows = 1 THEN '' WHEN r.row_no = 1 THEN 'Front row, L–R: '
     WHEN r.row_no = n_rows THEN 'Back row, L–R: ' WHEN n_rows = 3 THEN 'Middle row, L–R: '
     ELSE 'Row ' || cast(r.row_no AS bigint) || ', L–R: ' END AS label FROM (SELECT DISTINCT photo_id, row_no FROM rowed) r
   JOIN rows_of o ON o.photo_id = r.photo_id)"""


@query("f14_row_label", "regions", ROWS + LABELS + " SELECT photo_id, cast(row_no AS bigint) AS row_no, label FROM labelled")
def _(spark, sf):
    rows = people.cluster_rows(people.named(load(spark, sf, "regions"))).select("photo_id", "row_no").distinct()
    rows = rows.join(rows.groupBy("photo_id").agg(F.max("row_no").alias("n_rows")), "photo_id")
    return rows.select("photo_id", "row_no", people.row_label(F.col("row_no"), F.col("n_rows")).alias("label"))


@query(
    "f15_join_names",
    "regions",
    """, n AS (SELECT photo_id, list(name ORDER BY region_no) AS l FROM regions WHERE name <> '' GROUP BY photo_id)
 SELECT photo_id, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[-1] END AS names FROM n""",
)
def _(spark, sf):
    n = people.names_in_order(people.named(load(spark, sf, "regions")), "meta")
    return n.select("photo_id", text.join_names(F.col("names")).alias("names"))


@query(
    "f16_names_rows_text",
    "regions",
    ROWS
    + LABELS
    + """, line AS (SELECT r.photo_id, r.row_no, list(name ORDER BY cx, -cy, region_no) AS l FROM rowed r GROUP BY r.photo_id, r.row_no),
 said AS (SELECT l.photo_id, max(n_rows) AS n_rows, string_agg(label || CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[-1] END,
     '; ' ORDER BY l.row_no) AS by_rows FROM line l JOIN labelled b ON b.photo_id = l.photo_id AND b.row_no = l.row_no GROUP BY l.photo_id),
 flat AS (SELECT photo_id, bool_and(x IS NOT NULL) AS placed, list(name ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, x + w / 2, y + h / 2, region_no) AS l
   FROM regions WHERE name <> '' GROUP BY photo_id)
 SELECT f.photo_id, CASE WHEN placed AND n_rows > 1 THEN by_rows WHEN len(l) = 1 THEN l[1]
   ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[-1] END AS names FROM flat f LEFT JOIN said s ON s.photo_id = f.photo_id""",
)
def _(spark, sf):
    return people.names_rows_text(load(spark, sf, "regions"))


@query(
    "f17_people_counts",
    "regions",
    """, n AS (SELECT photo_id, sum(CASE WHEN name <> '' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN name = '' THEN 1 ELSE 0 END) AS b FROM regions GROUP BY photo_id)
 SELECT photo_id, CASE WHEN a > 0 THEN cast(cast(a AS bigint) AS varchar) ELSE '' END AS named, CASE WHEN b > 0 THEN cast(cast(b AS bigint) AS varchar) ELSE '' END AS unnamed FROM n""",
)
def _(spark, sf):
    return people.people_counts(load(spark, sf, "regions"))


_OX, _OY, _OW, _OH = sql_orient("l.orientation", "r.x", "r.y", "r.w", "r.h")
MOVED = f""", up AS (SELECT r.photo_id, r.region_no, r.name, l.*, {_OX} * up_w - sx AS x0, {_OY} * up_h - sy AS y0,
   ({_OX} * up_w - sx) + {_OW} * up_w AS x1, ({_OY} * up_h - sy) + {_OH} * up_h AS y1
   FROM regions r JOIN layouts l ON l.photo_id = r.photo_id WHERE r.x IS NOT NULL),
 clip AS (SELECT *, least(sw, x1) - greatest(0.0, x0) AS kw, least(sh, y1) - greatest(0.0, y0) AS kh FROM up),
 moved AS (SELECT *, kw > 0 AND kh > 0 AND kw * kh >= 0.5 * (x1 - x0) * (y1 - y0) AS stays FROM clip)"""


@query(
    "f18_remap_regions",
    "regions layouts",
    MOVED
    + """ SELECT photo_id, region_no, name, round((px + greatest(0.0, x0)) / cw, 6) AS x, round((py + greatest(0.0, y0)) / ch, 6) AS y,
   round(kw / cw, 6) AS w, round(kh / ch, 6) AS h FROM moved WHERE stays""",
)
def _(spark, sf):
    return people.remap_regions(load(spark, sf, "regions"), load(spark, sf, "layouts"))


_CX, _CY, _, _ = sql_orient("l.orientation", "r.x", "r.y", "cast(0 AS double)", "cast(0 AS double)")
_DX, _DY, _, _ = sql_orient("l.orientation", "(r.x + r.w)", "(r.y + r.h)", "cast(0 AS double)", "cast(0 AS double)")


@query(
    "f19_remap_shapes",
    "regions layouts",
    f""", s AS (SELECT r.photo_id, r.region_no, l.*, CASE WHEN r.region_no % 2 = 0 THEN 'circle' ELSE 'polygon' END AS shape, r.w AS radius,
   {_CX} * up_w - sx AS ax, {_CY} * up_h - sy AS ay, {_DX} * up_w - sx AS bx, {_DY} * up_h - sy AS by2,
   {sql_orient('l.orientation', '(r.x + r.w)', 'r.y', 'cast(0 AS double)', 'cast(0 AS double)')[0]} * up_w - sx AS ex,
   {sql_orient('l.orientation', '(r.x + r.w)', 'r.y', 'cast(0 AS double)', 'cast(0 AS double)')[1]} * up_h - sy AS ey
   FROM regions r JOIN layouts l ON l.photo_id = r.photo_id WHERE r.x IS NOT NULL),
 bb AS (SELECT *, least(ax, bx, ex) AS x0, greatest(ax, bx, ex) AS x1, least(ay, by2, ey) AS y0, greatest(ay, by2, ey) AS y1 FROM s),
 k AS (SELECT *, least(sw, x1) - greatest(0.0, x0) AS kw, least(sh, y1) - greatest(0.0, y0) AS kh FROM bb)
 SELECT photo_id, region_no, shape, round((px + least(greatest(ax, 0.0), sw)) / cw, 6) AS first_x, round((py + least(greatest(ay, 0.0), sh)) / ch, 6) AS first_y,
   cast(CASE WHEN shape = 'circle' THEN 1 ELSE 3 END AS bigint) AS n_points,
   CASE WHEN shape = 'circle' THEN round(radius * CASE WHEN orientation >= 5 THEN up_h ELSE up_w END / cw, 6) END AS radius FROM k
 WHERE CASE WHEN shape = 'circle' THEN ax >= 0 AND ay >= 0 AND ax <= sw AND ay <= sh
   ELSE x1 > x0 AND y1 > y0 AND kw > 0 AND kh > 0 AND kw * kh >= 0.5 * (x1 - x0) * (y1 - y0) END""",
)
def _(spark, sf):
    r = load(spark, sf, "regions").where("x IS NOT NULL").join(load(spark, sf, "layouts"), "photo_id")
    circle = F.col("region_no") % 2 == 0

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x, y, w, h = (F.col(c) for c in XYWH)
    shapes = r.withColumns({
        "shape": F.when(circle, "circle").otherwise("polygon"),
        "radius": F.when(circle, w),
        "vertices": F.when(~circle, F.array(point(x, y), point(x + w, y + h), point(x + w, y))),
    })
    s = people.remap_shapes(shapes)
    return s.select(
        "photo_id", "region_no", "shape", F.col("points")[0]["x"].alias("first_x"), F.col("points")[0]["y"].alias("first_y"),
        F.size("points").cast("long").alias("n_points"), "radius",
    )


@query("f20_dropped_regions", "regions layouts", MOVED + " SELECT DISTINCT photo_id, name FROM moved WHERE NOT stays AND name <> ''")
def _(spark, sf):
    return people.dropped_regions(load(spark, sf, "regions"), load(spark, sf, "layouts"))


def _keyed_faces(spark, sf):
    return load(spark, sf, "regions").withColumn("face_key", F.col("region_no").cast("string"))


@query(
    "f21_match_edited_faces",
    "regions face_edits",
    f"""SELECT e.photo_id, e.face_key FROM face_edits e LEFT JOIN regions r ON r.photo_id = e.photo_id AND cast(r.region_no AS varchar) = e.face_key
 WHERE e.face_key NOT LIKE 'new:%' AND (r.region_no IS NULL OR r.name <> e.was_name
   OR (r.x IS NOT NULL AND e.was_x IS NOT NULL AND {sql_iou('r', 'e', '', 'was_')} < 0.5))""",
)
def _(spark, sf):
    return people.match_edited_faces(_keyed_faces(spark, sf), load(spark, sf, "face_edits"))


@query(
    "f22_rematch_faces",
    "regions face_edits",
    f""", cand AS (SELECT e.photo_id, e.edit_no, r.region_no, e.was_name AS name, e.face_key = cast(r.region_no AS varchar) AS same
   FROM face_edits e JOIN regions r ON r.photo_id = e.photo_id AND r.name = e.was_name AND e.face_key NOT LIKE 'new:%'
   AND ((e.was_x IS NULL AND r.x IS NULL) OR {sql_iou('r', 'e', '', 'was_')} > 0.8)),
 opts AS (SELECT photo_id, name, edit_no, CASE WHEN bool_or(same) THEN list(region_no) FILTER (WHERE same) ELSE list(region_no ORDER BY region_no) END AS options
   FROM cand GROUP BY photo_id, name, edit_no),
 turn AS (SELECT *, row_number() OVER (PARTITION BY photo_id, name ORDER BY edit_no) AS i FROM opts),
 run AS (SELECT photo_id, name, edit_no, i, options[1] AS pick, [options[1]] AS taken FROM turn WHERE i = 1
   UNION ALL SELECT t.photo_id, t.name, t.edit_no, t.i, list_filter(t.options, lambda o: NOT list_contains(r.taken, o))[1],
     list_append(r.taken, list_filter(t.options, lambda o: NOT list_contains(r.taken, o))[1])
   FROM run r JOIN turn t ON t.photo_id = r.photo_id AND t.name = r.name AND t.i = r.i + 1)
 SELECT photo_id, edit_no, cast(pick AS varchar) AS face_key FROM run WHERE pick IS NOT NULL""",
)
def _(spark, sf):
    faces = _keyed_faces(spark, sf).withColumn("face_no", F.col("region_no"))
    edits = load(spark, sf, "face_edits").where("face_key NOT LIKE 'new:%'")
    return people.rematch_faces(faces, edits)


@query(
    "f22_new_faces_to_keep",
    "face_edits",
    "SELECT photo_id, face_key FROM face_edits WHERE face_key LIKE 'new:%' AND NOT deleted",
)
def _(spark, sf):
    added = load(spark, sf, "face_edits").where("face_key LIKE 'new:%' AND NOT deleted")
    return people.new_faces_to_keep(_keyed_faces(spark, sf), added).select("photo_id", "face_key")


@query(
    "f23_match_names",
    "",
    """, p AS (SELECT lower(trim(name)) AS key, pool, pos, trim(name) AS name FROM (
     SELECT 0 AS pool, c_custkey AS pos, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier
     UNION ALL SELECT 2, p_partkey, p_name FROM part) AS u WHERE trim(name) <> ''),
 q AS (SELECT n_nationkey AS query_id, lower(substr(n_name, 1, 1 + n_nationkey % 3)) AS q FROM nation
   UNION ALL SELECT 100 + p_partkey, lower(substr(p_name, 1, cast(2 + p_partkey % 9 AS int))) FROM part),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pool, pos) AS rn FROM p) AS b WHERE rn = 1),
 words AS (SELECT DISTINCT key, word FROM (SELECT key, unnest(regexp_split_to_array(key, '[\\s\\-''’.]+')) AS word FROM best UNION ALL SELECT key, key FROM best) AS w
   WHERE word <> ''),
 hit AS (SELECT DISTINCT query_id, key FROM q JOIN words w ON starts_with(w.word, q.q) WHERE key <> q AND q <> '')
 SELECT query_id, rank, name FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY pool, pos, h.key) AS rank
   FROM hit h JOIN best b ON b.key = h.key) AS r WHERE rank <= 6""",
)
def _(spark, sf):
    def pool(table, n, key, name):
        return load(spark, sf, table).select(F.lit(n).alias("pool"), F.col(key).alias("pos"), F.col(name).alias("name"))

    names = pool("customer", 0, "c_custkey", "c_name").unionByName(pool("supplier", 1, "s_suppkey", "s_name"))
    names = names.unionByName(pool("part", 2, "p_partkey", "p_name"))
    typed = load(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("query_id"), F.expr("substr(n_name, 1, 1 + n_nationkey % 3)").alias("typed")
    )
    typed = typed.unionByName(load(spark, sf, "part").select(
        (F.col("p_partkey") + 100).alias("query_id"), F.expr("substr(p_name, 1, cast(2 + p_partkey % 9 AS int))").alias("typed")
    ))
    return people.match_names(typed, names, 6)


@query(
    "f24_people_keywords_sync",
    "regions face_edits tags",
    """, k AS (SELECT photo_id, lower(name) AS keyword_key, min(name) AS keyword FROM regions WHERE name <> '' GROUP BY photo_id, lower(name)
   UNION ALL SELECT DISTINCT photo_id, 'picnic', 'Picnic' FROM regions),
 after AS (SELECT r.photo_id, trim(CASE WHEN e.has_name THEN e.name ELSE r.name END) AS name FROM regions r LEFT JOIN face_edits e
   ON e.photo_id = r.photo_id AND e.face_key = cast(r.region_no AS varchar) WHERE NOT coalesce(e.deleted, false)),
 has AS (SELECT photo_id, lower(name) AS keyword_key, min(name) AS keyword FROM after WHERE name <> '' GROUP BY photo_id, lower(name)),
 had AS (SELECT DISTINCT photo_id, lower(name) AS keyword_key FROM regions WHERE name <> '')
 SELECT photo_id, keyword_key, keyword FROM k WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.photo_id = k.photo_id AND had.keyword_key = k.keyword_key
     AND NOT EXISTS (SELECT 1 FROM has WHERE has.photo_id = had.photo_id AND has.keyword_key = had.keyword_key))
 UNION ALL SELECT photo_id, keyword_key, keyword FROM has h WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.photo_id = h.photo_id AND had.keyword_key = h.keyword_key)
   AND NOT EXISTS (SELECT 1 FROM k WHERE k.photo_id = h.photo_id AND k.keyword_key = h.keyword_key)""",
)
def _(spark, sf):
    faces = _keyed_faces(spark, sf)
    e = load(spark, sf, "face_edits").select("photo_id", "face_key", "has_name", F.col("name").alias("new_name"), "deleted")
    after = faces.join(e, ["photo_id", "face_key"], "left").where(~F.coalesce("deleted", F.lit(False)))
    after = after.withColumn("name", F.when(F.col("has_name"), F.col("new_name")).otherwise(F.col("name")))
    k = people.named(faces).groupBy("photo_id", F.lower("name").alias("keyword_key")).agg(F.min("name").alias("keyword"))
    k = k.unionByName(faces.select("photo_id", F.lit("picnic").alias("keyword_key"), F.lit("Picnic").alias("keyword")).distinct())
    return people.people_keywords_sync(k, faces, after)
