"""Face regions: frames, folding across standards, order, rows and names.

``regions`` is (photo_id, region_no, source, name, x, y, w, h); boxes are upright, a NULL box keeps
the name. All matches ride on photo_id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photocat.functions import boxes, text
from photocat.functions import fixed_values as fixed
from photocat.session import cut_lineage
from photocat.functions.groups import in_ranges, ordered_positions, ordered_scan, overlap_pairs, scan_ranges

BOX = ["x", "y", "w", "h"]


def has_box() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()


def named(regions: DataFrame) -> DataFrame:
    return regions.where(F.trim("name") != "")


# -- reading ---------------------------------------------------------------------------------------

_MWG = (
    "RegionList array<struct<Name:string, Type:string, Rotation:string,"
    " Area:struct<X:string, Y:string, W:string, H:string, Unit:string>>>,"
    " AppliedToDimensions struct<W:string, H:string>"
)
_MP = "Regions array<struct<PersonDisplayName:string, Rectangle:string>>"


def _number(c: Column) -> Column:
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def explode_regions(docs: DataFrame) -> DataFrame:
    """Regions of both standards from their JSON (columns photo_id, orientation, width, height, mwg,
    mp). A region without usable coordinates keeps its name with a NULL box."""
    mwg = (
        docs.withColumn("_m", F.from_json("mwg", _MWG))
        .select("photo_id", "orientation", "width", "height", "_m.AppliedToDimensions", F.posexplode("_m.RegionList").alias("i", "r"))
        .where(F.lower(F.trim(F.coalesce("r.Type", F.lit("Face")))) == "face")
    )
    cx, cy, w, h = (_number(F.col(f"r.Area.{k}")) for k in "XYWH")
    usable = (F.lower(F.trim(F.coalesce("r.Area.Unit", F.lit("normalized")))) == "normalized") & (w >= 0) & (h >= 0)
    frame = boxes.region_frame(
        F.col("orientation"), _number(F.col("AppliedToDimensions.W")), _number(F.col("AppliedToDimensions.H")),
        F.col("width"), F.col("height"), F.col("r.Rotation").isNotNull(),
    )
    mwg_box = F.when(usable & cx.isNotNull() & cy.isNotNull(), boxes.orient(frame, cx - w / 2, cy - h / 2, w, h))
    mwg = mwg.select(
        "photo_id", F.concat(F.lit("mwg:"), F.col("i")).alias("region_id"), F.lit("MWG").alias("source"),
        F.coalesce(F.trim("r.Name"), F.lit("")).alias("name"), mwg_box.alias("b"),
    )
    mp = docs.withColumn("_p", F.from_json("mp", _MP)).select("photo_id", "orientation", F.posexplode("_p.Regions").alias("i", "r"))
    parts = F.split("r.Rectangle", ",")
    px, py, pw, ph = (_number(F.try_element_at(parts, F.lit(k))) for k in (1, 2, 3, 4))
    whole = (F.size(parts) == 4) & px.isNotNull() & py.isNotNull() & (pw >= 0) & (ph >= 0)
    mp = mp.select(
        "photo_id", F.concat(F.lit("mp:"), F.col("i")).alias("region_id"), F.lit("MP").alias("source"),
        F.coalesce(F.trim("r.PersonDisplayName"), F.lit("")).alias("name"),
        F.when(whole, boxes.orient(F.col("orientation"), px, py, pw, ph)).alias("b"),
    )
    both = mwg.unionByName(mp)
    return both.select("photo_id", "region_id", "source", "name", *[F.col("b")[c].alias(c) for c in BOX])


# -- folding ---------------------------------------------------------------------------------------


def _list_order(source: str = "source") -> Column:
    """Place in the reader's list: the first standard's regions, then the second's."""
    return F.when(F.col(source) == "MWG", 0).otherwise(1)


def _overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(photo_id, region_no, key, source, r_no, r_key, r_source): regions of ``left`` lying on one of ``right``. Only numbers and
    boxes go into the join."""
    part = lambda df: df.select("photo_id", "region_no", "source", F.lower("name").alias("key"), *BOX)
    r = part(right).select("photo_id", F.col("region_no").alias("r_no"), F.col("source").alias("r_source"), F.col("key").alias("r_key"), *[F.col(c).alias("r" + c) for c in BOX])
    return overlap_pairs(part(left), r, ["photo_id"], boxes.iou(), 0.5).where("region_no <> r_no").select("photo_id", "region_no", "key", "source", "r_no", "r_key", "r_source")


def _folds(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Second-standard regions that repeat one of the first. Missing boxes are settled by one aggregate per name."""
    r = regions.select("photo_id", "region_no", "source", F.lower("name").alias("key"), has_box().alias("placed"))
    per_name = (
        r.where("source = 'MWG' and key <> ''")
        .groupBy("photo_id", "key")
        .agg(F.min("region_no").alias("first_any"), F.min(F.when(~F.col("placed"), F.col("region_no"))).alias("first_boxless"))
    )
    named = r.where("source = 'MP' and key <> ''").join(per_name, ["photo_id", "key"])
    by_name = F.when(F.col("placed"), F.col("first_boxless")).otherwise(F.col("first_any"))
    settled = named.select("photo_id", "region_no", by_name.alias("into_no")).where("into_no IS NOT NULL")
    near = pairs.where("source = 'MP' and r_source = 'MWG' and key = r_key").select("photo_id", "region_no", F.col("r_no").alias("into_no"))
    return settled.unionByName(near).groupBy("photo_id", "region_no").agg(F.min("into_no").alias("into_no"))


def _onto(pairs: DataFrame) -> DataFrame:
    """Unnamed regions lying on a named one, the first in list order."""
    on = pairs.where("key = '' and r_key <> ''").groupBy("photo_id", "region_no").agg(F.min(F.struct(_list_order("r_source").alias("rank"), "r_no")).alias("m"))
    return on.select("photo_id", "region_no", F.col("m.r_no").alias("into_no"))


def fold_sources(regions: DataFrame) -> DataFrame:
    """(photo_id, region_no, into_no): second-standard regions that repeat one of the first standard.

    Named ones match on name and either box missing or IoU above one half; unnamed ones on IoU.
    The first region that matches takes them in; no group's pairs are listed."""
    return _folds(regions, _overlaps(regions.where("source = 'MP'"), regions.where("source = 'MWG'")))


def unnamed_on_named(kept: DataFrame) -> DataFrame:
    """(photo_id, region_no, into_no): unnamed regions lying on a named one, first in list order."""
    return _onto(_overlaps(kept.where("name = ''"), kept.where("name <> ''")))


def region_homes(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``fold_sources`` gives, and what ``unnamed_on_named`` gives for the regions then left, from one pass over the
    overlaps, which is written once."""
    pairs = cut_lineage(_overlaps(regions.where("source = 'MP' or name = ''"), regions.where("source = 'MWG' or name <> ''")))
    fold = cut_lineage(_folds(regions, pairs))
    gone = fold.select("photo_id", "region_no")
    left = pairs.where("key = '' and r_key <> ''").join(gone, ["photo_id", "region_no"], "left_anti")
    return fold, _onto(left.join(gone.withColumnRenamed("region_no", "r_no"), ["photo_id", "r_no"], "left_anti"))


def dedup_regions_across_sources(regions: DataFrame) -> DataFrame:
    """Regions left once repeats across standards are folded."""
    return regions.join(fold_sources(regions), ["photo_id", "region_no"], "left_anti")


def suppress_unnamed_on_named(kept: DataFrame) -> DataFrame:
    """Of regions without repeats, those that are not unnamed ones lying on a named one."""
    return kept.join(unnamed_on_named(kept), ["photo_id", "region_no"], "left_anti")


def settled_faces(regions: DataFrame) -> DataFrame:
    """Both steps at once: the faces left of all regions."""
    fold, onto = region_homes(regions)
    return regions.join(fold.union(onto).select("photo_id", "region_no"), ["photo_id", "region_no"], "left_anti")


def append_listed_people(kept: DataFrame, listed: DataFrame) -> DataFrame:
    """Add people listed without a region, once each, unless a region names them already."""
    cols = ["photo_id", "region_no", "source", "name", *BOX]
    have = kept.where("name <> ''").select("photo_id", F.lower("name").alias("_key")).distinct()
    new = (
        listed.where(text.present(F.col("name")))
        .select("photo_id", F.lower(F.trim("name")).alias("_key"), "item", F.trim("name").alias("name"))
        .join(have, ["photo_id", "_key"], "left_anti")
        .groupBy("photo_id", "_key")
        .agg(F.min(F.struct("item", "name")).alias("p"))
        .select(
            "photo_id", F.col("p.item").alias("region_no"), F.lit("listed").alias("source"), F.col("p.name").alias("name"),
            *[F.lit(None).cast("double").alias(c) for c in BOX],
        )
    )
    return kept.select(*cols).unionByName(new)


def face_keys(regions: DataFrame) -> DataFrame:
    """(photo_id, region_no, face_key): each kept face with the ids of all regions folded into it:
    its own, its repeats in the second standard, then unnamed regions lying on it."""
    fold, onto = region_homes(regions)
    order = _list_order()
    first = regions.select("photo_id", "region_no", "source", F.concat(F.lower("source"), F.lit(":"), F.col("region_no")).alias("id"))
    # where each region ends up: through the fold, then through the unnamed-on-named step
    place = first.join(fold, ["photo_id", "region_no"], "left").withColumn("via", F.coalesce("into_no", "region_no"))
    onto = onto.select("photo_id", F.col("region_no").alias("via"), F.col("into_no").alias("home"))
    place = place.join(onto, ["photo_id", "via"], "left").withColumn("moved", F.col("home").isNotNull())
    mine = place.select(
        "photo_id", F.coalesce("home", "via").alias("face"), "id",
        F.struct(
            F.when(F.col("moved"), 2).when(F.col("into_no").isNotNull(), 1).otherwise(0).alias("phase"),
            F.when(F.col("moved"), F.when(F.col("into_no").isNotNull(), 0).otherwise(order)).otherwise(0).alias("list"),
            F.col("via"), F.col("into_no").isNotNull().alias("folded"), F.col("region_no"),
        ).alias("at"),
    )
    ids = F.array_sort(F.collect_list(F.struct("at", "id")))
    return mine.groupBy("photo_id", F.col("face").alias("region_no")).agg(ids.alias("l")).select(
        "photo_id", "region_no", F.array_join("l.id", "+").alias("face_key")
    )


def region_warnings(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """What is odd about each photo's regions (photos carries the declared size applied_w, applied_h)."""
    per_photo = faces.groupBy("photo_id").agg(
        F.bool_or((F.col("name") != "") & ~has_box()).alias("unplaced"), F.count(F.lit(1)).alias("n")
    )
    off = boxes.dims_mismatch(*[F.col(c) for c in ("orientation", "applied_w", "applied_h", "width", "height")])
    return photos.join(per_photo, "photo_id", "left").select(
        "photo_id",
        text.reasons(
            (off, "region dimensions mismatch"),
            (F.coalesce("unplaced", F.lit(False)), "names without positions"),
            (F.col("n").isNull(), "no face regions"),
        ).alias("warnings"),
    )


# -- order and rows --------------------------------------------------------------------------------


def _center(df: DataFrame) -> DataFrame:
    return df.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})


def in_order(faces: DataFrame, order: str = "lr") -> tuple[DataFrame, list[Column]]:
    """The faces with what ``order`` needs, and the columns to sort a photo's faces by."""
    df = _center(faces).withColumn("_late", F.when(has_box(), 0).otherwise(1))
    if order == "meta":
        return df, [F.col("region_no")]
    sign = -1 if order == "rl" else 1
    no_place = F.lit(0.0)
    return df, [
        F.col("_late"),
        F.coalesce(F.col("cx") * sign, no_place),
        F.coalesce(F.col("cy") * sign, no_place),
        F.when(F.col("_late") == 1, F.col("region_no")).otherwise(F.col("region_no") * sign),
    ]


def order_names(faces: DataFrame, order: str = "lr", parts: int | None = None) -> DataFrame:
    """Add ``pos``: left to right by box centre (``rl`` reversed, ``meta`` as stored); faces without
    a place follow in stored order."""
    df, by = in_order(faces, order)
    return ordered_positions(df, ["photo_id"], by, "pos", parts).drop("_late", "cx", "cy")


def names_in_order(faces: DataFrame, order: str = "lr") -> DataFrame:
    """Each photo's names as one list. The list is one value of the result, so it is sorted once
    inside the aggregate instead of ranking rows first."""
    df = _center(faces)
    sign = -1 if order == "rl" else 1
    key = {
        "meta": F.struct("region_no", "name"),
    }.get(order)
    if key is None:
        key = F.struct(
            F.when(has_box(), 0).otherwise(1).alias("late"), (F.col("cx") * sign).alias("a"), (F.col("cy") * sign).alias("b"),
            F.when(has_box(), F.col("region_no") * sign).otherwise(F.col("region_no")).alias("c"), F.col("name"),
        )
    listed = F.array_sort(F.collect_list(key))
    return df.groupBy("photo_id").agg(listed.alias("l")).select("photo_id", F.col("l.name").alias("names"))


def _front_to_back(faces: DataFrame) -> tuple[DataFrame, list[Column]]:
    df = _center(faces.where(has_box())).withColumn("_down", -F.col("cy"))
    return df, [F.col("_down"), F.col("region_no")]


def _middle(values: DataFrame, key: str, *columns: str, parts: int | None = None) -> DataFrame:
    """(key, the median of each column): values get their rank in ranges of (key, column, value), and the middle one or two of
    a group are kept, so no task holds a group."""
    long = values.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("c"))
    long = long.select(key, "c.column", "c.v").where("v is not null")
    ranked = ordered_positions(long, [key, "column"], [F.col("v")], "pos", parts)
    sizes = long.groupBy(key, "column").agg(F.count(F.lit(1)).alias("n"))
    mid = ranked.join(sizes, [key, "column"]).where("pos between (n + 1) div 2 and n div 2 + 1")
    return mid.groupBy(key).agg(*[F.avg(F.when(F.col("column") == c, F.col("v"))).alias(f"_mid_{c}") for c in columns])


def cluster_rows(faces: DataFrame, factor: float = 0.6, parts: int | None = None) -> DataFrame:
    """Add ``row_no`` (1 is the front row): faces from the bottom up, cut where the step is large
    for this photo's face heights and steps. Steps and rows come from the same ranges."""
    df, down = _front_to_back(faces)
    df = scan_ranges(in_ranges(df, ["photo_id"], down, parts), ["photo_id"], down, lag={"_prev": "cy"})
    df = df.withColumn("_gap", F.col("_prev") - F.col("cy"))
    df = df.join(_middle(df, "photo_id", "h", "_gap", parts=parts), "photo_id")
    limit = F.greatest(factor * F.col("_mid_h"), F.least(1.2 * F.col("_mid_h"), 2.5 * F.col("_mid__gap")))
    df = df.withColumn("_cut", F.when(F.col("_gap") >= limit, 1).otherwise(0))
    df = scan_ranges(df, ["photo_id"], down, running={"_row": "_cut"})
    return df.withColumn("row_no", F.col("_row") + 1).drop("_down", "_prev", "_gap", "_mid_h", "_mid__gap", "_cut", "_row", "_part")


def cluster_rows_k(faces: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """Add ``row_no`` for exactly min(k, faces) rows: cuts at the k-1 largest steps, the earlier
    step first among equals. The rank filter is a group limit: each task keeps only its own k-1
    largest steps of a photo before the shuffle."""
    if not 1 <= k <= 9:
        return cluster_rows(faces, parts=parts)
    df, down = _front_to_back(faces)
    df = ordered_scan(df, ["photo_id"], down, position="_pos", lag={"_prev": "cy"}, parts=parts)
    df = df.withColumn("_gap", F.col("_prev") - F.col("cy"))
    if k == 1:
        return df.withColumn("row_no", F.lit(1).cast("long")).drop("_down", "_pos", "_prev", "_gap")
    largest = Window.partitionBy("photo_id").orderBy(F.desc("_gap"), "_pos")
    top = (
        df.where("_gap IS NOT NULL")
        .select("photo_id", "_pos", F.row_number().over(largest).alias("_r"))
        .where(F.col("_r") < k)
        .groupBy("photo_id")
        .agg(F.collect_list("_pos").alias("_cuts"))
    )
    df = df.join(top, "photo_id", "left")
    before = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: c <= F.col("_pos")))
    return df.withColumn("row_no", (before + 1).cast("long")).drop("_down", "_pos", "_prev", "_gap", "_cuts")


def row_label(row_no: Column, rows: Column, labels: list[str] | None = None) -> Column:
    """Front row the first label, back row the last, the middle ones in order; a numbered label when
    there are too few; none for a single row."""
    labels = labels or fixed.ROW_LABELS
    middle = F.array(*[F.lit(x) for x in labels[1:-1]]).cast("array<string>")
    numbered = F.concat(F.lit("Row "), row_no.cast("string"), F.lit(", L–R: "))
    fits = F.lit(len(labels[1:-1])) >= rows - 2
    out = F.when(rows <= 1, F.lit("")).when(row_no == 1, F.lit(labels[0]))
    if len(labels) > 1:
        out = out.when(row_no == rows, F.lit(labels[-1]))
    return out.when(fits, F.try_element_at(middle, (row_no - 1).cast("int"))).otherwise(numbered)


def names_rows_text(
    faces: DataFrame, sep: str = ", ", last: str = " and ", row_sep: str = "; ", labels: list[str] | None = None, order: str = "lr"
) -> DataFrame:
    """Names row by row with labels; plain names in order when anyone has no place. ``order`` rl turns each row around."""
    labels = [x.lstrip() for x in labels or [] if x.strip()] or (None if labels is None else ["Row 1: "])
    n = named(faces)
    in_row = F.reverse("l.name") if order == "rl" else F.col("l.name")
    plain = names_in_order(n, order).select("photo_id", text.join_names(F.col("names"), sep, last).alias("plain"))
    # row order ties keep the front-to-back order
    by_row = (
        cluster_rows(n)
        .groupBy("photo_id", "row_no")
        .agg(F.array_sort(F.collect_list(F.struct("cx", (-F.col("cy")).alias("d"), "region_no", "name"))).alias("l"))
        .select("photo_id", "row_no", text.join_names(in_row, sep, last).alias("row_text"))
    )
    listed = by_row.groupBy("photo_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "row_text"))).alias("l"), F.max("row_no").alias("rows")
    )
    rows = listed.select(
        "photo_id", "rows",
        F.array_join(
            F.transform("l", lambda r: F.concat(row_label(r["row_no"], F.col("rows"), labels), r["row_text"])), row_sep
        ).alias("by_rows"),
    )
    placed = n.groupBy("photo_id").agg(F.bool_and(has_box()).alias("placed"))
    return (
        plain.join(placed, "photo_id")
        .join(rows, "photo_id", "left")
        .select("photo_id", F.when(F.col("placed") & (F.col("rows") > 1), F.col("by_rows")).otherwise(F.col("plain")).alias("names"))
    )


def people_counts(faces: DataFrame) -> DataFrame:
    """Named and unnamed faces per photo, as caption tokens: empty when 0."""
    counted = faces.groupBy("photo_id").agg(F.count_if(F.trim("name") != "").alias("n"), F.count_if(F.trim("name") == "").alias("u"))

    def shown(c):
        return F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise("")

    return counted.select("photo_id", shown("n").alias("named"), shown("u").alias("unnamed"))


# -- moving regions to a new canvas ------------------------------------------------------------------

LAYOUT = ["up_w", "up_h", "sx", "sy", "sw", "sh", "px", "py", "cw", "ch"]


def remap(df: DataFrame) -> DataFrame:
    """Add ``moved``: the stored box on the output canvas, NULL when less than half of it stays; a
    point moves with the photo and is NULL outside it. Needs the layout columns."""
    c = {n: F.col(n) for n in LAYOUT}
    df = df.withColumn("_b", boxes.orient(F.col("orientation"), *[F.col(n) for n in BOX]))
    x0, y0 = F.col("_b.x") * c["up_w"] - c["sx"], F.col("_b.y") * c["up_h"] - c["sy"]
    x1, y1 = x0 + F.col("_b.w") * c["up_w"], y0 + F.col("_b.h") * c["up_h"]
    df = df.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1})
    x0, y0, x1, y1 = (F.col(n) for n in ("_x0", "_y0", "_x1", "_y1"))
    kx0, ky0 = F.greatest(F.lit(0.0), x0), F.greatest(F.lit(0.0), y0)
    kw, kh = F.least(c["sw"], x1) - kx0, F.least(c["sh"], y1) - ky0
    stays = (kw > 0) & (kh > 0) & (kw * kh >= 0.5 * (x1 - x0) * (y1 - y0))
    is_box = (F.col("w") > 0) & (F.col("h") > 0)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 <= c["sw"]) & (y0 <= c["sh"])

    def at(x, y, w, h):
        parts = ((c["px"] + x) / c["cw"], (c["py"] + y) / c["ch"], w / c["cw"], h / c["ch"])
        return F.struct(*[F.round(v, 6).alias(n) for n, v in zip(BOX, parts)])

    moved = F.when(is_box & stays, at(kx0, ky0, kw, kh)).when(~is_box & inside, at(x0, y0, F.lit(0.0), F.lit(0.0)))
    return df.withColumn("moved", moved).drop("_b", "_x0", "_y0", "_x1", "_y1")


def turned_angle(orientation: Column, angle: Column) -> Column:
    """A region's own angle: a mirrored frame reverses its direction, a quarter turn keeps it."""
    return F.when(orientation.isin(2, 4, 5, 7), -angle).otherwise(angle)


def remap_regions(regions: DataFrame, layouts: DataFrame) -> DataFrame:
    """Regions on the output canvas; those cropped away are dropped."""
    moved = remap(regions.where(has_box()).join(layouts, "photo_id")).where("moved IS NOT NULL")
    return moved.select("photo_id", "region_no", "name", *[F.col("moved")[c].alias(c) for c in BOX])


def dropped_regions(regions: DataFrame, layouts: DataFrame) -> DataFrame:
    """Names whose regions were cropped away, once per photo."""
    moved = remap(named(regions).where(has_box()).join(layouts, "photo_id"))
    return moved.where("moved IS NULL").select("photo_id", "name").distinct()


def remap_shapes(shapes: DataFrame) -> DataFrame:
    """Circles and polygons in relative units on the output canvas (columns shape, x, y, radius,
    vertices plus the layout). A circle goes with its centre, its radius is relative to the width;
    a polygon stays when its bounding box does, each vertex clamped to the kept photo area."""
    c = {n: F.col(n) for n in LAYOUT}
    zero = F.lit(0.0)

    def upright(v):
        b = boxes.orient(F.col("orientation"), v["x"], v["y"], zero, zero)
        return F.struct((b["x"] * c["up_w"] - c["sx"]).alias("x"), (b["y"] * c["up_h"] - c["sy"]).alias("y"))

    points = F.coalesce("vertices", F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"))))
    df = shapes.withColumn("_p", F.transform(points, upright))
    df = df.withColumns({
        "_x0": F.array_min("_p.x"), "_x1": F.array_max("_p.x"), "_y0": F.array_min("_p.y"), "_y1": F.array_max("_p.y"),
    })
    x0, x1, y0, y1 = (F.col(n) for n in ("_x0", "_x1", "_y0", "_y1"))
    kw = F.least(c["sw"], x1) - F.greatest(zero, x0)
    kh = F.least(c["sh"], y1) - F.greatest(zero, y0)
    polygon = (x1 > x0) & (y1 > y0) & (kw > 0) & (kh > 0) & (kw * kh >= 0.5 * (x1 - x0) * (y1 - y0))
    circle = (x0 >= 0) & (y0 >= 0) & (x0 <= c["sw"]) & (y0 <= c["sh"])

    def placed(v):
        x = F.least(F.greatest(v["x"], zero), c["sw"])
        y = F.least(F.greatest(v["y"], zero), c["sh"])
        return F.struct(F.round((c["px"] + x) / c["cw"], 6).alias("x"), F.round((c["py"] + y) / c["ch"], 6).alias("y"))

    frame_w = F.when(boxes.turned(F.col("orientation")), c["up_h"]).otherwise(c["up_w"])
    df = df.where(F.when(F.col("shape") == "polygon", polygon).otherwise(circle))
    return df.select(
        "photo_id", "region_no", "shape", F.transform("_p", placed).alias("points"),
        F.round(F.col("radius") * frame_w / c["cw"], 6).alias("radius"),
    )


# -- matching edits to faces -------------------------------------------------------------------------


def match_edited_faces(faces: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose face is gone or is another one now. ``faces`` has face_key; ``edits`` has
    face_key and the face it was made on (was_name, was_x ... was_h). New faces never match."""
    old = edits.where(~F.col("face_key").startswith("new:")).select(
        "photo_id", "face_key", "was_name", *[F.col("was_" + c).alias("r" + c) for c in BOX]
    )
    both = old.join(faces.select("photo_id", "face_key", "name", *BOX), ["photo_id", "face_key"], "left")
    placed = has_box() & F.col("rx").isNotNull()
    other = (F.coalesce("name", F.lit("")) != F.col("was_name")) | (placed & (boxes.iou() < 0.5))
    return both.where(F.col("name").isNull() | other).select("photo_id", "face_key")


def rematch_candidates(faces: DataFrame, edits: DataFrame) -> DataFrame:
    """(photo_id, edit_no, face_key, face_no, same): faces an edit on a box may belong to in a new version of the file:
    same name and nearly the same box."""
    e = edits.where("was_x IS NOT NULL").select(
        "photo_id", "edit_no", F.col("face_key").alias("edit_key"), F.col("was_name").alias("name"),
        *[F.col("was_" + c).alias(c) for c in BOX],
    )
    f = faces.select("photo_id", F.col("face_key"), F.col("face_no"), "name", *[F.col(c).alias("r" + c) for c in BOX])
    return overlap_pairs(e, f, ["photo_id", "name"], boxes.iou(), 0.8).select(
        "photo_id", "edit_no", "face_key", "face_no", (F.col("edit_key") == F.col("face_key")).alias("same")
    )


def _taken_in_turn(batches):
    """Faces in order of (photo_id, name, face_no), each with the edit of its own key (``own``) and how many free edits come
    before that (``before``): who gets the face, ``own`` or the next free edit (``turn``, from 1). All that is held is how many
    free edits of the name have a face."""
    held, given = None, 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("photo_id", "name", "face_key", "own", "before", "free")]
        out = []
        for photo, name, face, own, before, free in zip(*cols, strict=True):
            if (photo, name) != held:
                held, given = (photo, name), 0
            if own is not None and given >= before:
                out.append((photo, name, face, own, None))
            elif given < free:
                given += 1
                out.append((photo, name, face, None, given))
        if out:
            names = ["photo_id", "name", "face_key", "own", "turn"]
            types = [batch.schema.field(c).type for c in names[:4]] + [batch.schema.field("before").type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def rematch_without_boxes(faces: DataFrame, edits: DataFrame) -> DataFrame:
    """(photo_id, edit_no, face_key) for edits and faces without a box, which go by name alone, so all faces of a name suit
    all its edits. Edits are not paired with faces: a free edit (no face has its key) is matched by its rank, and one pass
    over a name's faces finds which of them their own edits reach first."""
    name = ["photo_id", "name"]
    e = edits.where("was_x IS NULL").select("photo_id", F.col("was_name").alias("name"), "edit_no", F.col("face_key").alias("edit_key"))
    f = faces.where("x IS NULL").select("photo_id", "name", "face_no", "face_key")
    keyed = e.join(f.select(*name, F.col("face_key").alias("edit_key"), F.lit(1).alias("has_own")), [*name, "edit_key"], "left").withColumn("free", F.when(F.col("has_own").isNull(), 1).otherwise(0))
    ranked = cut_lineage(ordered_scan(keyed, name, [F.col("edit_no")], running={"rank": "free"}))
    sizes = ranked.groupBy(*name).agg(F.max("rank").alias("free"))
    # of several edits with one key the first one has the face
    own = ranked.where("free = 0").groupBy(*name, F.col("edit_key").alias("face_key")).agg(F.min(F.struct("edit_no", "rank")).alias("o"))
    own = own.select(*name, "face_key", F.col("o.edit_no").alias("own"), F.col("o.rank").alias("before"))
    rows = f.join(sizes, name).join(own, [*name, "face_key"], "left").select(*name, "face_no", "face_key", "own", "before", "free")
    types = {x.name: x.dataType.simpleString() for x in rows.schema}
    out = ", ".join(f"{c} {types[c]}" for c in (*name, "face_key", "own")) + ", turn bigint"
    dealt = rows.repartition(*name).sortWithinPartitions(*name, "face_no", "face_key")
    taken = cut_lineage(dealt.mapInArrow(_taken_in_turn, out))
    free = ranked.where("free = 1").select(*name, "edit_no", F.col("rank").alias("turn"))
    by_rank = taken.where("turn IS NOT NULL").join(free, [*name, "turn"]).select("photo_id", "edit_no", "face_key")
    return taken.where("own IS NOT NULL").select("photo_id", F.col("own").alias("edit_no"), "face_key").unionByName(by_rank)


def rematch_faces(faces: DataFrame, edits: DataFrame) -> DataFrame:
    """(photo_id, edit_no, face_key): each edit's face in a new version of the file. Edits take
    turns by edit_no: the face of the same key if it still matches, else the first match not taken;
    an edit left without one is dropped.

    Edits without a box are matched by rank. For the others taking turns equals proposing in rounds where a face
    always keeps the earliest edit, so every round is one join and one aggregate over all photos, and edits nobody
    competes with are settled in the first. Rounds end when no edit was turned down."""
    cand = cut_lineage(rematch_candidates(faces, edits))  # read twice, far smaller than the cells it comes from
    own = cand.where("same").select("photo_id", "edit_no", F.lit(True).alias("has_own"))
    cand = cand.join(own, ["photo_id", "edit_no"], "left").where(F.col("has_own").isNull() | F.col("same"))
    cand = ordered_positions(cand, ["photo_id", "edit_no"], [F.col("face_no")], "choice")
    cand = cut_lineage(cand.select("photo_id", "edit_no", "face_key", "choice"))
    held = cand.where("choice = 1")
    while True:
        first = held.groupBy("photo_id", "face_key").agg(F.min("edit_no").alias("keeps"))
        asked = cut_lineage(
            held.join(first, ["photo_id", "face_key"]).withColumn("refused", F.col("edit_no") != F.col("keeps")).drop("keeps")
        )
        refused = asked.where("refused")
        if refused.isEmpty():
            return asked.select("photo_id", "edit_no", "face_key").unionByName(rematch_without_boxes(faces, edits))
        again = refused.select("photo_id", "edit_no", (F.col("choice") + 1).alias("choice"))
        held = asked.where("NOT refused").select(*cand.columns).unionByName(
            cand.join(again, ["photo_id", "edit_no", "choice"]).select(*cand.columns)
        )


def new_faces_to_keep(faces: DataFrame, added: DataFrame) -> DataFrame:
    """Added faces the file does not have yet: none there with the same name and nearly the same box."""
    e = added.where("x IS NOT NULL").select("photo_id", F.coalesce("name", F.lit("")).alias("name"), "face_key", *BOX)
    f = faces.select("photo_id", "name", *[F.col(c).alias("r" + c) for c in BOX])
    written = overlap_pairs(e, f, ["photo_id", "name"], boxes.iou(), 0.8).select("photo_id", "face_key").distinct()
    return added.join(written, ["photo_id", "face_key"], "left_anti")


def name_prefixes(people: DataFrame) -> DataFrame:
    """(prefix, key, pool, pos, name): each name under every prefix of itself and of its words, but not under the whole name.
    Of names that differ in case only the first one counts."""
    p = people.where(text.present(F.col("name"))).select(F.lower(F.trim("name")).alias("key"), "pool", "pos", F.trim("name").alias("name"))
    p = p.groupBy("key").agg(F.min(F.struct("pool", "pos", "name")).alias("best"))
    words = F.filter(F.array_append(F.split("key", r"[\s\-'’.]+"), F.col("key")), lambda w: w != "")
    starts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
    return p.select(F.explode(F.array_distinct(starts)).alias("prefix"), "key", "best.*").where("prefix <> key")


def match_names(queries: DataFrame, people: DataFrame, k: int | None = None) -> DataFrame:
    """For each typed text, the names (with ``k`` the first k) in which the whole name or any word starts with it.

    ``queries`` (query_id, typed); ``people`` (pool, pos, name). Names are ranked once per typed prefix, whoever typed it: with
    ``k`` every task passes on at most k names of a prefix, else prefixes are dealt into ranges. Queries then meet their prefix's
    list by one equality join.
    """
    q = queries.select("query_id", F.lower(F.trim("typed")).alias("prefix")).where("prefix <> ''")
    index = name_prefixes(people).join(q.select("prefix").distinct(), "prefix", "left_semi")
    order = [F.col("pool"), F.col("pos"), F.col("key")]
    if k is None:
        ranked = ordered_positions(index, ["prefix"], order, "rank")
    else:
        w = Window.partitionBy("prefix").orderBy(*order)
        ranked = index.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return q.join(ranked, "prefix").select("query_id", "rank", "name")


def people_keywords_sync(keywords: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keywords of files that list people as keywords too, after faces changed: a name no face has
    any more goes, a new name is added once."""

    def names(df):
        return named(df).select("photo_id", F.lower(F.trim("name")).alias("keyword_key"), F.trim("name").alias("keyword"))

    had, has = names(before), names(after)
    gone = had.select("photo_id", "keyword_key").join(has, ["photo_id", "keyword_key"], "left_anti").distinct()
    new = (
        has.join(had, ["photo_id", "keyword_key"], "left_anti")
        .groupBy("photo_id", "keyword_key").agg(F.min("keyword").alias("keyword"))
        .join(keywords, ["photo_id", "keyword_key"], "left_anti")
    )
    kept = keywords.select("photo_id", "keyword_key", "keyword").join(gone, ["photo_id", "keyword_key"], "left_anti")
    return kept.unionByName(new.select("photo_id", "keyword_key", "keyword"))
