"""Change sets over caption fields, keywords and faces: validated, applied, written back, checked.

``edits`` is (photo_id, edit_seq, edited_at, field, value); a NULL value clears the field.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.functions import boxes, dates, text
from photocat.functions import fixed_values as fixed
from photocat.functions.groups import overlap_pairs
from photocat.operators.people import BOX, has_box

_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_BREAK = "[\n\u0085\u2028\u2029]"


# -- checking --------------------------------------------------------------------------------------


class Limits(NamedTuple):
    """How long and how many an edit's values may be."""

    text: int = fixed.MAX_TEXT
    line: int = fixed.MAX_LINE
    creators: int = fixed.MAX_CREATORS
    keywords: int = fixed.MAX_KEYWORDS
    keyword: int = fixed.MAX_KEYWORD
    faces: int = fixed.MAX_FACES


def text_problems(v: Column, multiline: Column, limit: Column) -> list:
    """(condition, reason) pairs for one text value."""
    return [
        (v.rlike(_CONTROL), "control characters"),
        (~multiline & v.rlike(_BREAK), "line breaks"),
        (F.length(v) > limit, "too long"),
        (v.rlike(r"(?i)^\s*base64:"), "starts with base64:"),
    ]


def validate_edits(edits: DataFrame, as_of, limits: Limits = Limits()) -> DataFrame:
    """Add ``errors``: why an edit can't be taken (empty when it can), and normalize its value."""
    field, v = F.col("field"), text.unix_lines(F.col("value"))
    multiline = field.isin(fixed.MULTILINE_FIELDS)
    limit = F.when(multiline, limits.text).otherwise(limits.line)
    is_date = field == "date"
    whole = v.rlike(r"^\s*\d{4}(?:-\d{2}(?:-\d{2})?)?\s*$")
    real = dates.partial_date(F.trim(v), as_of).isNotNull()
    known = field.isin(fixed.TEXT_FIELDS + ["date"])
    problems = [(~is_date & cond, why) for cond, why in text_problems(v, multiline, limit)]
    problems = [(~known, "unknown field"), *problems, (is_date & v.isNotNull() & ~(whole & real), "not a date")]
    return edits.withColumns({"errors": text.reasons(*problems), "value": text.strip(v)})


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def validate_date_edits(edits: DataFrame, as_of) -> DataFrame:
    """Add ``errors`` and ``written_pattern`` for date edits (iso, level, estimate, pattern)."""
    iso, level = F.trim("iso"), F.col("level")
    parts = F.size(F.split(iso, "-"))
    want = F.when(level == "day", 3).when(level == "month", 2).otherwise(1)
    shape = iso.rlike(r"^\d{4}(?:-\d{2}(?:-\d{2})?)?$")
    return edits.withColumns({
        "errors": text.reasons(
            (~level.isin("day", "month", "year", "circa"), "unknown level"),
            (~shape, "not written as a date"),
            (shape & (parts != want), "does not fit the level"),
            (shape & dates.partial_date(iso, as_of).isNull(), "not a date"),
            (F.col("pattern").isNotNull() & ~F.upper(F.trim("pattern")).rlike(dates.PATTERN), "bad pattern"),
        ),
        "written_pattern": dates.edit_pattern(level, F.col("estimate"), F.col("pattern")),
    })


def validate_keyword_edits(keyword_edits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Cleaned keyword lists: blank ones, repeats and date markers go; a photo's whole list is
    refused (``errors``) when a keyword is unusable or there are too many."""
    v = text.unix_lines(F.col("keyword"))
    bad = text.any_of(*[c for c, _ in text_problems(v, F.lit(False), F.lit(limits.keyword))])
    k = keyword_edits.withColumns({"keyword": text.strip(v), "_bad": F.coalesce(bad, F.lit(False))})
    per_photo = k.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("_bad").alias("bad"))
    per_photo = per_photo.select(
        "photo_id", text.reasons((F.col("bad"), "unusable keyword"), (F.col("n") > limits.keywords, "too many keywords")).alias("errors")
    )
    unique = (
        k.where((F.col("keyword") != "") & ~text.is_date_marker(F.col("keyword")))
        .groupBy("photo_id", F.lower("keyword").alias("keyword_key"))
        .agg(F.min(F.struct("item", "keyword")).alias("k"))
        .select("photo_id", "keyword_key", "k.item", "k.keyword")
    )
    return unique.join(per_photo, "photo_id")


def validate_face_edits(face_edits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add ``errors`` and clamp boxes; a new face that is deleted, or has neither name nor box, goes. All of a photo's edits
    are refused when there are too many."""
    x, y, w, h = (F.col(c) for c in BOX)
    slack = 1e-6
    outside = (w <= 0) | (h <= 0) | (x < -slack) | (y < -slack) | (x + w > 1 + slack) | (y + h > 1 + slack)
    is_new = F.col("face_key").startswith("new:")
    nothing = is_new & (F.col("deleted") | (F.coalesce(F.trim("name"), F.lit("")) == "") & x.isNull())
    problems = [(c, why) for c, why in text_problems(F.col("name"), F.lit(False), F.lit(limits.keyword))]
    clamp = {c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) for c in BOX}
    many = face_edits.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.faces).select("photo_id", F.lit(True).alias("_many"))
    return (
        face_edits.where(~F.coalesce(nothing, F.lit(False)))
        .join(many, "photo_id", "left")
        .withColumn("errors", text.reasons((F.coalesce("_many", F.lit(False)), "too many faces"), (F.coalesce(outside, F.lit(False)), "the box is outside the photo"), *problems))
        .withColumns(clamp)
        .drop("_many")
    )


# -- applying --------------------------------------------------------------------------------------


def latest_edit(edits: DataFrame) -> DataFrame:
    """The last edit of each field. The value rides in a struct, so a clearing NULL can win."""
    return (
        edits.groupBy("photo_id", "field")
        .agg(F.max(F.struct("edited_at", "edit_seq", "value")).alias("e"))
        .select("photo_id", "field", "e.edit_seq", "e.value")
    )


def _latest_wide(edits: DataFrame, names: list[str]) -> DataFrame:
    """One row per photo with the last edit of every named field as a struct (NULL: not edited)."""
    last = "max(struct(edited_at, edit_seq, value)) FILTER (WHERE field = '{0}')"
    return edits.where(F.col("field").isin(names)).groupBy("photo_id").agg(*[F.expr(last.format(n)).alias("e_" + n) for n in names])


def apply_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Caption fields as they will be: edited text replaces, empty clears, a date edit sets the date
    and how sure it is (its level taken from how it is written). Of the caption fields those that ``fields`` has."""
    names = [n for n in fixed.TEXT_FIELDS + ["date"] if n in fields.columns]
    e = _latest_wide(edits, names)
    df = fields.join(e, "photo_id", "left")

    def after(n):
        new = F.col("e_" + n)
        return F.when(new.isNotNull(), F.nullif(text.strip(new["value"]), F.lit(""))).otherwise(F.col(n))

    out = {n: after(n) for n in names}
    if "date" not in out:
        return df.select(*[c for c in fields.columns if c not in out], *[c.alias(n) for n, c in out.items()])
    level = F.element_at(F.array(F.lit("year"), F.lit("month"), F.lit("day")), F.size(F.split(out["date"], "-")))
    certain = dates.level_pattern(level, F.lit(False))
    own = F.col("certainty") if "certainty" in fields.columns else F.lit(None).cast("string")
    certain = F.when(out["date"].isNotNull(), certain)
    out["certainty"] = F.when(F.col("e_date").isNotNull(), certain).otherwise(own)
    rest = [c for c in fields.columns if c not in out]
    return df.select(*rest, *[c.alias(n) for n, c in out.items()])


def keywords_after(keywords: DataFrame, keyword_edits: DataFrame, date_edits: DataFrame) -> DataFrame:
    """(photo_id, branch, item, keyword): the edited list, or the own one without date markers; then
    the marker a date edit (photo_id, pattern; NULL clears) calls for, or the own markers."""
    edited = keyword_edits.select("photo_id").distinct()
    dated = date_edits.select("photo_id").distinct()
    own = keywords.select("photo_id", (F.col("src_rank") * F.lit(1 << 40) + F.col("item")).alias("item"), "keyword")
    marker = text.is_date_marker(F.col("keyword"))
    branches = [
        keyword_edits.select("photo_id", F.lit(0).alias("branch"), "item", "keyword"),
        own.where(~marker).join(edited, "photo_id", "left_anti").select("photo_id", F.lit(0).alias("branch"), "item", "keyword"),
        date_edits.where("pattern IS NOT NULL").select(
            "photo_id", F.lit(1).alias("branch"), F.lit(0).cast("long").alias("item"), F.concat(F.lit("DATE: "), "pattern").alias("keyword")
        ),
        own.where(marker).join(dated, "photo_id", "left_anti").select("photo_id", F.lit(1).alias("branch"), "item", "keyword"),
    ]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def faces_after(faces: DataFrame, face_edits: DataFrame) -> DataFrame:
    """Faces once the edits are written: changed, removed, added; a face with neither a name nor a
    box is gone. Faces carry face_key."""
    e = face_edits.select(
        "photo_id", "face_key", "has_name", "has_box", "deleted", F.col("name").alias("new_name"), *[F.col(c).alias("n" + c) for c in BOX]
    )
    both = faces.join(e, ["photo_id", "face_key"], "full_outer")
    is_new = F.col("face_key").startswith("new:")
    known = F.col("name").isNotNull()
    both = both.where((known | is_new) & ~F.coalesce("deleted", F.lit(False)))
    name = F.when(F.col("has_name") | ~known, F.coalesce("new_name", F.lit(""))).otherwise(F.col("name"))
    moved = F.coalesce("has_box", F.lit(False)) | ~known
    out = both.select(
        "photo_id", "face_key", F.trim(name).alias("name"), *[F.when(moved, F.col("n" + c)).otherwise(F.col(c)).alias(c) for c in BOX]
    )
    return out.where((F.col("name") != "") | has_box())


def propagate_hierarchy(paths: DataFrame, before: DataFrame, after: DataFrame, renames: DataFrame, dated: DataFrame) -> DataFrame:
    """Keyword paths follow the flat list: a renamed leaf is replaced, a removed one dropped, old date
    markers dropped where the date was edited. ``before`` and ``after`` are keyword rows,
    ``renames`` (photo_id, old_key, new_name), ``dated`` the photos whose date was edited."""
    key = F.lower(F.trim("keyword")).alias("leaf")
    kept = after.select("photo_id", key).distinct()
    gone = before.select("photo_id", key).distinct().join(kept, ["photo_id", "leaf"], "left_anti").withColumn("gone", F.lit(True))
    to = renames.select("photo_id", F.col("old_key").alias("leaf"), "new_name").groupBy("photo_id", "leaf").agg(F.max("new_name").alias("new_name"))
    to = to.withColumn("new_key", F.lower("new_name")).join(
        kept.withColumnRenamed("leaf", "new_key").withColumn("kept", F.lit(True)), ["photo_id", "new_key"]
    )
    steps = F.split("path", r"\|")
    p = paths.withColumn("leaf", F.lower(F.trim(F.element_at(steps, -1))))
    p = p.join(gone, ["photo_id", "leaf"], "left").join(to.drop("kept"), ["photo_id", "leaf"], "left")
    p = p.join(dated.select("photo_id", F.lit(True).alias("dated")).distinct(), "photo_id", "left")
    is_gone = F.coalesce("gone", F.lit(False))
    renamed = F.col("new_name").isNotNull() & (is_gone | (F.col("leaf") == F.col("new_key")))
    head = F.regexp_extract("path", r"^(.*\|)?[^|]*$", 1)
    p = p.where(~(F.coalesce("dated", F.lit(False)) & text.is_date_marker(F.element_at(steps, -1))) & (renamed | ~is_gone))
    return p.select("photo_id", "item", F.when(renamed, F.concat(head, "new_name")).otherwise(F.col("path")).alias("path"))


# -- writing back ----------------------------------------------------------------------------------


def mirror_spec(spark: SparkSession) -> DataFrame:
    """The dimension (field, spec_tag, tag, role, group_no, slot): a fixed table of a few dozen rows. A field's tags have slots
    from 0."""
    rows, slots = [], dict.fromkeys(fixed.MIRROR_SPEC, 0)
    for field, (primary, mirrors, fallbacks) in fixed.MIRROR_SPEC.items():
        for role, tags in (("primary", [primary]), ("mirror", mirrors), ("fallback", fallbacks)):
            for t in tags:
                group, _, name = t.partition(":")
                names = [f"{g}:{name}" for g in fixed.EXIF_GROUPS] if group == "EXIF" else [t]
                rows += [(field, t, n, role, i, slots[field] + i) for i, n in enumerate(names)]
                slots[field] += len(names)
    return spark.createDataFrame(rows, "field string, spec_tag string, tag string, role string, group_no int, slot int")


#: The fields whose old text decides what is written: those with fallback tags.
COMPARED_FIELDS = [n for n, (_, _, fallbacks) in fixed.MIRROR_SPEC.items() if fallbacks]
_SLOTS = max(sum(len(fixed.EXIF_GROUPS) if t.startswith("EXIF:") else 1 for t in [p, *m, *f]) for p, m, f in fixed.MIRROR_SPEC.values())
_CHARSET = "IPTC:CodedCharacterSet"


def _held_values(tags: DataFrame, spec: DataFrame) -> DataFrame:
    """(photo_id, field, held, utf8): the first values a photo's tags hold, by slot, and whether its IPTC text is UTF-8. One
    aggregate, which combines map-side; the character set goes to every field."""
    slots = spec.select("tag", "field", "slot").unionByName(spec.where("slot = 0").select(F.lit(_CHARSET).alias("tag"), "field", F.lit(-1).alias("slot")))
    names = [t for p, m, f in fixed.MIRROR_SPEC.values() for x in [p, *m, *f] for t in ([f"{g}:{x[5:]}" for g in fixed.EXIF_GROUPS] if x.startswith("EXIF:") else [x])]
    wanted = F.col("tag").isin([*names, _CHARSET]) & F.col("value").isNotNull() & ((F.col("tag") != _CHARSET) | F.col("value").rlike("(?i)%G|utf"))
    first = "min(struct(item, value)) FILTER (WHERE slot = {0})"
    held = tags.where(wanted).join(F.broadcast(slots), "tag").groupBy("photo_id", "field").agg(F.max(F.col("slot") == -1).alias("utf8"), *[F.expr(first.format(i)).alias(f"v{i}") for i in range(_SLOTS)])
    return held.select("photo_id", "field", "utf8", F.array(*[F.col(f"v{i}")["value"] for i in range(_SLOTS)]).alias("held"))


def mirror_fields(latest: DataFrame, tags: DataFrame, fields: DataFrame, jpeg: bool = True) -> DataFrame:
    """(photo_id, field, tag, action, value, note): what each edited text field writes.

    A value goes to the primary tag, to mirrors the photo already has, and to fallbacks that held
    the old text; a cleared field deletes every tag that could bring it back. A value a tag can't
    hold is deleted there with a note. Of ``fields`` those with fallbacks are read (``COMPARED_FIELDS``).

    All is brought together by photo and field; only then edits are spread over their tags, and those rows are not shuffled."""
    spec = mirror_spec(tags.sparkSession)
    e = latest.where(F.col("field").isin(list(fixed.MIRROR_SPEC))).select("photo_id", "field", F.coalesce(text.strip(F.col("value")), F.lit("")).alias("value"))
    was = fields.select("photo_id", F.explode(F.create_map(*[x for n in COMPARED_FIELDS for x in (F.lit(n), F.col(n))])).alias("field", "was")).where("was IS NOT NULL")
    w = e.join(_held_values(tags, spec), ["photo_id", "field"], "left").join(was, ["photo_id", "field"], "left")
    # a tag that holds nothing is written only if it is the primary one
    w = w.join(F.broadcast(spec), "field").withColumn("old", F.col("held")[F.col("slot")]).where("old IS NOT NULL OR role = 'primary'")
    v, tag = F.col("value"), F.col("tag")
    held = F.col("old").isNotNull()
    same = text.collapse(F.col("old")) == text.collapse(F.col("was"))
    writes = (F.col("role") == "primary") | ((F.col("role") == "mirror") & held) | ((F.col("role") == "fallback") & held & same & (F.col("was") != ""))
    limits = F.create_map(*[F.lit(x) for kv in fixed.IPTC_MAX_BYTES.items() for x in kv])
    one_byte = F.translate(v, text._CP1252_CHARS, text._C1_CHARS).rlike(r"^[\x00-\xff]*$") & (text.repair_mojibake(v) == v)
    size = F.when(F.col("utf8"), F.octet_length(v)).otherwise(F.length(v))
    iptc_ok = (F.coalesce("utf8", F.lit(False)) | one_byte) & (size <= F.coalesce(F.try_element_at(limits, tag), F.lit(1 << 30)))
    wide = tag.rlike(r":XP|UserComment$") & (tag.rlike(":XP") | ~v.rlike(r"^[\x00-\x7f]*$"))
    exif_size = F.when(wide, 2 * F.length(v)).otherwise(F.octet_length(v))
    exif = F.split_part(tag, F.lit(":"), F.lit(1)).isin(fixed.EXIF_GROUPS)
    exif_ok = ~exif | F.lit(not jpeg) | (exif_size <= fixed.EXIF_JPEG_MAX_BYTES)
    fits = F.when(tag.startswith("IPTC:"), iptc_ok).otherwise(exif_ok)
    action = (
        F.when((v == "") & held, "delete")
        .when((v != "") & writes & fits, "set")
        .when((v != "") & writes & held, "delete")
        .when((v != "") & writes, "skip")
    )
    note = F.when((v != "") & writes & ~fits, F.lit("kept elsewhere: this tag can't hold it")).otherwise("")
    return w.select("photo_id", "field", "tag", action.alias("action"), F.when(action == "set", v).alias("value"), note.alias("note")).where("action IS NOT NULL")


_DATE_TAGS = fixed.DATE_CLEARED_TAGS


def date_tag_updates(date_edits: DataFrame, tags: DataFrame, as_of) -> DataFrame:
    """(photo_id, tag, action, value) for date edits (photo_id, iso, pattern; NULL iso clears). A
    fully known day the file already has keeps its clock time, and the other tags follow it."""
    have = tags.where(F.col("tag").isin(_DATE_TAGS)).groupBy("photo_id").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(f"t{i}") for i, t in enumerate(_DATE_TAGS)]
    )
    df = date_edits.join(have, "photo_id", "left")
    df = df.withColumn("_fill", dates.fill_date(dates.partial_date(F.col("iso"), as_of)))
    t = {name: F.col(f"t{i}") for i, name in enumerate(_DATE_TAGS)}

    def same_day(c):
        return dates.same_day(c, F.col("_fill"), as_of)

    exif, xmp = t["ExifIFD:DateTimeOriginal"], t["XMP-exif:DateTimeOriginal"]
    df = df.withColumns({"_e": same_day(exif), "_x": same_day(xmp), "_i": same_day(t["IPTC:DateCreated"])})
    df = df.withColumn("_cur", F.when(F.col("pattern") == "Y!M!D!", F.when(F.col("_e"), exif).when(F.col("_x"), xmp)))
    cleared, cur = F.col("iso").isNull(), F.col("_cur")
    keeps, renew = ~cleared & cur.isNotNull(), ~cleared & cur.isNull()
    day = F.date_format("_fill", "yyyy:MM:dd")
    whole = F.concat(day, F.lit(" 00:00:00"))

    def row(cond, tag, action, value=None):
        value = F.lit(None).cast("string") if value is None else value
        return F.when(cond, F.struct(F.lit(tag).alias("tag"), F.lit(action).alias("action"), value.alias("value")))

    rows = [row(cleared & c.isNotNull(), name, "delete") for name, c in t.items()]
    for name in ("ExifIFD:DateTimeOriginal", "XMP-exif:DateTimeOriginal"):
        rows.append(row(keeps & t[name].isNotNull() & (dates.moment(t[name]) != dates.moment(cur)), name, "set", cur))
    rows.append(row(keeps & t["IPTC:DateCreated"].isNotNull() & ~F.col("_i"), "IPTC:DateCreated", "set", day))
    rows.append(row(renew, "ExifIFD:DateTimeOriginal", "set", whole))
    rows.append(row(renew & xmp.isNotNull(), "XMP-exif:DateTimeOriginal", "set", whole))
    rows.append(row(renew & t["IPTC:DateCreated"].isNotNull(), "IPTC:DateCreated", "set", day))
    for name in ("ExifIFD:OffsetTimeOriginal", "ExifIFD:SubSecTimeOriginal", "IPTC:TimeCreated"):
        rows.append(row(renew & t[name].isNotNull(), name, "delete"))
    rows.append(row(~cleared, "XMP-photoshop:DateCreated", "set", F.translate("iso", "-", ":")))
    return df.select("photo_id", F.inline(F.array_compact(F.array(*rows))))


def list_people_sync(listed: DataFrame, faces: DataFrame, after: DataFrame, face_edits: DataFrame) -> DataFrame:
    """The listed-people tag after face edits: a name no face has any more goes, a new one is added,
    a changed capitalisation is taken over. Only photos that list people are touched."""
    rows = listed.where(text.present(F.col("name"))).select("photo_id", "item", F.trim("name").alias("name"), F.lower(F.trim("name")).alias("key"))
    touched = face_edits.where("(has_name OR deleted) AND face_key NOT LIKE 'new:%'").select("photo_id", "face_key")
    old = faces.join(touched, ["photo_id", "face_key"]).select("photo_id", F.lower(F.trim("name")).alias("key")).where("key <> ''").distinct()
    final = after.where("name <> ''").select("photo_id", F.lower("name").alias("key")).distinct()
    gone = old.join(final, ["photo_id", "key"], "left_anti")
    named = face_edits.where("has_name AND NOT deleted AND trim(name) <> ''").select("photo_id", "face_key", F.trim("name").alias("new_name"))
    alive = after.select("photo_id", "face_key")
    named = named.join(alive, ["photo_id", "face_key"]).groupBy("photo_id", F.lower("new_name").alias("key")).agg(F.min("new_name").alias("new_name"))
    kept = rows.join(gone, ["photo_id", "key"], "left_anti").join(named, ["photo_id", "key"], "left")
    # a list is re-spelled once, at its first place
    first = kept.groupBy("photo_id", "key").agg(F.min("item").alias("first_item"))
    kept = kept.join(first, ["photo_id", "key"]).select(
        "photo_id", "item", F.when(F.col("item") == F.col("first_item"), F.coalesce("new_name", "name")).otherwise(F.col("name")).alias("name")
    )
    lists = rows.select("photo_id").distinct()
    added = named.join(rows.select("photo_id", "key").distinct(), ["photo_id", "key"], "left_anti").join(lists, "photo_id", "left_semi")
    return kept.unionByName(added.select("photo_id", F.lit(None).cast("long").alias("item"), F.col("new_name").alias("name")))


# -- checking what was written -----------------------------------------------------------------------


def check_text_fields(expected: DataFrame, got: DataFrame, latest: DataFrame) -> DataFrame:
    """(photo_id, field) of edited text fields that did not arrive, white space aside."""

    def rows(df, out):
        pairs = F.create_map(*[x for n in fixed.TEXT_FIELDS for x in (F.lit(n), F.col(n))])
        return df.select("photo_id", F.explode(pairs).alias("field", "v")).select("photo_id", "field", text.collapse(F.col("v")).alias(out))

    wanted = latest.where(F.col("field").isin(fixed.TEXT_FIELDS)).select("photo_id", "field")
    both = rows(expected, "want").join(wanted, ["photo_id", "field"]).join(rows(got, "have"), ["photo_id", "field"], "left")
    return both.where(F.col("want") != F.coalesce("have", F.lit(""))).select("photo_id", "field")


def check_dates(expected: DataFrame, got: DataFrame, latest: DataFrame, as_of) -> DataFrame:
    """Photos whose edited date did not arrive: date and certainty read the same, however written."""

    def read(df, out):
        cut = dates.apply_certainty(dates.partial_date(F.col("date"), as_of), F.col("certainty"))
        sure = F.coalesce(F.col("c.guess_year") | F.col("c.guess_month") | F.col("c.guess_day") | F.col("c.no_year"), F.lit(False))
        shown = F.struct(F.coalesce(dates.iso_text(F.col("c")), text.collapse(F.col("date"))).alias("iso"), sure.alias("guessed"))
        return df.withColumn("c", cut).select("photo_id", shown.alias(out))

    dated = latest.where("field = 'date'").select("photo_id")
    both = read(expected, "want").join(dated, "photo_id").join(read(got, "have"), "photo_id", "left")
    return both.where(~F.col("want").eqNullSafe(F.col("have"))).select("photo_id", F.lit("date").alias("field"))


def check_keyword_sets(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Photos whose keyword sets differ, case aside (expected and got are keyword rows)."""

    def keys(df):
        return df.select("photo_id", F.lower("keyword").alias("k")).distinct()

    e, g = keys(expected), keys(got)
    off = e.join(g, ["photo_id", "k"], "left_anti").unionByName(g.join(e, ["photo_id", "k"], "left_anti"))
    return off.select("photo_id", F.lit("keywords").alias("field")).distinct()


def check_faces(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Photos whose faces differ: names as multisets (case aside), or a placed face that is not there
    with the same name and nearly the same box."""

    def counts(df):
        return df.groupBy("photo_id", F.lower(F.trim("name")).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    e, g = counts(expected), counts(got).withColumnRenamed("n", "m")
    off = e.join(g, ["photo_id", "k"], "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).select("photo_id")
    placed = expected.where(has_box() & (F.trim("name") != "")).select("photo_id", "name", "face_key", *BOX)
    right = got.select("photo_id", "name", *[F.col(c).alias("r" + c) for c in BOX])
    found = overlap_pairs(placed, right, ["photo_id", "name"], boxes.iou(), 0.95).select("photo_id", "face_key").distinct()
    moved = placed.join(found, ["photo_id", "face_key"], "left_anti").select("photo_id")
    return off.unionByName(moved).distinct().select("photo_id", F.lit("faces").alias("field"))


def before_image(tags: DataFrame, touched: DataFrame) -> DataFrame:
    """The old values of every touched tag as JSON, tag by tag in order. ``touched`` is (photo_id,
    tag) of a write plan, so a photo's list is as short as its plan."""
    old = tags.where("value IS NOT NULL").join(touched.select("photo_id", "tag").distinct(), ["photo_id", "tag"], "left_semi")
    per_tag = old.groupBy("photo_id", "tag").agg(F.min(F.struct("item", "value")).alias("v"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("tag"), F.col("v.value").alias("value"))))
    return per_tag.groupBy("photo_id").agg(F.to_json(F.map_from_entries(listed)).alias("before"))


def describe_changes(fields: DataFrame, latest: DataFrame) -> DataFrame:
    """One line per changed field: old -> new."""
    names = fixed.TEXT_FIELDS + ["date"]
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    was = fields.select("photo_id", F.explode(pairs).alias("field", "was"))
    none = F.lit("(none)")
    line = F.concat("field", F.lit(": "), F.coalesce("was", none), F.lit(" -> "), F.coalesce("value", none))
    return latest.join(was, ["photo_id", "field"], "left").select("photo_id", "field", line.alias("change"))


def edit_count(edits: DataFrame, face_edits: DataFrame) -> DataFrame:
    """Edited details per photo: each field once, each face once. Fields and keys are first made
    distinct, so the count is an ordinary sum."""
    a = edits.select("photo_id", F.col("field").alias("what"))
    b = face_edits.select("photo_id", F.concat(F.lit("face "), "face_key").alias("what"))
    return a.unionByName(b).distinct().groupBy("photo_id").agg(F.count(F.lit(1)).alias("edits"))


# -- drafts and file versions ------------------------------------------------------------------------


def draft_validity(drafts: DataFrame, inventory: DataFrame) -> DataFrame:
    """A draft still belongs to its file when size and time are the same, else when size and quick
    hash are; a missing file makes it invalid. ``inventory``: path, size_bytes, mtime_ns, quick_hash."""
    now = inventory.select("path", F.col("size_bytes").alias("size_now"), F.col("mtime_ns").alias("mtime_now"), F.col("quick_hash").alias("hash_now"))
    d = drafts.join(now, "path", "left")
    same_size = F.col("size_bytes") == F.col("size_now")
    status = (
        F.when(F.col("size_now").isNull(), "missing")
        .when(same_size & (F.col("mtime_ns") == F.col("mtime_now")), "valid")
        .when(same_size & (F.col("quick_hash") == F.col("hash_now")), "valid by content")
        .otherwise("stale")
    )
    return d.select("draft_no", "path", status.alias("status"))


def prune_drafts(drafts: DataFrame, as_of, days: int = fixed.DRAFT_DAYS) -> DataFrame:
    """Drafts updated within ``days`` (their file's time where no update is recorded)."""
    limit = F.to_timestamp_ntz(F.lit(str(as_of))) - F.make_dt_interval(F.lit(days))
    return drafts.where(F.coalesce("updated", "file_time") >= limit)


def clear_superseded_drafts(drafts: DataFrame, saves: DataFrame) -> DataFrame:
    """Add ``action`` to drafts of saved photos: delete, keep details only, or keep.

    ``saves`` (photo_id, state_hash, is_copy, unhashed, details_written), one per photo. A draft
    edited since keeps everything; a copy leaves the edited details as the original's draft; a
    details-only draft whose details were written into the original is done."""
    s = saves.select("photo_id", F.col("state_hash").alias("saved_hash"), "is_copy", "unhashed", "details_written")
    d = drafts.join(s, "photo_id", "left")
    same = F.coalesce(F.col("state_hash") == F.col("saved_hash"), F.lit(False))
    mine = same | (F.col("unhashed") & F.col("state_hash").isNull() & ~F.col("is_copy"))
    done = F.col("details_written") & ~F.col("is_copy") & F.col("has_details") & ~F.col("has_caption_edits")
    action = (
        F.when(F.col("saved_hash").isNull(), "keep")
        .when(same & F.col("is_copy") & F.col("has_details"), "keep details")
        .when(mine | done, "delete")
        .otherwise("keep")
    )
    return d.select("draft_no", "photo_id", action.alias("action"))


def stat_change(before: DataFrame, now: DataFrame) -> DataFrame:
    """What happened to each file between two scans (path, size_bytes, mtime_ns, file_id,
    content_hash): same size, time and file: unchanged; same size only: the hash decides."""
    a = before.select("path", *[F.col(c).alias(c + "_0") for c in ("size_bytes", "mtime_ns", "file_id", "content_hash")])
    both = a.join(now.select("path", "size_bytes", "mtime_ns", "file_id", "content_hash"), "path", "full_outer")
    same_size = F.col("size_bytes") == F.col("size_bytes_0")
    replaced = F.coalesce(F.col("file_id") != F.col("file_id_0"), F.lit(False))
    change = (
        F.when(F.col("size_bytes_0").isNull(), "added")
        .when(F.col("size_bytes").isNull(), "removed")
        .when(same_size & (F.col("mtime_ns") == F.col("mtime_ns_0")) & ~replaced, "unchanged")
        .when(same_size & (F.col("content_hash") == F.col("content_hash_0")), "touched")
        .otherwise("changed")
    )
    return both.select("path", change.alias("change"))
