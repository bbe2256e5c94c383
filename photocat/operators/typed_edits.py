"""Change sets whose values have a type: one VARIANT per edit.

A text field is a string, the creators and the keywords are lists, a date is an object (iso, level, estimate, pattern), and
null clears any of them. Edits are checked, overlaid and compared as such, so a creator with a comma stays one creator and a
date keeps its level and its estimate. ``edits``: photo_id, field, value (VARIANT), edited_at, edit_seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.functions import dates, text
from photocat.functions import fixed_values as fixed
from photocat.functions.groups import spread
from photocat.operators.edits import Limits, text_problems

LISTS = ["creator", "keywords"]
KNOWN = [*fixed.TEXT_FIELDS, "keywords", "date"]
DATE = "struct<iso:string,level:string,estimate:boolean,pattern:string>"


def typed(edits: DataFrame, json: str = "value") -> DataFrame:
    """Edits whose value is JSON text, with it as a VARIANT. Text that is no JSON becomes null, and ``unreadable``."""
    v = F.try_parse_json(json)
    return edits.withColumns({"unreadable": F.col(json).isNotNull() & v.isNull(), "value": v})


def _kind() -> Column:
    """string, list, object, null, or another type's name."""
    k = F.coalesce(F.schema_of_variant("value"), F.lit("VOID"))
    return F.when(k == "STRING", "string").when(k.startswith("ARRAY"), "list").when(k.startswith("OBJECT"), "object").when(k == "VOID", "null").otherwise(F.lower(k))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("value", path, kind)


def _items() -> Column:
    """A list's items as texts; items of other types are null."""
    parts = _get("$", "array<variant>")
    return F.transform(parts, lambda x: F.when(F.schema_of_variant(x) == "STRING", text.unix_lines(F.try_variant_get(x, "$", "string"))))


def _tidy_list(items: Column) -> Column:
    return F.filter(F.transform(items, text.strip), lambda x: x != "")


def _first_of_each(items: Column) -> Column:
    """Without repeats, case aside: the first spelling stays, in order."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def validate_typed_edits(edits: DataFrame, as_of, limits: Limits = Limits()) -> DataFrame:
    """Add ``errors`` (empty when the edit can be taken) and bring ``value`` into the form that is stored: trimmed texts, lists
    without blanks (keywords also without repeats and date markers), dates with their level, estimate and own pattern."""
    # checking costs far more than reading: a small file of very many edits is dealt to all tasks first
    df = spread(edits).withColumn("_kind", _kind()).withColumn("_items", F.when(F.col("_kind") == "list", _items()))
    iso, level, own = F.trim(_get("$.iso", "string")), _get("$.level", "string"), F.upper(F.trim(_get("$.pattern", "string")))
    df = df.withColumns({n: F.when(F.col("_kind") == "object", c) for n, c in {"_iso": iso, "_level": level, "_own": own}.items()})
    df = df.withColumns({"_text": F.when(F.col("_kind") == "string", text.unix_lines(_get("$", "string"))), "_kinds": F.when(F.col("_kind") == "object", F.schema_of_variant(F.try_variant_get("value", "$.estimate", "variant")))})
    field, kind, items, one = (F.col(c) for c in ("field", "_kind", "_items", "_text"))
    is_text = field.isin(fixed.TEXT_FIELDS) & ~((field == "creator") & (kind == "list"))
    is_list = (field == "keywords") | ((field == "creator") & (kind == "list"))
    is_date, multiline = field == "date", field.isin(fixed.MULTILINE_FIELDS)

    limit = F.when(multiline, limits.text).otherwise(limits.line)
    per_item = F.when(field == "creator", limits.line).otherwise(limits.keyword)

    def any_item(n: int) -> Column:
        return F.exists(items, lambda x: F.coalesce(text_problems(x, F.lit(False), per_item)[n][0], F.lit(False)))

    bad_items = [(is_list & any_item(n), why) for n, (_, why) in enumerate(text_problems(one, F.lit(False), per_item))]

    iso, level, own = (F.col(c) for c in ("_iso", "_level", "_own"))
    simple = F.when(level == "circa", "year").otherwise(level)  # an older way to say: an estimated year
    parts, want = F.size(F.split(iso, "-")), F.when(simple == "day", 3).when(simple == "month", 2).otherwise(1)
    shape = iso.rlike(r"^\d{4}(?:-\d{2}(?:-\d{2})?)?$")
    dated = is_date & (kind != "null")
    some = F.coalesce(F.col("unreadable"), F.lit(False)) if "unreadable" in edits.columns else F.lit(False)
    false = F.lit(False)
    errors = text.reasons(
        (some, "no JSON"),
        (~F.coalesce(field.isin(KNOWN), false), "unknown field"),
        (is_text & ~kind.isin("string", "null"), "not text"),
        *[(is_text & F.coalesce(cond, false), why) for cond, why in text_problems(one, multiline, limit)],
        (is_list & ~kind.isin("list", "null"), "not a list"),
        (is_list & F.exists(items, lambda x: x.isNull()), "an item is not text"),
        *bad_items,
        ((field == "creator") & (F.size(items) > limits.creators), "too many creators"),
        ((field == "keywords") & (F.size(items) > limits.keywords), "too many keywords"),
        (dated & ~F.coalesce((kind == "object") & iso.isNotNull() & level.isin("day", "month", "year", "circa"), false), "not a date edit"),
        (dated & ~F.coalesce(F.col("_kinds"), F.lit("VOID")).isin("VOID", "BOOLEAN"), "estimate is not true or false"),
        (dated & F.coalesce(~own.rlike(dates.PATTERN), false), "bad pattern"),
        (dated & F.coalesce(~shape, false), "not written as a date"),
        (dated & F.coalesce(shape & (parts != want), false), "does not fit the level"),
        (dated & F.coalesce(shape & dates.partial_date(iso, as_of).isNull(), false), "not a date"),
    )
    estimate = (level == "circa") | F.coalesce(_get("$.estimate", "boolean"), false)
    plain = dates.level_pattern(simple, estimate)
    written = dates.edit_pattern(simple, estimate, own)
    date = F.to_variant_object(F.struct(iso.alias("iso"), simple.alias("level"), estimate.alias("estimate"), F.when(written != plain, written).alias("pattern")))
    tidy = _tidy_list(items)
    listed = F.when(field == "keywords", F.filter(_first_of_each(tidy), lambda x: ~text.is_date_marker(x))).otherwise(tidy)
    out = F.when(kind == "null", F.parse_json(F.lit("null"))).when(is_text, text.strip(one).cast("variant")).when(is_list, F.to_variant_object(listed)).when(is_date, date)
    keep = [c for c in edits.columns if c not in ("value", "unreadable")]
    checked = df.withColumn("errors", errors)
    # a generator: filters on its columns stay above it, so no check is copied into them
    done = F.struct(F.when(F.size("errors") == 0, out).otherwise(F.col("value")).alias("value"), F.col("errors").alias("errors"))
    return checked.select(*keep, F.inline(F.array(done)))


def latest_values(edits: DataFrame, fields: list[str]) -> DataFrame:
    """One row per photo with the last value of every field as a VARIANT (null: not edited; a clearing edit holds null)."""
    at = F.struct("edited_at", "edit_seq")
    given = F.coalesce(F.col("value"), F.parse_json(F.lit("null")))
    return edits.groupBy("photo_id").agg(*[F.max_by(given, F.when(F.col("field") == n, at)).alias("e_" + n) for n in fields])


def creator_names(value: Column) -> Column:
    """The creators an edit names: a list as given, a text as one name, none where it clears."""
    one = F.try_variant_get(value, "$", "string")
    listed = F.try_variant_get(value, "$", "array<string>")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return _tidy_list(F.when(is_list, listed).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")))


def joined_creators(names: Column) -> Column:
    """One text: "; " between names when any of them holds a comma, else ", "; null for none."""
    comma = F.exists(names, lambda x: F.contains(x, F.lit(",")))
    return F.when(F.size(names) > 0, F.when(comma, F.array_join(names, "; ")).otherwise(F.array_join(names, ", ")))


def apply_typed_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Caption fields as they will be: ``fields`` has photo_id, the text fields, creators (array), keywords (array), date and
    certainty. A date keeps the level, the estimate and the pattern of its edit; its marker follows the keywords."""
    df = fields.join(latest_values(edits, KNOWN), "photo_id", "left")
    edited = lambda n: F.col("e_" + n).isNotNull()
    out = {n: F.when(edited(n), F.nullif(text.strip(F.try_variant_get("e_" + n, "$", "string")), F.lit(""))).otherwise(F.col(n)) for n in fixed.TEXT_FIELDS if n != "creator"}
    creators = F.when(edited("creator"), creator_names(F.col("e_creator"))).otherwise(F.col("creators"))
    out["creators"] = creators
    out["creator"] = F.when(edited("creator"), joined_creators(creators)).otherwise(F.col("creator"))
    date = F.try_variant_get("e_date", "$", DATE)
    certain = dates.edit_pattern(date["level"], date["estimate"], date["pattern"])
    out["date"] = F.when(edited("date"), date["iso"]).otherwise(F.col("date"))
    out["certainty"] = F.when(edited("date"), F.when(date.isNotNull(), certain)).otherwise(F.col("certainty"))
    none = F.array().cast("array<string>")
    words = F.when(edited("keywords"), F.coalesce(F.try_variant_get("e_keywords", "$", "array<string>"), none)).otherwise(
        F.when(edited("date"), F.filter("keywords", lambda x: ~text.is_date_marker(x))).otherwise(F.col("keywords"))
    )
    own_marks = F.when(edited("keywords") & ~edited("date"), F.filter("keywords", text.is_date_marker)).otherwise(none)
    marker = F.when(edited("date") & date.isNotNull(), F.array(F.concat(F.lit("DATE: "), certain))).otherwise(none)
    out["keywords"] = F.concat(F.coalesce(words, none), F.coalesce(own_marks, none), marker)
    rest = [c for c in fields.columns if c not in out]
    return df.select(*rest, *[c.alias(n) for n, c in out.items()])


def check_creators(expected: DataFrame, got: DataFrame, edits: DataFrame) -> DataFrame:
    """(photo_id, field) of edited creator lists that did not arrive: other names, or another order."""
    asked = edits.where("field = 'creator'").select("photo_id").distinct()
    none = F.array().cast("array<string>")
    read = lambda df, out: df.select("photo_id", F.transform(F.coalesce("creators", none), text.strip).alias(out))
    both = read(expected, "want").join(asked, "photo_id", "left_semi").join(read(got, "have"), "photo_id", "left")
    return both.where(F.col("want") != F.coalesce("have", none)).select("photo_id", F.lit("creator").alias("field"))


def date_edit_rows(edits: DataFrame) -> DataFrame:
    """(photo_id, iso, pattern) of the last date edits, as the writers of date tags and markers take them; null clears."""
    date = F.try_variant_get("e_date", "$", DATE)
    last = latest_values(edits, ["date"]).where("e_date IS NOT NULL")
    return last.select("photo_id", date["iso"].alias("iso"), F.when(date.isNotNull(), dates.edit_pattern(date["level"], date["estimate"], date["pattern"])).alias("pattern"))


def keyword_edit_rows(edits: DataFrame) -> DataFrame:
    """(photo_id, item, keyword) of the last keyword edits."""
    last = latest_values(edits, ["keywords"]).select("photo_id", F.posexplode(F.try_variant_get("e_keywords", "$", "array<string>")).alias("item", "keyword"))
    return last.select("photo_id", F.col("item").cast("long").alias("item"), "keyword")
