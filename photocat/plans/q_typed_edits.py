"""Registered queries on typed change sets: every photo has an edit of its creators, many of their date, title or keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.operators import typed_edits as te
from photocat.plans import date_sql as ds
from photocat.plans.registry import query
from photocat.plans.views import load

AS_OF = ds.AS_OF


def _checked(spark, sf):
    return te.validate_typed_edits(te.typed(load(spark, sf, "typed_edits")), AS_OF)


# what each of the fixture's edits must come to, by the number of its photo
MEANT = """, meant AS (SELECT photo_id, field, edit_seq, edited_at,
  CASE field WHEN 'creator' THEN CASE photo_id % 7 WHEN 4 THEN 'line breaks' WHEN 6 THEN 'an item is not text' ELSE '' END
    WHEN 'date' THEN CASE photo_id % 8 WHEN 3 THEN 'does not fit the level' WHEN 5 THEN 'not a date' WHEN 7 THEN 'not a date edit' ELSE '' END ELSE '' END AS errors,
  CASE field WHEN 'creator' THEN CASE photo_id % 7 WHEN 0 THEN 'Smith, John|Jones, Mary|Lee, Ann' WHEN 1 THEN 'ACME; Inc.|Jane' WHEN 2 THEN 'One, Name' WHEN 3 THEN '' END
    WHEN 'date' THEN CASE photo_id % 8 WHEN 0 THEN '1952-06 month false' WHEN 1 THEN '1952 year true' WHEN 2 THEN '1952-06-14 day true' WHEN 6 THEN '1960-05-06 day false Y!M!D~' END
    WHEN 'title' THEN CASE edited_at WHEN 2 THEN 'Title ' || photo_id ELSE 'old' END
    WHEN 'keywords' THEN 'Sea|Boat' END AS stored FROM typed_edits)"""


@query("e1_validate_typed_edits", "typed_edits", MEANT + " SELECT photo_id, field, edit_seq, errors, stored FROM meant")
def _(spark, sf):
    d = F.try_variant_get("value", "$", te.DATE)
    date = F.when(d.isNotNull(), F.concat_ws(" ", d["iso"], d["level"], d["estimate"].cast("string"), d["pattern"]))
    listed = F.array_join(F.try_variant_get("value", "$", "array<string>"), "|")
    stored = F.when(F.col("field") == "date", date).when(F.col("field").isin(te.LISTS), F.coalesce(listed, F.try_variant_get("value", "$", "string"))).otherwise(F.try_variant_get("value", "$", "string"))
    ok = F.size("errors") == 0
    return _checked(spark, sf).select("photo_id", "field", "edit_seq", F.array_join("errors", "; ").alias("errors"), F.when(ok, stored).alias("stored"))


def _fields(spark, sf):
    k = F.col("c_custkey")
    own = F.array(F.concat(F.lit("Own, "), "c_name"), F.lit("Second"))
    nothing = [F.lit(None).cast("string").alias(n) for n in ("caption", "notes", "sublocation", "city", "state", "country")]
    return load(spark, sf, "customer").select(
        k.alias("photo_id"), F.col("c_name").alias("title"), *nothing, own.alias("creators"), te.joined_creators(own).alias("creator"),
        F.array(F.lit("Hill"), F.lit("DATE: Y!M~")).alias("keywords"), F.lit("1950-01").alias("date"), F.lit("Y!M~").alias("certainty"),
    )


def _after(spark, sf):
    checked = _checked(spark, sf).where("size(errors) = 0")
    return checked, te.apply_typed_edits(_fields(spark, sf), checked)


AFTER = """, w AS (SELECT c_custkey AS k, c_custkey % 7 AS c, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 8 ELSE 9 END AS d, c_name FROM customer),
 o AS (SELECT k AS photo_id, CASE WHEN k % 2 = 0 THEN 'Title ' || k ELSE c_name END AS title,
  CASE c WHEN 0 THEN 'Smith, John|Jones, Mary|Lee, Ann' WHEN 1 THEN 'ACME; Inc.|Jane' WHEN 2 THEN 'One, Name' WHEN 3 THEN '' WHEN 5 THEN '' ELSE 'Own, ' || c_name || '|Second' END AS creators,
  CASE c WHEN 0 THEN 'Smith, John; Jones, Mary; Lee, Ann' WHEN 1 THEN 'ACME; Inc., Jane' WHEN 2 THEN 'One, Name' WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 'Own, ' || c_name || '; Second' END AS creator,
  CASE d WHEN 0 THEN '1952-06' WHEN 1 THEN '1952' WHEN 2 THEN '1952-06-14' WHEN 4 THEN NULL WHEN 6 THEN '1960-05-06' ELSE '1950-01' END AS date,
  CASE d WHEN 0 THEN 'Y!M!' WHEN 1 THEN 'Y~' WHEN 2 THEN 'Y!M!D~' WHEN 4 THEN NULL WHEN 6 THEN 'Y!M!D~' ELSE 'Y!M~' END AS certainty FROM w)"""


@query(
    "e3_apply_typed_edits",
    "typed_edits",
    AFTER + """ SELECT *, CASE WHEN photo_id % 5 = 0 THEN 'Sea|Boat' ELSE 'Hill' END || CASE WHEN certainty IS NULL THEN '' ELSE '|DATE: ' || certainty END AS keywords FROM o""",
)
def _(spark, sf):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _after(spark, sf)[1].select("photo_id", "title", joined("creators"), "creator", "date", "certainty", joined("keywords"))


@query(
    "e10_check_written_creators",
    "typed_edits",
    """SELECT photo_id, 'creator' AS field FROM typed_edits WHERE field = 'creator' AND photo_id % 7 IN (0, 1) AND photo_id % 4 < 2""",
)
def _(spark, sf):
    # written back: some lists lost their last name, some came back in another order, the rest with blanks around
    checked, after = _after(spark, sf)
    k, c = F.col("photo_id") % 4, F.col("creators")
    lost = F.when(F.size(c) > 1, F.slice(c, 1, F.size(c) - 1)).otherwise(c)
    got = F.when(k == 0, lost).when(k == 1, F.reverse(c)).otherwise(F.transform(c, lambda x: F.concat(F.lit(" "), x)))
    return te.check_creators(after, after.select("photo_id", got.alias("creators")), checked)
