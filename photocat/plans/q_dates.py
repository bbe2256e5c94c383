"""Registered date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.functions import dates
from photocat.operators import partial_dates
from photocat.plans import date_sql as ds
from photocat.plans.registry import query
from photocat.plans.views import load

AS_OF = ds.AS_OF


def _texts(spark, sf, as_of=AS_OF):
    return dates.with_partial_date(load(spark, sf, "date_texts"), "value", "date", as_of)


PARSED = ", " + ds.parsed("p", "date_texts", "text_no, value, pattern, level, estimate", "value")


@query("d1_normalize_dates", "date_texts", PARSED + " SELECT text_no, value, y AS year, m AS month, d AS day FROM p")
def _(spark, sf):
    return _texts(spark, sf).select("text_no", "value", "date.year", "date.month", "date.day")


@query(
    "d2_date_validity",
    "date_texts",
    ", "
    + ds.parsed("p", "date_texts", "text_no, value", "value", "1960-06-01")
    + f" SELECT text_no, {ds.iso()} AS iso FROM p WHERE y IS NOT NULL",
)
def _(spark, sf):
    d = _texts(spark, sf, "1960-06-01")
    return d.where("date IS NOT NULL").select("text_no", dates.iso_text(F.col("date")).alias("iso"))


@query("d3_approximate_text", "date_texts", PARSED + f" SELECT text_no, {ds.rough('value')} AS approximate FROM p")
def _(spark, sf):
    return _texts(spark, sf).select("text_no", dates.approximate_text(F.col("value"), F.col("date")).alias("approximate"))


@query("d4_certain_year", "date_texts", f"SELECT text_no, {ds.certain_year('value')} AS certain_year FROM date_texts")
def _(spark, sf):
    return load(spark, sf, "date_texts").select("text_no", dates.certain_year(F.col("value"), AS_OF).alias("certain_year"))


CUT = PARSED + ", " + ds.cut("c", "p", "text_no, value", "pattern")


@query(
    "d5_apply_certainty",
    "date_texts",
    CUT + " SELECT text_no, CASE WHEN known THEN y END AS year, CASE WHEN known THEN m END AS month, CASE WHEN known THEN d END AS day,"
    " known AND no_year AS no_year, known AND (gy OR gm OR gd) AS guessed FROM c",
)
def _(spark, sf):
    c = _texts(spark, sf).withColumn("c", dates.apply_certainty(F.col("date"), F.col("pattern")))
    no = F.lit(False)
    guessed = F.col("c.guess_year") | F.col("c.guess_month") | F.col("c.guess_day")
    return c.select(
        "text_no", "c.year", "c.month", "c.day",
        F.coalesce("c.no_year", no).alias("no_year"), F.coalesce(guessed, no).alias("guessed"),
    )


@query(
    "d6_format_partial_date",
    "date_texts",
    PARSED
    + f""" SELECT text_no, {ds.in_words()} AS auto, coalesce({ds.iso()}, '') AS iso,
 CASE WHEN d IS NOT NULL THEN d || ' ' || {ds.month_name()} || ', ' || y WHEN m IS NOT NULL THEN {ds.month_name()} || ' ' || y
      WHEN y IS NOT NULL THEN cast(y AS varchar) ELSE '' END AS long_form,
 CASE WHEN m IS NOT NULL THEN y || ' (' || substr({ds.month_name()}, 1, 3) || ')' WHEN y IS NOT NULL THEN cast(y AS varchar)
      ELSE '' END AS bracketed,
 CASE WHEN d IS NOT NULL THEN printf('%02d/%02d/%02d', d, m, y % 100) WHEN m IS NOT NULL THEN printf('%02d/%02d', m, y % 100)
      WHEN y IS NOT NULL THEN printf('%02d', y % 100) ELSE '' END AS slashed,
 CASE WHEN d IS NOT NULL THEN 'day ' || d || ' of ' || m WHEN m IS NOT NULL THEN 'day ' || m ELSE '' END AS quoted FROM p""",
)
def _(spark, sf):
    d = F.col("date")
    forms = {
        "auto": None, "iso": "iso", "long_form": "d mmmm, yyyy", "bracketed": "yyyy (mmm)", "slashed": "dd/mm/yy",
        "quoted": "'day 'd' of 'm",
    }
    return _texts(spark, sf).select("text_no", *[dates.format_partial(d, f).alias(n) for n, f in forms.items()])


@query(
    "d7_render_date",
    "date_texts",
    CUT
    + f""" SELECT text_no, {ds.rendered('value')} AS printed,
 CASE WHEN y IS NULL THEN coalesce(printf('%04d', {ds.certain_year(ds.rough('value'))}), {ds.rough('value')})
      WHEN NOT known OR no_year THEN '' WHEN gy THEN 'c. ' || printf('%04d', y) ELSE printf('%04d', y) END AS year_only FROM c""",
)
def _(spark, sf):
    value, pattern = F.col("value"), F.col("pattern")
    return load(spark, sf, "date_texts").select(
        "text_no",
        dates.rendered_date(value, AS_OF, certainty=pattern).alias("printed"),
        dates.rendered_date(value, AS_OF, fmt="yyyy", certainty=pattern).alias("year_only"),
    )


@query(
    "d8_fill_partial_date",
    "date_texts",
    PARSED + " SELECT text_no, printf('%04d-%02d-%02d', y, coalesce(m, 6), coalesce(d, 15)) AS filled FROM p WHERE y IS NOT NULL",
)
def _(spark, sf):
    d = _texts(spark, sf).where("date IS NOT NULL")
    return d.select("text_no", dates.fill_date(F.col("date")).cast("string").alias("filled"))


@query(
    "d9_date_level_pattern",
    "date_texts",
    """, t AS (SELECT text_no, level, estimate, coalesce(pattern, '') AS own,
   CASE level WHEN 'day' THEN 3 WHEN 'month' THEN 2 ELSE 1 END AS rank FROM date_texts),
 f AS (SELECT *, CASE WHEN estimate THEN CASE level WHEN 'day' THEN 'Y!M!D~' WHEN 'month' THEN 'Y!M~' ELSE 'Y~' END
    ELSE CASE level WHEN 'day' THEN 'Y!M!D!' WHEN 'month' THEN 'Y!M!' ELSE 'Y!' END END AS standard,
   CASE WHEN regexp_matches(own, 'M[!~@]D[!~@]') THEN 3 WHEN regexp_matches(own, 'M[!~@]') THEN 2 ELSE 1 END AS finest FROM t)
 SELECT text_no, standard, CASE WHEN own <> '' AND (own NOT LIKE 'Y?%' OR finest > 1) AND finest <= rank THEN own
   ELSE standard END AS written FROM f""",
)
def _(spark, sf):
    level, estimate = F.col("level"), F.col("estimate")
    return load(spark, sf, "date_texts").select(
        "text_no",
        dates.level_pattern(level, estimate).alias("standard"),
        dates.edit_pattern(level, estimate, F.col("pattern")).alias("written"),
    )


@query(
    "d10_date_quality_profile",
    "tags photos",
    """, v AS (SELECT t.photo_id, t.value, regexp_extract(p.path, '^(.*)/[^/]*$', 1) AS folder, CASE t.photo_id % 4 WHEN 0 THEN 'Y~' WHEN 1 THEN 'Y!M~' WHEN 2 THEN 'Y?M!D!' END AS certainty
      FROM tags t JOIN photos p ON t.photo_id = p.photo_id WHERE t.tag = 'XMP-photoshop:DateCreated'), """
    + ds.parsed("p", "v", "folder, value, certainty", "value")
    + """, kinds AS (SELECT *, CASE WHEN d IS NOT NULL THEN 'day' WHEN m IS NOT NULL THEN 'month' WHEN y IS NOT NULL THEN 'year'
       WHEN regexp_matches(coalesce(value, ''), '[1-9]') THEN 'approximate' ELSE 'none' END AS kind FROM p)"""
    + ", "
    + ds.cut("c2", "p", "folder, kind, y AS year", "certainty").replace("FROM p)", "FROM kinds)", 1)
    + """, k AS (SELECT folder, kind, year AS y, known AND (gy OR gm OR gd OR no_year) AS guessed FROM c2)
 SELECT folder, kind, count(*) AS photos, count(*) FILTER (guessed) AS guessed, round(count(*) FILTER (guessed) / count(*), 6) AS guessed_share, cast(min(y) AS bigint) AS first_year, cast(max(y) AS bigint) AS last_year,
   cast(grouping(folder, kind) AS bigint) AS level FROM k GROUP BY ROLLUP (folder, kind)""",
)
def _(spark, sf):
    created = load(spark, sf, "tags").where("tag = 'XMP-photoshop:DateCreated'")
    photos = load(spark, sf, "photos").select("photo_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    k = F.col("photo_id") % 4
    rated = created.join(photos, "photo_id").withColumn("certainty", F.when(k == 0, "Y~").when(k == 1, "Y!M~").when(k == 2, "Y?M!D!"))
    return partial_dates.date_quality_profile(rated, "value", "folder", AS_OF, "certainty")


@query(
    "d11_same_moment",
    "date_texts",
    """, m AS (SELECT text_no, CASE WHEN regexp_matches(value, '^\\s*\\d{4}[-:]\\d{2}[-:]\\d{2}') THEN
      substr(trim(value), 1, 4) || ':' || substr(trim(value), 6, 2) || ':' || substr(trim(value), 9, 2) || ' ' ||
      CASE WHEN regexp_matches(value, '^\\s*\\d{4}[-:]\\d{2}[-:]\\d{2}[ T]\\d{2}:\\d{2}:\\d{2}') THEN substr(trim(value), 12, 8)
           WHEN regexp_matches(value, '^\\s*\\d{4}[-:]\\d{2}[-:]\\d{2}[ T]\\d{2}:\\d{2}') THEN substr(trim(value), 12, 5) || ':00'
           ELSE '00:00:00' END ELSE '' END AS moment FROM date_texts)
 SELECT text_no, moment, moment <> '' AND moment LIKE '%00:00:00' AS midnight FROM m""",
)
def _(spark, sf):
    t = load(spark, sf, "date_texts").select("text_no", dates.moment(F.col("value")).alias("moment"))
    return t.withColumn("midnight", F.col("moment").endswith("00:00:00"))


@query(
    "d11_same_day",
    "date_texts",
    ", "
    + ds.parsed("q", "date_texts", "text_no, value", "value")
    + " SELECT text_no, coalesce(d = 1 + text_no % 31 AND m IN (1 + text_no % 13, 1 + text_no % 12) AND y = 1900 + text_no % 130 AND m = CASE WHEN text_no % 2 = 0 THEN 1 + text_no % 12 ELSE 1 + text_no % 13 END, false) AS same FROM q",
)
def _(spark, sf):
    # the day each text was made from: spelled months run to 12, numbers to 13
    n = F.col("text_no")
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", 1900 + n % 130, F.when(n % 2 == 0, 1 + n % 12).otherwise(1 + n % 13), 1 + n % 31), "yyyy-MM-dd")
    return load(spark, sf, "date_texts").select("text_no", dates.same_day(F.col("value"), day, AS_OF).alias("same"))
