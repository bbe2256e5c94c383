"""Catalogue reports: sorts, facets, people, periods, coverage, space, differences between scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions import dates, text
from photocat.functions import fixed_values as fixed
from photocat.functions.groups import ordered_scan
from photocat.operators import identity, normalize, people
from photocat.operators.edits import stat_change


def natural_sort(df: DataFrame, column: str) -> DataFrame:
    """Rows ordered by name with numbers as numbers, case ignored (a range-partitioned sort)."""
    return df.orderBy(text.natural_key(F.col(column)), column)


def recent_log(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows, newest first; with ``limit`` the newest ones, of which each task keeps its own."""
    newest = log.orderBy(F.desc("time"), F.desc("seq"))
    return newest if limit is None else newest.limit(limit)


def folder_of(path: str = "path"):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def status_by_folder(plan: DataFrame) -> DataFrame:
    """Photos per folder and status, with totals (rollup)."""
    p = plan.select(folder_of().alias("folder"), "status")
    return p.rollup("folder", "status").agg(F.count(F.lit(1)).alias("photos"), F.grouping_id().cast("long").alias("level"))


def keyword_facets(tags: DataFrame) -> DataFrame:
    """Photos per keyword after merging and without markers, with the first spelling seen. A keyword
    on very many photos is summed map-side."""
    k = normalize.drop_marker_keywords(normalize.merge_keywords(tags))
    return k.groupBy("keyword_key").agg(
        F.count(F.lit(1)).alias("photos"), F.min(F.struct("photo_id", "src_rank", "item", "keyword"))["keyword"].alias("keyword")
    )


def people_index(regions: DataFrame, used: DataFrame) -> DataFrame:
    """Photos per person and when last used (``used``: photo_id, used_at)."""
    n = people.named(regions).groupBy("photo_id", F.lower(F.trim("name")).alias("person")).agg(F.min(F.struct("region_no", "name")).alias("f"))
    last = used.groupBy("photo_id").agg(F.max("used_at").alias("used_at"))
    n = n.join(last, "photo_id", "left")
    return n.groupBy("person").agg(
        F.count(F.lit(1)).alias("photos"), F.min(F.struct("photo_id", "f"))["f"]["name"].alias("name"), F.max("used_at").alias("last_used")
    )


def neighbours(regions: DataFrame, parts: int | None = None) -> DataFrame:
    """How often two people stand next to each other in the left-to-right order of a photo.

    Only adjacent faces are paired, by one pass along the order, so a photo with n faces gives n - 1 pairs, never all of
    them."""
    named, order = people.in_order(people.named(regions).withColumn("a", F.lower(F.trim("name"))), "lr")
    pairs = ordered_scan(named, ["photo_id"], order, lag={"b": "a"}, parts=parts).where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("person_1"), F.greatest("a", "b").alias("person_2")).agg(F.count(F.lit(1)).alias("times"))


def photos_by_period(fields: DataFrame, certainty: DataFrame, as_of) -> DataFrame:
    """Photos per decade, year and month, each also by whether any part of the date is a guess, with all totals. ``level`` is
    the grouping id: which of decade, year, month and guessed a row adds up."""
    f = fields.select("photo_id", "date").join(certainty, "photo_id", "left")
    cut = dates.apply_certainty(dates.partial_date(F.col("date"), as_of), F.col("certainty"))
    read = dates.let(cut, lambda c: F.struct(
        F.when(~c["no_year"], F.floor(c["year"] / 10) * 10).cast("long").alias("decade"),
        F.when(~c["no_year"], c["year"]).cast("long").alias("year"),
        F.when(~c["no_year"], c["month"]).cast("long").alias("month"),
        F.coalesce(c["guess_year"] | c["guess_month"] | c["guess_day"] | c["no_year"], F.lit(False)).alias("guessed"),
    ))
    none = F.struct(*[F.lit(None).cast("long").alias(c) for c in ("decade", "year", "month")], F.lit(False).alias("guessed"))
    f = f.select(F.inline(F.array(F.coalesce(read, none))))
    periods = [[], ["decade"], ["decade", "year"], ["decade", "year", "month"]]
    sets = [[F.col(c) for c in p + g] for p in periods for g in ([], ["guessed"])]
    return f.groupingSets(sets, "decade", "year", "month", "guessed").agg(F.count(F.lit(1)).alias("photos"), F.grouping_id().cast("long").alias("level"))


def source_coverage(fields: DataFrame) -> DataFrame:
    """Per field: how many photos each winning tag supplies, and how many have none, with the share."""
    names = fixed.TEXT_FIELDS + fixed.DATE_FIELDS_READ
    entry = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(n + "_tag"), F.lit("none")).alias("tag")) for n in names])
    g = fields.select(F.inline(entry)).groupBy("field", "tag").agg(F.count(F.lit(1)).alias("photos"))
    total = g.groupBy("field").agg(F.sum("photos").alias("total"))  # a few rows per field
    return g.join(total, "field").select("field", "tag", "photos", F.round(F.col("photos") / F.col("total"), 6).alias("share"))


def restorable_space(backups: DataFrame) -> DataFrame:
    """Backups per folder: how many, their bytes, lowest and highest version."""
    b = backups.select(folder_of().alias("folder"), "size_bytes", identity.backup_version(F.col("path")).alias("v"))
    return b.groupBy("folder").agg(
        F.count(F.lit(1)).alias("backups"), F.sum("size_bytes").alias("bytes"), F.min("v").alias("first_version"), F.max("v").alias("last_version")
    )


def inventory_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change, from_path) between two scans: unchanged, touched, changed, added, removed, and
    moved for an added path whose content was removed elsewhere. Each content is reduced to its
    first removed path before joining, so many copies of one content give no extra rows."""
    change = stat_change(before, now)
    gone = change.where("change = 'removed'").select("path").join(before.select("path", "content_hash"), "path")
    gone = gone.groupBy("content_hash").agg(F.min("path").alias("from_path"))
    new = change.where("change = 'added'").select("path").join(now.select("path", "content_hash"), "path")
    moved = new.join(gone, "content_hash").select("path", "from_path")
    both = change.join(moved, "path", "left")
    return both.select("path", F.when(F.col("from_path").isNotNull(), "moved").otherwise(F.col("change")).alias("change"), "from_path")


def inventory_counts(before: DataFrame, now: DataFrame) -> DataFrame:
    """Quick totals of (path, size_bytes) rows, equal ones counted as often as they stand: kept, only before, only now."""
    side = lambda df, b, n: df.select("path", "size_bytes", F.lit(b).alias("b"), F.lit(n).alias("n"))
    rows = side(before, 1, 0).unionByName(side(now, 0, 1)).groupBy("path", "size_bytes").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    parts = {"kept": F.least("b", "n"), "only before": F.greatest(F.col("b") - F.col("n"), F.lit(0)), "only now": F.greatest(F.col("n") - F.col("b"), F.lit(0))}
    out = rows.agg(*[total(c).alias(name) for name, c in parts.items()])
    return out.select(F.inline(F.array(*[F.struct(F.lit(name).alias("part"), F.col(f"`{name}`").alias("files")) for name in parts])))
