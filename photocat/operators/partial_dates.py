"""Date reports over a whole catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.functions import dates


def date_kind(value: Column, d: Column) -> Column:
    """day, month, year, approximate or none."""
    return (
        F.when(d["day"].isNotNull(), "day")
        .when(d["month"].isNotNull(), "month")
        .when(d["year"].isNotNull(), "year")
        .when(F.coalesce(value.rlike("[1-9]"), F.lit(False)), "approximate")
        .otherwise("none")
    )


def date_quality_profile(df: DataFrame, value: str, folder: str, as_of, certainty: str | None = None) -> DataFrame:
    """How exact the dates are per folder and in all (rollup), with the year range, and how many have a part that their
    ``certainty`` rates as a guess."""
    df = dates.with_partial_date(df, value, "_d", as_of)
    df = df.withColumn("kind", date_kind(F.col(value), F.col("_d"))).withColumn("_year", F.col("_d.year"))
    cut = dates.apply_certainty(F.col("_d"), F.col(certainty) if certainty else F.lit(None).cast("string"))
    guess = dates.let(cut, lambda c: c["guess_year"] | c["guess_month"] | c["guess_day"] | c["no_year"])
    df = df.withColumn("_guess", F.coalesce(guess, F.lit(False)))
    return df.rollup(folder, "kind").agg(
        F.count(F.lit(1)).alias("photos"),
        F.count_if("_guess").alias("guessed"),
        F.round(F.count_if("_guess") / F.count(F.lit(1)), 6).alias("guessed_share"),
        F.min("_year").cast("long").alias("first_year"),
        F.max("_year").cast("long").alias("last_year"),
        F.grouping_id().cast("long").alias("level"),
    )
