"""Tag dumps to caption fields.

``tags`` is long: photo_id, tag, item, value. One aggregate per photo picks every field at once, so
``photo_id`` is the only shuffle key, and each pick combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.functions import dates, text
from photocat.functions import fixed_values as fixed


def _expand(tag: str) -> list[str]:
    group, _, name = tag.partition(":")
    return [f"{g}:{name}" for g in fixed.EXIF_GROUPS] if group == "EXIF" else [tag]


CHARSET_TAG = "IPTC:CodedCharacterSet"


def field_sources(spark: SparkSession, fields: list[str] | None = None) -> DataFrame:
    """The dimension (field, source_tag, rank): a fixed table of a few dozen rows."""
    rows = [
        (field, tag, i * 100 + j)
        for field, sources in fixed.FIELD_SOURCES.items()
        if fields is None or field in fields
        for i, source in enumerate(sources)
        for j, tag in enumerate(_expand(source))
    ]
    return spark.createDataFrame(rows, "field string, source_tag string, rank int")


def _wanted(tags: DataFrame, names: list[str]) -> Column:
    """A tag filter the parquet scan can prune by: listed names, or a language variant of one."""
    own = F.col("tag").isin(names)
    xmp = [n for n in names if n.startswith("XMP")]
    return text.any_of(own, *[F.col("tag").startswith(n + "-") for n in xmp]) if xmp else own


def expand_tag_candidates(tags: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Present tag values with the field each can supply and its rank: EXIF tags match any image
    directory, and an XMP tag's language variants follow its default."""
    dim = field_sources(tags.sparkSession, fields)
    names = [
        t for f, s in fixed.FIELD_SOURCES.items() if fields is None or f in fields for x in s for t in _expand(x)
    ]
    base = F.when(F.col("tag").startswith("XMP"), F.regexp_extract("tag", r"^(XMP[^:]*:[^-]+)", 1)).otherwise(F.col("tag"))
    # the dimension is a fixed table, so broadcasting it does not grow with the data
    return (
        tags.where(_wanted(tags, names) & text.present(F.col("value")))
        .withColumn("source_tag", base)
        .join(F.broadcast(dim), "source_tag")
        .withColumn("rank", F.col("rank") + F.when(F.col("tag") != F.col("source_tag"), 50).otherwise(0))
        .drop("source_tag")
    )


def normalize_fields(tags: DataFrame, fields: list[str] | None = None, all_photos: bool = True) -> DataFrame:
    """One row per photo: every field's value and the tag it came from (``<field>_tag``).

    Text fields take the first tag that has a value; dates the first with a digit 1-9, else the first. A tag's items are
    joined in their order: by ", ", creators by "; " if a name holds a comma. IPTC values that were decoded wrongly are
    repaired first. Rows are shuffled once, by photo. With ``fields`` only these are read, for the same photos: of the
    other fields' values no more is kept than that the photo has one; without ``all_photos`` they are not read at all, and
    only photos with a value of these have a row.
    """
    by_field = {f: [t for x in sources for t in _expand(x)] for f, sources in fixed.FIELD_SOURCES.items()}
    read = [f for f in by_field if fields is None or f in fields]
    names = [t for f in read for t in by_field[f]]
    c = expand_tag_candidates(repair_iptc(tags.where(_wanted(tags, names) | (F.col("tag") == CHARSET_TAG))), read)
    shape_note = F.col("tag").endswith(":ImageDescription") & text.is_shape_note(F.col("value"))
    c = c.where(~((F.col("field") == "caption") & shape_note)).withColumn("value", text.clean(F.col("value"))).where("value IS NOT NULL")
    items = F.array_sort(F.collect_list(F.struct("item", "value")))["value"]
    lists = c.groupBy("photo_id", "field", "rank", "tag").agg(items.alias("items"))
    sep = F.when((F.col("field") == "creator") & F.exists("items", lambda x: x.contains(",")), "; ").otherwise(", ")
    lists = lists.select("photo_id", "field", "rank", "tag", F.when(sep == "; ", F.array_join("items", "; ")).otherwise(F.array_join("items", ", ")).alias("value"))
    others = [t for f in by_field if f not in read for t in by_field[f]]
    if others and all_photos:
        photos = tags.where(_wanted(tags, others) & text.present(F.col("value")) & ~shape_note).select("photo_id").distinct()
        lists = lists.unionByName(photos, allowMissingColumns=True)
    first = "min(struct(rank, tag, value)) FILTER (WHERE field = '{0}')"
    dated = "min(struct(rank, tag, value)) FILTER (WHERE field = '{0}' AND value RLIKE '[1-9]')"
    texts, days = ([f for f in some if f in read] for some in (fixed.TEXT_FIELDS, fixed.DATE_FIELDS_READ))
    aggs = [F.expr(first.format(f)).alias(f) for f in texts]
    aggs += [F.coalesce(F.expr(dated.format(f)), F.expr(first.format(f))).alias(f) for f in days]
    best = lists.groupBy("photo_id").agg(*aggs)
    return best.select("photo_id", *[F.col(f)["value"].alias(f) for f in texts + days], *[F.col(f)["tag"].alias(f + "_tag") for f in texts + days])


def fields_long(fields: DataFrame) -> DataFrame:
    """(photo_id, field, value, tag) rows of the wide field table."""
    names = fixed.TEXT_FIELDS + fixed.DATE_FIELDS_READ
    entry = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.col(n + "_tag").alias("tag")) for n in names])
    return fields.select("photo_id", F.inline(entry)).where(F.col("value").isNotNull())


def repair_iptc(tags: DataFrame) -> DataFrame:
    """Repair wrongly decoded IPTC values of photos whose character set tag does not say UTF-8."""
    flagged = (
        tags.where((F.col("tag") == CHARSET_TAG) & F.col("value").rlike("(?i)%G|utf"))
        .select("photo_id", F.lit(True).alias("_utf8"))
        .distinct()
    )
    wrong = F.col("tag").startswith("IPTC:") & F.col("_utf8").isNull()
    return (
        tags.join(flagged, "photo_id", "left")
        .withColumn("value", F.when(wrong, text.repair_mojibake(F.col("value"))).otherwise(F.col("value")))
        .drop("_utf8")
    )


def merge_keywords(tags: DataFrame) -> DataFrame:
    """Keywords of both lists, one row each: the first spelling and its place (src_rank, item).
    Repeats are removed by a map-side combined aggregate, not by a window."""
    rank = F.when(F.col("tag") == fixed.KEYWORD_TAGS[0], 0).otherwise(1)
    tags = repair_iptc(tags.where(F.col("tag").isin([*fixed.KEYWORD_TAGS, CHARSET_TAG])))
    return (
        tags.where(F.col("tag").isin(fixed.KEYWORD_TAGS) & text.present(F.col("value")))
        .select("photo_id", rank.alias("src_rank"), "item", text.strip(text.unix_lines(F.col("value"))).alias("keyword"))
        .groupBy("photo_id", F.lower("keyword").alias("keyword_key"))
        .agg(F.min(F.struct("src_rank", "item", "keyword")).alias("k"))
        .select("photo_id", "keyword_key", "k.src_rank", "k.item", "k.keyword")
    )


def keyword_text(keywords: DataFrame, sep: str = ", ") -> DataFrame:
    """Each photo's keywords as one text, in list order (after merging, so repeats are gone)."""
    listed = F.array_sort(F.collect_list(F.struct("src_rank", "item", "keyword")))
    return (
        keywords.groupBy("photo_id")
        .agg(listed.alias("l"))
        .select("photo_id", F.array_join(F.col("l.keyword"), sep).alias("keywords"))
    )


def split_creators(tags: DataFrame) -> DataFrame:
    """Creators as rows: every present item of the first tag that has any."""
    c = expand_tag_candidates(tags, ["creator"])
    best = c.groupBy("photo_id").agg(F.min(F.struct("rank", "tag")).alias("best"))
    return (
        c.join(best, "photo_id")
        .where(F.col("tag") == F.col("best.tag"))
        .select("photo_id", "item", text.strip(F.col("value")).alias("creator"))
    )


def join_creators(creators: DataFrame) -> DataFrame:
    """One text per photo: "; " between names when any of them holds a comma, else ", "."""
    listed = F.array_sort(F.collect_list(F.struct("item", "creator")))
    return (
        creators.groupBy("photo_id")
        .agg(listed.alias("l"), F.bool_or(F.contains("creator", F.lit(","))).alias("comma"))
        .select(
            "photo_id",
            F.when(F.col("comma"), F.array_join("l.creator", "; ")).otherwise(F.array_join("l.creator", ", ")).alias("creators"),
        )
    )


def drop_marker_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.where(~text.is_marker_keyword(F.col("keyword")))


def exclude_keywords(keywords: DataFrame, paths: DataFrame, prefixes: list[str]) -> DataFrame:
    """Drop keywords that start with a prefix, or are the leaf of a path that does. The prefixes
    become one pattern; only matching paths are joined, on photo and leaf."""
    leaves = (
        paths.where(text.starts_with_any(F.col("path"), prefixes))
        .select("photo_id", F.lower(F.trim(F.element_at(F.split("path", r"\|"), -1))).alias("keyword_key"))
        .distinct()
    )
    kept = keywords.where(~text.starts_with_any(F.col("keyword"), prefixes))
    return kept.join(leaves, ["photo_id", "keyword_key"], "left_anti")


def date_certainty(tags: DataFrame, as_of) -> DataFrame:
    """The date marker of each photo, where it describes the caption date: the date agrees with the
    original date tag as far as it goes, and that tag has no clock time. One aggregate per photo."""
    c = expand_tag_candidates(tags, ["date"]).withColumn("value", text.clean(F.col("value")))
    marker = F.regexp_extract("value", text.DATE_MARKER, 1)
    rank = F.when(F.col("tag") == fixed.KEYWORD_TAGS[0], 0).otherwise(1)
    k = tags.where(F.col("tag").isin(fixed.KEYWORD_TAGS) & text.is_date_marker(F.col("value"))).select(
        "photo_id", F.lit("marker").alias("field"), "tag", "item", F.upper(marker).alias("value"), rank.alias("rank")
    )
    original = [t for s in fixed.ORIGINAL_DATE_TAGS for t in _expand(s)]
    rows = c.select("photo_id", "field", "tag", "item", "value", "rank").unionByName(k)
    names = ", ".join(f"'{t}'" for t in original)
    best = rows.groupBy("photo_id").agg(
        F.expr("(min(struct(rank, tag, item, value)) FILTER (WHERE field = 'date' AND value RLIKE '[1-9]')).value").alias("date"),
        F.expr("(min(struct(rank, tag, item, value)) FILTER (WHERE field = 'marker')).value").alias("certainty"),
        F.expr(f"(min(struct(rank, tag, item, value)) FILTER (WHERE tag IN ({names}))).value").alias("original"),
    )
    best = best.where("certainty IS NOT NULL AND original IS NOT NULL")

    def agree(v: Column) -> Column:
        d, o = v["d"], v["o"]
        return (
            (d["year"] == o["year"])
            & (d["month"].isNull() | d["month"].eqNullSafe(o["month"]))
            & (d["day"].isNull() | d["day"].eqNullSafe(o["day"]))
        )

    both = F.struct(
        dates.partial_date(F.col("date"), as_of).alias("d"), dates.partial_date(F.col("original"), as_of).alias("o")
    )
    agrees = dates.let(both, agree)
    clock = F.regexp_extract("original", r"^\s*\d{4}[-:]\d{1,2}[-:]\d{1,2}[ T](\d{1,2}:\d{2}(?::\d{2})?)", 1)
    return best.where(agrees & ~clock.rlike("[1-9]")).select("photo_id", "certainty")


def location_line(fields: DataFrame) -> DataFrame:
    parts = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("sublocation", "city", "state", "country")]
    return fields.select("photo_id", F.concat_ws(", ", *parts).alias("location"))


def add_source_key(df: DataFrame, path: str = "path", out: str = "source_key") -> DataFrame:
    """A photo's identity by path: the first 24 hex digits of the hash of its NFC form. Only paths
    beyond ASCII can change under NFC, so only those rows pass through the Arrow function."""

    def key(c):
        return F.substring(F.sha2(F.lower(c), 256), 1, 24)

    ascii_only = F.col(path).rlike(r"^[\x00-\x7f]*$")
    plain = df.where(F.coalesce(ascii_only, F.lit(True))).withColumn(out, key(F.col(path)))
    other = df.where(~ascii_only).withColumn(out, key(text.nfc(F.col(path))))
    return plain.unionByName(other)


def image_facts(photos: DataFrame) -> DataFrame:
    """File facts with the size as shown: quarter-turned photos swap width and height."""
    turned = F.col("orientation").between(5, 8)
    return photos.select(
        "photo_id",
        "format",
        "pages",
        "orientation",
        F.when(turned, F.col("height")).otherwise(F.col("width")).alias("upright_width"),
        F.when(turned, F.col("width")).otherwise(F.col("height")).alias("upright_height"),
        "size_bytes",
        "mtime_ns",
    )


#: Fixed: where a fact stands in a tag dump, first choice first.
FACT_TAGS = {
    "channels": ["IFD0:SamplesPerPixel", "File:ColorComponents"],
    "bits": ["IFD0:BitsPerSample", "File:BitsPerSample", "PNG:BitDepth"],
    "resolution": ["IFD0:XResolution", "JFIF:XResolution", "PNG:PixelsPerUnitX"],
    "unit": ["IFD0:ResolutionUnit", "JFIF:ResolutionUnit", "PNG:PixelUnits"],
    "compression": ["IFD0:Compression", "PNG:Compression"],
}


def facts_from_tags(tags: DataFrame) -> DataFrame:
    """(photo_id, channels, bits, dpi, compression) from the tag dump, one aggregate per photo. Bits are those of the first
    channel; resolutions per centimetre or metre are turned into dots per inch; what is not written as a number is null."""
    wanted = [t for names in FACT_TAGS.values() for t in names]
    value = text.strip(F.col("value"))
    rows = tags.where(F.col("tag").isin(wanted) & text.present(F.col("value"))).groupBy("photo_id").agg(
        *[F.min(F.when(F.col("tag") == t, F.struct("item", value.alias("v"))))["v"].alias(f"_{n}") for n, t in enumerate(wanted)]
    )
    at = {t: F.col(f"_{n}") for n, t in enumerate(wanted)}
    first = {fact: F.coalesce(*[at[t] for t in names]) for fact, names in FACT_TAGS.items()}
    whole = lambda c: F.regexp_extract(c, r"^(\d+)(?:\D|$)", 1).try_cast("long")
    unit = F.lower(first["unit"])
    per_inch = F.when(unit.isin("cm", "3"), 2.54).when(unit.isin("meters", "meter", "1") & at["PNG:PixelsPerUnitX"].isNotNull(), 0.0254).when(unit.isin("none", "unknown"), None).otherwise(1.0)
    dpi = F.round(F.regexp_extract(first["resolution"], r"^(\d+(?:\.\d+)?)$", 1).try_cast("double") * per_inch).cast("long")
    return rows.select("photo_id", whole(first["channels"]).alias("channels"), whole(first["bits"]).alias("bits"), F.when(dpi > 0, dpi).alias("dpi"), first["compression"].alias("compression"))


def route_output_format(fmt: Column, setting: str, path: Column | None = None) -> tuple[Column, Column]:
    """(format, extension) of the output: the setting's format or the source's own; the source's
    spelling of the extension is kept when the format stays."""
    out = F.lit(fixed.FORMAT_NAMES[setting.lower()]) if setting.lower() in fixed.FORMAT_NAMES else fmt
    by_format = F.create_map(*[F.lit(x) for kv in fixed.FORMAT_EXTENSIONS.items() for x in kv])
    ext = F.try_element_at(by_format, out)
    if path is not None:
        own = F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)
        ext = F.when((out == fmt) & F.lower(own).isin(fixed.SUPPORTED_EXTENSIONS), own).otherwise(ext)
    return out, ext
