"""Identity of photos and files: fingerprints, duplicates, copies, backups, stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.functions import fixed_values as fixed
from photocat.operators.normalize import add_source_key

MB = 1 << 20


def quick_fingerprint(content: Column, size: Column, window: int = MB) -> Column:
    """Hash of the size and the first and last ``window`` bytes. Use it on files whose stat changed."""
    head = F.substring(content, 1, window)
    # the last window, without repeating what the head holds
    tail = F.substr(content, F.greatest(F.lit(window), size - window).cast("int") + 1, F.lit(window))
    label = F.encode(F.concat(size.cast("string"), F.lit("|")), "UTF-8")
    return F.substring(F.sha2(F.concat(label, head, F.when(size > window, tail).otherwise(F.lit(b""))), 256), 1, 32)


def full_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicate_groups(files: DataFrame) -> DataFrame:
    """One row per content held more than once: copies, the keeper (earliest, then by path) and the
    bytes the others take. Counted map-side, so a content with very many copies is one small row."""
    g = files.where("content_hash IS NOT NULL").groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("mtime_ns", "path")).alias("k"), F.max("size_bytes").alias("size_bytes")
    )
    return g.where("copies > 1").select(
        "content_hash", "copies", F.col("k.path").alias("keeper"), ((F.col("copies") - 1) * F.col("size_bytes")).alias("spare_bytes")
    )


def duplicate_members(files: DataFrame) -> DataFrame:
    """Every file of a duplicate group as a row, with the group's keeper."""
    groups = duplicate_groups(files).select("content_hash", "keeper")
    return files.join(groups, "content_hash").select("content_hash", "path", (F.col("path") == F.col("keeper")).alias("keep"))


def classify_provenance(df: DataFrame) -> DataFrame:
    """Add ``provenance`` from save_mode, payload_mode, has_original, has_record, has_payload and
    has_marker: copy, in place, unknown, or not ours. Only the two exact mode words count."""

    def mode(c):
        return F.when(F.col(c).isin("copy", "overwrite"), F.col(c))

    saved = F.coalesce(mode("save_mode"), mode("payload_mode"))
    out = (
        F.when(saved == "copy", "copy")
        .when(saved == "overwrite", "in place")
        .when(F.col("has_record") & F.col("has_original"), "in place")
        .when(F.col("has_record") | F.col("has_payload") | F.col("has_marker"), "unknown")
        .otherwise("not ours")
    )
    return df.withColumn("provenance", out)


def outputs_of(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """(output_no, photo_id, matched_by): earlier copies of each source photo.

    Stage one is an equi-join on the source key, except for files that carry their own key (photos
    captioned in place). Only rows left over go to stage two, the join on the source's pixel
    hashes, which files saved in place never match."""
    o = add_source_key(outputs, "path", "own_key").where(~F.col("source_key").eqNullSafe(F.col("own_key")))
    s = add_source_key(sources, "path", "key")
    by_key = o.join(s.select(F.col("key").alias("source_key"), "photo_id"), "source_key").select(
        "output_no", "photo_id", F.lit("key").alias("matched_by")
    )
    left = o.join(by_key.select("output_no"), "output_no", "left_anti")
    left = left.where((F.col("save_mode") != "overwrite") & ~F.col("has_original") & F.col("photo_hash").isNotNull())
    hashes = s.select("photo_id", F.explode(F.array_distinct(F.array("whole_hash", "crop_hash"))).alias("photo_hash")).where("photo_hash IS NOT NULL")
    by_hash = left.join(hashes, "photo_hash").select("output_no", "photo_id", F.lit("hash").alias("matched_by"))
    return by_key.unionByName(by_hash)


def backup_version(path: Column) -> Column:
    """The number in a backup's name: none is 1."""
    n = F.nullif(F.regexp_extract(path, r"-(\d+)\.[^./]+$", 1), F.lit(""))
    return F.coalesce(n.try_cast("long"), F.lit(1))


def backup_versions(backups: DataFrame) -> DataFrame:
    """Per photo: how many backups, and the oldest and newest by number (not by name)."""
    b = backups.withColumn("n", backup_version(F.col("path")))
    return b.groupBy("photo_id").agg(
        F.count(F.lit(1)).alias("backups"), F.min(F.struct("n", "backup_no")).alias("a"), F.max(F.struct("n", "backup_no")).alias("z")
    ).select("photo_id", "backups", F.col("a.backup_no").alias("oldest"), F.col("z.backup_no").alias("newest"))


def find_original_backup(records: DataFrame, backups: DataFrame) -> DataFrame:
    """(photo_id, backup_no, version): the newest backup with the recorded size and hash of the
    original, unless the record says that was captioned already."""
    want = records.where("NOT captioned AND size_bytes > 0 AND content_hash IS NOT NULL").select("photo_id", "size_bytes", "content_hash")
    hit = backups.select("photo_id", "size_bytes", "content_hash", "version", "backup_no").join(want, ["photo_id", "size_bytes", "content_hash"])
    return hit.groupBy("photo_id").agg(F.max(F.struct("version", "backup_no")).alias("b")).select("photo_id", "b.backup_no", "b.version")


def plan_backup(photos: DataFrame, records: DataFrame, backups: DataFrame) -> DataFrame:
    """(photo_id, reuse_no, is_original, next_version): reuse the backup of the recorded original,
    else one identical to the current file, else the first free version number."""
    recorded = find_original_backup(records.withColumn("captioned", F.lit(False)), backups).select("photo_id", F.col("backup_no").alias("by_record"))
    flags = records.groupBy("photo_id").agg(F.bool_or("captioned").alias("captioned"))
    current = find_original_backup(photos.withColumn("captioned", F.lit(False)), backups).select("photo_id", F.col("backup_no").alias("by_content"))
    have = backups.select("photo_id", "version").distinct()
    candidates = have.select("photo_id", (F.col("version") + 1).alias("version")).unionByName(
        photos.select("photo_id", F.lit(1).cast("long").alias("version"))
    )
    free = candidates.join(have, ["photo_id", "version"], "left_anti").groupBy("photo_id").agg(F.min("version").alias("free"))
    df = photos.select("photo_id").join(recorded, "photo_id", "left").join(flags, "photo_id", "left")
    df = df.join(current, "photo_id", "left").join(free, "photo_id", "left")
    reuse = F.coalesce("by_record", "by_content")
    return df.select(
        "photo_id", reuse.alias("reuse_no"),
        (F.col("by_record").isNotNull() & ~F.coalesce("captioned", F.lit(False))).alias("is_original"),
        F.when(reuse.isNull(), F.col("free")).alias("next_version"),
    )


def verify_output(outputs: DataFrame, reads: DataFrame) -> DataFrame:
    """Add ``ok``: a written file reads back as recorded. ``reads`` (output_no, orientation, width,
    height, pixel_hash) holds what was found, upright or turned: the size must be the canvas
    (swapped for quarter turns) and the hash one of the two recorded."""
    df = reads.join(outputs.select("output_no", "canvas_w", "canvas_h", "photo_hash", "output_hash"), "output_no")
    turned = F.col("orientation") >= 5
    size = F.when(turned, (F.col("width") == F.col("canvas_h")) & (F.col("height") == F.col("canvas_w"))).otherwise(
        (F.col("width") == F.col("canvas_w")) & (F.col("height") == F.col("canvas_h"))
    )
    known = F.coalesce(F.col("pixel_hash") == F.col("output_hash"), F.lit(False)) | F.coalesce(F.col("pixel_hash") == F.col("photo_hash"), F.lit(False))
    return df.select("output_no", "orientation", (size & known).alias("ok"))


def _block_means(v: Column, f: Column) -> Column:
    """Means of consecutive blocks of ``f`` samples; the last one may be shorter."""
    n = F.ceil(F.size(v) / f).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    total = lambda i: F.aggregate(F.slice(v, i * f + 1, f), F.lit(0.0), lambda a, x: a + x)
    return F.transform(starts, lambda i: total(i) / F.least(f, F.size(v) - i * f))


def lossy_similarity(df: DataFrame, a: str, b: str, value_range: float) -> DataFrame:
    """Add ``mad`` and ``psnr`` of two sample arrays after block means (at most 512 blocks), and
    whether the pair passes as the same picture. ``mad`` is in 1/255 of the range. Arrays of different lengths are
    different pictures, without measures."""
    f = F.greatest(F.lit(1), F.ceil(F.size(b) / 512)).cast("int")
    scale = 255.0 / value_range
    df = df.withColumns({"_a": _block_means(F.col(a).cast("array<double>"), f), "_b": _block_means(F.col(b).cast("array<double>"), f)})
    df = df.withColumn("_d", F.zip_with("_a", "_b", lambda x, y: (x - y) * scale))
    n = F.size("_d")
    mad = F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.abs(x)) / n
    mse = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x * x) / n
    df = df.withColumns({"mad": mad, "_mse": mse})
    psnr = F.when(F.col("_mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(255.0 * 255.0 / F.col("_mse")))
    df = df.withColumn("psnr", psnr)
    passes = (F.col("mad") < fixed.LOSSY_MAX_MAD) & (F.col("psnr") > fixed.LOSSY_MIN_PSNR)
    alike = F.size(a) == F.size(b)
    df = df.withColumns({c: F.when(alike, F.col(c)) for c in ("mad", "psnr")})
    return df.withColumn("same_picture", F.when(alike, passes).otherwise(False)).drop("_a", "_b", "_d", "_mse")


VERSION_KEY = ["path", "size_bytes", "mtime_ns", "file_id"]


def carry_results_forward(results: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Results of an old file version re-keyed to the new one where size, orientation and profile of
    the picture stayed the same."""
    same = ["width", "height", "orientation", "profile"]
    o = old.select(*VERSION_KEY, *[F.col(c).alias(c + "_0") for c in same])
    n = new.select("path", *[F.col(c).alias(c + "_1") for c in VERSION_KEY[1:]], *same)
    pair = o.join(n, "path")
    for c in same:
        pair = pair.where(F.col(c).eqNullSafe(F.col(c + "_0")))
    moved = results.join(pair.select(*VERSION_KEY, *[c + "_1" for c in VERSION_KEY[1:]]), VERSION_KEY)
    rest = [c for c in results.columns if c not in VERSION_KEY]
    return moved.select("path", *[F.col(c + "_1").alias(c) for c in VERSION_KEY[1:]], *rest)


def pending_analysis(inventory: DataFrame, results: DataFrame, version: int, with_ocr: bool) -> DataFrame:
    """Inventory rows no stored result serves: same file version, current rules, and read words where
    words are asked for (a result with words also serves a request without)."""
    usable = results.where(F.col("version") == version)
    if with_ocr:
        usable = usable.where("ocr")
    return inventory.join(usable.select(*VERSION_KEY).distinct(), VERSION_KEY, "left_anti")


def incremental_analysis(inventory: DataFrame, results: DataFrame, version: int, with_ocr: bool, analyze) -> DataFrame:
    """Stored results of these files plus ``analyze`` run on the pending rows only. Of two stored
    results the one with words is used."""
    usable = results.where((F.col("version") == version) & (F.col("ocr") | F.lit(not with_ocr)))
    rest = [c for c in results.columns if c not in VERSION_KEY]
    best = usable.groupBy(*VERSION_KEY).agg(F.max(F.struct("ocr", *[c for c in rest if c != "ocr"])).alias("r"))
    stored = best.join(inventory.select(*VERSION_KEY), VERSION_KEY, "left_semi").select(*VERSION_KEY, *[F.col("r")[c].alias(c) for c in rest])
    return stored.unionByName(analyze(pending_analysis(inventory, results, version, with_ocr)).select(*stored.columns))
