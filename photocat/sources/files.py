"""Reading and writing catalogue files: inventories, tag dumps, logs, drafts, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photocat.functions import fixed_values as fixed
from photocat.functions import text
from photocat.functions.groups import Running, ordered_scan

# Fixed: the name that marks a folder as holding backups; a catalogue can use its own.
BACKUP_MARKER = ".backups-here"


def scan_inventory(spark: SparkSession, root: str, recursive: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """Supported photos under a folder: path, name relative to it, size and time. File contents are
    never read, because the content column is not selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    folder = root.rstrip("/").removeprefix("file:") + "/"
    return files.where(ext.isin(extensions or fixed.SUPPORTED_EXTENSIONS)).select(
        "path", F.substring_index("path", folder, -1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")
    )


def sorted_by_name(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy(F.lower("name"), "name")


def skip_managed_paths(inventory: DataFrame, saving: dict | None = None, markers: DataFrame | None = None) -> DataFrame:
    """Drop hidden files and folders, backup and output folders, and folders that hold a marker file
    (``markers``: their paths). Folder names come from settings, so they are part of the filter; the
    marked folders are matched on each path's ancestors, an equi-join."""
    saving = saving or {}
    names = {n.lower() for n in fixed.MANAGED_FOLDERS} | ({saving["subfolderName"].lower()} if saving.get("subfolderName") else set())
    steps = F.split("path", "/")
    hidden = F.exists(steps, lambda s: s.startswith("."))
    managed = F.arrays_overlap(F.transform(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), F.lower), F.array(*[F.lit(n) for n in sorted(names)]))
    kept = inventory.where(~hidden & ~managed)
    for key in ("backupFolder", "fixedFolder"):
        if saving.get(key):
            kept = kept.where(~F.col("path").startswith(saving[key].rstrip("/") + "/"))
    if markers is None:
        return kept
    marked = markers.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    up = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    inside = kept.select("path", F.explode(up).alias("folder")).join(marked, "folder", "left_semi").select("path").distinct()
    return kept.join(inside, "path", "left_anti")


def dedup_requested_paths(requests: DataFrame) -> DataFrame:
    """Each requested path once, by its first request (request_no, path, name)."""
    best = requests.groupBy("path").agg(F.min(F.struct("request_no", "name")).alias("r"))
    return best.select("path", "r.request_no", "r.name")


# a JSON number outside any string: what precedes it (whole strings included), then the number
_NUMBER = r'\G((?:[^"0-9\-]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)'


def tags_of(docs: DataFrame) -> DataFrame:
    """Metadata documents (photo_id, doc: a JSON object of Group:Tag to scalar, list or struct) as the long tag table.
    A list gives a row per item; text that looks like a list stays text. Number text is kept as it is ("1.50" stays
    "1.50"): numbers are quoted before the JSON is read. Structs stay JSON text, with their numbers as text. A name that
    stands twice gives both values."""
    quoted = F.regexp_replace("doc", _NUMBER, '$1"$2"')
    entries = lambda c: F.try_parse_json(c).cast("map<string,variant>")
    twice = F.transform_values(F.from_json(quoted, "map<string,string>"), lambda k, v: v.cast("variant"))
    kv = docs.select("photo_id", F.explode(F.coalesce(entries(quoted), twice)).alias("tag", "v"))
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    is_struct = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    lists = F.when(is_list(F.col("v")), F.try_variant_get("v", "$", "array<variant>"))
    items = F.transform(lists, lambda x: F.try_variant_get(x, "$", "string"))
    items = F.when(is_list(F.col("v")), items).when(is_struct(F.col("v")), F.array(F.to_json("v")))
    items = items.otherwise(F.array(F.try_variant_get("v", "$", "string")))
    return kv.select("photo_id", "tag", F.posexplode(items).alias("item", "value")).withColumn("item", F.col("item").cast("long"))


def read_tag_dump(spark: SparkSession, path: str) -> DataFrame:
    """Tag rows of JSON documents, one per line, each naming its file as SourceFile (the photo_id)."""
    docs = spark.read.text(path).select(F.get_json_object("value", "$.SourceFile").alias("photo_id"), F.col("value").alias("doc"))
    return tags_of(docs.where("photo_id IS NOT NULL")).where("tag <> 'SourceFile'")


def tag_listing(tags: DataFrame, limit: int | None = None, width: int | None = None) -> DataFrame:
    """The tags of each photo as numbered text for showing, without file system groups. With ``limit`` the first ones
    only: a group limit, of which each task passes on at most so many rows of a photo. With ``width`` longer values are cut."""
    v = F.col("value") if width is None else F.when(F.length("value") > width, F.concat(F.substring("value", 1, width), F.lit("…"))).otherwise(F.col("value"))
    shown = tags.where("value IS NOT NULL AND tag <> 'SourceFile'")
    for group in fixed.LISTING_SKIPPED:
        shown = shown.where(~F.col("tag").startswith(group))
    w = Window.partitionBy("photo_id").orderBy("tag", "item")
    return shown.select("photo_id", "tag", "item", v.alias("value")).withColumn("n", F.row_number().over(w)).where(F.lit(True) if limit is None else F.col("n") <= limit).drop("n")


LOG_SCHEMA = (
    "seq bigint, time timestamp_ntz, ok boolean, source string, output string, mode string, format string, backup string,"
    " notes string, error string, ms bigint, batch string"
)


def parse_job_log(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """The records of log lines (column value), newest first; with ``limit`` the newest ones. Lines that are no JSON are skipped."""
    r = F.from_json("value", LOG_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(r.alias("r")).where("r IS NOT NULL AND r._bad IS NULL AND r.time IS NOT NULL").select("r.*").drop("_bad")
    newest = rows.orderBy(F.desc("time"), F.desc("seq"))
    return newest if limit is None else newest.limit(limit)


def read_job_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return parse_job_log(spark.read.text(_rolls(spark, path)).select("value"), limit)


def _rolls(spark: SparkSession, path: str) -> str:
    """What to read of a log: all folders of rolls if it is kept in rolls, else the path. Named like this they are listed by
    one job; below a few days' folders each day would be listed by a job of its own, with a task for each roll."""
    from photocat.streaming.store import Folder

    folder = Folder(spark, path)
    days = [n for n in folder.names() if n.startswith("day=")]
    return f"{path}/day=*/roll=*" if any(folder.holds_any(d) for d in days) else path


def write_job_log(log: DataFrame, path: str, max_bytes: int = fixed.LOG_ROLL_BYTES) -> None:
    """Append log records as lines of JSON: a folder per day, and in it one per ``roll``, which is full when it holds
    ``max_bytes``. The records before one in its day are added up along the order of time, so a day of any size is written
    by as many tasks as it has rolls; an append starts rolls of its own."""
    line = F.to_json(F.struct("*"))
    rows = log.select(F.coalesce(F.to_date("time").cast("string"), F.lit("none")).alias("day"), "time", "seq", line.alias("value"))
    rows = rows.withColumn("bytes", F.octet_length("value").cast("long") + 1)
    scan = ordered_scan(rows, ["day"], [F.col("time"), F.col("seq")], running={"before": Running("bytes", inclusive=False)})
    rolled = scan.withColumn("roll", F.concat(F.lit(uuid.uuid4().hex[:8] + "-"), F.lpad(F.expr(f"coalesce(before, 0) div {int(max_bytes)}").cast("string"), 6, "0")))
    placed = rolled.repartition("day", "roll").sortWithinPartitions("day", "roll", "time", "seq")
    placed.select("day", "roll", "value").write.mode("append").partitionBy("day", "roll").text(path)


def log_rolls(spark: SparkSession, path: str) -> DataFrame:
    """(day, roll, bytes) of a written log, from the listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(_rolls(spark, path))
    part = lambda n: F.regexp_extract("path", f"/{n}=([^/]*)/", 1).alias(n)
    return found.select(part("day"), part("roll"), "length").groupBy("day", "roll").agg(F.sum("length").alias("bytes"))


def drop_old_rolls(spark: SparkSession, path: str, keep_bytes: int = 2 * fixed.LOG_ROLL_BYTES) -> int:
    """Remove the oldest rolls of a log beyond ``keep_bytes``; how many went. One small row a roll comes to the driver."""
    from photocat.streaming.store import Folder

    folder, kept, gone = Folder(spark, path), 0, 0
    for r in log_rolls(spark, path).orderBy(F.desc("day"), F.desc("roll")).toLocalIterator():
        kept += r.bytes
        if kept > keep_bytes and kept > r.bytes:
            folder.remove(f"day={r.day}/roll={r.roll}")
            gone += 1
    return gone


def csv_report(report: DataFrame) -> DataFrame:
    """Text cells made safe for spreadsheets."""
    return report.select(*[text.csv_safe(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in report.dtypes])


#: Quotes are doubled, blanks stay, and an empty text is not the same as none.
CSV = {"header": "true", "escape": "\"", "emptyValue": "\"\"", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_report_csv(report: DataFrame, path: str) -> None:
    csv_report(report).write.mode("overwrite").options(**CSV).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """An exported report with its types; cells may hold quotes and line ends."""
    # a cell without quotes and text is null; what stands for it is a text that no cell has
    return spark.read.schema(schema).options(**CSV | {"emptyValue": "", "nullValue": "\0", "multiLine": "true"}).csv(path)


DRAFT_SCHEMA = "path string, stat struct<size:bigint, mtime_ns:string>, ident struct<size:bigint, hash:string>, state string, updated double"


def newest_first(drafts: DataFrame) -> DataFrame:
    return drafts.where("path IS NOT NULL").orderBy(F.desc_nulls_last("updated"), "path")


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Stored drafts, newest first; the editor state stays JSON text."""
    return newest_first(spark.read.schema(DRAFT_SCHEMA).json(path))
