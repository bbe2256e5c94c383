"""Registered streaming queries: each runs its stream over the events table to the end, and is
compared with the batch form of the same rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.plans.q_reports import sql_stamp, stamp
from photocat.plans.registry import query
from photocat.plans.views import load
from photocat.session import work_dir
from photocat.streaming import journal
from photocat.streaming.store import ResultStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = (
    "CASE event_type WHEN 'signup' THEN 'staged' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"
)


def _events(spark, sf):
    """The events table as a stream of journal rows."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = journal.read_events(spark, sf, schema, "events.parquet")
    return e.select(
        F.col("user_id").alias("batch_id"), (F.col("event_id") % 25).alias("idx"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), F.expr(STATE).alias("state"), (F.col("event_id") % 3).alias("epoch"), F.col("value").alias("ms"),
    )


def _collected(spark, stream):
    """Run a stream to its present end and read back what it wrote."""
    base = work_dir(spark)
    q = stream.writeStream.outputMode("append").option("checkpointLocation", base + "/progress").trigger(availableNow=True)
    q.format("parquet").option("path", base + "/rows").start().awaitTermination()
    return base + "/rows"


def _arriving(spark, sf, live, schema, late=False, key=("batch_id",), mode="append"):
    """Run ``live`` over journal rows that arrive in three lots, started anew for each from its checkpoint, and give the
    committed results. In order of time, or (``late``) with some rows of any time in the last lot."""
    base = work_dir(spark)
    rows = load(spark, sf, "journal").withColumn("ts", F.col("ts").cast("timestamp"))
    by_time = "CASE WHEN ts < timestamp'2024-01-11' THEN 0 WHEN ts < timestamp'2024-01-21' THEN 1 ELSE 2 END"
    rows = rows.withColumn("lot", F.expr(f"CASE WHEN seq % 7 = 0 THEN 2 ELSE {by_time} END" if late else by_time))
    store = ResultStore(spark, base + "/results", schema, key, 16)
    for lot in range(3):
        rows.where(F.col("lot") == lot).drop("lot").write.parquet(f"{base}/in/{lot}")
        stream = spark.readStream.schema(rows.drop("lot").schema).parquet(f"{base}/in/*")
        _with_rocksdb(spark, lambda: journal.write_epochs(live(stream), store, base + "/progress", mode).awaitTermination())  # noqa: B023
    return store


def _with_rocksdb(spark, run):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


LAST = """, st AS (SELECT batch_id, idx, arg_max(state, row(ts, seq)) AS state FROM journal GROUP BY batch_id, idx)"""


@query("t1_stream_current_state", "journal", LAST + " SELECT batch_id, idx, state FROM st")
def _(spark, sf):
    return journal.read_latest(_arriving(spark, sf, journal.stream_current_state, journal.LATEST, key=("batch_id", "idx"), mode="update"))


@query("t2_stream_new_results", "journal", "SELECT batch_id, idx, seq FROM journal WHERE state = 'done'")
def _(spark, sf):
    base = work_dir(spark)
    done = _events(spark, sf).where("state = 'done'").select("batch_id", "idx", "seq")
    # a second run finds nothing new: the checkpoint is the cursor
    for _ in range(2):
        journal.stream_new_results(done, base + "/rows", base + "/progress").awaitTermination()
    return spark.read.parquet(base + "/rows")


@query(
    "t3_stream_throughput",
    "journal",
    f"""SELECT batch_id, {sql_stamp("date_trunc('hour', ts)")} AS from_ts, count(*) AS done FROM journal WHERE state = 'done' GROUP BY batch_id, date_trunc('hour', ts)""",
)
def _(spark, sf):
    done = load(spark, sf, "journal").where("state = 'done'").withColumn("ts", F.col("ts").cast("timestamp"))
    return journal.throughput(done, "1 hour").select("batch_id", stamp("from_ts").alias("from_ts"), "done")


@query(
    "t3_stream_throughput_live",
    "journal",
    f"""SELECT batch_id, {sql_stamp("date_trunc('hour', ts)")} AS from_ts, count(*) AS done FROM journal WHERE state = 'done' GROUP BY batch_id, date_trunc('hour', ts)""",
)
def _(spark, sf):
    live = journal.throughput(_events(spark, sf).where("state = 'done'").withWatermark("ts", "40 days"), "1 hour")
    base = work_dir(spark)
    store = ResultStore(spark, base + "/results", "batch_id long, from_ts timestamp, to_ts timestamp, done long", ["batch_id"], 16)
    journal.write_epochs(live, store, base + "/progress", "update").awaitTermination()
    rows = store.read().groupBy("batch_id", "from_ts").agg(F.max("done").alias("done"))
    return rows.select("batch_id", stamp("from_ts").alias("from_ts"), "done")


# every report moves the expected end as the stream does, one recursion step a report
TIME_LEFT = """, numbered AS (
  SELECT batch_id, floor(epoch(ts)) AS t, idx::BIGINT AS done, 25 AS total, row_number() OVER (PARTITION BY batch_id ORDER BY floor(epoch(ts)), idx) AS n FROM journal WHERE state = 'done'
), paced AS (
  WITH RECURSIVE step AS (
    SELECT batch_id, n, t, done, total, t AS start_t, done AS start_done, done AS most, NULL::DOUBLE AS end_t FROM numbered WHERE n = 1
    UNION ALL
    SELECT c.batch_id, c.n, c.t, c.done, c.total, if(c.done < s.start_done, c.t, s.start_t), if(c.done < s.start_done, c.done, s.start_done),
      if(c.done < s.start_done, c.done, greatest(s.most, c.done)),
      CASE WHEN c.done < s.start_done THEN NULL WHEN c.done <= s.most OR c.done - s.start_done < 2 THEN s.end_t
        WHEN s.end_t IS NULL THEN c.t + greatest(0, c.total - c.done) * ((c.t - s.start_t) / (c.done - s.start_done))
        ELSE greatest(c.t, s.end_t) + 0.35::DOUBLE * (c.t + greatest(0, c.total - c.done) * ((c.t - s.start_t) / (c.done - s.start_done)) - greatest(c.t, s.end_t)) END
    FROM step s JOIN numbered c ON c.batch_id = s.batch_id AND c.n = s.n + 1
  ) SELECT * FROM step
)
SELECT batch_id, t, done, floor(CASE WHEN done >= total THEN 0.0::DOUBLE WHEN end_t IS NOT NULL THEN greatest(0.0::DOUBLE, end_t - t) END * 1000 + 0.5) / 1000 AS left_s FROM paced"""


@query("t4_stream_eta", "journal", TIME_LEFT)
def _(spark, sf):
    # progress reports: how many of a batch's photos were done at each completion
    def live(events):
        e = events.where("state = 'done'")
        return journal.stream_eta(e.select("batch_id", F.unix_timestamp("ts").cast("double").alias("t"), F.col("idx").alias("done"), F.lit(25).cast("long").alias("total")), keep="40 days", late="40 days")

    rows = _arriving(spark, sf, live, "batch_id long, t double, done long, left_s double").read()
    return rows.withColumn("left_s", F.floor(F.col("left_s") * 1000 + 0.5) / 1000)


FENCE = """SELECT batch_id, seq, epoch, coalesce(max(epoch) OVER (PARTITION BY batch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > epoch, false) AS refused FROM journal"""


# requests of one lot are taken in the order of their numbers
FENCE_LIVE = """ SELECT batch_id, seq, epoch, coalesce(max(epoch) OVER (PARTITION BY batch_id ORDER BY lot, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > epoch, false) AS refused FROM lots"""


@query("t5_stop_fence", "journal", FENCE)
def _(spark, sf):
    return journal.stop_fence(load(spark, sf, "journal"))


@query("t5_stop_fence_live", "journal", ", lots AS (SELECT *, CASE WHEN ts < timestamp '2024-01-11' THEN 0 WHEN ts < timestamp '2024-01-21' THEN 1 ELSE 2 END AS lot FROM journal)" + FENCE_LIVE)
def _(spark, sf):
    live = lambda events: journal.stream_stop_fence(events, keep="40 days")
    return _arriving(spark, sf, live, "batch_id long, seq long, epoch long, refused boolean").read()


@query(
    "t6_staging_idle",
    "journal",
    f""", g AS (SELECT batch_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY batch_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS cut FROM journal),
 s AS (SELECT batch_id, ts, sum(cut) OVER (PARTITION BY batch_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT batch_id, {sql_stamp('min(ts)')} AS from_ts, {sql_stamp('max(ts) + INTERVAL 10 MINUTE')} AS idle_at, count(*) AS events FROM s GROUP BY batch_id, n""",
)
def _(spark, sf):
    j = load(spark, sf, "journal").select("batch_id", F.col("ts").cast("timestamp").alias("ts"))
    return journal.idle_sessions(j).select("batch_id", stamp("from_ts").alias("from_ts"), stamp("idle_at").alias("idle_at"), "events")


@query("t7_autosave_dedup", "journal", "SELECT DISTINCT idx AS photo_id, state AS state_hash FROM journal")
def _(spark, sf):
    saves = _events(spark, sf).select(F.col("idx").alias("photo_id"), F.col("state").alias("state_hash"), "ts")
    return spark.read.parquet(_collected(spark, journal.autosave_dedup(saves, "40 days").select("photo_id", "state_hash")))


LATE = f""", lots AS (
  SELECT batch_id, ts, CASE WHEN seq % 7 = 0 THEN 2 WHEN ts < timestamp '2024-01-11' THEN 0 WHEN ts < timestamp '2024-01-21' THEN 1 ELSE 2 END AS lot FROM journal WHERE state = 'done'
), judged AS (
  SELECT batch_id, date_trunc('hour', ts) AS w, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR
    <= max(ts) OVER (PARTITION BY batch_id ORDER BY lot RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE, false) AS late FROM lots
) SELECT batch_id, {sql_stamp("w")} AS from_ts, count(*) FILTER (NOT late) AS done, count(*) FILTER (late) AS dropped FROM judged GROUP BY batch_id, w"""


@query("t8_late_events", "journal", LATE)
def _(spark, sf):
    live = lambda events: journal.stream_counts_and_late(events.where("state = 'done'"), "1 hour", "10 minutes", keep="60 days")
    store = _arriving(spark, sf, live, journal.COUNTED, late=True)
    late = journal.late_rows(store).groupBy("batch_id", "from_ts").agg(F.count(F.lit(1)).alias("dropped"))
    both = journal.window_counts(store).join(late, ["batch_id", "from_ts"], "full")
    zero = F.lit(0).cast("long")
    return both.select("batch_id", stamp("from_ts").alias("from_ts"), F.coalesce("done", zero).alias("done"), F.coalesce("dropped", zero).alias("dropped"))


@query("t9_stream_new_photos", "journal", "SELECT DISTINCT batch_id || '/' || idx AS path, 7 AS version FROM journal")
def _(spark, sf):
    base = work_dir(spark)
    fields = "path string, size_bytes long, mtime_ns long, file_id long, version int, ocr boolean"
    store = ResultStore(spark, base + "/results", fields, ["path"], 64)
    one = F.lit(1).cast("long")
    rows = load(spark, sf, "journal").select(F.concat_ws("/", "batch_id", "idx").alias("path"), one.alias("size_bytes"), one.alias("mtime_ns"), one.alias("file_id"), (F.col("seq") % 3).alias("lot"))

    def analyze(new):
        return new.withColumns({"version": F.lit(7), "ocr": F.lit(False)})

    for lot in range(3):  # the same files come again and again; each is analyzed once
        rows.where(F.col("lot") == lot).drop("lot").write.parquet(f"{base}/in/{lot}")
        inventory = spark.readStream.schema(rows.drop("lot").schema).parquet(f"{base}/in/*")
        journal.stream_new_photos(inventory, store, 7, base + "/progress", analyze).awaitTermination()
    return store.read().select("path", "version")


@query("t10_idempotent_sink", "journal", LAST + " SELECT state, count(*) AS entries FROM st GROUP BY state")
def _(spark, sf):
    # run, lose the progress record, run again: the same micro-batches replace their own commits
    base = work_dir(spark)
    store = ResultStore(spark, base + "/results", journal.LATEST, ["batch_id", "idx"], 16)

    for attempt in ("first", "again"):
        updates = journal.stream_current_state(_events(spark, sf))
        journal.write_epochs(updates, store, f"{base}/progress-{attempt}", "update").awaitTermination()
    return journal.read_latest(store).groupBy("state").agg(F.count(F.lit(1)).alias("entries"))
