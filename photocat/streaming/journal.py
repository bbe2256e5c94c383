"""Live forms of the journal operators.

Sources are file streams of journal-shaped rows. Every query takes a checkpoint folder on shared
storage, so a lost executor or a restart continues where it was. Operators that keep state per batch take
``late``, how far behind the newest event a row may be, and ``keep``, after how much silence (in event time) a batch's
state is dropped; finished batches go as soon as nothing late can come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from photocat.functions import fixed_values as fixed
from photocat.functions.groups import Running, ordered_scan
from photocat.operators.identity import VERSION_KEY, pending_analysis
from photocat.streaming.store import ResultStore


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream of the parquet files in a folder; new files are new rows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


# -- state that expires --------------------------------------------------------------------------------------


class _Expiring(StatefulProcessor):
    """State with one event-time timer a key: it is dropped when the watermark passes the newest event by ``keep_ms``, or
    by ``done_ms`` where the processor said that nothing is open any more."""

    def __init__(self, keep_ms: int, done_ms: int = 0):
        self.keep_ms, self.done_ms = keep_ms, done_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = self.open_states(handle)

    def open_states(self, handle: StatefulProcessorHandle) -> list:
        raise NotImplementedError

    def expire_after(self, newest_ms: int, open_: bool = True) -> None:
        at = int(newest_ms) + (self.keep_ms if open_ else self.done_ms)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.states:
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _columns(chunks: Iterator[pd.DataFrame], types: dict[str, str]) -> dict[str, np.ndarray]:
    """Some number columns of all chunks of a key, as arrays; Spark hands over a micro-batch in chunks of any order."""
    parts = [{c: chunk[c].to_numpy().astype(t) for c, t in types.items()} for chunk in chunks]
    return {c: np.concatenate([p[c] for p in parts]) for c in types}


def _with_state(rows: DataFrame, keys: list[str], processor: _Expiring, schema: str, late: str, time: str = "ts", mode: str = "Append") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="EventTime")


# -- state and results -----------------------------------------------------------------------------------

LATEST = "batch_id long, idx long, ts timestamp, seq long, state string"


def stream_current_state(events: DataFrame, late: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """The latest state per entry and ``span`` of time as events arrive (update mode); readers take the newest of an entry's
    spans. A span's state is dropped when no event can fall into it any more, so finished and silent batches cost nothing and
    what is kept is what was active lately."""
    spans = events.withWatermark("ts", late).groupBy("batch_id", "idx", F.window("ts", span))
    return spans.agg(F.max(F.struct("ts", "seq", "state")).alias("s")).select("batch_id", "idx", "s.ts", "s.seq", "s.state")


def write_epochs(updates: DataFrame, store: ResultStore, checkpoint: str, mode: str = "append"):
    """Run a stream to its present end into ``store``: a commit per micro-batch, replaced when it is repeated, so a
    restart never writes a row twice and readers never see half of one."""
    return updates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store.write).start()


def read_latest(store: ResultStore) -> DataFrame:
    """The newest row per entry of what ``write_epochs`` wrote."""
    best = store.read().groupBy("batch_id", "idx").agg(F.max(F.struct("ts", "seq", "state")).alias("s"))
    return best.select("batch_id", "idx", "s.state")


def stream_new_results(results: DataFrame, out: str, checkpoint: str):
    """Append results not delivered before: the checkpoint is the reader's cursor."""
    return (
        results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .format("parquet").option("path", out).start()
    )


# -- speed ---------------------------------------------------------------------------------------------------


def throughput(done: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Photos finished per batch and time window (batch or stream; add a watermark to a stream)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return done.groupBy("batch_id", w.alias("w")).agg(F.count(F.lit(1)).alias("done")).select(
        "batch_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "done"
    )


def stream_throughput(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    return throughput(events.where("state = 'done'").withWatermark("ts", late), width)


class _TimeLeft(_Expiring):
    """Expected end of one batch. State: the report from which speed is measured, the highest count, the expected end."""

    def open_states(self, handle):
        self.kept = handle.getValueState("pace", "start_t double, start_done long, most long, end_t double")
        return [self.kept]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pace = Pace(*self.kept.get()) if self.kept.exists() else None
        c = _columns(rows, {"t": "float64", "done": "int64", "total": "int64"})  # 24 bytes a report of one micro-batch
        order = np.lexsort((c["total"], c["done"], c["t"]))
        for k in range(0, len(order), OUT_ROWS):
            part = order[k : k + OUT_ROWS]
            left = []
            for t, done, total in zip(c["t"][part].tolist(), c["done"][part].tolist(), c["total"][part].tolist(), strict=True):
                pace = Pace(t, done, done, None) if pace is None or done < pace.start_done else pace.after(t, done, total)
                left.append(pace.left(t, done, total))
            yield pd.DataFrame({"batch_id": key[0], "t": c["t"][part], "done": c["done"][part], "left_s": pd.array(left, dtype="Float64")})
        if pace is not None:
            self.kept.update(pace)
            last = order[-1]
            self.expire_after(c["t"][last] * 1000, c["done"][last] < c["total"][last])


OUT_ROWS = 10_000


class Pace(NamedTuple):
    """Progress of a batch as the moment it is expected to end; measuring starts anew when its count falls below the start's."""

    start_t: float
    start_done: int
    most: int
    end_t: float | None

    def after(self, t: float, done: int, total: int) -> Pace:
        """With one more report. Only a higher count moves the expected end: partly to where the speed since the start
        leads, partly it stays (or is now, if it has passed)."""
        made = done - self.start_done
        if done <= self.most:
            return self
        if made < fixed.ETA_MIN_DONE:
            return self._replace(most=done)
        seconds_each = max(0.0, t - self.start_t) / made
        at_this_speed = t + max(0, total - done) * seconds_each
        before = at_this_speed if self.end_t is None else max(t, self.end_t)
        return self._replace(most=done, end_t=before + fixed.ETA_NEW_SHARE * (at_this_speed - before))

    def left(self, t: float, done: int, total: int) -> float | None:
        if done >= total:
            return 0.0
        return None if self.end_t is None else max(0.0, self.end_t - t)


def stream_eta(progress: DataFrame, late: str = "10 minutes", keep: str = "7 days") -> DataFrame:
    """Time left per batch from progress reports (batch_id, t seconds since 1970, done, total). Needs the RocksDB state
    store. A batch whose last report is complete is forgotten when no late report can come, a silent one after ``keep``."""
    rows = progress.select("batch_id", "t", "done", "total", F.timestamp_millis(F.floor(F.col("t") * 1000)).alias("ts"))
    return _with_state(rows, ["batch_id"], _TimeLeft(_milliseconds(keep), _milliseconds(late)), "batch_id long, t double, done long, left_s double", late)


# -- fences and sessions ---------------------------------------------------------------------------------------


class _Fence(_Expiring):
    """Marks requests issued under an older stop epoch than the batch has seen."""

    def open_states(self, handle):
        self.epoch = handle.getValueState("epoch", "epoch long")
        return [self.epoch]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.epoch.get()[0] if self.epoch.exists() else -1
        c = _columns((r.assign(ms=r["ts"].to_numpy().astype("datetime64[ms]").astype("int64")) for r in rows), {"seq": "int64", "epoch": "int64", "ms": "int64"})
        order = np.argsort(c["seq"], kind="stable")
        epoch = c["epoch"][order]
        highest = np.maximum.accumulate(np.concatenate([[seen], epoch]))
        self.epoch.update((int(highest[-1]),))
        self.expire_after(c["ms"].max())
        for k in range(0, len(order), OUT_ROWS):
            part = slice(k, k + OUT_ROWS)
            yield pd.DataFrame({"batch_id": key[0], "seq": c["seq"][order][part], "epoch": epoch[part], "refused": epoch[part] < highest[:-1][part]})


def stream_stop_fence(requests: DataFrame, late: str = "10 minutes", keep: str = "7 days") -> DataFrame:
    """Requests (batch_id, seq, epoch, ts) with ``refused``: route those to a side output. A batch silent for ``keep`` is
    over: its highest epoch is forgotten."""
    rows = requests.select("batch_id", "seq", "epoch", "ts")
    return _with_state(rows, ["batch_id"], _Fence(_milliseconds(keep)), "batch_id long, seq long, epoch long, refused boolean", late)


def stop_fence(requests: DataFrame) -> DataFrame:
    """The same on a stored journal: a request is refused when a newer epoch was seen before it. The highest epoch so far is
    carried along each batch's order, so a batch of any size is cut into ranges."""
    rows = requests.select("batch_id", "seq", "epoch")
    seen = ordered_scan(rows, ["batch_id"], [F.col("seq")], running={"seen": Running("epoch", "max", inclusive=False)})
    return seen.select("batch_id", "seq", "epoch", F.coalesce(F.col("seen") > F.col("epoch"), F.lit(False)).alias("refused"))


def idle_sessions(events: DataFrame, gap: str = fixed.STAGING_IDLE) -> DataFrame:
    """Spans of activity per batch: a batch silent for ``gap`` is treated as left (batch or stream)."""
    s = F.session_window("ts", gap)
    return events.groupBy("batch_id", s.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        "batch_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("idle_at"), "events"
    )


def stream_staging_idle(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return idle_sessions(events.withWatermark("ts", late))


def autosave_dedup(saves: DataFrame, within: str = "1 hour") -> DataFrame:
    """One row per draft state however often it is saved (saves: photo_id, state_hash, ts)."""
    return saves.withWatermark("ts", within).dropDuplicatesWithinWatermark(["photo_id", "state_hash"])


def late_rows_dropped(query) -> int:
    """Rows a finished query dropped as later than its watermark, from its progress reports."""
    return sum(
        int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"]
    )


COUNTED = "batch_id long, from_ts timestamp, late boolean, seq long, done long"


class _Windows(_Expiring):
    """Rows counted per time window, and the rows that come too late for their window.

    A row is late if its window ended ``late_ms`` or more before the newest row of its batch in earlier micro-batches. Windows
    that no row can enter any more are dropped from the state."""

    def __init__(self, width_ms: int, late_ms: int, keep_ms: int):
        super().__init__(keep_ms)
        self.width_ms, self.late_ms = width_ms, late_ms

    def open_states(self, handle):
        self.open = handle.getValueState("windows", "newest long, starts array<long>, counts array<long>")
        return [self.open]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.open.get()
        newest, starts, counts = kept or (None, [], [])
        held, touched, high = dict(zip(starts, counts, strict=True)), set(), newest
        for chunk in rows:
            ms = chunk["ts"].to_numpy().astype("datetime64[ms]").astype("int64")
            start = ms // self.width_ms * self.width_ms
            late = np.zeros(len(ms), dtype=bool) if newest is None else start + self.width_ms <= newest - self.late_ms
            if late.any():
                yield self._rows(key, start[late], True, chunk["seq"].to_numpy()[late], 1)
            for s, n in zip(*np.unique(start[~late], return_counts=True), strict=True):
                held[int(s)] = held.get(int(s), 0) + int(n)
                touched.add(int(s))
            high = int(ms.max()) if high is None else max(high, int(ms.max()))
        if touched:
            at = sorted(touched)
            yield self._rows(key, np.array(at), False, None, [held[s] for s in at])
        held = {s: n for s, n in held.items() if s + self.width_ms > high - self.late_ms}
        self.open.update((high, list(held), list(held.values())))
        # every call to the state takes a round trip: a batch has one timer, set with its state and again when it runs out
        if kept is None:
            self.handle.registerTimer(high + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.open.get()
        if kept is not None and kept[0] + self.keep_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(kept[0] + self.keep_ms)
        else:
            self.open.clear()
        return iter(())

    @staticmethod
    def _rows(key, start, late, seq, done) -> pd.DataFrame:
        seq = pd.array([None] * len(start), dtype="Int64") if seq is None else seq
        return pd.DataFrame({"batch_id": key[0], "from_ts": start.astype("datetime64[ms]"), "late": late, "seq": seq, "done": done})


def stream_counts_and_late(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", keep: str = "7 days") -> DataFrame:
    """(batch_id, from_ts, late, seq, done): counts of rows per batch and window as they grow (``late`` false), and beside
    them each late row (``late`` true, with its ``seq``). Lateness is judged by the operator itself, against the batch's own
    rows; the watermark that runs the timers trails by ``keep``, and only rows older than that go unseen."""
    rows = events.select("batch_id", "ts", "seq")
    return _with_state(rows, ["batch_id"], _Windows(_milliseconds(width), _milliseconds(late), _milliseconds(late)), COUNTED, keep)


def window_counts(store: ResultStore) -> DataFrame:
    """The last count of each window."""
    return store.read().where("NOT late").groupBy("batch_id", "from_ts").agg(F.max("done").alias("done"))


def late_rows(store: ResultStore) -> DataFrame:
    """The side output: rows that came too late to be counted."""
    return store.read().where("late").select("batch_id", "from_ts", "seq")


# -- new photos ----------------------------------------------------------------------------------------------


def stream_new_photos(inventory: DataFrame, store: ResultStore, version: int, checkpoint: str, analyze):
    """Analyze files as they appear or change: each micro-batch is compared with the stored results of the buckets its
    files fall into, no others are opened, and only files without a result are analyzed. Results are committed per
    micro-batch."""

    def handle(df: DataFrame, epoch: int) -> None:
        files = df.dropDuplicates(VERSION_KEY).persist()
        try:
            # results of earlier micro-batches only: a repeated one replaces its own
            stored = store.read(store.buckets_in(files), before=epoch)
            store.write(analyze(pending_analysis(files, stored, version, False)), epoch)
        finally:
            files.unpersist()

    return inventory.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def stored_results(store: ResultStore, inventory: DataFrame) -> DataFrame:
    """The stored results that ``incremental_analysis`` can need for these files: those of their buckets."""
    return store.read(store.buckets_in(inventory))
