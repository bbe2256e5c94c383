"""Streams over several files and triggers: state that expires, late rows, commits, and results read by bucket."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from photocat.operators import identity
from photocat.plans.q_streams import _with_rocksdb
from photocat.streaming import journal
from photocat.streaming.store import ResultStore

EVENTS = "batch_id long, idx long, ts timestamp, seq long, state string, epoch long, t double, done long, total long"


class Feed:
    """A folder that gets one file per trigger, and a stream over it started anew each time from its checkpoint."""

    def __init__(self, spark, base, live, schema, key=("batch_id",), mode="append"):
        self.spark, self.base, self.live, self.mode, self.n = spark, str(base), live, mode, 0
        self.store = ResultStore(spark, f"{base}/results", schema, key, 4)
        self.all = []

    def add(self, *rows):
        """rows: (batch_id, minute, seq, more columns)"""
        df = self.spark.createDataFrame([(b, m, s, *(extra.get(c) for c in ("idx", "state", "epoch", "done", "total"))) for b, m, s, extra in rows], "batch_id long, minute long, seq long, idx long, state string, epoch long, done long, total long")
        df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60)).withColumn("t", F.col("ts").cast("double"))
        df = df.select(*[c.split()[0] for c in EVENTS.split(", ")]).coalesce(1)
        df.write.parquet(f"{self.base}/in/{self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(EVENTS).parquet(f"{self.base}/in/*")
        q = _with_rocksdb(self.spark, lambda: self._run(stream))
        return q

    def _run(self, stream):
        q = journal.write_epochs(self.live(stream), self.store, f"{self.base}/progress", self.mode)
        q.awaitTermination()
        return q

    @staticmethod
    def kept(q):
        """Rows of state after the last micro-batch."""
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_time_left_forgets_finished_and_silent_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda e: journal.stream_eta(e, late="10 minutes", keep="2 hours"), "batch_id long, t double, done long, left_s double")
    report = lambda b, m, done, total=10: (b, m, 0, {"done": done, "total": total})
    feed.add(report(1, 0, 0), report(1, 1, 2), report(2, 0, 0), report(2, 2, 4), report(3, 0, 5))
    before = feed.kept(feed.add(report(1, 30, 5), report(2, 31, 10)))  # batch 2 is complete
    after = feed.kept(feed.add(report(1, 60, 6)))
    last = feed.kept(feed.add(report(4, 400, 1), report(4, 401, 2)))  # all others are silent
    assert before > after > last
    got = {(r.batch_id, r.done): r.left_s for r in feed.store.read().collect()}
    assert got[2, 10] == 0.0 and got[1, 2] == 240.0 and got[3, 5] is None and got[1, 6] is not None
    # batch 1 went on from its state, as in one pass over all reports
    pace, base = None, 1_700_000_000.0
    for minute, done in ((0, 0), (1, 2), (30, 5), (60, 6)):
        t = base + minute * 60
        pace = journal.Pace(t, done, done, None) if pace is None else pace.after(t, done, 10)
    assert got[1, 6] == pace.left(t, 6, 10)


def test_fence_over_several_files_equals_the_batch_form(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda e: journal.stream_stop_fence(e, keep="3 hours"), "batch_id long, seq long, epoch long, refused boolean")
    rows = [(b, 20 * k, 10 * k + b, {"epoch": (k + b) % 3 if k % 4 else 0}) for k in range(9) for b in range(3)]
    feed.add(*rows[:9])
    first = feed.kept(feed.add(*rows[9:18]))
    feed.add(*rows[18:])
    last = feed.kept(feed.add((7, 2000, 999, {"epoch": 0})))
    assert last < first
    flat = spark.createDataFrame([(b, s, x["epoch"]) for b, _, s, x in rows] + [(7, 999, 0)], "batch_id long, seq long, epoch long")
    assert sorted(map(tuple, feed.store.read().collect())) == sorted(map(tuple, journal.stop_fence(flat).collect()))
    assert feed.store.read().where("refused").count() > 0


def test_current_state_keeps_only_what_was_active_lately(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda e: journal.stream_current_state(e, span="1 hour"), journal.LATEST, ("batch_id", "idx"), "update")
    rows = [(b, 100 * k + b, 10 * k + b, {"idx": b, "state": ("staged", "running", "done", "failed")[k]}) for k in range(4) for b in range(5)]
    kept = [feed.kept(feed.add(*rows[5 * k : 5 * k + 5])) for k in range(3)]
    kept.append(feed.kept(feed.add(*rows[15:17])))
    assert max(kept) <= 10 and kept[-1] < kept[0] + 5
    got = {(r.batch_id, r.idx): r.state for r in journal.read_latest(feed.store).collect()}
    assert got == {(b, b): "failed" if b < 2 else "done" for b in range(5)}


def test_late_rows_go_to_the_side_and_are_not_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda e: journal.stream_counts_and_late(e, "1 hour", "10 minutes", keep="30 days"), journal.COUNTED)
    start = -(1_700_000_000 // 60 % 60)  # minutes to the full hour before
    at = lambda b, m, s: (b, start + m, s, {})
    feed.add(at(1, 5, 1), at(1, 50, 2), at(1, 130, 3), at(2, 10, 4))
    q = feed.add(at(1, 55, 5), at(2, 30, 6), at(1, 119, 7))  # batch 1 is at 2:10: windows up to 2:00 are closed for it
    assert journal.late_rows_dropped(q) == 0
    feed.add(at(2, 70, 8), at(2, 20, 9), at(2, 500, 10))
    feed.add(at(2, 40, 11))
    late = sorted(r.seq for r in journal.late_rows(feed.store).collect())
    assert late == [5, 7, 11]  # 9 came in one lot with 8: its window was open before
    counts = sorted((r.batch_id, r.done) for r in journal.window_counts(feed.store).collect())
    assert counts == [(1, 1), (1, 2), (2, 1), (2, 1), (2, 3)]


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, f"{tmp_path}/store", "path string, v long", ["path"], 8)


def values(store, **how):
    return sorted((r.path, r.v) for r in store.read(**how).collect())


def test_a_killed_attempt_leaves_the_earlier_result(spark, store):
    rows = lambda *v: spark.createDataFrame(list(v), "path string, v long")
    assert values(store) == []
    store.write(rows(("a", 1), ("b", 2)), 0)
    pending = store.write_aside(rows(("a", 9), ("c", 3)), 0)  # killed here
    assert values(store) == [("a", 1), ("b", 2)]
    store.commit(pending)  # the attempt that lives
    assert values(store) == [("a", 9), ("c", 3)]
    store.write(rows(("d", 4)), 1)
    assert values(store, before=1) == [("a", 9), ("c", 3)]
    store.write(rows(), 2)
    store.merge()
    store.clean()
    assert values(store) == [("a", 9), ("c", 3), ("d", 4)] and len(store.folder.names("rows")) == 1


def test_a_stream_killed_before_its_commit_writes_once(spark, tmp_path, monkeypatch):
    feed = Feed(spark, tmp_path, lambda e: journal.stream_current_state(e), journal.LATEST, ("batch_id", "idx"), "update")
    feed.add((1, 0, 1, {"idx": 0, "state": "staged"}))
    real, feed.store.commit = feed.store.commit, lambda done: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(Exception, match="killed"):
        feed.add((1, 1, 2, {"idx": 0, "state": "done"}))
    assert [r.state for r in journal.read_latest(feed.store).collect()] == ["staged"]
    feed.store.commit = real
    feed.add((2, 2, 3, {"idx": 0, "state": "running"}))
    assert sorted((r.batch_id, r.state) for r in feed.store.read().collect()) == [(1, "done"), (1, "staged"), (2, "running")]


def test_a_trigger_reads_only_the_buckets_of_its_files(spark, tmp_path, monkeypatch):
    fields = "path string, size_bytes long, mtime_ns long, file_id long, version int, ocr boolean"
    store = ResultStore(spark, f"{tmp_path}/results", fields, ["path"], 32)
    files = lambda names: spark.createDataFrame([(n, 1, 1, 1) for n in names], "path string, size_bytes long, mtime_ns long, file_id long")
    analyzed, opened = [], []

    def analyze(new):
        analyzed.append(sorted(r.path for r in new.collect()))
        return new.withColumns({"version": F.lit(7), "ocr": F.lit(False)})

    read = store.read
    monkeypatch.setattr(store, "read", lambda buckets=None, before=None: (lambda df: opened.append(len(df.inputFiles())) or df)(read(buckets, before)))
    for n, names in enumerate([[f"p{k}" for k in range(400)], ["p1", "p2", "new"], ["new", "p399"]]):
        files(names).write.parquet(f"{tmp_path}/in/{n}")
        inventory = spark.readStream.schema(files([]).schema).parquet(f"{tmp_path}/in/*")
        journal.stream_new_photos(inventory, store, 7, f"{tmp_path}/progress", analyze).awaitTermination()
    assert analyzed[1:] == [["new"], []] and len(analyzed[0]) == 400
    assert opened[0] == 0 and 1 <= opened[1] <= 3 and 1 <= opened[2] <= 3
    assert len(read().inputFiles()) >= 30
    # stored results of a few files for the batch form
    kept = identity.incremental_analysis(files(["p5", "more"]), journal.stored_results(store, files(["p5", "more"])), 7, False, analyze)
    assert sorted(r.path for r in kept.collect()) == ["more", "p5"] and analyzed[-1] == ["more"]


class _Calls:
    """A state handle that counts round trips."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            elif name == "registerTimer":
                self.timers.append(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            return {"get": self.value, "exists": self.value is not None, "listTimers": list(self.timers)}.get(name)

        return call


def test_a_batch_of_late_windows_costs_few_round_trips_and_expires_after_its_newest_row():
    calls = _Calls()
    windows = journal._Windows(3_600_000, 600_000, 1_000_000)
    windows.init(calls)
    hours = lambda *at: [pd.DataFrame({"ts": pd.to_datetime([int(h * 3_600_000) for h in at], unit="ms"), "seq": range(len(at))})]
    first = pd.concat(windows.handleInputRows((1,), iter(hours(5, 5.5)), None))
    assert calls.calls <= 3 and calls.timers == [int(5.5 * 3_600_000) + 1_000_000]
    more = pd.concat(windows.handleInputRows((1,), iter(hours(7, 1)), None))
    assert calls.calls <= 5 and first.done.tolist() == [2] and sorted(more.late) == [False, True]
    due = calls.timers.pop()
    fired = type("Fired", (), {"getExpiryTimeInMs": lambda self: due})()
    list(windows.handleExpiredTimer((1,), None, fired))
    assert calls.value is not None and calls.timers == [7 * 3_600_000 + 1_000_000]  # rows came meanwhile
    due = calls.timers.pop()
    list(windows.handleExpiredTimer((1,), None, fired))
    assert calls.value is None and not calls.timers
