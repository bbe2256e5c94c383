import numpy as np
import pandas as pd

from photocat.streaming.journal import Pace, _TimeLeft


def run(reports):
    pace, out = None, []
    for t, done, total in reports:
        pace = Pace(t, done, done, None) if pace is None or done < pace.start_done else pace.after(t, done, total)
        out.append(pace.left(t, done, total))
    return out


def test_steady_speed():
    assert run([(0.0, 0, 10), (5.0, 1, 10), (10.0, 2, 10), (15.0, 3, 10), (16.0, 3, 10), (50.0, 10, 10)]) == [None, None, 40.0, 35.0, 34.0, 0.0]


def test_a_slower_report_moves_the_end_partly():
    # after 2 in 10 s the end is at 50 s; the third comes at 30 s, which leads to 100 s
    assert run([(0.0, 0, 10), (10.0, 2, 10), (30.0, 3, 10)])[-1] == 50.0 + 0.35 * 50.0 - 30.0


def test_a_lower_count_starts_anew():
    assert run([(0.0, 4, 10), (1.0, 6, 10), (2.0, 3, 10), (4.0, 5, 10)]) == [None, 2.0, None, 5.0]


class _Value:
    def __init__(self):
        self.held = None

    def getValueState(self, name, schema):
        return self

    def listTimers(self):
        return iter(())

    def registerTimer(self, at):
        pass

    def exists(self):
        return self.held is not None

    def get(self):
        return tuple(self.held)

    def update(self, value):
        self.held = value


def test_a_batch_in_many_chunks_is_in_order():
    """Spark hands over 10,000 rows at a time, in the order of the shuffle."""
    n = 35_000
    reports = pd.DataFrame({"t": np.arange(n) // 3 * 1.0, "done": np.arange(n), "total": n})
    state = _Value()
    processor = _TimeLeft(0)
    processor.init(state)
    got = []
    for part in (reports[:32_000], reports[32_000:]):  # two micro-batches
        mixed = part.sample(frac=1, random_state=5)
        chunks = (mixed[k : k + 10_000] for k in range(0, len(mixed), 10_000))
        got += [r for out in processor.handleInputRows((7,), chunks, None) for r in out.itertuples(index=False)]
    want = run(list(reports.itertuples(index=False)))
    assert [(r.t, r.done) for r in got] == list(zip(reports.t, reports.done, strict=True))
    assert [None if pd.isna(r.left_s) else r.left_s for r in got] == want
