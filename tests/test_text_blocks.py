"""Lines to blocks: plane cells against all pairs, and components against a plain union."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from photocat.operators import text_blocks as tb

LINE = "photo_id long, line_no long, x double, y double, w double, h double"


def linked(a, b):
    """Stacked, or side by side on one baseline."""
    x, y, w, h = a
    x2, y2, w2, h2 = b
    v = max(y, y2) - min(y + h, y2 + h2)
    hz = max(x, x2) - min(x + w, x2 + w2)
    tall, low = max(h, h2), min(h, h2)
    foot = abs((y + h) - (y2 + h2))
    return (v <= tall and hz <= 2 * tall and v > -0.5 * low) or (-v >= 0.5 * low and foot <= 0.2 * tall and hz <= 3.75 * low)


def test_links_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for photo in range(6):
        for n in range(60):
            h = rng.choice([0.5, 3, 8, 8, 9, 16, 40]) * rng.uniform(0.9, 1.1)
            rows.append((photo, n, rng.uniform(-50, 900), rng.uniform(-50, 500), h * rng.choice([0.5, 2, 8, 60]), h))
        rows.append((photo, 60, 5.0, 5.0, 9.0, 0.0))
    got = [tuple(r) for r in tb.line_links(spark.createDataFrame(rows, LINE)).collect()]
    want = {(p, n, m) for p, n, *a in rows for q, m, *b in rows if p == q and m < n and a[3] > 0 < b[3] and linked(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_components_of_any_shape(spark):
    rng = random.Random(4)
    edges = {(1, k + 1, k) for k in range(300)}  # a chain
    edges |= {(2, k, 0) for k in range(1, 200)}  # a star
    edges |= {(3, max(a, b), min(a, b)) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(350)) if a != b}
    edges |= {(4, 2 * k + 1, 2 * k) for k in range(50)}  # pairs, settled in the first round
    perm = list(range(257))
    rng.shuffle(perm)
    edges |= {(5, max(a, b), min(a, b)) for a, b in zip(perm, perm[1:])}
    top = {}

    def find(n):
        while top.setdefault(n, n) != n:
            n = top[n]
        return n

    for p, a, b in edges:
        x, y = find((p, a)), find((p, b))
        top[max(x, y)] = min(x, y)
    want = {(p, n, find((p, n))[1]) for p, n in top if find((p, n)) != (p, n)}
    got = tb.connected(spark.createDataFrame(sorted(edges), "photo_id long, a long, b long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert tb.connected(spark.createDataFrame([], "photo_id long, a long, b long")).count() == 0


def test_a_page_of_twenty_thousand_lines_on_one_baseline(spark):
    rows = [(1, k, 20.0 * k, 100.0 + (k % 3) * 0.1, 10.0, 8.0) for k in range(20_000)] + [(1, 20_000, 20.0 * 20_000 + 500, 100.0, 10.0, 8.0)]
    blocks = tb.block_boxes(tb.group_text_blocks(spark.createDataFrame(rows, LINE))).collect()
    assert sorted((r.block, r.n_lines) for r in blocks) == [(0, 20_000), (20_000, 1)]


def test_words_meet_in_their_line_before_they_are_combined(spark):
    words = spark.range(600, numPartitions=3).selectExpr("id % 3 AS photo_id", "id div 30 % 5 AS line_no", "600 - id AS pos", "if(id % 7 = 0, NULL, concat('w', id)) AS word", "0.5D AS conf")
    lines = tb.assemble_lines(words)
    got = {(r.photo_id, r.line_no): r.text for r in lines.collect()}
    want = {}
    for r in words.orderBy("pos").collect():
        want.setdefault((r.photo_id, r.line_no), []).extend([r.word] if r.word else [])
    assert got == {k: " ".join(v) for k, v in want.items()}
    # before, every map task sorted (and at size spilled) all its words below the shuffle
    plan = lines._jdf.queryExecution().sparkPlan().toString()
    above, below = plan.split("Exchange" if "Exchange" in plan else "RepartitionByExpression", 1)
    assert "Aggregate" in above and "Aggregate" not in below


def first_reached(rows):
    """(photo, line): block, by all pairs."""
    top = {}

    def find(n):
        while top.setdefault(n, n) != n:
            n = top[n]
        return n

    for k, (p, n, *a) in enumerate(rows):
        for q, m, *b in rows[:k]:
            if p == q and None not in a + b and a[3] > 0 < b[3] and linked(a, b):
                s, t = find((p, n)), find((p, m))
                top[max(s, t)] = min(s, t)
    return {(p, n): find((p, n))[1] for p, n, *_ in rows}


def pages(rng, photos, n):
    """Pages of lines of many sizes, some on a raster so that gaps and widths fall on a limit, some boxes flat or missing."""
    for photo in range(photos):
        for k in range(rng.randrange(n)):
            h = rng.choice([(0.01, 0.5, 3.0, 500.0), (8.0, 8.0, 9.0), (4.0, 8.0, 16.0, 64.0, 0.0)][photo % 3])
            x, y, w = (4.0 * rng.randrange(a) for a in (150, 150, 40))
            yield photo, k - (k % 17 == 5), None if k % 23 == 22 else x, y * rng.choice([1, 0.99]), w, h


def written_records(spark):
    """Rows written to shuffles so far, one figure a stage."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_lines_are_dealt_once_and_nothing_is_paired_on_disk(spark):
    lines = spark.range(2_000, numPartitions=4).selectExpr(
        "id % 20 AS photo_id", "id div 20 AS line_no", "id div 20 % 2 * 600D AS x", "id div 40 * 12D AS y", "100D AS w", "10D AS h")
    before = written_records(spark)
    blocks = tb.group_text_blocks(lines).groupBy("block").count().collect()
    assert sorted((r.block, r["count"]) for r in blocks) == [(0, 1_000), (1, 1_000)]
    after = sum(n for stage, n in written_records(spark).items() if stage not in before)
    # once whole, and combined for the count of a photo's lines; before, 182,042
    assert 2_000 <= after <= 2 * 2_000


def test_blocks_within_a_task_whatever_the_batches(monkeypatch):
    rng = random.Random(7)
    for lot, pairs, batch in ((1, 1, 1), (40, 7, 3), (50_000, 1 << 19, 1_000)):
        monkeypatch.setattr(tb, "LOT", lot)
        monkeypatch.setattr(tb, "PAIRS", pairs)
        rows = list(pages(rng, 12, 80))
        lines = pa.table({c: pa.array(v, pa.int64() if c.endswith("o") or c.endswith("d") else pa.float64()) for c, v in zip(LINE.replace(",", "").split()[::2], zip(*rows))})
        got = pa.Table.from_batches(tb._blocks_within(iter(lines.to_batches(max_chunksize=batch))))
        want = first_reached(rows)
        assert got.drop_columns("block").equals(lines)
        assert got["block"].to_pylist() == [want[r[:2]] for r in rows] and len(set(want.items())) > len(set(want.values())) > 20


def test_blocks_keep_all_columns_and_lines_of_no_photo(spark):
    rows = [(None, "b", 0.0, 0.0, 50.0, 10.0, "x"), (None, "a", 0.0, 12.0, 50.0, 10.0, None), ("p", "c", 0.0, 0.0, 50.0, 10.0, "y"), ("p", None, 0.0, 12.0, 50.0, 10.0, "z"), ("q", "d", None, 0.0, 50.0, 10.0, "")]
    lines = spark.createDataFrame(rows, "photo_id string, line_no string, x double, y double, w double, h double, text string")
    got = tb.group_text_blocks(lines.withColumn("day", F.lit("2026-01-02").cast("date")))
    assert got.columns == [*lines.columns, "day", "block"]
    assert {(r.photo_id, r.line_no, r.text, str(r.day), r.block) for r in got.collect()} == {
        (None, "b", "x", "2026-01-02", "a"), (None, "a", None, "2026-01-02", "a"), ("p", "c", "y", "2026-01-02", "c"),
        ("p", None, "z", "2026-01-02", None), ("q", "d", "", "2026-01-02", "d")}
    assert tb.group_text_blocks(spark.createDataFrame([], LINE)).collect() == []


def test_photos_of_more_lines_than_a_task_takes_in(spark, monkeypatch):
    rows = list(pages(random.Random(9), 6, 90))
    rows = [(p if p != 3 else None, *r) for p, *r in rows]
    monkeypatch.setattr(tb, "WHOLE", 20)
    got = {(r.photo_id, r.line_no): r.block for r in tb.group_text_blocks(spark.createDataFrame(rows, LINE)).collect()}
    want = first_reached([(3 if p is None else p, *r) for p, *r in rows])
    assert got == {(None if p == 3 else p, n): b for (p, n), b in want.items()}


def test_of_a_large_photo_blocks_are_joined_in_rounds_not_lines(spark, monkeypatch):
    monkeypatch.setattr(tb, "WHOLE", 100)
    lines = spark.range(6_000, numPartitions=4).selectExpr("1L AS photo_id", "id AS line_no", "id % 2 * 600D AS x", "id div 2 * 12D AS y", "100D AS w", "10D AS h")
    before = written_records(spark)
    blocks = tb.group_text_blocks(lines).groupBy("block").count().collect()
    assert sorted((r.block, r["count"]) for r in blocks) == [(0, 3_000), (1, 3_000)]
    after = sum(n for stage, n in written_records(spark).items() if stage not in before)
    assert after <= 20 * 6_000  # before, 1,196,416
