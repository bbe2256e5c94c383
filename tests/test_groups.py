"""Large groups: the split scan and the grid join against plain computations."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from photocat.functions import boxes, groups
from photocat.operators import captions, people
from photocat.streaming import journal


def skewed(spark, n=4000):
    rnd = random.Random(5)
    rows = [(0 if rnd.random() < 0.5 else rnd.randrange(1, 60), i, float(rnd.randrange(50)), rnd.randrange(3)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, i int, v double, s int")


def test_split_scan_equals_window(spark):
    df = skewed(spark)
    order = [F.col("v"), F.col("i")]
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select(
        "k", "i", F.row_number().over(w).cast("long").alias("pos"), F.lag("v").over(w).alias("prev"),
        F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
    )
    got = groups.ordered_scan(df, ["k"], order, position="pos", lag={"prev": "v"}, running={"run": "s"}, parts=23)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect(), key=tuple) or set(map(tuple, got.select(*want.columns).collect())) == set(map(tuple, want.collect()))
    assert got.count() == df.count()


@pytest.mark.parametrize("how", ["max", "min", "bit_xor", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_any_associative_function_is_carried_between_ranges(spark, how, inclusive):
    df = skewed(spark).withColumn("x", F.when(F.col("s") > 0, F.col("i")))
    order = [F.col("v"), F.col("i")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = {"max": F.max("x"), "min": F.min("x"), "bit_xor": F.bit_xor("x"), "last": F.last("x", ignorenulls=True)}[how]
    want = df.select("k", "i", plain.over(w).alias("run"))
    got = groups.ordered_scan(df, ["k"], order, running={"run": groups.Running("x", how, inclusive)}, parts=23)
    assert set(map(tuple, got.select("k", "i", "run").collect())) == set(map(tuple, want.collect()))


def test_stop_fence_with_a_third_of_all_rows_in_one_batch(spark):
    rnd = random.Random(3)
    rows = [(0 if i % 3 == 0 else i, i, min(9, i // 400) - rnd.randrange(2)) for i in range(4000)]
    seen, want = {}, set()
    for b, seq, epoch in rows:
        want.add((b, seq, epoch, seen.get(b, epoch) > epoch))
        seen[b] = max(seen.get(b, epoch), epoch)
    got = journal.stop_fence(spark.createDataFrame(rows, "batch_id long, seq long, epoch long"))
    assert set(map(tuple, got.collect())) == want and any(r[3] for r in want)


def test_large_groups_really_are_split(spark):
    parts = groups.in_ranges(skewed(spark), ["k"], [F.col("v"), F.col("i")], 24).groupBy("k", "_part").count()
    sizes = [r["count"] for r in parts.where("k = 0").collect()]
    assert len(sizes) >= 10 and max(sizes) < 600
    assert parts.groupBy("k").count().where("count > 1").count() < 24


def test_many_groups_that_are_all_large(spark):
    df = spark.range(60_000).select((F.col("id") % 2000).alias("k"), F.hash("id").alias("v"), "id")
    w = Window.partitionBy("k").orderBy("v", "id")
    got = groups.ordered_positions(df, ["k"], [F.col("v"), F.col("id")], parts=97)
    assert got.join(df.withColumn("want", F.row_number().over(w)), "id").where("pos <> want").count() == 0
    assert got.count() == 60_000


def naive_iou(a, b):
    ix = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    iy = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return ix * iy / (a[2] * a[3] + b[2] * b[3] - ix * iy)


def test_grid_join_finds_exactly_the_overlaps(spark):
    rnd = random.Random(9)

    def box():
        w, h = rnd.choice([0.01, 0.03, 0.08, 0.2]) * rnd.uniform(0.8, 1.3), rnd.choice([0.01, 0.05, 0.15]) * rnd.uniform(0.8, 1.3)
        return (rnd.uniform(0, 0.5), rnd.uniform(0, 0.5), w, h)

    lefts = [(1 + i % 2, i, *box()) for i in range(300)]
    rights = [(k, 1000 + i, x + rnd.uniform(-0.01, 0.01), y, w * rnd.uniform(0.8, 1.2), h) for k, i, x, y, w, h in lefts for _ in range(2)]
    left = spark.createDataFrame(lefts, "k int, i int, x double, y double, w double, h double")
    right = spark.createDataFrame(rights, "k int, j int, rx double, ry double, rw double, rh double")
    got = sorted((r.i, r.j, round(r.rx, 9)) for r in groups.overlap_pairs(left, right, ["k"], boxes.iou(), 0.5).collect())
    want = sorted((a[1], b[1], round(b[2], 9)) for a in lefts for b in rights if a[0] == b[0] and naive_iou(a[2:], b[2:]) > 0.5)
    assert got == want and len(want) > 100


def test_grid_join_with_a_high_threshold_is_exact_and_offers_few_cells(spark):
    rnd = random.Random(4)
    lefts = [(i % 3, i, rnd.uniform(0, 0.4), rnd.uniform(0, 0.4), rnd.choice([0.01, 0.125, 0.2]) * rnd.uniform(0.9, 1.1), rnd.choice([0.03, 0.25]) * rnd.uniform(0.9, 1.1)) for i in range(300)]
    f = [0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.25]
    rights = [(k, 1000 * n + i, x + w * rnd.choice([0, 0.02, -0.1, 0.12]), y + h * rnd.choice([0, 0, -0.02, 0.1]), w * rnd.choice(f), h * rnd.choice(f)) for k, i, x, y, w, h in lefts for n in range(6)]
    left = spark.createDataFrame(lefts, "k int, i int, x double, y double, w double, h double")
    right = spark.createDataFrame(rights, "k int, j int, rx double, ry double, rw double, rh double")
    for threshold, cells in ((0.5, 30), (0.8, 5), (0.95, 2.5)):
        got = sorted((r.i, r.j) for r in groups.overlap_pairs(left, right, ["k"], boxes.iou(), threshold).collect())
        want = sorted((a[1], b[1]) for a in lefts for b in rights if a[0] == b[0] and naive_iou(a[2:], b[2:]) > threshold)
        assert got == want and len(want) > 20
        # before, each box offered about 25 cells at any threshold, and all were shuffled
        assert groups.in_reach(right, threshold).count() < cells * len(rights)


def test_rows_of_a_crowd_are_the_same_when_split(spark):
    rnd = random.Random(3)
    rows = [(1 + (i % 5 == 0), i, f"P{i}", rnd.randrange(900) / 1000, rnd.randrange(900) / 1000, 0.03, 0.04) for i in range(1500)]
    faces = spark.createDataFrame(rows, "photo_id long, region_no long, name string, x double, y double, w double, h double")

    def rows_of(df):
        return sorted(map(tuple, df.select("photo_id", "region_no", "row_no").collect()))

    assert rows_of(people.cluster_rows(faces, parts=9)) == rows_of(people.cluster_rows(faces, parts=1))
    assert rows_of(people.cluster_rows_k(faces, 4, parts=9)) == rows_of(people.cluster_rows_k(faces, 4, parts=1))


def test_name_collisions_of_one_popular_name(spark):
    wanted = spark.createDataFrame([(i, i, "/out", "Scan" if i % 3 else "scan", ".tif") for i in range(900)], "photo_id long, idx long, folder string, name string, ext string")
    taken = spark.createDataFrame([(f"/out/SCAN{n}.tif",) for n in ("", "-2", "-3", "-7", "-500", "-02")], "path string")
    for parts in (8, None):
        got = {r.photo_id: r.dest.lower() for r in captions.resolve_name_collisions(wanted, taken, parts).collect()}
        numbers = [n for n in range(2, 1000) if n not in (2, 3, 7, 500)][:900]
        assert got == {i: f"/out/scan-{n}.tif" for i, n in enumerate(numbers)}
