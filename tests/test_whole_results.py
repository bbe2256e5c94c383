"""Results that leave nothing out: short last blocks, names in other case, repeated rows, long notes."""

import pytest
from pyspark.sql import functions as F

from photocat.functions.captions import tok, token_text
from photocat.operators import captions, identity, reports


def test_last_samples_count(spark):
    a, b = [1.0] * 1025, [1.0] * 1024 + [9.0]
    df = spark.createDataFrame([(a, a), (a, b), (a, a[:-1])], "a array<double>, b array<double>")
    rows = identity.lossy_similarity(df, "a", "b", 255.0).collect()
    assert rows[0].mad == 0 and rows[0].same_picture
    assert rows[1].mad > 0
    assert rows[2].mad is None and rows[2].same_picture is False


def test_names_that_differ_in_case_are_one_name(spark):
    planned = spark.createDataFrame([(1, "/p/Cat.jpg"), (2, "/p/dog.jpg"), (3, "/p/new.jpg")], "photo_id long, dest string")
    taken = spark.createDataFrame([("/p/cat.jpg", 1), ("/p/CAT.jpg", None), ("/p/dog.jpg", 2), ("/p/DOG.JPG", 2)], "path string, owner_id long")
    got = {r.photo_id: r.decision for r in captions.overwrite_policy(planned, taken, "overwrite").collect()}
    assert got == {1: "count up", 2: "replace", 3: "write"}


def test_counts_of_repeated_rows(spark):
    side = lambda rows: spark.createDataFrame(rows, "path string, size_bytes long")
    got = {r.part: r.files for r in reports.inventory_counts(side([("x", 1), ("x", 1), ("y", 2)]), side([("x", 1), ("z", 3)])).collect()}
    assert got == {"kept": 1, "only before": 2, "only now": 1}
    assert {r.files for r in reports.inventory_counts(side([]), side([])).collect()} == {0}


def test_tokens(spark):
    df = spark.createDataFrame([("word " * 100, "1937-11-23")], "notes string, date string")
    r = df.select(token_text(tok("notes")), token_text(tok("notes", max=30)), token_text(tok("date", fmt="yyyy", as_of="2026-01-01"))).first()
    assert r[0] == ("word " * 100).strip() and len(r[1]) <= 30 and r[2] == "1937"
    for options in ({"fmt": "yyyy"}, {"length": 3}):
        with pytest.raises(ValueError):
            tok("date", **options)


def test_whole_log(spark):
    log = spark.range(700).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 60).alias("time"))
    assert reports.recent_log(log).count() == 700 and [r.seq for r in reports.recent_log(log, 2).collect()] == [699, 698]


def test_the_registered_tag_listing_has_all_tags_and_whole_values(spark, monkeypatch):
    from photocat.plans import q_reports, registry

    tags = spark.createDataFrame([(1, f"XMP:T{k:02}", 0, "v" * 900) for k in range(30)], "photo_id long, tag string, item long, value string")
    monkeypatch.setattr(q_reports, "load", lambda spark, sf, name: tags)
    got = registry.QUERIES["s5_tag_listing_whole"](spark, "").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tags.collect()))
