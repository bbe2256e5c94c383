"""Typed edits: checked, overlaid and compared as lists and objects."""

import json

import pytest

from photocat.operators import typed_edits as te

AS_OF = "2026-01-01"


def edit_rows(spark, *rows):
    """rows: (photo_id, field, value[, edited_at])"""
    data = [(p, f, v if isinstance(v, str) and v.startswith("{bad") else json.dumps(v), at[0] if at else 1, n) for n, (p, f, v, *at) in enumerate(rows)]
    return te.typed(spark.createDataFrame(data, "photo_id long, field string, value string, edited_at long, edit_seq long"))


def check(spark, field, value, **limits):
    r = te.validate_typed_edits(edit_rows(spark, (1, field, value)), AS_OF, te.Limits(**limits)).selectExpr("errors", "to_json(value) AS v").first()
    return r.errors, json.loads(r.v) if r.v is not None else None


CASES = [
    ("title", " One ", [], "One"),
    ("title", None, [], None),
    ("title", 7, ["not text"], 7),
    ("title", "a\nb", ["line breaks"], "a\nb"),
    ("caption", "a\r\nb", [], "a\nb"),
    ("title", "base64:xyz", ["starts with base64:"], "base64:xyz"),
    ("creator", ["Smith, John", " Jones, Mary ", " "], [], ["Smith, John", "Jones, Mary"]),
    ("creator", [], [], []),
    ("creator", "ACME; Inc.", [], "ACME; Inc."),
    ("creator", ["a", 3], ["an item is not text"], ["a", 3]),
    ("creator", ["a\x07b"], ["control characters"], ["a\x07b"]),
    ("creator", ["a"] * 51, ["too many creators"], ["a"] * 51),
    ("keywords", ["Sea", "sea", " ", "DATE: Y!", "Boat "], [], ["Sea", "Boat"]),
    ("keywords", "Sea", ["not a list"], "Sea"),
    ("keywords", ["k" * 201], ["too long"], ["k" * 201]),
    ("date", {"iso": "1952-06", "level": "month"}, [], {"iso": "1952-06", "level": "month", "estimate": False}),
    ("date", {"iso": " 1952 ", "level": "circa"}, [], {"iso": "1952", "level": "year", "estimate": True}),
    ("date", {"iso": "1952-06-14", "level": "day", "estimate": True}, [], {"iso": "1952-06-14", "level": "day", "estimate": True}),
    ("date", {"iso": "1952", "level": "day"}, ["does not fit the level"], {"iso": "1952", "level": "day"}),
    ("date", {"iso": "1952-13", "level": "month"}, ["not a date"], {"iso": "1952-13", "level": "month"}),
    ("date", {"iso": "June 1952", "level": "month"}, ["not written as a date", "does not fit the level"], None),
    ("date", {"level": "month"}, ["not a date edit"], {"level": "month"}),
    ("date", {"iso": "1952", "level": "year", "estimate": "yes"}, ["estimate is not true or false"], None),
    ("date", {"iso": "1952", "level": "year", "pattern": "X"}, ["bad pattern"], None),
    ("date", "1952", ["not a date edit"], "1952"),
    ("weather", "fine", ["unknown field"], "fine"),
    ("title", "{bad json", ["no JSON"], None),
]


def test_checking(spark):
    df = edit_rows(spark, *[(n, f, v) for n, (f, v, _, _) in enumerate(CASES)])
    got = {r.photo_id: r for r in te.validate_typed_edits(df, AS_OF).selectExpr("photo_id", "errors", "to_json(value) AS v").collect()}
    for n, (field, value, errors, stored) in enumerate(CASES):
        if "does not fit the level" in errors and len(errors) > 1:
            errors = errors[:1]
        assert got[n].errors[: len(errors)] == errors and bool(got[n].errors) == bool(errors), (field, value, got[n].errors)
        if stored is not None:
            v = json.loads(got[n].v)
            assert ({k: x for k, x in v.items() if x is not None} if isinstance(v, dict) else v) == stored, (field, value, got[n].v)
    assert check(spark, "creator", ["a", "b"], creators=1)[0] == ["too many creators"]


def test_overlay_and_comparison(spark):
    fields = "photo_id long, title string, caption string, notes string, creator string, sublocation string, city string, state string, country string, creators array<string>, keywords array<string>, date string, certainty string"
    base = lambda p: (p, "T", None, None, "ACME; Inc., Jane", None, "Rome", None, None, ["ACME; Inc.", "Jane"], ["Sea", "DATE: Y!M~"], "1950-01", "Y!M~")
    df = spark.createDataFrame([base(p) for p in range(1, 8)], fields)
    edits = te.validate_typed_edits(edit_rows(
        spark,
        (1, "creator", ["Smith, John", "Jones, Mary", "Lee, Ann"]), (2, "creator", ["ACME; Inc.", "Jane", "Bo"]), (3, "creator", "One, Name"), (4, "creator", None),
        (5, "date", {"iso": "1952-06-14", "level": "day", "estimate": True}), (6, "date", None), (7, "date", {"iso": "1960", "level": "circa"}), (7, "keywords", ["Hill"]),
        (1, "title", "old", 1), (1, "title", "", 5), (1, "city", "late", 0), (5, "keywords", ["a", "A"]),
    ), AS_OF)
    assert edits.where("size(errors) > 0").count() == 0
    after = te.apply_typed_edits(df, edits)
    got = {r.photo_id: r for r in after.collect()}
    assert got[1].creators == ["Smith, John", "Jones, Mary", "Lee, Ann"] and got[1].creator == "Smith, John; Jones, Mary; Lee, Ann"
    assert got[2].creator == "ACME; Inc., Jane, Bo" and got[3].creators == ["One, Name"] and got[4].creators == [] and got[4].creator is None
    assert got[1].title is None and got[1].city == "late" and got[2].title == "T"
    assert (got[5].date, got[5].certainty) == ("1952-06-14", "Y!M!D~") and got[5].keywords == ["a", "DATE: Y!M!D~"]
    assert (got[6].date, got[6].certainty, got[6].keywords) == (None, None, ["Sea"])
    assert (got[7].date, got[7].certainty, got[7].keywords) == ("1960", "Y~", ["Hill", "DATE: Y~"])
    assert got[1].keywords == ["Sea", "DATE: Y!M~"] and got[1].certainty == "Y!M~"
    # what was read back: photo 2 lost a name, photo 3 has the right one in two parts
    back = spark.createDataFrame([(1, ["Smith, John ", "Jones, Mary", "Lee, Ann"]), (2, ["ACME; Inc.", "Jane"]), (3, ["One", "Name"]), (4, None)], "photo_id long, creators array<string>")
    assert sorted(r.photo_id for r in te.check_creators(after, back, edits).collect()) == [2, 3]
    assert {(r.photo_id, r.iso, r.pattern) for r in te.date_edit_rows(edits).collect()} == {(5, "1952-06-14", "Y!M!D~"), (6, None, None), (7, "1960", "Y~")}
    assert sorted((r.photo_id, r.item, r.keyword) for r in te.keyword_edit_rows(edits).collect()) == [(5, 0, "a"), (7, 0, "Hill")]


@pytest.mark.parametrize("n", [0])
def test_no_rows(spark, n):
    assert te.validate_typed_edits(edit_rows(spark, (1, "title", "x")).limit(n), AS_OF).count() == 0


def test_edits_of_one_file_are_checked_by_all_tasks_and_once(spark):
    df = spark.range(2000, numPartitions=1).selectExpr("id AS photo_id", "if(id % 2 = 0, 'title', 'date') AS field", "if(id % 2 = 0, concat('\"', id, '\"'), 'null') AS value", "1L AS edited_at", "id AS edit_seq")
    good = te.validate_typed_edits(te.typed(df), AS_OF).where("size(errors) = 0")
    dealt = good.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(dealt) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in dealt) == 2000
    # a filter on the errors does not check a second time
    assert good._jdf.queryExecution().optimizedPlan().toString().count("too many creators") == 1
