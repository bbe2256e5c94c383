"""Caption tokens with options, over one photo of own data."""

import pytest

from photocat.functions.captions import group, lit, tok
from photocat.operators import captions
from pyspark.sql import functions as F

AS_OF = "2026-01-01"
FACE = "photo_id long, region_no long, source string, name string, x double, y double, w double, h double"
KEYWORD = "photo_id long, keyword_key string, src_rank int, item long, keyword string"


def box(n, name, cx, cy):
    return (1, n, "MWG", name, cx - 0.02, cy - 0.03, 0.04, 0.06)


ROWS = [box(0, "Lia", 0.2, 0.8), box(1, "Max", 0.5, 0.81), box(2, "Nora", 0.8, 0.8), box(3, "Otto", 0.3, 0.4), box(4, "Pia", 0.6, 0.41)]
WORDS = ["People|Lia", "Family", "Scan 2024", "Harvest", "DATE: Y!M~"]


@pytest.fixture(scope="module")
def say(spark):
    def run(*items, faces=ROWS, words=WORDS, **fields):
        row = {"title": "Harvest at Hill Farm", "date": "1952-06-14", "rated": "Y!M~", "sublocation": "Barn", "city": "Ulm", "state": None, "country": "Germany", "notes": None} | fields
        df = spark.createDataFrame([(1, *row.values())], "photo_id long, " + ", ".join(f"{c} string" for c in row))
        kw = spark.createDataFrame([(1, w.lower(), 0, n, w) for n, w in enumerate(words)], KEYWORD)
        paths = spark.createDataFrame([(1, "Topics|Farm|Harvest")], "photo_id long, path string")
        sources = captions.Sources(df, spark.createDataFrame(faces, FACE), kw, paths)
        return captions.render_captions(sources, {"b": list(items)}).first().caption

    return run


def test_names(say):
    assert say(tok("names")) == "Lia, Otto, Max, Pia and Nora"
    assert say(tok("names", order="rl")) == "Nora, Pia, Max, Otto and Lia"
    assert say(tok("names", order="meta", sep="; ", last="; ")) == "Lia; Max; Nora; Otto; Pia"
    assert say(tok("names.count"), lit(" named")) == "5 named"
    assert say(tok("title"), lit("\n"), tok("names"), lit("\n"), tok("names.count"), faces=[box(0, "", 0.2, 0.2)]) == "Harvest at Hill Farm"


def test_names_by_rows(say):
    assert say(tok("names", rows=True)) == "Front row, L–R: Lia, Max and Nora; Back row, L–R: Otto and Pia"
    assert say(tok("names", rows=True, labels=["Front: ", " Back: "], row_sep="\n")) == "Front: Lia, Max and Nora\nBack: Otto and Pia"
    assert say(tok("names", rows=True, order="rl", labels=["A: ", "B: "])) == "A: Nora, Max and Lia; B: Pia and Otto"
    assert say(tok("names", rows=True), faces=ROWS[:3]) == "Lia, Max and Nora"
    nowhere = [(1, 9, "listed", "Somebody", None, None, None, None)]
    assert say(tok("names", rows=True), faces=ROWS[:1] + ROWS[3:4] + nowhere) == "Lia, Otto and Somebody"
    assert say(tok("names", rows=True, case="upper", max=12)) == "FRONT ROW,…"


def test_keywords(say):
    assert say(tok("keywords")) == "People|Lia, Family, Scan 2024, Harvest"
    assert say(tok("keywords", markers="show")) == "People|Lia, Family, Scan 2024, Harvest, DATE: Y!M~"
    assert say(tok("keywords", exclude=["people", "SCAN"])) == "Family, Harvest"
    assert say(tok("keywords", exclude=["topics"], sep=" / ")) == "People|Lia / Family / Scan 2024"
    assert say(tok("title"), group(lit(" - "), tok("keywords", exclude=["people", "scan", "topics", "family"]))) == "Harvest at Hill Farm"


def test_dates(say):
    assert say(tok("date", as_of=AS_OF)) == "June 14, 1952"
    assert say(tok("date", as_of=AS_OF, certainty="rated")) == "c. June 1952"
    assert say(tok("date", as_of=AS_OF, certainty="rated", circa="about ")) == "about June 1952"
    assert say(tok("date", as_of=AS_OF, certainty="rated", fmt="yyyy")) == "1952"
    assert say(tok("date", as_of=AS_OF, fmt="d mmmm yyyy"), date="1952-06") == "June 1952"


def test_one_column_for_equal_tokens(spark, say):
    assert say(tok("location")) == "Barn, Ulm, Germany"
    assert say(tok("location"), city=" ", sublocation=None) == "Germany"
    df = spark.createDataFrame([(1, "a")], "photo_id long, title string")
    bound, at = captions.bind(captions.Sources(df), [[tok("title"), group(lit("x"), tok("title"))], [tok("title"), tok("title", case="upper")]])
    assert [c for c in bound.columns if c.startswith("_tok")] == ["_tok0", "_tok1"]
    assert bound.select(at(tok("title", case="upper"))).first()[0] == "A"


def test_many_photos_without_anything(spark):
    df = spark.createDataFrame([(k, None) for k in range(3)], "photo_id long, title string")
    faces, kw = spark.createDataFrame([], FACE), spark.createDataFrame([], KEYWORD)
    got = captions.caption_coverage(captions.Sources(df, faces, kw, None), {"b": [tok("title"), group(tok("names")), group(tok("keywords"))]})
    assert sorted((r.photo_id, r.token, r.expected) for r in got.where(F.col("photo_id") == 1).collect()) == [(1, "keywords", True), (1, "names", True), (1, "title", False)]
