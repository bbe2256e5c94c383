"""Fields with several items, and values that were decoded wrongly."""

from photocat.operators import normalize

TAGS = "photo_id long, tag string, item long, value string"


def test_all_items_of_the_first_tag(spark):
    tags = spark.createDataFrame([
        (1, "XMP-dc:Creator", 0, "Lee, Kim"), (1, "XMP-dc:Creator", 1, " Roe, Sam "), (1, "XMP-dc:Creator", 2, " "),
        (2, "XMP-dc:Creator", 1, "Sam Roe"), (2, "XMP-dc:Creator", 0, "Kim Lee"), (2, "IPTC:By-line", 0, "Somebody else"),
        (3, "XMP-dc:Title", 0, "One"), (3, "XMP-dc:Title", 1, "Two, or three"),
    ], TAGS)
    got = {r.photo_id: r for r in normalize.normalize_fields(tags).collect()}
    assert got[1].creator == "Lee, Kim; Roe, Sam"
    assert got[2].creator == "Kim Lee, Sam Roe"
    assert got[3].title == "One, Two, or three"


def test_repaired_before_the_pick(spark):
    tags = spark.createDataFrame([
        (1, "IPTC:City", 0, "OrlÃ©ans"), (2, "IPTC:City", 0, "OrlÃ©ans"), (2, "IPTC:CodedCharacterSet", 0, "UTF8"), (3, "IPTC:City", 0, "Orléans"),
        (1, "IPTC:Keywords", 0, "cafÃ©"),
    ], TAGS)
    assert {r.photo_id: r.city for r in normalize.normalize_fields(tags).collect()} == {1: "Orléans", 2: "OrlÃ©ans", 3: "Orléans"}
    assert [r.keyword for r in normalize.merge_keywords(tags).collect()] == ["café"]


def test_a_part_of_the_fields_is_read_for_the_same_photos(spark):
    rows = [
        (1, "XMP-photoshop:DateCreated", 0, "1952"), (1, "XMP-dc:Title", 0, "a"), (2, "XMP-dc:Title-de", 0, "b"), (3, "IPTC:City", 0, " "),
        (4, "IFD0:ImageDescription", 0, '{"shape": [3, 4]}'), (5, "IFD0:ImageDescription", 0, '{"shape": [3, 4]}'), (5, "IPTC:DateCreated", 0, "0000"),
        (5, "ExifIFD:DateTimeOriginal", 0, "1950:06:01"), (6, "IPTC:City", 0, "x"), (7, "IPTC:Keywords", 0, "k"), (8, "IPTC:City", 0, None), (9, "IPTC:CodedCharacterSet", 0, "UTF8"),
    ]
    tags = spark.createDataFrame(rows, TAGS)
    whole = normalize.normalize_fields(tags)
    for part in (["date"], ["city", "digitized"]):
        got = normalize.normalize_fields(tags, part)
        assert set(got.columns) == {"photo_id", *part, *[f + "_tag" for f in part]}
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.select(got.columns).collect()), key=repr)


def test_a_part_of_the_fields_without_the_other_photos(spark):
    rows = [(1, "XMP-dc:Title", 0, "a"), (1, "IPTC:City", 0, "x"), (2, "IPTC:City", 0, "y"), (3, "XMP-dc:Title", 0, " "), (4, "IPTC:Keywords", 0, "k")]
    tags = spark.createDataFrame(rows, TAGS)
    assert sorted(map(tuple, normalize.normalize_fields(tags, ["title"]).collect())) == [(1, "a", "XMP-dc:Title"), (2, None, None)]
    assert list(map(tuple, normalize.normalize_fields(tags, ["title"], all_photos=False).collect())) == [(1, "a", "XMP-dc:Title")]
