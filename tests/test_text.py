"""Text rules, caption templates and edit checks on small inputs."""

import random

from pyspark.sql import functions as F

from photocat.functions import captions, text
from photocat.functions.captions import group, lit, tok
from photocat.operators import edits, identity, normalize, text_blocks


def values(spark, items, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string").select("i", expr.alias("out"))
    return [r.out for r in df.orderBy("i").collect()]


def test_truncation(spark):
    v = ["Two boys on a dock in summer", "Two boys", "ab\ncdefghijklmnop", "aaaaaaaaaaaaaaaaaaaaaaaa", "one two three  four"]
    want = ["Two boys on a…", "Two boys", "ab\ncdefghijkl…", "aaaaaaaaaaaaa…", "one two three…"]
    assert values(spark, v[:4], text.truncate_words(F.col("v"), 14)) == want[:4]
    assert values(spark, [v[4]], text.truncate_words(F.col("v"), 15)) == want[4:]
    assert values(spark, ["xyz"], text.truncate_words(F.col("v"), 1)) == ["x"]


def test_lines_left_blank_go(spark):
    m = text.EMPTY_MARK
    cases = {f"a\n{m}\nb": "a\nb", "a\n\nb": "a\n\nb", f"a\n\n{m}\n\nb": "a\n\nb", f"{m}\n\na": "a", f"a {m} b": "a  b", f"{m} - a": "- a", f"a\n{m}\n": "a"}
    assert values(spark, list(cases), text.tidy_lines(F.col("v"))) == list(cases.values())


def test_templates(spark):
    rows = [("Picnic", "Oslo", ""), ("", "Oslo", "*Ann*"), ("Picnic", "", "")]
    df = spark.createDataFrame(rows, "title string, city string, names string")
    t = [tok("title"), group(lit(" ("), tok("city"), lit(")")), lit("\n"), tok("names")]
    assert [r.c for r in df.select(captions.caption(t).alias("c")).collect()] == ["Picnic (Oslo)", "(Oslo)\n*Ann*", "Picnic"]
    assert captions.only_optional(t, "city") and not captions.only_optional(t, "names")


def test_file_names(spark):
    cases = {
        'a<b>:"/\\|?*c': "a_b________c", " .a. ": "a", "con": "_con", "CON.txt": "_CON.txt", "com¹": "_com¹", "console": "console", "": "stem",
        "a\nb‎\u0085": "a b", "é" * 150: "é" * 100, "a" * 199 + "é": "a" * 199,
    }
    assert values(spark, list(cases), text.safe_file_name(F.col("v"), F.lit("stem"))) == list(cases.values())


def test_keyword_prefixes_end_at_words(spark):
    v = ["Scan 2024", "Scandinavia", "scan", "Scan|Negatives", "scań", "rescan"]
    assert values(spark, v, text.starts_with_any(F.col("v"), ["scan"])) == [True, False, True, True, False, False]


def test_wrongly_decoded_text(spark):
    v = ["CafÃ©", "Café", "plain", "â‚¬5", "naïve Ã©"]
    assert values(spark, v, text.repair_mojibake(F.col("v"))) == ["Café", "Café", "plain", "€5", "naïve Ã©"]


def test_source_key_is_the_same_for_both_spellings_of_an_accent(spark):
    df = spark.createDataFrame([("/a/Café.tif",), ("/a/Café.tif",), ("/a/b.tif",)], "path string")
    keys = {r.path: r.source_key for r in normalize.add_source_key(df).collect()}
    assert keys["/a/Café.tif"] == keys["/a/Café.tif"] and len(set(keys.values())) == 2 and len(keys["/a/b.tif"]) == 24


def test_glyphs(spark):
    assert values(spark, ["A.", "J.R.W.", "'71", "বাংলা", "|", "-.-", ""], text.glyphs(F.col("v"))) == [1, 3, 2, 2, 0, 0, 0]


def test_a_value_too_long_for_a_tag(spark):
    tags = spark.createDataFrame([(1, "IPTC:City", 0, "Old"), (1, "XMP-photoshop:City", 0, "Old")], "photo_id long, tag string, item long, value string")
    latest = spark.createDataFrame([(1, "city", "x" * 40)], "photo_id long, field string, value string")
    fields = spark.createDataFrame([(1, *["Old"] * 8)], "photo_id long, title string, caption string, notes string, creator string, sublocation string, city string, state string, country string")
    got = {r.tag: (r.action, r.note != "") for r in edits.mirror_fields(latest, tags, fields).collect()}
    assert got == {"XMP-photoshop:City": ("set", False), "IPTC:City": ("delete", True)}


def test_mirrored_fields_meet_before_they_are_spread_over_tags(spark):
    tags = spark.createDataFrame(
        [(1, "IPTC:CodedCharacterSet", 0, "UTF8"), (1, "IPTC:ObjectName", 1, "b"), (1, "IPTC:ObjectName", 0, "a"), (1, "IFD1:XPTitle", 0, ""), (1, "XMP-photoshop:Headline", 0, " Old  title"),
         (2, "IPTC:ObjectName", 0, "a"), (2, "XMP-photoshop:Headline", 0, "other"), (2, "XMP-dc:Title", 0, None), (3, "XMP-dc:Creator", 0, "x"), (None, "IPTC:City", 0, "y")],
        "photo_id long, tag string, item long, value string",
    )
    latest = spark.createDataFrame([(1, "title", "名"), (2, "title", "名"), (3, "creator", None), (3, "date", "1952"), (None, "city", "z"), (4, "state", " ")], "photo_id long, field string, value string")
    fields = spark.createDataFrame([(1, "Old title", *[None] * 7), (2, "Old title", *[None] * 7)], "photo_id long, title string, caption string, notes string, creator string, sublocation string, city string, state string, country string")
    out = edits.mirror_fields(latest, tags, fields)
    assert {(r.photo_id, r.tag): (r.action, r.value, r.note != "") for r in out.collect()} == {
        (1, "XMP-dc:Title"): ("set", "名", False), (1, "IPTC:ObjectName"): ("set", "名", False), (1, "IFD1:XPTitle"): ("set", "名", False), (1, "XMP-photoshop:Headline"): ("set", "名", False),
        (2, "XMP-dc:Title"): ("set", "名", False), (2, "IPTC:ObjectName"): ("delete", None, True),
        (3, "XMP-dc:Creator"): ("delete", None, False), (None, "XMP-photoshop:City"): ("set", "z", False),
    }
    # before, the rows spread over tags were shuffled by photo and tag, by photo, and by photo and field
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = edits.mirror_fields(latest, tags, fields)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = {line.split("hashpartitioning(")[1].split(", ENSURE")[0].count("#") for line in plan.split("\n") if "Exchange hashpartitioning" in line}
    assert keys == {2} and plan.count("Exchange hashpartitioning") == 3 and plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")


def test_fingerprint_windows(spark):
    import hashlib

    rows = [(i, bytes(random.Random(i).randbytes(n))) for i, n in enumerate((5, 10, 15, 20, 21, 50))]
    df = spark.createDataFrame(rows, "i int, c binary")
    got = {r.i: r.f for r in df.select("i", identity.quick_fingerprint(F.col("c"), F.octet_length("c"), 10).alias("f")).collect()}
    for i, b in rows:
        tail = b[-10:] if len(b) > 20 else b[10:]
        assert got[i] == hashlib.sha256(f"{len(b)}|".encode() + b[:10] + tail).hexdigest()[:32]


def test_text_blocks_against_a_plain_computation(spark):
    rnd = random.Random(4)
    lines = [(p, i, float(rnd.randrange(600)), float(rnd.randrange(900)), float(rnd.randrange(20, 200)), float(rnd.choice([6, 9, 14, 30, 70]))) for p in range(3) for i in range(120)]

    def linked(a, b):
        v = max(a[3], b[3]) - min(a[3] + a[5], b[3] + b[5])
        h = max(a[2], b[2]) - min(a[2] + a[4], b[2] + b[4])
        tall, low = max(a[5], b[5]), min(a[5], b[5])
        return (v <= tall and h <= 2 * tall and v > -0.5 * low) or (-v >= 0.5 * low and abs(a[3] + a[5] - b[3] - b[5]) <= 0.2 * tall and h <= 3.75 * low)

    root = {(a[0], a[1]): a[1] for a in lines}
    changed = True
    while changed:
        changed = False
        for a in lines:
            for b in lines:
                if a[0] == b[0] and a[1] != b[1] and linked(a, b) and root[a[0], a[1]] > root[b[0], b[1]]:
                    root[a[0], a[1]] = root[b[0], b[1]]
                    changed = True
    df = spark.createDataFrame(lines, "photo_id long, line_no long, x double, y double, w double, h double")
    got = {(r.photo_id, r.line_no): r.block for r in text_blocks.group_text_blocks(df).collect()}
    assert got == root
