"""Files written and read back, and streams against their batch forms."""

import json

from pyspark.sql import functions as F

from photocat.sources import files


def test_inventory(spark, tmp_path):
    for name in ("b.TIF", "A.jpg", "note.txt", ".hidden.jpg", "sub/c.png", "_originals/d.tif", "kept/e.tif", "kept/.backups-here"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 3)
    flat = files.sorted_by_name(files.scan_inventory(spark, str(tmp_path)))
    assert [r.name for r in flat.collect()] == ["A.jpg", "b.TIF"]
    # file bodies are never read
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in flat._jdf.queryExecution().executedPlan().toString()
    deep = files.scan_inventory(spark, str(tmp_path), recursive=True)
    marker = deep.where("name LIKE 'kept/%'").select(F.regexp_replace("path", "[^/]*$", ".backups-here").alias("path"))
    kept = files.skip_managed_paths(deep, {}, marker)
    assert sorted(r.name for r in kept.collect()) == ["A.jpg", "b.TIF", "sub/c.png"]


def test_tag_dump_keeps_number_text(spark, tmp_path):
    doc = {"SourceFile": "/a/1.tif", "A:S": "say \"1.50\", ok", "B:L": ["x", "y"], "C:D": {"W": 2}}
    line = json.dumps(doc)[:-1] + ', "D:N": 1.50, "E:M": -3, "F:L": [1.0, "2.00"]}'
    (tmp_path / "t.json").write_text(line + "\n")
    got = {(r.tag, r.item): r.value for r in files.read_tag_dump(spark, str(tmp_path)).collect()}
    assert got["D:N", 0] == "1.50" and got["E:M", 0] == "-3" and got["F:L", 0] == "1.0" and got["F:L", 1] == "2.00"
    assert got["A:S", 0] == 'say "1.50", ok' and got["B:L", 1] == "y" and ("SourceFile", 0) not in got


def test_log_and_report(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq": 1, "time": "2024-01-01T10:00:00", "ok": true}\nnot json\n{"seq": 2, "time": "2024-01-02T10:00:00"}\n')
    assert [r.seq for r in files.read_job_log(spark, str(tmp_path / "log.json")).collect()] == [2, 1]
    assert [r.seq for r in files.read_job_log(spark, str(tmp_path / "log.json"), 1).collect()] == [2]
    rep = spark.createDataFrame([("=1+1", "-x", "ok", 3)], "a string, b string, c string, n int")
    out = str(tmp_path / "csv")
    files.export_report_csv(rep, out)
    assert tuple(spark.read.option("header", True).csv(out).first()) == ("'=1+1", "'-x", "ok", "3")


def test_drafts(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"path": "/a", "updated": 5.0, "state": {"x": 1}}\n{"path": "/b", "updated": 9.0}\n{"path": "/c"}\n{"updated": 1}\n')
    assert [r.path for r in files.read_drafts(spark, str(tmp_path)).collect()] == ["/b", "/a", "/c"]


def test_text_that_looks_like_a_list_stays_text(spark):
    doc = json.dumps({"A:x": "[1]", "A:q": '["x"]', "A:l": ["a", "b"], "A:s": {"k": 3}, "A:t": True, "A:z": None, "A:e": [], "A:m": ["1", {"k": 2}]})[:-1] + ', "A:n": 1.50, "A:r": [1.0, 20]}'
    docs = spark.createDataFrame([(1, doc), (2, "no json"), (3, '{"A:x": 1, "A:x": 2}'), (4, None)], "photo_id long, doc string")
    got = sorted((r.photo_id, r.tag, r.item, r.value) for r in files.tags_of(docs).where("value is not null").collect())
    assert got == sorted([
        (1, "A:x", 0, "[1]"), (1, "A:q", 0, '["x"]'), (1, "A:l", 0, "a"), (1, "A:l", 1, "b"), (1, "A:s", 0, '{"k":"3"}'), (1, "A:t", 0, "true"),
        (1, "A:n", 0, "1.50"), (1, "A:r", 0, "1.0"), (1, "A:r", 1, "20"), (1, "A:m", 0, "1"), (1, "A:m", 1, '{"k":"2"}'), (3, "A:x", 0, "1"), (3, "A:x", 0, "2"),
    ])


def test_log_rolls_by_size_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(k, f"2024-01-0{1 + k % 3} 10:{k // 60 % 60:02}:{k % 60:02}", k % 5 != 0, f"/a/{k}.tif", "n" * (k % 40)) for k in range(900)] + [(900, None, True, "/a/none.tif", "")]
    log = spark.createDataFrame(rows, "seq long, t string, ok boolean, source string, notes string").select("seq", F.to_timestamp_ntz("t").alias("time"), "ok", "source", "notes")
    files.write_job_log(log.where("seq < 600 or seq = 900"), path, 4000)
    files.write_job_log(log.where("seq between 600 and 899"), path, 4000)
    rolls = {(r.day, r.roll): r.bytes for r in files.log_rolls(spark, path).collect()}
    assert max(rolls.values()) < 4000 + 200 and len(rolls) > 15 and {d for d, _ in rolls} == {"2024-01-01", "2024-01-02", "2024-01-03", "none"}
    # rolls follow the order of time inside a day
    seqs = {}
    for r in spark.read.text(path).select("day", "roll", F.get_json_object("value", "$.seq").cast("long").alias("seq")).collect():
        seqs.setdefault((str(r.day), r.roll), []).append(r.seq)
    for (day, roll), mine in seqs.items():
        later = [min(v) for (d, n), v in seqs.items() if d == day and n[:8] == roll[:8] and n > roll]
        assert all(max(mine) < x for x in later)
    got = files.read_job_log(spark, path).select("seq", "ok", "source", "notes").collect()
    assert sorted(map(tuple, got)) == sorted((s, ok, src, n) for s, t, ok, src, n in rows if t)
    assert files.read_job_log(spark, path, 2).count() == 2
    gone = files.drop_old_rolls(spark, path, 12_000)
    left = {r.day: r.bytes for r in files.log_rolls(spark, path).collect()}
    assert gone > 5 and sum(left.values()) <= 12_000


def test_report_round_trip(spark, tmp_path):
    rows = [(1, "", 'say "x",\nand y', None), (2, None, "=sum(1)", 4), (3, " a ", "'", 5)]
    df = spark.createDataFrame(rows, "k int, a string, b string, n int")
    files.export_report_csv(df, str(tmp_path / "r"))
    back = files.read_report_csv(spark, str(tmp_path / "r"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(1, "", 'say "x",\nand y', None), (2, None, "'=sum(1)", 4), (3, " a ", "'", 5)], key=str)


def test_a_rolled_log_is_listed_by_one_job(spark, tmp_path):
    path, sc = str(tmp_path / "log"), spark.sparkContext
    log = spark.range(400).selectExpr("id AS seq", "cast(timestamp_millis(1700000000000 + id * 600000) AS timestamp_ntz) AS time", "true AS ok", "repeat('x', 100) AS source")
    files.write_job_log(log, path, 300)
    for read, rows in ((files.log_rolls, 100), (files.read_job_log, 400)):
        sc.setJobGroup(f"list {read.__name__}", "listing")
        df = read(spark, path)
        jobs = sc.statusTracker().getJobIdsForGroup(f"list {read.__name__}")
        sc.setJobGroup("rest", "rest")
        # before: a job for each of the days, with a task for each roll
        assert len(jobs) == 1 and df.count() >= rows
