"""Registered batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from photocat.functions import fixed_values as fixed
from photocat.operators import batches, identity, text_blocks
from photocat.plans.q_blocks import SCORE, decided
from photocat.plans.registry import query
from photocat.plans.views import load

R = batches.REASON
POLICY = {"caseB": "rebuild", "caseC": "erase", "saveMode": "overwrite"}


def _analysis(spark, sf):
    a = identity.classify_provenance(decided(spark, sf))
    edge = text_blocks.edge_confidence(F.col("has_marker"), F.col("case"), F.col("edge_confidence"))
    return a.withColumns({"edge_confidence": edge, "weak": F.col("min_line_confidence") < 0.6})


DAMAGED = "(?i)unsupported file type|cannot identify|not a (valid|supported)|truncated|corrupt|damaged|unexpected end|premature end|decod|invalid (tiff|jpeg|png)|not an image"
ERR = f"CASE WHEN size_bytes = 0 THEN 'Empty file' WHEN regexp_matches(coalesce(error, ''), '{DAMAGED}') THEN 'Can''t read this file (damaged or not an image)' ELSE coalesce(error, 'Can''t read this file') END"
PLAN = (
    SCORE
    + """, pv AS (SELECT *, CASE WHEN coalesce(save_mode, CASE WHEN payload_mode = 'copy' THEN 'copy' END) = 'copy' THEN 'copy' WHEN save_mode = 'overwrite' THEN 'in place'
   WHEN has_record AND has_original THEN 'in place' WHEN has_record OR has_payload OR has_marker THEN 'unknown' ELSE 'not ours' END AS prov,
   CASE WHEN has_marker THEN 1.0 WHEN "case" IN ('B', 'C') THEN edge_confidence ELSE 0.0 END AS edge FROM dc),
 ac AS (SELECT *, CASE WHEN "case" IN ('A', 'B') THEN 'rebuild' WHEN "case" = 'C' THEN 'erase' ELSE 'band' END AS base FROM pv),
 rf AS (SELECT *, coalesce(uses_draft AND "case" = 'C' AND NOT draft_erases, false) AS refused, prov IN ('copy', 'unknown') AS ours FROM ac),
 fd AS (SELECT *, concat_ws('; ', CASE WHEN "case" IN ('B', 'C') AND edge < 0.6 THEN '%(edge)s' END, CASE WHEN "case" = 'D' THEN '%(over)s' END,
    CASE WHEN uses_draft AND dropped_faces > 0 THEN dropped_faces || ' face edit' || CASE WHEN dropped_faces > 1 THEN 's' ELSE '' END || ' left out: the faces changed in the file' END,
    CASE WHEN refused THEN '%(refused)s' END, CASE WHEN NOT ours AND NOT refused AND names_missing THEN '%(names)s' END,
    CASE WHEN NOT ours AND NOT refused AND min_line_confidence < 0.6 THEN '%(weak)s' END) AS found FROM rf),
 plan AS (SELECT photo_id, path, CASE WHEN NOT readable THEN 'error' WHEN unsupported OR pages > 1 THEN 'blocked' WHEN ours OR refused THEN 'skipped' WHEN found <> '' THEN 'flagged' ELSE 'ready' END AS status,
   CASE WHEN NOT readable OR unsupported OR pages > 1 THEN 'band' WHEN ours OR refused THEN 'skip' ELSE base END AS action,
   CASE WHEN NOT readable THEN {err} WHEN unsupported THEN '%(unsupported)s' WHEN pages > 1 THEN '%(multi)s' WHEN prov = 'copy' THEN '%(copy)s' WHEN prov = 'unknown' THEN '%(maybe_copy)s' ELSE found END AS reasons,
   coalesce(readable AND NOT unsupported AND pages <= 1 AND "case" = 'C' AND NOT ours AND NOT refused AND CASE WHEN uses_draft THEN draft_erases ELSE true END, false) AS on_copy, "case" FROM fd)""".replace("{err}", ERR) % R
)


def _plan(spark, sf):
    return batches.plan_batch(_analysis(spark, sf), POLICY)


@query("b1_plan_batch", "analysis", PLAN + " SELECT photo_id, path, status, action, reasons, on_copy FROM plan")
def _(spark, sf):
    return _plan(spark, sf).withColumn("reasons", F.array_join("reasons", "; "))


@query("b2_select_photos", "analysis", PLAN + """ SELECT photo_id FROM plan WHERE "case" IS NULL OR "case" = 'D'""")
def _(spark, sf):
    return batches.select_photos(_analysis(spark, sf), "uncaptioned").select("photo_id")


@query("b3_friendly_error", "analysis", f"SELECT photo_id, {ERR} AS error_class FROM analysis")
def _(spark, sf):
    return load(spark, sf, "analysis").select("photo_id", batches.friendly_error(F.col("error"), F.col("size_bytes")).alias("error_class"))


@query("b4_plan_counts", "analysis", PLAN + " SELECT status, count(*) AS photos FROM plan GROUP BY status")
def _(spark, sf):
    return batches.plan_counts(_plan(spark, sf))


@query(
    "b5_save_and_held_list",
    "analysis",
    PLAN
    + """ SELECT photo_id, 'save' AS list FROM plan WHERE status = 'ready' OR (status = 'flagged' AND photo_id % 2 = 0)
 UNION ALL SELECT photo_id, 'held' FROM plan WHERE status = 'flagged' AND photo_id % 2 <> 0""",
)
def _(spark, sf):
    p = _plan(spark, sf).withColumn("reviewed", F.col("photo_id") % 2 == 0)
    save = batches.save_list(p).select("photo_id", F.lit("save").alias("list"))
    return save.unionByName(batches.held_list(p).select("photo_id", F.lit("held").alias("list")))


@query(
    "b6_journal_unsaved",
    "analysis",
    PLAN
    + """, n AS (SELECT photo_id % 7 AS batch_id, count(*) AS n FROM plan WHERE status = 'ready' GROUP BY 1)
 SELECT p.photo_id % 7 AS batch_id, coalesce(n.n, 0) + row_number() OVER (PARTITION BY p.photo_id % 7 ORDER BY p.photo_id) - 1 AS idx, path,
   CASE status WHEN 'error' THEN 'blocked' WHEN 'flagged' THEN 'held' ELSE status END AS state, reasons AS error
 FROM plan p LEFT JOIN n ON n.batch_id = p.photo_id % 7 WHERE status <> 'ready'""",
)
def _(spark, sf):
    p = _plan(spark, sf).withColumns({"batch_id": F.col("photo_id") % 7, "plan_no": F.col("photo_id")})
    saved = p.where("status = 'ready'").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return batches.journal_unsaved(p.where("status <> 'ready'"), saved)


ENTRIES = """, en AS (SELECT batch_id, idx, arg_max(state, seq_at) AS state, arg_min(path, CASE WHEN path IS NOT NULL THEN seq_at END) AS path,
   arg_max(out_path, CASE WHEN out_path IS NOT NULL THEN seq_at END) AS out_path, arg_max(backup, CASE WHEN backup IS NOT NULL THEN seq_at END) AS backup,
   arg_max(coalesce(error, ''), seq_at) AS error FROM (SELECT *, row(ts, seq) AS seq_at FROM journal) AS j GROUP BY batch_id, idx)"""


def _entries(spark, sf):
    return batches.current_state(load(spark, sf, "journal"))


@query("b7_current_state", "journal", ENTRIES + " SELECT batch_id, idx, state, path, out_path, backup, nullif(error, '') AS error FROM en")
def _(spark, sf):
    return _entries(spark, sf).select("batch_id", "idx", "state", "path", "out_path", "backup", "error")


@query(
    "b7_result_state",
    "",
    "SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'click' THEN 'changed' ELSE 'failed' END AS state FROM events",
)
def _(spark, sf):
    e = load(spark, sf, "events")
    code = F.when(F.col("event_type") == "click", "changed").otherwise("exists")
    return e.select(F.col("event_id").alias("seq"), batches.result_state(F.col("event_type") == "purchase", code).alias("state"))


EXPECTED = """, ex AS (SELECT batch_id, 15 + batch_id % 20 AS expected FROM journal GROUP BY batch_id),
 jb AS (SELECT DISTINCT batch_id, idx FROM journal WHERE state = 'running' AND ms > 50)"""


def _expected(spark, sf):
    j = load(spark, sf, "journal")
    expected = j.select("batch_id").distinct().withColumn("expected", 15 + F.col("batch_id") % 20)
    return expected, j.where("state = 'running' AND ms > 50").select("batch_id", "idx")


_COUNT = ", ".join(f"count(CASE WHEN state = '{s}' THEN 1 END) AS {s}" for s in ("done", "failed", "cancelled", "running", "staged"))


@query(
    "b8_batch_summary",
    "journal",
    ENTRIES
    + EXPECTED
    + f""", r AS (SELECT e.*, state <> 'restored' AND (backup IS NOT NULL OR (state IN ('failed', 'changed', 'cancelled') AND j.idx IS NOT NULL)) AS can FROM en e
   LEFT JOIN jb j ON j.batch_id = e.batch_id AND j.idx = e.idx)
 SELECT r.batch_id, count(*) AS entries, {_COUNT}, max(ex.expected) AS expected, count(CASE WHEN can THEN 1 END) AS restorable, count(CASE WHEN can THEN 1 END) > 0 AS can_restore
 FROM r JOIN ex ON ex.batch_id = r.batch_id GROUP BY r.batch_id""",
)
def _(spark, sf):
    return batches.batch_summary(_entries(spark, sf), *_expected(spark, sf))


_TERMINAL = ", ".join(f"'{s}'" for s in fixed.TERMINAL_STATES + ["restored"])


@query(
    "b9_incomplete_batches",
    "journal",
    ENTRIES
    + EXPECTED
    + f""", o AS (SELECT batch_id, count(CASE WHEN state NOT IN ({_TERMINAL}) THEN 1 END) AS open, count(*) AS n FROM en GROUP BY batch_id),
 p AS (SELECT ex.batch_id, expected AS total, greatest(0, expected - n) AS missing, open + greatest(0, expected - n) AS pending FROM ex JOIN o ON o.batch_id = ex.batch_id)
 SELECT batch_id, total, missing, pending FROM p WHERE pending > 0""",
)
def _(spark, sf):
    return batches.incomplete_batches(_entries(spark, sf), _expected(spark, sf)[0])


@query(
    "b10_batch_report",
    "journal",
    ENTRIES
    + """, pl AS (SELECT batch_id, path, max(CASE WHEN idx % 3 = 0 THEN 'rebuild' ELSE 'band' END) AS action FROM en WHERE path IS NOT NULL GROUP BY batch_id, path)
 SELECT e.batch_id, idx, coalesce(e.path, '') AS file, coalesce(CASE WHEN starts_with(e.path, '/archive/') THEN substr(e.path, 10) ELSE e.path END, '') AS relative, state,
   coalesce(action, '') AS action, coalesce(out_path, '') AS output, coalesce(backup, '') AS backup, error, CASE WHEN idx % 4 = 0 THEN 'resized | profile kept' WHEN idx % 4 = 1 THEN 'resized' ELSE '' END AS notes FROM en e LEFT JOIN pl ON pl.batch_id = e.batch_id AND pl.path = e.path""",
)
def _(spark, sf):
    e = _entries(spark, sf)
    plan = e.where("path IS NOT NULL").select("batch_id", "path", F.when(F.col("idx") % 3 == 0, "rebuild").otherwise("band").alias("action"))
    few, one = F.array(F.lit("resized"), F.lit("profile kept")), F.array(F.lit("resized"))
    notes = F.when(F.col("idx") % 4 == 0, few).when(F.col("idx") % 4 == 1, one).when(F.col("idx") % 4 == 2, F.array().cast("array<string>"))
    return batches.batch_report(e.withColumn("notes", notes), plan, "/archive/")


@query(
    "b11_guard_planned_paths",
    "journal",
    """, planned AS (SELECT DISTINCT batch_id, path FROM journal WHERE state = 'staged')
 SELECT seq, batch_id, path FROM journal j WHERE state = 'done' AND EXISTS (SELECT 1 FROM planned p WHERE p.batch_id = j.batch_id AND p.path = j.path)""",
)
def _(spark, sf):
    j = load(spark, sf, "journal")
    return batches.guard_planned_paths(j.where("state = 'done'"), j.where("state = 'staged'")).select("seq", "batch_id", "path")


RESTORE = (
    ENTRIES
    + """, bk AS (SELECT DISTINCT backup, CASE WHEN length(backup) % 2 = 0 THEN 0 ELSE 5000 END AS size_bytes, 'k' || (length(backup) % 3) AS content_hash FROM en WHERE backup IS NOT NULL),
 nw AS (SELECT DISTINCT path, 4000 + 1000 * (idx % 3) AS size_bytes, 7 AS mtime_ns, 'k' || (idx % 4) AS content_hash FROM en WHERE path IS NOT NULL AND idx % 5 <> 0),
 pn AS (SELECT DISTINCT batch_id, path FROM journal WHERE path IS NOT NULL AND idx % 7 <> 0),
 j AS (SELECT e.batch_id, e.idx, e.path, b.size_bytes AS bs, b.content_hash AS bh, n.size_bytes AS ns, n.content_hash AS nh, p.path IS NOT NULL AS planned,
     coalesce(n.size_bytes = 4000 + 1000 * (e.idx % 2) AND n.content_hash = 'k' || (e.idx % 4), false) AS as_written
   FROM en e LEFT JOIN bk b ON b.backup = e.backup LEFT JOIN nw n ON n.path = e.path LEFT JOIN pn p ON p.batch_id = e.batch_id AND p.path = e.path WHERE e.backup IS NOT NULL),
 rs AS (SELECT *, ns IS NOT NULL AND NOT as_written AS edited FROM j),
 rp AS (SELECT batch_id, idx, path, CASE WHEN NOT planned THEN 'error' WHEN coalesce(bs, 0) = 0 THEN 'missing-backup' WHEN ns = bs AND nh = bh THEN 'unchanged' WHEN edited THEN 'skipped-edited'
   ELSE 'restored' END AS result, false AS keep_aside FROM rs)"""
)


def _restore(spark, sf):
    e = _entries(spark, sf)
    n = F.length("backup")
    bk = e.where("backup IS NOT NULL").select(
        "backup", F.when(n % 2 == 0, 0).otherwise(5000).alias("size_bytes"), F.concat(F.lit("k"), (n % 3).cast("string")).alias("content_hash")
    ).distinct()
    i = F.col("idx")
    now = e.where("path IS NOT NULL AND idx % 5 <> 0").select(
        "path", (4000 + 1000 * (i % 3)).alias("size_bytes"), F.lit(7).alias("mtime_ns"), F.concat(F.lit("k"), (i % 4).cast("string")).alias("content_hash")
    ).distinct()
    planned = load(spark, sf, "journal").where("path IS NOT NULL AND idx % 7 <> 0").select("batch_id", "path")
    e = e.withColumns({"out_size": 4000 + 1000 * (i % 2), "out_mtime": F.lit(7), "out_hash": F.concat(F.lit("k"), (i % 4).cast("string")), "ours": F.lit(False)})
    return batches.plan_restore(e, planned, bk, now)


@query("b12_plan_restore", "journal", RESTORE + " SELECT batch_id, idx, path, result, keep_aside FROM rp")
def _(spark, sf):
    return _restore(spark, sf)


@query(
    "b12_restore_totals",
    "journal",
    RESTORE + " SELECT batch_id, result, count(*) AS photos, cast(grouping(batch_id, result) AS bigint) AS level FROM rp GROUP BY ROLLUP (batch_id, result)",
)
def _(spark, sf):
    return batches.restore_totals(_restore(spark, sf))


@query(
    "b13_requeue_failed",
    "journal",
    ENTRIES
    + """ SELECT batch_id, idx, 'retry' AS state, '' AS error FROM en e WHERE state IN ('failed', 'cancelled')
   AND EXISTS (SELECT 1 FROM journal j WHERE j.batch_id = e.batch_id AND j.idx = e.idx AND j.state = 'staged')""",
)
def _(spark, sf):
    return batches.requeue_failed(_entries(spark, sf), load(spark, sf, "journal").where("state = 'staged'"))


@query(
    "b14_adopt_finished",
    "journal",
    ENTRIES
    + """, o AS (SELECT batch_id || ':' || idx AS job_id, max(out_path) AS out_path FROM journal WHERE state = 'done' AND ms > 20 GROUP BY 1)
 SELECT e.batch_id, e.idx, 'done' AS state, o.out_path FROM en e JOIN o ON o.job_id = e.batch_id || ':' || e.idx WHERE e.state IN ('running', 'failed')""",
)
def _(spark, sf):
    outputs = load(spark, sf, "journal").where("state = 'done' AND ms > 20").select(F.concat_ws(":", "batch_id", "idx").alias("job_id"), "out_path")
    return batches.adopt_finished(_entries(spark, sf), outputs)


@query(
    "b15_compare_plans",
    "analysis",
    PLAN
    + """, o AS (SELECT photo_id, status, action, photo_id % 11 = 0 AS edited FROM plan WHERE status IN ('ready', 'flagged')),
 n AS (SELECT photo_id, CASE WHEN photo_id % 5 = 0 THEN 'blocked' ELSE status END AS status, CASE WHEN photo_id % 3 = 0 THEN 'skip' ELSE action END AS action, reasons
   FROM plan WHERE photo_id % 13 <> 0),
 r AS (SELECT coalesce(o.photo_id, n.photo_id) AS idx, CASE WHEN o.status IS NULL THEN 'Not prepared before the batch stopped' WHEN edited THEN 'Edited in review but not prepared'
   WHEN n.status IS NULL THEN 'Could not be prepared again' WHEN NOT (n.status IN ('ready', 'flagged') AND o.action = n.action) THEN 'Changed since it was checked ('
     || CASE WHEN n.status IN ('ready', 'flagged') THEN 'now it would ' || CASE WHEN n.action = 'skip' THEN 'be skipped' ELSE n.action END
        ELSE n.status || CASE WHEN reasons <> '' THEN ': ' || reasons ELSE '' END END || ')' ELSE '' END AS reason FROM o FULL JOIN n ON n.photo_id = o.photo_id)
 SELECT idx, CASE WHEN reason = '' THEN 'stage' ELSE 'notPrepared' END AS outcome, reason FROM r""",
)
def _(spark, sf):
    p = _plan(spark, sf).withColumns({"batch_id": F.lit(1), "idx": F.col("photo_id")})
    old = p.where("status IN ('ready', 'flagged')").select("batch_id", "idx", "status", "action", (F.col("idx") % 11 == 0).alias("edited"))
    new = p.where("idx % 13 <> 0").withColumns({
        "status": F.when(F.col("idx") % 5 == 0, "blocked").otherwise(F.col("status")),
        "action": F.when(F.col("idx") % 3 == 0, "skip").otherwise(F.col("action")),
    })
    return batches.compare_plans(old, new).select("idx", "outcome", "reason")


@query(
    "b16_exclude_entries",
    "journal",
    ENTRIES
    + """, rq AS (SELECT DISTINCT batch_id, idx, 'excluded' AS state, 'left out' AS reason FROM journal WHERE ms > 30)
 SELECT r.* FROM rq r WHERE NOT EXISTS (SELECT 1 FROM en e WHERE e.batch_id = r.batch_id AND e.idx = r.idx
   AND (state IN ('done', 'running', 'restored') OR out_path IS NOT NULL OR backup IS NOT NULL))""",
)
def _(spark, sf):
    rq = load(spark, sf, "journal").where("ms > 30").select("batch_id", "idx", F.lit("excluded").alias("state"), F.lit("left out").alias("reason")).distinct()
    return batches.exclude_entries(rq, _entries(spark, sf))


@query(
    "b17_folders_touched",
    "journal",
    ENTRIES
    + """ SELECT DISTINCT batch_id, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder FROM (SELECT batch_id, path AS p FROM en UNION ALL SELECT batch_id, out_path FROM en
   UNION ALL SELECT batch_id, backup FROM en) AS u WHERE p IS NOT NULL""",
)
def _(spark, sf):
    return batches.folders_touched(_entries(spark, sf))
