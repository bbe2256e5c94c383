"""Planning a batch over many photos, and its journal.

``journal`` is an event table (batch_id, idx, ts, seq, state, path, out_path, backup, error); the
state of an entry is an aggregate over its events.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.functions import fixed_values as fixed
from photocat.functions import text
from photocat.functions.dates import let
from photocat.functions.groups import ordered_positions

# Fixed: what a batch does unless told otherwise.
POLICY = {
    "which": "all", "saveMode": "copy", "caseA": "recaption", "caseB": "skip", "caseC": "skip", "warnings": "hold",
    "allowMultipage": False, "allowOverwriteHandwritten": False,
}
REASON = fixed.BATCH_REASONS


def friendly_error(error: Column, size: Column) -> Column:
    """A readable class of a read error; any other error text stands for itself."""
    said = F.lower(F.coalesce(error, F.lit("")))
    says = lambda phrases: reduce(operator.or_, [said.contains(p) for p in phrases])
    return (
        F.when((F.coalesce(size, F.lit(-1)) == 0) | says(fixed.EMPTY_FILE_PHRASES), "Empty file")
        .when(says(fixed.DAMAGED_FILE_PHRASES), "Can't read this file (damaged or not an image)")
        .when(said == "", "Can't read this file")
        .otherwise(error)
    )


def plan_batch(analysis: DataFrame, policy: dict | None = None) -> DataFrame:
    """(photo_id, path, status, action, reasons, on_copy) for analyzed photos.

    Needs readable, error, size_bytes, unsupported, pages, provenance, case, edge_confidence,
    uses_draft, draft_erases, dropped_faces, names_missing and weak. The policy is a handful of
    settings, so it is folded into the expressions; the plan is one projection."""
    p = {**POLICY, **(policy or {})}
    only_new = p["which"] == "uncaptioned"
    skip_a, skip_b, skip_c = (p[c] == "skip" or only_new for c in ("caseA", "caseB", "caseC"))
    overwrite = p["saveMode"] == "overwrite"
    refuses = F.lit(overwrite and not p["allowOverwriteHandwritten"])
    stop = (
        F.when(~F.col("readable"), "error")
        .when(F.col("unsupported"), "unsupported")
        .when((F.col("pages") > 1) & F.lit(not p["allowMultipage"]), "multi")
        .when(F.col("provenance") == "copy", "copy")
        .when(F.col("provenance") == "unknown", "maybe_copy")
    )
    erases, n = F.coalesce(F.col("draft_erases"), F.lit(False)), F.col("dropped_faces")
    dropped = F.concat(n.cast("string"), F.lit(" face edit"), F.when(n > 1, "s").otherwise(""), F.lit(" left out: the faces changed in the file"))

    # each step binds what the next one reads, so a filter on the plan stays one small expression
    def by_case(v: Column) -> Column:
        case = v["case"]
        return (
            F.when(case == "A", "skip" if skip_a else "rebuild")
            .when(case == "B", "skip" if skip_b else "rebuild")
            .when(case == "C", "skip" if skip_c else "erase")
            .otherwise("band")
        )

    def with_action(v: Column) -> Column:
        drafted = F.col("uses_draft") & (v["base"] != "skip")
        refused = drafted & F.coalesce(v["case"] == "C", F.lit(False)) & refuses & ~erases
        return F.struct(
            v["stop"].alias("stop"), v["case"].alias("case"), v["base"].alias("base"), drafted.alias("drafted"), refused.alias("refused"),
            F.when(v["stop"].isin("copy", "maybe_copy") | refused, "skip").otherwise(v["base"]).alias("action"),
        )

    def with_reasons(v: Column) -> Column:
        unsure = v["case"].isin("B", "C") & (v["base"] != "skip") & (F.col("edge_confidence") < fixed.EDGE_UNSURE)
        goes = v["action"] != "skip"
        found = text.reasons(
            (unsure, REASON["edge"]), (v["case"] == "D", REASON["over"]), (v["drafted"] & (n > 0), dropped),
            (v["refused"], REASON["refused"]), (goes & F.col("names_missing"), REASON["names"]), (goes & F.col("weak"), REASON["weak"]),
        )
        return F.struct(v.alias("v"), found.alias("found"))

    def outcome(u: Column) -> Column:
        v, found = u["v"], u["found"]
        stop, some = v["stop"], F.size(u["found"]) > 0
        skipped = v["action"] == "skip"
        default_skip = F.when(v["case"] == "A", REASON["own"]).otherwise(REASON["existing"])
        why = (
            F.when(stop == "error", F.array(friendly_error(F.col("error"), F.col("size_bytes"))))
            .when(stop == "unsupported", F.array(F.lit(REASON["unsupported"])))
            .when(stop == "multi", F.array(F.lit(REASON["multi"])))
            .when(stop == "copy", F.array(F.lit(REASON["copy"])))
            .when(stop == "maybe_copy", F.array(F.lit(REASON["maybe_copy"])))
            .when(skipped & ~some, F.array(default_skip))
            .otherwise(found)
        )
        blocked = stop.isin("unsupported", "multi")
        status = (
            F.when(stop == "error", "error").when(blocked, "blocked").when(skipped, "skipped").when(some, "flagged").otherwise("ready")
        )
        on_copy = stop.isNull() & (v["case"] == "C") & F.lit(overwrite) & F.when(v["drafted"], erases).otherwise(v["base"] == "erase") & ~skipped
        return F.struct(
            status.alias("status"), F.when(stop.isin("error", "unsupported", "multi"), "band").otherwise(v["action"]).alias("action"),
            why.alias("reasons"), F.coalesce(on_copy, F.lit(False)).alias("on_copy"),
        )

    seen = F.struct(stop.alias("stop"), F.col("case").alias("case"))
    based = lambda v: F.struct(v["stop"].alias("stop"), v["case"].alias("case"), by_case(v).alias("base"))
    plan = let(seen, lambda a: let(based(a), lambda b: let(with_action(b), lambda c: let(with_reasons(c), outcome))))
    # as generated columns: filters and counts on the plan read its result, they are not rewritten
    # into (and do not repeat) the expression
    return analysis.select("photo_id", "path", F.inline(F.array(plan)))


def select_photos(analysis: DataFrame, which: str, ticked: DataFrame | None = None) -> DataFrame:
    """all, selected (the ticked ones), or uncaptioned (no existing caption of any case)."""
    if which == "selected":
        return analysis.join(ticked.select("photo_id").distinct(), "photo_id", "left_semi")
    if which == "uncaptioned":
        return analysis.where(~F.coalesce(F.col("case").isin("A", "B", "C"), F.lit(False)))
    return analysis


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("photos"))


def save_list(plan: DataFrame, warnings: str = "hold") -> DataFrame:
    """Photos that will be saved: ready ones, and flagged ones when included or reviewed."""
    taken = F.lit(warnings == "include") | F.coalesce("reviewed", F.lit(False))
    return plan.where((F.col("status") == "ready") | ((F.col("status") == "flagged") & taken))


def held_list(plan: DataFrame, warnings: str = "hold") -> DataFrame:
    """Flagged photos held back for review."""
    return plan.where((F.col("status") == "flagged") & F.lit(warnings == "hold") & ~F.coalesce("reviewed", F.lit(False)))


def journal_unsaved(plan: DataFrame, saved: DataFrame, parts: int | None = None) -> DataFrame:
    """Journal entries of the photos a batch does not save: their state, reasons, and indices after
    the saved ones. ``plan`` (batch_id, plan_no, path, status, reasons), ``saved`` (batch_id, n)."""
    states = F.create_map(*[F.lit(x) for kv in fixed.UNSAVED_STATES.items() for x in kv])
    state = F.coalesce(F.try_element_at(states, F.col("status")), F.lit("skipped"))
    df = ordered_positions(plan, ["batch_id"], [F.col("plan_no")], "pos", parts)
    df = df.join(saved.select("batch_id", "n"), "batch_id", "left")
    return df.select(
        "batch_id", (F.coalesce("n", F.lit(0)) + F.col("pos") - 1).alias("idx"), "path", state.alias("state"),
        F.array_join("reasons", "; ").alias("error"),
    )


# -- the journal ---------------------------------------------------------------------------------------


def result_state(ok: Column, code: Column) -> Column:
    """The state a finished job leaves: done, changed, or failed."""
    return F.when(ok, "done").when(code == "changed", "changed").otherwise("failed")


def current_state(journal: DataFrame) -> DataFrame:
    """One row per entry: its last state and error, the last output and backup written, and its path,
    which never changes once set."""
    at = F.struct("ts", "seq")
    return journal.groupBy("batch_id", "idx").agg(
        F.max(F.struct("ts", "seq", "state", "error")).alias("s"),
        F.min(F.when(F.col("path").isNotNull(), F.struct("ts", "seq", "path"))).alias("p"),
        F.max(F.when(F.col("out_path").isNotNull(), F.struct(at.alias("at"), "out_path"))).alias("o"),
        F.max(F.when(F.col("backup").isNotNull(), F.struct(at.alias("at"), "backup"))).alias("b"),
    ).select(
        "batch_id", "idx", "s.state", F.col("p.path").alias("path"), F.col("o.out_path").alias("out_path"), F.col("b.backup").alias("backup"),
        F.col("s.error").alias("error"), F.col("s.seq").alias("seq"),
    )


def batch_summary(entries: DataFrame, expected: DataFrame, journaled: DataFrame) -> DataFrame:
    """Per batch: photos per state, expected, and how many can be restored: not restored yet, with a
    backup on record, or failed, changed or cancelled with one journaled next to the job.
    ``expected`` (batch_id, expected), ``journaled`` (batch_id, idx)."""
    j = journaled.select("batch_id", "idx", F.lit(True).alias("has_backup")).distinct()
    e = entries.join(j, ["batch_id", "idx"], "left")
    late = F.col("state").isin("failed", "changed", "cancelled") & F.col("has_backup")
    can = (F.col("state") != "restored") & (F.col("backup").isNotNull() | F.coalesce(late, F.lit(False)))
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "cancelled", "running", "staged")]
    s = e.groupBy("batch_id").agg(F.count(F.lit(1)).alias("entries"), *counts, F.count_if(can).alias("restorable"))
    s = s.join(expected, "batch_id", "left")
    return s.select(
        "batch_id", "entries", "done", "failed", "cancelled", "running", "staged",
        F.coalesce("expected", "entries").alias("expected"), "restorable", (F.col("restorable") > 0).alias("can_restore"),
    )


def incomplete_batches(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """Batches with photos left: entries not finished, and photos never staged."""
    over = F.col("state").isin(fixed.TERMINAL_STATES + ["restored"])
    b = entries.groupBy("batch_id").agg(F.count_if(~over).alias("open"), F.count(F.lit(1)).alias("n"))
    b = expected.join(b, "batch_id", "left").select(
        "batch_id", F.col("expected").alias("total"), F.greatest(F.lit(0), F.col("expected") - F.coalesce("n", F.lit(0))).alias("missing"),
        F.coalesce("open", F.lit(0)).alias("open"),
    )
    return b.withColumn("pending", F.col("open") + F.col("missing")).drop("open").where("pending > 0")


def batch_report(entries: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """Every photo of a batch with its relative path, state, planned action, output, backup,
    error and notes. ``plan`` (batch_id, path, action); ``notes`` of an entry is a list of texts (none where entries have none)."""
    a = plan.groupBy("batch_id", "path").agg(F.max("action").alias("action"))
    prefix = folder.rstrip("/") + "/"
    rel = F.when(F.col("path").startswith(prefix), F.substr("path", F.lit(len(prefix) + 1))).otherwise(F.col("path"))
    blank = F.lit("")
    notes = F.array_join("notes", " | ") if "notes" in entries.columns else blank
    return entries.join(a, ["batch_id", "path"], "left").select(
        "batch_id", "idx", F.coalesce("path", blank).alias("file"), F.coalesce(rel, blank).alias("relative"), "state",
        F.coalesce("action", blank).alias("action"), F.coalesce("out_path", blank).alias("output"),
        F.coalesce("backup", blank).alias("backup"), F.coalesce("error", blank).alias("error"), F.coalesce(notes, blank).alias("notes"),
    )


def guard_planned_paths(requests: DataFrame, planned: DataFrame) -> DataFrame:
    """Requests to write back, for photos the batch was created with only."""
    return requests.join(planned.select("batch_id", "path").distinct(), ["batch_id", "path"], "left_semi")


def plan_restore(entries: DataFrame, planned: DataFrame, backups: DataFrame, now: DataFrame, force: bool = False) -> DataFrame:
    """(batch_id, idx, path, result, keep_aside): what restoring each entry would do. No file moves.

    ``backups`` (backup, size_bytes, content_hash); ``now`` (path, size_bytes, mtime_ns,
    content_hash); entries carry backup, the identity written (out_size, out_mtime, out_hash) and
    ``ours`` (a backup journaled for an output of this very job)."""
    b = backups.select("backup", F.col("size_bytes").alias("b_size"), F.col("content_hash").alias("b_hash"))
    n = now.select("path", F.col("size_bytes").alias("n_size"), F.col("mtime_ns").alias("n_time"), F.col("content_hash").alias("n_hash"))
    ok = planned.select("batch_id", "path", F.lit(True).alias("planned")).distinct()
    e = entries.where("backup IS NOT NULL").join(b, "backup", "left").join(n, "path", "left").join(ok, ["batch_id", "path"], "left")
    there = F.col("n_size").isNotNull()
    same = there & (F.col("n_size") == F.col("b_size")) & (F.col("n_hash") == F.col("b_hash"))
    as_written = (F.col("n_size") == F.col("out_size")) & (F.col("n_time") == F.col("out_mtime")) & (F.col("n_hash") == F.col("out_hash"))
    edited = there & ~F.coalesce("ours", F.lit(False)) & ~F.coalesce(as_written, F.lit(False))
    result = (
        F.when(F.col("planned").isNull(), "error")
        .when(F.coalesce("b_size", F.lit(0)) == 0, "missing-backup")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .when(edited & F.lit(not force), "skipped-edited")
        .otherwise("restored")
    )
    return e.select("batch_id", "idx", "path", result.alias("result"), ((result == "restored") & edited).alias("keep_aside"))


def restore_totals(plan: DataFrame) -> DataFrame:
    """Results per batch and over all batches."""
    return plan.rollup("batch_id", "result").agg(F.count(F.lit(1)).alias("photos"), F.grouping_id().cast("long").alias("level"))


def requeue_failed(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """New events that run failed and cancelled entries again, where a staged job exists."""
    again = entries.where(F.col("state").isin("failed", "cancelled")).join(jobs.select("batch_id", "idx").distinct(), ["batch_id", "idx"], "left_semi")
    return again.select("batch_id", "idx", F.lit("retry").alias("state"), F.lit("").alias("error"))


def adopt_finished(entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """New events for running or failed entries whose output carries this entry's job id: done.
    ``outputs`` (job_id, out_path); a job id is batch:index."""
    job = F.concat_ws(":", "batch_id", "idx")
    mine = entries.where(F.col("state").isin("running", "failed")).withColumn("job_id", job).drop("out_path")
    found = outputs.groupBy("job_id").agg(F.max("out_path").alias("out_path"))
    return mine.join(found, "job_id").select("batch_id", "idx", F.lit("done").alias("state"), "out_path")


def compare_plans(old: DataFrame, new: DataFrame) -> DataFrame:
    """(batch_id, idx, outcome, reason) when a batch resumes: an entry is staged again if it would
    still be saved the same way, else it is not prepared and says why. ``old`` carries edited."""
    n = new.select("batch_id", "idx", F.col("status").alias("status_now"), F.col("action").alias("action_now"), F.col("reasons").alias("reasons_now"))
    df = old.join(n, ["batch_id", "idx"], "full_outer")
    saved = F.col("status_now").isin("ready", "flagged")
    same = saved & (F.col("action") == F.col("action_now"))
    would = F.concat(
        F.lit("now it would "),
        F.when(F.col("action_now") == "skip", "be skipped").otherwise(F.col("action_now")),
    )
    listed = F.array_join("reasons_now", "; ")
    why = F.when(saved, would).otherwise(F.concat("status_now", F.when(listed != "", F.concat(F.lit(": "), listed)).otherwise("")))
    reason = (
        F.when(F.col("status").isNull(), "Not prepared before the batch stopped")
        .when(F.col("edited"), "Edited in review but not prepared")
        .when(F.col("status_now").isNull(), "Could not be prepared again")
        .when(~same, F.concat(F.lit("Changed since it was checked ("), why, F.lit(")")))
    )
    return df.select("batch_id", "idx", F.when(reason.isNull(), "stage").otherwise("notPrepared").alias("outcome"), F.coalesce(reason, F.lit("")).alias("reason"))


def exclude_entries(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """New events for entries that won't be saved (batch_id, idx, state, reason); saved, running and
    restored ones, and any with an output or backup, are never re-labelled."""
    kept = F.col("state").isin(fixed.PROTECTED_STATES) | F.col("out_path").isNotNull() | F.col("backup").isNotNull()
    return requests.join(entries.where(kept).select("batch_id", "idx"), ["batch_id", "idx"], "left_anti")


def folders_touched(entries: DataFrame) -> DataFrame:
    """Every folder a batch reads from or writes to."""
    paths = F.explode(F.array_compact(F.array(*[c for c in ("path", "out_path", "backup") if c in entries.columns])))
    return entries.select("batch_id", paths.alias("p")).select("batch_id", F.regexp_extract("p", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
