"""Caption tables and output names for whole catalogues."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.functions import captions, text
from photocat.functions import fixed_values as fixed
from photocat.functions.groups import ordered_positions, ordered_scan
from photocat.operators import normalize, people
from photocat.operators.normalize import route_output_format
from photocat.session import cut_lineage


class Sources(NamedTuple):
    """What tokens read: one row of fields per photo, and the rows of its faces, keywords and keyword paths."""

    fields: DataFrame
    faces: DataFrame | None = None
    keywords: DataFrame | None = None
    paths: DataFrame | None = None


NAMES = {"order": "lr", "sep": ", ", "last": " and ", "rows": False, "row_sep": "; ", "labels": None}


def _names(df: DataFrame, faces: DataFrame, toks: list[captions.Tok]) -> tuple[DataFrame, dict]:
    """Lists of names join once per order, texts by rows once per way to write them."""
    raw, orders = {}, {}
    for t in toks:
        o = NAMES | {k: v for k, v in t.options.items() if k in NAMES}
        if o.pop("rows"):
            column = f"_rows{len(raw)}"
            by_rows = people.names_rows_text(faces, o["sep"], o["last"], o["row_sep"], o["labels"], o["order"])
            df = df.join(by_rows.withColumnRenamed("names", column), "photo_id", "left")
            raw[t.key] = F.col(column)
            continue
        if o["order"] not in orders:
            orders[o["order"]] = column = f"_names_{o['order']}"
            df = df.join(people.names_in_order(people.named(faces), o["order"]).withColumnRenamed("names", column), "photo_id", "left")
        listed = F.coalesce(F.col(orders[o["order"]]), F.array().cast("array<string>"))
        raw[t.key] = F.nullif(F.size(listed).cast("string"), F.lit("0")) if t.name == "names.count" else text.join_names(listed, o["sep"], o["last"])
    return df, raw


def _keywords(df: DataFrame, sources: Sources, toks: list[captions.Tok]) -> tuple[DataFrame, dict]:
    """A list of keywords joins once per choice of markers and exclusions."""
    raw, lists = {}, {}
    for t in toks:
        chosen = t.options.get("markers") == "show", tuple(t.options.get("exclude", ()))
        if chosen not in lists:
            kept = sources.keywords if chosen[0] else normalize.drop_marker_keywords(sources.keywords)
            if chosen[1]:
                kept = normalize.exclude_keywords(kept, sources.paths, list(chosen[1]))
            lists[chosen] = column = f"_keywords{len(lists)}"
            listed = F.array_sort(F.collect_list(F.struct("src_rank", "item", "keyword")))["keyword"]
            df = df.join(kept.groupBy("photo_id").agg(listed.alias(column)), "photo_id", "left")
        raw[t.key] = F.array_join(F.coalesce(F.col(lists[chosen]), F.array().cast("array<string>")), t.options.get("sep", ", "))
    return df, raw


def bind(sources: Sources, templates: list) -> tuple[DataFrame, captions.At]:
    """Compile templates: every different token of them becomes one column, computed once, however often and wherever it
    stands. Returns the photos with these columns, and where each token's text is found."""
    toks = {t.key: t for items in templates for t in captions.tokens(items)}
    of = lambda *names: [t for t in toks.values() if t.name in names and "column" not in t.options]
    df, raw = sources.fields, {}
    if sources.faces is not None:
        df, found = _names(df, sources.faces, of("names", "names.count"))
        raw |= found
    if sources.keywords is not None:
        df, found = _keywords(df, sources, of("keywords"))
        raw |= found
    for t in of("location"):
        if "location" not in df.columns:
            raw[t.key] = F.concat_ws(", ", *[F.nullif(text.strip(F.col(c)), F.lit("")) for c in ("sublocation", "city", "state", "country") if c in df.columns])
    column = {key: f"_tok{n}" for n, key in enumerate(toks)}
    df = df.withColumns({column[key]: captions.token_text(t, raw.get(key)) for key, t in toks.items()})
    return df, lambda t: F.col(column[t.key])


def render_captions(fields: DataFrame | Sources, template: dict) -> DataFrame:
    """(photo_id, block, caption) for a template {block: items}: tokens are bound once, then the blocks become rows. Empty
    captions are kept, so a block that takes no space shows as such."""
    df, at = bind(fields if isinstance(fields, Sources) else Sources(fields), list(template.values()))
    blocks = [F.struct(F.lit(n).alias("block"), captions.caption(items, at).alias("caption")) for n, items in template.items()]
    return df.select("photo_id", F.inline(F.array(*blocks)))


def caption_coverage(fields: DataFrame | Sources, template: dict) -> DataFrame:
    """(photo_id, block, token, expected): every token that came out empty; ``expected`` where the
    template only uses it inside optional groups."""
    df, at = bind(fields if isinstance(fields, Sources) else Sources(fields), list(template.values()))
    blocks = []
    for n, items in template.items():
        optional = sorted({t.name for t in captions.tokens(items) if captions.only_optional(items, t.name)})
        blocks.append(F.struct(
            F.lit(n).alias("block"), captions.empty_tokens(items, at).alias("empty"),
            F.array(*[F.lit(x) for x in optional]).cast("array<string>").alias("optional"),
        ))
    rows = df.select("photo_id", F.inline(F.array(*blocks)))
    return rows.select("photo_id", "block", F.explode("empty").alias("token"), "optional").select(
        "photo_id", "block", "token", F.array_contains("optional", F.col("token")).alias("expected")
    )


def coverage_totals(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("block", "token").agg(F.count(F.lit(1)).alias("photos"))


def plan_destinations(photos: DataFrame, saving: dict, name_items: list) -> DataFrame:
    """(photo_id, path, folder, name, ext, dest): where each copy goes. ``saving`` holds location
    (same, subfolder, fixed), subfolderName, fixedFolder and outputFormat. A copy never takes its
    own source's place."""
    source_folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    location = saving.get("location", "subfolder")
    if location == "fixed" and saving.get("fixedFolder"):
        folder = F.lit(saving["fixedFolder"].rstrip("/"))
    elif location == "same":
        folder = source_folder
    else:
        folder = F.concat(source_folder, F.lit("/" + (saving.get("subfolderName") or "captioned")))
    _, ext = route_output_format(F.col("format"), saving.get("outputFormat", "same"), F.col("path"))
    df = photos.withColumns({
        "stem": stem, "filename": base, "folder": F.regexp_extract(source_folder, r"([^/]*)$", 1), "_to": folder, "ext": ext,
    })
    name = text.safe_file_name(captions.caption(name_items), F.col("stem"))
    df = df.withColumn("name", name)
    own = F.concat("_to", F.lit("/"), "name", "ext") == F.col("path")
    df = df.withColumn("name", F.when(own, F.concat("name", F.lit("-captioned"))).otherwise(F.col("name")))
    return df.select(
        "photo_id", "path", F.col("_to").alias("folder"), "name", "ext", F.concat("_to", F.lit("/"), "name", "ext").alias("dest")
    )


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("_base", F.lower(F.concat("folder", F.lit("/"), "name"))).withColumn("_ext", F.lower("ext"))


def resolve_name_collisions(wanted: DataFrame, taken: DataFrame, parts: int | None = None) -> DataFrame:
    """(photo_id, dest): names in batch order (idx). The first photo keeps its name if it is free;
    the rest count up from 2, skipping numbers that are taken on disk or are another photo's own
    name. Equality ignores case.

    The k-th photo in need takes the k-th free number. A taken number n with r taken ones up to it
    leaves n - 1 - r free numbers below, so the k-th free number is k + 1 plus the taken numbers
    that have fewer than k free ones below: a running sum over both lists merged. The scans split
    large groups, so one name that a third of all photos want is not sorted in one task."""
    group = ["_base", "_ext"]
    own = _key(wanted)
    on_disk = taken.select(F.lower("path").alias("_path")).distinct()
    plain_taken = on_disk.select(F.col("_path").alias("_plain"), F.lit(True).alias("plain_taken"))
    own = own.withColumn("_plain", F.concat("_base", "_ext")).join(plain_taken, "_plain", "left")
    # read five times below: written once
    own = cut_lineage(ordered_positions(own, group, [F.col("idx")], "k", parts))
    # counting up never gets to numbers of more digits, as there are fewer photos
    number = r"^(.*)-([1-9]\d{0,17})(\.[^./]*)$"
    first_names = own.where("k = 1 AND plain_taken IS NULL").select(F.col("_plain").alias("_path"))
    numbered = on_disk.unionByName(first_names).distinct().where(F.col("_path").rlike(number)).select(
        F.regexp_extract("_path", number, 1).alias("_base"), F.regexp_extract("_path", number, 3).alias("_ext"),
        F.regexp_extract("_path", number, 2).cast("long").alias("n"),
    )
    used = numbered.where("n >= 2").join(own.select(*group).distinct(), group, "left_semi")
    used = ordered_positions(used, group, [F.col("n")], "r", parts)
    none = F.lit(None).cast("long")
    events = own.select(
        *group, F.when(F.col("plain_taken").isNull(), F.col("k") - 1).otherwise(F.col("k")).alias("at"), F.lit(1).alias("kind"),
        F.col("idx").alias("tie"), "photo_id", F.lit(0).alias("step"),
    ).unionByName(
        # counts from the first rank that has this number below it
        used.select(*group, (F.col("n") - F.col("r")).alias("at"), F.lit(0).alias("kind"), F.col("n").alias("tie"), none.alias("photo_id"), F.lit(1).alias("step"))
    )
    shifted = ordered_scan(events, group, [F.col("at"), F.col("kind"), F.col("tie")], running={"shift": "step"}, parts=parts)
    numbered_name = F.when(F.col("at") > 0, F.concat(F.lit("-"), (F.col("at") + 1 + F.col("shift")).cast("string"))).otherwise("")
    return (
        shifted.where("kind = 1")
        .select("photo_id", numbered_name.alias("suffix"))
        .join(own.select("photo_id", "folder", "name", "ext"), "photo_id")
        .select("photo_id", F.concat("folder", F.lit("/"), "name", "suffix", "ext").alias("dest"))
    )


def overwrite_policy(planned: DataFrame, taken: DataFrame, policy: str) -> DataFrame:
    """Add ``decision`` for names that exist on disk. ``taken``: path, owner_id (the photo whose
    earlier copy it is, NULL for any other file). ask: a conflict; overwrite: only an earlier copy
    of the same photo is replaced, anything else counts up; increment: counts up. Files whose names differ only in
    case are one name, whose owner counts only if all of them have it."""
    one_owner = (F.min("owner_id") == F.max("owner_id")) & (F.count("owner_id") == F.count(F.lit(1)))
    t = taken.groupBy(F.lower("path").alias("_d")).agg(F.when(one_owner, F.min("owner_id")).alias("owner_id"), F.lit(True).alias("exists"))
    df = planned.withColumn("_d", F.lower("dest")).join(t, "_d", "left")
    mine = F.col("owner_id") == F.col("photo_id")
    free = F.col("exists").isNull()
    if policy == "ask":
        decision = F.when(free, "write").otherwise("conflict")
    elif policy == "overwrite":
        decision = F.when(free, "write").when(F.coalesce(mine, F.lit(False)), "replace").otherwise("count up")
    else:
        decision = F.when(free, "write").otherwise("count up")
    return df.select("photo_id", "dest", decision.alias("decision"))


def batch_policy(policy: str) -> str:
    """A batch can't stop to ask: it counts up instead."""
    return "increment" if policy == "ask" else policy
