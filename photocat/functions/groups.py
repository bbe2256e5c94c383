"""Ordering and matching inside groups that may be very uneven.

One photo, folder or batch can hold a large share of all rows. A plain window would sort such a group in one task.
``ordered_scan`` deals rows into ranges of (group, order) instead: as many as ``spark.sql.shuffle.partitions`` says (or
``parts``), each about the same share of all rows, so a group with a third of the rows lies in a third of the ranges. The
window runs per group and range, and what the earlier ranges of a group hold is carried in. Two neighbouring ranges
share one group at most, so groups that need this are fewer than ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photocat.session import cut_lineage


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Add ``_part``, the number of the row's range of (keys, order). Written once, as a range's bounds come from a
    sample. Spark chooses how many ranges there are, unless ``parts`` does."""
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    return cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over as many tasks as a shuffle has, whatever the files. For steps that cost much more
    than reading their rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Running(NamedTuple):
    """A value carried along a group's order: ``how`` combines the rows up to this one (or before it, not ``inclusive``).

    ``how`` is any of COMBINE: an associative function with its aggregate, so that each range is reduced on its own."""

    src: str
    how: str = "sum"
    inclusive: bool = True


#: how -> (aggregate over rows or ranges in order, what an earlier and a later part give together). Nulls count for nothing.
COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "bit_xor": (F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: str | None = None,
    lag: dict[str, str] | None = None,
    running: dict[str, str | Running] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Row position, previous-row values and running values inside each group.

    ``lag`` maps a new column to the column it reads, ``running`` to a column to sum or to a ``Running``. ``order`` is
    ascending and unique inside a group (rows that tie may be taken in any order). Keys are not null.
    """
    return scan_ranges(in_ranges(df, keys, list(order), parts), keys, order, position, lag, running).drop("_part")


def scan_ranges(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: str | None = None,
    lag: dict[str, str] | None = None,
    running: dict[str, str | Running] | None = None,
) -> DataFrame:
    """``ordered_scan`` over rows that ``in_ranges`` dealt by the same keys and order; they keep their ``_part``, so another
    scan of the same order needs no new ranges."""
    lag = lag or {}
    running = {out: Running(r) if isinstance(r, str) else r for out, r in (running or {}).items()}
    order = list(order)
    by_part = [*keys, "_part"]
    # groups in several ranges: fewer than ranges, so they and their parts are small enough to be handed to every task,
    # whatever the rows; a shuffle by group would bring a large one together again
    several = rows.groupBy(*keys).agg(F.min("_part").alias("_a"), F.max("_part").alias("_z")).where("_a < _z").select(*keys)
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    totals = [F.count(F.lit(1)).alias("_cnt")]
    totals += [F.max_by(F.struct(src), o).alias(f"_last_{out}") for out, src in lag.items()]
    for out, r in running.items():
        whole = F.max_by(r.src, F.when(F.col(r.src).isNotNull(), o)) if r.how == "last" else COMBINE[r.how][0](r.src)
        totals.append(whole.alias(f"_all_{out}"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    prior = Window.partitionBy(*keys).orderBy("_part")
    carried = (
        rows.join(F.broadcast(several), list(keys))
        .groupBy(*by_part)
        .agg(*totals)
        .select(
            *by_part,
            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_before"),
            *[F.lag(f"_last_{out}").over(prior).alias(f"_carry_{out}") for out in lag],
            *[COMBINE[r.how][0](F.col(f"_all_{out}")).over(before).alias(f"_base_{out}") for out, r in running.items()],
        )
    )
    w = Window.partitionBy(*by_part).orderBy(*order)
    new = {"_rn": F.row_number().over(w).cast("long")}
    new |= {out: F.lag(src).over(w) for out, src in lag.items()}
    new |= {out: COMBINE[r.how][0](F.col(r.src)).over(w.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)) for out, r in running.items()}
    out = rows.withColumns(new).join(F.broadcast(carried), by_part, "left")
    fix = {
        name: F.when((F.col("_rn") == 1) & (F.col("_before") > 0), F.col(f"_carry_{name}.{src}")).otherwise(F.col(name))
        for name, src in lag.items()
    }
    fix |= {name: COMBINE[r.how][1](F.col(f"_base_{name}"), F.col(name)) for name, r in running.items()}
    if position:
        fix[position] = F.col("_rn") + F.coalesce(F.col("_before"), F.lit(0))
    keep = [c for c in rows.columns if c not in fix]
    return out.select(*keep, *[c.alias(n) for n, c in fix.items()])


def ordered_positions(df, keys, order, name: str = "pos", parts: int | None = None) -> DataFrame:
    """1-based position of each row in its group."""
    return ordered_scan(df, keys, order, position=name, parts=parts)


def with_group_values(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add per-group aggregates. The aggregate combines map-side and is joined back (the join is
    split by AQE when one key is large), so no task has to hold a whole group."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), list(keys))


def _levels(size: str) -> Column:
    return F.floor(F.log2(F.col(size))).cast("int")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], iou, threshold: float) -> DataFrame:
    """Pairs of boxes in the same group with IoU > ``threshold`` (at least 0.5).

    ``left`` has box columns x, y, w, h and ``right`` has rx, ry, rw, rh. Each left box has one grid cell for its size
    class, and each right box offers only the cells a box overlapping it by ``threshold`` can have. Along one side the
    overlap t is no smaller than in the plane, so widths differ by less than a factor of 1 / t and centres by less than
    (1 - t) / (2 + 2t) of both widths together: the higher the threshold, the fewer cells. So near misses are not paired,
    and no pair is lost or repeated.
    """
    if threshold < 0.5:
        raise ValueError("overlap_pairs needs a threshold of at least 0.5")
    keys = list(keys)
    left = left.where("w > 0 and h > 0").withColumns({"_lw": _levels("w"), "_lh": _levels("h")})
    left = left.withColumns({"_i": _at(F.col("x") + F.col("w") / 2, "_lw"), "_j": _at(F.col("y") + F.col("h") / 2, "_lh")})
    left = left.withColumn("_cell", _cell_key()).drop("_lw", "_lh", "_i", "_j")
    return left.join(in_reach(right, threshold), [*keys, "_cell"]).where(iou > threshold).drop("_cell")


def _cell_key() -> Column:
    return F.xxhash64("_lw", "_lh", "_i", "_j")


def _at(centre: Column, level: str) -> Column:
    return F.floor(centre / F.pow(F.lit(2.0), F.col(level) + 1)).cast("long")


def in_reach(right: DataFrame, threshold: float) -> DataFrame:
    """Boxes (rx, ry, rw, rh), once for each ``_cell`` a box with a larger overlap than ``threshold`` can have."""
    t = threshold * (1 - 1e-6)  # room for rounding
    right = right.where("rw > 0 and rh > 0")
    for level, size in {"_lw": "rw", "_lh": "rh"}.items():
        lowest, highest = (F.floor(F.log2(F.col(size) * by)).cast("int") for by in (t, 1 / t))
        right = right.withColumn(level, F.explode(F.sequence(lowest, highest)))
    for n, (c, size, level) in {"i": ("rx", "rw", "_lw"), "j": ("ry", "rh", "_lh")}.items():
        # the largest box of the class that may still overlap enough says how far away its centre is
        widest = F.least(F.col(size) / t, F.pow(F.lit(2.0), F.col(level) + 1))
        reach = (1 - t) / (2 + 2 * t) * (F.col(size) + widest)
        first, last = (_at(F.col(c) + F.col(size) / 2 + sign * reach, level) for sign in (-1, 1))
        right = right.withColumn(f"_{n}", F.explode(F.sequence(first, last)))
    return right.withColumn("_cell", _cell_key()).drop("_lw", "_lh", "_i", "_j")
