"""Existing captions from recognized words and band measurements.

Words are (photo_id, line_no, block_no, pos, word, conf); lines and blocks carry pixel boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photocat.functions import fixed_values as fixed
from photocat.functions import text
from photocat.session import cut_lineage


def assemble_lines(words: DataFrame) -> DataFrame:
    """Words to lines in reading order; confidence is the mean weighted by word length.

    Words are dealt to their lines first: lists of so many lines do not fit a map-side table, so combining there only
    sorted and spilled every word once more."""
    weight = F.greatest(F.lit(1), F.length("word"))
    return words.repartition("photo_id", "line_no").groupBy("photo_id", "line_no").agg(
        F.expr("listagg(word, ' ') WITHIN GROUP (ORDER BY pos)").alias("text"),
        (F.sum(F.col("conf") * weight) / F.sum(weight)).alias("conf"),
    )


def line_glyphs(words: DataFrame) -> DataFrame:
    """Letters and digits per line: of confidently read words, of fairly read ones, of all."""
    g = words.withColumn("g", text.glyphs(F.col("word")))

    def over(limit):
        return F.sum(F.when(F.col("conf") >= limit, F.col("g")).otherwise(0))

    return g.groupBy("photo_id", "block_no", "line_no").agg(
        over(fixed.WORD_CONFIDENCE).alias("sure"), over(fixed.COMPANION_CONFIDENCE).alias("fair"), F.sum("g").alias("glyphs")
    )


def filter_lines(lines: DataFrame) -> DataFrame:
    """Lines that read as text: two confident glyphs on a line thick enough for writing; shorter
    lines stay beside one in the same block. Needs sure, fair, glyphs, thickness and short_side."""
    full = F.col("short_side") * fixed.WRITING_THICKNESS
    reads = (F.col("sure") >= 2) & (F.col("thickness") >= full)
    df = lines.withColumn("reads", reads)
    blocks = df.groupBy("photo_id", "block_no").agg(F.bool_or("reads").alias("block_reads"))
    companion = (F.col("thickness") >= 0.5 * full) & ((F.col("glyphs") >= 2) | (F.col("fair") >= 1))
    return df.join(blocks, ["photo_id", "block_no"]).where(F.col("reads") | (F.col("block_reads") & companion)).drop("block_reads")


# -- lines to blocks ---------------------------------------------------------------------------------


#: Size classes are powers of two of a height in pixels, up to this one.
LARGEST = 40
#: A line reaches so many heights sideways; a cell is so many sides high and so many wide.
REACH, ROWS, CELL = 3.75, 4, 64


def _cell(at: str, level: str, wide: int) -> Column:
    return F.expr(f"cast(floor(({at}) / ({wide} * pow(2.0D, {level} + 1))) as long)")


def line_links(lines: DataFrame) -> DataFrame:
    """(photo_id, a, b): lines that belong together, stacked or side by side on one baseline.

    Lines meet in cells of the plane, some times as high and as wide as the taller line's size class: the taller one
    looks in the cells it can reach, the other lies in the cells it covers, filed once for each larger size class on its
    photo. A pair counts in the first cell both have, so it is found once, and neither a page nor a baseline with very
    many lines is paired line by line."""
    level = F.least(F.greatest(F.floor(F.log2("h")), F.lit(0)), F.lit(LARGEST)).cast("int")
    b = lines.select("photo_id", "line_no", "x", "y", "w", "h").where("h > 0").withColumn("lv", level)
    taller = b.withColumns({
        "r0": _cell("y - h", "lv", ROWS), "r1": _cell("y + 2 * h", "lv", ROWS),
        "c0": _cell(f"x - {REACH} * h", "lv", CELL), "c1": _cell(f"x + w + {REACH} * h", "lv", CELL),
    })
    taller = taller.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("r1", "c1")
    classes = b.groupBy("photo_id").agg(F.bit_or(F.expr("shiftleft(1L, lv)")).alias("classes"))
    other = b.select("photo_id", F.col("line_no").alias("line_2"), *[F.col(c).alias(c + "2") for c in ("x", "y", "w", "h")], F.col("lv").alias("own"))
    other = other.join(classes, "photo_id").withColumn("lv", F.explode(F.sequence(F.col("own"), F.floor(F.log2("classes")).cast("int"))))
    other = other.where("(shiftright(classes, lv) & 1) = 1").withColumns({
        "q0": _cell("y2", "lv", ROWS), "q1": _cell("y2 + h2", "lv", ROWS), "d0": _cell("x2", "lv", CELL), "d1": _cell("x2 + w2", "lv", CELL),
    })
    other = other.withColumn("row", F.explode(F.sequence("q0", "q1"))).withColumn("col", F.explode(F.sequence("d0", "d1"))).drop("own", "classes", "q1", "d1")
    p = taller.join(other, ["photo_id", "lv", "row", "col"]).where("h > h2 OR (h = h2 AND line_no > line_2)")
    p = p.where("row = greatest(r0, q0) AND col = greatest(c0, d0)")
    v = F.greatest("y", "y2") - F.least(F.col("y") + F.col("h"), F.col("y2") + F.col("h2"))
    hz = F.greatest("x", "x2") - F.least(F.col("x") + F.col("w"), F.col("x2") + F.col("w2"))
    tall, low = F.greatest("h", "h2"), F.least("h", "h2")
    stacked = (v <= tall) & (hz <= 2 * tall) & (v > -0.5 * low)
    foot = F.abs((F.col("y") + F.col("h")) - (F.col("y2") + F.col("h2")))
    same_base = (-v >= 0.5 * low) & (foot <= 0.2 * tall) & (hz <= REACH * low)
    return p.where(stacked | same_base).select("photo_id", F.greatest("line_no", "line_2").alias("a"), F.least("line_no", "line_2").alias("b"))


def connected(links: DataFrame) -> DataFrame:
    """(photo_id, node, root): each linked node with the smallest node it reaches.

    Alternating star steps (every node hands its neighbours the smallest one it sees) halve the distance to the root, so
    long chains need few rounds. After each round the components that have become stars (no child has two roots, no
    root hangs below another) are set aside, and only the rest is looked at again, until nothing is left."""
    rest, done = cut_lineage(links.select("photo_id", "a", "b").distinct()), []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select("photo_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("photo_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.where("b > a").join(low, ["photo_id", "a"]).select("photo_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = hung.groupBy("photo_id", "a").agg(F.min("b").alias("m"))
        up = hung.join(low, ["photo_id", "a"]).where("b <> m").select("photo_id", F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut_lineage(up.unionByName(low.select("photo_id", "a", F.col("m").alias("b"))).distinct())
        # roots that are not settled: those that share a child, hang below another, or have a root below them
        per_child = stars.groupBy("photo_id", "a").agg(F.count(F.lit(1)).alias("n"))
        roots = stars.select("photo_id", F.col("b").alias("a")).distinct()
        shared = stars.join(per_child.where("n > 1"), ["photo_id", "a"], "left_semi").select("photo_id", "b")
        below = stars.join(roots, ["photo_id", "a"], "left_semi")
        moving = cut_lineage(shared.union(below.select("photo_id", "b")).union(below.select("photo_id", F.col("a").alias("b"))).distinct())
        if moving.isEmpty():
            done.append(stars)
            break
        done.append(stars.join(moving, ["photo_id", "b"], "left_anti"))
        rest = stars.join(moving, ["photo_id", "b"], "left_semi").select("photo_id", "a", "b")
    out = links.sparkSession.createDataFrame([], links.select("photo_id", "a", "b").schema) if not done else done[0].select("photo_id", "a", "b")
    for d in done[1:]:
        out = out.unionByName(d.select("photo_id", "a", "b"))
    return out.select("photo_id", F.col("a").alias("node"), F.col("b").alias("root"))


#: A task takes in photos of up to so many lines whole, so many lines at a time, and compares so many pairs at once.
WHOLE, LOT, PAIRS = 100_000, 50_000, 1 << 19
#: Size classes within a task are powers of two from this exponent on.
LOWEST, CLASSES = -20, 2048
#: A tile of a larger photo is so many times as wide and high as the size class of its lines.
TILE = 128


def _power(size: np.ndarray) -> np.ndarray:
    """The exponent of the first power of two above each size."""
    return np.maximum(np.frexp(np.maximum(size, 0))[1], LOWEST).astype(np.int64)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, and 0, 1, 2.. along its copies."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _linked(x, y, w, h, a, b) -> np.ndarray:
    """Whether lines a and b, a not lower than b, belong together: stacked, or side by side on one baseline."""
    v = np.maximum(y[a], y[b]) - np.minimum(y[a] + h[a], y[b] + h[b])
    hz = np.maximum(x[a], x[b]) - np.minimum(x[a] + w[a], x[b] + w[b])
    stacked = (v <= h[a]) & (hz <= 2 * h[a]) & (v > -0.5 * h[b])
    foot = np.abs((y[a] + h[a]) - (y[b] + h[b]))
    return stacked | ((-v >= 0.5 * h[b]) & (foot <= 0.2 * h[a]) & (hz <= REACH * h[b]))


def _near(photo, x, y, w, h) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (taller, other) of a photo's lines that can belong together, in lots.

    Lines are filed by rows of the plane, once for their own size class and each larger one of their photo, and along a
    row by where they begin, those of like width together. The taller line looks through the rows it can reach."""
    sizes, own = np.unique(photo * CLASSES + _power(h) - LOWEST, return_inverse=True)
    side = np.ldexp(2.0, sizes % CLASSES + LOWEST)
    line, size = _spread(np.searchsorted(sizes, (photo + 1) * CLASSES) - own)
    size += own[line]
    rows, row = np.unique(np.floor(y[line] / side[size]), return_inverse=True)
    begins = np.sort(x)
    filed = (size * len(rows) + row) * (len(x) + 1) + np.searchsorted(begins, x)[line]
    width = _power(w)[line]
    # rows the taller line reaches; a little more, as sums are rounded
    first, last = np.floor((y - 2.01 * h) / side[own]), np.floor((y + 2.01 * h) / side[own])
    tall, down = _spread((last - first + 1).astype(np.int64))
    at = np.minimum(np.searchsorted(rows, first[tall] + down), len(rows) - 1)
    there = rows[at] == first[tall] + down
    tall = tall[there]
    at = (own[tall] * len(rows) + at[there]) * (len(x) + 1)
    until = at + np.searchsorted(begins, x + w + 4 * h, side="right")[tall]
    for wide in np.unique(width):
        alike = np.flatnonzero(width == wide)
        alike = alike[np.argsort(filed[alike], kind="stable")]
        since = at + np.searchsorted(begins, x - 4 * h - np.ldexp(1.0, wide))[tall]
        start = np.searchsorted(filed[alike], since)
        n = np.maximum(np.searchsorted(filed[alike], until) - start, 0)
        cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS), side="left") + 1
        for i, j in zip([0, *cuts], cuts, strict=False):
            of, step = _spread(n[i:j])
            yield tall[i:j][of], line[alike[start[i:j][of] + step]]


def _first_reached(photo, node, x, y, w, h) -> np.ndarray:
    """For each node (numbered in order) the first one it reaches by links of its lines."""
    root = np.arange(node.max(initial=-1) + 1)
    for a, b in _near(photo, x, y, w, h):
        new = ((h[a] > h[b]) | ((h[a] == h[b]) & (a > b))) & (root[node[a]] != root[node[b]])
        a, b = a[new], b[new]
        new = _linked(x, y, w, h, a, b)
        a, b = node[a[new]], node[b[new]]
        while len(a):
            a, b = root[a], root[b]
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    return root


def _groups(lines: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """The groups of rows in order, numbered from 0."""
    codes = [lines[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in by]
    return np.cumsum(np.any([np.diff(c, prepend=c[:1]) != 0 for c in codes], axis=0))


def _blocks_within(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("photo_id",)) -> Iterator[pa.RecordBatch]:
    """Lines in order of ``by``: the same rows with their block, as far as it lies within their group."""

    def blocks(lines: pa.Table) -> pa.Table:
        group, number = _groups(lines, by), lines["line_no"].combine_chunks()
        rank = pc.rank(number, tiebreaker="dense").to_numpy().astype(np.int64)
        _, first, node = np.unique(group * (len(rank) + 1) + rank, return_index=True, return_inverse=True)
        box = [lines[c].cast(pa.float64(), safe=False).to_numpy() for c in ("x", "y", "w", "h")]
        has = np.flatnonzero(np.isfinite(box).all(axis=0) & (box[3] > 0) & number.is_valid().to_numpy(zero_copy_only=False))
        root = _first_reached(group[has], node[has], *(c[has] for c in box))
        root = np.concatenate([root, np.arange(len(root), len(first))])
        return lines.append_column("block", number.take(pa.array(first[root[node]])))

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOT:
            lines = pa.Table.from_batches(held)
            group = _groups(lines, by)
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if whole:
                yield from blocks(lines.slice(0, whole)).combine_chunks().to_batches(max_chunksize=10_000)
            held, n = lines.slice(whole).to_batches(), n - whole
    if n:
        yield from blocks(pa.Table.from_batches(held)).combine_chunks().to_batches(max_chunksize=10_000)


def _grouped(lines: DataFrame, *by: str) -> DataFrame:
    """Lines with their block, as far as it lies within their group; they are dealt once, to the task that has the group."""
    out = lines.withColumn("block", F.col("line_no")).schema
    return lines.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: _blocks_within(batches, by), out)


def _grouped_by_all(lines: DataFrame) -> DataFrame:
    """Lines with their block, however many a photo has: blocks within tiles of the plane, per size class, are found first;
    then only they, not lines, are joined in rounds where lines in different ones meet."""
    size = F.greatest(F.floor(F.log2("h")), F.lit(LOWEST)).alias("lv")
    tile = F.struct(size, *[F.expr(f"floor({c} / ({TILE} * pow(2.0D, greatest(floor(log2(h)), {LOWEST}))))") for c in ("y", "x")])
    tiles = _grouped(lines.withColumn("tile", F.to_json(tile)), "photo_id", "tile").drop("tile")
    # lines of no photo are those of one photo, as in the sort; a struct is equal to another with the same null
    tiles = tiles.withColumn("photo_id", F.struct("photo_id"))
    links = line_links(tiles.withColumn("line_no", F.struct("block", "line_no"))).select("photo_id", F.col("a.block").alias("a"), F.col("b.block").alias("b"))
    # a line number that is in several tiles is one line
    parts = tiles.groupBy("photo_id", "line_no").agg(F.collect_set("block").alias("parts")).where("size(parts) > 1")
    parts = parts.select("photo_id", F.explode("parts").alias("a"), F.array_min("parts").alias("b"))
    root = connected(links.unionByName(parts)).withColumnRenamed("node", "block")
    whole = tiles.join(root, ["photo_id", "block"], "left").withColumn("block", F.coalesce("root", "block"))
    return whole.withColumn("photo_id", F.col("photo_id.photo_id")).select(*lines.columns, "block")


def group_text_blocks(lines: DataFrame) -> DataFrame:
    """Lines with ``block`` (its first line) by transitive links.

    Lines are dealt once, to the task that has their photo; neither cells nor links nor rounds are written anywhere. Only
    photos with more lines than a task takes in are cut into tiles."""
    lines = lines.drop("block")
    many = lines.groupBy(F.col("photo_id").alias("whose")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("whose")
    many = cut_lineage(many)
    if many.isEmpty():
        return _grouped(lines, "photo_id")
    has_many = F.col("photo_id").eqNullSafe(F.col("whose"))
    few = _grouped(lines.join(F.broadcast(many), has_many, "left_anti"), "photo_id")
    return few.unionByName(_grouped_by_all(lines.join(F.broadcast(many), has_many, "left_semi")))


def block_boxes(grouped: DataFrame) -> DataFrame:
    """The union box and line count of each block."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    g = grouped.groupBy("photo_id", "block").agg(F.min("x").alias("x"), F.min("y").alias("y"), right.alias("r"), bottom.alias("bt"), F.count(F.lit(1)).alias("n_lines"))
    return g.select("photo_id", "block", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("bt") - F.col("y")).alias("h"), "n_lines")


def main_block(blocks: DataFrame) -> DataFrame:
    """Add ``role``: main, other (small, faint, grey, near a corner) or caption. Blocks carry height,
    n_lines, contrast, chroma and along (place of the centre along its band, 0..1)."""
    area = F.col("height") * F.greatest(F.lit(1), F.col("n_lines"))
    top = blocks.groupBy("photo_id").agg(F.max(F.struct(area.alias("area"), F.col("contrast"), (-F.col("block")).alias("first"), F.col("height"))).alias("m"))
    df = blocks.join(top, "photo_id")
    is_main = F.col("block") == -F.col("m.first")
    corner = (F.col("along") < 0.25) | (F.col("along") > 0.75)
    faint = (F.col("height") <= 0.6 * F.col("m.height")) & (F.col("contrast") <= 0.7 * F.col("m.contrast")) & (F.col("chroma") <= 25)
    return df.select(*blocks.columns, F.when(is_main, "main").when(corner & faint, "other").otherwise("caption").alias("role"))


# -- measurements to a decision ------------------------------------------------------------------------


def scan_evidence(df: DataFrame) -> DataFrame:
    """Add ``score`` and ``cues``: how strongly a band looks like paper on a scan. A scanner shows in any of make, model and
    software that ``df`` has."""
    device = F.lower(F.concat_ws(" ", *[F.col(c) for c in ("make", "model", "software") if c in df.columns]))
    scanner = device.rlike("|".join(fixed.SCANNER_WORDS))
    high_dpi = ~scanner & (F.col("dpi") >= fixed.HIGH_DPI) & ~F.col("has_camera_tags")
    cues = [
        (F.abs("angle") >= fixed.TILT, 2.0, "tilted"),
        (F.col("edge_blur") >= fixed.SOFT_EDGE, 1.0, "soft edge"),
        (F.col("color_drift") >= fixed.DRIFT, 1.0, "lighting drift"),
        (F.col("noise") >= fixed.TEXTURE_NOISE, 1.5, "paper grain"),
        ((F.col("noise") >= fixed.FLAT_NOISE) & (F.col("noise") < fixed.TEXTURE_NOISE), 1.0, "grain"),
        (scanner, 2.0, "scanner"),
        (high_dpi, 0.5, "high dpi, no camera data"),
    ]
    score = F.lit(0.0)
    for cond, points, _ in cues:
        score = score + F.when(F.col("band_found") & cond, points).otherwise(0.0)
    names = text.reasons(*[(F.col("band_found") & cond, name) for cond, _, name in cues])
    return df.withColumns({"score": score, "cues": names})


def decide_case(df: DataFrame) -> DataFrame:
    """Add ``case``: A own output, B flat band with writing, C paper band with writing, D text over
    the photo only; NULL for none. A hidden marker proves a flat band, written on or not."""
    writing = F.col("reads_text") | F.col("looks_written")
    band = F.col("band_found") & (writing | F.col("has_marker"))
    case = (
        F.when(F.col("verified"), "A")
        .when(band & F.col("has_marker"), "B")
        .when(band & (F.col("score") >= fixed.SCAN_SCORE), "C")
        .when(band, "B")
        .when(F.col("text_over_photo"), "D")
    )
    return df.withColumn("case", case)


def weak_reads(lines: DataFrame) -> DataFrame:
    """Per photo: any caption line read below the limit."""
    return lines.groupBy("photo_id").agg((F.min("conf") < fixed.WEAK_READ).alias("weak"))


def edge_confidence(has_marker: Column, case: Column, confidence: Column) -> Column:
    """How sure the photo's edge is: certain with a marker, measured for a band case, else 0."""
    return F.when(has_marker, 1.0).when(case.isin("B", "C"), confidence).otherwise(0.0)
