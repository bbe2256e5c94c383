"""Context-triggered piecewise hashing: fingerprints of whole texts that stay alike where the texts do.

A hash rolls over the last WINDOW bytes. Where it ends in enough zero bits a chunk ends, so a boundary depends on the bytes
before it alone and comes back wherever these bytes do. The zero bits asked for set the block size: 4, 8, 16 ... bytes a
chunk on average. A text takes the smallest block size at which it has at most MAX_CHUNKS chunks (what is left after the last
boundary is a chunk too), and is written twice, at this size and at the next: ``size:chunks:chunks of twice the size``, each
chunk as two of 64 characters (12 bits of a hash over all its bytes). So every byte of a text counts, however long it is.

Two fingerprints are compared at block sizes they share (equal, or one twice the other) by the number of chunks to
insert or delete to turn one into the other: likeness = 1 - edits / all chunks, the best of the shared sizes; 0 where they
share none. Equal fingerprints have likeness 1, also those of two empty texts.

Everything is computed over slices of texts side by side: hashes by shifted sums and by prefix sums modulo 2 ** 64, edits by
the bits of a 64-bit word a pair.

The edited text of a document needs the document after it in the order of ids. Ranges of ids are found from ids and hashes
alone; then texts are shuffled once, into those ranges, the first row of each range also into the range before it, and a
task reads its rows in order, holding one of them.

Defined results: null texts are empty; an empty text has the fingerprint ``4::``; null ids come first, rows with equal ids
stand in the order of a hash of their text (repeated rows follow each other); the row after the last is the first, so a single
row follows itself; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.functions.groups import in_ranges
from photocat.llm.common import table, text_slices, utf8

WINDOW = 7
MAX_CHUNKS = 64
#: Bits that a window's hash ends in at the smallest block size.
FIRST_BITS = 2
LEVELS = 40
#: Bytes hashed at once.
STEP = 1 << 20

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)
_DIGITS = np.array([c.encode() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
_PAIRS = np.char.add(_DIGITS[:, None], _DIGITS[None, :]).ravel()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, STEP)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _raised(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2 ** 64."""
    out, square = np.ones(len(exponents), dtype=np.uint64), base
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        out[(exponents >> bit) & 1 == 1] *= np.uint64(square)
        square = square * square & _M
    return out


def _zeros(h: np.ndarray) -> np.ndarray:
    """The zero bits each number ends in."""
    low = h & (~h + np.uint64(1))
    return np.where(h == 0, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64)


class _Sums:
    """Boundaries and prefix hashes of one long run of bytes, read in steps."""

    def __init__(self, data: np.ndarray, marks: np.ndarray):
        ends, zeros, at_ends, at_marks = [], [], [], np.zeros(len(marks), dtype=np.uint64)
        carry, scale = 0, 1
        for start in range(0, len(data), STEP):
            now = data[start : start + STEP]
            h = np.zeros(len(now), dtype=np.uint64)
            for back in range(WINDOW):
                part = data[max(0, start - back) : max(0, start - back + len(now))].astype(np.uint64)
                h[len(h) - len(part) :] += (part + np.uint64(1)) * _ROLL[back]
            h = _mix(h)
            hit = np.flatnonzero(h & np.uint64((1 << FIRST_BITS) - 1) == 0)
            sums = np.cumsum((now.astype(np.uint64) + np.uint64(1)) * _UP[: len(now)]) * np.uint64(scale) + np.uint64(carry)
            ends.append(hit + start + 1)
            zeros.append(_zeros(h[hit]))
            at_ends.append(sums[hit])
            here = np.flatnonzero((marks > start) & (marks <= start + len(now)))
            at_marks[here] = sums[marks[here] - start - 1]
            carry, scale = int(sums[-1]), scale * int(_UP[-1]) * _BASE & _M
        self.ends = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        self.zeros = np.concatenate(zeros) if zeros else np.zeros(0, dtype=np.int64)
        self.at_ends = np.concatenate(at_ends) if at_ends else np.zeros(0, dtype=np.uint64)
        self.at_marks = at_marks


class Prints:
    """Fingerprints of several texts: ``level`` of each, and its chunks (12 bits each, -1 behind the last) at this block size and
    at the next: arrays (texts, MAX_CHUNKS)."""

    def __init__(self, level: np.ndarray, chunks: tuple[np.ndarray, np.ndarray]):
        self.level, self.chunks = level, chunks

    def __len__(self) -> int:
        return len(self.level)

    def take(self, which) -> Prints:
        return Prints(self.level[which], (self.chunks[0][which], self.chunks[1][which]))

    @staticmethod
    def joined(parts: list[Prints]) -> Prints:
        return Prints(np.concatenate([p.level for p in parts]), tuple(np.concatenate([p.chunks[k] for p in parts]) for k in (0, 1)))

    def written(self) -> list[str]:
        rows = zip((1 << (self.level + FIRST_BITS)).tolist(), *self.chunks, strict=True)
        text = lambda c: b"".join(_PAIRS[c[c >= 0]].tolist()).decode()
        return [f"{size}:{text(one)}:{text(two)}" for size, one, two in rows]


def parsed(texts: list[str]) -> Prints:
    """Fingerprints as they were written."""
    level = np.zeros(len(texts), dtype=np.int64)
    chunks = (np.full((len(texts), MAX_CHUNKS), -1, dtype=np.int16), np.full((len(texts), MAX_CHUNKS), -1, dtype=np.int16))
    value = {d: k for k, d in enumerate(_DIGITS.tolist())}
    for row, text in enumerate(texts):
        size, *both = text.encode().split(b":")
        level[row] = int(size).bit_length() - 1 - FIRST_BITS
        for out, s in zip(chunks, both, strict=True):
            codes = [value[s[k : k + 1]] << 6 | value[s[k + 1 : k + 2]] for k in range(0, len(s), 2)]
            out[row, : len(codes)] = codes
    return Prints(level, chunks)


def prints(texts: list[bytes]) -> Prints:
    n, gap = len(texts), bytes(WINDOW - 1)
    data = np.frombuffer(b"".join(x for t in texts for x in (gap, t)), dtype=np.uint8)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
    stop = np.cumsum(sizes + len(gap))
    start = stop - sizes
    sums = _Sums(data, np.concatenate([start, stop]))
    of = np.searchsorted(stop, sums.ends)  # the text a boundary lies in; an end at ``stop`` is its own text's
    inside = (of < n) & (sums.ends > start[np.minimum(of, n - 1)])
    of, ends, at_ends = of[inside], sums.ends[inside], sums.at_ends[inside]
    height = np.minimum(sums.zeros[inside] - FIRST_BITS, LEVELS)
    counts = np.bincount(of * (LEVELS + 1) + height, minlength=n * (LEVELS + 1)).reshape(n, LEVELS + 1)
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # boundaries at each block size
    fits = counts < MAX_CHUNKS
    level = np.where(fits.any(axis=1), fits.argmax(axis=1), LEVELS).astype(np.int64)
    return Prints(level, tuple(_chunks(level + up, of, height, ends, at_ends, start, stop, sums.at_marks) for up in (0, 1)))


def _chunks(level, of, height, ends, at_ends, start, stop, at_marks) -> np.ndarray:
    """The chunk hashes of each text where boundaries have at least its ``level``."""
    n = len(level)
    used = height >= np.minimum(level, LEVELS)[of]
    tail = np.flatnonzero(stop > start)
    # each text's boundaries and its end, which may be a boundary itself
    doc, end, upto = np.concatenate([of[used], tail]), np.concatenate([ends[used], stop[tail]]), np.concatenate([at_ends[used], at_marks[n:][tail]])
    order = np.lexsort((end, doc))
    doc, end, upto = doc[order], end[order], upto[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (end[1:] != end[:-1])][: len(doc)]
    doc, end, upto = doc[new], end[new], upto[new]
    first = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
    begin = np.where(first, start[doc], np.r_[0, end[:-1]][: len(doc)])
    before = np.where(first, at_marks[:n][doc], np.r_[np.uint64(0), upto[:-1]][: len(doc)])
    value = _mix((upto - before) * _raised(_INVERSE, begin) + (end - begin).astype(np.uint64)) >> np.uint64(52)
    place = np.arange(len(doc)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(doc) else np.zeros(0, dtype=np.int64)
    out = np.full((n, MAX_CHUNKS), -1, dtype=np.int16)
    # boundaries at every place of a text (bytes that repeat) leave more chunks than fit at the largest size: the last ones are summed up
    kept = place < MAX_CHUNKS
    out[doc[kept], place[kept]] = value[kept]
    for k in np.flatnonzero(~kept):
        out[doc[k], -1] = (int(out[doc[k], -1]) * 31 + int(value[k])) % 4096
    return out


def _common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each pair of rows."""
    out = []
    for k in range(0, len(one), 256):
        a, b = one[k : k + 256], two[k : k + 256]
        match = (a[:, None, :] == b[:, :, None]) & (b >= 0)[:, :, None]
        match = np.packbits(match, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
        open_ = np.full(len(a), _M, dtype=np.uint64)
        for col in range(match.shape[1]):
            step = open_ & match[:, col]
            open_ = (open_ + step) | (open_ - step)
        out.append(MAX_CHUNKS - np.unpackbits(open_.view(np.uint8).reshape(len(a), 8), axis=1).sum(axis=1))
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def _alike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    total = (one >= 0).sum(axis=1) + (two >= 0).sum(axis=1)
    return np.where(total == 0, 1.0, 2 * _common(one, two) / np.maximum(total, 1))


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """How alike the fingerprints of each pair are, 0 to 1."""
    out, apart = np.zeros(len(a)), a.level - b.level
    for gap, pairs in ((0, ((0, 0), (1, 1))), (1, ((0, 1),)), (-1, ((1, 0),))):
        rows = np.flatnonzero(apart == gap)
        for i, j in pairs:
            out[rows] = np.maximum(out[rows], _alike(a.chunks[i][rows], b.chunks[j][rows]))
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of a text column."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        return pa.array([p for part in text_slices([batch]) for p in prints(utf8(part.column("text"))).written()], pa.string())

    return docs.withColumn(name, of(F.coalesce(F.col(text), F.lit(""))))


def likeness_of(one: Column, two: Column) -> Column:
    """The likeness of two fingerprint columns."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(likeness(parsed(a.to_pylist()), parsed(b.to_pylist())), pa.float64())

    return of(one, two)


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``next_only``, in partitions of neighbouring ids, in order; the last row of each partition is the first
    of the next one (of the first one, in the end), and there for its text only."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    firsts = in_ranges(rows.select("doc_id", "tie"), [], [F.col("doc_id").asc_nulls_first(), F.col("tie")], n).groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("k"))
    # one row a partition: the bounds, not the data
    bounds = sorted((r.k.known, r.k.doc_id or 0, r.k.tie) for r in firsts.collect())

    @F.udf("array<struct<part:int,next_only:boolean>>", useArrow=True)
    def parts_of(doc_id, tie):
        key = (doc_id is not None, doc_id or 0, tie)
        part = bisect.bisect_right(bounds, key) - 1
        return [(part, False)] + ([((part - 1) % len(bounds), True)] if bounds[part] == key else [])

    placed = rows.withColumn("p", F.explode(parts_of("doc_id", "tie"))).select("doc_id", "text", "tie", "p.part", "p.next_only")
    return placed.repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions("part", "next_only", F.col("doc_id").asc_nulls_first(), "tie")


EDITED = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    held = None  # (doc_id, text, part, next_only, prints) of the row whose next one has not come yet
    for batch in text_slices(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        part, next_only = batch.column("part").to_pylist(), batch.column("next_only").to_pylist()
        own = prints([t.encode() for t in texts])
        if held is not None:
            ids, texts, part, next_only = [held[0], *ids], [held[1], *texts], [held[2], *part], [held[3], *next_only]
            own = Prints.joined([held[4], own])
        here = np.array([k for k in range(len(ids) - 1) if not next_only[k] and part[k] == part[k + 1]], dtype=np.int64)
        cut = lambda k: len(texts[k]) // 2
        edited = [texts[k][: len(texts[k]) - cut(k)] + texts[k + 1][: cut(k)] for k in here.tolist()]
        theirs = prints([t.encode() for t in edited])
        mine, after = own.take(here), own.take(here + 1)
        if len(here):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in here.tolist()], pa.int64()), pa.array([len(texts[k]) for k in here.tolist()], pa.int64()), pa.array(edited, pa.string()),
                    pa.array(mine.written(), pa.string()), pa.array(theirs.written(), pa.string()), pa.array(likeness(mine, theirs)), pa.array(likeness(mine, after)),
                ],
                names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        held = (ids[-1], texts[-1], part[-1], next_only[-1], own.take(slice(len(own) - 1, None)))


def edited(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) with its half replaced by the start of the next one, both fingerprints, and how alike the
    document is to its edited text and to the next document."""
    return _in_order(docs).mapInArrow(_pairs, EDITED)


def op11_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
