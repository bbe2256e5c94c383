"""Language model scoring with a log-frequency Bloom filter.

Tokens are lower-cased words and one end per text. Word counts are exact; bigram counts live in a Bloom filter: a
bigram seen c times is inserted once per level 0 .. floor(log2 c), and a reader probes level after level until one is
missing, which gives the count rounded down to a power of two (or, rarely, a larger one). The filter lies in segments
by hash, one for each part of the counting, and grows with the corpus: no level is left out. Its load follows the corpus
too. A false answer gives a word SHARE / count(h) that no count backs, and any word of the vocabulary may get one, so false
answers have to become rarer as the vocabulary grows: ``hashes_for`` takes one more hash function with each doubling of the
vocabulary, and an entry has as many bits as this needs (34 at 170 MB of text), all segments together ``FILTER_BITS`` at least.
The filter is never gathered: its parts answer for it.

P(w | h) = (SHARE * count(h w) / count(h) + (1 - SHARE) * P(w)) / Z(h), P(w) = (c + 0.1) / (N + 0.1 (V + 1)); for an unseen
h it is P(w). Z(h) = 1 + SHARE * V * f / count(h) takes away what false answers add over all words together; f is the
rate of false answers, known from how full the segments are. So the words after h weigh 1 at most, in expectation (less by
what counts lose when they are rounded down).

Counting: each task counts the words and bigrams of its texts and sends them, packed, to the part of the hash range
they belong to. Scoring: texts are dealt into blocks of about ``BLOCK_BYTES``; a block asks the parts for the counts
of its different words and bigrams and gets them in the same order. So a frequent word or bigram costs one request a
block, and no task holds more than a block or a part. Words are told apart by 64-bit hashes. Where the texts to be scored
are also those to learn from, both are one: a block's requests say how often its training rows have what they ask for, a
part counts, builds its segment and answers from it, and its totals go to every block with the answers.

Defined results: a null text is the empty text (one token, the end); a null id is the text "" for the choice of
training rows and so held out; repeated rows count and are scored as often as they stand; with no training row
every count is 0; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import fixed, table, text_slices, utf8
from photocat.llm.shingles import MIX_1, STEP, mixed, word_hashes

FOLDS = 10
FILTER_BITS = 1 << 27
HASHES = 5
#: Bits of a bigram's hash that the filter knows it by.
KEY_BITS = 40
SHARE = 0.1
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20
START, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS, BIGRAMS = 1, 2
#: Different words and bigrams a task holds before it sends them.
HELD_KEYS = 1_000_000
#: Bigrams a task looks up at once.
PROBED_KEYS = 1 << 17


def hashes_for(text_bytes: int) -> int:
    """Hash functions for a corpus, so that false answers are ten times rarer than one in its different words. A text of so
    many bytes has about 60 times the square root of that, and not more than one in six bytes."""
    vocabulary = max(1.0, min(text_bytes / 6, 60 * text_bytes**0.5))
    return max(HASHES, min(KEY_BITS, int(np.ceil(np.log2(10 * vocabulary)))))


def bits_per_entry(hashes: int) -> int:
    """The load at which so many hash functions do best: half of all bits are set."""
    return -(-hashes * 100 // 69)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, index of the first token of each text and the number of tokens)"""
    words, first = word_hashes([t.translate(LOWER) for t in texts])
    counts = np.diff(first)
    out = np.full(len(words) + len(texts), END)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    return out, np.concatenate([[0], np.cumsum(counts + 1)])


def bigrams(tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of every token with the one before it in its text."""
    before = np.concatenate([[START], tok[:-1]]) if len(tok) else tok
    before[first[:-1]] = START
    return mixed(before * STEP + tok * MIX_1)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _parts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted keys, by their leading bits."""
    if not bits:
        return [(0, 0, len(keys))]
    at = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *at.tolist(), len(keys)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Tally:
    """Counts of keys, gathered in sorted arrays."""

    def __init__(self):
        self.waiting, self.n = [], 0

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.waiting.append((found, counts))
        self.n += len(found)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(*(np.concatenate(x) for x in zip(*self.waiting, strict=True))) if self.waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.waiting, self.n = [], 0
        return out


COUNT_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _short(keys: np.ndarray, bits: int) -> bytes:
    """The 40 bits of each key after those of its part."""
    return ((keys << np.uint64(bits)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int):
    """Rows of COUNT_SCHEMA. A bigram is short and has counts of a byte."""
    if kind == BIGRAMS:
        times = -(-counts // 255)
        keys = np.repeat(keys, times)
        full = np.full(len(keys), 255)
        full[np.cumsum(times) - 1] = counts - 255 * (times - 1)
        counts = full
    rows = []
    for p, a, b in _parts(keys, bits):
        if kind == BIGRAMS:
            rows.append((kind, p, _short(keys[a:b], bits), counts[a:b].astype(np.uint8).tobytes()))
        else:
            rows.append((kind, p, keys[a:b].astype("<u8").tobytes(), counts[a:b].astype("<u4").tobytes()))
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 64], strict=True), COUNT_SCHEMA, strict=True)], schema=COUNT_SCHEMA)


def _count_batches(batches, bits: int):
    tally = {WORDS: _Tally(), BIGRAMS: _Tally()}
    for part in text_slices(batches):
        tok, first = tokens(utf8(part.column("text")))
        tally[WORDS].add(tok)
        tally[BIGRAMS].add(bigrams(tok, first))
        for kind, t in tally.items():
            if t.n > HELD_KEYS:
                yield from _packed(kind, *t.take(), bits)
    for kind, t in tally.items():
        yield from _packed(kind, *t.take(), bits)


def _merge_part(rows: pa.Table) -> pa.Table:
    """All counts of one kind and part."""
    kind, part = rows.column("kind")[0].as_py(), rows.column("part")[0].as_py()
    raw = b"".join(rows.column("keys").to_pylist())
    if kind == BIGRAMS:
        keys, counts = _long(raw), np.frombuffer(b"".join(rows.column("counts").to_pylist()), dtype=np.uint8)
    else:
        keys, counts = np.frombuffer(raw, dtype="<u8"), np.frombuffer(b"".join(rows.column("counts").to_pylist()), dtype="<u4")
    return _merged_row(kind, part, keys, counts)


MERGED_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("types", pa.int64())])
KNOWN_SCHEMA = pa.schema([*MERGED_SCHEMA, ("bits", pa.binary()), ("false_rate", pa.float64())])


def _merged_row(kind: int, part: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    keys, counts = _summed(keys.astype(np.uint64), counts.astype(np.int64))
    total, types = int(counts.sum()), len(keys)
    return pa.table([[kind], [part], [keys.astype("<u8").tobytes()], [counts.astype("<u8").tobytes()], [total], [types]], schema=MERGED_SCHEMA)


def _merge_kind(rows: pa.Table, least: int, hashes: int) -> pa.Table:
    return _known(_merge_part(rows), least, hashes)


def _known(merged: pa.Table, least: int, hashes: int) -> pa.Table:
    """The counts of the words, or the filter's segment for the bigrams and its rate of false answers, of one part."""
    if merged.column("kind")[0].as_py() == WORDS:
        return pa.table([*merged.columns, pa.array([None], pa.binary()), pa.array([None], pa.float64())], schema=KNOWN_SCHEMA)
    entries = int((level(np.frombuffer(merged.column("counts")[0].as_py(), dtype="<u8")) + 1).sum())
    (segment,) = _segments(merged.to_batches(), segment_bits(entries, least, hashes), 0, hashes)
    bits = np.frombuffer(segment.column("bits")[0].as_py(), dtype=np.uint8)
    full = float(np.bitwise_count(bits).sum()) / (8 * len(bits))
    rate = full**hashes + merged.column("types")[0].as_py() / 2**KEY_BITS
    kept = merged.set_column(2, "keys", pa.array([None], pa.binary())).set_column(3, "counts", pa.array([None], pa.binary()))
    return pa.table([*kept.columns, segment.column("bits"), pa.array([rate])], schema=KNOWN_SCHEMA)


MERGED = "kind int, part int, keys binary, counts binary, total bigint, types bigint, bits binary, false_rate double"


def segment_bits(entries: int, least: int, hashes: int = HASHES) -> int:
    """Bits of a segment, whole bytes."""
    return -(-max(64, least, entries * bits_per_entry(hashes)) // 8) * 8


def level(counts: np.ndarray) -> np.ndarray:
    """floor(log2 count), exactly."""
    return np.frexp(counts.astype(np.float64))[1] - 1


def _slots(keys: np.ndarray, at: np.ndarray | int, size: int, hashes: int = HASHES):
    """The positions of each key's bits for a level, one array per hash function."""
    base = mixed(keys + np.asarray(at, dtype=np.uint64) * STEP)
    other = mixed(base) | np.uint64(1)
    for _ in range(hashes):
        yield (base % np.uint64(size)).astype(np.int64)
        base = base + other


def _segments(batches, size: int, lowest: int, hashes: int = HASHES):
    """The filter's segment of each part."""
    for batch in batches:
        for part, raw, counts in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            bits = np.zeros(size, dtype=bool)
            keys, top = np.frombuffer(raw, dtype="<u8"), level(np.frombuffer(counts, dtype="<u8"))
            at = lowest
            while len(keys := keys[top >= at]):
                top = top[top >= at]
                for slot in _slots(keys, at, size, hashes):
                    bits[slot] = True
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])


def probe(filter_bits: np.ndarray, hashes: np.ndarray, part_bits: int, size: int, lowest: int, functions: int = HASHES) -> np.ndarray:
    """Counts of bigrams as powers of two, 0 where the lowest level is missing."""
    part = (hashes >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(hashes), dtype=np.int64)
    keys = (hashes << np.uint64(part_bits)) >> np.uint64(24)
    out = np.zeros(len(hashes))
    open_at, at = np.arange(len(hashes)), lowest
    while len(open_at):
        # those that miss a bit go at once, so that absent ones cost few probes
        slot = mixed(keys[open_at] + np.array([at], dtype=np.uint64) * STEP)
        step, base = mixed(slot) | np.uint64(1), part[open_at] * (size // 8)
        for _ in range(functions):
            place = (slot % np.uint64(size)).astype(np.int64)
            has = (filter_bits[base + (place >> 3)] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            if has.all():
                slot = slot + step
            else:
                open_at, step, base, slot = open_at[has], step[has], base[has], slot[has] + step[has]
        out[open_at] = 2.0**at
        at += 1
    return out


class Model:
    """What scoring needs: totals, and by part the exact word counts and the filter's segments."""

    def __init__(self, merged: DataFrame, part_bits: int, hashes: int):
        self.part_bits, self.hashes = part_bits, hashes
        words = F.col("kind") == WORDS
        total = merged.filter(words).agg(F.sum("total"), F.sum("types")).first()
        self.n, self.v = int(total[0] or 0), int(total[1] or 0)
        self.false_rate = merged.agg(F.avg("false_rate")).first()[0] or 0.0
        self.parts = merged.select("part", "keys", "counts", "bits")


def model_size(text_bytes: int) -> tuple[int, int]:
    """(leading bits of a hash that name its part, hash functions)"""
    return max(3, (text_bytes // PART_BYTES).bit_length()), hashes_for(text_bytes)


def train(docs: DataFrame, text_bytes: int, filter_bits: int = FILTER_BITS) -> Model:
    """Count words and bigrams of all rows of ``docs`` and build the filter."""
    bits, hashes = model_size(text_bytes)
    rows = docs.select("text").mapInArrow(lambda b: _count_batches(b, bits), "kind int, part int, keys binary, counts binary")
    return Model(fixed(rows.groupBy("kind", "part").applyInArrow(lambda t: _merge_kind(t, filter_bits >> bits, hashes), MERGED)), bits, hashes)


def _requests(rows: pa.Table, bits: int) -> pa.Table:
    tok, first = tokens(utf8(rows.column("text").combine_chunks()))
    block = rows.column("block")[0].as_py()
    keys, pairs = np.unique(tok), np.unique(bigrams(tok, first))
    words = {p: keys[a:b].astype("<u8").tobytes() for p, a, b in _parts(keys, bits)}
    twos = {p: _short(pairs[a:b], bits) for p, a, b in _parts(pairs, bits)}
    parts = sorted(words.keys() | twos.keys())
    columns = [pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), *(pa.array([x.get(p, b"") for p in parts], pa.binary()) for x in (words, twos))]
    return pa.table(columns, names=["part", "block", "words", "bigrams"])


def _answers(asked: pa.Table, known: pa.Table, hashes: int) -> pa.Table:
    """For each request the counts of its words (in four bytes each where they fit), and for its bigrams a byte each: 0, or one
    more than the highest level."""
    joined = lambda c: b"".join(x or b"" for x in known.column(c).to_pylist())
    keys, counts, bits = np.frombuffer(joined("keys"), dtype="<u8"), np.frombuffer(joined("counts"), dtype="<u8"), np.frombuffer(joined("bits"), dtype=np.uint8)
    of_words, of_bigrams, wide = [], [], []
    # a bigram that several blocks ask for is looked up once
    shorts = asked.column("bigrams").to_pylist()
    pairs, at = np.unique(_long(b"".join(shorts)), return_inverse=True)
    slices = [pairs[k : k + PROBED_KEYS] << np.uint64(24) for k in range(0, len(pairs), PROBED_KEYS)]
    found = np.concatenate([np.zeros(0), *(probe(bits, x, 0, len(bits) * 8, 0, hashes) if len(bits) else np.zeros(len(x)) for x in slices)])
    levels = np.frexp(found)[1].astype(np.uint8)[at]
    ends = np.cumsum([len(short) // 5 for short in shorts])
    for raw, short, end in zip(asked.column("words").to_pylist(), shorts, ends.tolist(), strict=True):
        want = np.frombuffer(raw, dtype="<u8")
        at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        told = np.where(keys[at] == want, counts[at], 0) if len(keys) else np.zeros(len(want))
        wide.append(bool(told.max(initial=0) >= 1 << 32))
        of_words.append(told.astype("<u8" if wide[-1] else "<u4").tobytes())
        of_bigrams.append(levels[end - len(short) // 5 : end].tobytes())
    return pa.table([asked.column("block"), asked.column("part"), pa.array(of_words, pa.binary()), pa.array(of_bigrams, pa.binary()), pa.array(wide)], names=["block", "part", "counts", "levels", "wide"])


def _counts_packed(counts: np.ndarray) -> bytes:
    """A byte each; those of 255 and more follow in eight."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _counts_read(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw[:n], dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], dtype="<u8")
    return counts


def _counted_requests(rows: pa.Table, bits: int) -> pa.Table:
    """A block's requests to every part, and how often the block's training rows have what it asks for."""
    tok, first = tokens(utf8(rows.column("text").combine_chunks()))
    trained = np.repeat(~rows.column("held_out").to_numpy().astype(bool), np.diff(first))
    parts, block, columns = range(1 << bits), rows.column("block")[0].as_py(), []
    for keys, packed in ((tok, lambda k: k.astype("<u8").tobytes()), (bigrams(tok, first), lambda k: _short(k, bits))):
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at[trained], minlength=len(keys))
        sent = {p: (packed(keys[a:b]), _counts_packed(counts[a:b])) for p, a, b in _parts(keys, bits)}
        columns += [pa.array([sent.get(p, (b"", b""))[k] for p in parts], pa.binary()) for k in (0, 1)]
    return pa.table([pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), *columns], names=["part", "block", "words", "word_counts", "bigrams", "bigram_counts"])


def _learned_answers(asked: pa.Table, least: int, hashes: int) -> pa.Table:
    """A part's answers, learned from the counts that came with the requests, and its totals."""
    part, known = asked.column("part")[0].as_py(), {}
    for kind, column, read in ((WORDS, "word", lambda raw: np.frombuffer(raw, dtype="<u8")), (BIGRAMS, "bigram", _long)):
        keys = [read(raw) for raw in asked.column(f"{column}s").to_pylist()]
        counts = np.concatenate([_counts_read(raw, len(k)) for raw, k in zip(asked.column(f"{column}_counts").to_pylist(), keys, strict=True)])
        if (seen := counts > 0).any():
            known[kind] = _known(_merged_row(kind, part, np.concatenate(keys)[seen], counts[seen]), least, hashes)
    told = _answers(asked, pa.concat_tables([KNOWN_SCHEMA.empty_table(), *known.values()]), hashes)
    said = lambda kind, column, none: known[kind].column(column)[0].as_py() if kind in known else none
    for name, value, kind in (("total", said(WORDS, "total", 0), pa.int64()), ("types", said(WORDS, "types", 0), pa.int64()), ("false_rate", said(BIGRAMS, "false_rate", None), pa.float64())):
        told = told.append_column(name, pa.array([value] * told.num_rows, kind))
    return told


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_tokens(tok: np.ndarray, first: np.ndarray, c: np.ndarray, n: int, v: int, bigram_counts: np.ndarray, false_rate: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score, score) of each text; ``c``: count of each token; ``false_rate``: how often the filter
    answers for a bigram that it does not hold."""
    sums = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
    p = (c + 0.1) / (n + 0.1 * (v + 1))
    before = np.concatenate([[0], c[:-1]]) if len(c) else c
    before[first[:-1]] = c[first[1:] - 1]  # a text's start has been seen as often as the end
    joint = np.minimum(bigram_counts, before)
    seen = np.maximum(before, 1)
    mixed_p = np.where(before > 0, (SHARE * joint / seen + (1 - SHARE) * p) / (1 + SHARE * v * false_rate / seen), p)
    return np.diff(first), sums((c > 0).astype(np.int64)), sums(np.log10(p)), sums(np.log10(mixed_p))


def _scored(texts: pa.Table, counts: pa.Table, n: int, v: int, false_rate: float) -> pa.Table:
    """The scores of a block's texts from what the parts told it, in their order."""
    tok, first = tokens(utf8(texts.column("text").combine_chunks()))
    keys, at = np.unique(tok, return_inverse=True)
    each = zip(counts.column("counts").to_pylist(), counts.column("wide").to_pylist(), strict=True)
    c = np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(raw, dtype="<u8" if w else "<u4").astype(np.int64) for raw, w in each)])
    pairs, pair_at = np.unique(bigrams(tok, first), return_inverse=True)
    levels = np.frombuffer(b"".join(counts.column("levels").to_pylist()), dtype=np.uint8)
    if len(c) != len(keys) or len(levels) != len(pairs):
        raise ValueError("the answers do not fit the block")
    found = np.where(levels > 0, 2.0 ** (levels.astype(np.int64) - 1), 0)
    n_tokens, n_known, base, got = score_tokens(tok, first, c[at], n, v, found[pair_at], false_rate)
    return pa.table([texts.column("doc_id"), texts.column("held_out"), *(pa.array(x) for x in (n_tokens, n_known, np.full(len(n_tokens), n), base, got))], schema=SCORE_SCHEMA)


def _blocks(docs: DataFrame, text_bytes: int) -> DataFrame:
    blocks = max(1, -(-text_bytes // BLOCK_BYTES))
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))


def score(docs: DataFrame, model: Model, text_bytes: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    bits, n, v, hashes, false_rate = model.part_bits, model.n, model.v, model.hashes, model.false_rate
    rows = _blocks(docs, text_bytes)
    asked = rows.groupBy("block").applyInArrow(lambda t: _requests(t, bits), "part int, block bigint, words binary, bigrams binary")
    told = asked.groupBy("part").cogroup(model.parts.groupBy("part")).applyInArrow(lambda a, b: _answers(a, b, hashes), "block bigint, part int, counts binary, levels binary, wide boolean")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, c: _scored(t, c.sort_by("part"), n, v, false_rate), SCORED)


def train_and_score(docs: DataFrame, text_bytes: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``score`` of all rows under the model that ``train`` makes of those not held out. Every block sends its counts along with
    its requests, to every part, so bigrams travel once and neither they nor the filter are stored in between."""
    bits, hashes = model_size(text_bytes)
    rows = _blocks(docs, text_bytes)
    asked = rows.groupBy("block").applyInArrow(lambda t: _counted_requests(t, bits), "part int, block bigint, words binary, word_counts binary, bigrams binary, bigram_counts binary")
    told = asked.groupBy("part").applyInArrow(lambda t: _learned_answers(t, filter_bits >> bits, hashes), "block bigint, part int, counts binary, levels binary, wide boolean, total bigint, types bigint, false_rate double")

    def scored(texts: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("part")
        n, v = (int(counts.column(c).to_numpy().sum()) for c in ("total", "types"))
        rates = counts.column("false_rate").drop_null().to_numpy()
        return _scored(texts, counts, n, v, float(rates.mean()) if len(rates) else 0.0)

    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, SCORED)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return train_and_score(docs, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
