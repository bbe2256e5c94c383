"""Byte-level BPE: encoding whole texts to ids and decoding ids to bytes.

Pre-tokenisation uses no regular expressions. A batch of texts becomes one array of code points, each mapped to a
class (letter, digit, space, other). A small automaton over these classes knows where a piece starts. Its steps are
functions from state to state, and composing functions is associative, so the states of all positions come from a
scan: rows of the array are composed side by side, the rows' functions are combined by doubling, and a last sweep
reads off the boundaries. The slices between boundaries are merged pair by pair once and then found in a cache.

The ids of a text are kept packed (unsigned 32-bit, little-endian), and so is ``ends``: the byte offset in the text
at which each token ends. Decoding places the tokens' bytes at these offsets.

Defined results: a null text is the empty text and has no ids; repeated rows and ids are handled row by row; an empty
table gives no rows; further columns are kept, those named ``ids`` and ``ends`` are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from photocat.llm.common import table, text_slices, utf8, with_columns

#: Merged pieces a worker remembers, and those of one slice more; the cache changes no result.
CACHE_PIECES = 250_000
#: Texts are cut into pieces in slices of about so many bytes, as the pieces of a slice take many times its size.
SLICE = 1 << 20
#: Pieces of more bytes are merged one by one.
LONG_PIECE = 100
NO_RANK = np.uint64(1 << 40)
NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)

# Classes of a position. Blanks are told apart by whether text follows; apostrophes by the letters that follow.
LETTER, DIGIT, OTHER, BLANK_INNER, SPACE_LAST, BLANK_LAST, APOSTROPHE_1, APOSTROPHE_2, N_CLASSES = range(9)
# What was read before a position. CUT: a piece ended. LEFT_n: n letters of a contraction are still to come.
CUT, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_SPACE, IN_BLANKS, LEFT_1, LEFT_2, N_STATES = range(9)
FIRST = 16  # added to the class of a text's first position: the state before it counts as CUT

#: White space of the Unicode standard, and the letters after an apostrophe that belong to it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SUFFIX_1 = "stmd"
SUFFIX_2 = ("re", "ve", "ll")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts here), each indexed by class * 16 + state."""
    to = np.zeros((2 * FIRST, 16), dtype=np.uint8)
    starts = np.zeros((2 * FIRST, 16), dtype=bool)
    run = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER}
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            if c in run:
                to[c, s], starts[c, s] = run[c], s not in (run[c], AFTER_SPACE, LEFT_1, LEFT_2)
                if c == LETTER and s in (LEFT_1, LEFT_2):
                    to[c, s] = CUT if s == LEFT_1 else LEFT_1
            elif c in (APOSTROPHE_1, APOSTROPHE_2):
                inside = s in (IN_OTHER, AFTER_SPACE)  # the run goes on, and the apostrophe is part of it
                to[c, s] = IN_OTHER if inside else LEFT_1 if c == APOSTROPHE_1 else LEFT_2
                starts[c, s] = not inside
            elif c == BLANK_INNER:
                to[c, s], starts[c, s] = IN_BLANKS, s != IN_BLANKS
            else:  # the last blank before text always starts a piece; a space takes the text with it
                to[c, s], starts[c, s] = AFTER_SPACE if c == SPACE_LAST else CUT, True
    to[FIRST:, :] = to[:FIRST, CUT : CUT + 1]
    starts[FIRST:, :] = starts[:FIRST, CUT : CUT + 1]
    return to.ravel(), starts.ravel()


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of every code point, next state, start of a piece)"""
    kinds = {"L": LETTER, "N": DIGIT}
    classes = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], dtype=np.uint8)
    classes[[ord(c) for c in WHITE]] = BLANK_INNER
    return classes, *_automaton()


def _classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each position; ``first`` marks the texts' first positions."""
    kind = _tables()[0][points]
    after = np.append(first[1:], True)  # the next position belongs to another text
    blank = kind == BLANK_INNER
    last = blank & ~after & ~np.append(blank[1:], True)
    kind[last] = np.where(points[last] == 32, SPACE_LAST, BLANK_LAST)
    for at in np.flatnonzero(points == 39):
        text = points[at + 1 : at + 3]
        inside = [not first[at + 1 + k] for k in range(len(text))]
        one = chr(text[0]) if len(text) and inside[0] else ""
        two = one + chr(text[1]) if one and len(text) > 1 and inside[1] else one
        if one and one in SUFFIX_1:
            kind[at] = APOSTROPHE_1
        elif two in SUFFIX_2:
            kind[at] = APOSTROPHE_2
    return kind + FIRST * first.astype(np.uint8)


def piece_starts(points: np.ndarray, first: np.ndarray, width: int = 64) -> np.ndarray:
    """Positions at which a piece starts, by a scan over transition functions."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    _, to, starts = _tables()
    rows = -(-len(points) // width)
    kind = np.zeros(rows * width, dtype=np.uint16)
    kind[: len(points)] = _classes(points, first)
    kind = np.ascontiguousarray(kind.reshape(rows, width).T) << 4
    # each row's function: the state after it for every state before it
    f = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for k in range(width):
        f = to[kind[k][:, None] + f]
    # functions of all rows up to each one, by doubling: later after earlier
    step = 1
    while step < rows:
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([[CUT], f[:-1, CUT]]).astype(np.uint16)
    out = np.empty((width, rows), dtype=bool)
    for k in range(width):
        at = kind[k] + state
        out[k] = starts[at]
        state = to[at].astype(np.uint16)
    return np.flatnonzero(out.T.reshape(-1)[: len(points)])


class Ranks:
    """The vocabulary of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for t, r in self.rank.items():
            token[r] = t
        self.length = np.array([len(t) for t in token], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.pieces: dict[bytes, bytes] = {}  # packed ids of pieces seen

    @functools.cached_property
    def single(self) -> np.ndarray:
        return np.array([self.rank.get(bytes([b]), 0) for b in range(256)], dtype=np.uint64)

    @functools.cached_property
    def pairs(self) -> _Lookup:
        """The merged id of two adjacent ids."""
        rank = self.rank
        found = {(rank[t[:i]] << 32) | rank[t[i:]]: r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        return _Lookup(np.array(list(found), dtype=np.uint64), np.array(list(found.values()), dtype=np.uint64))

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of every piece, merged once and then remembered."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        found = self.pieces
        short = []
        for p in set(pieces).difference(found):
            if (whole := self.rank.get(p)) is not None:
                found[p] = whole.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                found[p] = np.array(_merged_long(p, self.rank), dtype="<u4").tobytes()
            else:
                short.append(p)
        if short:
            found.update(zip(short, merged(short, self), strict=True))
        return list(map(found.__getitem__, pieces))


class _Lookup:
    """Values of 64-bit keys in an open table, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, NO_KEY)
        self.values = np.full(1 << self.bits, NO_RANK)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == NO_KEY
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], NO_RANK)
        again = np.flatnonzero((got != keys) & (got != NO_KEY))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[again]]
            hit = got == keys[again]
            out[again[hit]] = self.values[at[again[hit]]]
            again = again[~hit & (got != NO_KEY)]
        return out


def merged(pieces: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """Packed ids of pieces, all merged side by side: in each round every piece that still has a pair with a rank
    merges its pair of lowest rank, the leftmost of equal ones."""
    out = [b""] * len(pieces)
    ids = vocabulary.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    owner = np.repeat(np.arange(len(pieces)), size)
    rank = np.full(len(ids), NO_RANK)  # of a position and the next one
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner] = vocabulary.pairs((ids[inner] << np.uint64(32)) | ids[inner + 1])
    while len(ids):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        best = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(ids)))
        if (best == NO_RANK).any():  # these pieces are done
            done = np.repeat(best == NO_RANK, size)
            flat = ids[done].astype("<u4").tobytes()
            ends = np.cumsum(size[best == NO_RANK]).tolist()
            for k, x, y in zip(owner[first[best == NO_RANK]].tolist(), [0, *ends], ends, strict=False):
                out[k] = flat[4 * x : 4 * y]
            ids, owner, rank = ids[~done], owner[~done], rank[~done]
            size, best = size[best != NO_RANK], best[best != NO_RANK]
            if not len(ids):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        hit = hit[np.diff(owner[hit], prepend=-1) != 0]
        ids[hit] = best
        keep = np.ones(len(ids), dtype=bool)
        keep[hit + 1] = False
        ids, owner, rank = ids[keep], owner[keep], rank[keep]
        at = hit - np.arange(len(hit))  # where the merged ids stand now
        rank[at] = NO_RANK
        for left in (at[: len(at) - (len(at) > 0 and at[-1] == len(ids) - 1)], at[at > 0] - 1):
            left = left[owner[left] == owner[left + 1]]
            rank[left] = vocabulary.pairs((ids[left] << np.uint64(32)) | ids[left + 1])
    return out


def _merged_long(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one long piece; its pairs are kept in a heap, so that the cost grows little faster than the length."""
    n = len(piece)
    end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n

    def pair(i: int):
        j = end[i]
        r = rank.get(piece[i : end[j]]) if j < n else None
        return None if r is None else (r, i, end[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        if gone[i] or (j := end[i]) >= n or end[j] != upto:
            continue  # one of the two has changed meanwhile
        gone[j], end[i] = True, upto
        if upto < n:
            before[upto] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_texts(texts: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """Packed ids of UTF-8 texts."""
    joined = b"".join(texts)
    points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), dtype="<u4")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(width)])  # byte offset of each code point
    ends = np.cumsum([len(t) for t in texts])
    text_at = np.searchsorted(offset, np.concatenate([[0], ends]))  # first code point of each text
    first = np.zeros(len(points) + 1, dtype=bool)
    first[text_at] = True
    cuts = piece_starts(points, first[:-1])
    piece_of_text = np.searchsorted(cuts, text_at).tolist()
    at = offset[cuts].tolist() + [len(joined)]
    ids = vocabulary.packed([joined[a:b] for a, b in zip(at, at[1:], strict=False)])
    return [b"".join(ids[a:b]) for a, b in zip(piece_of_text, piece_of_text[1:], strict=False)]


def token_ends(ids: bytes, vocabulary: Ranks) -> bytes:
    """Packed byte offsets at which the tokens end."""
    return np.cumsum(vocabulary.length[np.frombuffer(ids, dtype="<u4")]).astype("<u4").tobytes()


def decode_ids(ids: bytes, ends: bytes, vocabulary: Ranks) -> bytes:
    """The bytes of the tokens, each placed so that it ends at its offset."""
    token = np.frombuffer(ids, dtype="<u4")
    end = np.frombuffer(ends, dtype="<u4").astype(np.int64)
    length = vocabulary.length[token]
    if not len(token):
        return b""
    if len(end) != len(token) or (np.diff(end, prepend=0) != length).any():
        raise ValueError("the offsets do not fit the ids")
    source = np.repeat(vocabulary.start[token] - (end - length), length) + np.arange(end[-1])
    return vocabulary.bytes[source].tobytes()


def _typed(df: DataFrame, drop: tuple[str, ...], extra: str) -> str:
    return ", ".join([f"`{f.name}` {_kind(f.dataType)}" for f in df.schema if f.name not in drop] + [extra])


def _kind(t) -> str:
    return t.simpleString()


def _encode_batches(batches, path: str):
    v = ranks(path)
    for part in text_slices(batches, max_bytes=SLICE):
        ids = encode_texts(utf8(part.column("text")), v)
        ends = [token_ends(x, v) for x in ids]
        yield with_columns(part, ("text",), ids=pa.array(ids, pa.binary()), ends=pa.array(ends, pa.binary()))
    v.pieces = {}  # workers live on after a task


def _decode_batches(batches, path: str):
    v = ranks(path)
    for part in text_slices(batches, "ids", SLICE):
        got = [decode_ids(a or b"", b or b"", v) for a, b in zip(part.column("ids").to_pylist(), part.column("ends").to_pylist(), strict=True)]
        yield with_columns(part, ("ends",), bytes=pa.array(got, pa.binary()))


def _digest_batches(batches):
    sha = lambda c: pa.array([hashlib.sha256(x).hexdigest() for x in c.to_pylist()])
    for part in batches:
        ids = part.column("ids")
        yield with_columns(part, ("bytes",), n_tokens=pa.array([len(x) // 4 for x in ids.to_pylist()], pa.int64()), ids_sha256=sha(ids), decoded_sha256=sha(part.column("bytes")))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The rows with ``ids`` and ``ends`` in place of ``text``. ``path``: rank file, present on every worker."""
    return docs.drop("ids", "ends").mapInArrow(lambda b: _encode_batches(b, path), _typed(docs, ("text", "ids", "ends"), "ids binary, ends binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``bytes``, decoded from ``ids`` and ``ends``, in place of ``ends``."""
    return encoded.drop("bytes").mapInArrow(lambda b: _decode_batches(b, path), _typed(encoded, ("ends", "bytes"), "bytes binary"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encoding and decoding in one pass: the rows with ``ids``, ``n_tokens`` and the digests of the packed ids and of
    the decoded bytes in place of ``text``."""
    ours = ("ids", "ends", "bytes", "n_tokens", "ids_sha256", "decoded_sha256")
    chain = lambda b: _digest_batches(_decode_batches(_encode_batches(b, path), path))
    return docs.drop(*ours).mapInArrow(chain, _typed(docs, ("text", *ours), "ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of tokens, digest of the packed ids, digest of the decoded bytes."""
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()).drop("ids")
