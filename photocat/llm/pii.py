"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find the base spans. The field finds spans in other spellings: it cuts a run of words around digits, at
signs and written-out ones into segments, each outside or one entity of up to ``MAX_WORDS`` words. Features look at
whole segments (their shape, digits, checksums, the word before), and dynamic programming chooses boundaries and
kinds together. Training maximises the likelihood of the segmentation that the base patterns give on a bounded sample
of runs, ``TRAIN_RUNS`` smallest by a hash over all documents, and on copies of them respelled by rule (entities
written differently stay entities, broken ones become outside). All texts are searched whole.

Defined results: a null text is the empty text; spans are in code points, the end is exclusive; spans of the field that
touch a base span are dropped; repeated rows and ids are handled row by row; an empty table gives no rows; with no run to
train on the field adds nothing; further columns are left out by ``find``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import table, text_slices

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
CARD_KIND = KINDS.index("card")
MAX_WORDS = 8
#: Bound of the training sample and of the words of a run in it.
TRAIN_RUNS = 800
TRAIN_WORDS = 40
EPOCHS = 6
RATE = 0.5
DECAY = 1e-3
#: Added to the score of every word outside; makes the field cautious.
CAUTION = 0.5

# The base patterns. Repetitions that cannot match differently give nothing back.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

WORD = re.compile(r"[^ \t-\r]+")
ANCHOR = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = []
    last, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(t, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = t.find("@", max(at + 1, last))
    if DIGIT.search(t):
        out += [(1, *m.span()) for m in IP.finditer(t) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
        out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in t:
        out += [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(_digits(m.group())) <= 15]
    return out


def runs(t: str) -> list[list[tuple[int, int]]]:
    """Spans of the words of each run: words with an anchor and one word on either side."""
    if not ANCHOR.search(t):
        return []
    words = [m.span() for m in WORD.finditer(t)]
    hot = [k for k, (a, b) in enumerate(words) if ANCHOR.search(t, a, b)]
    out, upto = [], -3
    for k in hot:
        if k - 1 > upto + 1:
            out.append([])
        out[-1] += words[max(0, upto + 1, k - 1) : k + 2]
        upto = k + 1
    return out


def trimmed(t: str, a: int, b: int) -> tuple[int, int]:
    """The span without the punctuation around it; a bracket stays where its partner is inside."""
    while a < b and t[a] in "\"'<[{(,;:#*$%&|" and not (t[a] == "(" and ")" in t[a:b] or t[a] == "[" and "]" in t[a:b]):
        a += 1
    while b > a and t[b - 1] in ".,;:!?\"'>]})#*$%&|" and not (t[b - 1] == ")" and "(" in t[a:b] or t[b - 1] == "]" and "[" in t[a:b]):
        b -= 1
    return a, b


def shape(s: str) -> str:
    out = []
    for c in s[:80]:
        k = "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c
        if not out or out[-1] != k or k not in "9a ":
            out.append(k)
    return "".join(out)[:40]


def features(t: str, words: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the words i .. j - 1 as one segment."""
    a, b = trimmed(t, words[i][0], words[j - 1][1])
    s = t[a:b]
    d, low = _digits(s), s.lower()
    letters = any(c.isalpha() for c in s)
    names = [f"n{j - i}", f"d{min(len(d), 20)}", f"l{letters}", f"s{shape(s)}", f"d{min(len(d), 20)}l{letters}", f"c{s[:1] if not s[:1].isalnum() else 'w'}"]
    low = re.sub(r"\s+", " ", low)  # a search for blanks before a bracket would start at every one of a long run
    bare = re.sub(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*", ".", re.sub(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*", "@", low))
    if re.fullmatch(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", bare):
        names.append("as-address")
    parts = bare.split(".")
    if len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts):
        names.append("as-octets")
    if 16 <= len(d) <= 19 and not letters:
        names.append(f"luhn{luhn(d)}")
    if 8 <= len(d) <= 15 and not letters:
        names.append(f"dialled{'+' in s}{s.startswith('00')}{'(' in s}{any(c in s for c in ' -.')}")
    names.append("marks" + "".join(sorted({c for c in s if not c.isalnum() and not c.isspace()}))[:8])
    before = t[slice(*words[i - 1])] if i else ""
    names.append("before" + shape(before)[:12])
    return names


class Field:
    """Weights of the field: a vector over kinds and outside for every feature, and one for every pair of neighbours."""

    def __init__(self):
        self.weight: dict[str, np.ndarray] = {}
        self.next = np.zeros((OUTSIDE + 1, OUTSIDE + 1))

    def scores(self, names: list[str]) -> np.ndarray:
        out = np.zeros(OUTSIDE + 1)
        for n in names:
            w = self.weight.get(n)
            if w is not None:
                out += w
        return out

    def lattice(self, t: str, words: list[tuple[int, int]]):
        """{(i, j): (features, scores)}; outside is one word long."""
        out = {}
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + MAX_WORDS) + 1):
                names = features(t, words, i, j)
                s = self.scores(names)
                if j > i + 1:
                    s[OUTSIDE] = -math.inf
                if "luhnTrue" not in names:
                    s[CARD_KIND] = -math.inf  # a card has 16 to 19 digits and its checksum, however it is written
                out[i, j] = names, s
        return out

    def learn(self, t: str, words: list[tuple[int, int]], gold: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on the log-likelihood of a segmentation."""
        n, lattice = len(words), self.lattice(t, words)
        forward = np.full((n + 1, OUTSIDE + 1), -np.inf)
        backward = np.full((n + 1, OUTSIDE + 1), -np.inf)
        forward[0, OUTSIDE] = 0  # what stands before a run is outside
        backward[n] = 0
        for j in range(1, n + 1):
            into = []
            for i in range(max(0, j - MAX_WORDS), j):
                into.append(np.logaddexp.reduce(forward[i][:, None] + self.next, axis=0) + lattice[i, j][1])
            forward[j] = np.logaddexp.reduce(np.array(into), axis=0)
        for i in range(n - 1, -1, -1):
            out = [self.next + (lattice[i, j][1] + backward[j])[None, :] for j in range(i + 1, min(n, i + MAX_WORDS) + 1)]
            backward[i] = np.logaddexp.reduce(np.concatenate(out, axis=1), axis=1)
        total = np.logaddexp.reduce(forward[n])
        moved = np.zeros_like(self.next)
        for (i, j), (names, s) in lattice.items():
            joint = np.exp(forward[i][:, None] + self.next + (s + backward[j])[None, :] - total)
            moved -= joint
            change = -joint.sum(0)
            kind = gold.get((i, j))
            if kind is not None:
                change[kind] += 1
            if np.abs(change).max() > 1e-4:
                for name in names:
                    w = self.weight.setdefault(name, np.zeros(OUTSIDE + 1))
                    w *= 1 - rate * DECAY
                    w += rate * change
        at, before = 0, OUTSIDE
        while at < n:
            j = next(j for (i, j) in gold if i == at)
            moved[before, gold[at, j]] += 1
            at, before = j, gold[at, j]
        self.next += rate * moved

    def decode(self, t: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the entities of the best segmentation."""
        n, lattice = len(words), self.lattice(t, words)
        best = np.full((n + 1, OUTSIDE + 1), -np.inf)
        best[0, OUTSIDE] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_WORDS), j):
                s = lattice[i, j][1].copy()
                s[OUTSIDE] += CAUTION
                ways = best[i][:, None] + self.next
                top = ways.argmax(0)
                value = ways[top, np.arange(OUTSIDE + 1)] + s
                for k in np.flatnonzero(value > best[j]):
                    best[j, k], back[j, int(k)] = value[k], (i, int(top[k]))
        out, j, k = [], n, int(best[n].argmax())
        while j:
            i, before = back[j, k]
            if k != OUTSIDE:
                out.append((k, *trimmed(t, words[i][0], words[j - 1][1])))
            j, k = i, before
        return out[::-1]


def gold_segments(words: list[tuple[int, int]], spans: list[tuple[int, int, int]], t: str) -> dict[tuple[int, int], int] | None:
    """The segmentation of a run that the spans give; None if they do not fall on its words."""
    out, at = {}, 0
    starts = {s: (k, e) for k, s, e in spans}
    while at < len(words):
        kind, j = OUTSIDE, at + 1
        for j2 in range(at + 1, min(len(words), at + MAX_WORDS) + 1):
            a, b = trimmed(t, words[at][0], words[j2 - 1][1])
            if starts.get(a, (None, None))[1] == b:
                kind, j = starts[a][0], j2
        out[at, j] = kind
        at = j
    return out if sum(k != OUTSIDE for k in out.values()) == len(spans) else None


def respelled(t: str, spans: list[tuple[int, int, int]], seed: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The run with its entities written differently, or broken and then no entities any more."""
    rng, out, kept, at = random.Random(seed), [], [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        s, real = t[a:b], rng.random() < 0.6
        d = _digits(s)
        if kind == 0:
            name, _, host = s.partition("@")
            left, right = rng.choice([("[", "]"), ("(", ")")])
            gap = rng.choice(["", " "])
            s = f"{name}{gap}{left}at{right}{gap}" + host.replace(".", f"{gap}{left}dot{right}{gap}" if rng.random() < 0.7 else ".") if real else rng.choice([f"{name}{gap}{left}{gap}{host}", f"{name}/{d or 7}", f"{left}at{right} {rng.randint(1, 12)}"])
        elif kind == 1:
            s = s.replace(".", rng.choice(["[.]", "(.)", "[dot]"])) if real else rng.choice([".".join(str(int(x) + 300) for x in s.split(".")), ".".join(s.split(".")[:3]), f"v{s}.1"])
        elif kind == 2:
            group = rng.choice([".", "/", "_"])
            s = group.join(d[k : k + 4] for k in range(0, len(d), 4)) if real else d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        else:
            local = d[-10:]
            s = rng.choice([f"({local[:3]}) {local[3:6]}-{local[6:]}", f"00{d[:-10]} {local[:3]} {local[3:6]} {local[6:]}", f"00{d[:-10]}-{local[:3]}-{local[3:6]}-{local[6:]}"]) if real else rng.choice([f"{local[:4]}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{local[:2]}:{local[2:4]}", f"{local[:3]}-{local[3:6]}"])
        out.append(t[at:a])
        start = sum(map(len, out))
        out.append(s)
        if real:
            kept.append((kind, start, start + len(s)))
        at = b
    return "".join([*out, t[at:]]), kept


def _training_batches(batches):
    """(hash, run) of the runs of all texts that are short enough to train on."""
    for part in text_slices(batches):
        found = []
        for t in part.column("text").to_pylist():
            for words in runs(t or ""):
                if len(words) <= TRAIN_WORDS:
                    run = t[words[0][0] : words[-1][1]]
                    found.append((hashlib.md5(run.encode("utf-8", "replace")).hexdigest(), run))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["hash", "run"])


def train(docs: DataFrame) -> Field:
    """Fit the field on the sample and its respelled copies."""
    sample = docs.select("text").mapInArrow(_training_batches, "hash string, run string").distinct().orderBy("hash").limit(TRAIN_RUNS).collect()
    cases = []
    for h, t in sample:
        for text, spans in ((t, base_spans(t)), respelled(t, base_spans(t), h)):
            for words in runs(text):
                inside = [s for s in spans if words[0][0] <= s[1] and s[2] <= words[-1][1]]
                gold = gold_segments(words, inside, text)
                if gold is not None:
                    cases.append((text, words, gold))
    field = Field()
    order = random.Random(5)
    for epoch in range(EPOCHS):
        order.shuffle(cases)
        for text, words, gold in cases:
            field.learn(text, words, gold, RATE / (1 + epoch))
    return field


def find(t: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, by kind and start."""
    base = base_spans(t)
    extra = [s for words in runs(t) for s in field.decode(t, words)]
    if base and extra:
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken])
        at = np.searchsorted(starts, [b for _, _, b in extra])
        extra = [s for s, k in zip(extra, at, strict=True) if not k or reach[k - 1] <= s[1]]
    return base, sorted([*base, *extra])


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def find_all(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weight, field.next))

    def run(batches):
        own = Field()
        own.weight, own.next = shared.value
        for part in text_slices(batches):
            rows = []
            for doc_id, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                base, spans = find(t or "", own)
                rows.append((doc_id, *(sum(k == kind for k, _, _ in base) for kind in range(OUTSIDE)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    return find_all(docs, train(docs))
