"""Hashes of words and of runs of words, for whole slices of texts at once."""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
#: Fixed values of a published mixing function (splitmix64) and an odd base for polynomial hashes.
MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, index of the first word of each text and the number of words). Words are runs
    without blank characters; a blank byte is put between texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return data, starts, ends, np.searchsorted(starts, text_starts)


def word_hashes(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, index of the first word of each text and the number of words). Worked through in
    chunks of about so many bytes, as the sums take eight times the memory of the text."""
    data, starts, ends, first = word_spans(texts)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, side="right")))
        a, b = starts[at:upto] - starts[at], ends[at:upto] - starts[at]
        part = data[starts[at] : ends[upto - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(max(chunk, 1 << len(part).bit_length()))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * up[: len(part)])])
        out[at:upto] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * STEP)
        at = upto
    return out, first


def labelled(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``words`` words together with how often it stood earlier in its text, index of the first
    run of each text and the number of runs). A text of fewer words has one run of all of them, an empty one none."""
    h, first = word_hashes(texts)
    n_words = np.diff(first)
    runs = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    first_run = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(first_run[-1]) - first_run[text] + first[text]  # first word of each run
    if not len(at):
        return np.zeros(0, dtype=np.uint64), first_run
    value = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(words, dtype=np.uint64)])
    length = np.minimum(n_words[text], words)
    for k in range(words):
        value = mixed(value * STEP + np.where(k < length, padded[at + k], np.uint64(k)))
    apart = mixed(value + text.astype(np.uint64) * MIX_1)
    order = np.argsort(apart, kind="stable")
    same = np.concatenate([[False], apart[order][1:] == apart[order][:-1]])
    if same.any():
        index = np.arange(len(order))
        group_start = np.maximum.accumulate(np.where(same, 0, index))
        times = np.empty(len(order), dtype=np.uint64)
        times[order] = (index - group_start).astype(np.uint64)
        value = np.where(times > 0, mixed(value + times * STEP), value)
    return value, first_run
