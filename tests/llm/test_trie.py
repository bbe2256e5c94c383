"""The trie against plain prefixes of lists."""

import hashlib
import random
import zlib

import pytest

from photocat.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, said string"


def said(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    turns = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, said(role, text), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(turns.get(base, [])[:h] + own[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if convs[c] == k)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(children.get(k, [])), sum(x not in children for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_chars", "ends_sha256"]


def result(df):
    return sorted((tuple(r) for r in trie.trie(*trie.rebuilt(trie.fixed(trie.digests(df)))).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    rng = random.Random(8)
    rows = []
    for c in list(range(0, 8)) + list(range(95, 130)) + [200, 777, -3, -250]:
        style = rng.randrange(3)
        for t in range(rng.choice([1, 1, 2, 5, 9, 14])):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"é turn {t} {rng.randrange(2) if t > 4 or style else 0}", "x"))
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, "x"), (1, None, "a", None, "x"), (1, 3, "b", "same", None), (1, 3, "b", "same", None), (None, 1, "a", "nobody's", "x"),
        (2, 1, "a", "", "x"), (3, 1, "a", "w " * 300_000, "x"), (103, 2, "", "😀", "x"), (104, 2, None, "😀", "x"), (100, 5, "a", "first", "x"),
    ]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame(rows, SCHEMA).limit(0)) == []
    lone = [r for r in rows if r[0] is None]
    assert result(spark.createDataFrame(lone, SCHEMA)) == []


def test_one_long_conversation_and_one_common_one(spark):
    """A conversation with a third of all turns, and a third of all conversations equal: no turn, node or id is lost."""
    rows = [(0, t, "u", f"turn {t}", "x") for t in range(1500)]
    rows += [(1000 * k + 1, t, "u", f"common {t}", "x") for k in range(1, 200) for t in range(8)]
    rows += [(1000 * k + 2, t, "u", f"common {t}" if t < 7 else f"own {k}", "x") for k in range(1, 100) for t in range(9)]
    got = result(spark.createDataFrame(rows, SCHEMA))
    want = {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            key = hash(turns[:d]) if d < 20 else (c, d)
            n, low = want.get((d, key), (0, c))
            want[d, key] = n + 1, min(low, c)
    assert sorted((low, d, n) for (d, _), (n, low) in want.items()) == sorted((r[0], r[1], r[3]) for r in got)
    root = next(r for r in got if r[1] == 0)
    assert root[5] == sum(r[4] == 0 for r in got)


def test_texts_of_nodes(spark):
    turns = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 1), (2, 1, "a", 1)], "conv_id long, pos long, said string, n_chars long")
    nodes = trie.trie(turns.select("conv_id").distinct(), turns)
    got = sorted((r.depth, r.said, r.n_convs) for r in trie.last_turns(nodes, turns).collect())
    assert got == [(0, None, 2), (1, "a", 2), (2, "b", 1)]
