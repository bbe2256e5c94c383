"""The manifest against plain trees, with superblocks small enough to need several rounds."""

import hashlib
import zlib

import pytest

from photocat.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, chars):
    return H(*map(written, (r["doc_id"], r["source"], r["lang"], chars, r["text"])))


def climb(nodes):
    """(top, way of each node): the way lists, level by level, the siblings before and after."""
    ways, where, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, at in enumerate(where):
            run = level[at // 2 * 2 : at // 2 * 2 + 2]
            ways[k].append((run[: at % 2], run[at % 2 + 1 :]))
            where[k] = at // 2
        level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], ways


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["n_chars"]), r))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([y[2] for y in sorted(by_lang[x], key=lambda y: y[:3])]) for x in order}
    root, above = climb([trees[x][0] for x in order])
    out = []
    for x, up in zip(order, above, strict=True):
        for (_, _, leaf, r), way in zip(sorted(by_lang[x], key=lambda y: y[:3]), trees[x][1], strict=True):
            node, tamper = leaf, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            if tamper:
                node = leaf_of(r, r["n_chars"] + 1)
            for before, after in way + up:
                node = H(*before, node, *after)
            out.append((r["doc_id"], leaf, trees[x][0], root, H(*[d for b, a in way + up for d in b + a]), node))
    return sorted(out, key=str)


def result(df, bits=merkle.BLOCK_LEVELS):
    return sorted((tuple(r) for r in merkle.manifest(merkle.leaves(df, merkle.tampered_chars()), bits).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()), key=str)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_superblocks_of_any_size_give_the_same_trees(spark, real, bits):
    rows = [r | {"lang": None if r["doc_id"] % 11 == 0 else "é" if r["doc_id"] % 13 == 0 else r["lang"]} for r in real[1]][: 200 if bits > 1 else 45]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], real[0].schema)
    want = brute(rows)
    assert result(df, bits) == want
    assert any(r[3] != r[5] for r in want) and any(r[3] == r[5] for r in want)


def test_odd_rows(spark, odd):
    docs, rows = odd
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert result(docs) == brute([dict(zip(names, r, strict=False)) for r in rows])
    assert result(docs.limit(0)) == []
    one = spark.createDataFrame([(7, None, None, None, 2**63 - 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert result(one) == brute([{"doc_id": 7, "text": None, "lang": None, "source": None, "n_chars": 2**63 - 1}])
    assert result(one)[0][4] == H()


def test_many_languages(spark):
    rows = [{"doc_id": k, "text": "t", "lang": f"l{k % 37}", "source": "s", "n_chars": 1} for k in range(111)]
    assert result(spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")) == brute(rows)
