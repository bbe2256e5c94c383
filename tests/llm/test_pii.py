import hashlib
import random
import re
import time

from photocat.llm import pii


def plain(t):
    """The base patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = lambda p, ok=lambda s: True: [m.span() for m in re.finditer(p, t) if ok(m.group())]
    return [
        *((0, *s) for s in found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
        *((1, *s) for s in found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))),
        *((2, *s) for s in found(r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)))),
        *((3, *s) for s in found(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)),
    ]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    for k in range(20_000):
        t = "".join(rng.choice("a.b@c-1 2+()3%é\n4.5" if k % 2 else "0123456789 -.+@a") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "1 " * 150_000):
        pii.base_spans(t)


def test_field_finds_respelled_entities(spark, real):
    docs, rows = real
    field = pii.train(docs)
    right = wrong = missed = 0
    for r in rows:
        base = pii.base_spans(r["text"])
        if base and len(r["text"]) < 5000:
            text, kept = pii.respelled(r["text"], base, str(r["doc_id"]))
            got = {s for w in pii.runs(text) for s in field.decode(text, w)}
            right, wrong, missed = right + len(set(kept) & got), wrong + len(got - set(kept)), missed + len(set(kept) - got)
    assert right >= 0.7 * (right + missed) and wrong <= 0.2 * (right + wrong)


def test_query_against_plain_patterns(spark, real, odd):
    for docs in (real[0], odd[0]):
        field = pii.train(docs)
        want = sorted((str(r.doc_id), pii.spelled(plain(r.text or ""))) for r in docs.collect())
        got = pii.find_all(docs, field).collect()
        assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((d, hashlib.sha256(s.encode()).hexdigest()) for d, s in want)
        spans = {}
        for d, s in want:
            spans.setdefault(d, set()).add(s)
        for r in got:
            assert any(set(filter(None, s.split(","))) <= set(r.spans.split(",")) for s in spans[str(r.doc_id)])
            assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len(list(filter(None, r.spans.split(","))))


def test_texts_without_anything(spark):
    docs = spark.createDataFrame([(1, "no digits here"), (2, None)], "doc_id bigint, text string")
    assert [r.spans for r in pii.find_all(docs, pii.train(docs)).collect()] == ["", ""]


def test_the_field_takes_linear_time_over_blanks():
    field = pii.Field()
    for t in ("1" + " " * 1_000_000 + "2", "1 " + "\n" * 500_000 + "[at]" + "\t" * 500_000 + " x", "a@b.cd" + "( " * 1000):
        began = time.monotonic()
        pii.find(t, field)
        assert time.monotonic() - began < 10, t[:20]
