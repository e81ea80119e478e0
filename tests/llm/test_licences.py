"""Licence spans against every chain of every common run of words, without an automaton."""

import random

import pytest

from glyphsieve.llm import licences
from glyphsieve.llm.licences import ENOUGH, GAP, MATCH, SHARE, TEMPLATES

TEXT = {label: max((t for x, t in TEMPLATES if x == label), key=len).split() for label, _ in TEMPLATES}


def plain_spans(words):
    spans = set()
    for label, text in TEMPLATES:
        own, matches = text.split(), []
        for shift in range(-len(own), len(words)):
            at = 0
            while at < len(own):
                n = 0
                while at + n < len(own) and 0 <= shift + at + n < len(words) and own[at + n] == words[shift + at + n]:
                    n += 1
                if n >= MATCH:
                    matches.append((shift + at, n, at))
                at += n + 1

        def chains(m, matches=matches):
            """(covered, first) of every chain that ends with m."""
            start, n, at = m
            yield n, start
            for p in matches:
                if p[0] < start and p[2] < at and p[0] + p[1] < start + n and p[2] + p[1] < at + n and start - p[0] - p[1] <= GAP and at - p[2] - p[1] <= GAP:
                    for covered, first in chains(p):
                        yield covered + n - max(0, p[0] + p[1] - start, p[2] + p[1] - at), first

        best = [(*max(chains(m)), m[0] + m[1] - 1) for m in matches]
        taken = []
        for covered, first, last in sorted(best, key=lambda c: (-c[0], c[2], -c[1])):
            if (covered >= SHARE * len(own) or covered >= ENOUGH) and all(last < low or high < first for low, high in taken):
                taken.append((first, last))
                spans.add((label, first, last, covered, min(1.0, covered / len(own))))
    inside = lambda s, o: s[0] != o[0] and o[1] <= s[1] and s[2] <= o[2] and s[4] < o[4]
    return sorted((s for s in spans if not any(inside(s, o) for o in spans)), key=lambda s: (s[1], s[2], s[0], -s[4]))


def scanned(words):
    return licences.scanner().scan([w.encode() for w in words])[1]


NAMED = {
    "the end before the whole": TEXT["mit"][-9:] + "and so then again".split() + TEXT["mit"],
    "the end of a notice before it": "see the gnu general public license for more details".split() + ["x"] * 4 + TEXT["gpl"],
    "two copies": TEXT["mit"] + TEXT["mit"],
    "two copies apart": TEXT["zlib"] + ["x"] + TEXT["zlib"],
    "two texts in turns": TEXT["mit"][:60] + TEXT["bsd"][:70] + TEXT["mit"][60:] + TEXT["bsd"][70:],
    "one that borrows": TEXT["lgpl"],
    "words put in": " x y ".join(" ".join(TEXT["isc"][i : i + 8]) for i in range(0, len(TEXT["isc"]), 8)).split(),
    "nothing": [],
}


@pytest.mark.parametrize("name", NAMED)
def test_named(name):
    assert scanned(NAMED[name]) == plain_spans(NAMED[name])


def test_what_is_found():
    labels = lambda name: [(s[0], s[1]) for s in scanned(NAMED[name]) if s[3] >= ENOUGH]
    assert labels("the end before the whole") == [("mit", 13)] and labels("two copies") == [("mit", 0), ("mit", len(TEXT["mit"]))]
    assert labels("the end of a notice before it") == [("gpl", 13)] and labels("one that borrows") == [("lgpl", 0)]


def test_random_mixtures():
    draw = random.Random(7)
    found = 0
    for _ in range(150):
        words = []
        for _ in range(draw.randint(1, 6)):
            text = TEXT[draw.choice(list(TEXT))]
            at = draw.randrange(len(text))
            words += text[at : at + draw.randint(2, 40)] + [draw.choice(["x", "the", "software", "of"]) for _ in range(draw.randint(0, 14))]
        assert scanned(words) == plain_spans(words)
        found += len(plain_spans(words))
    assert found > 100


def test_labels_and_score(spark):
    texts = [" ".join(w) for w in NAMED.values()] + ["clean words only", None, "the mit license " + " ".join(TEXT["zlib"])]
    rows = licences.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        spans = plain_spans((texts[r["doc_id"]] or "").split())
        base = set(r["base_labels"].split(",")) - {""}
        assert r["labels"] == ",".join(sorted({s[0] for s in spans} | base))
        assert r["score"] == (1.0 if base else max((s[4] for s in spans), default=0.0))


def test_long_texts_take_linear_time():
    words = (TEXT["mit"] + ["x"]) * 200 + "of the software and the software is of this license the license".split() * 2000
    assert len([s for s in scanned(words) if s[0] == "mit"]) >= 200
