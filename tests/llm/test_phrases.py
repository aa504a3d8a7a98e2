"""Collocations against plain counting, with wide and with colliding fingerprints."""

import random
import re
from collections import Counter

import pytest

from leadlake.llm import phrases as ph

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(rows):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 6):
                counts.update((lang, n, " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    return counts, words


def plain_collocations(rows, least, cover, most):
    counts, words = plain_counts(rows)
    f = {(g, p): c for (g, _, p), c in counts.items() if c >= least}
    longest = Counter()
    for (g, p), a in f.items():
        w = p.split(" ")
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                k = (g, " ".join(w[i : i + n]))
                longest[k] = max(longest[k], a)
    out = []
    for (g, p), a in f.items():
        w = p.split(" ")
        if len(w) < 2 or ((g, p) in longest and 100 * longest[g, p] >= cover * a):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[g, " ".join(w[:k])], f[g, " ".join(w[k:])]
            cuts.append((1000 * a * words[g] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((g, p, a, left, right, words[g], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    nth = Counter()
    ranked = []
    for r in out:
        nth[r[0]] += 1
        if nth[r[0]] <= most:
            ranked.append((r[0], nth[r[0]], *r[1:]))
    return ranked


@pytest.fixture(scope="module")
def rows(corpus_rows):
    rng = random.Random(2)
    made = [(r[0], r[1], r[2]) for r in corpus_rows]
    for i in range(40):
        text = " ".join(rng.choice(["New york", "new\tYork  city", "über Straße", "a", "b", "the. end", "one, two"]) for _ in range(30))
        made.append((200 + i, text + "\x0bx y\x0cy x", rng.choice(["en", "de", None, "und"])))
    return made


@pytest.mark.parametrize("bits, cover, most", [(64, 100, 2000), (64, 60, 7), (7, 100, 2000)])
def test_collocations_against_plain_counts(spark, rows, bits, cover, most):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, lang string, n int, row string, fp int").repartition(5)
    out = ph.collocations(docs, least=12, cover=cover, most=most, bits=bits)
    got = sorted(tuple(r) for r in out.collect())
    assert got == plain_collocations([r[1:] for r in rows], 12, cover, most) and len(got) > 5


def test_pointers_far_into_a_text(spark, rows, monkeypatch):
    monkeypatch.setattr(ph, "WORD_BITS", 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found, _ = ph.frequent_phrases(docs, least=12)
    counts, _ = plain_counts([r[1:] for r in rows])
    assert {(r.lang, r.n, r.phrase): r.f for r in found.collect()} == {k: c for k, c in counts.items() if c >= 12}


def test_scores_beyond_64_bits(spark):
    docs = spark.createDataFrame([(1, "a b " * 40, "en")], "doc_id bigint, text string, lang string")
    (row,) = [r for r in ph.collocations(docs, least=3).collect() if r.phrase == "a b a b a"]
    assert (row.a, row.n, row.score) == (38, 80, 1000 * 38 * 80 // (row.l * row.r))
    wide = spark.range(1).selectExpr("(cast(1000 as decimal(4,0)) * cast(9000000000000 as decimal(19,0)) * cast(900000000000000 as decimal(19,0))) div (cast(3 as decimal(19,0)) * cast(100000000000000 as decimal(19,0))) as x")
    assert wide.first().x == 1000 * 9 * 10**12 * 9 * 10**14 // (3 * 10**14)


def test_edges(spark, nothing, corpus):
    assert ph.collocations(nothing).count() == 0
    assert ph.collocations(corpus, least=10**6).count() == 0
