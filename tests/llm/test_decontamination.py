"""Phrase and proximity search against plain scans."""

import random
import re

import numpy as np
import pytest

from leadlake.llm import decontamination as dc

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def plain(docs, items, window):
    out = []
    for key, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for item, phrase in items:
            own = words_of(phrase)
            size = min(len(own), window)
            for q in range(len(own) - size + 1 if own else 0):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == own[q : q + size]:
                        hit |= set(range(i, i + size))
                        ids.add(str("" if item is None else item))
        out.append((key, len(words), len(hit), len(ids), sorted(ids), bool(hit)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def items(corpus_rows):
    some = " ".join(words_of(corpus_rows[2][1])[3:40])
    rows = [(7, some.upper() + "!"), (10, "The Old House"), (9, "mit license"), (9, "not anywhere"), (11, None), (12, " .. "), (None, "漢字"), (13, "cat"), (13, "cat"), (14, "by the river where")]
    return rows + [(15, " ".join(words_of(corpus_rows[94][1])[40:400])), (16, "the " * 12)]


@pytest.mark.parametrize("window, block_words, slice_words", [(10, 1 << 20, 1 << 18), (3, 50, 20), (1, 7, 5)])
def test_matches_against_plain_scan(spark, corpus, corpus_rows, items, window, block_words, slice_words):
    table = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id bigint, text string, key string, block int")
    index = dc.build_index(corpus, block_words=block_words)
    matches = dc.phrase_matches(index, table, window=window, slice_words=slice_words)
    assert matches.count() > 10
    out = dc.decontaminate(corpus, table, window=window, index=index)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r.item_ids), r.contaminated) for r in out.collect()]
    assert ordered(got) == ordered(plain([r[:2] for r in corpus_rows], items, window))


def test_matches_name_their_places(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y a b c"), (2, "a b"), (3, "c d e a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", "A-B c D e")], "item_id string, text string")
    index = dc.build_index(docs)
    keys = {(r.block, r.nth): r.key for r in dc.index_documents(index).collect()}
    got = sorted((keys[r.block, r.nth], r.item_first, r["first"], r.n_words) for r in dc.phrase_matches(index, items, window=3).collect())
    assert got == [(1, 0, 1, 3), (1, 0, 7, 3), (1, 1, 2, 3), (1, 2, 3, 3), (3, 0, 3, 3), (3, 2, 0, 3)]
    assert all(r.item_id == "i" for r in dc.phrase_matches(index, items, window=3).collect())


def plain_near(words, phrase, within):
    """All narrowest stretches: those that hold the words and no shorter stretch that does."""
    need, found = set(phrase), set()
    for i in range(len(words)):
        for j in range(i, min(len(words), i + within)):
            if need <= set(words[i : j + 1]):
                if not need <= set(words[i + 1 : j + 1]):
                    found.add((i, j - i + 1))
                break
    return found


def test_proximity_against_plain_scan(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))) for i in range(12)]
    index = dc.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), block_words=100)
    keys = {(r.block, r.nth): r.key for r in dc.index_documents(index).collect()}
    found = {}
    for r in dc.proximity_matches(index, spark.createDataFrame(items, "item_id bigint, text string"), within=7).collect():
        found.setdefault((keys[r.block, r.nth], int(r.item_id)), set()).add((r["first"], r.n_words))
    for key, text in docs:
        for item, phrase in items:
            every, got = plain_near(text.split(), phrase.split(), 7), found.get((key, item), set())
            assert got <= every and bool(got) == bool(every)
            if every:
                assert min(n for _, n in got) == min(n for _, n in every)


def test_blocks_unpack_as_packed():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 40, 5000).astype(np.uint64)
    words[100:4900] = np.uint64(7)  # and long gaps for the others
    block = dc.Block.build(words, np.array([0, 10, 5000]))
    again = dc.Block.unpacked(block.packed())
    for a, b in ((block.terms, again.terms), (block.ends, again.ends), (block.places, again.places), (block.bounds, again.bounds)):
        assert a.tolist() == b.tolist()
    empty = dc.Block.unpacked(dc.Block.build(np.zeros(0, np.uint64), np.array([0, 0])).packed())
    assert dc.phrase_places(empty, np.array([[1, 2]], np.uint64)) == []


def test_edges(spark, corpus, nothing):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert dc.decontaminate(nothing, items).count() == 0
    out = dc.decontaminate(corpus, items.limit(0)).collect()
    assert len(out) == corpus.count() and not any(r.contaminated or r.item_ids for r in out)


def test_long_words_are_hashed_apart(spark):
    a, b = "ab", "ba"
    for _ in range(11):  # strings that polynomial hashes over 64 bits do not tell apart
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    out = {r.doc_id: r.contaminated for r in dc.decontaminate(docs, spark.createDataFrame([(1, a)], "item_id int, text string")).collect()}
    assert out == {1: True, 2: False}
