"""Each operator against a plain version on a small corpus with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_words import DE, EN, sentence
from leadlake.llm import language as lg
from leadlake.llm import licenses as li
from leadlake.llm import mixing as mx
from leadlake.llm import pieces as pc
from leadlake.llm import repeats as rp
from leadlake.llm import simhash as sh
from leadlake.llm import templates as tp
from leadlake.llm import topk as tk
from leadlake.llm import toxicity as tx
from leadlake.llm.components import connected_components
from leadlake.llm.fingerprints import edit_sensitivity, edited, fingerprints
from leadlake.llm.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")



def sha(data):
    return hashlib.sha256(data).hexdigest()


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r) if isinstance(r, (tuple, list)) else (r is not None, r))


# --- op1 ----------------------------------------------------------------------------------------------
def test_toxicity_learns_words_and_families(spark):
    rng = random.Random(1)
    plain = ["river", "stone", "walk", "green", "house", "bridge", "lamp", "summer"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = "vilexx" + rng.choice(["a", "on", "um", "er", "ist", "q"])
        rows.append((i, " ".join(words), rng.choice(["en", "de", None])))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    held = lg.fold("doc_id", 5) == 0
    model = tx.fit_toxicity(docs, marks.where(~held | F.col("doc_id").isNull()), sample_rows=600)
    found = tx.score_toxicity(docs, model).join(spark.createDataFrame(labels, "doc_id bigint, toxic int"), "doc_id").where(held).collect()
    right = sum(r["predicted"] == r["toxic"] for r in found)
    assert len(found) > 80 and right / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_toxicity_scores_hang_on_the_text_alone(corpus):
    """In any order and company, and at any width of batches, a text has one score."""
    labels = corpus.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = tx.fit_toxicity(corpus, labels, epochs=2)
    tables = model.network.tables()
    texts = [r.text or "" for r in corpus.collect()] + ["", "a", "a b"]
    alone = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        alone.append(float(model.scores(data, np.array([0, len(data)]), tables)[0]))
    rng = random.Random(3)
    for _ in range(4):
        order = rng.sample(range(len(texts)), len(texts))
        body = [texts[i].encode() for i in order]
        got = model.scores(np.frombuffer(b"".join(body), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in body])]), tables)
        assert got.tolist() == [alone[i] for i in order]


def plain_response(p, rows, width):
    """The highest response of each filter of a width over one text (rows of hashed embeddings for each word)."""
    emb = p["emb"][rows].sum(1) if len(rows) else np.zeros((1, p["emb"].shape[1]), np.float32)
    out = []
    for i in range(len(emb)):
        out.append(sum(emb[i + j] @ p[f"w{width}"][j] for j in range(width) if i + j < len(emb)))
    return np.max(out, 0)


def test_filters_against_a_plain_convolution():
    rng = np.random.default_rng(4)
    network = tx.ConvolutionalClassifier(50, 1)
    texts = [rng.integers(2, 50, (n, 3)).astype(np.int32) for n in (0, 1, 2, 5, 0, 9, 3)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = network.logits(np.concatenate(texts), bounds, network.tables())
    for logit, rows in zip(got, texts):
        pooled = np.concatenate([np.maximum(plain_response(network.p, rows, w) + network.p[f"b{w}"], 0) for w in tx.WIDTHS])
        assert abs(logit - (pooled @ network.p["out"] + network.p["bias"][0])) < 1e-4


def test_toxicity_edges(spark, corpus, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {(r.score, r.predicted) for r in tx.score_toxicity(corpus, tx.fit_toxicity(corpus, labels)).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id bigint, toxic int")
    model = tx.fit_toxicity(corpus, one, epochs=1)
    out = tx.score_toxicity(corpus, model)
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == corpus.count()
    assert all(math.isfinite(r.score) for r in out.collect())
    assert tx.score_toxicity(nothing, model).count() == 0


# --- op2 ----------------------------------------------------------------------------------------------
def plain_line(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    return tuple("*" if re.search("[0-9]", w) else w for w in words)


def plain_learned(lines):
    """For each different line, its learned templates."""
    out = defaultdict(set)
    for tree in (lambda w: (len(w), w[:3]), lambda w: (len(w), w[:2], w[-1]), lambda w: (len(w), w[-3:])):
        leaves = defaultdict(list)
        for w in lines:
            leaves[tree(w)].append(w)
        for members in leaves.values():
            if len(members) < tp.LEAST_LINES:
                continue
            seen = Counter((i, t) for w in members for i, t in enumerate(w))
            for w in members:
                for least, share in tp.READINGS:
                    kept = tuple(t if t != "*" and seen[i, t] >= least and seen[i, t] * share >= len(members) else None for i, t in enumerate(w))
                    fixed = sum(t is not None for t in kept)
                    if tp.LEAST_FIXED <= fixed < len(w) and 10 * fixed >= tp.FIXED_IN_TEN * len(w):
                        out[w].add(("learned", kept))
    return out


def plain_dropped(rows, least=3):
    """(key, text, lines, dropped) of every row."""
    docs, first, places = defaultdict(set), {}, defaultdict(list)
    lines = [(d, i, t, n, plain_line(line)) for d, (i, t, *_) in enumerate(rows) for n, line in enumerate((t or "").split("\n"))]
    learned = plain_learned({w for *_, w in lines if w})
    for d, i, t, n, w in lines:
        for name in [("literal", w), *learned[w]] if w else []:
            place = (i is not None, i, t, n)
            docs[name].add(d)
            first[name] = min(first.get(name, place), place)
            places[d, n].append((name, place))
    out = []
    for d, (i, t, *_) in enumerate(rows):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        cut = t.split("\n")
        kept = [x for n, x in enumerate(cut) if all(len(docs[name]) < least or first[name] == place for name, place in places[d, n])]
        out.append((i, "\n".join(kept), len(cut), len(cut) - len(kept)))
    return out


def test_line_templates_against_plain_version(corpus, corpus_rows, nothing):
    out = tp.drop_recurring_lines(corpus)
    assert out.columns == [*corpus.columns, "n_lines", "n_dropped"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert ordered(got) == ordered(plain_dropped(corpus_rows))
    assert sum(r[3] for r in got) > 20
    assert tp.drop_recurring_lines(nothing).count() == 0


NAMES = "Anna Bob Cleo Dora Emil Fritz Gina Hugo Ida Jan Kim Lea".split()


@pytest.mark.parametrize("line", [
    "Posted by {a} in News", "User {a} logged in from {b} at noon via the office proxy", "{a} has joined the channel today", "{a} wrote on {b} about all things here",
])
def test_templates_with_fields_anywhere(spark, line):
    rng = random.Random(len(line))
    prose = lambda: sentence(rng, EN, rng.randint(4, 12))
    rows = [(i, "\n".join([prose(), line.format(a=n, b=NAMES[(i * 5 + 3) % 12].lower()), prose()])) for i, n in enumerate(NAMES)]
    out = {r.doc_id: r for r in tp.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [out[i].n_dropped for i in range(12)] == [0] + [1] * 11
    assert all(rows[i][1].split("\n")[0::2] == out[i].text.split("\n") for i in range(1, 12))
    assert ordered((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.values()) == ordered(plain_dropped(rows))


def test_prose_that_shares_its_beginning_stays(spark):
    rng = random.Random(12)
    rows = [(i, "The old house " + " ".join(rng.choice(EN + DE) for _ in range(9))) for i in range(60)]
    assert sum(r.n_dropped for r in tp.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == 0


def test_shards_of_a_leaf_learn_alike(spark):
    rows = [(i, f"Posted by {''.join(random.Random(i).choice('abcdefgh') for _ in range(9))} in News") for i in range(400)]
    out = tp.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=50).collect()
    assert sum(r.n_dropped for r in out) == 399


# --- op3 ----------------------------------------------------------------------------------------------
def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], "x") for i in range(500)]
    rows += [(500 + i, rows[0][1], "x") for i in range(30)]  # many ties
    rows += [(600, None, "x"), (700, [None] * 8, "x"), (800, [float("nan")] * 8, "x"), (900, [float("inf")] * 8, "x"), (1000, [0.5] * 3, "x"), (1100, [0.25] * 3, "y"), (None, [0.1] * 8, "z")]
    rows += [(1200, [], "x"), (20, rows[20][1], "again")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string").repartition(4)
    got = defaultdict(list)
    for r in tk.top_k(vectors, F.col("vec_id") % 100 == 0, block_rows=64, query_rows=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in [(i, v) for i, v in fine if i % 100 == 0]:
        others = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))[:10]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(others, 1)]
    assert set(got) == {i for i, _ in fine if i % 100 == 0}
    assert tk.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(1, 60)]
    twice, other = [0.25] * 6, [-0.25] * 6
    rows += [(100, twice), (100, twice), (100, other)]
    out = tk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") == 100, block_rows=16).collect()
    want = []
    for v in (twice, other):
        whole = [math.floor(1024 * x) for x in v]
        best = sorted((-sum(a * math.floor(1024 * float(np.float32(x))) for a, x in zip(whole, w)), i) for i, w in rows if i != 100)[:10]
        want += [(100, n, i, -score) for n, (score, i) in enumerate(best, 1)]
    assert sorted(map(tuple, out)) == sorted(want)


# --- op4 ----------------------------------------------------------------------------------------------
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_license_base_counts(spark, nothing):
    texts = [
        "Released under the MIT License, mit-license? MIT licenses.", None, "", "an Apache\n LICENSE: the GNU General Public License v3",
        "permission is hereby grented, free of charge", "x" * 50000 + " mit license", "mit license " * 300, "Ünmit license smit license mit  license",
    ]
    rows = [(i, t, 0.1, "l") for i, t in enumerate(texts)] + [(3, texts[3], 0.2, "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, labels string")
    out = li.license_summary(li.scan_licenses(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        words = re.findall(WORD, (texts[r.doc_id] or "").translate(LOWER))
        places = [(i, label) for phrase, label in li.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    by = {r.doc_id: r for r in out}
    assert by[4].labels == "mit" and 0.9 < by[4].score < 1 and by[1].score == by[2].score == 0
    assert li.scan_licenses(nothing).count() == 0


def test_many_notices_take_linear_time():
    notices = li.make_notices(li.NOTICES)
    for phrase in ("released under the gnu license", "released under the mit licence", "permission is hereby granted, free of charge"):
        text = " ".join(li._GAP.split(phrase)) + " "
        began = time.process_time()
        found = li.fuzzy_spans(text * (20000 // len(phrase.split())), notices)
        assert time.process_time() - began < 20
        assert len(found) == (0 if "gnu" in phrase else 20000 // len(phrase.split()))


def test_fuzzy_spans_find_any_bounded_edit():
    notices = li.make_notices({"general public license": "gpl"})
    rng = random.Random(2)
    for _ in range(200):
        text = list("general public license")
        for _ in range(notices[0].errors):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice([[], ["z"], [text[k], "q"]])
        found = li.fuzzy_spans("lead words here " + "".join(text) + " and behind", notices)
        assert found and found[0][2] == "gpl" and found[0][3] <= notices[0].errors


# --- op5 ----------------------------------------------------------------------------------------------
def near_classes(keys, prints, radius=4):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [least.get(root(i)) for i in range(len(keys))]


def test_simhash_components(corpus, corpus_rows, nothing):
    prints = [sh.simhash_text([w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))]) for _, t, *_ in corpus_rows]
    classes = near_classes([r[0] for r in corpus_rows], prints)
    want = [(r[0], p - (1 << 64) if p >> 63 else p, c) for r, p, c in zip(corpus_rows, prints, classes)]
    assert ordered(tuple(r) for r in sh.near_duplicates(corpus).collect()) == ordered(want)
    assert sh.near_duplicates(nothing).count() == 0
    kept = sh.keep_representatives(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for r, c in zip(corpus_rows, classes) if r[0] is not None})


def test_representatives_of_clashing_keys(spark):
    a, b = " ".join(f"left{i}" for i in range(30)), " ".join(f"right{i}" for i in range(30))
    for rows in ([(1, a, 1), (1, b, 2), (0, b, 3)], [(1, a, 2), (1, b, 1), (0, b, 3)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
        assert sorted((r.doc_id, r.text) for r in sh.keep_representatives(docs.select("n", "doc_id", "text")).collect()) == [(0, b), (1, a)]


def plain_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b, similarity=0.8):
    return (not a and not b) or bool(a or b) and len(a & b) >= similarity * len(a | b)


def near_copies(rng, count, words):
    """Long texts, each with three copies that a few words were changed in."""
    out = []
    for _ in range(count):
        base = [rng.choice(words) + str(rng.randrange(400)) for _ in range(rng.randint(60, 400))]
        out.append(base)
        for _ in range(3):
            copy = list(base)
            for k in rng.sample(range(len(copy)), max(1, len(copy) // 60)):
                copy[k] = "changed"
            out.append(copy)
    return [" ".join(t) for t in out]


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(14)
    texts = near_copies(rng, 60, EN) + [" ".join(rng.choice(EN) + str(rng.randrange(400)) for _ in range(100)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tid bigint, text string")
    sets = [plain_shingles(t) for t in texts]
    links = {(r.u, r.v) for r in sh.similar_links(docs).collect()}
    assert all(alike(sets[u], sets[v]) for u, v in links)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    root = {r.node: r.root for r in connected_components(sh.similar_links(docs)).collect()}
    found = sum(root.get(i, i) == root.get(j, j) for i, j in near)
    assert len(near) > 100 and found >= 0.9 * len(near)
    assert not any(i in root for i in range(240, 440))


def test_every_pair_at_the_border_is_connected(spark):
    rng = random.Random(15)
    texts = ["", " ", "\n", "one", "One", "a b c d e", "a b c d f"]
    for _ in range(150):
        # a changed word changes five shingles: as many as leave a similarity of 0.80 to 0.83; every text has a common line
        base = ["this line is in every one of the texts here"] + [rng.choice(EN) + str(rng.randrange(4000)) for _ in range(rng.randint(100, 200))]
        copy = list(base)
        for k in rng.sample(range(10, len(base) - 5, 6), max(1, round(len(base) * 0.11 / 5))):
            copy[k] = "changed"
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame([(i * 7919 % 4001, t) for i, t in enumerate(texts)], "tid bigint, text string")
    tids, sets = [i * 7919 % 4001 for i in range(len(texts))], [plain_shingles(t) for t in texts]
    near = {(max(tids[i], tids[j]), min(tids[i], tids[j])) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])}
    assert len(near) > 100
    links = sh.similar_links(docs)
    assert {(max(r.u, r.v), min(r.u, r.v)) for r in links.collect()} <= near
    root = {r.node: r.root for r in connected_components(links).collect()}
    assert all(root.get(i, i) == root.get(j, j) for i, j in near)
    # without any group before it, the exact join alone finds all pairs
    alone = sh.missed_links(docs, spark.createDataFrame([], "node bigint, root bigint"), 5, 0.8)
    assert {(r.u, r.v) for r in alone.collect()} == near


def test_unlike_documents_stay_with_all_columns(spark, corpus, corpus_rows, nothing):
    helpers = ["tid", "key", "whole", "doc", "first", "last", "node", "root", "n", "kinds", "variant"]
    docs = corpus.select("doc_id", "text", *[F.lit(f"mine {c}").alias(c) for c in helpers])
    kept = sh.keep_unlike(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {tuple(r)[2:] for r in rows} == {tuple(f"mine {c}" for c in helpers)}
    sets = [plain_shingles(t) for t in dict.fromkeys(r[1] or "" for r in corpus_rows)]
    got = [plain_shingles(r.text) for r in rows]
    assert all(any(alike(a, b) for b in got) for a in sets)  # each text is there, or one like it
    assert sum(alike(a, b) for i, a in enumerate(got) for b in got[:i]) == 0
    assert sh.keep_unlike(nothing).count() == 0


def test_links_of_dense_balls(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = {r.node: r.root for r in connected_components(sh.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))).collect()}
    want = near_classes(signed, prints)
    assert [roots.get(p, p) for p in signed] == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500)], "u bigint, v bigint")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500}


# --- op6 ----------------------------------------------------------------------------------------------
def test_pieces_without_dropout_are_the_models_own(corpus_rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pc.MODEL)
    model = pc.piece_model(pc.model_bytes(pc.MODEL))
    for _, t, *_ in corpus_rows[:60]:
        assert np.frombuffer(model.encode(t), np.int32).tolist() == sp.encode(t)
    for t in ["hello  world\n\tx ", " lead", "ça été ñ 漢😀 \x00z", "a   b"]:
        assert np.frombuffer(model.encode(t), np.int32).tolist() == sp.encode(t)


def test_pieces_side_by_side_as_one_by_one():
    model, rng = pc.piece_model(pc.model_bytes(pc.MODEL)), random.Random(4)
    for dropout in (0.0, 0.1, 0.5):
        limit = int(dropout * (1 << 32))
        for _ in range(60):
            part = "".join(rng.choice("theandingo ") for _ in range(rng.randint(2, 40)))
            symbols, salt = model.symbol_of[[ord(c) for c in part]], rng.getrandbits(64)
            row = np.full((1, len(part) + 2), pc.ALONE, np.int32)
            row[0, 1:-1] = symbols
            model._segment_rows(row, np.array([salt], np.uint64), limit)
            assert row[0, 1:-1].tolist() == model.segment(symbols.tolist(), salt, limit)
    for long in ["the" * 400, "漢" * 300 + "\n" * 90, "▁ ▁▁" * 40]:
        assert model.decode(model.encode(long, 5, 0.3, 1)) == long


def test_pieces_decode_losslessly_and_vary(corpus, corpus_rows, nothing):
    encoded = pc.encode_pieces(corpus, dropout=0.3)
    assert all(r.lossless is (None if r.ids is None else True) for r in encoded.collect())
    back = pc.decode_pieces(encoded)
    assert ordered((r.doc_id, r.text) for r in back.collect()) == ordered((r[0], r[1]) for r in corpus_rows)
    again = {r.doc_id: r.ids for r in pc.encode_pieces(corpus, dropout=0.3).collect()}
    other = {r.doc_id: r.ids for r in pc.encode_pieces(corpus, dropout=0.3, seed=99).collect()}
    first = {r.doc_id: r.ids for r in encoded.collect()}
    assert first == again and first != other
    assert pc.encode_pieces(nothing).count() == 0


def test_pieces_draw_anew_for_every_occurrence():
    model, word = pc.piece_model(pc.model_bytes(pc.MODEL)), " international"
    limit, many = int(0.1 * (1 << 32)), 3000
    whole = model.segment_chunks([word], np.zeros(1, np.uint64), 0)[0]
    forms = Counter(model.encode_together([word[1:]] * many, 7, 0.1, list(range(many))))
    assert len(forms) > 20 and 0.02 < forms[whole] / many < 0.9
    # within one row, too, and as the occurrence would be segmented alone
    text = " ".join(["international", "a" * 40, "the", "漢字", "x,y"] * 300)
    row = model.encode(text, 7, 0.1, "row")
    bits, chunks = pc.xxhash.xxh64_intdigest("row", 7), pc._CHUNKS.findall(" " + text)
    salts = pc.mix(np.uint64(bits) + np.arange(len(chunks), dtype=np.uint64) * np.uint64(pc._SALTS[0]))
    alone = [model.segment_chunks([c], salts[i : i + 1], limit)[0] for i, c in enumerate(chunks)]
    assert b"".join(alone) == row and len(set(alone[::5])) > 15
    assert model.decode(row) == text and model.encode(text, 7, 0.1, "row") == row != model.encode(text, 7, 0.1, "other")


# --- op7 ----------------------------------------------------------------------------------------------
def plain_repeats(rows, length=rp.LENGTH):
    seen, out = set(), {}
    for key, text in sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is not None, r)):
        body = text.encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if body[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(body[i : i + length])
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[key, text] = (key, len(body), sum(gone), spans, sha(bytes(c for c, g in zip(body, gone) if not g)))
    return [out[k, t or ""] for k, t in rows]


def test_repeats_against_plain_version(corpus, corpus_rows, nothing):
    out = rp.drop_repeats(corpus)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert ordered(got) == ordered(plain_repeats([(r[0], r[1]) for r in corpus_rows]))
    assert sum(r[2] for r in got) > 10000 and all(sha(bytes(r.kept)) == r.kept_sha256 for r in out.collect())
    assert rp.drop_repeats(nothing).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    shared = text()
    rows = [(0, shared), *[(None, text()) for _ in range(400)], *[(5, text()) for _ in range(400)], (5, text() + shared), (None, shared[20:])]
    out = rp.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert ordered(got) == ordered(plain_repeats(rows))


def test_merged_transforms_sort_like_suffixes():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 40))) for _ in range(12)]
    depth = 16
    shards = [rp.shard_transform(strings[i : i + 4], depth) for i in (0, 4, 8)]
    interleave, interval = rp.merge_transforms(shards, depth)
    assert sorted(interleave.tolist()) == list(range(sum(len(o) for o, _, _ in shards)))
    every = []
    for s in strings:
        ring = (bytes(c for c in s) + b"\0") * (depth + 1)
        every += [ring[i : i + depth] for i in range(len(s) + 1)]
    assert sorted(Counter(every).values()) == sorted(Counter(interval.tolist()).values())


@pytest.mark.parametrize(("alphabet", "depth"), [(b"ab", 16), (b"ab", 18), (bytes(range(97, 123)) + bytes(range(128, 250)), 12)])
def test_merge_leaves_out_suffixes_that_stand_alone_or_end(alphabet, depth):
    rng = random.Random(9)
    strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(3, 4000 if len(alphabet) > 2 else 60))) for _ in range(12)]
    strings += [s[len(s) // 3 :] + s[: len(s) // 2] for s in strings[:6]]
    parts = [strings[i : i + 6] for i in (0, 6, 12)]
    shards = [rp.shard_transform(p, depth) for p in parts]
    sizes = [sum(len(s) + 1 for s in p) for p in parts]
    at = np.concatenate([o + sum(sizes[:i]) for i, (o, _, _) in enumerate(shards)])
    left = np.concatenate([np.arange(len(s), -1, -1) for s in strings])[at]
    interleave, interval = rp.merge_transforms(shards, depth, left)
    joined = b"".join(s + b"\xff" for s in strings)
    every = Counter(s[i : i + depth] for s in strings for i in range(len(s) - depth + 1))
    texts = [joined[p : p + depth] for p in at[interleave].tolist()]
    assert sorted(Counter(texts).items()) == sorted((t, n) for t, n in every.items() if n > 1) and texts == sorted(texts)
    assert all((a == b) == (x == y) for a, b, x, y in zip(texts, texts[1:], interval.tolist(), interval[1:].tolist()))
    assert len(texts) < len(joined)


def test_a_shard_of_millions_of_symbols_is_sorted():
    body = np.random.default_rng(3).integers(97, 105, 2_200_000).astype(np.uint8)
    order, before, longer = rp.shard_transform([body.tobytes()], 32)
    heads = np.zeros(len(order), np.uint64)
    ring = np.append(body + np.uint8(1), 0).astype(np.uint64)
    for k in range(8):
        heads = (heads << np.uint64(8)) | np.roll(ring, -k)
    assert (np.diff(heads[order].view(np.int64)) >= 0).all() and len(np.unique(order)) == len(ring)
    assert (before == np.roll(ring, 1)[order]).all() and (order[longer] == (order - 1) % len(ring)).all()


def test_runs_of_many_bodies_are_cut_at_once():
    rng = random.Random(4)
    bodies = [rng.randbytes(n) for n in (0, 40, 9, 10, 300, 0, 25, 10)]
    runs = [(i, s, rng.randint(1, len(b) - 9 - s)) for i, b in enumerate(bodies) if len(b) > 9 for s in rng.choices(range(len(b) - 9), k=i % 4)]
    runs += [(4, 290, 1), (6, 0, 6), (6, 15, 1), (7, 0, 1), (7, 0, 1)]  # to the end, side by side, twice
    runs.sort(key=lambda r: r[0])
    owner, start, windows = (np.array(x, np.int64) for x in zip(*runs))
    removed, spans, kept = rp._without(bodies, np.bincount(owner, minlength=len(bodies)), start, windows, 10)
    for i, body in enumerate(bodies):
        gone = {p for o, s, w in runs if o == i for p in range(s, s + w + 9)}
        assert kept[i] == bytes(c for p, c in enumerate(body) if p not in gone)
        assert removed[i] == len(gone) and spans[i] == sum(p - 1 not in gone for p in gone)
    assert rp._without([b"", b"ab"], np.zeros(2, int), start[:0], windows[:0], 10)[2] == [b"", b"ab"]


# --- op8 ----------------------------------------------------------------------------------------------
def plain_targets(sizes):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, open_names, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / max(sum(weight[n] for n in open_names), 1)
        full = [n for n in open_names if weight[n] * level > 2 * sizes[n] + 1e-9]
        if not full:
            return {**target, **{n: weight[n] * level for n in open_names}}
        for n in full:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
            open_names.remove(n)


def test_mixing_meets_targets(corpus, corpus_rows, nothing):
    got = mx.mix_sources(corpus).collect()
    assert len(got) == len(corpus_rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    words = defaultdict(int)
    for r in corpus_rows:
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert sizes == words
    target = plain_targets(words)
    for r in got:
        assert r.source_size == words[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
    assert all(abs(taken[n] - target[n]) <= 1 for n in target)
    assert ordered(map(tuple, got)) == ordered(map(tuple, mx.mix_sources(corpus.repartition(5)).collect()))
    assert mx.mix_sources(nothing).count() == 0


def test_rounding_tree_keeps_mass(spark):
    rng = random.Random(6)
    units = [("a", i, n := rng.randint(1, 50), n * rng.uniform(0.05, 0.95)) for i in range(3000)] + [("b", 9000 + i, 10, 4.0) for i in range(3)]
    out = {r.id: r for r in mx.dependent_rounding(spark.createDataFrame(units, "source string, id bigint, size bigint, mass double"), block=8).collect()}
    for name in "ab":
        own = [u for u in units if u[0] == name]
        assert abs(sum(out[u[1]].extra * u[2] + out[u[1]].rest for u in own) - sum(u[3] for u in own)) < 1e-6
        assert sum(out[u[1]].rest > 0 for u in own) <= 1
    assert len(out) == len(units)


def test_copies_keep_columns(corpus):
    docs = corpus.select("doc_id", "text", "source", *[F.lit(f"mine {c}").alias(c) for c in ("key", "body", "nth", "copies", "copy", "doc", "size", "_key")])
    out = mx.take_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {tuple(r)[3:] for r in rows} == {tuple(f"mine {c}" for c in docs.columns[3:])}
    again = mx.take_copies(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in again)


def test_targets_of_many_sources(spark):
    rng = random.Random(17)
    sizes = {f"s{i:03d}": rng.choice([0, 1, 5, 40, 300]) for i in range(150)} | {None: 77}
    table = spark.createDataFrame([(n, k) for n, size in sizes.items() for k in (size // 2, size - size // 2)], "source string, size bigint")
    want = plain_targets(sizes)
    got = {r.source: r.target for r in mx.source_targets(table).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-6 * max(1, want[n]) for n in want)


# --- op9 ----------------------------------------------------------------------------------------------
def test_fingerprints(corpus, corpus_rows, nothing):
    out = edit_sensitivity(corpus).collect()
    rows = sorted(corpus_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in rows]
    want = [(r[0], len(t), sha(edited(t, texts[(i + 1) % len(texts)]).encode())) for i, (r, t) in enumerate(zip(rows, texts))]
    assert ordered((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == ordered(want)
    by_text = {}
    for r, t in ((r, x[1] or "") for r in out for x in corpus_rows if x[0] == r.doc_id and r.doc_id not in (None, 90, 96)):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    plain = {r.doc_id: r.fingerprint for r in fingerprints(corpus).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in out if r.doc_id is not None)
    assert edit_sensitivity(nothing).count() == 0


def test_shared_halves_are_near(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared = text(400)
    docs = spark.createDataFrame([(1, text(7) + " " + shared + " " + text(300)), (2, shared + " " + text(200)), (3, text(700))], "doc_id bigint, text string")
    a, b, c = (np.array(re.findall("....", r.fingerprint)) for r in fingerprints(docs).orderBy("doc_id").collect())
    assert (a == b).mean() > 0.3 and (a == c).mean() < 0.05


# --- op10 ---------------------------------------------------------------------------------------------
def plain_phrases(text, sample):
    """Phrases of a symbol string that all occur in ``sample``, by longest match."""
    count = i = 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count += 1
        i += max(n, 1)
    return count


def test_cross_parsing_counts_longest_matches():
    rng = random.Random(10)
    sample = bytes(rng.choice(b"abc ") for _ in range(300))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(1, 900))) for _ in range(40)]
    table = lg.automaton(lg.SYMBOLS[np.frombuffer(sample, np.uint8)].tolist())
    model = lg.LanguageModel(["x"], [table])
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got, _ = model.phrases(data, offsets)
    symbols = [lg.normalise(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].astype(np.uint8).tobytes() for t in texts]
    own = lg.SYMBOLS[np.frombuffer(sample, np.uint8)].astype(np.uint8).tobytes()
    assert got[0].tolist() == [plain_phrases(s, own) for s in symbols]


def test_language_of_small_corpus(corpus, corpus_rows, nothing):
    model = lg.fit_languages(corpus.where(lg.fold("doc_id", 3) != 1))
    out = lg.identify_languages(corpus, model).collect()
    text = {r[0]: (r[1], r[2]) for r in corpus_rows}
    right = [r.lang_pred == text[r.doc_id][1] for r in out if r.doc_id is not None and r.doc_id < 60]
    assert sum(right) / len(right) > 0.95
    for r in out:
        letters = re.search(r"[^\W\d_]", text[r.doc_id][0] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert lg.identify_languages(nothing, model).count() == 0
    assert {r.lang_pred for r in lg.identify_languages(corpus, lg.fit_languages(nothing)).collect()} == {"und"}


# --- registered queries and the pipeline ----------------------------------------------------------------
def test_kept_documents_are_those_identified(corpus, nothing):
    from leadlake.llm import language

    docs = corpus.withColumn("_known", F.lit("mine")).withColumn("lang_pred", F.lit(1))
    model = language.fit_languages(docs)
    found = sorted((str(r["doc_id"]), r["lang_pred"]) for r in language.identify_languages(docs, model).collect() if r["lang_pred"] != language.UNKNOWN)
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((str(r["doc_id"]), r["lang"]) for r in rows) == found
    assert {(r["_known"], r["lang_pred"]) for r in rows} == {("mine", 1)}
    assert language.keep_identified(nothing, model).count() == 0
    assert language.keep_identified(docs, language.fit_languages(nothing)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op10_language"](spark, SF_DIR).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_document_is_answered(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    if name not in ("op3_topk", "op11_collocations"):  # these answer queries and languages
        assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


CLASHES = ["_row", "_key", "_nth", "_tid", "_kept", "n_lines", "n_dropped", "row", "lines", "literal", "template", "tid", "root", "size", "id", "copies", "score", "lang_pred"]


def test_pipeline_stage_by_stage(spark, corpus):
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        staged = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(staged.collect(), schema=staged.schema)
        after = docs.collect()
        if name != "pieces":
            assert docs.columns == columns
            assert {tuple(r)[5:] for r in after} == {tuple(f"mine {c}" for c in CLASHES)}
            assert any(r.doc_id is None for r in after)
        if name == "language":
            assert ordered(r.doc_id for r in after) == ordered(r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or ""))
        if name == "lines":
            cut = [r for r in plain_dropped([(r.doc_id, r.text) for r in before]) if not r[3] or re.search(r"\S", r[1] or "")]
            assert ordered((r.doc_id, r.text) for r in after) == ordered(r[:2] for r in cut)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "near_duplicates":
            left = [plain_shingles(r.text) for r in after]
            assert all(any(alike(plain_shingles(r.text), b) for b in left) for r in before)
            assert sum(alike(a, b) for i, a in enumerate(left) for b in left[:i]) == 0
        if name == "mix":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > len(before)
        if name == "pieces":
            assert len(after) == len(before) and all(r.lossless for r in after)


def test_pipeline_on_an_empty_table(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 0 and out.where("not lossless").count() == 0
