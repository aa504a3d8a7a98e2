"""Containment by suffix ranges, similar names by rare prefixes, and estimates, against brute force."""

import random

import pytest
from lead_samples import NOW  # noqa: F401
from pyspark.sql import functions as F

from leadlake.functions.contact import company_words
from leadlake.operators import duplicates as du
from leadlake.operators import suffixes as sx
from leadlake.operators import suggestions as su
from leadlake.plans import search as se


@pytest.mark.parametrize("ranges", [1 << 19, 40])
def test_containing_matches_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(sx, "RANGE_ROWS", ranges)
    rng = random.Random(2)
    letters = "abãé漢\U0010ffff "
    strings = {(rng.randrange(3), "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for _ in range(200)}
    strings |= {(1, f"{i} hot piece") for i in range(300)}  # most strings hold one piece
    probes = {(rng.randrange(4), "".join(rng.choice(letters) for _ in range(rng.randint(0, 3)))) for _ in range(150)} | {(1, "hot"), (1, "e"), (2, "hot")}
    table = spark.createDataFrame(sorted(strings), "scope bigint, text string")
    asked = spark.createDataFrame(sorted(probes) + [(None, "a"), (1, None)], "scope bigint, piece string")
    got = {(r.scope, r.piece, r.text) for r in sx.containing(table, asked).collect()}
    want = {(u, p, t) for u, p in probes for v, t in strings if p and u == v and p in t}
    assert got == want and len(want) > 1000
    numbered = [(u, t, rng.randrange(1000)) for u, t in sorted(strings)]
    least = sx.least_containing(sx.suffix_table(spark.createDataFrame(numbered, "scope bigint, text string, value bigint"), True), asked)
    best = {}
    for u, p in probes:
        values = [n for v, t, n in numbered if p and u == v and p in t]
        if values:
            best[u, p] = min(values)
    assert {(r.scope, r.piece): r.value for r in least.collect()} == best
    assert sx.containing(table.limit(0), asked).count() == 0 and sx.containing(table, asked.limit(0)).count() == 0


def test_prefix_rule_is_exact():
    """Similar sets share one of the rarest words of each, and pass the size and place tests there."""
    rng = random.Random(3)
    for _ in range(20000):
        n = rng.randint(1, 24)
        a = rng.sample(range(60), n)
        b = [w for w in a if rng.random() < 0.93] + rng.sample(range(60, 90), rng.randint(0, 2))
        if not b:
            continue
        rng.shuffle(b)
        a, b = sorted(set(a)), sorted(set(b))  # smaller numbers are rarer words
        shared = len(set(a) & set(b))
        if not shared * 5 > len(set(a) | set(b)) * 4:
            continue
        needed = (len(a) + len(b)) * 4 // 9 + 1
        first = min(set(a) & set(b))
        i, j = a.index(first), b.index(first)
        assert shared >= needed and i < len(a) - len(a) * 4 // 5 and j < len(b) - len(b) * 4 // 5
        assert 1 + min(len(a) - 1 - i, len(b) - 1 - j) >= needed
        assert len(a) * 4 // 5 + 1 <= len(b) <= -(-len(a) * 5 // 4) - 1


def test_similar_names_with_a_word_that_half_of_them_hold(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(150)]

    def names(count):
        out = []
        for _ in range(count):
            words = rng.sample(pool, rng.randint(1, 14))
            out.append(" ".join(words + ["trading"] * (rng.random() < 0.5)))
        return out

    old = names(300) + ["trading", "trading house"]
    new = names(150) + ["Trading", "house trading"]
    for base in rng.sample(old, 120):
        words = base.split()
        if rng.random() < 0.5:
            words.append("extra")
        elif len(words) > 1:
            words.pop(rng.randrange(len(words)))
        rng.shuffle(words)
        new.append(" ".join(words))
    sets = lambda rows: spark.createDataFrame([(n,) for n in rows], "company string")
    got = {tuple(sorted(r.words)) for r in du.similar_name_sets(sets(new), sets(old)).collect()}
    words_of = {r.company: tuple(sorted(r.w)) for r in sets(new + old).select("company", company_words(F.col("company")).alias("w")).collect()}
    olds = [set(words_of[o]) for o in old]
    want = {w for n in new if (w := words_of[n]) and any(len(set(w) & o) * 5 > len(set(w) | o) * 4 for o in olds)}
    assert got == want and 60 < len(want) < 200


def test_hot_piece_of_one_user(spark):
    """Every name of a user holds the same words; the check of a batch within itself stays exact."""
    rows = [(i, 1, f"the acme house {'x' * (i % 17)}{i % 40}") for i in range(300)] + [(900, 2, "acme"), (901, 1, "acme house"), (902, 1, "_cme house")]
    table = spark.createDataFrame(rows, "id long, user_id long, company string")
    got = {r.id: r.already_exists for r in du.drop_existing(table, table.limit(0), dedupe_within_batch=True).collect()}
    kept = []
    for i, user, name in rows:
        hit = any(u == user and (name in n or (name.startswith("_") and name[1:] in n)) for u, n in kept)
        assert got[i] == hit
        kept.append((user, name))


def test_related_queries_over_all_texts(spark):
    rng = random.Random(9)
    words = ["red", "blue", "gear", "ring", "anvil", "rod", "old", "new"]
    popular = [(" ".join(rng.sample(words, rng.randint(1, 3))).title(), rng.randrange(30)) for _ in range(80)]
    popular = sorted(dict(popular).items())
    log = [(i, " ".join(rng.sample(words + ["a", "ea", "zz", "old"], rng.randint(0, 3)))) for i in range(40)] + [(99, None)]
    tables = spark.createDataFrame(log, "query_id long, query_text string"), spark.createDataFrame(popular, "query string, count long")
    for pool in (None, 10):
        texts = sorted(popular, key=lambda r: (-r[1], r[0]))
        if pool:
            texts = sorted(sorted(popular, key=lambda r: (r[1], r[0]), reverse=True)[:pool], key=lambda r: (-r[1], r[0]))
        got = {r.query_id: r.related_queries for r in su.related_queries(*tables, pool=pool).collect()}
        for i, text in log:
            terms = [w for w in set((text or "").split()) if len(w) > 1]
            assert list(got[i] or []) == [t for t, _ in texts if any(w in t.lower() for w in terms)][:5]


def test_estimates_against_brute_force(spark, sample, sample_rows):
    log = [(1, "software"), (2, "tech ma"), (3, "nothing_here"), (4, "s_ftware"), (5, "__"), (6, ""), (7, "o"), (8, "de ech"), (9, "online bank of"), (10, "_______________________________________________________________")]
    for user in (None, 2):
        got = {r.query_id: r.estimated_results for r in se.estimated_results(sample, spark.createDataFrame(log, "query_id long, query_text string"), user).collect()}
        rows = [r for r in sample_rows if user in (None, r["user_id"])]

        def holds(row, term):
            texts = [(row[c] or "").lower() for c in ("company", "industry", "description")]
            return any(any(all(p in ("_", c) for p, c in zip(term, t[i:])) for i in range(len(t) - len(term) + 1)) for t in texts)

        for i, text in log:
            terms = [w for w in text.split() if len(w) > 1 and w not in ("of",)]
            assert got[i] == max([sum(holds(r, w) for r in rows) for w in terms], default=0), (i, user)
