"""Duplicate checks against brute force on random data with hot groups, wildcards and long names."""

import random
import re

import pytest

from leadlake.operators import duplicates as du
from leadlake.plans import ingest as ing

SUFFIXES = {"ltda", "ltd", "inc", "corp", "sa", "me", "eireli", "epp", "llc"}


def name_words(name):
    text = re.sub(r"\b(?:" + "|".join(SUFFIXES) + r")\b\.?", "", (name or "").lower())
    return frozenset(text.split())


def similar(a, b):
    a, b = name_words(a), name_words(b)
    return bool(a and b) and len(a & b) * 5 > len(a | b) * 4


def make_names(rng, count):
    vocabulary = [f"w{i}" for i in range(40)]
    shared = random.Random(3)
    base = [shared.sample(vocabulary, n) for n in (1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15, 16, 18, 20, 21, 24, 30) for _ in range(2)]
    names = []
    for _ in range(count):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            if rng.random() < 0.5 and len(words) > 1:
                words.pop(rng.randrange(len(words)))
            else:
                words.append(rng.choice(vocabulary))
        rng.shuffle(words)
        names.append(" ".join(words) + rng.choice(["", " Ltda.", " INC"]))
    return names


def test_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    schema = "id long, company string, email string, phone string, website string"

    def rows(start, count):
        out = []
        for i, name in enumerate(make_names(rng, count)):
            # A third of all rows share one e-mail domain, phone and site.
            hot = i % 3 == 0
            email = "Hot@x.com" if hot and start else rng.choice([None, "", f"m{rng.randrange(300)}@X.com"])
            phone = rng.choice([None, "", str(rng.randrange(400))])
            site = rng.choice([None, f"https://www.s{rng.randrange(400)}.com/a", f"s{rng.randrange(5)}"])
            out.append((start + i, rng.choice([name, name, None]) if i % 10 == 0 else name, email, phone, site))
        return out

    new, old = rows(1000, 260), rows(0, 260)

    def domain(url):
        m = re.match(r"https?://([^/]*)", url or "")
        return m.group(1).replace("www.", "") if m else None

    expected = {}
    for n in new:
        expected[n[0]] = (
            any(similar(n[1], o[1]) for o in old),
            bool(n[2]) and any(o[2] and o[2].lower() == n[2].lower() for o in old),
            bool(n[3]) and any(o[3] == n[3] for o in old),
            bool(domain(n[4])) and any(domain(o[4]) == domain(n[4]) for o in old),
        )
    found = du.detect_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    got = {r["id"]: (r["similar_name"], r["same_email"], r["same_phone"], r["same_domain"]) for r in found}
    assert got == expected
    assert all(r["is_duplicate"] == any(got[r["id"]]) for r in found)
    assert 30 < sum(v[0] for v in expected.values()) < 250


def test_subset_rule_is_exact():
    """The similarity bound and the subset rule agree for all set sizes."""
    for kept in range(1, 41):
        for a in range(0, 12):
            for b in range(0, 12):
                assert (kept * 5 > (kept + a + b) * 4) == ((a + b) * 4 < kept)


def like(text, pattern):
    expr = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.search(expr, text, re.I | re.S) is not None


@pytest.mark.parametrize("within", [False, True])
def test_existing_names_match_brute_force(spark, within):
    rng = random.Random(11)
    pieces = ["acme", "store", "north", "xy", "q", "São Tomé", "trading house of the", "a\\b", "100"]

    def name():
        return " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))) + rng.choice(["", f" {rng.randrange(60)}"])

    old = [(i, i % 2, rng.choice([name(), name(), None])) for i in range(150)]
    new = []
    for i in range(150):
        n = name()
        n = rng.choice([n, n, n.upper(), n[: rng.randrange(1, len(n) + 1)]])
        new.append((i, i % 3, n))
    if not within:
        new += [(200, 0, "ac_e st%re"), (201, 1, "%"), (202, 1, "_" * 200), (203, 0, "zz_z"), (204, 2, "%"), (205, 0, "__%")]
    schema = "id long, user_id int, company string"
    found = du.drop_existing(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), dedupe_within_batch=within)
    got = {r["id"]: r["already_exists"] for r in found.collect()}
    expected, saved = {}, [(u, c) for _, u, c in old if c is not None]
    for i, user, company in new:
        expected[i] = any(u == user and like(c, company) for u, c in saved)
        if within and not expected[i]:
            saved.append((user, company))
    assert got == expected
    assert 20 < sum(expected.values()) < len(new) - 20


def test_import_defaults(spark):
    new = spark.createDataFrame([(1, 1, "Fresh", None), (2, 1, "", 3), (3, 1, "acme", 9)], "id long, user_id int, company string, score int")
    old = spark.createDataFrame([(1, "The ACME shop")], "user_id int, company string")
    rows = {r["id"]: r for r in ing.import_leads(new, old).collect()}
    assert [rows[i]["outcome"] for i in (1, 2, 3)] == ["imported", "rejected", "exists"]
    assert rows[1]["score"] == 75 and rows[1]["status"] == "Novo" and rows[1]["keywords"] == []
    assert ing.import_report(ing.import_leads(new, old)).first().asDict() == {"imported_count": 1, "error_count": 1}


def test_no_side_that_grows_is_broadcast(spark, tmp_path):
    """Tables whose files are small hold many rows: joins of new with stored leads must not pass one through the driver."""
    fields = "id bigint, user_id bigint, company string, email string, phone string, website string"
    new = spark.createDataFrame([(1, 1, "Small ring 1 Ltda", "A@b.com", "1", "http://x.com")], fields)
    old = spark.createDataFrame([(7, 1, "small ring 1", "a@b.com", None, None), (8, 1, "other", None, "2", None)], fields)
    new.write.parquet(str(tmp_path / "new"))
    old.write.parquet(str(tmp_path / "old"))
    found = du.detect_duplicates(spark.read.parquet(str(tmp_path / "new")), spark.read.parquet(str(tmp_path / "old")))
    assert [(r["similar_name"], r["same_email"], r["same_phone"], r["same_domain"]) for r in found.collect()] == [(True, True, False, False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
