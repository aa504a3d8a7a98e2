import random

import pytest

from corpus_words import DE, EN, sentence

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id bigint, key string, _row bigint"


def make_rows():
    """Small texts with copies, near copies, shared lines, nulls, empty and long texts, repeated rows; the columns after
    n_chars only clash with names that operators use."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words, lang = (EN, "en") if i % 3 else (DE, "de")
        text = "\n".join(sentence(rng, words, rng.randint(4, 30)) for _ in range(rng.randint(1, 5)))
        rows.append([i, text, lang, f"s{i % 4}"])
    long = rows[1][1] * 2
    for i in range(60, 70):
        rows.append([i, rows[i - 60][1], rows[i - 60][2], "copies"])
    for i in range(70, 80):
        rows.append([i, rows[4][1] + " " + rng.choice(EN), "en", "copies"])
    for i in range(80, 90):
        rows.append([i, sentence(rng, EN, 12) + f"\nPage {i} of 100 was printed for user{i} on the {i}th day\n" + sentence(rng, EN, 9), "en", "s1"])
    rows += [[90, None, "en", "s1"], [91, "", None, None], [92, " \n\t ", "en", None], [93, "12 34 !!", "de", "s2"], [94, long * 40, "en", "s3"]]
    rows += [[95, "ab" * 300, "en", "s0"], [95, "ab" * 300, "en", "s0"], [96, None, None, None], [96, None, None, None]]
    rows += [[None, "a text without an id and with the mit license in it", "en", "s0"], [97, "漢字▁😀 ñ\x00 mix", "en", "s2"]]
    return [(a, t, g, s, None if t is None else len(t), 0.5, 7, "k", 1) for a, t, g, s in rows]


@pytest.fixture(scope="session")
def corpus_rows():
    return make_rows()


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

