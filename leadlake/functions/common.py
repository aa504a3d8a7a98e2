"""Small Column helpers shared by the function modules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def str_array(values: Iterable[str]) -> Column:
    """A literal array of texts. Splitting one literal folds to a constant and keeps the plan short."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True if any word occurs in the text: a few searches, or one pattern for long lists."""
    words = list(words)
    if len(words) <= 6:
        return any_of(F.contains(text, F.lit(w)) for w in words)
    return F.rlike(text, F.lit("|".join(re.escape(w) for w in words)))


def filled(col: Column) -> Column:
    """Not null and not the empty string, as a plain true/false (never null)."""
    return F.coalesce(col != "", F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def keep_if(value: Column, test) -> Column:
    """``value`` if it passes ``test``, else null; evaluated once however often the test mentions it."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, null when there is none or it is empty."""
    return keep_if(F.regexp_extract(text, pattern, group), lambda v: v != "")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share of ``whole`` in percent, half-even rounded; 0 when there is no whole."""
    return F.bround(F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0)), digits)


def flags(*pairs: tuple[Column, str]) -> Column:
    """The labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def first_group_match(text: Column, groups: list[tuple[str, list[str]]], test) -> Column:
    """Name of the first group for which ``test(text, words)`` holds, else null."""
    result = None
    for name, words in groups:
        cond = test(text, words)
        result = F.when(cond, F.lit(name)) if result is None else result.when(cond, F.lit(name))
    return result


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (also in nested lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Every character that counts as white space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))
