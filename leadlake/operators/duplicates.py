"""Duplicate and existence checks between a batch of new leads and the stored ones.

No step pairs all members of a group. Keys are made distinct before they meet, similar names meet by
their rarest words, names inside names by a sorted table of suffixes, and the remaining comparisons are
semi-joins that stop at the first match. Both sides grow with the tables, and their files are far smaller than their rows, so
these joins ask for a merge: a broadcast would pass a whole side through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.common import filled
from leadlake.functions.contact import company_words, url_domain_bare
from leadlake.operators.suffixes import containing, least_containing, suffix_table

# Similarity of names must exceed this share of common words (4 of 5; kept as whole numbers, so tests are exact).
SHARED, OF = 4, 5


def _least_shared(n: Column, m: Column) -> Column:
    """Words that sets of n and m words must share: the least s with s / (n + m - s) > 4/5."""
    return F.floor((n + m) * SHARED / (SHARED + OF)) + 1


def _prefixes(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """(words, n, word, place): the rarest words of each name, as many as a similar name cannot lack all of.

    Of n words a similar name shares more than 4/5, so one of the n - floor(4 n / 5) rarest is shared; ``place`` counts
    from the rarest word.
    """
    listed = names.select("words", F.explode("words").alias("word")).join(frequency.hint("merge"), "word")
    ordered = listed.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("by_df"))
    n = F.size("words")
    prefix = F.slice(F.col("by_df.word"), F.lit(1), n - F.floor(n * SHARED / OF).cast("int"))
    return ordered.select("words", n.alias("n"), F.posexplode(prefix).alias("place", "word"))


def _similar(new_names: DataFrame, old_names: DataFrame) -> DataFrame:
    """Distinct new word sets similar to some old one: a set-similarity join on the rarest words.

    Words are ordered by their frequency in both tables, so a word that half of the names hold is in few prefixes. Names
    meet by (word, number of words): a new name asks for each size that a similar name can have, which also splits
    a frequent word by size. The places of the shared word bound what two names can share at best; only those that
    can reach the threshold are compared, as a semi-join that ends at the first similar name.
    """
    every = new_names.unionByName(old_names).select(F.explode("words").alias("word"))
    frequency = every.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n")
    sizes = F.sequence((F.floor(n * SHARED / OF) + 1).cast("int"), (F.ceil(n * OF / SHARED) - 1).cast("int"))
    a = _prefixes(new_names, frequency).withColumn("m", F.explode(sizes)).alias("a")
    b = _prefixes(old_names, frequency).alias("b")
    needed = _least_shared(F.col("a.n"), F.col("b.n"))
    at_best = 1 + F.least(F.col("a.n") - 1 - F.col("a.place"), F.col("b.n") - 1 - F.col("b.place"))
    shared = F.size(F.array_intersect("a.words", "b.words"))
    alike = (F.col("a.word") == F.col("b.word")) & (F.col("a.m") == F.col("b.n")) & (at_best >= needed) & (shared >= needed)
    return a.join(b.hint("merge"), alike, "left_semi").select("words")


def _word_sets(leads: DataFrame) -> DataFrame:
    words = company_words(F.col("company"))
    return leads.select(words.alias("words")).filter(F.size("words") > 0).distinct()


def similar_name_sets(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct word sets of new company names that are similar to an existing name."""
    return _similar(_word_sets(new), _word_sets(existing)).distinct()


def _known_keys(existing: DataFrame, key: Column) -> DataFrame:
    return existing.select(key.alias("key")).filter(filled(F.col("key"))).distinct()


def detect_duplicates(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Each new lead with the reasons it duplicates an existing one and the overall verdict.

    ``new`` needs a unique ``key`` and company, email, phone and website.
    """
    keys = {
        "same_email": F.lower(F.col("email")),
        "same_phone": F.col("phone"),
        "same_domain": url_domain_bare(F.col("website")),
    }
    matches = []
    for reason, value in keys.items():
        mine = new.select(F.col(key), value.alias("key")).filter(filled(F.col("key")))
        matches.append(
            mine.join(_known_keys(existing, value).hint("merge"), "key", "left_semi").select(key, F.lit(reason).alias("reason"))
        )
    mine = new.select(F.col(key), company_words(F.col("company")).alias("words"))
    similar = mine.join(similar_name_sets(new, existing).hint("merge"), "words", "left_semi")
    matches.append(similar.select(key, F.lit("similar_name").alias("reason")))
    found = matches[0]
    for other in matches[1:]:
        found = found.unionByName(other)
    names = ["similar_name", *keys]
    per_lead = found.groupBy(key).agg(*[F.max(F.col("reason") == n).alias(n) for n in names])
    joined = new.join(per_lead.hint("merge"), key, "left")
    for n in names:
        joined = joined.withColumn(n, F.coalesce(n, F.lit(False)))
    verdict = F.col(names[0])
    for n in names[1:]:
        verdict = verdict | F.col(n)
    return joined.withColumn("is_duplicate", verdict)


# --- existence by name containment -----------------------------------------------------------


def _literal_part(name: Column) -> Column:
    """The longest piece of a lower-cased name that holds no pattern wildcard."""
    pieces = F.split(name, "[%_]")
    longest = F.array_max(F.transform(pieces, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return longest["s"]


def names_already_present(new: DataFrame, existing: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct (user_id, company) of ``new`` that some company name of ``existing`` contains.

    Containment is case-insensitive and ``%`` and ``_`` in the new name are wildcards. Names are looked up in a table of the
    suffixes of the existing ones; names with wildcards by their longest literal piece, and then by the full test, which ends
    at the first hit. With ``ordered`` both sides carry ``seq`` and only an earlier row counts (equal names: see
    :func:`drop_existing`).
    """
    name, user = F.lower(F.col("company")), F.col("user_id").cast("bigint").alias("scope")
    old_seq, new_seq = (F.min("seq"), F.min("seq")) if ordered else (F.min(F.lit(0)), F.min(F.lit(1)))
    old = existing.filter(name.isNotNull()).groupBy(user, name.alias("text")).agg(old_seq.cast("bigint").alias("value"))
    mine = new.filter(filled(name)).groupBy(user, name.alias("pattern")).agg(new_seq.cast("bigint").alias("seq"))
    mine = mine.withColumn("piece", _literal_part(F.col("pattern")))

    plain = mine.filter(F.col("piece") == F.col("pattern"))
    least = least_containing(suffix_table(old, True), plain)
    found = plain.join(least.hint("merge"), ["scope", "piece"]).filter(F.col("value") < F.col("seq")).select("scope", "pattern")

    # With wildcards the piece alone proves nothing: the names that hold it are tested.
    some = mine.filter((F.col("piece") != F.col("pattern")) & (F.length("piece") > 0))
    if not some.isEmpty():
        n, s = some.alias("n"), containing(old, some).join(old, ["scope", "text"]).alias("s")
        like = F.ilike(F.col("s.text"), F.concat(F.lit("%"), F.col("n.pattern"), F.lit("%")), F.lit("\u0001"))
        test = (F.col("n.scope") == F.col("s.scope")) & (F.col("n.piece") == F.col("s.piece")) & (F.col("s.value") < F.col("n.seq")) & like
        found = found.unionByName(n.join(s, test, "left_semi").select("scope", "pattern"))

    # Names made of wildcards only: "_" stands for one character, "%" for any number.
    wild = mine.filter(F.length("piece") == 0).withColumn("needed", F.length(F.regexp_replace("pattern", "[^_]", "")))
    by_length = old.groupBy("scope", F.length("text").alias("length")).agg(F.min("value").alias("value"))
    fits = (F.col("w.scope") == F.col("o.scope")) & (F.col("o.length") >= F.col("w.needed")) & (F.col("o.value") < F.col("w.seq"))
    wild_found = wild.alias("w").join(by_length.alias("o"), fits, "left_semi").select("scope", "pattern")
    return found.unionByName(wild_found).select(F.col("scope").alias("user_id"), F.col("pattern").alias("name")).distinct()


def drop_existing(
    new: DataFrame, existing: DataFrame, key: str = "id", dedupe_within_batch: bool = False
) -> DataFrame:
    """New leads with ``already_exists``: a stored lead of the same user contains the company name.

    With ``dedupe_within_batch`` an earlier row of the batch (smaller ``key``) counts as stored too.
    "Contains" is transitive, so it does not matter whether that earlier row was itself dropped.
    """
    name = F.lower(F.col("company"))
    present = names_already_present(new, existing).withColumn("known", F.lit(True))
    joined = new.withColumn("name", name).join(present.hint("merge"), ["user_id", "name"], "left")
    exists = F.coalesce("known", F.lit(False))
    if dedupe_within_batch:
        batch = new.withColumn("seq", F.col(key))
        earlier = names_already_present(batch, batch, ordered=True).withColumn("in_batch", F.lit(True))
        first = batch.groupBy("user_id", name.alias("name")).agg(F.min("seq").alias("first_seq"))
        joined = joined.join(earlier.hint("merge"), ["user_id", "name"], "left").join(first.hint("merge"), ["user_id", "name"], "left")
        repeated = filled(F.col("name")) & F.coalesce(F.col(key) > F.col("first_seq"), F.lit(False))
        exists = exists | F.coalesce("in_batch", F.lit(False)) | repeated
    return joined.withColumn("already_exists", exists).drop("name", "known", "in_batch", "first_seq")
