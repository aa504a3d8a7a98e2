"""A corpus pipeline of five stages over ``documents``: language, recurring lines, near-duplicates, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``; intermediate tables of a stage are removed when the next one starts. All but the last return the
columns they were given. Null texts, empty tables and extra columns are handled as the operators say: documents without a letter go in the first stage, everything else follows from the texts.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm.language import fit_languages, fold, keep_identified
from leadlake.llm.mixing import take_copies
from leadlake.llm.pieces import encode_pieces
from leadlake.llm.simhash import keep_unlike
from leadlake.llm.templates import cut_recurring_lines
from leadlake.session import release_stored, stored, stored_folders


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (no letter in the text) go; ``lang`` becomes the language found in the text."""
    return keep_identified(docs, fit_languages(docs.where(fold("doc_id", 3) != 1)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out; documents of which nothing is left go."""
    cut = cut_recurring_lines(docs).where((F.col("n_dropped") == 0) | F.regexp_like("text", F.lit(r"\S")))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(kinds.get("n_chars", "bigint"))}
    return cut.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts whose five-word shingles are similar to 0.8 or more."""
    return keep_unlike(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return take_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document that is left, with the check that they decode to its text."""
    return encode_pieces(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "lossless", "ids")


_OWN: set[str] = set()  # folders that stages have stored steps in


def _stage(function):
    """A stage that first removes what earlier stages stored on their way, as their results are written by now."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = release_stored(set(_OWN), docs)
        before = stored_folders()
        found = function(spark, docs, sf_dir)
        _OWN.clear()
        _OWN.update(left | (stored_folders() - before))
        return found

    return run_stage


STAGES = [
    ("language", _stage(identify_language)),
    ("lines", _stage(drop_lines)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("mix", _stage(mix)),
    ("pieces", _stage(encode)),
]

#: SQL cannot express cross-parsing, ball hashing or keyed merges; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
