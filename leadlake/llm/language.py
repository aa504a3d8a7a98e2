"""Language identification by cross-parsing entropy.

Each language gets a suffix automaton of a bounded sample of its labelled text. A text is cut into the fewest
phrases that all occur in that sample (longest match after longest match), and the language that needs the fewest
phrases per symbol wins. Only bytes of letters and the gaps between words count.

Defined results: null texts and texts without a letter give ``und`` with score 0; ties go to the language first in
code point order; with nothing to learn from, every text is ``und``; an empty table gives an empty table; repeated rows
are answered one by one; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import flat, slices

UNKNOWN = "und"
#: Phrases end at the borders of segments of this many bytes, so that segments can be parsed side by side.
SEGMENT = 1024


def _symbols() -> np.ndarray:
    """Byte -> symbol: 0 gap (space, punctuation, digits), 1-26 letters without case, 27-90 bytes of non-ASCII letters."""
    table = np.zeros(256, np.int32)
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    table[0x80:0xC0] = 27 + np.arange(64)
    table[0xC0:] = 27 + np.arange(64)
    return table


SYMBOLS, ALPHABET = _symbols(), 91


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text with runs of gaps made one, and the new offsets."""
    symbols = SYMBOLS[data]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    kept = np.zeros(len(symbols) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return symbols[keep], kept[offsets]


def automaton(sequence: list[int]) -> np.ndarray:
    """The suffix automaton of ``sequence`` as a parsing table: entry [state * ALPHABET + symbol] holds twice the next
    row's start, plus one where the symbol cannot extend the phrase and so begins the next."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in sequence:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    restart = np.zeros(ALPHABET, np.int32)
    for c, to in moves[0].items():
        restart[c] = to * ALPHABET * 2
    table = np.repeat((restart | 1)[None, :], len(moves), axis=0)
    for state, row in enumerate(moves):
        for c, to in row.items():
            table[state, c] = to * ALPHABET * 2
    table[0] |= 1  # at the start of a segment any symbol begins a phrase
    return table.reshape(-1)


@dataclass
class LanguageModel:
    """Parsing tables by language, in code point order of the names."""

    languages: list[str]
    tables: list[np.ndarray]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed by each language for each text, and the symbols of each text."""
        symbols, offsets = normalise(data, offsets)
        n = np.diff(offsets)
        pieces = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, offsets[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), "right")
        counts = np.zeros((len(self.tables), len(owner)), np.int64)
        states = np.zeros((len(self.tables), len(owner)), np.int32)
        for step, m in enumerate(active):
            c = symbols[begin[:m] + step]
            for k, table in enumerate(self.tables):
                move = table[states[k, :m] + c]
                counts[k, :m] += move & 1
                states[k, :m] = move >> 1
        out = np.zeros((len(self.tables), len(n)))
        for k in range(len(self.tables)):
            out[k] = np.bincount(owner, counts[k], len(n))
        return out, n

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language, and how far it is ahead of the second (0 to 1)."""
        phrases, n = self.phrases(data, offsets)
        best = phrases.argmin(0)
        ranked = np.sort(phrases, axis=0)
        second = ranked[1] if len(ranked) > 1 else np.full(len(n), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(n > 0, 1 - ranked[0] / np.maximum(second, 1), 0.0)
        return best, np.clip(score, 0, 1)


def fit_languages(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    rows_per_language: int = 150, bytes_per_row: int = 400, bytes_per_language: int = 30_000,
) -> LanguageModel:
    """Learn from a bounded sample: about ``rows_per_language`` rows by a hash of their key, of each a stretch of
    ``bytes_per_row`` characters from a place that the hash names, and ``bytes_per_language`` symbols in all."""
    rows = labelled.where(F.col(lang).isNotNull() & has_letter(F.col(text)))
    sizes = rows.groupBy(F.col(lang).alias("lang")).count().orderBy("lang").collect()
    if not sizes:
        return LanguageModel([], [])
    share = F.coalesce(*[F.when(F.col(lang) == r["lang"], F.lit(rows_per_language / r["count"])) for r in sizes])
    mark = F.xxhash64(F.col(key).cast("string"), F.lit("language sample"))
    spot = F.greatest(F.lit(1), F.pmod(F.shiftright(mark, 20), F.greatest(F.length(text) - bytes_per_row, F.lit(1))).cast("int") + 1)
    sample = (
        rows.where(F.pmod(mark, F.lit(1 << 20)) < share * (1 << 20))
        .select(F.col(lang).alias("lang"), mark.alias("mark"), F.substring(F.col(text), spot, F.lit(bytes_per_row)).alias("text"))
        .orderBy("lang", "mark", "text").limit(2 * rows_per_language * len(sizes))
        .collect()
    )
    names, tables = [], []
    for name in sorted({r["lang"] for r in sample}):
        texts = [" " + r["text"] + " " for r in sample if r["lang"] == name]
        symbols, _ = normalise(*flat(pa.array(["".join(texts)])))
        names.append(name)
        tables.append(automaton(symbols[:bytes_per_language].tolist()))
    return LanguageModel(names, tables)


def _answers(model: LanguageModel, texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text; ``known`` says which texts have a letter."""
    data, offsets = flat(texts)
    names = np.full(len(known), UNKNOWN, object)
    scores = np.zeros(len(known))
    if model.languages:
        for i, j in slices(offsets):
            part = offsets[i : j + 1]
            best, score = model.predict(data[part[0] : part[-1]], part - part[0])
            names[i:j] = np.array(model.languages, object)[best]
            scores[i:j] = score
        names[~known] = UNKNOWN
        scores[~known] = 0
    return names, scores


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType

    def parse(batches):
        for batch in batches:
            known = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            names, scores = _answers(shared.value, batch.column(1), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), has_letter(F.col(text)).alias("known"))
    return map_arrow(rows, parse, f"key {kind.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a language of the model, with all their columns in place and ``lang`` (where
    there is such a column) set to what was found. Rows are answered where they are read: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = StructType([StructField(f.name, StringType() if f.name == lang else f.dataType) for f in docs.schema])

    def parse(batches):
        for batch in batches:
            found, _ = _answers(shared.value, batch.column(names.index(text)), np.ones(len(batch), bool))
            columns = [pa.array(found, pa.string()) if n == lang else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(found != UNKNOWN))

    return map_arrow(docs.where(has_letter(F.col(f"`{text}`"))), parse, schema)


def fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds
