"""Toxicity: a convolutional text classifier over hashed word embeddings.

Each word and its first four and five bytes (word families share a stem) are hashed to 64 bits and looked up in a table
of embeddings, whose sum stands for the word; filters of widths 1 to 3 slide over the
text, the highest response of each filter is kept (max pooling), and a linear layer turns these into a logit. All of
it is trained here in numpy on a bounded sample of labelled rows. The threshold is calibrated for each language on
labelled rows that training has not seen; the language of a text is itself read from its words, never from a column.
A score is the logistic of the logit minus that threshold, so 0.5 is the calibrated border everywhere.

Defined results: null and empty texts (and texts without words) get the score of the bare bias, never more than 0.5
away from clean; repeated rows get the same score; labels that are null or belong to no document are left out, and a
document with several labels counts as toxic if one says so; without labels of both classes every score is 0; other
columns of the input are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import ALNUM, LOWER, flat, prefix_hash, slices, span_hash, word_spans

WIDTHS, FILTERS, DIM = (1, 2, 3), 6, 12
SLOTS = 1 << 20
STEMS = (4, 5)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of hashes for each lower-cased word (the word and its stems), and the word offsets of each text."""
    lowered = LOWER[data]
    starts, ends, bounds = word_spans(lowered, offsets, ALNUM)
    sums = prefix_hash(lowered)
    found = [span_hash(sums, starts, ends)]
    found += [span_hash(sums, starts, np.minimum(ends, starts + k)) ^ np.uint64(k) for k in STEMS]
    return np.stack(found, 1), bounds


@dataclass
class Vocabulary:
    """Hashed embeddings table: slot -> row; the hash kept with each row tells a known word from one that collides."""

    row_of: np.ndarray
    hash_of: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray, bounds: np.ndarray, least: int = 3) -> Vocabulary:
        """Rows for the words in ``least`` sampled documents or more. Row 0 is padding, row 1 any other word."""
        once = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
        words, counts = np.unique(np.concatenate(once), return_counts=True)
        words, counts = words[counts >= least], counts[counts >= least]
        words = words[np.argsort(counts, kind="stable")]  # the more frequent word gets a slot that two want
        row_of = np.ones(SLOTS, np.int32)
        row_of[(words % np.uint64(SLOTS)).astype(np.int64)] = np.arange(2, len(words) + 2)
        return cls(row_of, np.concatenate([np.zeros(2, np.uint64), words]))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        rows = self.row_of[(hashes % np.uint64(SLOTS)).astype(np.int64)]
        return np.where(self.hash_of[rows] == hashes, rows, 1)


def padded(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with padding behind each text, so that filters that begin in a text do not reach into the next; text starts; and
    the places where no filter may begin: all padding, but for the first place of a text without words."""
    gap = max(WIDTHS)
    n = len(bounds) - 1
    out = np.zeros((len(rows) + gap * n, rows.shape[1]), np.int32)
    inside = np.arange(len(rows)) + gap * np.repeat(np.arange(n), np.diff(bounds))
    out[inside] = rows
    starts = bounds[:-1] + gap * np.arange(n)
    behind = np.ones(len(out), bool)
    behind[inside] = behind[starts] = False
    return out, starts, np.flatnonzero(behind)


class ConvolutionalClassifier:
    """Embeddings, one bank of filters per width with max pooling, and a linear layer."""

    def __init__(self, words: int, seed: int):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (words, DIM)), "out": r.normal(0, 0.3, len(WIDTHS) * FILTERS), "bias": np.zeros(1)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 0.4, (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][:2] = 0

    def tables(self) -> dict:
        """Each word's share in each filter, so that a convolution is a sum of look-ups."""
        return {w: [self.p["emb"] @ self.p[f"w{w}"][j] for j in range(w)] for w in WIDTHS}

    def pool(self, tables: dict, rows: np.ndarray, starts: np.ndarray, behind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        responses = np.zeros((len(rows), FILTERS), np.float32)
        for j in range(width):
            for part in rows.T:
                responses[: len(rows) - j] += tables[width][j][part[j:]]
        responses[behind] = -np.inf
        return np.maximum.reduceat(responses, starts, axis=0), responses

    def logits(self, rows: np.ndarray, bounds: np.ndarray, tables: dict) -> np.ndarray:
        rows, starts, behind = padded(rows, bounds)
        if not len(starts):
            return np.zeros(0, np.float32)
        pooled = [np.maximum(self.pool(tables, rows, starts, behind, w)[0] + self.p[f"b{w}"], 0) for w in WIDTHS]
        # summed text by text in one order, so that a score hangs on the text alone
        return (np.concatenate(pooled, 1) * self.p["out"]).sum(1) + self.p["bias"][0]

    def gradients(self, rows: np.ndarray, bounds: np.ndarray, truth: np.ndarray, weight: np.ndarray, tables: dict) -> dict:
        rows, starts, behind = padded(rows, bounds)
        ends = np.append(starts[1:], len(rows))
        peaks, pooled = {}, []
        for w in WIDTHS:
            top, responses = self.pool(tables, rows, starts, behind, w)
            where = np.zeros(top.shape, np.int64)
            for i, (a, b) in enumerate(zip(starts, ends)):  # one step per document of a mini-batch
                where[i] = a + responses[a:b].argmax(0)
            peaks[w] = where
            pooled.append(top + self.p[f"b{w}"])
        raw = np.concatenate(pooled, 1)
        active = np.maximum(raw, 0)
        logit = active @ self.p["out"] + self.p["bias"][0]
        error = (1 / (1 + np.exp(-logit)) - truth) * weight / len(truth)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = active.T @ error
        g["bias"][0] = error.sum()
        back = error[:, None] * self.p["out"][None, :] * (raw > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = d.sum(0)
            for j in range(w):
                at = np.minimum(peaks[w] + j, len(rows) - 1)
                for f in range(FILTERS):
                    for part in rows.T:
                        words = np.where(peaks[w][:, f] + j < len(rows), part[at[:, f]], 0)
                        g[f"w{w}"][j, :, f] += d[:, f] @ self.p["emb"][words]
                        np.add.at(g["emb"], words, d[:, f, None] * self.p[f"w{w}"][j, :, f][None, :])
        g["emb"][:2] = 0
        return g

    def train(self, rows: np.ndarray, bounds: np.ndarray, truth: np.ndarray, epochs: int, seed: int, batch: int = 64) -> None:
        r = np.random.default_rng(seed)
        weight = np.where(truth > 0, 0.5 / max(truth.mean(), 1e-6), 0.5 / max(1 - truth.mean(), 1e-6)).astype(np.float32)
        moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(truth))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                parts = [rows[bounds[k] : bounds[k + 1]] for k in some]
                inner = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                g = self.gradients(np.concatenate(parts), inner, truth[some], weight[some], self.tables())
                step += 1
                rate = 0.02 * (1 - epoch / epochs) + 0.002
                for k, v in g.items():
                    v += 1e-5 * self.p[k]
                    moment[k] = 0.9 * moment[k] + 0.1 * v
                    square[k] = 0.99 * square[k] + 0.01 * v * v
                    self.p[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                self.p["emb"][:2] = 0


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    network: ConvolutionalClassifier
    #: log-frequency of each word row in each language, and the calibrated threshold of each language
    language_of: np.ndarray
    thresholds: np.ndarray
    languages: list[str]

    def languages_of(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bounds) - 1, self.language_of.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            out[full] = np.add.reduceat(self.language_of[rows[:, 0]], bounds[:-1][full], axis=0)
        return out.argmax(1)

    def scores(self, data: np.ndarray, offsets: np.ndarray, tables: dict) -> np.ndarray:
        hashes, bounds = word_hashes(data, offsets)
        rows = self.vocabulary.rows(hashes)
        logit = self.network.logits(rows, bounds, tables) - self.thresholds[self.languages_of(rows, bounds)]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def best_threshold(logit: np.ndarray, truth: np.ndarray) -> float:
    """The border with the least sum of the share of toxic texts missed and twice the share of false alarms; in the middle of
    the widest such gap."""
    order = np.argsort(logit)
    x, y = logit[order], truth[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1)
    alarms = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max((1 - y).sum(), 1)
    cost = missed + 2 * alarms
    low = np.concatenate([[x[0] - 2], x])
    high = np.concatenate([x, [x[-1] + 2]])
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    k = best[np.argmax((high - low)[best])]
    return float((low[k] + high[k]) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, lang: str, most: int) -> list:
    """At most about ``most`` labelled documents, half of them toxic where there are so many, chosen by a hash of the key."""
    truth = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in truth.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    if len(sizes) < 2:
        return []
    share = F.when(F.col("toxic") == 1, F.lit(most / 2 / sizes[1])).otherwise(F.lit(most / 2 / sizes[0]))
    mark = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("toxicity sample")), F.lit(1 << 20))
    chosen = truth.where(F.col("toxic").isin(0, 1) & (mark < share * (1 << 20))).limit(2 * most).select(key, "toxic").collect()
    if not chosen:
        return []
    # at most 2 * ``most`` ids: small enough to broadcast whatever the corpus is
    ids = docs.sparkSession.createDataFrame([(r[key], r["toxic"]) for r in chosen], truth.schema)
    rows = docs.join(F.broadcast(ids), key).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), "toxic")
    return sorted(rows.limit(2 * most).collect(), key=lambda r: (str(r["key"]), r["text"] or ""))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", lang: str = "lang",
    sample_rows: int = 4000, epochs: int = 6, seed: int = 7,
) -> ToxicityModel | None:
    """Train on about ``sample_rows`` labelled documents; a fifth of them is kept for the thresholds. ``lang`` only groups
    the sample when word statistics of languages are made: no score reads it."""
    sample = labelled_sample(docs, labels, text, key, label, lang, sample_rows)
    truth = np.array([r["toxic"] for r in sample], np.float32)
    if not len(truth) or truth.min() == truth.max():
        return None
    data, offsets = flat(pa.array([r["text"] for r in sample], pa.string()))
    parts = [word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 19)]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    hashes = np.concatenate([h for h, _ in parts])
    vocabulary = Vocabulary.build(hashes, bounds)
    rows = vocabulary.rows(hashes)
    owner = np.repeat(np.arange(len(sample), dtype=np.int32), np.diff(bounds))
    del hashes, parts
    languages = sorted({r["lang"] or "" for r in sample})
    group = np.array([languages.index(r["lang"] or "") for r in sample])
    table = np.stack([np.bincount(rows[group[owner] == g, 0], minlength=len(vocabulary.hash_of)) for g in range(len(languages))], 1) + 0.5
    table = np.log(table / table.sum(0)).astype(np.float32)
    table[:2] = 0
    network = ConvolutionalClassifier(len(vocabulary.hash_of), seed)
    kept = np.arange(len(sample)) % 5 == 4
    if len({*truth[~kept]}) < 2:
        kept[:] = False
    chosen = np.flatnonzero(~kept)
    parts = [rows[bounds[i] : bounds[i + 1]] for i in chosen]
    network.train(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), truth[chosen], epochs, seed)
    model = ToxicityModel(vocabulary, network, table, np.zeros(len(languages)), languages)
    tables = network.tables()
    logit = np.concatenate([network.logits(rows[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], tables) for i, j in slices(offsets, 1 << 19)])
    found = np.concatenate([model.languages_of(rows[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in slices(offsets, 1 << 19)])
    judge = kept if kept.any() and len({*truth[kept]}) == 2 else np.ones(len(sample), bool)
    overall = best_threshold(logit[judge], truth[judge])
    for g in range(len(languages)):
        own = judge & (found == g)
        enough = min(truth[own].sum(), (1 - truth[own]).sum()) >= 20
        model.thresholds[g] = best_threshold(logit[own], truth[own]) if enough else overall
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    if model is None:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        tables = model.network.tables()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            out = np.zeros(len(offsets) - 1)
            for i, j in slices(offsets, 1 << 20):
                part = offsets[i : j + 1]
                out[i:j] = model.scores(data[part[0] : part[-1]], part - part[0], tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["key", "score"])

    found = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), score, f"key {kind}, score double")
    return found.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
