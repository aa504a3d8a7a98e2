"""Line dedup by log-template trees of fixed depth, whose leaves learn.

The levels of a tree are the number of tokens of a line and three leading tokens. Two more trees take two leading tokens and
the last one, or the last three, for lines whose variable fields stand at these places. Tokens with a digit are variable
everywhere. The different lines of a leaf, three or more, tell which tokens are fixed: a token that stands at its place in
three of them or more, and in a sixteenth of them (or in two, and in half of them, by a second reading), is; the others are
variable fields, wherever they stand and however many there are. A template is named by the fixed tokens and their places. It
needs four fixed tokens and fixed tokens at six places in ten, so that prose, whose lines share little more than a path, has none.

Each line belongs to its literal template (variable where there are digits) and the learned ones. Templates in
``least_documents`` documents or more are dropped everywhere but at their first line. Leaves learn from different lines, so a
line that is copied often counts once; a leaf of more than ``SHARD`` lines is dealt by hash into shards that learn alike.

Defined results: a null text has no lines and stays null; blank lines belong to no template and stay; the first line is
the one in the document with the smallest key (then text hash, then place); a template that recurs within one document
only is left alone; repeated rows count each and get the same text; an empty table gives an empty table; all columns of the
input are kept, with the text replaced, but for columns named ``n_lines`` and ``n_dropped``, which are replaced, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.filters import in_filter, make_filter
from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import NOT_SPACE, flat, mix, prefix_hash, slices, span_hash, word_spans
from leadlake.session import stored

#: Different lines of a leaf that learn together at most (about), and tokens that are read together.
SHARD, TOGETHER = 4096, 1 << 19
#: A token is fixed that stands in so many lines of its leaf and in one of so many; for each reading.
READINGS = ((3, 16), (2, 2))
#: Different lines of a leaf that learns.
LEAST_LINES = 3
#: Fixed tokens of a template: so many, and so many in ten.
LEAST_FIXED, FIXED_IN_TEN = 4, 6
VARIABLE = np.uint64(0x5851F42D4C957F2D)
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_TREE = np.uint64(0x2545F4914F6CDD1D)
TREES = ["lead", "ends", "tail"]


class Lines:
    """The lines of some texts that have a token. ``value`` and ``fixed`` are of tokens: a hash with the place, and whether it
    has no digit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, _ = word_spans(data, offsets, NOT_SPACE)
        digits = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
        self.fixed = digits[ends] == digits[starts]
        token = np.where(self.fixed, span_hash(prefix_hash(data), starts, ends), VARIABLE)
        # a line is known by its text and the line breaks before it
        breaks = np.flatnonzero(data == 10)
        text = np.searchsorted(offsets, starts, "right") - 1
        line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[text])
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
        self.at = at = np.flatnonzero(fresh)
        self.text, self.line = text[at], line[at]
        self.size = np.diff(np.append(at, len(starts)))
        nth = np.arange(len(starts)) - np.repeat(at, self.size)
        self.value = mix(token + nth.astype(np.uint64) * _PLACE)
        n, last = self.size.astype(np.uint64), at + self.size - 1
        self.literal = mix((np.add.reduceat(self.value, at) if len(at) else self.value) + n)
        after = [token[np.minimum(at + k, last)] for k in range(3)]
        before = [token[np.maximum(last - k, at)] for k in range(3)]
        self.leaves = [
            _path(n, k, path) for k, path in enumerate(((after[0], after[1], after[2]), (after[0], after[1], before[0]), (before[0], before[1], before[2])))
        ]


def _path(n: np.ndarray, tree: int, tokens: tuple[np.ndarray, ...]) -> np.ndarray:
    name = mix(n + np.uint64(tree) * _TREE)
    for token in tokens:
        name = mix(name ^ token)
    return name


def named_template(value: np.ndarray, fixed: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of each line by its fixed tokens, and whether it has enough of them, and a variable one."""
    count = np.add.reduceat(fixed.astype(np.int64), at)
    name = mix(np.add.reduceat(np.where(fixed, value, np.uint64(0)), at) ^ (size.astype(np.uint64) * VARIABLE))
    return name, (count >= LEAST_FIXED) & (10 * count >= FIXED_IN_TEN * size) & (count < size)


def learned_templates(group: np.ndarray, size: np.ndarray, value: np.ndarray, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each reading, the template of each line and whether it is one. ``group``: the leaf of each line, ascending; ``value``
    and ``known`` (no digit) are those of the lines' tokens."""
    at = np.cumsum(size) - size
    owner = np.repeat(group, size)
    order = np.lexsort((value, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (value[order[1:]] != value[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    count = np.empty(len(order), np.int64)
    count[order] = np.diff(np.flatnonzero(fresh), append=len(order))[np.cumsum(fresh) - 1]
    lines = np.bincount(group)[owner]
    known = known & (lines >= LEAST_LINES)
    return [named_template(value, known & (count >= least) & (count * share >= lines), at, size) for least, share in READINGS]


def _identity(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def line_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, row, key, line, literal, fresh, lead, ends, tail) of every line with a token: its document (each row of ``docs`` is one), a
    hash of key and text, the literal template (``fresh``: 1 for its first line in the document) and the leaves of the trees."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        before = 0
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in slices(offsets, 1 << 20):
                found = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                fresh = np.ones(len(found.text), np.int32)
                order = np.lexsort((found.line, found.literal, found.text))
                fresh[order[1:]] = (found.literal[order[1:]] != found.literal[order[:-1]]) | (found.text[order[1:]] != found.text[order[:-1]])
                take = pa.array(found.text + i)
                part = np.asarray(batch.column(3), np.int64)[found.text + i]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part << 33 | (before + i + found.text)), batch.column(0).take(take), batch.column(1).take(take), pa.array(found.line.astype(np.int32)),
                        *[pa.array(x.view(np.int64)) for x in (found.literal, *found.leaves)], pa.array(fresh),
                    ],
                    names=["doc", "row", "key", "line", "literal", *TREES, "fresh"],
                )
            before += batch.num_rows

    rows = docs.select(_identity(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    return map_arrow(rows, work, f"doc bigint, row bigint, key {kind}, line int, literal bigint, lead bigint, ends bigint, tail bigint, fresh int")


def _lines_of_leaves(docs: DataFrame, leaves: DataFrame, text: str) -> DataFrame:
    """(leaf, literal, tokens) of the different lines of the leaves: (leaf). A task sends a line once; lines of a few other leaves may
    be among them."""
    shared = docs.sparkSession.sparkContext.broadcast(make_filter(leaves, "leaf"))

    def work(batches):
        sent = np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in slices(offsets, 1 << 20):
                found = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                literal, once = np.unique(found.literal, return_index=True)
                live = [in_filter(shared.value, leaf[once]) & (found.size[once] > LEAST_FIXED) for leaf in found.leaves]
                fresh = np.logical_or.reduce(live) & ~np.isin(literal, sent, assume_unique=True)
                sent = np.union1d(sent, literal[fresh])
                # a token is its hash, with the lowest bit set where it has no digit
                marked = (found.value & ~np.uint64(1)) | found.fixed
                for leaf, own in zip(found.leaves, live):
                    some = once[own & fresh]
                    bodies = [marked[a : a + n].tobytes() for a, n in zip(found.at[some].tolist(), found.size[some].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[some].view(np.int64)), pa.array(found.literal[some].view(np.int64)), pa.array(bodies, pa.binary())], names=["leaf", "literal", "tokens"]
                    )

    return map_arrow(docs.select(F.col(text).alias("text")), work, "leaf bigint, literal bigint, tokens binary")


def _learned(lines: DataFrame, large: DataFrame | None) -> DataFrame:
    """(literal, template): the learned templates of the lines of each leaf, or of each shard of the large ones: (leaf, shards)."""

    def solve(rows):
        leaf, part, literal = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])
        size = np.array([len(r[3]) // 8 for r in rows])
        value = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
        found = learned_templates(np.cumsum(fresh) - 1, size, value, (value & np.uint64(1)).astype(bool))
        names = [(literal[is_one], name[is_one]) for name, is_one in found]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for a, _ in names])), pa.array(np.concatenate([b for _, b in names]).view(np.int64))], names=["literal", "template"])

    def work(batches):
        held, tokens = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] == held[-1][:3]:  # sent by another task, too
                    continue
                if tokens >= TOGETHER and row[:2] != held[-1][:2]:
                    yield solve(held)
                    held, tokens = [], 0
                held.append(row)
                tokens += len(row[3]) // 8
        if held:
            yield solve(held)

    part = F.lit(0).cast("bigint")
    if large is not None:
        lines, part = lines.join(large, "leaf", "left"), F.pmod("literal", F.coalesce("shards", F.lit(1)))
    dealt = lines.select("leaf", part.alias("shard"), "literal", "tokens")
    dealt = dealt.repartition("leaf", "shard").sortWithinPartitions("leaf", "shard", "literal")
    return map_arrow(dealt, work, "literal bigint, template bigint").distinct()


def dropped_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_documents: int = 3, shard: int = SHARD) -> DataFrame:
    """(row, lines): the lines to drop of each (key, text), by its hash."""
    lines = stored(line_rows(docs, text, key), "lines")
    first = F.min(F.struct("key", "row", "line")).alias("first")
    # a hot line is summed before it is shuffled
    recurring = lines.groupBy("literal").agg(F.sum("fresh").alias("documents"), first).where(F.col("documents") >= least_documents)
    recurring = stored(recurring.select("literal", "first"), "literals")
    members_of = lines.select("literal", F.explode(F.array(*TREES)).alias("leaf"))
    leaves = stored(members_of.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LINES), "leaves")
    large = leaves.where(F.col("n") > shard).select("leaf")
    if large.isEmpty():
        large = None
    else:  # copies of a line do not make a leaf large
        large = members_of.join(large, "leaf").groupBy("leaf").agg(F.count_distinct("literal").alias("n"))
        large = stored(large.where(F.col("n") > shard).select("leaf", F.ceil(F.col("n") / shard).alias("shards")), "large-leaves")
    learned = stored(_learned(_lines_of_leaves(docs, leaves, text), large), "templates")
    # the side of the lines may be skewed to one line, which a sort-merge join splits; a literal has a few templates at most
    members = lines.select("literal", "doc", "key", "row", "line").join(learned.hint("merge"), "literal")
    general = members.groupBy("template").agg(F.count_distinct("doc").alias("documents"), first).where(F.col("documents") >= least_documents)
    later = (F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line"))
    exact = lines.select("literal", "row", "line").join(recurring.hint("merge"), "literal").where(later).select("row", "line")
    alike = members.select("template", "row", "line").join(general.select("template", "first").hint("merge"), "template").where(later).select("row", "line")
    return exact.unionByName(alike).groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def cut_recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_documents: int = 3, shard: int = SHARD) -> DataFrame:
    """(doc, text, n_lines, n_dropped): each row of ``docs`` as a struct, so that no name can clash, with its text as cut."""
    dropped = dropped_lines(docs, text, key, least_documents, shard)
    rows = docs.select(_identity(key, text).alias("row"), F.struct("*").alias("doc"))
    whole = F.col(f"doc.`{text}`")
    lines = F.split(whole, "\n", -1)
    # places of lines count from 0
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("lines"), i))
    cut = F.when(F.col("lines").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    count = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return rows.join(dropped, "row", "left").select("doc", cut.alias("text"), count(lines).alias("n_lines"), count(F.col("lines")).alias("n_dropped"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_documents: int = 3, shard: int = SHARD) -> DataFrame:
    """``docs`` with recurring lines cut out of the text, and the columns ``n_lines`` and ``n_dropped``."""
    cut = cut_recurring_lines(docs, text, key, least_documents, shard)
    own = [F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*own, "n_lines", "n_dropped")
