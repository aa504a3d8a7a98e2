"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

Every source gets a target of words by water-filling: weight shares, capped at a multiple of the source's size, with the
excess shared again by weight. A document of a source should then be taken ``target / size of the source`` times: the
whole part is certain, and the fraction is rounded dependently. Two fractional documents transfer mass between them at
random until one is integral, so that expectations and the words of the pair both stay; the other carries on. Blocks
of documents are reduced so to one residual each, residuals are put into blocks again, and so on: a reduction tree
whose rounds shrink by the block size. The last residual of a source takes the words that are left to it.

Defined results: a null text has size 0, takes nothing and weighs nothing; a null source is a source of its own, last in
order; sources of size 0 have target 0; repeated rows are separate documents; the outcome depends on the rows and the
seed only; an empty table gives an empty table; other columns of the input stay untouched in :func:`take_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.session import stored

WEIGHTS = (3, 1, 2)
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text: its runs of other characters, by their lengths without inner words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(marks, SPACE, "")).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) of every source.

    The water level is exact: sources sorted by the level at which they reach their cap; the level that uses up the
    total lies behind the sources whose caps it exceeds.
    """
    per_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    # null sources last, then by code points (Spark compares UTF-8 bytes, which agrees)
    ranked = running(per_source.withColumn("no_name", F.col("source").isNull()), ["no_name", "source"], {})
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, all_weight = total_share * (whole["size"] or 0), whole["weight"] or 0.0
    levels = running(ranked.drop("no_name").withColumnRenamed("nth", "place"), ["full_at", "place"], {"capped": "cap", "closed": "weight"})
    # the level if exactly the sources before this one are at their caps; the first that fits is the water level
    level = (F.lit(total) - (F.col("capped") - F.col("cap"))) / (F.lit(all_weight) - F.col("closed") + F.col("weight"))
    fit = levels.withColumn("level", level).where(F.col("level") <= F.col("full_at")).agg(F.min(F.struct("full_at", "place", "level")).alias("fit")).first()["fit"]
    poured = F.col("weight") * F.lit(fit["level"]) if fit else F.col("cap")
    return ranked.select("source", "source_size", F.least("cap", poured).alias("target"))


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with ``nth``, their place in ``order`` from 1, and running sums (name: column), up to the row itself. Rows are cut
    into ranges; each range adds what the ranges before it hold, so no task sees them all."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("range").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"all_{name}") for name, c in sums.items()])
    earlier = held.select(F.col("range").alias("earlier"), "rows", *[f"all_{name}" for name in sums])
    # one row per range, each with the ranges before it
    behind = held.select("range").join(earlier, F.col("earlier") < F.col("range"), "left").groupBy("range")
    behind = behind.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(f"all_{name}"), F.lit(0)).alias(f"all_{name}") for name in sums])
    own = Window.partitionBy("range").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", F.row_number().over(own).alias("local"), *[F.sum(c).over(upto).alias(f"local_{name}") for name, c in sums.items()])
    joined = local.join(behind, "range")
    return joined.select(*rows.columns, (F.col("rows") + F.col("local")).alias("nth"), *[(F.col(f"all_{name}") + F.col(f"local_{name}")).alias(name) for name in sums])


def _body(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(seed: int):
    """Fold step of a block: the residual so far meets the next document; whichever becomes integral is done."""

    def step(state: Column, unit: Column) -> Column:
        a, u = state["size"].cast("double"), state["mass"]
        b, v = unit["size"].cast("double"), unit["mass"]
        up, down = F.least(a - u, v), F.least(u, b - v)  # mass that can go to the residual, or away from it
        gains = _draw(F.lit(seed), state["id"], unit["id"]) * (up + down) < down
        moved_a = F.when(gains, u + up).otherwise(u - down)
        moved_b = F.when(gains, v - up).otherwise(v + down)
        # the limiting side becomes exactly integral: compare the limits, not the sums
        a_done = F.when(gains, a - u <= v).otherwise(u <= b - v)
        a_full = gains
        b_full = ~gains
        settled_a = F.struct(state["id"].alias("id"), F.when(a_full, F.lit(1)).otherwise(F.lit(0)).alias("extra"))
        settled_b = F.struct(unit["id"].alias("id"), F.when(b_full, F.lit(1)).otherwise(F.lit(0)).alias("extra"))
        return (
            F.when(state["id"].isNull(), F.struct(unit["id"].alias("id"), unit["size"].alias("size"), unit["mass"].alias("mass"), state["done"].alias("done")))
            .when(a_done, F.struct(unit["id"].alias("id"), unit["size"].alias("size"), moved_b.alias("mass"), F.concat(state["done"], F.array(settled_a)).alias("done")))
            .otherwise(F.struct(state["id"].alias("id"), state["size"].alias("size"), moved_a.alias("mass"), F.concat(state["done"], F.array(settled_b)).alias("done")))
        )

    return step


def dependent_rounding(units: DataFrame, seed: int = 11, block: int = 64) -> DataFrame:
    """(id, extra, rest): which fractional units get their extra copy (0 or 1), and for the last of a source the words
    left to it. ``units``: source, id (unique), size, mass (fraction times size, strictly between 0 and size).

    Each round puts about ``block`` units of a source together by a hash of their ids, so no group grows with the table.
    """
    start = F.expr("named_struct('id', cast(null as bigint), 'size', 0L, 'mass', 0D, 'done', cast(array() as array<struct<id: bigint, extra: int>>))")
    settled: DataFrame | None = None
    level, largest = 0, units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while True:
        groups = max(1, -(-largest // block)) if largest > 1 else 1
        last = groups == 1
        place = F.lit(0).cast("bigint") if last else F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.lit(groups))
        folded = (
            units.groupBy("source", place.alias("place"))
            .agg(F.sort_array(F.collect_list(F.struct("id", "size", "mass"))).alias("units"))
            .select("source", F.aggregate("units", start, _pivot(seed + level)).alias("end"))
        )
        folded = stored(folded, f"rounding-{level}")
        done = folded.select(F.explode("end.done").alias("d")).select("d.id", "d.extra", F.lit(0.0).alias("rest"))
        settled = done if settled is None else settled.unionByName(done)
        units = folded.where("end.id is not null").select("source", "end.id", "end.size", "end.mass")
        if last:
            return settled.unionByName(units.select("id", F.lit(0).alias("extra"), F.col("mass").alias("rest")))
        level, largest = level + 1, groups


def mix_sources(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
    total_share: float = 1.5, most: float = 2.0, seed: int = 11,
) -> DataFrame:
    """(key, body, nth, source, size, source_size, target, taken) of every row: the words that the mix takes from it. ``body`` is a hash
    of the text; ``nth`` numbers rows with the same key, source and text."""
    rows = docs.select(F.col(key).alias("key"), _body(text).alias("body"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    nth = F.row_number().over(Window.partitionBy("key", "body", "source").orderBy("size"))
    rows = stored(rows.withColumn("nth", nth).withColumn("id", F.xxhash64("key", "body", "source", "nth")), "sizes")
    targets = source_targets(rows, weights, total_share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a join with one row per source; Spark broadcasts it when it sees that it is small
    planned = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    planned = planned.withColumn("sure", F.floor(ratio + 1e-12)).withColumn("fraction", F.greatest(ratio - F.col("sure"), F.lit(0.0)))
    fractional = planned.where("size > 0 and fraction > 1e-9").select("source", "id", "size", (F.col("fraction") * F.col("size")).alias("mass"))
    rounded = dependent_rounding(fractional, seed)
    taken = F.col("sure") * F.col("size") + F.coalesce(F.col("extra") * F.col("size") + F.round("rest"), F.lit(0))
    return planned.join(rounded, "id", "left").select(
        F.col("key").alias(key), "body", "nth", F.col("source").alias(source), "size", "source_size", "target", taken.cast("bigint").alias("taken")
    )


def take_copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``. The one document per
    source that is taken in part counts as a copy where the part is half of it or more."""
    mixed = mix_sources(docs, text, source, key, **options)
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    mixed = mixed.select(F.col(key).alias("key"), "body", F.col(source).alias("source"), "nth", copies.alias("copies")).where("copies > 0")
    # the columns of docs travel as one struct, so none can clash
    rows = docs.select(F.col(key).alias("key"), _body(text).alias("body"), F.col(source).alias("source"), F.struct("*").alias("doc"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "body", "source").orderBy("body")))
    joined = rows.alias("r").join(mixed.alias("c"), F.expr("r.key <=> c.key and r.body = c.body and r.source <=> c.source and r.nth = c.nth"))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
