"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source, targets are found by water-filling on the source totals (one row a source), and each
document is emitted ``floor(rate)`` times plus once more if its hash falls below the rate's fraction.  The hash is of the
seed and the id, so reruns and retried tasks agree.  The rates are written once; Spark then knows their size and
broadcasts them only below its threshold, otherwise it joins by source and splits a hot one.

Defined results: null texts have size 0; a null source is a source of its own, last in order; a source without words has
target 0 and none of its rows is taken; null ids are hashed by their text; repeated rows share one decision; an empty
table gives an empty result; extra columns stay, but ``mix_sources`` replaces those named like its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import fresh, stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, rate) for rows (source, source_size).

    The share of all words is dealt by weight; no source gets more than ``most`` times its own words, and what is above
    goes to the others by weight.  With sources in order of cap over weight, those before the first whose level fits are
    full; later levels that fit are lower, so it has the largest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every)
    # with a share above what all caps allow no level fits, and every source is full
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


RESULTS = ("size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, dict[str, str]]:
    """docs with the results under names that docs doesn't have, and those names."""
    own = {c: fresh(docs.columns, f"_mix_{c}") for c in (*RESULTS, "source", "rate")}
    sized = docs.withColumn(own["size"], word_count(text_col))
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(own["size"]).alias("source_size"))
    rates = stored(source_targets(sizes, list(weights), share, most), "rates")
    rates = rates.select(*[F.col(c).alias(own[c]) for c in rates.columns])
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    out = sized.join(rates, F.col(source_col).eqNullSafe(F.col(own["source"])))
    rate = F.col(own["rate"])
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    out = out.withColumn(own["copies"], copies.cast("int"))
    return out.withColumn(own["taken"], (F.col(own["size"]) * F.col(own["copies"])).cast("long")), own


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` (= size x copies)."""
    out, own = _mixed(docs, **options)
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    return out.select(*kept, *[F.col(own[c]).alias(c) for c in RESULTS])


def emit_copies(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as many times as the mix takes it, columns as in docs."""
    out, own = _mixed(docs, **options)
    taken = out.where(F.col(own["copies"]) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), own["copies"])).alias(fresh(docs.columns, "_copy"))).select(*docs.columns)
