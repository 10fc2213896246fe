"""Packing by optimal length buckets.

The lengths of all documents form one histogram: exact below ``EXACT``, in steps of 1/64 above, so that it has a fixed
bound of some 1,800 bars at any size of the input.  Dynamic programming over it chooses the boundaries that minimise
padding for a given number of buckets.  Inside a bucket every document is padded to the bucket's boundary, so a batch
holds ``budget // boundary`` documents; one longer than the budget is a batch of its own.

Positions inside a bucket come from two levels of counting (cells of some hundred rows, then rows of a cell), so a hot
bucket is never in one task and only the last batch of each bucket can have room left.

Defined results: null and empty texts have length 0 and are packed at length 0 into the first bucket; ties are ordered
by hash, id and text hash; repeated rows are packed as often as they come; an empty table gives an empty result; extra
columns are ignored, whatever their names.  Above EXACT words boundaries may lie at bar tops only, so padding can be up to
1/64 of a length above the least possible.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .runtime import stored

EXACT = 512
CELL = 128


def bar(length):
    """Histogram bar of a length: itself up to EXACT, above in 64 steps each doubling."""
    power = F.floor(F.log2(length.cast("double") / EXACT + 1e-12))
    step = F.pow(F.lit(2.0), power) * (EXACT / 64)
    return F.when(length <= EXACT, length.cast("double")).otherwise(F.ceil(length / step) * step).cast("long")


def boundaries(lengths: list[int], counts: list[int], tops: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.  Bars ascend; tops are their largest lengths."""
    n = len(lengths)
    if n == 0:
        return []
    count = np.concatenate([[0], np.cumsum(np.array(counts, np.float64))])
    mass = np.concatenate([[0], np.cumsum(np.array(counts, np.float64) * np.array(lengths, np.float64))])
    top = np.array(tops, np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, frm = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            c = cost[:j] + top[j - 1] * (count[j] - count[:j]) - (mass[j] - mass[:j])
            frm[j] = int(np.argmin(c))
            new[j] = c[frm[j]]
        back.append(frm)
        cost = new
    out, j = [], n
    for frm in reversed(back):
        out.append(int(tops[j - 1]))
        j = int(frm[j])
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 8192) -> DataFrame:
    """(id, n_tokens, bucket, padded_to, batch, slot) for each row: batch numbers count within the bucket, slots within the batch."""
    sized = docs.select(F.col(id_col).alias("id"), word_count(text_col).alias("n_tokens"), F.xxhash64(id_col, text_col).alias("h"))
    rows = stored(sized, "lengths")
    bars = rows.groupBy(bar(F.col("n_tokens")).alias("bar")).agg(F.count(F.lit(1)).alias("c"), F.avg("n_tokens").alias("mean"), F.max("n_tokens").alias("top")).orderBy("bar").collect()
    ends = boundaries([b["mean"] for b in bars], [b["c"] for b in bars], [b["top"] for b in bars], buckets) or [0]
    number = F.lit(len(ends) - 1)
    for k in reversed(range(len(ends) - 1)):
        number = F.when(F.col("n_tokens") <= ends[k], k).otherwise(number)
    rows = rows.withColumn("bucket", number.cast("int"))
    per_bucket = {k: sum(b["c"] for b in bars if b["top"] <= e and (k == 0 or b["top"] > ends[k - 1])) for k, e in enumerate(ends)}
    cells = F.element_at(F.array(*[F.lit(max(1, per_bucket[k] // CELL)) for k in range(len(ends))]), F.col("bucket") + 1)
    padded = F.element_at(F.array(*[F.lit(e) for e in ends]), F.col("bucket") + 1).cast("long")
    rows = rows.withColumn("cell", F.pmod(F.col("h"), cells))
    counted = rows.groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("bucket", "cell", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("offset"))
    placed = rows.withColumn("row", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("h", "id")) - 1).join(offsets, ["bucket", "cell"])
    place = F.col("offset") + F.col("row")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(padded, F.lit(1))))
    return placed.select(F.col("id").alias(id_col), "n_tokens", "bucket", padded.alias("padded_to"), F.floor(place / capacity).cast("long").alias("batch"), F.pmod(place, capacity).cast("int").alias("slot"))
