"""What the multi-step operators share beside working storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, scratch, shared_dir, stored

__all__ = ["bounded_sample", "fresh", "partitions", "release", "scratch", "shared_dir", "stored"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], stem: str) -> str:
    """The stem, lengthened until no column has that name."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def bounded_sample(rows: DataFrame, keys: list[str], limit: int, total: int) -> DataFrame:
    """At most ``limit`` of ``total`` rows, those of the smallest key hashes.

    A threshold on the hash that some twice ``limit`` rows pass comes first, so tasks hand on that many rows all
    together and not ``limit`` each.
    """
    h = F.xxhash64(*keys)
    if total > 2 * limit:
        rows = rows.where(h < F.lit(int((2 * limit + 64) / total * 2**64) - 2**63))
    return rows.orderBy(h, *keys).limit(limit)
