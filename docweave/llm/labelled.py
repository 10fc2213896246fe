"""A bounded, reproducible sample of labelled texts for fitting, and the pass that scores all texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import chunks, text_buffer
from .runtime import bounded_sample


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(n))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """At most ``limit`` texts with labels 0 or 1, those of the smallest id hashes.

    Only (id, label) of the sample is broadcast, ``limit`` rows at most; texts are read by one scan.  Ids with
    contradicting labels, null ids and null labels are left out; of repeated ids one text is used.
    """
    one = labels.where(usable & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    picked = bounded_sample(one, [id_col], limit, one.count()).select(F.col(id_col).alias("_id"), F.col("y").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), "_id")
    found = texts.groupBy("_id").agg(F.min("t").alias("t"), F.first("y").alias("y")).orderBy("_id").select("t", "y").toArrow()
    return found.column("t").to_pylist(), found.column("y").to_pylist()


def with_scores(docs: DataFrame, text_col: str, score_col: str, scores: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """docs with the scores of their whole texts; a column that has the name already is replaced."""
    base = docs.drop(score_col)
    place = base.schema.fieldNames().index(text_col)

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in chunks(*text_buffer(batch.column(place))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(buf, offs), pa.float64())], names=[*part.schema.names, score_col])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(score_col, DoubleType())]))
