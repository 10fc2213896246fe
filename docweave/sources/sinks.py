"""Sinks: category lists, occurrences, id lists, features, annotated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_lines(cats: DataFrame) -> DataFrame:
    """(value,) lines ``id: cat, cat`` in order of the id, from (doc_id, cats)."""
    return cats.orderBy("doc_id").select(F.concat("doc_id", F.lit(": "), F.array_join("cats", ", ")).alias("value"))


def write_categories(cats: DataFrame, path: str) -> None:
    """One sorted text file; the list is small beside the corpus."""
    category_lines(cats).coalesce(1).write.mode("overwrite").text(path)


def occurrence_json(occurrences: DataFrame) -> Column:
    """JSON of a row without nulls and empty lists."""
    fields = []
    for f in occurrences.schema.fields:
        c = F.col(f.name)
        fields.append((F.when(F.size(c) > 0, c) if f.dataType.typeName() == "array" else c).alias(f.name))
    return F.to_json(F.struct(*fields))


def write_occurrences(occurrences: DataFrame, path: str) -> None:
    """Gzipped JSON lines, a folder for each document."""
    rows = occurrences.select(F.col("arxivid").alias("doc"), occurrence_json(occurrences).alias("value"))
    rows.repartition("doc").write.mode("overwrite").partitionBy("doc").option("compression", "gzip").text(path)


def write_ids(ids: DataFrame, path: str, id_col: str = "doc_id", order_col: str | None = None) -> None:
    """One id a line; with order_col the files together have them in its order, otherwise each keeps that of its rows."""
    ids = ids.orderBy(order_col) if order_col else ids
    ids.select(F.col(id_col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str, id_col: str = "doc_id") -> None:
    features.select(F.col(id_col).alias("id"), "nxref", "ntext", "ninter", "nmrow").write.mode("overwrite").csv(path)


def write_markup(annotated: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Annotated documents as a table."""
    annotated.select(id_col, "html_out").write.mode("overwrite").parquet(path)


def extract_document(docs: DataFrame, doc_id, path: str, id_col: str = "doc_id", markup_col: str = "html") -> None:
    """The markup of one document as a text file in a folder."""
    docs.where(F.col(id_col) == F.lit(doc_id)).select(F.col(markup_col).alias("value")).coalesce(1).write.mode("overwrite").text(path)
