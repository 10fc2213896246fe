"""Whole-corpus selection, features, scores and lookups, as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("no-problem", "warning", "error")


def containing(docs: DataFrame, needle: str, markup_col: str = "html") -> DataFrame:
    """Documents whose markup holds a literal string."""
    return docs.where(F.contains(F.col(markup_col), F.lit(needle)))


def selection_counts(docs: DataFrame, needle: str, markup_col: str = "html") -> DataFrame:
    """(processed, found)."""
    return docs.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.contains(F.col(markup_col), F.lit(needle))).alias("found"))


def one_document(docs: DataFrame, doc_id, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_col) == F.lit(doc_id))


def unit_features(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, nxref, ntext, ninter, nmrow) of each document that has elements of exactly the class ltx_unit.

    Distinct xref targets and first texts of those elements, targets that are ids of csymbols, and mrows among them.
    Sets are counted by grouping, so no document's set is held in one row.
    """
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    units = nodes.where(attr("class") == "ltx_unit")
    per = units.groupBy(id_col).agg(F.count_distinct("text").alias("ntext"), F.count_if(F.col("tag") == "mrow").alias("nmrow"))
    targets = units.select(id_col, attr("xref").alias("x")).where("x is not null").distinct()
    known = nodes.where("tag = 'csymbol'").select(id_col, attr("id").alias("x"), F.lit(1).alias("known")).where("x is not null").distinct()
    found = targets.join(known, [id_col, "x"], "left").groupBy(id_col).agg(F.count(F.lit(1)).alias("nxref"), F.count("known").alias("ninter"))
    count = lambda name: F.coalesce(name, F.lit(0))
    return per.join(found, id_col, "left").select(id_col, count("nxref").alias("nxref"), "ntext", count("ninter").alias("ninter"), "nmrow")


def relevance(inter: Column, texts: Column) -> Column:
    return inter * F.sqrt(texts)


def ranked(features: DataFrame, k: int | None = None, id_col: str = "doc_id", line_col: str = "line_no") -> DataFrame:
    """(id, score, line) by falling score, ties in line order; of repeated ids the last line counts."""
    last = Window.partitionBy(id_col).orderBy(F.desc(line_col))
    one = features.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    out = one.select(id_col, relevance(F.col("ninter"), F.col("ntext")).alias("score"), line_col).orderBy(F.desc("score"), line_col)
    return out.limit(k) if k is not None else out


def severity_of(severities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, level): the first of the levels that lists the id."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return severities.groupBy(id_col).agg(F.min_by("level", rank).alias("level"))


def without_errors(docs: DataFrame, severities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of no error level; an id without a level is an error of the run."""
    joined = docs.join(severity_of(severities, id_col), id_col, "left")
    level = F.when(F.col("level").isNull(), F.raise_error(F.concat(F.lit("no severity for "), F.col(id_col).cast("string"))).cast("string")).otherwise(F.col("level"))
    return joined.where(level != "error").drop("level")


def doc_to_cats(edges: DataFrame) -> DataFrame:
    """(doc_id, cats in order) from (doc_id, pos, cat)."""
    return edges.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cat"))), lambda x: x["cat"]).alias("cats"))


def cat_to_docs(edges: DataFrame) -> DataFrame:
    """(cat, doc_id) without repeats: a category may hold a large part of all documents, so they aren't put in one row."""
    return edges.select("cat", "doc_id").distinct()


def annotate(docs: DataFrame, occurrences: DataFrame, units: DataFrame, *, id_col: str = "doc_id", markup_col: str = "html") -> DataFrame:
    """(id, html_out): documents with a marker of unit and amount after each occurrence."""
    from .html_tree import parse_html, serialize
    from .linearize import Flat, Node

    import pyarrow as pa

    named = occurrences.join(units.select("unit_id", "label"), "unit_id")
    notes = named.groupBy(F.col("arxivid").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("dnm_range", F.concat_ws(" ", F.col("amount_val").cast("string"), "label").alias("note")))).alias("notes"))
    joined = docs.select(id_col, F.col(markup_col).alias("m")).join(notes, F.col(id_col).cast("string") == F.col("_id")).select(id_col, "m", "notes")

    def run(batches):
        for batch in batches:
            out = []
            for markup, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                flat = Flat(parse_html(markup))
                for x in todo:
                    _, to, closed = x["dnm_range"].split("&")
                    note = Node("sup", {"style": "color:blue"})
                    note.text = x["note"]
                    flat.add(note, flat.position(to)[0], closed == "True")
                flat.apply()
                out.append(serialize(flat.root))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "html_out"])

    return joined.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, html_out string")
