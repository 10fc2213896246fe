"""From raw documents to packed training batches: five of the operators in a row.

Each stage takes (spark, docs, sf_dir) and returns the documents it kept; its result is written as Parquet and read
again as the next stage's input.  All but the last return the columns of documents, extra ones included, whatever their
names.  Every stage gives an empty result for an empty table and reads whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.minhash_dedup import minhash_dedup
from docweave.llm.mixing import emit_copies
from docweave.llm.packing import pack
from docweave.llm.quality_knn import quality_scores
from docweave.llm.runtime import fresh, release, stored
from docweave.llm.secret_scan import redact_secrets
from docweave.session import ship, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.3 go.  Scores by similarity to labelled documents of the input.

    Null and empty texts get the share of good documents among those learnt from (0.5 without labels) and so stay where
    that is 0.3 or more; null ids have no labels; repeated rows stay or go together; a score of exactly 0.3 stays.
    """
    score = fresh(docs.columns, "score")
    scored = quality_scores(docs, table(ship(spark), sf_dir, "labels"), F.lit(True), score_col=score)
    return scored.where(F.col(score) >= 0.3).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document of the smallest id stays.

    Texts without words are in no group, and all of them stay, but for repeated rows: of rows equal in id and text one
    stays.  Rows of one id with different texts are documents of their own.  Null ids come behind all others, in order of
    their texts' hashes; they stay where no document with an id is in their group.
    """
    ship(spark)
    key, h = fresh(docs.columns, "_key"), fresh(docs.columns, "_hash")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    # null ids get numbers above all usual ids
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + text_hash.bitwiseAND(F.lit((1 << 62) - 1)))).withColumn(h, text_hash)
    found = stored(minhash_dedup(keyed, id_col=key).select(F.col(key), F.col("text_hash").alias(h), "kept"), "near-dedup")
    kept = keyed.join(found.where("not kept").select(key, h).distinct(), [key, h], "left_anti")
    # repeats of a row are few or none; only they are moved once more
    again = stored(found.where("kept").groupBy(key, h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, h), "repeated")
    if not again.isEmpty():
        one = kept.join(again, [key, h], "left_semi").dropDuplicates([key, h])
        kept = kept.join(again, [key, h], "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; all documents stay.

    Null texts stay null, empty ones empty; repeated rows are changed alike; ids don't matter.
    """
    ship(spark)
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights.

    Null texts have size 0 and are drawn like others of their source; a null source is one of its own, last in order;
    null ids are drawn by their texts; repeated rows share one decision.
    """
    return emit_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batch and slot of each document.

    Null and empty texts have length 0 and are packed too, as are null ids; repeated rows are packed as often as they come.
    """
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]

# nearest neighbours, signatures and forests have no SQL; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
