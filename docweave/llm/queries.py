"""The ten operators as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .arc_to_warc import archive_round_trip
from .fingerprints import fingerprints
from .labelled import remainder
from .minhash_dedup import minhash_dedup
from .mixing import mix_sources
from .packing import pack
from .projection_ann import nearest
from .quality_knn import quality_scores
from .secret_scan import find_secrets
from .suffix_dedup import remove_repeats
from .toxicity_ftrl import toxicity_scores


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(ship(spark), sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(ship(spark), sf_dir, "documents"), width=2, percent=80)


def _judged(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return _judged(quality_scores(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0), 5, 0)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_round_trip(table(ship(spark), sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.col("removed")
    return remove_repeats(table(ship(spark), sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"), F.size(runs).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(ship(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(ship(spark), sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first_id", "n_equal")


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity_scores(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2), 4, 2)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_packing, op3_minhash_dedup, op4_quality_knn, op5_arc_to_warc, op6_suffix_dedup, op7_mixing, op8_projection_ann, op9_fingerprints, op10_toxicity_ftrl)}

ORACLES = {
    "op5_arc_to_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        b AS (SELECT d, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN n >= 1000 AND r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND r <> page_id THEN r END AS refers_to
        FROM p LEFT JOIN b ON p.d = b.d AND n >= 1000""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][r % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o1, 0)) / sum(w) OVER o2 AS level FROM w
              WINDOW o1 AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     o2 AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        t AS (SELECT source, source_size, least(cap, coalesce(max(level) FILTER (level <= cap / w) OVER () * w, cap)) AS target FROM l),
        x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                     ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""",
}
