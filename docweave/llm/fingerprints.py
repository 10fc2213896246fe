"""Canonical exact digests: one fingerprint for texts that differ in form only.

A text is normalised (NFKC, case folding, NFKC again), runs of white space become one blank and the ends are stripped;
the fingerprint is the 128-bit xxh3 digest of that.  Inside a bucket of equal digests bytes decide: documents are grouped
by digest and canonical text, which Spark compares byte by byte, copies being collapsed in each task before they are
moved.  A document, its edited text and its neighbour are compared directly.  Where different texts share a digest, all
texts of that digest get the SHA-256 of their canonical bytes behind it, edited ones too.

Neighbours (the next document by descending id) come from one range-wise shuffle: bounds are drawn from a bounded
sample, the first row of each range is sent to the range before it as well, and each range is streamed in order.

Defined results: null texts are empty; null ids come last, equal ids are ordered by text hash; repeated rows are
neighbours of each other; after the last row follows the first, so a single row follows itself; likeness is 1 or 0; an
empty table gives an empty result; extra columns are ignored, whatever their names.  Memory: one text with its canonical
and edited forms at a time, some eight times its length.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_sample, partitions, stored

LOWEST = -(2**63)
SAMPLE = 1 << 16
RANGE_BYTES = 64 << 20


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(text: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(text)


def _ranges(bounds: list[tuple[int, int]]):
    """Range number of each (key, h): how many bounds are at or below it."""
    first = np.array([b[0] for b in bounds], np.int64)

    def of(keys: np.ndarray, hs: np.ndarray) -> np.ndarray:
        out = np.searchsorted(first, keys, "right")
        for i in np.flatnonzero(np.isin(keys, first)).tolist():
            n = int(np.searchsorted(first, keys[i], "left"))
            while n < len(bounds) and bounds[n] <= (keys[i], hs[i]):
                n += 1
            out[i] = n
        return out

    return of


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("id"), text.alias("text"))


def with_next_text(rows: DataFrame) -> DataFrame:
    """Rows dealt to ranges: (range, halo, k, h, id, text), sorted so that each row's follower in the partition is its next document."""
    total = rows.count()
    sample = bounded_sample(rows.select("k", "h", F.octet_length("text").alias("n")), ["k", "h"], SAMPLE, total).collect()
    size = total * sum(r["n"] for r in sample) / max(1, len(sample))
    count = min(SAMPLE // 4, max(2 * partitions(rows.sparkSession), math.ceil(size / RANGE_BYTES)))
    sample = sorted({(r["k"], r["h"]) for r in sample})
    bounds = sorted({sample[len(sample) * i // count] for i in range(1, count)}) if len(sample) > 2 * count else []
    of = _ranges(bounds)

    def heads(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = of(k, h)
            order = np.lexsort((h, k, n))
            last = np.flatnonzero(np.append(n[order][1:] != n[order][:-1], True))
            at = order[last]
            yield pa.RecordBatch.from_arrays([pa.array(n[at], pa.int32()), pa.array(k[at]), pa.array(h[at])], names=["n", "k", "h"])

    top = rows.select("k", "h").mapInArrow(heads, "n int, k long, h long").groupBy("n").agg(F.max(F.struct("k", "h")).alias("t")).collect()
    # one head a range, so as many rows as there are ranges; each goes to the next higher range that has rows
    full = sorted(r["n"] for r in top)
    higher = dict(zip(full, full[1:] + full[:1]))
    goes = {(r["t"]["k"], r["t"]["h"]): higher[r["n"]] for r in top}

    def deal(batches):
        for batch in batches:
            k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = of(k, h)
            heads = [i for i, key in enumerate(zip(k.tolist(), h.tolist())) if key in goes]
            own = pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(np.zeros(len(n)), pa.int32()), *batch.columns], names=["n", "halo", *batch.schema.names])
            yield own
            if heads:
                extra = batch.take(pa.array(heads))
                to = pa.array([goes[key] for key in zip(extra.column(0).to_pylist(), extra.column(1).to_pylist())], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(heads)), pa.int32()), *extra.columns], names=own.schema.names)

    dealt = rows.mapInArrow(deal, "n int, halo int, k long, h long, id long, text string")
    return dealt.repartition(count, "n").sortWithinPartitions("n", "halo", F.desc("k"), F.desc("h"))


RESULT = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fp": pa.string(), "sha": pa.string(), "edited_fp": pa.string(), "edited_sha": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
RESULT_DDL = "id long, n_chars long, edited_sha256 string, fp string, sha string, edited_fp string, edited_sha string, near_edited double, near_next double"


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _digests(batches):
    held, done = None, []

    def flush():
        columns = list(zip(*done)) if done else [[]] * len(RESULT)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, RESULT.values())], names=list(RESULT))

    for batch in batches:
        for n, halo, _, _, i, text in zip(*(c.to_pylist() if c.type != pa.string() else c for c in batch.columns)):
            text = text.as_py()
            own = None
            if held is not None and held[0] == n:
                _, last_id, last, last_own = held
                half = len(last) // 2
                edited = last[: len(last) - half] + text[:half]
                changed = canonical(edited)
                own = canonical(text)
                a, b, c = digest(last_own), digest(changed), digest(own)
                done.append((last_id, len(last), _sha(edited.encode("utf-8", "surrogatepass")), a, _sha(last_own), b, _sha(changed), float(a == b and last_own == changed), float(a == c and last_own == own)))
                if len(done) >= 2000:
                    yield flush()
            held = None if halo else (n, i, text, canonical(text) if own is None else own)
    yield flush()


def _canonical_rows(batches):
    for batch in batches:
        forms = [canonical(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([digest(f) for f in forms], pa.string()), pa.array(forms, pa.binary())], names=["id", "fp", "form"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_id, n_equal) for each row.

    first_id is the smallest id of equal canonical texts, n_equal their number.
    """
    rows = _ordered(docs, id_col, text_col)
    found = stored(with_next_text(rows).mapInArrow(_digests, RESULT_DDL), "digests")
    forms = rows.select("id", "text").mapInArrow(_canonical_rows, "id long, fp string, form binary")
    # equal rows here are equal in every byte
    equal = forms.groupBy("fp", "form").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_equal"))
    equal = stored(equal.select("fp", F.sha2("form", 256).alias("sha"), "first_id", "n_equal"), "equal-texts")
    named = equal.select("fp", "sha").union(found.select("edited_fp", "edited_sha"))
    shared = stored(named.groupBy("fp").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("fp"), "shared-digests")
    out = found.join(equal, ["fp", "sha"]).withColumnsRenamed({"fp": "fingerprint", "edited_fp": "edited_fingerprint"})
    if not shared.isEmpty():
        for name, sha in (("fingerprint", "sha"), ("edited_fingerprint", "edited_sha")):
            full = F.when(F.col("shared").isNull(), F.col(name)).otherwise(F.concat_ws("-", name, sha))
            out = out.join(shared.select(F.col("fp").alias(name), F.lit(1).alias("shared")), name, "left").withColumn(name, full).drop("shared")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first_id", "n_equal")
