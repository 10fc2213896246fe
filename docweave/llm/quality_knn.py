"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are byte pairs of the text plus a few terms for repetition (shares of repeated neighbours and of distinct words,
in steps), so that no language needs a word list.  A truncated SVD over the TF-IDF vectors of a bounded sample of
labelled texts gives the space; the sample's own vectors, scaled to length one, are broadcast.  For every document the
exact cosines with all of them are computed in blocks, and the labels of the nearest ``neighbours`` are averaged with
their similarities, raised to ``power``, as weights; ``emphasis`` is the weight of the terms for repetition.

What is broadcast has a fixed bound: ``sample`` x ``rank`` floats, a ``terms`` x ``rank`` projection and 65,536 term
numbers, under 1 MB with the defaults (chosen by ``selection``).

Defined results: null and empty texts score as the share of label 1 in the sample, as do texts without a known term;
without any usable label every score is 0.5; repeated rows get equal scores; ties between neighbours go to the smaller
place in the sample; an empty table gives an empty result.  Whole texts are read, one of any length at a time, with some
25 bytes of work space a byte.  Extra columns stay; one named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .kernels import RangeHash, chunks, text_buffer, word_ranges
from .labelled import training_texts, with_scores

STEPS = 12


def term_counts(buf: np.ndarray, offs: np.ndarray, number: np.ndarray | None, terms: int) -> np.ndarray:
    """Counts of byte pairs (numbered by ``number``, or all 65,536) for each text of a chunk."""
    n = len(offs) - 1
    width = 65536 if number is None else terms + 1
    if len(buf) < 2:
        return np.zeros((n, width if number is None else terms), np.float32)
    pair = (buf[:-1].astype(np.int64) << 8) | buf[1:]
    doc = np.repeat(np.arange(n), np.diff(offs))[:-1]
    inside = np.ones(len(pair), bool)
    ends = offs[1:-1]
    inside[ends[(ends > 0) & (ends < len(buf))] - 1] = False
    column = pair if number is None else number[pair]
    out = np.bincount((doc * width + column)[inside], minlength=n * width).reshape(n, width)
    return (out if number is None else out[:, :terms]).astype(np.float32)


def repetition(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One-hot steps of three shares for each text: equal neighbours, words seen before, and of capital letters."""
    n = len(offs) - 1
    starts, ends, bounds = word_ranges(buf, offs)
    words = RangeHash(buf).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = np.zeros((n, 3 * STEPS), np.float32)
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    for i in range(n):
        w = words[bounds[i] : bounds[i + 1]]
        if len(w):
            same = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
            seen = 1 - len(np.unique(w)) / len(w)
            caps = float(upper[offs[i + 1]] - upper[offs[i]]) / max(1, offs[i + 1] - offs[i])
            for k, v in enumerate((same, seen, caps)):
                out[i, k * STEPS + min(STEPS - 1, int(v * STEPS))] = 1
    return out


class Space:
    def __init__(self, texts: list[str], labels: list[int], terms: int, rank: int, emphasis: float, power: int):
        self.terms, self.power, self.labels = terms, power, np.array(labels, np.float32)
        self.base = float(self.labels.mean()) if labels else 0.5
        self.number = np.full(65536, terms, np.int64)
        column = pa.array(texts, pa.large_string())
        df = np.zeros(65536)
        for _, _, buf, offs in chunks(*text_buffer(column)):
            for i in range(len(offs) - 1):
                t = buf[offs[i] : offs[i + 1]]
                if len(t) > 1:
                    df[np.unique((t[:-1].astype(np.int64) << 8) | t[1:])] += 1
        kept = np.argsort(-df, kind="stable")[:terms]
        kept = kept[df[kept] > 0]
        self.number[kept] = np.arange(len(kept))
        self.idf = np.ones(terms + 3 * STEPS, np.float32)
        self.idf[: len(kept)] = np.log((1 + len(texts)) / (1 + df[kept])) + 0.2
        self.idf[terms:] = emphasis
        self.project = None
        if texts:
            x = np.concatenate([self._weigh(buf, offs) for _, _, buf, offs in chunks(*text_buffer(column))])
            _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
            self.project = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
            self.vectors = self._unit(x @ self.project)

    def _weigh(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = np.log1p(np.concatenate([term_counts(buf, offs, self.number, self.terms), repetition(buf, offs)], 1)) * self.idf
        return self._unit(x)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, buf: np.ndarray, offs: np.ndarray, neighbours: int) -> np.ndarray:
        n = len(offs) - 1
        if self.project is None:
            return np.full(n, self.base)
        out = np.empty(n)
        for a in range(0, n, 256):
            b = min(n, a + 256)
            z = self._unit(self._weigh(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) @ self.project)
            cosine = z @ self.vectors.T
            k = min(neighbours, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (b - a, 1))
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            out[a:b] = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.base)
        return np.clip(out, 0, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", sample: int = 3000, terms: int = 1536, rank: int = 16, neighbours: int = 3, emphasis: float = 9, power: int = 8) -> DataFrame:
    """docs with a column ``score_col``: how likely label 1 is.  Labels count where ``usable`` (a predicate on labels) holds."""
    texts, ys = training_texts(docs, labels, label, usable, sample, id_col, text_col)
    space = docs.sparkSession.sparkContext.broadcast(Space(texts, ys, terms, rank, emphasis, power))
    return with_scores(docs, text_col, score_col, lambda buf, offs: space.value.scores(buf, offs, neighbours))
