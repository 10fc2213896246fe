"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters (any byte from 128 counts as one), lower-cased.  Features are words, their stems (the first
four and six bytes, so that inflected forms share a coordinate), pairs of neighbours and pairs around one left-out
word, hashed to ``2**bits`` coordinates; each counts once a text.  Training takes a bounded
sample of labelled texts, a few passes in a fixed order, with a learning rate per coordinate and an L1 penalty that
leaves few weights (settings chosen by ``selection``); only those are broadcast (their number is at most the features of the sample).

Defined results: null and empty texts score by the bias alone, 0.5 without any usable label; repeated rows get equal
scores; ids with contradicting labels aren't learnt from, and of texts with one id the smallest is; an empty table gives
an empty result, without labels learnt from every score is 0.5.  Extra columns stay; one named like the score is
replaced.  Whole texts are read, one of any length at a time, with some 100 bytes of work space a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .kernels import BASE, LOWER, U64, RangeHash, chunks, mix, text_buffer, word_ranges
from .labelled import training_texts, with_scores

NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
STEMS = (4, 6)


def coordinates(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of all features, repeats included."""
    buf = LOWER[buf]
    starts, ends, bounds = word_ranges(buf, offs, NO_LETTER)
    ranges = RangeHash(buf)
    words = ranges.of(starts, ends) if len(starts) else np.zeros(0, U64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    docs, found = [doc], [mix(words)]
    for stem in STEMS:
        long = ends - starts >= stem
        docs.append(doc[long])
        found.append(mix(ranges.of(starts[long], starts[long] + stem) + U64(stem)))
    for gap, salt in ((1, U64(0xA0761D6478BD642F)), (2, U64(0xE7037ED1A0B428DB))):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        found.append(mix(words[:-gap] * BASE + words[gap:] + salt)[same])
    return np.concatenate(docs), (np.concatenate(found) >> U64(64 - bits)).astype(np.int64)


class Ftrl:
    def __init__(self, bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << self.bits, 0, self.l1)
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def fit(self, texts: list[str], labels: list[int], passes: int) -> Ftrl:
        rows = []
        for _, _, buf, offs in chunks(*text_buffer(pa.array(texts, pa.large_string()))):
            doc, at = coordinates(buf, offs, self.bits)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(len(offs)))
            at = at[order]
            rows += [np.append(np.unique(at[a:b]), 1 << self.bits) for a, b in zip(cut[:-1], cut[1:])]
        order = np.random.Generator(np.random.PCG64(3)).permutation(len(rows))
        for _ in range(passes):
            for i in order:
                self.learn(rows[i], labels[i])
        return self


class Scorer:
    """The weights that aren't zero, as a sorted table."""

    def __init__(self, model: Ftrl):
        every = np.arange((1 << model.bits) + 1)
        w = model.weights(every)
        self.bits, self.bias = model.bits, float(w[-1])
        self.at = np.flatnonzero(w[:-1])
        self.w = w[:-1][self.at]

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        doc, at = coordinates(buf, offs, self.bits)
        known = np.zeros(1 << self.bits, bool)
        known[self.at] = True
        hit = known[at]
        pair = np.unique((doc[hit] << self.bits) | at[hit])
        total = np.bincount(pair >> self.bits, self.w[np.searchsorted(self.at, pair & ((1 << self.bits) - 1))], minlength=n) if len(pair) else np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", sample: int = 6000, passes: int = 4, bits: int = 20, alpha: float = 1.0, l1: float = 10.0) -> DataFrame:
    """docs with a column ``score_col``: how likely label 1 is.  Labels count where ``usable`` (a predicate on labels) holds."""
    texts, ys = training_texts(docs, labels, label, usable, sample, id_col, text_col)
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(Ftrl(bits, alpha, l1=l1).fit(texts, ys, passes)))
    return with_scores(docs, text_col, score_col, lambda buf, offs: scorer.value.scores(buf, offs))
