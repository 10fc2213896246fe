"""Chooses settings of the two classifiers by folds inside the rows that may be learnt from.

    python -m docweave.llm.selection /root/testdata/sf0.1

Rows held out by the queries are dropped before anything else, so no figure printed here has seen them.  The remaining
labelled texts are dealt to three folds by a hash of the id; each setting is fitted on two and scored on the third.  The
setting with the smallest log loss over all three wins (scores are kept between 0.001 and 0.999 for that; ties go to the
setting named first).
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

from .kernels import chunks, text_buffer
from .quality_knn import Space
from .toxicity_ftrl import Ftrl, Scorer

FOLDS = 3
KNN = [dict(zip(("terms", "rank", "emphasis", "power", "neighbours"), v)) for v in itertools.product((1536,), (8, 16, 32, 64), (3, 9, 18, 36), (2, 8), (3, 5, 9))]
FTRL = [dict(zip(("alpha", "l1", "passes"), v)) for v in itertools.product((0.3, 1.0, 3.0, 10.0), (1.0, 3.0, 6.0, 10.0), (1, 2, 4))]


def learnable(sf_dir: str, label: str, modulus: int, usable) -> list[tuple[str, int, int]]:
    """(text, label, fold) of labelled documents whose remainder of crc32 is usable, in order of id."""
    labels = pq.read_table(f"{sf_dir}/labels.parquet", columns=["doc_id", label]).to_pylist()
    known = {r["doc_id"]: r[label] for r in labels if r[label] in (0, 1) and r["doc_id"] is not None and usable(zlib.crc32(str(r["doc_id"]).encode()) % modulus)}
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = {r["doc_id"]: r["text"] or "" for r in docs if r["doc_id"] in known}
    return [(texts[i], known[i], xxhash.xxh64_intdigest(f"fold:{i}") % FOLDS) for i in sorted(texts)]


def _parts(rows, fold):
    return [r[0] for r in rows if r[2] != fold], [r[1] for r in rows if r[2] != fold], [r[0] for r in rows if r[2] == fold]


def _over(score, texts) -> np.ndarray:
    return np.concatenate([score(buf, offs) for _, _, buf, offs in chunks(*text_buffer(pa.array(texts, pa.large_string())))])


def knn_scores(rows, fold, s) -> np.ndarray:
    texts, ys, tried = _parts(rows, fold)
    space = Space(texts, ys, s["terms"], s["rank"], s["emphasis"], s["power"])
    return _over(lambda buf, offs: space.scores(buf, offs, s["neighbours"]), tried)


def ftrl_scores(rows, fold, s) -> np.ndarray:
    texts, ys, tried = _parts(rows, fold)
    scorer = Scorer(Ftrl(20, s["alpha"], l1=s["l1"]).fit(texts, ys, s["passes"]))
    return _over(scorer.scores, tried)


def judge(rows, by_fold) -> tuple[float, float, float]:
    """Log loss, and the shares of labels 1 and 0 that a cut at 0.3 puts right."""
    p = np.concatenate(by_fold)
    y = np.array([r[1] for f in range(FOLDS) for r in rows if r[2] == f])
    q = np.clip(p, 0.001, 0.999)
    loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()
    return float(loss), float((p[y == 1] >= 0.3).mean()), float((p[y == 0] < 0.3).mean())


def main(sf_dir: str) -> None:
    jobs = [("quality", 5, lambda m: m != 0, knn_scores, KNN), ("toxic", 4, lambda m: m != 2, ftrl_scores, FTRL)]
    with ProcessPoolExecutor() as pool:
        for label, modulus, usable, score, settings in jobs:
            rows = learnable(sf_dir, label, modulus, usable)
            waiting = [[pool.submit(score, rows, f, s) for f in range(FOLDS)] for s in settings]
            found = [(judge(rows, [w.result() for w in ws]), s) for ws, s in zip(waiting, settings)]
            print(f"{label}: {len(rows)} texts")
            for (loss, right1, right0), s in sorted(found, key=lambda x: x[0][0]):
                print(f"  {loss:.4f} label 1 {right1:.4f} label 0 {right0:.4f} {s}")


if __name__ == "__main__":
    main(sys.argv[1])
