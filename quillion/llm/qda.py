"""Quality classifier: regularised quadratic discriminant (operator 5).

Statistics of each text are transformed to be roughly Gaussian. From all labelled documents the classes'
means and covariances are summed up in one pass, covariances shrink towards the pooled one and a scaled
identity, and their Cholesky factors are kept. A document's score is the difference of the two log
densities, by Mahalanobis distances through the factors, plus the log prior ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.llm import _vec
from quillion.plans.scratch import Scratch

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "distinct", "stutter", "ends", "separators", "line_length", "common")
#: Shrinkage: weight of the pooled covariance, then of the identity scaled to the mean variance.
POOLED, IDENTITY = 0.2, 0.05
#: Ratios of counts are smoothed by so many words of a usual text.
PRIOR_WORDS = 4.0
CHARS = 1 << 21
_COMMON = "the of and to a in is that it for was on are as with he be by at from this de la que el en y los se del las un por con una su para le les des et est dans du pour sur qui der die und das den von zu mit ist nicht".split()
_MARKS = ".!?,;:'\"()-…¿¡«»„“”‘’–— \n\r\t"


def _classes() -> np.ndarray:
    """Per code point: 1 letter in lower case or without case, 2 in upper case, 3 number, 4 usual mark or space, 0 symbol."""
    if not hasattr(_classes, "table"):
        word, lower = _vec.tables()
        t = np.zeros(len(word), dtype=np.uint8)
        t[word] = 1
        t[word & (lower != np.arange(len(lower), dtype=np.uint32))] = 2
        t[48:58] = 3
        t[[ord(c) for c in _MARKS]] = 4
        _classes.table = t
        _classes.common = np.sort(_vec.words(_COMMON).hash)
    return _classes.table


def features(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics for each text; an empty text gives those of the smoothing alone."""
    table = _classes()
    cps, starts = _vec.code_points(texts)
    n = len(texts)
    kind = table[cps]

    def per_text(mask):
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[np.minimum(starts[1:], len(cps))] - sums[starts[:-1]]).astype(float)

    breaks = np.zeros(n)
    breaks[:-1] = 1  # the line feed between texts
    w = _vec.words(texts)
    bounds = np.searchsorted(w.doc, np.arange(n + 1))
    count = np.diff(bounds).astype(float)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], dtype=float)
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    common = _classes.common
    usual = common[np.minimum(np.searchsorted(common, w.hash), len(common) - 1)] == w.hash
    by_doc = lambda m: np.bincount(w.doc[m], minlength=n).astype(float)
    letters, upper = per_text((kind == 1) | (kind == 2)), per_text(kind == 2)
    symbols, digits = per_text(kind == 0), per_text(kind == 3)
    lines = per_text(cps == 10) - breaks + 1
    ends = per_text((cps == 46) | (cps == 33) | (cps == 63))
    bars = per_text((cps == 124) | (cps == 8250) | (cps == 8226))
    p = PRIOR_WORDS
    logit = lambda a, b: np.log((a + 1e-3) / (b - a + 1e-3))
    return np.stack(
        [
            np.log1p(count),
            np.log((letters + 5 * p) / (count + p)),
            np.log((symbols + 0.02) / (count + p)),
            logit(upper + 0.04 * 5 * p, np.maximum(letters, upper) + 5 * p),
            np.log((digits + 0.05) / (count + p)),
            logit(distinct + 0.9 * p - 0.1, count + p) + 0.35 * np.log1p(count),
            np.log((by_doc(same) + 0.02 * p) / (count + p)),
            np.log((ends + 0.1 * p) / (count + p)),
            np.log((bars + 0.02) / (count + p)),
            np.log((count + 2 * p) / (lines + 0.05 * p)) - 0.5 * np.log1p(count),
            np.log((by_doc(usual) + 0.3 * p) / (count + p)),
        ],
        axis=1,
    )


class QDA:
    """Two Gaussians with shrunk covariances; `score` is log p(1|x) - log p(0|x)."""

    def __init__(self, n, mean, cov):
        d = len(mean[0])
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.mean = [np.asarray(m) for m in mean]
        self.factor, self.log_det = [], []
        for c in cov:
            s = (1 - POOLED) * c + POOLED * pooled
            s = (1 - IDENTITY) * s + IDENTITY * np.trace(s) / d * np.eye(d)
            low = np.linalg.cholesky(s + 1e-9 * np.eye(d))
            self.factor.append(np.linalg.inv(low))
            self.log_det.append(2 * np.log(np.diag(low)).sum())
        self.prior = float(np.log(n[1] / n[0]))

    @classmethod
    def from_sums(cls, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """From each class's count, sum, and sum of outer products."""
        n = [sums[k][0] for k in (0, 1)]
        mean = [sums[k][1] / sums[k][0] for k in (0, 1)]
        cov = [sums[k][2] / sums[k][0] - np.outer(m, m) for k, m in zip((0, 1), mean)]
        return cls(n, mean, cov)

    def score(self, x: np.ndarray) -> np.ndarray:
        part = []
        for m, f, det in zip(self.mean, self.factor, self.log_det):
            z = (x - m) @ f.T
            part.append(-0.5 * (z * z).sum(axis=1) - 0.5 * det)
        return part[1] - part[0] + self.prior


def document_features(docs: DataFrame) -> DataFrame:
    """`(doc_id, x)`: little-endian doubles; a null text counts as an empty one."""

    def run(it):
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in _vec.slices([len(t) for t in texts], CHARS):
                rows += [r.tobytes() for r in features(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary")


def fit(rows: DataFrame) -> QDA | None:
    """From `(x, label)`; None where a class has fewer than two rows. Partitions send one sum a class."""
    d = len(FEATURES)

    def run(it):
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in it:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<f8").reshape(-1, d)
            y = np.array(batch.column(1))
            for k in (0, 1):
                s = x[y == k]
                total[k] += np.concatenate(([len(s)], s.sum(axis=0), (s.T @ s).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([total[k].tobytes() for k in (0, 1)], pa.binary())], ["label", "sums"])

    sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    few = rows.mapInArrow(run, "label long, sums binary").collect()
    for k, v in sorted((r["label"], bytes(r["sums"])) for r in few):
        sums[k] += np.frombuffer(v)
    if min(s[0] for s in sums.values()) < 2:
        return None
    return QDA.from_sums({k: (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for k, s in sums.items()})


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, score, keep)` of every row; `keep` where good quality is the more likely.

    Trained on all documents with a label 0 or 1 in `quality`; other labels and null ids are not used for
    training, and a document with several label rows, or several rows, counts each time. Null, empty
    and very long texts get a score like any other. If a class has under two documents there is no classifier:
    scores are null and everything is kept. Other columns, of whatever name, are not read. Empty input gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    table = scratch.keep(document_features(docs))
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label"))
    model = fit(table.join(known, "doc_id").select("x", "label"))
    if model is None:
        return table.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    shared = spark.sparkContext.broadcast(model)

    def run(it):
        for batch in it:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f8").reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s > 0)], ["doc_id", "score", "keep"])

    return table.mapInArrow(run, "doc_id long, score double, keep boolean")
