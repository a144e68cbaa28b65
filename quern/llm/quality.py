"""Quality classifier: a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics. The two classes are
normal densities whose covariances are shrunk towards their pooled diagonal;
the score is the posterior of label 1, from the difference of the Mahalanobis
log-densities, with each class's Cholesky factor computed once.

The densities need sums and sums of products only, so all labelled rows of
the learning folds are used, and one small row per class reaches the driver.

Defined cases: a null text scores like an empty one; a label row without a
quality, or whose document is missing, teaches nothing; repeated labels each
count; with one class only (or none) the score is the smoothed share of
label 1; other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, crc_fold, kept_rows, map_batches, slices

FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
SHRINK = 0.05
PACK = 1 << 20
_KIND = np.full(256, 4, np.uint8)  # 0 upper, 1 lower or beyond ASCII, 2 digit, 3 space, 4 sign
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 1, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_END = re.compile(rb"[.!?]+(?=\s|$)")
FEATURES = (
    "words", "word_length", "upper", "digits", "signs", "types", "top_word", "packed",
    "sign_ended", "sentence", "pair_repeats", "line_repeats",
)


def _logit(share: float, n: int, usual: float) -> float:
    """Log-odds of a share seen in ``n`` items; few items draw it to the usual one."""
    p = (share * n + 20 * usual) / (n + 20)
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of FEATURES."""
    raw = (text or "").encode()
    n = len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5)
    words = raw.split()
    w = len(words)
    counts = Counter(words)
    packed, pack = 0, zlib.compressobj(1)
    for at in range(0, n, PACK):
        packed += len(pack.compress(raw[at : at + PACK]))
    packed += len(pack.flush())
    ended = sum(1 for x in counts if _KIND[x[-1]] == 4 and x[-1] not in b".,;:") if w else 0
    top = counts.most_common(1)[0][1] if w else 0
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x]
    ends = len(_END.findall(raw)) + 1
    letters = int(kinds[0] + kinds[1])
    return [
        float(np.log1p(w)),
        float(np.log1p((n - kinds[3]) / max(w, 1))),
        _logit(kinds[0] / max(letters, 1), letters, 0.02),
        float(np.sqrt(kinds[2] / max(n, 1))),
        _logit(kinds[4] / max(n, 1), n, 0.03),
        float(np.log1p(len(counts)) / np.log1p(max(w, 1))),
        _logit(top / max(w, 1), w, 0.06),
        float(np.log((packed + 20) / (n + 60))),
        _logit(ended / max(len(counts), 1), len(counts), 0.01),
        float(np.log1p(w / ends)),
        _logit(1 - pairs / (w - 1) if w > 1 else 0.0, max(w - 1, 0), 0.01),
        _logit(1 - len(set(lines)) / max(len(lines), 1), len(lines), 0.01),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, fold and x (the statistics) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch):
                x = [statistics(t) for t in part.column("text").to_pylist()]
                yield {"doc_id": part.column("doc_id"), "fold": part.column("fold"), "x": x}

    rows = docs.select("doc_id", crc_fold(F.col("doc_id"), FOLDS).alias("fold"), "text")
    return map_batches(rows, run, f"doc_id {kind}, fold bigint, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Scores for rows of statistics; ``classes`` is empty if one class was missing."""

    prior: float
    classes: tuple = ()

    @staticmethod
    def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK) -> Discriminant:
        """moments: per class the count, the sum of x and the sum of its outer products."""
        n = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        prior = (n[1] + 1) / (n[0] + n[1] + 2)
        if min(n.values()) < 2:
            return Discriminant(prior)
        mean = {c: moments[c][1] / n[c] for c in (0, 1)}
        cov = {c: moments[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = np.diag((n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])).clip(1e-6)
        classes = []
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - shrink) * cov[c] + shrink * np.diag(pooled) + 1e-6 * np.eye(len(pooled)))
            classes.append((mean[c], np.linalg.inv(factor), -np.log(np.diag(factor)).sum()))
        return Discriminant(prior, tuple(classes))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        density = [base - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, base in self.classes]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-odds.clip(-50, 50)))


def _given(batch: pa.RecordBatch) -> list:
    return batch.column("x").to_pylist()


def _of_texts(batch: pa.RecordBatch) -> list:
    return [statistics(t) for part in slices(batch) for t in part.column("text").to_pylist()]


def moments(
    rows: DataFrame, of: Callable[[pa.RecordBatch], list] = _given
) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products by class, added up by Spark.

    ``rows`` has n0 and n1, how often each class counts, and what ``of`` makes the
    statistics from.
    """
    d = len(FEATURES)
    size = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = {0: np.zeros(size), 1: np.zeros(size)}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(of(batch), float).reshape(-1, d)
            for c in (0, 1):
                n = np.array(batch.column(f"n{c}").to_pylist(), float)
                z, n = x[n > 0], n[n > 0]
                nz = z * n[:, None]
                total[c] += np.concatenate(([n.sum()], nz.sum(axis=0), (nz.T @ z).ravel()))
        yield {
            "y": np.repeat([0, 1], size),
            "k": np.tile(np.arange(size), 2),
            "v": np.concatenate((total[0], total[1])),
        }

    parts = map_batches(rows, run, "y int, k int, v double")
    sums = {0: np.zeros(size), 1: np.zeros(size)}
    for y, k, v in parts.groupBy("y", "k").agg(F.sum("v")).collect():  # 2 x 157 numbers
        sums[y][k] = v
    return {c: (s[0], s[1 : d + 1], s[d + 1 :].reshape(d, d)) for c, s in sums.items()}


def _marked(labels: DataFrame) -> DataFrame:
    """doc_id, and for each label which it is (n0 or n1 is one, the other nought)."""
    n = [(F.col("quality") == c).cast("long").alias(f"n{c}") for c in (0, 1)]
    return labels.where("quality in (0, 1)").select("doc_id", *n)


def learn(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labelled documents of the learning folds; only their statistics are computed,
    in one pass, so that a task needs one Python worker."""
    known = docs.select("doc_id", "text").where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = _marked(labels).groupBy("doc_id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    taught = known.join(counts, "doc_id").select("text", "n0", "n1")
    return Discriminant.fit(moments(taught, _of_texts))


def score(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    space = Workspace(spark, "quality")
    seen = space.save(features(docs), "features")
    taught = seen.where(F.col("fold") != HELD_OUT).join(_marked(labels), "doc_id")
    model = Discriminant.fit(moments(taught.select("x", "n0", "n1")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
                p = model.score(x)
                held = np.array(batch.column("fold").to_pylist()) == HELD_OUT
                yield {
                    "doc_id": batch.column("doc_id"), "held_out": held, "score": p,
                    "predicted": (p >= threshold).astype(np.int32),
                }

    return map_batches(seen, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject.

    Rows that share an id (or a null one) are each judged on their own text.
    """
    model = learn(docs, labels)

    def keep(texts: list[str | None]) -> list[bool]:
        return (model.score(np.array([statistics(t) for t in texts], float)) >= threshold).tolist()

    return kept_rows(docs, "text", keep)
