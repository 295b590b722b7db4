"""Quality scores by regularised quadratic discriminant analysis.

Every whole text becomes a dozen transformed statistics (shares of symbols,
capitals, digits, repeated words and repeated shingles, richness of words, line
and sentence lengths). Each class has a mean and a covariance that is shrunk
towards the pooled one and then towards a multiple of the identity; the score
compares the classes' log densities, computed from Mahalanobis distances with
Cholesky factors that are kept with the model. The amounts of shrinkage and the
curve from density difference to score are chosen on a part of the labelled
sample that the moments have not seen.

The fit takes a bounded sample of the labelled documents outside the held-out
fold; scoring is one pass over whole texts without a shuffle.

Results for odd inputs: null, empty and blank texts have all statistics zero and
a score like any other; without both classes among the labels every score is
the share of label 1, or 0; repeated rows are scored each; a null ``doc_id`` is
scored and never learnt from; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import held_out, logistic
from .memory import tidy
from .words import mix, text_array, words

STATISTICS = [
    "size", "symbols", "capitals", "bars", "digits", "twins", "richness", "top_word", "word_length", "long_words",
    "stops", "lines", "again", "marked_words",
]
#: Bound of the training sample, for each class.
MOST = 6_000
#: Bytes of text measured at once (a longer text alone, whole), and rows passed on at once.
MEASURED_BYTES, PASSED_ROWS = 1 << 19, 1024
_SCHEMA = ", ".join(f"{s} double" for s in STATISTICS)
_KINDS = np.zeros((5, 256))
_KINDS[0, [ord(c) for c in "!#$%&*@|~^+=<>{}[]\\/_"]] = 1
_KINDS[1, 65:91] = 1
_KINDS[2, ord("|")] = 1
_KINDS[3, 48:58] = 1
_KINDS[4, [ord(c) for c in ".?!"]] = 1


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the most frequent one's count, of each row."""
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(code)))
    top = np.zeros(n)
    np.maximum.at(top, row[at], count)
    return np.bincount(row[at], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for w in words(texts, MEASURED_BYTES):
        n = w.hi - w.lo
        size = np.diff(w.row_at)
        h = w.hashes()
        count = np.bincount(w.row, minlength=n)
        per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
        edges = np.zeros(len(w.data) + 1)

        def share(flag: np.ndarray) -> np.ndarray:
            np.cumsum(flag, out=edges[1:])
            return edges[w.row_at[1:]] - edges[w.row_at[:-1]]

        symbols, capitals, bars, digits, stops = (share(k[w.data]) for k in _KINDS)
        lines = share(w.data == 10)
        distinct, top = _distinct(w.row, h, n)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
        last = w.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
        marked = _KINDS[0][last]
        length = w.end - w.start
        again = np.zeros(n)
        if len(h) > 4:
            inside = np.flatnonzero(w.row[:-4] == w.row[4:])
            code = np.zeros(len(inside), np.uint64)
            for j in range(5):
                code = mix(code * np.uint64(0xA0761D6478BD642F) + h[inside + j])
            found = np.bincount(w.row[inside], minlength=n)
            again = 1 - _distinct(w.row[inside], code, n)[0] / np.maximum(found, 1)
            again[found == 0] = 0
        out[w.lo : w.hi] = np.column_stack(
            [
                np.log1p(count),
                np.sqrt(symbols / per_byte),
                np.sqrt(capitals / per_byte),
                np.sqrt(bars / per_word),
                np.sqrt(digits / per_byte),
                np.sqrt(np.bincount(w.row, weights=same, minlength=n) / per_word),
                np.log1p(distinct) / np.log1p(per_word),
                np.sqrt(top / per_word),
                np.log1p(np.bincount(w.row, weights=length, minlength=n) / per_word),
                np.sqrt(np.bincount(w.row, weights=length > 20, minlength=n) / per_word),
                np.sqrt(stops / per_word),
                np.sqrt(lines / per_word),
                np.sqrt(again),
                np.sqrt(np.bincount(w.row, weights=marked, minlength=n) / per_word),
            ]
        )
        out[w.lo : w.hi][count == 0] = 0
    return out


@dataclass
class Discriminant:
    """Class means, Cholesky factors' inverses and log determinants, and the score's curve."""

    means: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        out = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse[k].T
            out.append(-0.5 * (np.einsum("ij,ij->i", z, z) + self.logdet[k]))
        return np.sign(out[1] - out[0]) * np.log1p(np.abs(out[1] - out[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -500, 500)))


def _discriminant(x: np.ndarray, y: np.ndarray, pooled: float, round_: float) -> Discriminant:
    d = x.shape[1]
    means = np.stack([x[y == k].mean(0) for k in (0, 1)])
    own = [np.cov(x[y == k].T, bias=True) if (y == k).sum() > 1 else np.zeros((d, d)) for k in (0, 1)]
    both = sum((y == k).mean() * own[k] for k in (0, 1))
    inverse, logdet = [], []
    for k in (0, 1):
        s = (1 - pooled) * own[k] + pooled * both
        s = (1 - round_) * s + (round_ * np.trace(s) / d + 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(lower))
        logdet.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(means, np.stack(inverse), np.array(logdet))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Shrinkage and curve by the log loss on every third row, moments from the others."""
    empty = Discriminant(np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2))
    if len(np.unique(y)) < 2:
        empty.constant = float(y.mean()) if len(y) else 0.0
        return empty
    check = np.arange(len(y)) % 3 == 0
    if len(np.unique(y[check])) < 2 or len(np.unique(y[~check])) < 2:
        check = np.ones(len(y), bool)
        learn = check
    else:
        learn = ~check
    best = None
    for pooled in (0.0, 0.1, 0.3, 0.6):
        for round_ in (1e-3, 1e-2, 5e-2):
            m = _discriminant(x[learn], y[learn], pooled, round_)
            z = m.difference(x[check])
            weight = np.ones(len(z))
            m.slope, m.offset = logistic(z[:, None], y[check], weight, penalty=1e-3)
            p = np.clip(m.score(x[check]), 1e-9, 1 - 1e-9)
            loss = -np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))
            if best is None or loss < best[0]:
                best = (loss, m)
    return best[1]


def learn(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on at most MOST labelled documents of each class outside the held-out fold."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(text_array(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in x.T]], names=["doc_id", "y", *STATISTICS])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    some = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(MOST) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(some[0].union(some[1])), "doc_id")  # at most 2 * MOST ids of 16 bytes
    found = rows.select("doc_id", "y", "text").mapInArrow(tidy(measure), "doc_id long, y int, " + _SCHEMA)
    found = found.orderBy(order, "doc_id").limit(2 * MOST).collect()
    x = np.array([list(r)[2:] for r in found]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.y for r in found]))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = spark.sparkContext.broadcast(learn(docs, labels))  # a few matrices of the statistics

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = shared.value.score(statistics(text_array(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(tidy(score), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold, with all their columns, in one pass."""
    shared = spark.sparkContext.broadcast(learn(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PASSED_ROWS):
                rows = batch.slice(lo, PASSED_ROWS)
                yield rows.filter(pa.array(shared.value.score(statistics(text_array(rows.column(at)))) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
