"""Quality scores by regularised quadratic discriminant analysis of document statistics.

A document is a vector of statistics of its bytes, words and lines, transformed towards bell shapes. Each class
gets a mean and a covariance, shrunk towards the pooled covariance and its diagonal; their Cholesky factors are
computed once and travel with the model. A score is the posterior of label 1: the difference of the classes'
log-densities, from Mahalanobis distances, and of their log priors, through the logistic function.

The model learns from SAMPLE labelled rows at most, those with the smallest hashes of doc_id, which bounds what
is broadcast and collected; scores cover all rows. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null text is empty text and gets a score like any other; without labelled rows of both classes
every score is 0.5; null doc_id is held out; a doc_id counts once with each label it has, by one of its documents
if it has several; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_batches, pieces, span_hashes, word_spans

#: The most labelled rows to learn from.
SAMPLE = 20_000
#: Shares of the pooled covariance, and of its diagonal, in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
FOLDS = 5
#: Words and lines of one text are counted by hashes under a fixed key, as scores must not change from run to run.
KEY = (1, 3, 5, 7)
FEATURES = ("bytes", "words", "word_length", "word_spread", "upper", "digits", "punctuation", "symbols", "other_bytes", "space", "entropy", "distinct_words", "word_repeats", "line_breaks", "distinct_lines", "line_length", "ends")

_KIND = np.zeros((256, 6))
_KIND[65:91, 0] = 1  # upper case
_KIND[97:123, 1] = 1  # lower case
_KIND[48:58, 2] = 1  # digits
for _c in b".,;:!?'\"()-":
    _KIND[_c, 3] = 1
for _c in range(33, 127):
    if not _KIND[_c].any():
        _KIND[_c, 4] = 1  # other signs
_KIND[128:, 5] = 1


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row; 40 bits of a key decide."""
    if not len(keys):
        return np.zeros(rows)
    both = np.sort(row.astype(np.uint64) << np.uint64(40) | keys >> np.uint64(24))
    new = np.append(True, both[1:] != both[:-1])
    return np.bincount((both[new] >> np.uint64(40)).astype(np.int64), minlength=rows).astype(float)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, features) transformed statistics of texts given as bytes and row offsets."""
    rows = len(at) - 1
    size = np.diff(at).astype(float)
    row = np.repeat(np.arange(rows), np.diff(at))
    histogram = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(float) if rows else np.zeros((0, 256))
    kinds = histogram @ _KIND
    part = lambda x, of: x / np.maximum(1.0, of)
    share = part(histogram, size[:, None])
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    starts, ends, words_at = word_spans(data, at)
    words = np.diff(words_at).astype(float)
    of = np.repeat(np.arange(rows), np.diff(words_at))
    length = (ends - starts).astype(float)
    mean = part(np.bincount(of, length, rows), words)
    spread = np.sqrt(np.maximum(0, part(np.bincount(of, length**2, rows), words) - mean**2))
    hashes, _ = span_hashes(data, starts, ends, KEY)
    again = np.zeros(len(starts))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    last = data[ends - 1] if len(ends) else data[:0]
    lines_end = np.flatnonzero(data == 10) if len(data) else np.zeros(0, np.int64)
    line_starts = np.union1d(lines_end + 1, at[:-1][size > 0])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_row = np.searchsorted(at, line_starts, "right") - 1
    lines = np.bincount(line_row, minlength=rows).astype(float)
    distinct_lines = _distinct(span_hashes(data, line_starts, line_ends, KEY)[0], line_row, rows)
    letters = kinds[:, 0] + kinds[:, 1]
    columns = [
        np.log1p(size),
        np.log1p(words),
        np.log1p(mean),
        np.log1p(spread),
        np.sqrt(part(kinds[:, 0], letters)),
        np.sqrt(part(kinds[:, 2], size)),
        np.sqrt(part(kinds[:, 3], size)),
        np.sqrt(part(kinds[:, 4], size)),
        np.sqrt(part(kinds[:, 5], size)),
        np.sqrt(part(histogram[:, SPACE].sum(1), size)),
        entropy,
        np.log1p(_distinct(hashes, of, rows)) / np.maximum(1.0, np.log1p(words)),
        np.sqrt(part(np.bincount(of, again, rows), words)),
        np.sqrt(part(histogram[:, 10], words)),
        part(distinct_lines, lines),
        np.log1p(part(size, lines)),
        np.sqrt(part(np.bincount(of, _KIND[last, 3], rows), words)),
    ]
    return np.stack(columns, 1)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_determinants: np.ndarray
    log_priors: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Discriminant | None:
        if not len(y) or y.min() == y.max():
            return None
        centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - centre) / scale
        groups = [z[y == k] for k in (0, 1)]
        scatter = [(g - g.mean(0)).T @ (g - g.mean(0)) for g in groups]
        pooled = (scatter[0] + scatter[1]) / len(z)
        means, factors, logs = [], [], []
        for g, s in zip(groups, scatter, strict=True):
            # A class of few rows leans on the pooled covariance more.
            own = len(g) / (len(g) + z.shape[1])
            c = (1 - TO_POOLED) * (own * s / len(g) + (1 - own) * pooled) + TO_POOLED * pooled
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
            lower = np.linalg.cholesky(c)
            means.append(g.mean(0))
            factors.append(np.linalg.inv(lower))
            logs.append(2 * np.log(np.diag(lower)).sum())
        return cls(centre, scale, np.array(means), np.array(factors), np.array(logs), np.log([len(g) / len(z) for g in groups]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1."""
        z = (x - self.centre) / self.scale
        log = [p - 0.5 * ((((z - m) @ f.T) ** 2).sum(1) + d) for m, f, d, p in zip(self.means, self.factors, self.log_determinants, self.log_priors, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Discriminant | None:
    """Learn from at most `sample` labelled rows that are not held out."""
    bounded_batches(docs.sparkSession)
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
    rows = rows.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__y").limit(sample)
    # Not more than `sample` rows, whatever the input.
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("__id"))
    # Of documents that repeat an id one counts, so that not more than `sample` rows come back.
    found = found.groupBy("__id", "__y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("__y", "text")

    def run(batches):
        for b in batches:
            for part, data, at in pieces(b):
                x = statistics(data, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))], names=["y", "x"])

    got = found.mapInArrow(run, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(len(y), len(FEATURES))
    # The order in which tasks end must not show in the sums.
    order = np.lexsort((*x.T, y))
    return Discriminant.fit(x[order], y[order])


def scores(docs: DataFrame, model: Discriminant | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part, data, at in pieces(b):
                s = model.score(statistics(data, at)) if model else np.full(len(at) - 1, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
