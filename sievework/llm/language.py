"""Language identification by rank-order n-gram profiles.

Words are runs of letters, in lower case, with a space on either side; their n-grams of one to three characters
are counted. A language's profile is its PROFILE most frequent n-grams in order; a document's likewise. The
distance of the two sums, over the document's n-grams, how far each is out of place; one that the profile lacks
counts PROFILE places. The nearest profile names the language.

A profile learns from about SAMPLE documents of the language at most, chosen by a hash of doc_id; predictions
cover all documents and whole texts. lang, source and doc_id are no inputs of a prediction.

Defined results: null text, and text without letters, is `und` with score 0, and so is any text where nothing
was learned; ties go to the language that comes first; null doc_id is held out; null lang teaches nothing; an
empty table gives an empty table. The score is s1 / (s1 + s2) for the two nearest languages, s being one less
the distance as a share of the largest; with a single language it is s1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, folded, materialize, trim
from .quality import held_out

PROFILE, LONGEST = 300, 3
#: About the most documents that a language's profile learns from.
SAMPLE = 5_000
UNKNOWN = "und"
#: Languages whose counts are small enough to broadcast.
FEW = 10_000
#: n-grams that a task gathers before it passes on their counts.
COUNTED = 500_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as numbers of 21 bits a character, and their counts."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    # Between two words stays one space, which serves both.
    c = np.where(letter, c, 32)[keep].astype(np.int64)
    letter = letter[keep]
    twice = np.append(False, ~letter[1:] & ~letter[:-1])
    c, letter = c[~twice], letter[~twice]
    out = [c[letter]]
    two = c[:-1] | c[1:] << 21
    out.append(two)
    if len(c) > 2:
        out.append((two[:-1] | c[2:] << 42)[letter[1:-1]])
    found = [np.unique(x, return_counts=True) for x in out]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _best(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order; equal counts in order of their numbers."""
    if len(grams) > 4 * PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


class Profiles:
    """The languages' ranks of all n-grams that any of their profiles has."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[name], np.int64)), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = _best(*ngrams(text or "")) if self.languages else self.grams
        if not len(grams):
            return UNKNOWN, 0.0
        where = np.searchsorted(self.grams, grams)
        known = where < len(self.grams)
        known[known] = self.grams[where[known]] == grams[known]
        ranks = self.ranks[np.where(known, where, len(self.grams))]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(grams))[:, None]))
        s = 1 - apart.sum(0) / (PROFILE * len(grams))
        order = np.argsort(-s, kind="stable")
        first, second = s[order[0]], s[order[1]] if len(order) > 1 else None
        score = first if second is None else first / (first + second) if first + second > 0 else 0.5
        return self.languages[order[0]], float(score)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from the documents with a lang that are not held out."""
    bounded_batches(docs.sparkSession)
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    amount = materialize(known.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n")), "languages")
    # A row for each language: with few of them, as ever, the texts stay where they are.
    amount = F.broadcast(amount) if amount.count() <= FEW else amount
    chosen = known.join(amount, F.col("lang") == F.col("__lang")).filter(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)).cast("double") / (1 << 30) * F.col("__n") < sample)

    def run(batches):
        held: dict[str, list] = {}

        def rows():
            for lang, parts in held.items():
                grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(ngrams(text or ""))
                size += len(held[lang][-1][0])
                if size > COUNTED:
                    yield from rows()
                    held, size = {}, 0
                    trim()
        yield from rows()

    counts = chosen.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").select("lang", "gram").collect():  # a profile each
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles(profiles)


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, held_out, lang_pred and score of every document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("__text"))
    schema = StructType([*rows.drop("__text").schema, *StructType.fromDDL("lang_pred string, score double")])

    def run(batches):
        for b in batches:
            got = [profiles.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)
            trim()

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents whose language is known, with their own columns."""
    rows, back = folded(docs)
    return predict(rows.select("*", F.col("text").alias("body")), profiles, ("others", "body")).filter(F.col("lang_pred") != UNKNOWN).select(*back("body"))
