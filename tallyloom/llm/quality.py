"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A document's score is a weighted mean over its words, with hashed features: the word, its shape (b"A!!" for "EDTH!!"),
and whether it repeats the word before. All grades share the weights; ordered thresholds cut the score:
P(grade >= k) = sigmoid(score - threshold_k). From these follow the expected grade and the tail probability that selects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordCache, bucket, cool, shape, sigmoid, slices, texts
from tallyloom.llm.samples import choose, features_of, minimise

DIMS = 4096
PER_GRADE = 1500  # at most so many rated documents of each grade are fitted on
GRADES = 3
SEED = 11
REPEAT = DIMS
CACHE_WORDS = 100_000
DAMPING = 8  # words of no weight that every text has: a few odd words don't decide a short text


def columns(word: bytes) -> tuple[int, int]:
    return bucket(b"w" + word.lower(), DIMS), bucket(b"s" + shape(word), DIMS)


def _repeats(words: list[bytes]) -> int:
    return sum(map(eq, words, islice(words, 1, None)))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text: counts over the number of words and DAMPING more."""
    words = text.split()
    counts = np.zeros(DIMS + 1)
    for word in words:
        counts[list(columns(word))] += 1
    counts[REPEAT] = _repeats(words)
    used = np.nonzero(counts)[0]
    return used, counts[used] / (len(words) + DAMPING)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, class) from labels (doc_id, quality, toxic): 0 junk, 1 prose but toxic, 2 clean prose. Null quality: unrated."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null").select("doc_id", grade.alias("class"))


@dataclass
class Model:
    weights: np.ndarray  # by column; the last is for repeats
    thresholds: np.ndarray  # increasing; one fewer than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) by document and k from 1 on."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit_matrix(x: np.ndarray, y: np.ndarray, n_grades: int, penalty: float = 1e-3, steps: int = 300) -> Model:
    """Fit on features (a row per document) and grades 0 to n_grades - 1; grades without rows get a smoothed share."""
    share = (np.bincount(y, minlength=n_grades) + 1) / (len(y) + n_grades)
    above = np.clip(1 - np.cumsum(share)[:-1], 1e-6, 1 - 1e-6)
    first = -np.log(above / (1 - above))
    steps_between = np.log(np.maximum(np.diff(first), 1e-3))
    if len(np.unique(y)) < 2:
        return Model(np.zeros(x.shape[1]), first)
    rms = np.sqrt((x**2).mean(0))
    scale = 1 / (rms + 0.02 * rms.max())
    x, d, rows = (x * scale).astype(np.float32), x.shape[1], np.arange(len(y))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))

    def gradient(p: np.ndarray) -> np.ndarray:
        cut = sigmoid((x @ p[:d].astype(np.float32))[:, None] - thresholds(p)[None, :])
        tail = np.hstack([np.ones((len(y), 1)), cut, np.zeros((len(y), 1))])
        slope = np.hstack([np.zeros((len(y), 1)), cut * (1 - cut), np.zeros((len(y), 1))])
        probability = np.maximum(tail[rows, y] - tail[rows, y + 1], 1e-9)
        # d(-log P)/d(score - threshold) of the two cuts around the grade.
        low, high = -slope[rows, y] / probability, slope[rows, y + 1] / probability
        by_score = (low + high) / len(y)
        by_cut = np.zeros_like(tail)
        np.add.at(by_cut, (rows, y), -low / len(y))
        np.add.at(by_cut, (rows, y + 1), -high / len(y))
        by_cut = by_cut.sum(0)[1:-1]
        later = np.cumsum(by_cut[::-1])[::-1]
        by_parameter = np.concatenate([later[:1], later[1:] * np.exp(p[d + 1 :])])
        return np.concatenate([x.T @ by_score.astype(np.float32) + penalty * p[:d], by_parameter])

    p = minimise(gradient, np.concatenate([np.zeros(d), first[:1], steps_between]), steps, 0.05)
    return Model(p[:d] * scale, thresholds(p))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = GRADES, per_grade: int = PER_GRADE, seed: int = SEED) -> Model:
    """Fit on at most `per_grade` documents of each grade, chosen by hash among all ratings (doc_id, class)."""
    ids, values, y = features_of(docs, choose(ratings, per_grade, range(n_grades), seed), features)
    x = np.zeros((len(y), DIMS + 1), np.float32)
    for row, (i, v) in enumerate(zip(ids, values)):
        x[row, i] = v
    return fit_matrix(x, y, n_grades)


def rate(docs: DataFrame, model: Model, select_grade: int = 1, at_least: float = 0.5,
         names: tuple[str, str, str] = ("expected_grade", "tail", "kept")) -> DataFrame:
    """docs with expected_grade, tail (probability of `select_grade` or better) and kept (tail >= at_least).

    Whole texts are scored. Texts without words (null, empty) have expected grade and tail 0 and are not kept. Rows,
    repeats included, and other columns stay; columns of the three names are replaced.
    """
    docs = docs.drop(*names)
    added = [F.lit(0.0).alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2])]
    schema, at = docs.select("*", *added).schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        weights = model.weights.tolist()
        cache = WordCache(lambda word: sum(weights[c] for c in columns(word)), CACHE_WORDS)
        for batch in slices(batches):
            scores, some = [], []
            for text in texts(batch.column(at)):
                words = text.split()
                total = sum(map(cache.__getitem__, words)) + weights[REPEAT] * _repeats(words)
                scores.append(total / (len(words) + DAMPING))
                some.append(bool(words))
            some = np.array(some)
            tails = model.tails(np.array(scores)) * some[:, None]
            tail = tails[:, select_grade - 1]
            made = [pa.array(tails.sum(1)), pa.array(tail), pa.array((tail >= at_least) & some)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
