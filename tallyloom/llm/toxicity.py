"""Toxicity: a linear classifier learnt from confirmed toxic documents and unlabelled ones.

Unlabelled text holds toxic documents too, a share `prior` of it. The risk of calling a clean document toxic is therefore
that of the unlabelled documents less the prior's share of the confirmed ones; that difference counts as zero where
it falls below (non-negative positive-unlabelled learning).

Features are what a document contains at least once: words without surrounding punctuation and their beginnings. Those
that set the confirmed documents apart are kept, a bounded number. So one insult counts in a long text as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordCache, sigmoid, slices, texts
from tallyloom.llm.samples import choose, features_of, held_out, minimise

CONFIRMED, UNLABELLED = 3000, 4000  # at most so many documents of each kind are fitted on
KEPT_FEATURES, EVIDENCE = 1024, 8.0
BEGINNINGS = (4, 5, 6)
THRESHOLD, SEED = 0.7, 23
EDGES = b".,;:!?\"'()[]{}<>*-_"


def word_features(word: bytes) -> list[int]:
    word = word.lower().strip(EDGES)
    text = word.decode(errors="ignore")
    return [crc32(word), *(crc32(text[:n].encode() + b"\n") for n in BEGINNINGS if len(text) > n)] if word else []


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(sorted({f for w in set(text.split()) for f in word_features(w)}), np.int64)
    return found, np.ones(len(found))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def fit_sets(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, kept: int = KEPT_FEATURES,
             penalty: float = 5e-4, steps: int = 400) -> Model:
    """Fit on documents given as arrays of distinct feature ids. Without confirmed documents nothing is toxic."""
    if not confirmed or not unlabelled:
        return Model({}, -4.0)
    shares = []
    for documents in (confirmed, unlabelled):
        shares.append(dict(zip(*np.unique(np.concatenate(documents), return_counts=True))))
    found = np.array(list(shares[0]))
    n = np.array([shares[0][f] for f in found.tolist()], float)
    p = (n + 0.5) / (len(confirmed) + 1)
    u = (np.array([shares[1].get(f, 0) for f in found.tolist()]) + 0.5) / (len(unlabelled) + 1)
    # Log-likelihood ratio against the count that the unlabelled share lets expect: rare coincidences stay out.
    expected = u * len(confirmed)
    clear = (p > u) & (n * np.log(n / expected) - (n - expected) > EVIDENCE)
    apart = sorted(zip((p * np.log(p / u))[clear].tolist(), found[clear].tolist()), reverse=True)
    chosen = np.array(sorted(f for _, f in apart[:kept]), np.int64)
    if not len(chosen):
        return Model({}, float(np.log(prior / (1 - prior))))

    def matrix(documents: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(documents), len(chosen) + 1), np.float32)
        x[:, -1] = 1
        for row, ids in enumerate(documents):
            x[row, np.flatnonzero(np.isin(chosen, ids, assume_unique=True))] = 1
        return x

    xp, xu = matrix(confirmed), matrix(unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        wf = w.astype(np.float32)
        zp, zu = xp @ wf, xu @ wf
        p, u = sigmoid(zp), sigmoid(zu)
        # Risk of what is clean, estimated from unlabelled less confirmed documents; below zero it counts as zero.
        clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        total = prior * (xp.T @ ((p - 1) / len(p)).astype(np.float32)) + penalty * np.append(w[:-1], 0)
        if clean_risk > 0:
            total += xu.T @ (u / len(u)).astype(np.float32) - prior * (xp.T @ (p / len(p)).astype(np.float32))
        return total

    start = np.zeros(len(chosen) + 1)
    start[-1] = np.log(prior / (1 - prior))
    w = minimise(gradient, start, steps, 0.05)
    return Model(dict(zip(chosen.tolist(), w[:-1].tolist())), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED,
        prior: float | None = None, seed: int = SEED) -> Model:
    """Fit from labels (doc_id, toxic), of rows that aren't held out: confirmed documents are those marked toxic, at most
    `confirmed`; unlabelled ones any documents, whatever their label, at most `unlabelled`, both chosen by hash of the id.
    The prior is the toxic share of those labels unless given.
    """
    learn = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    if prior is None:
        row = learn.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()
        prior = row[0] if row[0] is not None else 0.5
    prior = min(max(prior, 1e-3), 0.5)
    marked = learn.where("toxic = 1").select("doc_id", F.lit(1).alias("class"))
    any_docs = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.lit(0).alias("class"))
    ids_1, _, _ = features_of(docs, choose(marked, confirmed, range(1, 2), seed), features)
    ids_0, _, _ = features_of(docs, choose(any_docs, unlabelled, range(1), seed + 1), features)
    return fit_sets(ids_1, ids_0, prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic (int, 1 from the threshold on), from whole texts alone.

    Texts without words get the score of no evidence. Rows, repeats included, and other columns stay; columns of the two
    names are replaced.
    """
    names = ("toxicity", "toxic")
    docs = docs.drop(*names)
    schema = docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1])).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        cache = WordCache(lambda word: tuple(f for f in word_features(word) if f in weights))
        for batch in slices(batches):
            totals = []
            for text in texts(batch.column(at)):
                found = {f for hits in map(cache.__getitem__, set(text.split())) for f in hits}
                totals.append(model.bias + sum(weights[f] for f in sorted(found)))
            scores = sigmoid(np.array(totals))
            made = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
