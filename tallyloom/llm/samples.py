"""Bounded samples of documents to fit a classifier on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, texts


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, mod 3, is 1. Rows without id aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def choose(rows: DataFrame, per_class: int, classes: range, seed: int) -> DataFrame:
    """Of rows (doc_id, class), at most `per_class` of each class, those whose ids hash lowest: (doc_id, class)."""
    order = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    rows = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("class").cast("int").alias("class"))
    parts = [rows.where(F.col("class") == c).orderBy(*order).limit(per_class) for c in classes]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def features_of(docs: DataFrame, chosen: DataFrame, extract) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For the chosen documents: their features' ids and values as `extract(text)` gives them, and their classes.

    `chosen` is bounded by choose(), so it is broadcast to the scan and what comes back fits the driver: a row per id,
    ordered by id. Of rows with the same id the one with the longest text counts, of equally long ones the first by text.
    """
    texts_of = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = texts_of.groupBy("doc_id", "class").agg(F.min_by("text", F.struct(-F.length("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [extract(t) for t in texts(batch.column(2))]
            ids = pa.array([i.astype(np.int64) for i, _ in made], pa.list_(pa.int64()))
            values = pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, values], names=["doc_id", "class", "ids", "vals"])

    got = one.mapInArrow(run, "doc_id long, class int, ids array<long>, vals array<float>").toArrow().sort_by("doc_id")
    column = lambda name: [np.asarray(x.values) for x in got.column(name)]
    return column("ids"), column("vals"), got.column("class").to_numpy().astype(int)


def minimise(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam on the full batch."""
    w, m, v = start.astype(float), np.zeros_like(start, dtype=float), np.zeros_like(start, dtype=float)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
