"""What several operators share: reading tables, text columns, settling intermediate tables, Arrow batches, word features."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts exactly there.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyloom-")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which names a cluster's shared folder. A session that runs in one
    process may do without: it gets a temporary folder. On a cluster executors would each write to their own disk there,
    so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/tallyloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to a new folder and read it back, so that later jobs start from files that outlive executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0. Native."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACES))).cast("long")


_WARM = []


def warm(make: Callable) -> Callable:
    """The function with what it made last kept, for later tasks of the Python worker."""
    kept = lru_cache(2)(make)
    _WARM.append(kept)
    return kept


def cool() -> None:
    """Drop what warm() functions keep. Workers outlive stages: an operator that needs much memory of its own calls it first,
    so that a worker holds one operator's tables at a time.
    """
    for kept in _WARM:
        kept.cache_clear()
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def row_hash(df: DataFrame, *names: str) -> Column:
    """Two 64-bit hashes of the named columns as one text: rows that share it are taken as equal."""
    columns = [F.col(n) for n in names]
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), *columns)))


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """rows with `rank` (from 0 within each group, by the order columns) and `total` (rows of the group), both long.

    Rows are dealt into ranges of (group, order), so a group of any size is spread over tasks; a range counts its own rows
    and the counts of the ranges before are added. Rows that tie in all order columns are told apart by where they lie in a
    written table, so repeats don't pile up in one range and every later job sees the same ranks. Nulls come first.
    """
    tie, at, part, first, before, other = (free_name(rows, n) for n in ("_tie", "_at", "_part", "_first", "_before", "_group"))
    stored = settle(rows.withColumn(tie, F.monotonically_increasing_id()), label)
    keys = [group, *order, tie]
    dealt = stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    # The id is the partition's number in the high 31 bits and the row's place in it in the low 33.
    dealt = dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33))
    dealt = settle(dealt, label)
    runs = dealt.groupBy(group, part).agg(F.count("*").alias("total"), F.min(at).alias(first))
    own = W.partitionBy(group)
    runs = runs.select(
        F.col(group).alias(other), F.col(part).alias(f"{part}{other}"), first,
        (F.sum("total").over(own.orderBy(part)) - F.col("total")).alias(before), F.sum("total").over(own).alias("total"),
    )
    same = F.col(group).eqNullSafe(F.col(other)) & (F.col(part) == F.col(f"{part}{other}"))
    placed = dealt.join(runs, same).withColumn("rank", F.col(before) + F.col(at) - F.col(first))
    return placed.select(*rows.columns, "rank", "total")


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, one by one; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(batches: Iterable[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a cut holds about `size` bytes, one row at least: bounds what is built per step."""
    for batch in batches:
        rows, step = batch.num_rows, max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, min(step, rows - start))


class WordCache(dict):
    """word -> value made by `make`; emptied when it holds `limit` words, so memory is bounded whatever the corpus."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        value = self.make(word)
        if len(word) <= 64:
            self[word] = value
        return value


def bucket(feature: bytes, dims: int) -> int:
    """Hashing trick: a feature's column."""
    return zlib.crc32(feature) % dims


_RUNS = (
    (re.compile(rb"[A-Z]+"), b"A"),
    (re.compile(rb"[a-z]+"), b"a"),
    (re.compile(rb"[0-9]+"), b"9"),
    (re.compile(rb"[\x80-\xff]+"), b"u"),
)


def shape(word: bytes) -> bytes:
    """Letters, digits and other characters of a word by class, runs cut to one: b'EDTH!!' -> b'A!!'."""
    for pattern, mark in _RUNS:
        word = pattern.sub(mark, word)
    return word[:12]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
