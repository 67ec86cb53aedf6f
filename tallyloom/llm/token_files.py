"""Token ids in Parquet: list columns in a document order, laid out for selective reads.

A row is a document: doc_id, shard and place (its position: shards in order, places within a shard), n_tokens and ids.
Ids are dictionary encoded (or delta encoded), row groups and pages are small and sorted by doc_id, and the footer has
column and offset indexes, so a reader of a few documents opens the row groups and pages that can hold them, and a
reader of lengths or positions never touches the ids.

Encoding is a map in the range-partitioned order, by the tokenizers library. Words recur, so where no
token crosses white space the library gets a word once per worker while a bounded cache has what it stands in.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.bpe import (
    CACHE_CHUNKS, SLICE_BYTES, ChunkEncoder, Splitter, cuts_at_space, ended, id_bytes, id_lists, read_vocabulary, sizes_of,
)
from tallyloom.llm.common import slices

END_ID = 1
WORDS = 512  # given to the library's model at once
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 64 << 10
SCHEMA = "doc_id long, shard int, place long, n_tokens long, ids array<int>"


class LibraryEncoder:
    """The tokenizers library. Where texts may be cut at white space, its model gets each new word of them once, behind a
    bounded cache of what stands between white space; otherwise it gets whole texts.
    """

    def __init__(self, text: str, limit: int = CACHE_CHUNKS):
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        self.chunks = ChunkEncoder(Splitter(text), self._words, limit) if cuts_at_space(spec) else None
        if self.chunks:
            # Its model alone, over words that are cut and spelled in byte letters already.
            plain = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(plain | {"truncation": None, "padding": None}))
            last = spec["model"].get("end_of_word_suffix")
            ids = spec["model"]["vocab"]
            self.ends_word = np.zeros(max(ids.values()) + 1, bool)
            self.ends_word[[i for t, i in ids.items() if last and t.endswith(last)]] = True

    def encode(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text of a column as array<int>; null is empty."""
        if self.chunks:
            return self.chunks.encode(column)
        whole = [t or "" for t in column.to_pylist()]
        return id_lists([e.ids for e in self.library.encode_batch_fast(whole, add_special_tokens=False)])

    def _words(self, words: list[str]) -> pa.ListArray:
        """Many words a call. The last token of a word, and no other, is one that ends words."""
        lines = [" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
        encoded = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array([i for e in encoded for i in e.ids], np.int32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return id_lists([[t.id for t in self.library.model.tokenize(w)] for w in words])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))


@lru_cache(2)
def _encoder(spec: str) -> LibraryEncoder:
    return LibraryEncoder(spec)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode the text of docs (doc_id, text; others are ignored), append `end_id` to each document, write the files.

    Order: doc_id, nulls first, then the text itself, so equal ids and whole repeated rows have a defined order too.
    Null and empty texts give only the end id. `encoding` is "dictionary" or "delta". An empty frame gives files without
    rows. A task that is run again writes the same rows: the order is total.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, shard = _encoder(spec.value), 0, TaskContext.get().partitionId()
        for batch in slices(batches, SLICE_BYTES):
            n, lists = batch.num_rows, encoder.encode(batch.column(1))
            lists = lists if end_id is None else ended(lists, end_id)
            columns = [
                batch.column(0), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(place, place + n, dtype=np.int64)),
                sizes_of(lists), lists,
            ]
            place += n
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "place", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # Ranges of doc_id alone: the sampled bounds stay small, whatever the texts. Equal ids share a range.
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    delta = encoding == "delta"
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "v2" if delta else "v1")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the files, of doc_ids from `first` to `last` where given: row groups and pages outside are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def with_starts(rows: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Rows (shard, place, n_tokens, more) and `start`: how many ids all documents before have.

    Sums per shard go ahead (a row per written file), then each shard numbers its own documents; ids aren't read. Where rows
    come out of work that shall not be done twice, `lengths` gives the same shards and n_tokens.
    """
    totals = (rows if lengths is None else lengths).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(before, "shard").withColumn("start", F.col("own") + F.col("before")).drop("own", "before")


def with_crc(rows: DataFrame) -> DataFrame:
    """Rows of the files with `ids_crc32` (unsigned, of the ids as little-endian unsigned 32-bit integers) for ids."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([zlib.crc32(x) for x in id_bytes(batch.column(4))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], made], names=[*batch.schema.names[:4], "ids_crc32"])

    return rows.mapInArrow(check, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
