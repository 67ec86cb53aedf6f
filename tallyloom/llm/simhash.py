"""SimHash near-duplicates with pigeonring candidates.

A fingerprint has 64 bits. Cut into a ring of four 16-bit segments, two fingerprints that differ in at most 3 bits have
a segment from which every chain of l consecutive segments differs in at most l*3/4 bits (pigeonring principle): the
segment itself is equal, with the next one at most 1 bit differs, with the next two at most 2, in all at most 3. The
index follows the first two links of the chain: an equal segment and, as at most one bit of the next segment differs,
an equal half of that segment. Eight such 24-bit keys find every pair; the chain budgets prune the rest.

Only distinct fingerprints are compared, so copies never meet. A key shared by more than `crowd` fingerprints (the
largest set of pairwise links has 128, so such a key also holds pairs that don't link) is made finer: its unset bits are
cut into four runs, of which a pair with at most 3 differences shares one. That repeats until no key is crowded or no
bit is left, so candidates stay linear in the number of fingerprints and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import free_name, row_hash, settle, slices, texts
from tallyloom.llm.components import components

BITS, SEGMENTS, MAX_DIFFER, SEED = 64, 4, 3, 42
WIDTH = BITS // SEGMENTS
CROWD = 128
BLOCK = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text. Shingles are taken in blocks, so memory doesn't follow the hashes."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    starts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*starts)) if len(starts) > 1 else iter(starts[0]), repeat(SEED))
    counts, total = np.zeros(BITS, np.int64), 0
    while len(block := np.fromiter(islice(hashes, BLOCK), np.uint64)):
        counts += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add a bigint column `name` (replacing one of that name); all other columns are kept. A map, no shuffle."""
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = pa.array([fingerprint(t, shingle) for t in texts(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


def _part(segment: int, low: int = 0, width: int = WIDTH) -> int:
    return ((1 << width) - 1) << (segment % SEGMENTS * WIDTH + low)


def first_masks() -> list[tuple[int, int]]:
    """(segment where the chain starts, bits that must be equal)."""
    half = WIDTH // 2
    return [(i, _part(i) | _part(i + 1, low, half)) for i in range(SEGMENTS) for low in (0, half)]


def finer_masks(mask: int) -> list[int]:
    """The mask with one of MAX_DIFFER + 1 runs of its unset bits added."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    runs = np.array_split(np.array(free, dtype=np.int64), MAX_DIFFER + 1)
    return list(dict.fromkeys(mask | sum(1 << int(b) for b in run) for run in runs))


def _differ(a: Column, b: Column, mask: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(mask))))


def within_budgets(a: Column, b: Column, start: Column) -> Column:
    """Chains from the given segment stay within their share of the allowed differences; the last is the Hamming check."""
    passes = F.lit(False)
    for i in range(SEGMENTS):
        ok, mask = start == i, 0
        for length in range(1, SEGMENTS + 1):
            mask |= _part(i + length - 1)
            ok = ok & (_differ(a, b, mask) <= length * MAX_DIFFER // SEGMENTS)
        passes = passes | ok
    return passes


def links(fingerprints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All pairs (a < b) of distinct bigint `fingerprint`s that differ in at most 3 bits, each once."""
    spark = fingerprints.sparkSession
    masks = first_masks()
    keys = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).alias("mask")) for s, m in masks]))
    rows = fingerprints.select("fingerprint", keys.alias("k")).select("fingerprint", "k.start", "k.mask")
    found = []
    while True:
        rows = rows.withColumn("bits", F.col("fingerprint").bitwiseAND(F.col("mask")))
        key = ["start", "mask", "bits"]
        sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
        full = settle(sizes.where((F.col("n") > crowd) & (F.col("mask") != -1)), "simhash-crowded")
        crowded = not full.isEmpty()
        small = rows.join(full, key, "left_anti") if crowded else rows
        other = small.withColumnRenamed("fingerprint", "b")
        pairs = small.withColumnRenamed("fingerprint", "a").join(other, key).where("a < b")
        found.append(pairs.where(within_budgets(F.col("a"), F.col("b"), F.col("start"))).select("a", "b"))
        if not crowded:
            break
        # Masks in use: a handful, they follow the depth of the search and not the data.
        masks = full.select("start", "mask").distinct().collect()
        steps = [(s, m, _signed(f)) for s, m in masks for f in finer_masks(m & ((1 << BITS) - 1))]
        finer = spark.createDataFrame(steps, "start int, mask long, finer long")
        rows = settle(
            rows.join(full, key, "left_semi").join(finer, ["start", "mask"])
            .select("fingerprint", "start", F.col("finer").alias("mask")).distinct(),
            "simhash-finer",
        )
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.distinct()


def groups(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(fingerprint, component_id) for each distinct fingerprint of rows (doc_id, fingerprint): component_id is the
    smallest doc_id reachable through links of at most 3 differing bits, null if all of them are null.
    """
    distinct = settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = components(links(distinct, crowd), "simhash-links").withColumnRenamed("node", "fingerprint")
    named = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of docs (doc_id, text); other columns are ignored.

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat get a row each. A row with a null
    doc_id is fingerprinted and linked; it is never the smallest of a group that has ids. Empty in, empty out.
    """
    rows = settle(with_fingerprints(docs.select("doc_id", "text"), shingle).drop("text"), "simhash-rows")
    return rows.join(groups(rows, crowd), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """The rows of docs that stand for their group: the one with the smallest doc_id; of several with that doc_id, one.

    Returns docs' columns. Fingerprints are made once more beside the texts rather than carried through the search. Rows
    that share doc_id and fingerprint become one before the shuffle, so a row that repeats without end piles up nowhere;
    texts are shuffled once, to the decision about them.
    """
    chosen = settle(
        near_duplicates(docs, shingle, crowd)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_id").agg(F.min("fingerprint").alias("fingerprint_kept")),
        "simhash-chosen",
    )
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")
    chosen = chosen.select(key("component_id"), F.col("fingerprint_kept").alias("made"))
    names = docs.columns
    made = free_name(docs, "made")
    rows = with_fingerprints(docs, shingle, name=made)
    whole = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = rows.select(key("doc_id"), F.col(made).alias("made"), row_hash(rows, *names).alias("order"), whole.alias("whole"))
    one = rows.groupBy("key", "made").agg(F.min_by("whole", "order").alias("whole"))
    kept = one.join(chosen, ["key", "made"], "left_semi")
    return kept.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(names)])
