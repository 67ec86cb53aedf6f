"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash rotates a unit vector pseudo-randomly (three rounds of random signs and a Walsh-Hadamard transform) and names the
nearest of the 2d signed axes. A table joins some of them into a bucket; a vector lies in its own bucket of each table
and in the PROBES likeliest next ones. Vectors that meet in a bucket, one of them in its own, are compared exactly. There
are as many hashes to a table as keep buckets small at the number of vectors, and as many tables as those hashes need to
miss a pair at the threshold with a probability of MISS at most, measured on random pairs of that length.

Copies are one class and hashed once. Names of buckets are counted first, without vectors; only classes that meet another
one there are brought together with theirs. Buckets with more than BLOCK members are cut into blocks by hash, and every pair
of blocks is a group of its own, so no bucket lands in one task and all its pairs are compared. A pair that meets in
several buckets counts in the first only. Groups return sums of links and a spanning forest of theirs, not pairs: what
is written follows the number of vectors, however dense they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import settle, slices
from tallyloom.llm.components import components

THRESHOLD = 0.93
PROBES, MISS = 3, 1e-4
BLOCK, TILE, SEED, RADIX = 1024, 256, 97, 64
NEXT = 3  # how many nearest axes of a hash are combined into probes


@lru_cache(8)
def _matrix(size: int) -> np.ndarray:
    """The Hadamard matrix of that size."""
    made = np.ones((1, 1))
    while len(made) < size:
        made = np.block([[made, made], [made, -made]])
    return made


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, scaled to keep lengths: up to six levels a step, as a product with a small matrix."""
    n, d = x.shape
    width = 1
    while width < d:
        step = min(RADIX, d // width)
        x = np.matmul(_matrix(step), x.reshape(n, d // (step * width), step, width)).reshape(n, d)
        width *= step
    return x / np.sqrt(d)


def buckets(vectors: np.ndarray, tables: int, hashes: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """By row, table and place: the own bucket first, then the probed ones, likeliest first. -1: fewer combinations."""
    n, given = vectors.shape
    d = _padded(given)
    unit = np.zeros((n, d))
    unit[:, :given] = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    random = np.random.default_rng(seed)
    combos = np.array(np.meshgrid(*[range(NEXT)] * hashes)).reshape(hashes, -1).T
    result = np.full((n, tables, 1 + probes), -1, np.int64)
    for table in range(tables):
        axes, lost = [], []
        for _ in range(hashes):
            y = unit
            for _ in range(3):
                y = _hadamard(y * random.choice([-1.0, 1.0], d))
            nearest = np.sort(np.argpartition(-np.abs(y), NEXT - 1, axis=1)[:, :NEXT], axis=1)
            nearest = np.take_along_axis(nearest, np.argsort(-np.abs(np.take_along_axis(y, nearest, 1)), axis=1, kind="stable"), 1)
            size = np.take_along_axis(y, nearest, 1)
            axes.append(2 * nearest + (size < 0))
            lost.append((np.abs(size[:, :1]) - np.abs(size)) ** 2)
        cost = sum(lost[h][:, combos[:, h]] for h in range(hashes))
        best = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        bucket = np.zeros((n, best.shape[1]), np.int64)
        for h in range(hashes):
            bucket = bucket * (2 * d) + np.take_along_axis(axes[h], combos[best, h], 1)
        result[:, table, : bucket.shape[1]] = bucket
    return result


@lru_cache(64)
def tables_needed(dims: int, hashes: int, threshold: float = THRESHOLD, probes: int = PROBES, miss: float = MISS) -> int:
    """Tables with which random vectors at a cosine of the threshold meet nowhere with a probability of `miss` at most."""
    draw, pairs, tables = np.random.default_rng(SEED), min(1000, max(100, 25_600 // dims)), 4
    a, other = draw.normal(size=(2, pairs, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other -= (other * a).sum(1)[:, None] * a
    other /= np.linalg.norm(other, axis=1)[:, None]
    x = buckets(a, tables, hashes, probes)
    y = buckets(threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * other, tables, hashes, probes)
    apart = 1 - ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(2).mean()
    return max(2, int(np.ceil(np.log(miss) / np.log(min(max(apart, 1e-3), 0.999)))))


def plan(vectors: int, dims: int, threshold: float = THRESHOLD, probes: int = PROBES) -> tuple[int, int]:
    """Tables and hashes for that many distinct vectors of a label: a table has at least as many buckets as unlike vectors
    meet one by chance, own or probed on either side. So chance meetings stay below one a vector and table, at any number.
    """
    hashes = max(2, int(np.ceil(np.log(max(2, vectors * (1 + 2 * probes))) / np.log(2 * dims) - 1e-9)))
    return tables_needed(dims, hashes, threshold, probes), hashes


def classes_of(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding, label) with `class` (text) and `vector` (its doubles as bytes): equal in label and vector,
    equal class. Both are null where nothing may link: no label or vector, or one that is zero, holds null or a component
    that is not finite. 0.0 and -0.0 are the same component.
    """
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, vectors = [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2)):
                ok = label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count
                x = vector.values.to_numpy(zero_copy_only=False) + 0.0 if ok else np.zeros(1)
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt((x * x).sum())
                ok = ok and np.isfinite(norm) and norm > 0
                vectors.append(x.tobytes() if ok else None)
                names.append(blake2b(x.tobytes() + label.encode(), digest_size=16).hexdigest() if ok else None)
            made = [pa.array(names, pa.string()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["vec_id", "label", "class", "vector"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label string, class string, vector binary")


KEYS = ["label", "dims", "hashed", "bucket", "block", "other"]
PLACES = "label string, class string, copies long, vector binary, dims int, keys array<long>"


def _padded(dims: int) -> int:
    return max(4, 1 << (dims - 1).bit_length())


def _hashed(classes: DataFrame, plans: dict[int, tuple[int, int]], probes: int) -> DataFrame:
    """Classes with their length and the buckets of all tables, 1 + probes to a table; `plans` go by padded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            vectors = batch.column(3).to_pylist()
            sizes = np.array([len(v) // 8 for v in vectors], int)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                found = buckets(np.array([np.frombuffer(vectors[i]) for i in at]), *plans[_padded(int(dims))], probes)
                keys = pa.array(list(found.reshape(len(at), -1)), pa.list_(pa.int64()))
                own = [c.take(pa.array(at)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), dims, np.int32)), keys], names=[*batch.schema.names, "dims", "keys"])

    return classes.select("label", "class", "copies", "vector").mapInArrow(run, PLACES)


def _first_meeting(keys: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether pairs of rows meet here first: in no earlier table, and in this one not in a smaller bucket too."""
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        own_i, own_j = keys[i, t, 0], keys[j, t, 0]
        at_i, at_j = (keys[j, t] == own_i[:, None]).any(1), (keys[i, t] == own_j[:, None]).any(1)
        if t < table:
            first &= ~(at_i | at_j)
        else:
            first &= bucket == np.where(at_i & at_j, np.minimum(own_i, own_j), np.where(at_i, own_i, own_j))
    return first


def _group_links(vectors: np.ndarray, probe: np.ndarray, side: np.ndarray, cross: bool, keys: np.ndarray, copies: np.ndarray,
                 table: int, bucket: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a group: copies linked to each, and for each the first row of its part of the links found here."""
    n = len(vectors)
    norms = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / norms[:, None]
    linked, root = np.zeros(n, np.int64), np.arange(n)
    pairs = []
    for first in range(0, n, TILE):
        near = unit[first : first + TILE] @ unit.T >= threshold - 1e-9
        i, j = np.nonzero(near)
        i += first
        use = (i < j) & ~(probe[i] & probe[j])
        if cross:
            use &= side[i] != side[j]
        i, j = i[use], j[use]
        exact = (vectors[i] * vectors[j]).sum(1) / (norms[i] * norms[j]) >= threshold
        i, j = i[exact], j[exact]
        new = _first_meeting(keys, i, j, table, bucket)
        i, j = i[new], j[new]
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        pairs.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return linked, root


def _links(index: DataFrame, threshold: float) -> DataFrame:
    """(class, root, linked) from index rows dealt into groups by KEYS."""

    def group(rows: pa.Table) -> pa.RecordBatch | None:
        probe = rows["probe"].to_numpy()
        if probe.all():
            return None
        vectors = np.frombuffer(b"".join(rows["vector"].to_pylist())).reshape(len(rows), -1)
        keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1, rows["places"][0].as_py())
        table, bucket = rows["hashed"][0].as_py(), rows["bucket"][0].as_py()
        cross = rows["block"][0].as_py() != rows["other"][0].as_py()
        linked, root = _group_links(
            vectors, probe, rows["side"].to_numpy(), cross, keys, rows["copies"].to_numpy(), table, bucket, threshold
        )
        used = np.flatnonzero(linked)
        names = rows["class"].take(pa.array(used))
        return pa.RecordBatch.from_arrays(
            [names.combine_chunks(), rows["class"].take(pa.array(root[used])).combine_chunks(), pa.array(linked[used])],
            names=["class", "root", "linked"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # rows of a group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            cuts = np.zeros(len(rows) - 1, bool)
            for key in KEYS:
                column = rows[key].combine_chunks()
                cuts |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(cuts) + 1])
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1 and (made := group(rows.slice(a, b - a))) is not None and made.num_rows:
                    yield made
            rest = rows.slice(starts[-1])
        if rest is not None and len(rest) > 1 and (made := group(rest)) is not None and made.num_rows:
            yield made

    return index.mapInArrow(run, "class string, root string, linked long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, hashes: int | None = None,
                    probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `rows` (vec_id, embedding, label; others are ignored).

    n_links: other rows whose vector has the same label and length and a cosine of at least `threshold`, copies included.
    component_id: the smallest vec_id reachable by links. Rows that can't link (see classes_of) have no links and their own
    id. Links are searched by hashing: a pair at the threshold is missed with a probability of about MISS, nearer ones far
    less; pairs below it are never linked. `tables` and `hashes` follow from the number of vectors unless given. The driver
    learns that number by padded length. Empty in, empty out.
    """
    rows = settle(classes_of(rows), "vectors-rows")
    valid = rows.where("class is not null").groupBy("class")
    classes = settle(
        valid.agg(F.first("label").alias("label"), F.count("*").alias("copies"), F.min("vec_id").alias("smallest"),
                  F.first("vector").alias("vector")), "vectors-classes",
    )
    size = F.octet_length("vector") / 8
    counted = classes.groupBy("label", F.greatest(F.lit(2), F.length(F.bin(size.cast("long") - 1))).alias("bits")).count()
    most = counted.groupBy("bits").agg(F.max("count").alias("n")).collect()
    plans = {1 << r.bits: plan(r.n, 1 << r.bits, threshold, probes) for r in most} if not (tables and hashes) else {1 << r.bits: (tables, hashes) for r in most}
    hashed = settle(_hashed(classes, plans, probes), "vectors-hashed")
    own = ["label", "dims", "hashed", "bucket"]
    places = hashed.select("class", "label", "dims", F.posexplode("keys").alias("pos", "bucket")).where("bucket >= 0")
    places = places.select("class", *own[:2], F.expr(f"int(pos div {1 + probes})").alias("hashed"), "bucket", (F.col("pos") % (1 + probes) > 0).alias("probe"))
    sizes = places.groupBy(own).agg(F.count("*").alias("members"), F.min("probe").alias("only_probed"))
    met = settle(sizes.where("members > 1 and not only_probed").drop("only_probed"), "vectors-met")
    index = places.join(met, own)
    parts = F.ceil(F.col("members") / block).cast("int")
    index = index.withColumn("side", F.pmod(F.xxhash64(F.lit(SEED), "class"), parts).cast("int"))
    index = index.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    index = index.select(
        *own, F.least("side", "with").alias("block"), F.greatest("side", "with").alias("other"), "side", "probe", "class",
        F.lit(1 + probes).alias("places"),
    )
    index = index.join(hashed.select("class", "copies", "vector", "keys"), "class")
    found = settle(_links(index.repartition(*KEYS).sortWithinPartitions(*KEYS), threshold), "vectors-links")
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), "vectors-components")
    linked = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    named = classes.select("class", "copies", "smallest").join(linked, "class", "left")
    named = named.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component"))
    named = named.join(smallest, "root").select(
        "class", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "component"
    )
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.select("vec_id", "class").join(named, "class", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
