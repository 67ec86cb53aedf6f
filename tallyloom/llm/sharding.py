"""Shards by a weighted hash tree of regions, racks and shards.

A row descends from the root: at every level each child draws a number from a hash of its own name and the row's key,
-ln(u) / weight, and the smallest wins. So a child gets its share by weight, and a change of weights moves rows only where
it has to: between a child whose weight changed and its siblings, and, level by level, inside what changed. Rows of a
subtree of which no weight changed, neither in it nor beside it, stay.

A shard that joins a laid-out tree becomes a region of its own, with one rack. Its draw is the only new one at the only
level with a new draw, so it takes rows into itself and none move between the others (law `key`).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import free_name, new_folder, ranked

SHARDS, SEED, LAW = 40, "shards", "key"
REGIONS, RACKS = 4, 2  # of the planned layout
OVERHEAD = 16  # bytes of a row beside its text
BLOCK_ROWS = 1 << 17


@dataclass(frozen=True)
class Node:
    """A region or rack (with children), or a shard (with its number). The weight of a node with children is their sum."""

    name: str
    children: tuple[Node, ...] = ()
    number: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[Node]:
        return [s for c in self.children for s in c.shards()] if self.children else [self]

    def literal(self) -> Column:
        below = F.array(*[c.literal() for c in self.children]) if self.children else F.lit(self.number)
        return F.struct(F.lit(self.name).alias("name"), F.lit(float(self.weight)).alias("weight"), below.alias("below"))


def shard_node(number: int, weight: float = 1.0) -> Node:
    return Node(f"shard-{number}", (), number, weight)


def joined(tree: Node, number: int, weight: float = 1.0) -> Node:
    """The tree after a shard joined as a region of its own."""
    rack = Node(f"rack-of-{number}", (shard_node(number, weight),))
    return replace(tree, children=(*tree.children, Node(f"region-of-{number}", (rack,))))


def reweighted(tree: Node, number: int, weight: float) -> Node:
    """The tree after a shard's weight changed; 0 or less takes it away, and with it racks and regions left empty."""
    if not tree.children:
        return replace(tree, own_weight=weight) if tree.number == number else tree
    children = (reweighted(c, number, weight) for c in tree.children)
    return replace(tree, children=tuple(c for c in children if c.children or c.number >= 0 and c.own_weight > 0))


def layout(shards: int, planned: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> Node:
    """The tree of a number of shards: the planned ones dealt evenly over regions and racks, later ones joined one by one.
    It depends on these numbers alone.
    """
    if shards < 1 or planned < 1:
        raise ValueError("at least one shard is needed")
    first = min(shards, planned)
    racks_of: dict[int, dict[int, list[Node]]] = {}
    for i in range(first):
        region, rack = i * regions // planned, i * regions * racks // planned
        racks_of.setdefault(region, {}).setdefault(rack, []).append(shard_node(i))
    tree = Node(
        "root",
        tuple(
            Node(f"region-{region}", tuple(Node(f"rack-{rack}", tuple(nodes)) for rack, nodes in in_region.items()))
            for region, in_region in racks_of.items()
        ),
    )
    for number in range(first, shards):
        tree = joined(tree, number)
    return tree


def _won(children: Column, key: Column, seed: str) -> Column:
    """What lies below the child that wins the draw."""

    def drawn(child: Column) -> Column:
        digest = F.md5(F.concat_ws("/", F.lit(seed), child["name"], key))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["name"].alias("name"), child["below"].alias("below"))

    return F.array_min(F.transform(children, drawn))["below"]


def shard_of(key: Column, tree: Node, seed: str = SEED) -> Column:
    """The number of the shard (int) that a key belongs to; a null key is an empty one. Native, without a shuffle."""
    below, level = F.array(*[c.literal() for c in tree.children]), tree
    text = F.coalesce(key.cast("string"), F.lit(""))
    while level.children:
        below, level = _won(below, text, seed), level.children[0]
    return below.cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, planned: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs (doc_id, text).

    size is the text's UTF-8 bytes and OVERHEAD; a null text has none, and a null crc. doc_id and the number of shards
    decide the shard, so rows of one doc_id, null included, share it. slot numbers a shard's rows from 0 by doc_id, size and
    crc. grown_shard is the shard if one more had joined. Repeated rows get a slot each. Other columns are ignored. Empty
    in, empty out. Texts are read once and not shuffled.
    """
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        shard_of(key, layout(shards, planned), seed).alias("shard"),
        shard_of(key, layout(shards + 1, planned), seed).alias("grown_shard"),
    )
    placed = ranked(rows, "shard", ["doc_id", "size", "text_crc32"], "shards")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str | None = None, tree: Node | None = None, seed: str = SEED, rows: int = BLOCK_ROWS) -> str:
    """Write docs, all columns, into a folder per shard (shard=0, ...) and return the path.

    A shard's rows come from as many tasks as it holds blocks of about `rows` rows, so a heavy shard is not one task. A
    column called `shard` is replaced.
    """
    tree = tree or layout(SHARDS)
    path = path or new_folder(docs.sparkSession, "shards")
    block = free_name(docs, "_block")
    docs = docs.withColumn("shard", shard_of(F.col("doc_id"), tree, seed))
    blocks = max(1, -(-docs.count() // (rows * len(tree.shards()))))
    salted = docs.withColumn(block, F.pmod(F.xxhash64(*docs.drop("text").columns, F.monotonically_increasing_id()), F.lit(blocks)))
    salted.repartition("shard", block).drop(block).write.partitionBy("shard").parquet(path)
    return path
