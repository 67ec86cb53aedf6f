"""A Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and a proof for every row.

A row's rank in its group, written in digits to the base of the fan, is its path to the group's root. Digits are grouped
away one after another, the lowest first: rows that agree in all higher digits become one row, whose hash is taken over
its children and which holds them as an array of structs, themselves holding theirs. A block of DIGITS digits is put
together in one task after one shuffle, so a row never nests more than fan ** DIGITS leaves. Blocks' hashes alone go to
the next round, until a group is one block; the groups' hashes are the leaves of one more such tree.

Proofs come back down the same rows: a transform gives each child the hashes beside it, an explode passes them on to its
own children. A round hands its proofs to the blocks below by stacking both and grouping by the block, so no join is
needed and nothing is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ranked, settle

FAN, DIGITS = 16, 3
PATH = "array<struct<before: string, after: string>>"


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values, each with its length in front; null is a dash, numbers are decimals."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lowered(text: Column) -> Column:
    """A text with A to Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _depth(total: Column, fan: int) -> Column:
    """Levels of a tree of that many leaves: none for one leaf."""
    levels, size = F.lit(0), 1
    while size < 1 << 62:
        levels, size = levels + (total > size).cast("int"), size * fan
    return levels


def _rolled(nodes: DataFrame, above: int, fan: int, digits: int) -> DataFrame:
    """(grp, block, depth, hash, below) from nodes (grp, rank, depth, hash, below): `digits` levels, the first being number
    `above`, grouped away. Levels at or beyond a group's depth hand their only child's hash on.
    """
    places = [F.expr(f"rank div {fan**i}l % {fan}").alias(f"d{i}") for i in range(digits)]
    rows = nodes.select("grp", F.expr(f"rank div {fan**digits}l").alias("block"), "depth", *places, "hash", "below")
    rows = rows.repartition("grp", "block")
    for i in range(digits):
        keys = ["grp", "block", "depth", *[f"d{j}" for j in range(digits - 1, i, -1)]]
        children = F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("at"), "hash", "below")))
        rows = rows.groupBy(*keys).agg(children.alias("below"))
        made = F.when(F.col("depth") > above + i, F.sha2(F.array_join("below.hash", ""), 256)).otherwise(F.col("below.hash")[0])
        rows = rows.withColumn("hash", made)
    return rows


def _rounds(nodes: DataFrame, fan: int, digits: int, label: str) -> list[DataFrame]:
    """Settled blocks by round, until every group is one block. The driver learns whether another round is needed."""
    rounds = []
    while True:
        rounds.append(settle(_rolled(nodes, len(rounds) * digits, fan, digits), label))
        more = rounds[-1].where(F.col("depth") > len(rounds) * digits)
        if more.isEmpty():
            return rounds
        nodes = more.select("grp", F.col("block").alias("rank"), "depth", "hash", F.struct(F.col("block").alias("rank")).alias("below"))


def _ends(blocks: DataFrame, at: int, digits: int) -> DataFrame:
    """Of the blocks of round `at`, or of groups' rows, those of groups that end there."""
    lowest = F.lit(at == 0) | (F.col("depth") > at * digits)
    return blocks.where(lowest & (F.col("depth") <= (at + 1) * digits))


def _tops(rounds: list[DataFrame], digits: int) -> DataFrame:
    """(grp, depth, hash): the root of each group."""
    parts = [_ends(blocks, at, digits).select("grp", "depth", "hash") for at, blocks in enumerate(rounds)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _descended(rounds: list[DataFrame], tops: DataFrame, digits: int, label: str) -> DataFrame:
    """(grp, top, path, below): every leaf's proof, its own level first, from tops (grp, depth, top, path), where `path` is
    what follows a group's root and `top` is handed down.
    """
    handed = None
    for at in reversed(range(len(rounds))):
        given = _ends(tops, at, digits).select("grp", F.lit(0).cast("long").alias("block"), "top", "path")
        given = given.unionByName(handed) if handed is not None else given
        blocks = rounds[at].select("grp", "block", "depth", "below")
        stacked = blocks.unionByName(given, allowMissingColumns=True).groupBy("grp", "block")
        rows = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("depth", "below", "top", "path")])
        for i in reversed(range(digits)):

            def beside(child: Column, place: Column) -> Column:
                hashes = F.col("below.hash")
                before = F.array_join(F.slice(hashes, F.lit(1), place), "")
                after = F.array_join(F.slice(hashes, place + 2, F.size(hashes)), "")
                return F.struct(before.alias("before"), after.alias("after"), child["below"].alias("below"))

            rows = rows.select("grp", "depth", "top", "path", F.explode(F.transform("below", beside)).alias("c"))
            step = F.array(F.struct("c.before", "c.after"))
            path = F.when(F.col("depth") > at * digits + i, F.concat(step, "path")).otherwise(F.col("path"))
            rows = rows.select("grp", "depth", "top", path.alias("path"), F.col("c.below").alias("below"))
        if at:
            handed = settle(rows.select("grp", F.col("below.rank").alias("block"), "top", "path"), label)
    return rows.select("grp", "top", "path", "below")


def proofs(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """leaves and `subroot` (the hash of the row's group), `root` (of all groups) and `path`: for every level of the two
    trees, lowest first, the hashes before and after the row's own, joined.

    leaves holds a digest in `leaf`; rows of a group are in the order of `order`, ties in that of their digests. A group
    of one row has no level of its own: its digest is the subroot. A null group is a group and comes first, a null order
    comes first. Columns of the added names are replaced. Columns of types without an order aren't possible. Empty in,
    empty out.
    """
    leaves = leaves.drop("subroot", "root", "path")
    own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(leaves.columns)]).alias("below")
    plain = leaves.select(F.col(group).alias("grp"), F.col(order).alias("place"), F.col(leaf).alias("hash"), own)
    depth = _depth(F.col("total"), fan).alias("depth")
    nodes = ranked(plain, "grp", ["place", "hash"], "merkle-ranked").select("grp", "rank", depth, "hash", "below")
    rounds = _rounds(nodes, fan, digits, "merkle-blocks")
    tops = settle(_tops(rounds, digits), "merkle-groups")
    # The same tree once more, over the groups as one group's leaves.
    kept = F.struct(F.col("grp").alias("name"), "depth", "hash").alias("below")
    over = ranked(tops.select(F.lit(0).alias("all"), "grp", "depth", "hash"), "all", ["grp"], "merkle-ranked")
    over = over.select(F.col("all").alias("grp"), "rank", depth, "hash", kept)
    upper = _rounds(over, fan, digits, "merkle-top")
    root = _tops(upper, digits).select("grp", "depth", F.col("hash").alias("top"), F.array().cast(PATH).alias("path"))
    by_group = _descended(upper, root, digits, "merkle-paths").select(
        F.col("below.name").alias("grp"), F.col("below.depth").alias("depth"),
        F.struct(F.col("below.hash").alias("subroot"), F.col("top").alias("root")).alias("top"), "path",
    )
    rows = _descended(rounds, settle(by_group, "merkle-paths"), digits, "merkle-paths")
    names = [F.col(f"below.c{i}").alias(c) for i, c in enumerate(leaves.columns)]
    return rows.select(*names, "top.subroot", "top.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest over all hashes of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)
