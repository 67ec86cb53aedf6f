"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of a source shall be taken target / source_size times: a whole number and a fraction. Fractions become 0 or 1
in pairs: two documents move word mass between them, in a random direction whose expectation is zero, until one of the
two is whole; the other stays open and meets the next. What a pair takes in all never changes, so a source misses its
target by less than the one document that is left at its end is long.

Pairs are dealt out as a reduction tree. A source's documents are spread over blocks of about BLOCK documents, each
block folds to one open document, and BLOCK blocks make a block of the next level. A source of any size is thus many
small groups, and a source's levels are few: two for 16,000 documents, five for 30 billion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import row_hash, settle, word_count

WEIGHTS, CEILING, BLOCK, SEED = (5, 2, 1), 3, 128, 20_240_601


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, n_docs, source_size, target) from rows (source, size). Sources in code point order, null last, weigh
    `weights`, repeating, and share the sum of all sizes; a target is at most `ceiling` times its source's size and the
    excess is shared again by weight. A row per source: the windows below sort sources, not documents.
    """
    each = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    at = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    ranked = each.withColumn("weight", F.get(F.array(*map(F.lit, weights)), at).cast("double"))
    # A common level gives level * weight words; a source is full from level `full` on. Full ones come first.
    full = F.lit(ceiling) * F.col("source_size") / F.col("weight")
    order = W.orderBy("full", F.asc_nulls_last("source"))
    all_sources = W.partitionBy()
    ranked = ranked.withColumn("full", full).withColumn("most", F.lit(ceiling) * F.col("source_size"))
    ahead = F.sum("most").over(order) - F.col("most")
    remaining = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(all_sources) - ahead) / remaining)
    # From the first source that the level does not fill, later levels only fall.
    common = F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(all_sources)
    target = F.least(F.col("most").cast("double"), F.coalesce(common, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "n_docs", "source_size", target.alias("target"))


def _uniform(*parts: Column | int) -> Column:
    """In [0, 1), the same whenever the parts are."""
    values = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*values), 11) / F.lit(float(1 << 53))


ITEM = "struct<size: bigint, hash: string, occurrence: int, p: double>"


def _fold(items: Column, level: int, seed: int) -> Column:
    """One pass of pairs over an array of items: what became whole (p 0 or 1), and the one left open."""
    none = F.lit(None).cast(ITEM)

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["hash"].alias("hash"), x["occurrence"].alias("occurrence"), p.alias("p"))

    def meet(state: Column, x: Column) -> Column:
        a = state["open"]
        gives, takes = x["size"] * x["p"], x["size"] * (1 - x["p"])
        lacks, has = a["size"] * (1 - a["p"]), a["size"] * a["p"]
        up, down = F.least(lacks, gives), F.least(has, takes)  # most mass that may go to a, and from a
        to_a = _uniform(seed, level, a["hash"], x["hash"], a["occurrence"], x["occurrence"]) * (up + down) < down
        one, zero = F.lit(1.0), F.lit(0.0)
        end = lambda whole, whole_p, left, left_p: F.struct(
            item(left, left_p).alias("open"), F.array_append(state["done"], item(whole, whole_p)).alias("done")
        )
        return (
            F.when(a.isNull(), F.struct(x.alias("open"), state["done"].alias("done")))
            .when(to_a & (lacks <= gives), end(a, one, x, x["p"] - lacks / x["size"]))
            .when(to_a, end(x, zero, a, a["p"] + gives / a["size"]))
            .when(has <= takes, end(a, zero, x, x["p"] + has / x["size"]))
            .otherwise(end(x, one, a, a["p"] - takes / a["size"]))
        )

    start = F.struct(none.alias("open"), F.array().cast(f"array<{ITEM}>").alias("done"))
    return F.aggregate(items, start, meet)


def round_fractions(items: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(source, size, hash, occurrence, up): each item of positive size once, `up` drawn with probability p.

    items: source, n_docs, size, hash, occurrence, p in (0, 1). The sum of size * p of a source is kept up to part of one item.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block))
    level_items = items.select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed), "hash", "occurrence"), blocks).alias("block"),
        blocks.alias("blocks"),
        F.struct("size", "hash", "occurrence", "p").alias("item"),
    )
    parts, level = [], 0
    while True:
        # Long documents first: what follows them is finer, so that less is left open.
        array = F.reverse(F.sort_array(F.collect_list("item")))
        folded = level_items.groupBy("source", "block").agg(F.max("blocks").alias("blocks"), array.alias("items"))
        folded = settle(
            folded.select("source", "block", "blocks", _fold(F.col("items"), level, seed).alias("f")), "mixing-level"
        )
        parts.append(folded.select("source", F.explode("f.done").alias("item")))
        opened = folded.where("f.open is not null")
        parts.append(opened.where("blocks = 1").select("source", _settled(F.col("f.open"), seed).alias("item")))
        above = opened.where("blocks > 1")
        if above.isEmpty():
            break
        level_items = above.select(
            "source", F.floor(F.col("block") / block).alias("block"), F.ceil(F.col("blocks") / block).alias("blocks"),
            F.col("f.open").alias("item"),
        )
        level += 1
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("source", "item.size", "item.hash", "item.occurrence", (F.col("item.p") > 0.5).alias("up"))


def _settled(item: Column, seed: int) -> Column:
    """A source's last open item, drawn by what is left of its fraction."""
    return item.withField("p", (_uniform(seed, -1, item["hash"], item["occurrence"]) < item["p"]).cast("double"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """How often each row is taken: (source, size, hash, occurrence, source_size, target, copies), one row per row.

    rows: source, size (long, at least 0), hash (text that names the row). Rows that share a hash are told apart by their
    occurrence, 1 and up, so repeats are dealt with one by one and reruns agree. Rows of size 0 take no mass; they are drawn
    one by one. Sources may be null; a source without words has target 0. Empty in, empty out.
    """
    rows = settle(rows.select("source", "size", "hash"), "mixing-rows")
    sources = settle(source_targets(rows, weights, ceiling), "mixing-sources")
    counted = rows.groupBy("source", "size", "hash").agg(F.count("*").cast("int").alias("repeats"))
    each = counted.select("source", "size", "hash", F.explode(F.sequence(F.lit(1), "repeats")).alias("occurrence"))
    share = sources.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    share = share.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    share = share.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    open_items = each.where("size > 0").join(share.where("p > 0").select("of", "n_docs", "p"), same).drop("of")
    up = round_fractions(open_items, seed, block)
    # Whole shares and rows without words need no rounding of mass.
    rest = each.join(share.select("of", "p"), same).where("size = 0 or p = 0")
    rest = rest.select("source", "size", "hash", "occurrence", (_uniform(seed, F.col("hash"), F.col("occurrence")) < F.col("p")).alias("up"))
    result = up.unionByName(rest).join(share, same)
    copies = F.col("whole") + F.col("up").cast("long")
    return result.select("source", "size", "hash", "occurrence", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it; columns source and text are needed, all are kept.

    The size of a row is its number of words (null text: 0). Rows equal in every column are taken as often as all of them
    together; they become one before the shuffle, so a row that repeats without end piles up nowhere. Texts are shuffled
    once, to the decision about them.
    """
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], row_hash(docs, *names).alias("hash"))
    source, text = f"_{names.index('source')}", f"_{names.index('text')}"
    taken = mix(rows.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), "hash"), **options)
    taken = taken.groupBy("hash").agg(F.sum("copies").alias("copies")).where("copies > 0")
    one = rows.groupBy("hash").agg(F.first(F.struct(*[f"_{i}" for i in range(len(names))])).alias("whole"))
    taken_rows = one.join(taken, "hash")
    repeated = taken_rows.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(*[F.col(f"whole._{i}").alias(c) for i, c in enumerate(names)])
