import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries, sharding
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, shard int, rank string"


def plain_shard(key, node, seed=sharding.SEED):
    while node.children:
        draws = []
        for child in node.children:
            u = (int(md5(f"{seed}/{child.name}/{key}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            draws.append((-math.log(u) / child.weight, child.name, child))
        node = min(draws)[2]
    return node.number


def check(found, docs):
    """Rows of assign() for (doc_id, text) rows."""
    tree, grown = sharding.layout(40), sharding.layout(41)
    expected = Counter()
    for doc_id, text in docs:
        key = "" if doc_id is None else doc_id
        crc = None if text is None else zlib.crc32(text.encode())
        expected[doc_id, len((text or "").encode()) + 16, crc, "key", plain_shard(key, tree), plain_shard(key, grown)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == expected
    slots = defaultdict(list)
    for r in found:
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0))
    for rows in slots.values():
        rows.sort()
        assert [slot for slot, *_ in rows] == list(range(len(rows)))
        assert [key for _, *key in rows] == sorted(key for _, *key in rows)


def test_query_against_brute_force(spark):
    docs = queries.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    check(queries.op12_sharding(spark, SF_SMALL).collect(), docs)


def test_odd_rows(spark):
    rows = [(None, None), (None, "x"), (1, ""), (1, None), (2, "Ä日" * 300_000), (-3, "a"), (2**62, "a")] + [(7, "copy")] * 500
    odd = spark.createDataFrame([(*r, 99, "clash") for r in rows], SCHEMA)
    check(sharding.assign(odd.repartition(7)).collect(), rows)
    assert sharding.assign(odd.limit(0)).count() == 0


def shards(spark, tree, n=40_000):
    made = spark.range(n).select(sharding.shard_of(F.col("id"), tree).alias("s")).collect()
    return [r.s for r in made]


def test_shares_follow_weights(spark):
    tree = sharding.layout(6, planned=6, regions=2, racks=2)
    tree = sharding.reweighted(tree, 4, 3.0)
    counts = Counter(shards(spark, tree))
    for shard in tree.shards():
        assert abs(counts[shard.number] / 40_000 - shard.own_weight / 8) < 0.01


def test_one_more_shard_takes_rows_into_itself_alone(spark):
    for count in (1, 3, 40, 41, 47):
        planned = min(count, 40)
        before, after = shards(spark, sharding.layout(count, planned)), shards(spark, sharding.layout(count + 1, planned))
        moved = [(a, b) for a, b in zip(before, after) if a != b]
        assert {b for _, b in moved} == {count}
        assert abs(len(moved) / 40_000 - 1 / (count + 1)) < 0.01


def test_a_changed_weight_moves_rows_of_its_own_subtrees_alone(spark):
    tree = sharding.layout(40)
    changed = sharding.reweighted(tree, 7, 4.0)
    region = next(c for c in tree.children if 7 in [s.number for s in c.shards()])
    rack = next(c for c in region.children if 7 in [s.number for s in c.shards()])
    in_region, in_rack = ({s.number for s in n.shards()} for n in (region, rack))
    moved = [(a, b) for a, b in zip(shards(spark, tree), shards(spark, changed)) if a != b]
    assert moved
    for a, b in moved:  # into the heavier region, within it into the heavier rack, within that into the heavier shard
        assert b in in_region
        assert a not in in_region or b in in_rack
        assert a not in in_rack or b == 7
    gone = sharding.reweighted(tree, 7, 0)
    assert {a for a, b in zip(shards(spark, tree), shards(spark, gone)) if a != b} >= {7}
    assert 7 not in shards(spark, gone)


def test_no_shards_is_an_error():
    with pytest.raises(ValueError):
        sharding.layout(0)


def test_shards_are_written(spark, tmp_path):
    docs = queries.table(spark, SF_SMALL, "documents")
    path = sharding.write_shards(docs, str(tmp_path / "out"), rows=3)
    back = spark.read.schema("doc_id long, text string, lang string, source string, n_chars long, shard int").parquet(path)
    assert sorted(back.drop("shard").collect()) == sorted(docs.collect())
    tree = sharding.layout(40)
    assert all(r.shard == plain_shard(r.doc_id, tree) for r in back.select("doc_id", "shard").collect())
