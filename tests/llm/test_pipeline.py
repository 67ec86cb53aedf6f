import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from tallyloom.llm import bpe, mixing, pii, quality, queries, simhash
from tallyloom.llm.common import settle
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output."""
    docs, found = queries.table(spark, SF_SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = settle(stage(spark, docs, SF_SMALL), f"test-{name}")
        found[name] = (docs, made)
        docs = made
    return found


def test_stages_keep_the_columns_of_documents(stages):
    for docs, made in list(stages.values())[:-1]:
        assert docs.columns == made.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_documents(spark, stages):
    labels = queries.table(spark, SF_SMALL, "labels")
    _, kept = stages["quality"]
    rated = labels.join(kept.select("doc_id"), "doc_id").toPandas()
    assert (rated.quality == 1).mean() > 0.97
    assert len(rated) > 0.97 * labels.where("quality = 1").count()


def test_near_dedup_against_brute_force(stages):
    docs, kept = stages["near_dedup"]
    rows = sorted(docs.collect())
    prints = [simhash.fingerprint((r.text or "").encode(), 3) & (2**64 - 1) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j in range(i):
                if (a ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    assert sorted(kept.collect()) == [r for i, r in enumerate(rows) if group[i] == i]


def test_pii_leaves_no_entity(stages):
    docs, made = stages["pii"]

    def entities(df):  # long numbers without a valid check digit are none
        found = df.select(F.explode(pii.matches(df.text)).alias("m"))
        return {r.m for r in found.where(pii.kind_of(found.m).isNotNull()).collect()}

    before, after = entities(docs), entities(made)
    assert before and not before & after and len(after) == len(before)
    assert docs.count() == made.count()


def test_mixing_takes_near_targets(stages):
    docs, made = stages["mixing"]
    taken = Counter()
    for r in made.collect():
        taken[r.source] += len((r.text or "").split())
    sized = docs.select("source", mixing.word_count(docs.text).alias("size"))
    longest = max(r["size"] for r in sized.collect())
    for r in mixing.source_targets(sized).collect():
        assert abs(taken[r.source] - r.target) <= longest


def test_last_stage_has_tokens(stages):
    docs, made = stages["bpe"]
    assert docs.count() == made.count()
    assert all(bool(r.ids) == bool((r.decoded or "").strip()) for r in made.collect())


def test_empty_and_odd_documents_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(None, None, None, None, None, None), (1, "", "en", "a", 0, "x"), (2, "word " * 400_000, "en", None, 9, "x")]
    rows += [(3, "The same good text of some words. " * 3, "en", "a", 9, "x")] * 2
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, SF_SMALL), "test-odd")
        docs.collect()


def test_a_worker_drops_one_stages_tables_before_it_fills_anothers(spark, monkeypatch):
    docs = queries.table(spark, SF_SMALL, "documents")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: run)
    rate = quality.rate(docs, quality.Model(np.zeros(quality.DIMS + 1), np.zeros(2)))
    text = bpe.read_vocabulary(queries.TOKENIZER)
    assert bpe._encoder(text) is bpe._encoder(text)
    assert list(rate(iter([]))) == []
    assert [kept.cache_info().currsize for kept in (bpe.vocabulary, bpe._encoder, bpe._tokens)] == [0, 0, 0]


def test_a_vocabulary_is_held_once():
    text = bpe.read_vocabulary(queries.TOKENIZER)
    tracemalloc.start()
    vocabulary = bpe.Vocabulary(text)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 40 << 20
    assert vocabulary.library.get_vocab_size() == 0


def test_queries_are_registered():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLE_SQL) <= set(entry_point.oracle_sql())
