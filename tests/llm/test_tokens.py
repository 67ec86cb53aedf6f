import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import bpe, queries, token_files
from tests.conftest import SF_SMALL

LIBRARY = Tokenizer.from_file(queries.TOKENIZER)
ROWS = [(3, "The  quick brown FOX's 1984 déjà-vu"), (1, None), (2, ""), (2, " \n\t"), (None, "no id"), (2, "the the"), (2, "the the")]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoders():
    text = bpe.read_vocabulary(queries.TOKENIZER)
    return bpe.ChunkEncoder(bpe.vocabulary(text), bpe.vocabulary(text).word_ids, 400), token_files.LibraryEncoder(text, 400)


@pytest.mark.parametrize("which", [0, 1])
def test_encoders_equal_the_library(which):
    draw, letters = random.Random(7), [chr(c) for c in [*range(0x250), *range(0x370, 0x5F0), 0x2028, 0x3000, 0x1F600, 0x301]]
    letters += ["'s", "'t", "'ll", " ", "\n", "<|endoftext|>", "<|EndOfText|>", "ing ", "İ", "Σ"] * 20 + list("aaabbtthheeinn") * 20
    cases = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(4000)]
    cases += ["a" * 5000, "x" * 3 + "!" * 3000, "가 é"]
    found = encoders()[which].encode(pa.array([*cases, None]))
    assert found.to_pylist() == [*map(library_ids, cases), []]


def test_decode_equals_the_library():
    tokens = bpe._tokens(bpe.read_vocabulary(queries.TOKENIZER))
    lists = [*map(library_ids, ("the quick fox", "déjà <|endoftext|> vu", "")), [5, 10**6, -1, 7], [10**6]]
    found = bpe.decode(pa.array([[1], *lists, None], pa.list_(pa.int32()))[1:], tokens).to_pylist()
    assert found == [*[LIBRARY.decode([i for i in ids if 0 <= i < 50_000], skip_special_tokens=False) for ids in lists], ""]


def test_bpe_query(spark):
    docs = queries.table(spark, SF_SMALL, "documents").toPandas()
    out = queries.op3_bpe(spark, SF_SMALL).toPandas().set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids, row = library_ids(text), out.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_keep_rows_and_replace_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, "old") for r in ROWS], "doc_id long, text string, ids string")
    out = bpe.with_decoded(bpe.with_ids(docs, queries.TOKENIZER), queries.TOKENIZER).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted((str(a), str(b)) for a, b in ROWS)
    assert all(r.ids == library_ids(r.text) for r in out)
    assert all(r.decoded == LIBRARY.decode(r.ids, skip_special_tokens=False) for r in out)
    assert bpe.with_ids(docs.limit(0), queries.TOKENIZER).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, place string").repartition(3)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, queries.TOKENIZER, encoding=encoding)
    out = token_files.with_starts(token_files.read_tokens(spark, path)).orderBy("start", "n_tokens").collect()
    ordered = sorted(((-1 if i is None else i), t or "") for i, t in ROWS)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in out] == [i for i, _ in ordered]
    assert [r.ids for r in out] == [[*library_ids(t), 1] for _, t in ordered]
    assert [r.start for r in out] == [sum(len(r.ids) for r in out[:k]) for k in range(len(out))]
    assert {r.doc_id for r in token_files.read_tokens(spark, path, first=2, last=2).collect()} == {2}
    empty = str(tmp_path / "empty")
    token_files.write_tokens(docs.limit(0), empty, queries.TOKENIZER)
    assert token_files.with_starts(token_files.read_tokens(spark, empty)).count() == 0


def test_selective_reads_touch_only_their_columns_and_rows(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(queries.table(spark, SF_SMALL, "documents"), path, queries.TOKENIZER)
    lengths = token_files.with_starts(token_files.read_tokens(spark, path).drop("ids"))._jdf.queryExecution().toString()
    assert "ids" not in [line for line in lengths.splitlines() if "ReadSchema" in line][0].split("ReadSchema")[1]
    some = token_files.read_tokens(spark, path, first=5, last=9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in some and "LessThanOrEqual(doc_id,9)" in some


def test_token_query(spark):
    docs = queries.table(spark, SF_SMALL, "documents").toPandas().sort_values("doc_id")
    out = queries.op2_token_files(spark, SF_SMALL).toPandas().sort_values("doc_id")
    start = 0
    for text, row in zip(docs.text, out.itertuples()):
        ids = [*library_ids(text), 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
