import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle, queries
from tests.conftest import SF_SMALL


def digest(*values):
    parts = [b"-" if v is None else f"{len(str(v).encode())}:{v}".encode() for v in values]
    return sha256(b"".join(parts)).hexdigest()


def joined(hashes):
    return sha256("".join(hashes).encode()).hexdigest()


def tree(nodes, fan):
    """The root, and for each leaf its siblings before and after, level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            first = place - place % fan
            steps[leaf].append((nodes[first:place], nodes[place + 1 : first + fan]))
        nodes = [joined(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [place // fan for place in at]
    return nodes[0], steps


def plain_proofs(rows, fan=16):
    """rows (source, doc_id, leaf) -> (source, doc_id, leaf, subroot, root, steps), in any order."""
    by_source = defaultdict(list)
    for source, doc_id, leaf in rows:
        by_source[source].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([leaf for *_, leaf, _ in sorted(by_source[s])], fan) for s in sources]
    root, above = tree([s for s, _ in subs], fan)
    for source, (subroot, steps), top in zip(sources, subs, above):
        for (*_, leaf, doc_id), own in zip(sorted(by_source[source]), steps):
            yield source, doc_id, leaf, subroot, root, own + top


def flat(source, doc_id, leaf, subroot, root, steps):
    return source, doc_id, leaf, subroot, root, tuple(("".join(a), "".join(b)) for a, b in steps)


def found_of(frame):
    return Counter(
        (r.source, r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in frame.collect()
    )


@pytest.mark.parametrize("fan,digits", [(16, 3), (2, 1), (3, 2)])
def test_groups_of_all_sizes(spark, fan, digits):
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "hot": 300, "ä": 2, "z\U0001f600": 33, "z￿": 1}
    rows = [(s, i, joined([f"{s}/{i}"])) for s, n in sizes.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(5)
    found = merkle.proofs(leaves, "source", "doc_id", fan=fan, digits=digits)
    assert found_of(found) == Counter(flat(*r) for r in plain_proofs(rows, fan))
    assert all(r.ok for r in found.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect())


def test_ties_nulls_repeats_and_clashing_names(spark):
    rows = [("s", None, joined(["n"])), (None, None, joined(["m"])), ("s", 1, joined(["b"])), ("s", 1, joined(["a"]))]
    rows += [("s", 2, joined(["same"]))] * 40
    schema = "source string, doc_id long, leaf string, path string, hash int, grp string, rank long, total int, _tie int"
    leaves = spark.createDataFrame([(*r, "gone", 1, "g", 5, 6, 7) for r in rows], schema)
    found = merkle.proofs(leaves, "source", "doc_id", fan=4, digits=2)
    assert found.columns == ["source", "doc_id", "leaf", "hash", "grp", "rank", "total", "_tie", "subroot", "root", "path"]
    assert {(r.hash, r.grp, r["rank"], r.total, r._tie) for r in found.collect()} == {(1, "g", 5, 6, 7)}
    assert found_of(found) == Counter(flat(*r) for r in plain_proofs(rows, 4))


def test_no_rows_and_one_row(spark):
    schema = "source string, doc_id long, leaf string"
    assert merkle.proofs(spark.createDataFrame([], schema), "source", "doc_id").count() == 0
    one = merkle.proofs(spark.createDataFrame([(None, 1, "ab")], schema), "source", "doc_id").first()
    assert (one.subroot, one.root, one.path) == ("ab", "ab", [])


def check_query(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    leaf_of = lambda r, text: digest(r.doc_id, r.source, r.lang, r.n_chars, text)
    expected, shown = Counter(), {}
    for r in docs:
        leaf = leaf_of(r, r.text)
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if tampered else r.text
        shown[leaf] = leaf_of(r, text)
    for source, doc_id, leaf, subroot, root, steps in plain_proofs((r.source, r.doc_id, leaf_of(r, r.text)) for r in docs):
        h = shown[leaf]
        for before, after in steps:
            h = joined([*before, h, *after])
        expected[doc_id, leaf, subroot, root, joined(x for a, b in steps for x in a + b), h, h == root] += 1
    names = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    found = queries.op13_merkle(spark, sf_dir)
    assert found.columns == list(names)
    assert Counter(tuple(r) for r in found.collect()) == expected
    return expected


def test_query_against_brute_force(spark):
    assert {k[-1] for k in check_query(spark, SF_SMALL)} == {True, False}


def test_query_over_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, subroot string"
    rows = [(None, None, None, None, None, None), (5, "ABC é", "en", "", 3, "x"), (5, "ABC é", "en", "", 3, "x"), (6, "", "", "a", 0, "x")]
    rows += [(7, "Z" * 1_000_000, "en", "a", -1, "x")] + [(i, f"Text {i}", "en", None, i, None) for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    check_query(spark, str(tmp_path))
