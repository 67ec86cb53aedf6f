import random

import numpy as np
import pytest
import xxhash

from tallyloom.llm import components, embeddings, queries, simhash
from tests.conftest import SF_SMALL


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\r\x0b\x0c":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_a_long_path_a_star_and_loops(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(200)]
    star = [("hub", f"leaf{i}") for i in range(50)]
    edges = spark.createDataFrame(path + star + [("x", "x"), ("hub", "leaf1"), (None, "y")], "a string, b string")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert len({found[n] for n in found if n.startswith("p")}) == 1
    assert len({found[n] for n in found if not n.startswith("p")}) == 1
    assert len(found) == 201 + 51
    assert components.components(edges.limit(0)).count() == 0


def test_fingerprints_equal_the_definition():
    for text in ("", " \n ", "One", "one Two", "ÄB c\x0bd e f g", "a b c a b c a b", "x y z   q w"):
        assert simhash.fingerprint(text.encode()) & (2**64 - 1) == plain_fingerprint(text)
    long = "word" + " other word" * 200_000
    assert simhash.fingerprint(long.encode()) & (2**64 - 1) == plain_fingerprint(long)


def test_query_against_brute_force(spark):
    out = queries.op1_simhash(spark, SF_SMALL).toPandas()
    docs = queries.table(spark, SF_SMALL, "documents").toPandas().set_index("doc_id").text
    assert all(int(r.fingerprint, 16) == plain_fingerprint(docs[r.doc_id]) for r in out.itertuples())
    prints = [int(f, 16) for f in out.fingerprint]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = roots(len(prints), links)
    smallest = {r: min(d for d, s in zip(out.doc_id, root) if s == r) for r in set(root)}
    assert [smallest[r] for r in root] == out.component_id.tolist()


@pytest.mark.parametrize("crowd", [24, 128])
def test_links_lose_none_whatever_the_crowd(spark, crowd):
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(120)}
    prints |= {draw.getrandbits(64) for _ in range(30)} | {0, 7, 2**64 - 1}
    prints = sorted(p - 2**64 if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = sorted((r.a, r.b) for r in simhash.links(frame, crowd).collect())
    mask = 2**64 - 1
    assert found == [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3]


def test_keep_one_handles_nulls_repeats_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (5, None, "c"), (None, "", "d"), (9, "something else here", "e"),
            (None, "only without an id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, [docs.collect()[i] for i in (1, 3, 5, 6)]))
    assert simhash.keep_one(docs.limit(0)).count() == 0
    every = simhash.near_duplicates(docs).collect()
    assert len(every) == len(rows) and {r.component_id for r in every} == {2, 5, 9, None}


def brute_links(rows, threshold=0.93):
    good = []
    for i, (_, v, label) in enumerate(rows):
        ok = label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)
        good.append(np.array(v, float) if ok else None)
    links = []
    for i, a in enumerate(good):
        for j in range(i):
            b = good[j]
            same = a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]
            if same and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((i, j))
    return links


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors_against_brute_force(spark, block):
    draw = np.random.default_rng(3)
    rows = []
    for c in range(4):
        centre = draw.normal(size=16)
        rows += [((centre + draw.normal(size=16) * s).tolist(), c % 2) for s in (0.02, 0.1, 0.2, 0.3) for _ in range(4)]
    rows += [(rows[0][0], 0), (rows[0][0], 1), (rows[0][0], None), ([2 * x for x in rows[0][0]], 0), (None, 0), ([0.0] * 16, 0)]
    rows += [([float("nan")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), ([1.0, 2.0], 0), ([], 0), ([1.0, 2.0], 0)]
    rows = [(100 - i, v, label) for i, (v, label) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embeddings.near_duplicates(frame, block=block).collect()}
    links = brute_links(rows)
    root = roots(len(rows), links)
    for i, (vec_id, _, _) in enumerate(rows):
        component = min(rows[k][0] for k in range(len(rows)) if root[k] == root[i])
        expected = (sum(i in pair for pair in links), component, component == vec_id)
        assert (out[vec_id].n_links, out[vec_id].component_id, out[vec_id].kept) == expected
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("vectors,dims", [(1000, 16), (10_000, 64), (3_000_000, 64), (10**9, 64), (10_000, 256), (10_000, 768)])
def test_recall_at_the_threshold(vectors, dims):
    draw, n = np.random.default_rng(1), min(2000, 100_000 // dims)
    a, other = draw.normal(size=(2, n, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other -= (other * a).sum(1)[:, None] * a
    other /= np.linalg.norm(other, axis=1)[:, None]
    tables, hashes = embeddings.plan(vectors, dims)
    assert (2 * embeddings._padded(dims)) ** hashes >= vectors
    x, y = embeddings.buckets(a, tables, hashes), embeddings.buckets(0.93 * a + np.sqrt(1 - 0.93**2) * other, tables, hashes)
    assert ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2)).mean() > 0.99


def test_vectors_of_many_dimensions_and_a_column_of_nulls(spark):
    draw = np.random.default_rng(8)
    long = draw.normal(size=(3, 1000))
    rows = [(i, (v + draw.normal(size=1000) * 0.01 * k).tolist(), 1) for i, (v, k) in enumerate((v, k) for v in long for k in range(4))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r.component_id for r in embeddings.near_duplicates(frame).collect()}
    assert out == {i: i - i % 4 for i in range(12)}
    none = spark.createDataFrame([(1, None, None), (2, None, None)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(none).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_against_all_pairs(spark):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in queries.table(spark, SF_SMALL, "embeddings").collect()]
    out = {r.vec_id: r for r in queries.op6_embeddings(spark, SF_SMALL).collect()}
    links = brute_links(rows)
    root = roots(len(rows), links)
    n_links = np.bincount([i for pair in links for i in pair], minlength=len(rows))
    smallest = {}
    for (vec_id, *_), top in zip(rows, root):
        smallest[top] = min(vec_id, smallest.get(top, vec_id))
    assert all((out[r[0]].n_links, out[r[0]].component_id) == (n_links[i], smallest[root[i]]) for i, r in enumerate(rows))
