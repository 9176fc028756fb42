"""Substring dedup, MinHash, nearest neighbours and vector dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, embedding_dedup, minhash, suffix_dedup
from riskloom.llm import queries  # noqa: F401
from riskloom.llm.base import QUERIES, components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (7, 9), (9, 7)]
    want = Sets()
    for a, b in links:
        want.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want.find(n) for a, b in links if a != b for n in (a, b)}


def shingles(text, words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute_components(rows, words):
    sets, by = [shingles(t, words) for _, t in rows], defaultdict(list)
    want = Sets()
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in by[g] if j < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                want.join(rows[k][0], rows[j][0])
    return [(i, len(s), want.find(i)) for (i, _), s in zip(rows, sets)]


def test_minhash_equals_brute_force(spark, sf_dir, documents):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op8_minhash_forest"](spark, sf_dir).collect())
    assert got == sorted(brute_components(list(zip(documents["doc_id"], documents["text"])), 4))


@pytest.mark.parametrize("block,dense", [(256, 256), (4, 3)])
def test_minhash_groups(spark, block, dense):
    """Stars (each copy is alike to the base only), chains, exact copies and strangers that share a passage."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(60)], []
    for k in range(40):
        star = list(base)
        for at in rng.sample(range(120), 2):
            star[at] = word()
        rows.append(" ".join(star))
    chain = [word() for _ in range(100)]
    for k in range(12):
        chain = chain[2:] + [word(), word()]
        rows.append(" ".join(chain))
    rows += [" ".join(passage + [word() for _ in range(30)]) for _ in range(30)] + [" ".join(base)] * 5 + ["two words"] * 3 + ["Two  WORDS"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=4, block=block, dense=dense).collect())
    assert got == sorted(brute_components(rows, 4))


def test_deepened_regions_hand_on_parts_not_documents():
    """A region that its links hold together has no row; one in two parts has two, whatever its documents."""
    docs, deepened = np.arange(100, 112), np.array([True] * 10 + [False] * 2)
    lcp = np.array([0, 3, 3, 3, 3, 0, 3, 3, 3, 3, 0, 3])
    a, b = np.array([101, 102, 103, 104, 107, 106, 109]), np.array([100, 100, 100, 100, 105, 105, 108])
    at = minhash._first_of_parts(docs, lcp, deepened, a, b)
    assert docs[at].tolist() == [105, 108]
    assert not len(minhash._first_of_parts(docs, lcp, deepened, a[:0], b[:0])) == 0
    assert len(minhash._first_of_parts(docs, lcp, np.zeros(12, bool), a, b)) == 0


def test_regions_deepen_where_dense():
    lcp = np.array([0, 3, 3, 5, 5, 2, 16, 16, 16, 0, 4, 1])
    spans, deepened = minhash._regions(lcp, 2)
    assert sorted(spans) == [(5, 9), (9, 11)]
    assert deepened.tolist() == [True] * 5 + [True] * 4 + [False] * 3


def test_minhash_of_a_dense_family(spark):
    """One template at some 0.7 to each other, with pairs near 0.8 planted: deepened regions find them all, and link no others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    base, texts = [word() for _ in range(300)], []
    for k in range(600):
        own = list(base)
        for at in rng.sample(range(0, 300, 5), 12):
            own[at] = word()
        texts.append(own)
    for k in range(0, 200):
        own = list(texts[k])
        for at in rng.sample(range(2, 300, 5), 7):
            own[at] = word()
        texts.append(own)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=4, dense=32).collect())
    want = brute_components(rows, 4)
    assert 650 > len({c for _, _, c in want}) > 500
    assert got == sorted(want)


def test_minhash_of_odd_rows(spark, tricky):
    got = minhash.near_duplicates(tricky)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept", "head", "text_hash"] and len(rows) == tricky.count()
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept and by[3].n_shingles == by[4].n_shingles == by[7].n_shingles == 0 and by[7].kept
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(tricky.limit(0)).count() == 0


def test_minhash_of_shared_ids(spark):
    """Rows with one id and unlike texts stay apart; the component of each is the smallest id that its own text reaches."""
    rng = random.Random(2)
    long = lambda: [str(rng.random()) for _ in range(100)]
    a, b, c = long(), long(), long()
    rows = [(5, a), (5, b), (3, a[:-1]), (7, c), (7, c[:-1]), (9, b[1:]), (9, b[1:]), (11, long())]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs).join(docs.withColumn("text_hash", F.xxhash64("text")).distinct(), ["doc_id", "text_hash"]).collect()
    told = {(r.doc_id, r.text): (r.component_id, r.kept, r.head) for r in got}
    assert len(got) == 8 and [told[i, " ".join(t)][:2] for i, t in rows] == [
        (3, False), (5, True), (3, True), (7, True), (7, True), (5, False), (5, False), (11, True)
    ]
    assert sum(told[i, " ".join(t)][2] for i, t in rows[3:5]) == 1  # one of two near copies with the same id heads their component


def test_vectors_of_shared_ids(spark):
    a, b, c = [1.0, 0.1, 0.0], [0.0, 1.0, 0.1], [0.1, 0.0, 1.0]
    rows = [(5, a), (5, b), (3, [1.0, 0.2, 0.0]), (9, [0.0, 1.0, 0.2]), (9, [0.0, 1.0, 0.2]), (7, c)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, True), (7, 0, 7, True), (9, 2, 5, False), (9, 2, 5, False)]


def test_words_are_cut_anywhere(spark):
    text = " ".join(str(k % 97) for k in range(4000))
    whole, pieces = minhash.word_hashes(text.encode()), minhash.word_hashes(text.encode(), most=50)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def brute_substrings(rows, width):
    data = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(t[k : k + width] for _, t in data for k in range(len(t) - width + 1))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if n[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((i, len(t), sum(gone), sum(a > b for a, b in zip(gone, b"\0" + gone)), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes,bits", [(1 << 20, 1 << 16), (60, 1 << 8)])
def test_substrings_equal_brute_force(spark, shard_bytes, bits):
    rng, rows = random.Random(shard_bytes), []
    passage = "".join(rng.choice("abcdé ") for _ in range(300))
    for k in range(160):
        t = "".join(rng.choice("abcdé \n") for _ in range(rng.randrange(100)))
        if k % 2:
            a = rng.randrange(280)
            t = t[:20] + passage[a : a + rng.randrange(5, 90)] + t[20:]
        rows.append((k, "ab" * rng.randrange(50) if k % 17 == 0 else None if k % 23 == 0 else t))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.dedup_substrings(docs, width=12, shard_bytes=shard_bytes, filter_bits=bits).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_substrings(rows, 12)


def test_substring_query_and_odd_rows(spark, sf_dir, documents, tricky):
    want = {i: w for i, *w in brute_substrings(list(zip(documents["doc_id"], documents["text"])), 200)}
    for r in QUERIES["op6_suffix_array_dedup"](spark, sf_dir).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    rows = suffix_dedup.dedup_substrings(tricky).collect()
    assert len(rows) == tricky.count() and {r.doc_id: r.n_removed for r in rows}[5] == {r.doc_id: r.n_bytes for r in rows}[5]
    assert suffix_dedup.dedup_substrings(tricky.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(6)
    for _ in range(200):
        data = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdef") for _ in range(rng.randrange(1, 90)))
        order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), 1000)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(data[a:], data[b:])) if x != y), min(len(data) - a, len(data) - b))
        got = suffix_dedup.common_prefixes(np.frombuffer(data, np.uint8), order)
        assert got.tolist()[1:] == [common(a, b) for a, b in zip(order, order[1:])]


@pytest.fixture(scope="module")
def vectors(sf_dir):
    t = ds.dataset(f"{sf_dir}/embeddings.parquet").to_table()
    return t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float)


def test_nearest_reach_the_recall(spark, sf_dir, vectors):
    ids, x = vectors
    got = QUERIES["op1_adaptive_dimension_scan"](spark, sf_dir).toPandas()
    place, hits = {v: k for k, v in enumerate(ids)}, 0
    for q, g in got.groupby("query_id"):
        score = x @ x[place[q]]
        score[place[q]] = -np.inf
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, score[[place[v] for v in g.vec_id]], rtol=0, atol=1e-12)
        hits += len(set(g.vec_id) & set(ids[np.lexsort((ids, -score))[:20]]))
    assert sorted(got.query_id.unique()) == [v for v in sorted(ids) if v % 20 == 0] and hits >= 0.9 * len(got)


def odd_vectors(spark, more=()):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, None, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, []), (7, [1.0]), (None, [1.0, 0.0, 0.0])]
    rows += [(20, [2.0, 0.0, 0.0]), (21, [2.0, 0.0, 0.0]), (22, [0.0, 3.0, 0.0]), (23, [1.0, 1e-9, 0.0]), *more]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("n_links", F.lit("x"))


def test_nearest_of_odd_rows(spark):
    got = [tuple(r) for r in ann.search(odd_vectors(spark), F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 21, 2.0), (20, 1, 21, 4.0), (20, 2, 0, 2.0)]
    assert ann.search(odd_vectors(spark), F.col("vec_id") % 20 == 0).count() == 8  # all others
    assert ann.search(odd_vectors(spark).limit(0), F.lit(True)).count() == 0 and ann.search(odd_vectors(spark), F.lit(False)).count() == 0


def test_nearest_in_small_blocks(spark, sf_dir, vectors):
    ids, x = vectors
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = ann.search(docs, F.col("vec_id") < 60, k=5, target=1.0, block_rows=40, block_queries=7).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[list(ids).index(q)]
        score[list(ids).index(q)] = -np.inf
        hits += len(set(g.vec_id) & set(ids[np.lexsort((ids, -score))[:5]]))
    assert len(got) == 300 and hits >= 0.97 * len(got)


@pytest.mark.parametrize("large", [[1e160], [1e200, 1e-200, 1e-320], [1e8], [1e3, 1e5, 1e7, 1e9, 1e30]])
def test_nearest_with_any_norms(spark, large):
    """Vectors of very unlike size among unit vectors: they answer, are found, and take nothing from the others."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for at, norm in enumerate(large):
        x[37 * at + 20] *= norm
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(docs, F.col("vec_id") % 20 == 0, k=10).toPandas()
    assert len(got) == 600
    hits = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        g = g.sort_values("rank")
        assert np.allclose(g.score, score[g.vec_id], rtol=1e-12, atol=0)
        hits += len(set(g.vec_id) & set(np.lexsort((np.arange(1200), -score))[:10]))
    assert hits >= 0.9 * len(got)


def brute_vectors(ids, x, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want, n = Sets(), np.zeros(len(ids), int)
    i, j = np.nonzero(np.triu(u @ u.T >= least, 1))
    for a, b in zip(i, j):
        want.join(int(ids[a]), int(ids[b]))
    np.add.at(n, i, 1)
    np.add.at(n, j, 1)
    return {int(v): (int(c), want.find(int(v))) for v, c in zip(ids, n)}


@pytest.mark.parametrize("tile_rows", [4096, 25])
def test_vectors_equal_brute_force(spark, tile_rows):
    rng = np.random.default_rng(tile_rows)
    x = np.concatenate((rng.normal(size=(150, 24)), rng.normal(size=(5, 24)).repeat(20, axis=0) + rng.normal(size=(100, 24)) * 0.2, np.ones((30, 24))))
    ids = rng.permutation(1000)[: len(x)]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(rows, tile_rows=tile_rows).collect()}
    assert got == brute_vectors(ids, x, 0.9)


def test_vector_query_and_odd_rows(spark, sf_dir, vectors):
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op9_tiled_embedding_dedup"](spark, sf_dir).collect()}
    assert got == brute_vectors(*vectors, 0.9)
    rows = embedding_dedup.near_vectors(odd_vectors(spark)).collect()
    assert len(rows) == 13
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {
        **{k: (0, k, True) for k in (1, 2, 3, 4, 5, 6, 7, 22)}, None: (0, None, True), **{k: (3, 0, k == 0) for k in (0, 20, 21, 23)},
    }
    assert embedding_dedup.near_vectors(odd_vectors(spark).limit(0)).count() == 0
