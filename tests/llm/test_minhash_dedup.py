import itertools
import random
from collections import Counter

import numpy as np
from fixtures_llm import ODD

from dyadic.llm import minhash_dedup as M


def shingles(text):
    w = (text or "").split()
    if not w:
        return Counter()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j]:
            least = sum((sets[i] & sets[j]).values())
            if least * 5 >= 4 * (sum(sets[i].values()) + sum(sets[j].values()) - least):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_classes_equal_brute_force(make, words):
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ODD
    rows = M.near_duplicate_classes(make(texts)).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(texts)
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_blocks_find_what_one_block_finds(make, words, monkeypatch):
    rng = random.Random(2)
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(copy))
    monkeypatch.setattr(M, "BLOCK_ROWS", 7)
    rows = M.near_duplicate_classes(make(texts)).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(texts)
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_registers_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    hs, doc, n = np.r_[h, h], np.repeat([0, 1], 60), np.r_[a, b]
    s = M.signatures(hs, doc, n, 2, 2000)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_one_document_of_each_class_stays(make):
    docs = make(["a b c d e f", "a b c d e f", None, "", "q r s t u v"], [5, 3, 7, 8, None]).unionByName(make(["a b c d e f"], [3]))
    kept = M.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, 3), (False, 7), (False, 8)]
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(make):
    assert M.near_duplicate_classes(make([])).collect() == []
    assert M.without_near_duplicates(make([])).collect() == []


def test_repeated_ids_lose_no_text(spark, make):
    """Ids that repeat with other texts: only near duplicates go, whatever their ids, also with names that the operator might use."""
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", "m n o p q r", "g h i j k l", "g h i j k l"]
    docs = make(texts, [1, 1, 2, 2, 1, None]).withColumnRenamed("key", "__dropped").withColumnRenamed("slot", "text_hash").withColumnRenamed("shard", "root")
    kept = M.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, texts[1]), (1, texts[0]), (1, texts[1]), (2, texts[3])]
    classes = M.near_duplicate_classes(docs).collect()
    assert sorted((r.class_id or 0, r.class_size) for r in classes) == [(0, 1), (1, 2), (1, 2), (1, 2), (1, 2), (2, 1)]
    assert len({r.class_key for r in classes if r.class_id == 1}) == 2


def test_components_of_chains_and_stars(spark):
    from dyadic.llm.graph import components

    rng = random.Random(3)
    names = rng.sample(range(10**6), 600)
    edges = list(zip(names[:200], names[1:200])) + [(names[200], x) for x in names[201:400]] + [(rng.choice(names[400:]), rng.choice(names[400:])) for _ in range(120)]
    edges += edges[:5] + [(names[0], names[0]), (names[0], None)]
    found, _ = components(spark.createDataFrame(edges, "a long, b long"))
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        if y is not None:
            parent[root(x)] = root(y)
    rows = found.collect()
    got = {r.v: r.root for r in rows}
    assert len(rows) == len(got) and all(r.root < r.v for r in rows)
    seen = {x for e in edges for x in e if x is not None and e[0] != e[1] and e[1] is not None}
    mine = {x: got.get(x, x) for x in seen}
    assert set(got) <= seen
    groups = lambda f: {frozenset(x for x in seen if f(x) == r) for r in {f(x) for x in seen}}
    assert groups(mine.get) == groups(root)


def test_thue_morse_words_differ():
    """Words on which every polynomial hash modulo 2^64 agrees."""
    from dyadic.llm import textvec

    a, b = b"a", b"b"
    for _ in range(12):
        a, b = a + b, b + a
    for n in (8, 16, 32, 64, 1024, 4096):
        data = np.frombuffer(a[:n] + b[:n], np.uint8)
        h = textvec.hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
        again = textvec.hashes(np.frombuffer(b"xyz" + a[:n], np.uint8), np.array([3]), np.array([3 + n]))
        assert again[0] == h[0]
