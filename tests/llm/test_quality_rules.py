import random
import zlib

import numpy as np
from fixtures_llm import ODD

from dyadic.llm import quality_rules as Q


def corpus(words, n=240):
    rng = random.Random(8)
    texts, labels = [], []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(30, 80))]
        if k % 4 == 0:
            own = [w + "###" for w in own] if k % 8 else [w.upper() + "!!" for w in own]
        texts.append(" ".join(own))
        labels.append(int(k % 4 != 0))
    return texts, labels


def test_held_out_accuracy(make, spark, words):
    texts, labels = corpus(words)
    docs = make(texts + ODD)
    table = spark.createDataFrame([(k, y, 0, "x") for k, y in enumerate(labels)] + [(None, 1, 0, "x"), (0, None, 0, "x"), (1, 1, 0, "x"), (99999, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = Q.train(docs, table)
    rows = {r.doc_id: r for r in Q.score(docs, model).collect()}
    assert len(rows) == len(texts) + len(ODD)
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(rows[k].predicted, y) for k, y in enumerate(labels) if rows[k].held_out]
    assert len(held) > 30 and np.mean([p == y for p, y in held]) > 0.95


def test_columns_score_as_numpy_does(make, spark, words):
    texts, labels = corpus(words, 120)
    docs = make(texts)
    model = Q.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"))
    x = np.array([list(r.s) for r in docs.orderBy("doc_id").select(Q.statistics(docs.text).alias("s")).collect()], float)
    got = [r.score for r in Q.score(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(model.score(x), got)


def test_labels_of_one_kind_and_none(make, spark):
    docs = make(["a b c", None])
    one = Q.train(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in Q.score(docs, one).collect())
    none = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score == 0.5 for r in Q.score(docs, none).collect())
    assert Q.score(make([]), none).collect() == []


def test_lasso_drops_what_says_nothing():
    rng = np.random.default_rng(0)
    a = (rng.random((500, 6)) < 0.5).astype(float)
    y = (a[:, 0] > 0).astype(float)
    _, w = Q.lasso(a, y, 0.05)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.05
