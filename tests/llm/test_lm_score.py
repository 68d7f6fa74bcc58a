import math
import random
from collections import Counter

import pytest
from fixtures_llm import ODD

from dyadic.llm import lm_score as L


def brute(texts, order):
    docs = [(t or "").split() for t in texts]
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total = [sum((grams(w, k) for w in docs), Counter()) for k in range(1, order + 1)]
    n = sum(map(len, docs))
    out = []
    for w in docs:
        own = [grams(w, k) for k in range(1, order + 1)]
        rest = n - len(w)
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        s = off = 0
        for i in range(len(w)):
            factor = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if left(g) > 0:
                    p = factor * left(g) / (left(g[:-1]) if k > 1 else rest)
                    break
                factor *= L.BACKOFF if k > 1 else 1
            else:
                k, p = 0, factor / (rest + 1)
            off += k < min(order, i + 1)
            s += math.log(p)
        out.append((len(w), off, s if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(make, words, order, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words[:25]) for _ in range(rng.randint(1, 60))) for _ in range(30)] + ODD
    monkeypatch.setattr(L, "BLOCK", 300)
    monkeypatch.setattr(L, "BUCKET", 2000)
    rows = {r.doc_id: r for r in L.score(make(texts), order=order).collect()}
    for k, (n, off, s) in enumerate(brute(texts, order)):
        r = rows[k]
        assert (r.n_words, r.n_backed_off) == (n, off)
        assert r.log_score is None if s is None else r.log_score == pytest.approx(s)


def test_empty_table(make):
    assert L.score(make([])).collect() == []
