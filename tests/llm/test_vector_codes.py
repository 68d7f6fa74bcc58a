"""Product codes against distances to all entries, one vector after the other."""

import hashlib
import math
import random

import numpy as np
import pytest

from dyadic.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, of int, part int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, members in own.items():
                new[p][k] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    coded = []
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sum(y[2] for y in coded if y[3] == lab), digest) for i, c, e, lab in coded]


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, 2, 3) for i, v, lab in rows], SCHEMA)


def made(n, dim=32, seed=1, spread=1.0):
    rng = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(k, [f(rng.gauss(0, spread)) for _ in range(dim)], rng.choice([0, 1, None])) for k in range(n)]
    return rows


def same(spark, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in V.codes(table(spark, rows)).collect()), key=key)
    assert got == sorted(plain(rows), key=key)


@pytest.mark.parametrize("n,spread", [(150, 1.0), (90, 0.01), (20, 1.0), (1, 1.0)])
def test_equals_all_distances(spark, n, spread):
    same(spark, made(n, spread=spread))


def test_odd_rows_go_and_ties_go_low(spark):
    rows = made(80) + [(100, None, 1), (101, [None] * 32, 1), (102, [float("nan")] + [0.0] * 31, 0), (103, [float("inf")] * 32, None)]
    rows += [(5, rows[5][1], 1), (None, rows[6][1], 0), (-3, rows[7][1], None), (-4, rows[7][1], None), (200, [0.0] * 32, 1)]
    same(spark, rows)


def test_many_equal_vectors(spark):
    rows = made(70) + [(1000 + k, [0.25] * 32, 7) for k in range(500)]
    same(spark, rows)


def test_empty_and_uncodable(spark):
    assert V.codes(table(spark, [])).collect() == []
    assert V.codes(table(spark, [(1, None, 2)])).collect() == []
    got = {r["vec_id"]: r for r in V.codes(table(spark, [*made(70), (500, [1.0] * 16, 1), (501, [], 1), (502, [3e38] * 32, 1)])).collect()}
    assert [got[k]["code"] for k in (500, 501, 502)] == [None] * 3 and len(got) == 73
    assert all(r["code"] is None for r in V.codes(table(spark, [(1, [1.0] * 5, 0), (2, [1.0] * 5, 0)])).collect())


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    entries, queries = rng.integers(-300, 300, (64, 4)), rng.integers(-400, 400, (1000, 4))
    which, best, measured = V.Cells(entries).nearest(queries)
    d = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all()
    assert measured < 0.5 * d.size


def test_decode(spark):
    rows = table(spark, made(100, spread=0.3))
    ints = V.integers(rows)
    books = V.codebooks(ints)
    out = {r["vec_id"]: r for r in V.decode(V.encode(ints, books), books).collect()}
    for r in ints.collect():
        back = [math.floor(x * 256) for x in out[r["vec_id"]]["vector"]]
        assert sum((a - b) ** 2 for a, b in zip(back, r["v"])) == out[r["vec_id"]]["error"]
