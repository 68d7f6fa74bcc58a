import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import ODD
from tokenizers import Tokenizer

from dyadic.llm import rans as R

STRANGE = ["a  b\n\n c ", "x y “q”", "<|endoftext|> hi<|endoftext|>there", "don't we'll  \t\n", "日本 語,Д.x", "a\x1c b", "é,É.é3 ×,÷. abc123def", "\r\n", "a b  c"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(R.TOKENIZER))


def test_round_trip_through_files(make, words, tokenizer):
    texts = [" ".join(words[k : k + 40]) + "." for k in range(20)] + ODD + STRANGE
    ids = [5 * ((11 * k) % len(texts)) for k in range(len(texts))]
    rows = {r.doc_id: r for r in R.round_trip(make(texts, ids)).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(own, "<u4").tobytes())
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(own), crc), repr(t)[:40]
        start += len(own)


@pytest.mark.parametrize("n", [1, 2, 63, 255, 256, 1000, 300_000])
def test_coder_and_its_sections(n, monkeypatch):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 900).astype(np.uint32) * 3
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    coder = R.Coder(seen, R.frequencies(counts[seen]))
    whole = coder.encode(ids)
    assert (coder.decode(whole) == ids).all()
    monkeypatch.setattr(R, "STEP", 1 << 12)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    parts = [coder.section(block, k) for k in reversed(range(coder.sections(block)))]
    assert (np.concatenate(parts[::-1]) == ids).all()
    if n > 1000:
        assert coder.sections(block) > 4
        p = counts[seen] / n
        assert len(whole) * 8 / n < 1.3 * -(p * np.log2(p)).sum()


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint32) % 50
    coder = R.Coder(np.arange(50), R.frequencies(np.full(50, 100)))
    block = bytearray(coder.encode(ids))
    block[-40] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(block))


def test_frequencies_keep_rare_ids():
    f = R.frequencies(np.array([0, 1, 10**9, 3]), 8)
    assert f.sum() == 256 and list(f > 0) == [False, True, True, True]


def test_empty_table(make):
    assert R.round_trip(make([])).collect() == []


def test_null_ids_come_first(make):
    rows = R.round_trip(make(["b", "a"], [None, 1])).collect()
    assert {r.doc_id: r.start for r in rows} == {None: 0, 1: 2}


def test_more_ids_than_the_usual_scale():
    rng = np.random.default_rng(1)
    ids = rng.permutation(np.arange(1 << 19, dtype=np.uint32))
    coder = R.Coder(np.arange(1 << 19), R.frequencies(np.ones(1 << 19, np.int64)))
    assert int(coder.scale) == 21 and (coder.decode(coder.encode(ids)) == ids).all()


def test_repeated_ids_and_rows(make, tokenizer):
    """Rows of one id follow each other in a fixed order, and all of them are there."""
    texts = ["one two", "three", "one two", None, "four five six"]
    runs = [R.round_trip(make(texts, [7, 7, 7, 7, 3]).repartition(k)).collect() for k in (1, 3)]
    rows = [sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) for rows in runs]
    assert rows[0] == rows[1] and rows[0][0][:2] == (3, 0)
    assert sorted(r[2] for r in rows[0]) == sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert [r[1] for r in rows[0]] == [sum(x[2] for x in rows[0][:k]) for k in range(5)]
