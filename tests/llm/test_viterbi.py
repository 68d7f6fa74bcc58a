import random
import time

import public_tokenizers
import pytest
import sentencepiece
from fixtures_llm import ODD

from dyadic.llm import viterbi as V


@pytest.fixture(scope="module")
def coder():
    return V.shared(public_tokenizers.path(V.MODEL))


def test_segmentations_are_the_best_of_the_library(coder, words):
    """The same pieces as a unigram model: the library's lattice search gives the best segmentation first."""
    encode, _ = coder
    with open(public_tokenizers.path(V.MODEL), "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")  # trainer_spec.model_type = unigram
    texts = [*words, "Hello", "the", "theandtion", "naïve", "größer", "日本", "😀x", "#$%&!", "12345"]
    score = lambda ids: sum(float(encode.model.scores[k]) if encode.model.kinds[k] == 1 else float(encode.unknown_score) for k in ids)
    for t in texts:
        own = encode([t])[0].tolist()
        best = library.nbest_encode(t, nbest_size=3)[0]
        assert score(own) == pytest.approx(score(best), abs=0.5), t


def brute(encode, word):
    """Plain dynamic program over characters."""
    piece = {p: (float(s), k) for k, (p, s, t) in enumerate(zip(encode.model.pieces, encode.model.scores, encode.model.kinds)) if t == 1}
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - encode.longest), e):
            w = word[s:e]
            if w in piece:
                c = (best[s][0] + piece[w][0], best[s][1] + [piece[w][1]])
            elif e - s == 1:
                c = (best[s][0] + float(encode.unknown_score), best[s][1] + [int(encode.byte_ids[b]) for b in w.encode()])
            else:
                continue
            if best[e] is None or c[0] > best[e][0]:
                best[e] = c
    return best[-1][1]


def test_ids_equal_a_plain_dynamic_program(coder, words):
    encode, _ = coder
    for w in [*words[:150], "日本x", "aa😀", "the", "qqqqqqqqqqqqqqqqqqqqqqqqq"]:
        assert encode([w])[0].tolist() == brute(encode, V.MARK + w)


def test_round_trip(make, words):
    texts = [" ".join(words[k : k + 30]) for k in range(10)] + ["  two  spaces ", "line\nbreak\ttab", "\u0000x"] + ODD
    rows = {r.doc_id: r for r in V.encode_decode(make(texts)).collect()}
    for k, t in enumerate(texts):
        assert rows[k].exact == (V.MARK not in (t or "")), repr(t)[:40]
        assert rows[k].n_ids == len(rows[k].ids)
        assert (rows[k].n_ids == 0) == (not t)
    assert V.encode_decode(make([])).collect() == []
    back = V.decode(V.encode_decode(make(texts)).select("doc_id", "ids")).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back if V.MARK not in (texts[r.doc_id] or ""))


def test_merges_equal_the_library(spark, make, words):
    with open(public_tokenizers.path(V.MODEL), "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    texts = [" ".join(words[k : k + 25]) for k in range(0, 300, 25)] + ["The theory of theandtion, there!", "naïve größer\n日本 😀x  two   three", "aaaaaaaaaaaaaaaaaaaaaaaa", *ODD]
    rows = {r.doc_id: r for r in V.encode_decode(make(texts), also_merges=True).collect()}
    for k, t in enumerate(texts):
        assert rows[k].merge_ids == library.encode(t or ""), repr(t)[:40]


def test_long_words_like_short_ones(words, monkeypatch):
    """Words segmented by themselves give what words that advance together give, for both ways; a word of 200,000 characters takes seconds."""
    rng = random.Random(2)
    model = V.Model.load(public_tokenizers.path(V.MODEL))
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["日本語の文" * 30, "a" * 300, "xé😀" * 50, "q", "的" * 97]
    for way in (V.BEST, V.MERGED):
        monkeypatch.setattr(V, "LONG", 10**9)
        expected = V.Encoder(model, (way,))(texts)
        monkeypatch.setattr(V, "LONG", 0)
        got = V.Encoder(model, (way,))(texts)
        assert got[0].tolist() == expected[0].tolist() and got[1].tolist() == expected[1].tolist()
        monkeypatch.undo()
        encode = V.Encoder(model, (way,))
        for long in ("".join(rng.choice(words) for _ in range(33_000))[:200_000], "日本語の文" * 40_000, "a" * 200_000):
            began = time.time()
            encode([long])
            assert time.time() - began < 15


def test_chunks_of_one_hash_are_told_apart():
    """The cache compares bytes, so even equal hashes never give another chunk's ids."""
    import numpy as np

    from dyadic.llm.wordcache import ChunkCache

    encode = lambda data, start, end: [(np.concatenate([data[a:b] for a, b in zip(start, end)]).astype(np.uint32), end - start)]
    cache = ChunkCache(encode)
    chunks = [b"one", b"two", b"one", b"a much longer chunk than the first", b"x" * 40, b"one "]
    data = np.frombuffer(b"".join(chunks), np.uint8)
    end = np.cumsum([len(c) for c in chunks])
    start = end - [len(c) for c in chunks]
    for _ in range(3):
        ids, n = cache.ids(np.zeros(len(chunks), np.uint64), data, start, end)[0]
        assert ids.astype(np.uint8).tobytes() == data.tobytes() and n.tolist() == [len(c) for c in chunks]
