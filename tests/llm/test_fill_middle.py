"""Fill-in-middle against a plain scan of the texts."""

import hashlib
import re
import time

import pytest

from dyadic.llm import fill_middle as M

from fixtures_llm import ODD

TEXTS = [*ODD, " lead and trail \n", "\t\t", "a <P> b c", "x<S>y z", "<M>", "é ü\x0b\x0cß  日本語 テキスト\r\nend ", "no break space here", "a" * 20000 + " " + "b" * 9000, " " * 9000, ("word  \n" * 4000) + "é", "nul \x00 byte", "emoji 😀😀 😀"]


def plain(doc_id, text):
    text = text or ""
    tokens = [m.group() for m in re.finditer(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)]
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_plain_scan(make):
    texts = TEXTS * 12
    docs = make(texts)
    got = sorted(tuple(r) for r in M.transform(docs).collect())
    assert got == [plain(i, t) for i, t in enumerate(texts)]
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_round_trip_and_cases(make):
    texts = TEXTS * 4
    rows = M.round_trip(make(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(plain(r["doc_id"], text)[5].encode()).hexdigest()
    assert M.round_trip(make([])).collect() == []
    twice = M.round_trip(make(["a b c", "a b c", None], ids=[None, None, None])).collect()
    assert len(twice) == 3 and twice[0]["doc_id"] is None


@pytest.mark.parametrize("size", [1, 7, 100])
def test_pieces_dont_change_tokens(size):
    for t in TEXTS:
        ends = M.token_ends(t or "", size=size)
        assert ends.tolist() == [m.end() for m in re.finditer(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", t or "")]


def test_very_long_text():
    text = "some words and é \n" * 200_000
    began = time.time()
    assert len(M.token_ends(text)) == 4 * 200_000 + 1
    assert time.time() - began < 30


def test_marks_only_in_the_form_are_read_back():
    for form in ("psm", "spm"):
        for p, m, s in [("", "", "a"), ("a ", "b", ""), ("", "x <p> M>", "")]:
            out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
            assert M.restored(out, form) == p + m + s
