import random
import re
from collections import Counter

from fixtures_llm import ODD

from dyadic.llm import rule_ledger as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_measurements(make, words):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words[:30]) + rng.choice(["", "", ".", "\n", "\t#"]) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    texts += [(t + "\n") * 3 for t in texts[:5]] + ODD
    rows = {r.doc_id: r for r in R.ledger(make(texts)).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), repr(t)[:60]
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation_read_only_the_ledger(make, words):
    clean = " ".join(words[:60])
    texts = [clean, clean.upper(), " ".join(w + "###" for w in words[:60]), "short", None]
    rows = R.ledger(make(texts)).cache()
    assert [r.kept for r in rows.orderBy("doc_id").collect()] == [True, False, False, False, False]
    v1 = [r.kept for r in R.apply_policy(rows, "v1").orderBy("doc_id").collect()]
    assert v1 == [True, True, True, False, False]
    found = {r.rule: (r.failed, r.alone) for r in R.ablation(rows).collect()}
    assert found["few_words"] == (2, 2) and found["symbols"] == (1, 1) and found["capitals"] == (1, 1)


def test_kept_documents_keep_their_columns(make, words):
    docs = make([" ".join(words[:50]), "x", None])
    kept = R.kept_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    assert R.ledger(make([])).collect() == []


def test_native_plan(make):
    plan = R.ledger(make(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_contract_columns(make):
    assert R.ledger(make([])).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
