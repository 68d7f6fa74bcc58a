"""Texts of some megabytes, and repeated ids, in operators whose other tests have short ones."""

import re
import time
import zlib

import pytest

from dyadic.llm import lm_score, quality_rules, rans, rule_ledger, secrets, viterbi

LONG = "Some plain words stand here, and 12 of them are repeated! token=abcDEF123456\n" * 40_000


def timed(df, limit=120):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < limit
    return rows


def test_ledger_and_secrets_are_linear(make):
    docs = make([LONG, "short text"])
    row = {r["doc_id"]: r for r in timed(rule_ledger.ledger(docs))}[0]
    words = LONG.split()
    assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words)) and row["n_dup_lines"] == 39_999 and row["n_repeat_words"] == len(words)
    found = {r["doc_id"]: r for r in timed(secrets.scan(docs))}[0]
    assert found["n_assign"] == len(re.findall(r"token=[A-Za-z0-9]+", LONG))


def test_tokens_of_a_long_text_come_back(make):
    docs = make([LONG, None, "a"])
    found = {r["doc_id"]: r for r in timed(rans.round_trip(docs))}
    format_ = rans.Encoder.shared(None).tokenizer
    ids = format_.encode(LONG[:78], add_special_tokens=False).ids
    assert found[1]["n_tokens"] == 1 and found[0]["n_tokens"] > 39_000 * len(ids) // 2
    whole = format_.encode_batch_fast([LONG], add_special_tokens=False)[0].ids
    assert found[0]["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*whole, 2]))


@pytest.mark.parametrize("operator", ["lm_score", "sentencepiece"])
def test_repeated_ids_are_rows_of_their_own(make, operator):
    docs = make(["one two three four", "one two five", "one two five", None], ids=[7, 7, 7, 7])
    run = lm_score.score if operator == "lm_score" else viterbi.encode_decode
    rows = run(docs).collect()
    assert len(rows) == 4 and all(r["doc_id"] == 7 for r in rows)
    if operator == "lm_score":
        assert sorted(r["n_words"] for r in rows) == [0, 3, 3, 4]


def test_repeated_labelled_ids_count_once(spark, make):
    texts = [f"word {k} and some more plain words to make it longer" * (1 + k % 3) for k in range(60)]
    docs = make([*texts, "another text of a repeated id"], ids=[*range(60), 0])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.score(docs, quality_rules.train(docs, labels)).collect()
    assert len(rows) == 61 and all(0 <= r["score"] <= 1 for r in rows)
