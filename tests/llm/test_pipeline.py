"""The five stages against a plain version of each, chained."""

import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import ITEM  # noqa: E402
from test_minhash_dedup import brute as classes  # noqa: E402

from dyadic.llm.viterbi import MODEL  # noqa: E402


def test_stages(spark, words, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [text(rng.randint(20, 60)) for _ in range(20)]
    near = clean[3] + " " + rng.choice(words)
    texts = [*clean, clean[0], near, "few words", None, "", text(30).upper(), ITEM + " " + text(40), text(25) + " token = abcdefghij0123456789 " + text(10)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = [], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept.append(sorted(r.doc_id for r in docs.collect()))
        columns.append(docs.columns)
    good = [k for k, t in enumerate(texts) if t and len(t.split()) >= 10 and not t.isupper()]
    assert kept[0] == good
    roots = classes([texts[k] for k in good])
    unique = [good[k] for k, r in enumerate(roots) if k == r]
    assert kept[1] == unique and len(unique) == len(good) - 2
    without = [k for k in unique if ITEM not in texts[k]]
    assert kept[2:] == [without] * 3
    assert columns[:4] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    final = {r.doc_id: r for r in docs.collect()}
    secret = len(texts) - 1
    assert all(r.exact for r in final.values())
    assert final[secret].decoded_chars == len(texts[secret]) - len("token = abcdefghij0123456789") + len("[SECRET]")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == without


def test_merge_ids_of_the_last_stage_equal_the_library(spark, words, tmp_path):
    with open(public_tokenizers.path(MODEL), "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    rng = random.Random(3)
    texts = {k: " ".join(rng.choice(words) for _ in range(30)) for k in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.merge_ids for r in rows} == {k: library.encode(t) for k, t in texts.items()}


def test_cases(spark, words, tmp_path):
    """Repeated ids and rows, null ids, long texts, clashing names, and an empty table: every row is accounted for."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, d = (text(30) for _ in range(4))
    long = " ".join(f"{rng.choice(words)[:4]}{k % 9000}" for k in range(30_000))
    rows = [(1, a), (1, b), (1, a), (2, a), (None, c), (None, c), (3, long), (4, ITEM + " " + d), (4, d), (5, None), (6, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __dropped string, root int"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        stages.append(sorted(((r.doc_id or 0), r.text) for r in docs.collect()))
    assert stages[0] == sorted(((i or 0), t) for i, t in rows if t)
    assert stages[1] == sorted([(1, a), (1, b), (0, c), (0, c), (3, long), (4, ITEM + " " + d), (4, d)])
    assert stages[2] == stages[3] == sorted([(1, a), (1, b), (0, c), (0, c), (3, long), (4, d)])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in final) == sorted(i for i, _ in stages[3]) and all(r.exact for r in final)
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
