import pytest

from dyadic.llm import decontaminate as D

ITEM = "Yesterday morning our friend Anna bought 12 apples for 30 dollars while Anna and Peter sold 7 kg of pears at the old market near the river"
SCHEMA = "item_id long, text string, doc_id long, slots string"


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM, 9, "x"), (2, "short one", 9, "x"), (3, None, 9, "x"), (None, "a b c d e f g h i j", 9, "x"), (4, "completely different words fill this other item so nothing matches it here", 9, "x")], SCHEMA)


def caught(make, bench, texts):
    return sorted((r.doc_id, r.item_id, r.verbatim) for r in D.leaks(make(texts), bench).collect())


def test_verbatim_and_new_parameters(make, bench, words):
    filler = " ".join(words[:80]) + ". "
    changed = ITEM.replace("Anna", "Maria").replace("Peter", "Paul").replace("12", "45").replace("30", "90").replace("7", "8")
    broken = changed.replace("while Maria", "while Olga")  # one name became two
    texts = [filler + ITEM + ". " + filler, filler + changed + ".", filler + broken, filler, None, "", ITEM]
    assert caught(make, bench, texts) == [(0, 1, True), (1, 1, False), (6, 1, True)]


def test_parts_of_an_item(make, bench):
    w = ITEM.split()
    half, little = " ".join(w[: len(w) * 3 // 4]), " ".join(w[:9])
    assert [r[0] for r in caught(make, bench, [half, little])] == [0]


def test_repeated_passages_that_are_no_benchmark_stay(make, bench, words):
    passage = " ".join(words[100:170])
    docs = make([passage + " " + words[k] for k in range(20)] + [ITEM])
    kept = D.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 20


def test_a_full_filter_changes_nothing(make, bench, monkeypatch):
    import numpy as np

    monkeypatch.setattr(D, "key_filter", lambda keys, key: np.full(1 << 18, (1 << 64) - 1, np.uint64))
    assert caught(make, bench, [ITEM, "nothing of it"]) == [(0, 1, True)]


def test_empty_tables_and_repeats(make, bench):
    assert D.leaks(make([]), bench).collect() == []
    assert D.leaks(make([ITEM]), bench.limit(0)).collect() == []
    assert len(D.leaks(make([ITEM, ITEM], [3, 3]), bench).collect()) == 1


def test_two_parameters_with_the_same_new_value(make, bench):
    text = ITEM.replace("12", "45").replace("30", "45")
    assert caught(make, bench, [text]) == [(0, 1, False)]


def test_parameters_of_another_number_of_words(make, bench, spark, words):
    several = [ITEM.replace("Peter", "Mary Ann"), ITEM.replace("Peter", "Mary Ann").replace("Anna bought", "Eva Maria Roth bought").replace("while Anna", "while Eva Maria Roth").replace("7", "7 thousand")]
    broken = several[1].replace("while Eva Maria Roth", "while Eva Roth")
    filler = " ".join(words[:80]) + ". "
    assert caught(make, bench, [filler + several[0], several[1], broken]) == [(0, 1, False), (1, 1, False)]
    longer = spark.createDataFrame([(1, several[1], 9, "x")], SCHEMA)
    assert caught(make, longer, [ITEM, several[1], several[0]]) == [(0, 1, False), (1, 1, True), (2, 1, False)]


def test_items_dense_in_placeholders(make, spark, words):
    table = "The list says Anna 12 kg Peter 30 kg Olga 7 kg Maria 45 kg Paul 8 kg Eva 19 kg which makes this heap of goods"
    short = "add 3 4 5 6 7"
    bench = spark.createDataFrame([(1, table, 9, "x"), (2, short, 9, "x")], SCHEMA)
    filler = " ".join(words[:80]) + ". "
    changed = table.replace("Anna 12", "Tim 61").replace("Eva 19", "Uwe 77")
    other = "Some say Anna 11 kg Peter 31 kg Olga 6 kg Maria 44 kg Paul 9 kg Eva 18 kg and no more than that"
    texts = [filler + table + ". " + filler, filler + changed, other, filler + short, "add 3 4 5 6 8"]
    assert caught(make, bench, texts) == [(0, 1, True), (1, 1, False), (3, 2, True)]
    assert [tuple(r) for r in D.leaks(make([ITEM]), spark.createDataFrame([(1, ITEM, 9, "x")], SCHEMA)).select("matched", "windows").collect()] == [(20, 20)]


def test_repeated_ids_with_other_texts(spark, make, bench, words):
    """Windows of two rows with one id are never put together, and only the row that leaks goes."""
    w = ITEM.split()
    halves = [" ".join(w[:14]) + " " + " ".join(words[:40]), " ".join(words[40:80]) + " " + " ".join(w[14:])]
    docs = make([halves[0], halves[1], ITEM, "clean text of its own"], [5, 5, 6, 6]).withColumnRenamed("key", "__leaking")
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()] == [(6, 1)]
    kept = D.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted([*halves, "clean text of its own"])
    twice = spark.createDataFrame([(1, " ".join(w[:14])), (1, " ".join(w[14:]))], "item_id long, text string")
    assert len(D.leaks(make([ITEM]), twice).collect()) == 1


def test_short_items_match_whole_documents(make, bench):
    texts = ["short one", "Short one!", "a short one in a text", "short two"]
    assert [r[0] for r in caught(make, bench, texts)] == [0, 1]


def test_outer_characters_one_by_one():
    import random

    import numpy as np

    from dyadic.llm import textvec

    def core(word):
        word = word.encode()
        start, end = 0, len(word)
        while end - start > 1 and D._OUTER[word[end - 1]] and word[end - 1] != ord("%"):
            end -= 1
        while end - start > 1 and D._OUTER[word[start]]:
            start += 1
        return word[start:end]

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab(!%\"' .") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["(" * 200_000 + " " + ")" * 200_000]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    token, _, w = D.tokens(data, bounds)
    cores = [core(x) for t in texts for x in t.split()]
    flat = np.frombuffer(b"".join(cores), np.uint8)
    end = np.cumsum([len(c) for c in cores])
    assert (token == textvec.hashes(flat, end - [len(c) for c in cores], end)).all()


def test_equals_its_sql_on_every_case(spark, make, bench, words, tmp_path):
    """The SQL of the registered query, on texts that touch every rule: new values, equal new values, runs, dense windows, short items, repeated ids."""
    import duckdb

    from dyadic.llm import oracles

    table = "The list says Anna 12 kg Peter 30 kg Olga 7 kg Maria 45 kg Paul 8 kg Eva 19 kg which makes this heap of goods"
    several = ITEM.replace("Peter", "Mary Ann").replace("7", "7 thousand")
    filler = " ".join(words[:60]) + ". "
    items = [(1, ITEM), (2, "short one"), (3, None), (4, table), (5, several), (6, "add 3 4 5 6 7"), (6, "what is the sum of 14 and 27 apples"), (None, ITEM)]
    texts = [ITEM, filler + ITEM, ITEM.replace("12", "45").replace("30", "45"), several, filler + several, several.replace("Mary Ann", "Eva Maria Roth"), ITEM.replace("Anna bought", "Olga bought"), table, table.replace("Anna 12", "Tim 61")]
    texts += [filler + table.replace("Eva 19", "Uwe 77"), "Short one!", "a short one", "add 3 4 5 6 7", "add 3 4 5 6 8", "What is the sum of 3 and 4 apples", " ".join(ITEM.split()[:12]), filler, None, "", "what is the sum of 14 and 14 apples?"]
    ids = [*range(len(texts) - 3), 0, 0, 1]
    docs, benchmark = make(texts, ids), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    expected = con.sql(oracles.OP7)
    got = sorted(tuple(r[c] for c in expected.columns) for r in D.leaks(docs, benchmark).collect())
    assert got == sorted(expected.fetchall()) and len(got) > 12
