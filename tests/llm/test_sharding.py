import random
import zlib
from collections import Counter

from fixtures_llm import ODD

from dyadic.llm import sharding as H


def check(rows, texts, shards):
    size = Counter(r.shard for r in rows)
    counts = [size.get(s, 0) for s in range(shards)]
    assert len(rows) == len(texts) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_law_and_columns(make, words):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(150)] + ["copy of it"] * 60 + ODD
    rows = H.assign(make(texts), 7).collect()
    check(rows, texts, 7)
    for r in rows:
        own = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(own) + 8, zlib.crc32(own))


def test_links_are_kept_together(make, words):
    texts = [" ".join(words[k : k + 3]) for k in range(200) for _ in range(2)]
    found = H.cut_links(H.assign(make(texts), 8)).first()
    assert found.links == 200 and found.cut <= 2  # a random placement cuts 7 of 8


def test_a_group_larger_than_a_shard(make):
    texts = ["same"] * 90 + [f"t{k}" for k in range(10)]
    rows = H.assign(make(texts), 5).collect()
    check(rows, texts, 5)
    assert len({r.shard for r in rows if texts[r.doc_id] == "same"}) <= 5


def test_few_rows_repeats_and_empty_table(make):
    check(H.assign(make(["a", "a", None], [1, 1, None]), 24).collect(), ["a", "a", None], 24)
    assert H.assign(make([]), 24).collect() == []


def test_native_plan(make):
    plan = H.assign(make(["a", "b"]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_groups_of_all_sizes_stay_whole_where_they_fit(make, words):
    """One group of a third of the rows, some as large as a shard, many small ones: only what can't fit a shard is cut."""
    rng = random.Random(8)
    texts = ["hot"] * 200 + ["large a"] * 40 + ["large b"] * 35 + [f"pair {k % 60}" for k in range(120)] + [f"{rng.choice(words)} {k}" for k in range(205)]
    rng.shuffle(texts)
    rows = H.assign(make(texts), 12).collect()
    check(rows, texts, 12)
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in shards.items() if t.startswith("pair")) <= 8
    assert len(shards["large a"]) <= 3 and len(shards["large b"]) <= 3
