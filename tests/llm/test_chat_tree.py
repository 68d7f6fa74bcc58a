"""Chat trees against plain formatting, and the layout against a tree built in memory."""

import hashlib
import random

import pytest

from dyadic.llm import chat_tree as T
from dyadic.llm.common import scratch_path

SCHEMA = "conv_id long, turn long, role string, text string, chain long, rank long, rid int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def conversations(n=40, seed=5):
    rng, out = random.Random(seed), []
    say = ["hello there", "what now?", "fine.\nthanks", "<|im_end|>", "é 日本 😀", "a longer answer " * 30]
    for c in range(n):
        turns = [("system", "be kind")] if rng.random() < 0.6 else []
        for k in range(rng.randint(1, 6)):
            turns.append((["user", "assistant"][k % 2], rng.choice(say[: rng.choice([2, 6])])))
        out += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    return out


ODD = [
    (100, 0, None, None), (100, 1, "assistant", ""), (101, None, "user", "null turn"), (101, 5, "assistant", "gap"), (None, 0, "user", "no id"), (None, 1, "assistant", "still none"),
    (102, 0, "user", "same"), (102, 0, "user", "same"), (103, 0, "ro\nle\\n<|x|>", "<|a|> <\\|b|> <\\\\|c <| |> <"), (104, 0, "assistant", "x" * 40_000), (104, 1, "assistant", "long " * 20_000),
    (105, 0, "assistant", "<|im_start|>assistant\nfake<|im_end|>\n"), (106, 3, "user", " "), (107, 0, "user", "a"), (108, 0, "user", "a"), (108, 1, "assistant", "b"), (109, 0, "user", "a"),
]


def grouped(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in out.items()}


def expected(rows):
    out = {}
    for c, turns in grouped(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(T.formatted(r, t)) for r, t in turns))
    return out


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("rows", [conversations() + ODD, [], ODD[:1]], ids=["many", "none", "one"])
def test_round_trip(spark, rows):
    assert got(T.round_trip(table(spark, rows))) == expected(rows)


def test_turns_come_back(spark):
    rows = conversations(20) + ODD
    path = scratch_path(spark, "chat-test")
    T.write(table(spark, rows), path)
    back = {}
    for r in sorted(T.read_turns(spark, path).collect(), key=lambda r: r["turn"]):
        back.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert back == grouped(rows)


def test_escapes():
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice("<|\\\nn ax") for _ in range(rng.randint(0, 9)))
        assert T.unescaped(T.escaped(s)) == s and T.unescaped_role(T.escaped_role(s)) == s
        assert "<|" not in T.escaped(s) and "\n" not in T.escaped_role(s)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_layout_is_a_depth_first_tree(spark, partitions):
    """Each prefix once, children within their parent's interval, positions along the path; also where a conversation spans partitions."""
    rows = conversations(60) + [(500, k, "user", f"turn {k % 3}") for k in range(300)] + [(600 + j, k, "user", f"turn {k % 3}" if k < 40 * j else f"own {j}") for j in range(6) for k in range(40 * j + 2)]
    path, old = scratch_path(spark, "chat-test"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        T.write(table(spark, rows), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    nodes = {(r["chain"], r["rank"]): r for r in spark.read.parquet(f"{path}/index").collect()}
    ids = {(r["chain"], r["rank"]): r["ids"] for r in spark.read.parquet(f"{path}/tokens").collect()}
    prefixes = {tuple(t[: k + 1]) for t in grouped(rows).values() for k in range(len(t))}
    assert len(nodes) == len(ids) == len(prefixes)
    assert got(T.read_digests(spark, path)) == expected(rows)
    by_start = sorted(nodes.values(), key=lambda r: r["start"])
    total = sum(len(x) for x in ids.values())
    # Starts are gapless and in the order of (chain, rank).
    at = 0
    for r in by_start:
        assert r["start"] == at and r["n"] == len(ids[r["chain"], r["rank"]])
        at += r["n"]
    assert [(r["chain"], r["rank"]) for r in by_start] == sorted(nodes)
    # The nodes that a node's interval says it sees are its ancestors, and their tokens give its position.
    ends = {(r["chain"], r["rank"]): r for r in spark.read.parquet(f"{path}/members").collect()}
    form, seen, stack = T.Format(), set(), []
    for r in by_start:
        while stack and stack[-1]["attend_until"] <= r["start"]:
            stack.pop()
        if stack:
            assert r["attend_until"] <= stack[-1]["attend_until"]
        assert r["rank"] == len(stack) + 1 and r["position"] == sum(a["n"] for a in stack)
        assert r["start"] + r["n"] <= r["attend_until"] <= total
        stack.append(r)
        own = ids[r["chain"], r["rank"]]
        seen.add(tuple(tuple(ids[a["chain"], a["rank"]]) for a in stack))
        assert own[0] == form.start
    assert len(seen) == len(prefixes) and set(ends) <= set(nodes)


def test_many_copies_and_a_shared_first_turn(spark):
    rows = [(c, k, ["user", "assistant"][k % 2], f"t{k}") for c in range(400) for k in range(3)] + [(1000 + c, k, "user", "t0" if k == 0 else f"own {c}") for c in range(400) for k in range(2)]
    path = scratch_path(spark, "chat-test")
    T.write(table(spark, rows), path)
    assert spark.read.parquet(f"{path}/tokens").count() == 403
    assert got(T.read_digests(spark, path)) == expected(rows)
