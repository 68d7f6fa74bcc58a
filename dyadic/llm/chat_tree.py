"""Chat formatting as a prefix tree: conversations that share initial turns share the tokens of these.

A turn is written as <|im_start|>role, line feed, text, <|im_end|>, line feed. Within roles and texts, each
`<|` (with any backslashes between) gets one backslash more, so no text can pretend to be a mark, and
taking one away gives the text back; roles have line feeds and backslashes escaped as well. Marks are
ids of their own behind the vocabulary. The loss mask covers the text of each assistant turn.

The tree: a node is a sequence of turns that starts some conversation. Its key is a pair of 64-bit
states, to which each turn applies an affine map drawn from its digest; such maps compose, so a long
conversation's states come from several tasks. Each node belongs to the first conversation through
it; what a conversation owns is one run of turns up to its end, a chain. Chains are laid out depth first:
a chain, then those that branch off it, the deepest branches first. So every subtree is one interval.

Output (`<path>/...`): `tokens`, sorted by (chain, rank), has each node's ids once, with the bounds of its text
and its loss mark; `index` has a node's first token in the whole layout (start), the position id of that token in
its conversation (position), and attend_until: a token sees itself and all earlier ones whose attend_until
lies behind it, which are those of its node and of the node's ancestors; `paths` has the chains that a
chain branches off, with the last rank on each; `members` has the node in which each conversation ends.

Scale: what is sorted, joined and numbered are keys and numbers; a text is moved by the join that picks one row
for each node and by the sort of the layout. Numbers that run through all rows come from sums by partition. A
first turn or a whole conversation that a third of all rows share is one row after a grouped minimum, and joins with
it may be split; a conversation with a third of all rows is spread over tasks until its digest is taken, which is
a stream through one task, since such a digest is sequential.

Cases: a null text or role counts as empty. Null conv_ids are one conversation, the first. Turns needn't be
gapless; null turns come first, and rows of one turn follow each other in the order of a digest, so
repeated rows are repeated turns. Very long texts are encoded in bounded slices. An empty table gives none. Columns
of other names are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, scratch_path, sort_parts, text_slices, written
from .rans import Encoder

#: Fixed values of the format.
START, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"
#: States that every conversation starts from.
_SEED = (0x243F6A8885A308D3, 0x13198A2E03707344)
_M64 = (1 << 64) - 1


# --- template -------------------------------------------------------------------------------------


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def formatted(role: str, text: str) -> str:
    return f"{START}{escaped_role(role)}\n{escaped(text)}{END}\n"


class Format:
    """Ids of turns and back: the marks are the two ids behind the vocabulary."""

    def __init__(self, tokenizer: str | None = None):
        self.encoder = Encoder.shared(tokenizer)
        self.start = self.encoder.tokenizer.get_vocab_size(True)
        self.end = self.start + 1
        self.close = self._ids("\n")
        self.heads: dict[str, np.ndarray] = {}

    def _ids(self, text: str) -> np.ndarray:
        data = text.encode()
        return self.encoder.slice(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] if data else np.empty(0, np.uint32)

    def head(self, role: str) -> np.ndarray:
        if role not in self.heads:
            if len(self.heads) > 10_000:
                self.heads.clear()
            self.heads[role] = np.r_[np.uint32(self.start), self._ids(f"{escaped_role(role)}\n")].astype(np.int32)
        return self.heads[role]

    def encode(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, int, int]]:
        """For each turn its ids and where its text starts and ends in them."""
        data = [escaped(t).encode() for t in texts]
        flat, n = self.encoder.slice(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])]) if any(data) else (np.empty(0, np.uint32), np.zeros(len(data), np.int64))
        ends, out = np.cumsum(n), []
        tail = np.r_[np.uint32(self.end), self.close].astype(np.int32)
        for role, i, j in zip(roles, ends - n, ends):
            head = self.head(role)
            out.append((np.concatenate([head, flat[i:j].astype(np.int32), tail]), len(head), len(head) + int(j - i)))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.encoder.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def texts(self, nodes: list[tuple[np.ndarray, int, int]]) -> list[tuple[str, str]]:
        """Role and text, still escaped, of each node's ids."""
        for ids, i, j in nodes:
            if ids[0] != self.start or ids[j] != self.end:
                raise ValueError("marks are not where a turn of the output has them")
        parts = self.decode([p for ids, i, j in nodes for p in (ids[1:i], ids[i:j])])
        return [(head[:-1], text) for head, text in zip(parts[::2], parts[1::2])]


# --- keys of prefixes -----------------------------------------------------------------------------

_ROWS = "rid long, conv_id long, turn long, role string, text string, a1 long, b1 long, a2 long, b2 long"


def _digested(conversations: DataFrame) -> DataFrame:
    """Rows with the two affine maps of their turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = np.empty((batch.num_rows, 4), np.uint64)
            for k, (role, text) in enumerate(zip(batch.column(3), batch.column(4))):
                role, text = (role.as_py() or "").encode(), (text.as_py() or "").encode()
                maps[k] = np.frombuffer(hashlib.blake2b(b"%d:" % len(role) + role + text, digest_size=32).digest(), "<u8")
            maps[:, ::2] |= np.uint64(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(maps[:, j].view(np.int64)) for j in range(4))], [*batch.schema.names, "a1", "b1", "a2", "b2"])

    rows = conversations.select(
        F.monotonically_increasing_id().alias("rid"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, _ROWS)


_LOCAL = "part int, row long, rid long, conv_id long, conv long, rank long, a1 long, b1 long, a2 long, b2 long"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the conversation and of the turn within a sorted partition, and the maps of all its turns so far, composed."""
    part, row, conv, rank, last, now = TaskContext.get().partitionId(), 0, -1, 0, None, (1, 0, 1, 0)
    for batch in batches:
        ids = batch.column(1).to_pylist()
        maps = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (2, 3, 4, 5)], axis=1).tolist() if len(ids) else []
        out, places = [], []
        for i, (a1, b1, a2, b2) in zip(ids, maps):
            if conv < 0 or i != last:
                conv, rank, last, now = conv + 1, 0, i, (1, 0, 1, 0)
            rank += 1
            now = (a1 * now[0] & _M64, (a1 * now[1] + b1) & _M64, a2 * now[2] & _M64, (a2 * now[3] + b2) & _M64)
            out.append(now)
            places.append((conv, rank))
        n = len(ids)
        made = np.array(out, np.uint64).reshape(n, 4).view(np.int64)
        at = np.array(places, np.int64).reshape(n, 2)
        arrays = [np.full(n, part, np.int32), row + np.arange(n), batch.column(0), batch.column(1), at[:, 0], at[:, 1], *(made[:, j] for j in range(4))]
        row += n
        yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(np.ascontiguousarray(a)) for a in arrays], [f.split()[0] for f in _LOCAL.split(", ")])


def _starts(local: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """For each partition: what to add to its numbers of conversations, to the ranks of its first one, and the states that one starts from. One row for each partition reaches the driver."""
    fields = ["row", "conv_id", "conv", "rank", "a1", "b1", "a2", "b2"]
    rows = local.groupBy("part").agg(F.min(F.struct(*fields)).alias("first"), F.max(F.struct(*fields)).alias("last")).collect()
    out, convs, before = {}, 0, None
    for r in sorted(rows, key=lambda r: r["part"]):
        goes_on = before is not None and before[0] == r["first"]["conv_id"]
        rank0, state = (before[1], before[2]) if goes_on else (0, _SEED)
        base = convs - 1 if goes_on else convs
        out[r["part"]] = (base, rank0, *state)
        last, alone = r["last"], r["last"]["conv"] == 0
        x = state if alone else _SEED
        after = tuple(((last[f"a{k}"] & _M64) * x[k - 1] + (last[f"b{k}"] & _M64)) & _M64 for k in (1, 2))
        before = (last["conv_id"], last["rank"] + (rank0 if alone else 0), after)
        convs = base + last["conv"] + 1
    return out


def prefixes(rows: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """rid, conv_id, conv (number of the conversation), rank (from 1), x1, x2 (key of the turns so far), as a written table."""
    spark = rows.sparkSession
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("a1"), F.col("b1"), F.col("rid")]
    slim = rows.select("rid", "conv_id", "turn", "a1", "b1", "a2", "b2").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local, path = written(slim.select("rid", "conv_id", "a1", "b1", "a2", "b2").mapInArrow(_composed, _LOCAL), "local")
    starts = _starts(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            own = np.array([starts[p] for p in part.tolist()], np.uint64).reshape(len(part), 4)
            conv, rank = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            first = conv == 0
            a1, b1, a2, b2 = (batch.column(k).to_numpy().view(np.uint64) for k in (6, 7, 8, 9))
            with np.errstate(over="ignore"):
                x1 = a1 * np.where(first, own[:, 2], np.uint64(_SEED[0])) + b1
                x2 = a2 * np.where(first, own[:, 3], np.uint64(_SEED[1])) + b2
            arrays = [batch.column(2), batch.column(3), conv + own[:, 0].astype(np.int64), rank + np.where(first, own[:, 1].astype(np.int64), 0), x1.view(np.int64), x2.view(np.int64)]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], ["rid", "conv_id", "conv", "rank", "x1", "x2"])

    out, out_path = written(local.mapInArrow(run, "rid long, conv_id long, conv long, rank long, x1 long, x2 long"), "prefixes")
    remove(spark, path)
    return out, out_path


# --- running numbers ------------------------------------------------------------------------------


def _before(sums: DataFrame, value: str, name: str) -> DataFrame:
    """(part, name): the sum of value over the parts before; one row for each partition of a sort."""
    own = sums.groupBy("part").agg(F.sum(value).alias("own"))
    return own.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias(name))


def running(df: DataFrame, order: list[str], value: str, name: str, parts: int) -> tuple[DataFrame, str]:
    """df with the sum of value over all rows before this one, in an order without ties."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(at).to_numpy()
            upto = total + np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(upto - own)], [*batch.schema.names, "part", "inner"])
            total = int(upto[-1]) if len(own) else total

    rows, path = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, part int, inner long"), "running")
    return rows.join(F.broadcast(_before(rows, value, "outer")), "part").withColumn(name, F.col("inner") + F.col("outer")).drop("part", "inner", "outer"), path


# --- writing --------------------------------------------------------------------------------------

_TOKENS = "part int, chain long, rank long, before long, n long, text_from int, text_to int, loss boolean, ids array<int>"


def _encoded(tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, part, before = Format(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, _, _ in text_slices(batch):
                roles = rows.column(2).to_pylist()
                made = form.encode(roles, rows.column(3).to_pylist())
                n = np.array([len(ids) for ids, _, _ in made], np.int64)
                upto = before + np.cumsum(n)
                arrays = [
                    pa.array(np.full(len(n), part, np.int32)), rows.column(0), rows.column(1), pa.array(upto - n), pa.array(n), pa.array([i for _, i, _ in made], pa.int32()), pa.array([j for _, _, j in made], pa.int32()),
                    pa.array([r == LEARNT for r in roles]), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate([ids for ids, _, _ in made]))),
                ]
                before = int(upto[-1])
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _TOKENS.split(", ")])

    return run


def write(conversations: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """The prefix tree of conversations (conv_id, turn, role, text) under path."""
    spark = conversations.sparkSession
    rows, rows_path = written(_digested(conversations), "rows")
    parts = sort_parts(spark, rows_path)
    turns, turns_path = prefixes(rows, parts)
    # Tables of their own wherever a key may be that of a third of all rows: joins split only what they shuffle themselves.
    owners, owners_path = written(turns.groupBy("x1", "x2").agg(F.min("conv").alias("owner")), "owners")
    owned, owned_path = written(turns.join(owners, ["x1", "x2"]).drop("x1", "x2"), "owned")
    remove(spark, turns_path, owners_path)

    # A conversation's path: the chains it runs along, each with its first and last rank.
    runs = owned.groupBy("conv", "owner").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    steps = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("first", "owner", "last"))).alias("path"))
    chains = steps.where(F.element_at("path", -1)["owner"] == F.col("conv"))
    # Depth first: the branch at the greater rank comes first, then the one of the earlier conversation; a chain stands before its branches.
    chains = chains.withColumn("key", F.flatten(F.transform("path", lambda e: F.array(-e["first"], e["owner"])))).withColumn("one", F.lit(1).cast("long"))
    numbered, numbered_path = running(chains, ["key"], "one", "chain", parts)
    chains, chains_path = written(numbered.select("conv", "chain", "path"), "chains")
    remove(spark, numbered_path)

    label = chains.select(F.col("conv").alias("owner"), "chain")
    nodes = owned.where("conv = owner").select("rid", "owner", "rank").join(label, "owner").select("rid", "chain", "rank")
    picked = nodes.join(rows.select("rid", "role", "text"), "rid").select("chain", "rank", "role", "text")
    order = ["chain", "rank"]
    picked.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_encoded(tokenizer), _TOKENS).write.option("compression", "zstd").parquet(f"{path}/tokens")
    remove(spark, rows_path)

    ends = owned.groupBy("conv").agg(F.max(F.struct("rank", "owner")).alias("end"), F.any_value("conv_id").alias("conv_id"))
    ends, ends_path = written(ends.select("conv_id", F.col("end.owner").alias("owner"), F.col("end.rank").alias("rank")), "ends")
    ends.join(label, "owner").select("conv_id", "chain", "rank").write.parquet(f"{path}/members")
    branch = chains.select("chain", F.explode(F.filter("path", lambda e: e["owner"] != F.col("conv"))).alias("e")).select("chain", "e.owner", "e.last")
    branch, branch_path = written(branch, "branch")
    above, above_path = written(branch.join(label.withColumnRenamed("chain", "above"), "owner").select("chain", "above", "last"), "above")
    paths = above.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("last", "above"))).alias("path"))
    chains.select("chain").join(paths, "chain", "left").withColumn("path", F.coalesce("path", F.expr("cast(array() as array<struct<last: bigint, above: bigint>>)"))).write.parquet(f"{path}/paths")
    _write_index(spark, path, above, parts)
    remove(spark, owned_path, chains_path, ends_path, branch_path, above_path)


def _write_index(spark: SparkSession, path: str, above: DataFrame, parts: int) -> None:
    """start, position and attend_until of each node, from the lengths that the tokens have."""
    tokens = spark.read.schema(_TOKENS).parquet(f"{path}/tokens").select("part", "chain", "rank", "before", "n")
    placed = tokens.join(F.broadcast(_before(tokens, "n", "outer")), "part").select("chain", "rank", "n", (F.col("outer") + F.col("before")).alias("start"))
    placed, placed_path = written(placed, "placed")
    whole, whole_path = written(placed.groupBy("chain").agg(F.min("start").alias("chain_start"), F.sum("n").alias("chain_n")), "whole")
    # Tokens of all chains below each branching point: one row a point.
    below = above.join(whole.select("chain", "chain_n"), "chain").groupBy("above", "last").agg(F.sum("chain_n").alias("below"))
    below, below_path = written(below.select(F.col("above").alias("chain"), F.col("last").alias("rank"), "below"), "below")
    summed, summed_path = running(placed.join(below, ["chain", "rank"], "left").withColumn("below", F.coalesce("below", F.lit(0)).cast("long")), ["start"], "below", "passed", parts)
    # Position ids of a chain's first token: the tokens of its path up to where it branches off.
    upto = placed.join(whole, "chain").select(F.col("chain").alias("above"), F.col("rank").alias("last"), (F.col("start") + F.col("n") - F.col("chain_start")).alias("upto"))
    upto, upto_path = written(upto.join(below.select(F.col("chain").alias("above"), F.col("rank").alias("last")), ["above", "last"], "left_semi"), "upto")
    based = above.join(upto, ["above", "last"]).groupBy("chain").agg(F.sum("upto").alias("base"))
    edge = summed.groupBy("chain").agg(F.min("passed").alias("passed0"), F.sum("below").alias("below_all"))
    level, level_path = written(whole.join(edge, "chain").join(based, "chain", "left"), "level")
    until = F.col("chain_start") + F.col("chain_n") + F.col("below_all") - (F.col("passed") - F.col("passed0"))
    index = summed.join(level, "chain").select("chain", "rank", "start", "n", (F.coalesce("base", F.lit(0)) + F.col("start") - F.col("chain_start")).alias("position"), until.alias("attend_until"))
    index.write.parquet(f"{path}/index")
    remove(spark, placed_path, whole_path, below_path, summed_path, upto_path, level_path)


# --- reading --------------------------------------------------------------------------------------


def _leaf_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes on the path of each node in which conversations end (leaf_chain, leaf_rank), with their ids."""
    leaves = spark.read.parquet(f"{path}/members").select(F.col("chain").alias("leaf_chain"), F.col("rank").alias("leaf_rank")).distinct()
    paths = spark.read.parquet(f"{path}/paths").withColumnRenamed("chain", "leaf_chain")
    own = F.struct(F.col("leaf_rank").alias("last"), F.col("leaf_chain").alias("above"))
    steps = leaves.join(paths, "leaf_chain").withColumn("path", F.concat("path", F.array(own)))
    spans = F.transform("path", lambda e, i: F.struct(e["above"].alias("chain"), (F.coalesce(F.get("path", i - 1)["last"], F.lit(0)) + 1).alias("first"), e["last"].alias("last")))
    spread = steps.select("leaf_chain", "leaf_rank", F.explode(spans).alias("e")).select("leaf_chain", "leaf_rank", "e.chain", F.explode(F.sequence("e.first", "e.last")).alias("rank"))
    return spread.join(spark.read.schema(_TOKENS).parquet(f"{path}/tokens").drop("part", "before"), ["chain", "rank"])


_DIGESTS = "chain long, rank long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _digests(tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, key, turns, loss, sums, out = Format(tokenizer), None, None, None, None, []
        extra = len(START) + len(END) + 2

        def batch_of(rows: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in _DIGESTS.split(", ")])

        def done() -> None:
            out.append((*key, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3]))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                nodes = list(zip((x.values.to_numpy() for x in rows.column(5)), rows.column(2).to_pylist(), rows.column(3).to_pylist()))
                for chain, rank, masked, (ids, _, _), (role, text) in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(4).to_pylist(), nodes, form.texts(nodes)):
                    if (chain, rank) != key:
                        if key:
                            done()
                        key, turns, loss, sums = (chain, rank), hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                    plain = unescaped(text)
                    turns.update(f"{unescaped_role(role)}\n{plain}\n".encode())
                    if masked:
                        loss.update(plain.encode())
                        sums[1] += len(plain)
                    sums[0], sums[2], sums[3] = sums[0] + 1, sums[2] + extra + len(role) + len(text), sums[3] + len(ids)
                if len(out) >= 1000:
                    yield batch_of(out)
                    out.clear()
        if key:
            done()
        if out:
            yield batch_of(out)

    return run


def read_digests(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """conv_id, n_turns, digests of turns and of the text under the loss mask, lengths in characters and tokens, from the files alone. A path that several conversations share is read once."""
    nodes = _leaf_nodes(spark, path).select("leaf_chain", "leaf_rank", "rank", "text_from", "text_to", "loss", "ids")
    apart = nodes.repartition("leaf_chain", "leaf_rank").sortWithinPartitions("leaf_chain", "leaf_rank", "rank")
    digests = apart.select("leaf_chain", "leaf_rank", "text_from", "text_to", "loss", "ids").mapInArrow(_digests(tokenizer), _DIGESTS)
    members = spark.read.parquet(f"{path}/members")
    return members.join(digests, ["chain", "rank"]).drop("chain", "rank")


def read_turns(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """conv_id, turn (from 0), role, text of every conversation, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Format(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found = form.texts(list(zip((x.values.to_numpy() for x in rows.column(5)), rows.column(3).to_pylist(), rows.column(4).to_pylist())))
                arrays = [*rows.columns[:3], pa.array([unescaped_role(r) for r, _ in found], pa.string()), pa.array([unescaped(t) for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["chain", "rank", "turn", "role", "text"])

    nodes = _leaf_nodes(spark, path).select("leaf_chain", "leaf_rank", (F.col("rank") - 1).alias("turn"), "text_from", "text_to", "ids")
    turns = nodes.mapInArrow(run, "chain long, rank long, turn long, role string, text string")
    return spark.read.parquet(f"{path}/members").join(turns, ["chain", "rank"]).select("conv_id", "turn", "role", "text")


def round_trip(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The digests of conversations, read back from files written for the purpose."""
    path = scratch_path(conversations.sparkSession, "chat")
    write(conversations, path, tokenizer)
    return read_digests(conversations.sparkSession, path, tokenizer)
