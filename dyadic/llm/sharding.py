"""Shards by balanced label propagation: linked documents (equal texts) move together, sizes stay even.

Every linked document starts in a shard by the hash of its id. In each round a group of equal texts looks
at its members' shards (a star: one grouped count, one join), and members outside the group's
most common shard ask to move there; a shard that refused movers before is their last choice. A shard accepts movers up to its quota: what it has free
plus what leaves it. The share that it accepts is found from K-row sums, and a hash decides who is in it,
whole groups at a time unless a group is large against the quota, so nothing is ranked or
collected. Rounds go on until none asks, or PATIENCE rounds brought no fewer movers. Single documents have no neighbours to follow, so they fill what
room is left. At last the rows are range-sorted by shard, with single documents at both ends of a shard and groups between them, and
the law `rows` is settled: shard sizes differ by one row at most, and borders cut through single documents first.

Native: DataFrame functions only. The text is read once; rounds carry (doc_id, size, crc, group).

Cases: a null text counts as no bytes and is equal to an empty one. Rows with a null doc_id and
repeated rows are placed like others; ties between shards are settled by a hash. Very long texts are read once, for their hashes. An empty table gives no rows.
Other columns aren't read, so their names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, remove, written

SHARDS = 24
#: Rounds without fewer movers after which propagation ends.
PATIENCE = 3
#: Groups of more than this share of the even size move in parts.
WHOLE = 0.1


def _share(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def propagated(rows: DataFrame, even: float, shards: int = SHARDS, group: str = "group") -> tuple[DataFrame, str]:
    """Linked rows (with doc_id, group), their shard after the last round, and the written table's path. A shard takes movers up to the even size."""
    now, path = written(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")), "shards")
    k, full, fewest, since = 0, [False] * shards, None, 0
    while since < PATIENCE:
        votes = now.groupBy(group, "shard").agg(F.count("*").alias("n"))
        wish = (
            votes.groupBy(group)
            .agg(F.max(F.struct((~F.get(F.array(*map(F.lit, full)), F.col("shard"))).alias("free"), "n", F.xxhash64(group, "shard").alias("tie"), "shard")).alias("best"), F.sum("n").alias("total"), F.count("*").alias("parts"))
            .where("parts > 1")
            .select(group, F.col("best.shard").alias("to"), "total")
        )
        # As a table of its own, so that the join may split the rows of a large group.
        wish, wish_path = written(wish, "wishes")
        asked = now.join(wish, group, "left").withColumn("moves", F.coalesce(F.col("to") != F.col("shard"), F.lit(False)))
        asked, asked_path = written(asked, "shards")
        flow = asked.select(F.explode(F.array(F.struct(F.col("shard").alias("at"), F.lit(1).alias("is"), F.col("moves").cast("int").alias("out"), F.lit(0).alias("into")), F.struct(F.coalesce("to", "shard").alias("at"), F.lit(0).alias("is"), F.lit(0).alias("out"), F.col("moves").cast("int").alias("into")))).alias("f"))
        sums = flow.groupBy("f.at").agg(F.sum("f.is").alias("size"), F.sum("f.out").alias("out"), F.sum("f.into").alias("into")).collect()
        accepted = {r["at"]: min(1.0, max(0.0, even - r["size"] + r["out"]) / r["into"]) if r["into"] else 0.0 for r in sums}
        limit = F.get(F.array(*(F.lit(accepted.get(s, 0.0)) for s in range(shards))), F.col("to"))
        key = F.when(F.col("total") > even * WHOLE, F.concat_ws(":", group, F.col("doc_id").cast("string"))).otherwise(F.col(group))
        moved = F.when(F.col("moves") & (_share(key, k) < limit), F.col("to")).otherwise(F.col("shard"))
        new, new_path = written(asked.withColumn("shard", moved).drop("to", "total", "moves"), "shards")
        remove(now.sparkSession, path, asked_path, wish_path)
        now, path = new, new_path
        full = [accepted.get(s, 1.0) < 1.0 and any(r["at"] == s and r["into"] for r in sums) for s in range(shards)]
        asking = sum(r["into"] for r in sums)
        if not asking:
            break
        since = 0 if fewest is None or asking < fewest else since + 1
        fewest = asking if fewest is None else min(fewest, asking)
        k += 1
    return now, path


def settled(rows: DataFrame, shards: int = SHARDS, group: str = "group") -> DataFrame:
    """rows (with shard, and linked: not single) with shard and slot so that shard sizes differ by one at most, in the order of their shards, with single rows first and last in each."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    place = F.when(F.col("linked"), 1).otherwise(2 * F.pmod(F.xxhash64(F.lit(-1), "doc_id"), F.lit(2)))
    order = ["shard", "place", group, "doc_id"]
    ordered = rows.withColumn("place", place).drop("linked").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed, _ = written(
        ordered.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shards"
    )
    # One row for each partition of the sort; its size doesn't depend on the number of documents in one.
    before = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.sum("n").over(Window.orderBy("part")).alias("upto"), "n").select("part", (F.col("upto") - F.col("n")).alias("before"))
    total = placed.count()
    base, extra = divmod(total, shards)
    rank = F.col("rank")
    wide = extra * (base + 1)
    shard = F.when(rank < wide, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - wide) / max(base, 1)))
    first = F.when(F.col("shard") < extra, F.col("shard") * (base + 1)).otherwise(wide + (F.col("shard") - extra) * base)
    return (
        placed.join(F.broadcast(before), "part")
        .withColumn("rank", F.col("before") + F.col("row"))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (rank - first).cast("long"))
        .drop("part", "row", "before", "rank", "place")
    )


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group")
    )
    # Groups as a table of their own, so that the join may split the rows of a large one.
    rows, path = written(rows, "rows")
    groups, groups_path = written(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", F.lit(True).alias("linked")), "groups")
    flagged, flagged_path = written(rows.join(groups, "group", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "rows")
    even = flagged.count() / shards
    moved, moved_path = propagated(flagged.where("linked"), even, shards)
    size = {r["shard"]: r["n"] for r in moved.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    out = settled(moved.unionByName(filled(flagged.where("not linked"), [max(0.0, even - size.get(s, 0)) for s in range(shards)])), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
    remove(docs.sparkSession, path, groups_path, flagged_path, moved_path)
    return out


def filled(singles: DataFrame, room: list[float]) -> DataFrame:
    """singles with shards in proportion to the room in these."""
    total, upto = sum(room) or 1.0, []
    for r in room[:-1]:
        upto.append((upto[-1] if upto else 0.0) + r / total)
    edges = F.array(*map(F.lit, upto)) if upto else F.expr("cast(array() as array<double>)")
    u = _share(F.col("doc_id"), -2)
    return singles.withColumn("shard", F.size(F.filter(edges, lambda e: e <= u)))


def cut_links(assigned: DataFrame, key: str = "text_crc32") -> DataFrame:
    """links, cut: pairs of a star over each group, and those whose ends lie in different shards."""
    parts = assigned.groupBy(key, "shard").agg(F.count("*").alias("n"))
    groups = parts.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("together"))
    return groups.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("n") - F.col("together")).alias("cut"))
