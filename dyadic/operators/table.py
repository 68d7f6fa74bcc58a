"""Joins, grouped aggregates, pivots, margins, ranks and running windows over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import numbered

Aggregate = Callable[[Column], Column]


# --- joins ---------------------------------------------------------------------------------------


def natural_join(x: DataFrame, y: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all names that both have."""
    return x.join(y, [c for c in x.columns if c in y.columns], how)


def defaulting_join(x: DataFrame, y: DataFrame, keys: list[str], how: str = "full", default: float | str = 0) -> DataFrame:
    """A join in which what the other side lacks becomes a constant, in every column it fits."""
    out = x.join(y, keys, how)
    return out.fillna(default, [f.name for f in out.schema if f.name not in keys])


def fold_lookup(df: DataFrame, table: DataFrame, keys: dict[str, str], value: str, out: str, default: Column | None = None) -> DataFrame:
    """df with a value looked up by one or more keys (df column -> table column); unknown keys get the default."""
    right = table.select(*(F.col(t).alias(f"__k{i}") for i, t in enumerate(keys.values())), F.col(value).alias(out))
    cond = [df[d] == right[f"__k{i}"] for i, d in enumerate(keys)]
    joined = df.join(right, cond, "left").drop(*(f"__k{i}" for i in range(len(keys))))
    return joined if default is None else joined.withColumn(out, F.coalesce(out, default))


# --- aggregates ----------------------------------------------------------------------------------


def aggregate(df: DataFrame, by: list[str], columns: list[str], fn: Aggregate | list[Aggregate]) -> DataFrame:
    """One function over each column, or the i-th function over the i-th; outputs keep the columns' names."""
    fns = fn if isinstance(fn, list) else [fn] * len(columns)
    return df.groupBy(*by).agg(*(f(F.col(c)).alias(c) for f, c in zip(fns, columns)))


def aggregate_onto_rows(df: DataFrame, by: list[str], column: str, fn: Aggregate, out: str) -> DataFrame:
    """The group's aggregate beside each of its rows."""
    return df.withColumn(out, fn(F.col(column)).over(Window.partitionBy(*by)))


def count_pivot(df: DataFrame, by: str, column: str, values: list) -> DataFrame:
    """One row for each group, one count for each value; 0 where there is none."""
    counts = [F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(str(v)) for v in values]
    return df.groupBy(by).agg(*counts)


def cross_table(df: DataFrame, x: str, y: str, fraction_by: str | None = None, scale: float = 1.0) -> DataFrame:
    """(x, y, value) counts with margins, a null standing for TOTAL.

    By row or column, inner cells become shares of their row or column; the TOTAL column keeps the
    rows' counts and the TOTAL row becomes shares of all (and the other way round by column).
    """
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).cube(x, y).agg(F.count("*").alias("n"), F.grouping(x).alias("gx"), F.grouping(y).alias("gy"))
    if fraction_by is None:
        return counts.select(x, y, F.col("n").cast("double").alias("value"))
    along, flag, other = (x, "gx", "gy") if fraction_by == "row" else (y, "gy", "gx")
    # Cells of one row share the row's key and flag; their total is the cell that sums the other side.
    total = F.max(F.when(F.col(other) == 1, F.col("n"))).over(Window.partitionBy(along, flag))
    value = F.when(F.col(other) == 1, F.col("n").cast("double")).otherwise(scale * F.col("n") / total)
    return counts.select(x, y, value.alias("value"))


def rollup_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.rollup(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def distinct_count(df: DataFrame, by: list[str], column: str, out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(column).alias(out))


def margin_sums(cells: DataFrame, side: str) -> DataFrame:
    """Sums of (row, col, value) by row or by col."""
    return cells.groupBy(side).agg(F.sum("value").alias("sum"))


def normalize_by(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Shares of the group's sum; a group that sums to 0 gets zeros, a negative value is an error."""
    w = Window.partitionBy(*by)
    checked = F.when(F.col(column) < 0, F.raise_error(F.lit(f"{column} has a negative value")).cast("double")).otherwise(F.col(column))
    total = F.sum(checked).over(w)
    return df.withColumn(out, F.when(total != 0, F.col(column) / total).otherwise(0.0))


def smooth_ratio(df: DataFrame, x: str, y: str, size: float, mean: float | None = None, out: str = "ratio") -> DataFrame:
    """(x + m size) / (y + size) with m the overall ratio unless given."""
    if mean is not None:
        return df.withColumn(out, F.try_divide(F.col(x) + mean * size, F.col(y) + size))
    m = df.agg(F.try_divide(F.sum(x), F.sum(y)).alias("__m"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.try_divide(F.col(x) + F.col("__m") * size, F.col(y) + size)).drop("__m")


# Scores of editorial labels, and labels that are left out.
LABEL_SCORES = {"excellent": 2.0, "good": 1.0, "fair": 0.0, "bad": -1.0, "abuse": -10.0}
LABELS_LEFT_OUT = ["nj", ""]


def label_score(df: DataFrame, user: str, label: str, scores: dict[str, float] | None = None, left_out: list[str] | None = None) -> DataFrame:
    """user, mean, var, n of label scores; a label that has no score is an error."""
    scores = scores or LABEL_SCORES
    table = F.create_map(*(x for k, v in scores.items() for x in (F.lit(k), F.lit(v))))
    rows = df.where(~F.coalesce(F.col(label), F.lit("")).isin(LABELS_LEFT_OUT if left_out is None else left_out))
    score = F.coalesce(F.element_at(table, F.col(label)), F.raise_error(F.concat(F.lit("unknown label: "), F.col(label))).cast("double"))
    return rows.withColumn("__s", score).groupBy(user).agg(F.avg("__s").alias("mean"), F.var_samp("__s").alias("var"), F.count("*").alias("n"))


def label_keyed_quantiles(df: DataFrame, by: list[str], column: str, probs: list[float]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(column, F.array(*map(F.lit, probs))).alias("quantiles"))


def decile_bins(df: DataFrame, column: str, tie: str, bins: int = 10) -> DataFrame:
    """df with bin 0..bins-1 of equal counts by value (ties by another column), from a global number rather than one sorted task."""
    total = df.count()
    return numbered(df, [column, tie], "__n", 0).withColumn("bin", F.floor(F.col("__n") * bins / max(total, 1)).cast("int")).drop("__n")


def centred(df: DataFrame, column: str, by: list[str] | None = None, support: str | None = None) -> DataFrame:
    """column minus its mean (of the group); with support, the mean is over rows that have some and others stay as they are."""
    has = F.col(support) > 0 if support else F.lit(True)
    w = Window.partitionBy(*by) if by else None
    if w is None:
        mean = df.agg(F.avg(F.when(has, F.col(column))).alias("__mean"))
        out = df.crossJoin(F.broadcast(mean))
    else:
        out = df.withColumn("__mean", F.avg(F.when(has, F.col(column))).over(w))
    return out.withColumn(column, F.when(has, F.col(column) - F.col("__mean")).otherwise(F.col(column))).drop("__mean")


def moments_from_sums(n: Column, s: Column, sos: Column) -> tuple[Column, Column]:
    """Mean, and variance over n - 1, from a count, a sum and a sum of squares."""
    mean = s / n
    return mean, F.when(n > 1, sos / (n - 1) - n / (n - 1) * mean * mean)


def covariance_from_sums(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Covariance over n."""
    return sxy / n - sx / n * (sy / n)


def gram(df: DataFrame, features: str, target: str | None = None, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., i, j, value): sums of w x_i x_j, and with j = 0 of w x_i y; i and j from 1 on, i <= j. Partial sums are combined before the shuffle."""
    w = F.col(weight) if weight else F.lit(1.0)
    by = by or []
    left = df.where(w.isNotNull() & (F.abs(w) > 0)).select(*by, w.alias("__w"), F.col(features).alias("__x"), (F.col(target) if target else F.lit(None).cast("double")).alias("__y"))
    pairs = F.expr(
        "flatten(transform(__x, (a, i) -> concat(transform(slice(__x, i + 1, size(__x) - i), (b, k) -> "
        "struct(i + 1 as i, i + 1 + k as j, __w * a * b as v)), array(struct(i + 1 as i, 0 as j, __w * a * __y as v)))))"
    )
    return left.select(*by, F.explode(pairs).alias("p")).where("p.v is not null").groupBy(*by, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("p.v").alias("value"))


def least_support(df: DataFrame, trials: str, obs: str) -> DataFrame:
    """(trials, need): the least obs among rows of this many trials or more, made non-increasing in trials."""
    least = df.groupBy(trials).agg(F.min(obs).alias("least"))
    w = Window.orderBy(trials).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return least.select(trials, F.max("least").over(w).alias("need"))


def argmax(df: DataFrame, by: list[str], value: str, place: str, least: bool = False) -> DataFrame:
    """The first place of the greatest (or least) value of each group."""
    order = F.struct(F.col(value), -F.col(place)) if not least else F.struct(F.col(value), F.col(place))
    pick = F.max_by if not least else F.min_by
    return df.groupBy(*by).agg(pick(F.col(place), order).alias("place"))


def sampled(df: DataFrame, by: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows of each group, chosen by a hash of their key, the same ones every time."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


# --- filters -------------------------------------------------------------------------------------


def supported(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups with `least` rows or more: a grouped count and a semi join, so that no group has to fit in a task."""
    big = df.groupBy(*by).count().where(F.col("count") >= least).select(*by)
    return df.join(big, by, "left_semi")


def mutual(ratings: DataFrame, users: DataFrame, voter: str = "voter", author: str = "author", user: str = "user") -> DataFrame:
    """Ratings between selected users whose voter also receives and whose author also gives ratings there; one pass."""
    chosen = users.select(F.col(user).alias("__u")).distinct()
    both = ratings.join(chosen, ratings[voter] == chosen["__u"], "left_semi")
    both = both.join(chosen, both[author] == chosen["__u"], "left_semi")
    authors = both.select(F.col(author).alias("__a")).distinct()
    voters = both.select(F.col(voter).alias("__v")).distinct()
    both = both.join(authors, both[voter] == authors["__a"], "left_semi")
    return both.join(voters, both[author] == voters["__v"], "left_semi")


# --- windows -------------------------------------------------------------------------------------


def ranked(df: DataFrame, score: str, tie: str, out: str = "rank") -> DataFrame:
    """df with ranks from 1 on by descending score; a range sort, not one task."""
    return numbered(df.withColumn("__neg", -F.col(score)), ["__neg", tie], out).drop("__neg")


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batched(df: DataFrame, item: str, order: list[str], per_batch: int, batches: int) -> DataFrame:
    """df with the batch (from 1 on) of each row by arrival within its item; rows beyond the last batch go."""
    n = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    return df.withColumn("batch", (F.floor((n - 1) / per_batch) + 1).cast("int")).where(F.col("batch") <= batches)


def suffix_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., j, n): rows whose value exceeds j, for each j from 0 that some value exceeds."""
    counts = df.where(F.col(value) > 0).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    filled = counts.select(*by, F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("j"), "c")
    return filled.groupBy(*by, "j").agg(F.sum("c").alias("n"))


def every_nth(df: DataFrame, order: list[str], points: int) -> DataFrame:
    """Every (n // points)-th row in order, and the last one."""
    total = df.count()
    step = max(total // points, 1)
    return numbered(df, order, "place").where(((F.col("place") - 1) % step == 0) | (F.col("place") == total))


def head_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


# --- sets and checks -----------------------------------------------------------------------------


def ordered_except(x: DataFrame, y: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values of x that y lacks, with the first place of each."""
    return x.groupBy(column).agg(F.min(order).alias(order)).join(y.select(column).distinct(), column, "left_anti")


def same_rows(x: DataFrame, y: DataFrame) -> bool:
    """Whether two tables have the same rows as often, nulls being equal."""
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def differences(x: DataFrame, y: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Keys and columns in which numbers differ by more than a relative tolerance, or one is null."""
    values = [f.name for f in x.schema if f.name not in keys and isinstance(f.dataType, T.NumericType)]
    long = lambda df, name: df.select(*keys, F.explode(F.create_map(*(z for v in values for z in (F.lit(v), F.col(v).cast("double"))))).alias("column", name))
    both = long(x, "a").join(long(y, "b"), [*keys, "column"], "full")
    far = F.abs(F.col("a") - F.col("b")) > tolerance * F.greatest(F.abs("a"), F.abs("b"))
    return both.where(F.coalesce(far, F.col("a").isNull() != F.col("b").isNull()))


# --- splits --------------------------------------------------------------------------------------


def portable_hash(seed: int, column: str) -> Column:
    """The first 32 bits of an MD5 digest, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(column).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def split_within_items(df: DataFrame, item: str, key: str, share: float, seed: int = 0, category: str | None = None) -> DataFrame:
    """df with `train`: the first ceil(n share) rows (or categories) of each item in hash order."""
    unit = category or key
    order = [portable_hash(seed, unit), F.col(unit)]
    rank = (F.dense_rank() if category else F.row_number()).over(Window.partitionBy(item).orderBy(*order))
    ranked_rows = df.withColumn("__r", rank)
    total = F.max("__r").over(Window.partitionBy(item))
    return ranked_rows.withColumn("train", F.col("__r") <= F.ceil(total * share)).drop("__r")


def split_items(df: DataFrame, item: str, share: float, seed: int = 0) -> DataFrame:
    """df with `train`: ceil(items share) whole items."""
    items = df.select(item).distinct().withColumn("__h", portable_hash(seed, item))
    n = items.count()
    placed = numbered(items, ["__h", item], "__r").select(item, (F.col("__r") <= F.ceil(F.lit(n * share))).alias("train"))
    return df.join(placed, item)


def bernoulli_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """df with `train`, from a hash of the key, so that it doesn't change with partitioning."""
    return df.withColumn("train", portable_hash(seed, key) / float(1 << 32) < share)


def cold_start_split(df: DataFrame, user: str, item: str, key: str, users: int, items: int, rows: int, seed: int = 0) -> DataFrame:
    """df with `test`: all rows of some users and items, topped up to a number of rows."""
    pick = lambda c, n: df.select(c).distinct().orderBy(portable_hash(seed, c), c).limit(n).withColumn("__hit", F.lit(1))
    cold_users = pick(user, users).withColumnRenamed("__hit", "__u")
    cold_items = pick(item, items).withColumnRenamed("__hit", "__i")
    out = df.join(cold_users, user, "left").join(cold_items, item, "left").withColumn("__cold", F.coalesce("__u", "__i").isNotNull())
    need = max(rows - out.where("__cold").count(), 0)
    # The last row in the order of (hash, key) that still goes: from counts by the hash's upper 16 bits (65,536 at most), then the order within one of these. Rows of one key go together.
    rest = out.where("not __cold").select(key, portable_hash(seed + 1, key).alias("__h"))
    below, last = 0, None
    for b, n in sorted(rest.groupBy(F.shiftright("__h", 16).alias("b")).count().collect(), key=lambda r: (r[0] is not None, r[0])):
        if not need:
            break
        if n > need:
            near = rest.where(F.shiftright("__h", 16) == b).orderBy("__h", key).limit(need)
            last = None if b is None else near.agg(F.max(F.struct("__h", key)).alias("e")).first()["e"]
            break
        need -= n
        if b is not None:
            below = (b + 1) << 16
    h = portable_hash(seed + 1, key)
    more = (h < below) if last is None else (h < last[0]) | ((h == last[0]) & (F.col(key) <= F.lit(last[1])))
    return out.withColumn("test", F.col("__cold") | F.coalesce(more, F.lit(False))).drop("__u", "__i", "__cold")
