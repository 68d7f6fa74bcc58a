"""Dictionaries of ids, feature gathering, and changes between dense and sparse forms.

Ids are numbered from 1 in binary order of their values. A global number without a global sort in
one task: values are range-partitioned and numbered within partitions, and partition offsets come from a
count of rows per partition (one row each). The numbered partitions are written before they are counted, so that
counts and numbers come from one and the same partitioning, whatever is recomputed later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def numbered(df: DataFrame, order: list[str], name: str = "idx", start: int = 1) -> DataFrame:
    """df with a gapless number in the given order (which should be total)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(before, "__part").withColumn(name, F.col("__before") + F.col("__row") + start).drop("__part", "__row", "__before")


def dictionary(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(id, idx): distinct non-null values of the columns, numbered in order; several columns share one dictionary. Columns of one table are read in one pass."""
    ids, tables = None, []
    for df, name in columns:
        same = next((names for t, names in tables if t is df), None)
        same.append(name) if same else tables.append((df, [name]))
    for df, names in tables:
        own = df.select((F.col(names[0]) if len(names) == 1 else F.explode(F.array(*names))).alias("id"))
        ids = own if ids is None else ids.unionByName(own)
    return numbered(ids.where("id is not null").distinct(), ["id"])


def extended(known: DataFrame, df: DataFrame, column: str, order: str) -> DataFrame:
    """The dictionary with new values of a column after all known ones, by their first appearance in `order`."""
    new = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("id"))
        .agg(F.min(order).alias("first"))
        .join(known, "id", "left_anti")
    )
    top = known.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("top"))
    fresh = numbered(new, ["first", "id"]).crossJoin(F.broadcast(top)).select("id", (F.col("idx") + F.col("top")).alias("idx"))
    return known.unionByName(fresh)


def encode(df: DataFrame, column: str, known: DataFrame, out: str, drop_unknown: bool = False) -> DataFrame:
    """df with the number of a column's value; unknown values become null, or their rows are dropped."""
    lookup = known.select(F.col("id").alias(f"__{out}"), F.col("idx").alias(out))
    return df.join(lookup, df[column] == F.col(f"__{out}"), "inner" if drop_unknown else "left").drop(f"__{out}")


def index_observations(obs: DataFrame, same_ids: bool = False, drop_self_links: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Observations with numbers for each id column that they have, and the dictionaries. Missing optional columns switch their terms off.

    They are written once, since each dictionary reads them."""
    obs = cut(obs)
    dicts: dict[str, DataFrame] = {}
    if same_ids:
        dicts["src"] = dicts["dst"] = dictionary((obs, "src_id"), (obs, "dst_id"))
        if drop_self_links:
            obs = obs.where("src_id <> dst_id")
    elif drop_self_links:
        raise ValueError("self links are defined only where both ends share their ids")
    for key, column in (("src", "src_id"), ("dst", "dst_id"), ("src_ctx", "src_context"), ("dst_ctx", "dst_context"), ("ctx", "ctx_id")):
        if column in obs.columns:
            dicts.setdefault(key, dictionary((obs, column)))
            obs = encode(obs, column, dicts[key], f"{key}_idx")
    return obs, dicts


def matched(obs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id the dictionary has."""
    return obs.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def gather_dense(ids: DataFrame, features: DataFrame, id_col: str, columns: list[str], intercept: bool = False, intercept_first: bool = True) -> DataFrame:
    """(id, idx, x): features as an array for each id of the dictionary. An id without features has a null array, which `missing_features` reports."""
    x = [F.col(c).cast("double") for c in columns]
    x = ([F.lit(1.0), *x] if intercept_first else [*x, F.lit(1.0)]) if intercept else x
    rows = features.select(F.col(id_col).alias("id"), F.array(*x).alias("x"))
    return ids.join(rows, "id", "left")


def missing_features(gathered: DataFrame) -> DataFrame:
    return gathered.where("x is null").select("id")


def gather_sparse(ids: DataFrame, triples: DataFrame, id_col: str, width: int, intercept: bool = False) -> DataFrame:
    """(id, idx, x) from (id, index, value) with index from 1 on; absent entries are 0, an intercept comes last."""
    maps = triples.groupBy(F.col(id_col).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("index", "value"))).alias("m"))
    x = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    x = F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), width)).otherwise(x)
    x = F.concat(x, F.array(F.lit(1.0))) if intercept else x
    return ids.join(maps, "id", "left").select("id", "idx", x.alias("x"))


def one_hot(df: DataFrame, column: str, levels: list) -> list[Column]:
    """Indicators of all levels but the first (in order)."""
    return [F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{column}{v}") for v in sorted(levels)[1:]]


def dense_to_triples(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, index, value) of the cells that are neither null nor 0; index from 1 on."""
    cells = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns)))
    return df.select(F.col(row).alias("row"), cells.alias("pos", "value")).where("value is not null and value <> 0").select("row", (F.col("pos") + 1).alias("index"), "value")


def triples_to_dense(triples: DataFrame, width: int, order: str | None = None) -> DataFrame:
    """One row for each row key with columns c1..c<width>; absent is 0; of repeated cells the last in `order` wins (the greatest value without one)."""
    pick = (lambda c: F.max_by(c, F.col(order))) if order else F.max
    cells = [F.coalesce(pick(F.when(F.col("index") == k, F.col("value"))), F.lit(0.0)).alias(f"c{k}") for k in range(1, width + 1)]
    return triples.groupBy("row").agg(*cells)


def join_columns(columns: list[str], sep: str) -> Column:
    return F.concat_ws(sep, *(F.col(c).cast("string") for c in columns))


def split_column(df: DataFrame, source: str, names: list[str], sep: str) -> DataFrame:
    """New columns from the parts of a text; another number of parts than names is an error."""
    import re

    parts = F.split(source, re.escape(sep))
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of parts: "), F.col(source))))
    return df.withColumn("__parts", checked).select("*", *(F.col("__parts")[k].alias(n) for k, n in enumerate(names))).drop("__parts")


def true_places(flags: Column) -> Column:
    """Places (from 1 on) of the true entries of an array."""
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())


def repeat_index(df: DataFrame, index: str, times: str) -> DataFrame:
    """Each index as often as its row says."""
    return df.where(F.col(times) > 0).select(F.explode(F.array_repeat(F.col(index), F.col(times).cast("int"))).alias(index))


def overwrite(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """x, where rows whose key y has take y's values of the columns they share; keys are unique in y."""
    shared = [c for c in x.columns if c in y.columns and c not in keys]
    renamed = y.select(*keys, F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in shared))
    joined = x.join(renamed, keys, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in x.columns))


def subset_info(obs: DataFrame, id_col: str, context_col: str | None = None) -> DataFrame:
    """Distinct ids, for each context or overall (context null)."""
    overall = obs.select(F.lit(None).cast("string").alias("context"), F.col(id_col).alias("id")).distinct()
    if not context_col:
        return overall
    return obs.select(F.col(context_col).cast("string").alias("context"), F.col(id_col).alias("id")).distinct().unionByName(overall)


def select_group_sum(cells: DataFrame, picks: DataFrame, weighted: bool = True) -> DataFrame:
    """(k, group, sum) of cells (k, j, value) over picks (j, group, weight): each pick adds its column, times its weight."""
    value = F.col("value") * F.col("weight") if weighted else F.col("value")
    return cells.join(picks, "j").groupBy("k", "group").agg(F.sum(value).alias("sum"))
