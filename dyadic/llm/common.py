"""Shared folder, written tables and the fixed-size key filter of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the key filter: its size is the same whatever the data.
FILTER_BITS = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a new folder of this machine, if the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="dyadic-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dyadic/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which cuts its lineage; and the table's path."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a written table for each partition of a sort over it.
SORTED = 1 << 27


def sort_parts(spark: SparkSession, path: str, each: int = SORTED) -> int:
    """Partitions for a range sort of a written table: the session's number, or more if its files hold more than `each` bytes a partition."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns' names never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of an Arrow batch in runs of about `most` bytes of text (one row at least), with the run's UTF-8 bytes and its rows' bounds in them. A null text is empty."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        bounds = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[bounds[0] : bounds[-1]], bounds - bounds[0]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit words whose outputs look independent."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A one-probe Bloom filter of well-mixed 64-bit keys, aggregated in Spark: at most 2^FILTER_BITS / 64 words reach the driver, however many keys there are.

    A filter that fills up lets more through, so what it lets through is always joined exactly afterwards.
    """
    bit = F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (
        keys.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({key} & 63L as int))").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toPandas()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1) != 0


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join) -> Column:
    """Running join (sum, greatest, ...; null is neutral) over an array, by doubling: n log n steps, where appending one by one would take n squared."""

    def doubled(v: Column) -> Column:
        steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda s: s < F.size(v))
        return F.aggregate(steps, v, lambda a, s: F.transform(a, lambda x, i: F.coalesce(join(x, F.get(a, i - s)), x, F.get(a, i - s))))

    return let(values, doubled)
