"""Small dense matrices in Arrow batches, where column expressions would be too long."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _by_batch(df: DataFrame, column: str, out: str, kind: str, fn: Callable[[np.ndarray], list]) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for pdf in batches:
            m = [np.stack(x) for x in pdf[column]]
            yield pdf.assign(**{out: fn(np.stack(m)) if m else pd.Series(dtype=object)})

    return df.mapInPandas(run, f"{fields}, `{out}` {kind}")


def _lists(m: np.ndarray) -> list:
    return [[list(map(float, row)) for row in x] for x in m]


def inverse(df: DataFrame, column: str, out: str) -> DataFrame:
    """Inverses of symmetric positive matrices (array<array<double>>) through their Cholesky factors, a batch at a time."""

    def fn(m: np.ndarray) -> list:
        low = np.linalg.inv(np.linalg.cholesky(m))
        return _lists(np.transpose(low, (0, 2, 1)) @ low)

    return _by_batch(df, column, out, "array<array<double>>", fn)


def eigen(df: DataFrame, column: str, out: str) -> DataFrame:
    """Eigenvalues (descending) and vectors (one row each) of symmetric matrices."""

    def fn(m: np.ndarray) -> list:
        values, vectors = np.linalg.eigh(m)
        return [{"values": list(map(float, v[::-1])), "vectors": [list(map(float, row)) for row in w.T[::-1]]} for v, w in zip(values, vectors)]

    return _by_batch(df, column, out, "struct<values:array<double>,vectors:array<array<double>>>", fn)


def product(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Products of matrices, left to right."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for pdf in batches:
            total = [np.stack(x) for x in pdf[columns[0]]]
            for c in columns[1:]:
                total = [a @ np.stack(b) for a, b in zip(total, pdf[c])]
            yield pdf.assign(**{out: _lists(total)})

    return df.mapInPandas(run, f"{fields}, `{out}` array<array<double>>")


def ridge_by_group(df: DataFrame, by: str, features: str, y: str, penalty: float) -> DataFrame:
    """(by, beta): regularised regressions from Gram sums, solved a batch of groups at a time."""
    from pyspark.sql import functions as F

    from ..operators.factor import gram_sums, solve_batches

    k = len(df.select(features).first()[0])
    rows = df.withColumn("r", F.col(y)).withColumn("s2", F.lit(1.0))
    return solve_batches(gram_sums(rows, [by], features, k), [by], k, 1 / penalty, None).select(by, F.col("mean").alias("beta"))
