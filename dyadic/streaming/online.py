"""Sequential Gaussian regression in batches: each batch is predicted before it is absorbed. For tables and for streams.

State of an item: precision L and L b (from its prior), and the batch it is in. On entering a batch the
coefficients are solved for, and the state is multiplied by the discount if every diagonal entry
stays at its prior's or above. Noise has unit variance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.table import batched


class State:
    def __init__(self, prior_mean: np.ndarray, prior_precision: np.ndarray):
        self.floor = np.diag(prior_precision).copy()
        self.lam, self.eta = prior_precision.copy(), prior_precision @ prior_mean
        self.beta, self.batch, self.seen = prior_mean.copy(), 1, 0

    def enter(self, batch: int, discount: float) -> None:
        while self.batch < batch:
            self.batch += 1
            self.beta = np.linalg.solve(self.lam, self.eta)
            if (np.diag(self.lam) * discount >= self.floor).all():
                self.lam, self.eta = self.lam * discount, self.eta * discount

    def step(self, x: np.ndarray, y: np.ndarray, offset: np.ndarray) -> np.ndarray:
        pred = x @ self.beta + offset
        self.lam, self.eta = self.lam + x.T @ x, self.eta + x.T @ (y - offset)
        self.seen += len(y)
        return pred

    def pack(self) -> list[float]:
        return [float(x) for x in (*self.lam.ravel(), *self.eta, *self.beta, *self.floor, self.batch, self.seen)]

    @classmethod
    def unpack(cls, v: list[float], k: int) -> State:
        out = cls.__new__(cls)
        v = np.array(v)
        out.lam, out.eta, out.beta, out.floor = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[k * k + k : k * k + 2 * k], v[k * k + 2 * k : k * k + 3 * k]
        out.batch, out.seen = int(v[-2]), int(v[-1])
        return out


def predict_batches(obs: DataFrame, item: str, order: list[str], features: str, y: str, per_batch: int, batches: int | None, prior_mean: list[float], prior_var: float, discount: float = 1.0, offset: str | None = None) -> DataFrame:
    """(item, order..., batch, y, pred); rows beyond the last batch go, without `batches` (None) none does.

    A batch enters only through its sums x x' and x (y - offset), so what follows one another for an item is one small row a batch; rows
    then meet the coefficients of their batch in a join.
    """
    k, whole = len(prior_mean), batches if batches is not None else (1 << 31) // per_batch - 1
    rows = batched(obs, item, order, per_batch, whole).select(item, *order, "batch", F.col(features).alias("x"), F.col(y).cast("double").alias("y"), (F.col(offset) if offset else F.lit(0.0)).alias("o"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = lambda i: F.col("x")[i]
    sums = rows.groupBy(item, "batch").agg(*(F.sum(x(i) * x(j)).alias(f"l{i}_{j}") for i, j in pairs), *(F.sum(x(i) * (F.col("y") - F.col("o"))).alias(f"e{i}") for i in range(k)))
    kinds = dict(rows.dtypes)
    prior, precision, upper = np.array(prior_mean, float), np.eye(k) / prior_var, np.triu_indices(k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch")
        state, betas = State(prior, precision), []
        own, right = pdf[[f"l{i}_{j}" for i, j in pairs]].to_numpy(float), pdf[[f"e{i}" for i in range(k)]].to_numpy(float)
        for b, tri, eta in zip(pdf["batch"], own, right):
            state.enter(int(b), discount)
            betas.append(state.beta.copy())
            lam = np.zeros((k, k))
            lam[upper] = lam.T[upper] = tri
            state.lam, state.eta = state.lam + lam, state.eta + eta
        return pd.DataFrame({item: pdf[item].to_numpy(), "batch": pdf["batch"].to_numpy(), "beta": betas})

    found = sums.groupBy(item).applyInPandas(run, f"{item} {kinds[item]}, batch {kinds['batch']}, beta array<double>")
    pred = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("o")
    return rows.join(found, [item, "batch"]).select(item, *order, "batch", "y", pred.alias("pred"))


def predict_stream(stream: DataFrame, item: str, order: str, features: str, y: str, per_batch: int, prior_mean: list[float], prior_var: float, discount: float = 1.0) -> DataFrame:
    """The same over a stream: state survives between micro-batches, batch bounds count the item's rows. Rows must arrive in order across micro-batches."""
    k = len(prior_mean)
    kinds = dict(stream.dtypes)
    prior, precision = np.array(prior_mean, float), np.eye(k) / prior_var

    def run(key: tuple, parts: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = State.unpack(list(store.get[0]), k) if store.exists else State(prior, precision)
        rows = pd.concat(list(parts)).sort_values(order)
        preds, first = [], 0
        while first < len(rows):
            room = per_batch - state.seen % per_batch
            part = rows.iloc[first : first + room]
            state.enter(state.seen // per_batch + 1, discount)
            preds.append(state.step(np.stack(part[features].to_numpy()), part[y].to_numpy().astype(float), np.zeros(len(part))))
            first += room
        store.update((state.pack(),))
        yield pd.DataFrame({item: rows[item].to_numpy(), order: rows[order].to_numpy(), "y": rows[y].to_numpy().astype(float), "pred": np.concatenate(preds)})

    return stream.groupBy(item).applyInPandasWithState(run, f"{item} {kinds[item]}, {order} {kinds[order]}, y double, pred double", "state array<double>", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window with a watermark, for tables and streams alike."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = (stream.withWatermark(time, late) if stream.isStreaming else stream).groupBy(window.alias("w"), by)
    return out.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
