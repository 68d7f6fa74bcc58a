"""Small tables as text. Only bounded results: a limit of rows is taken before anything is collected."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def as_text(df: DataFrame, most: int = 100, number: str = "{:.4g}", latex: bool = False) -> str:
    """At most so many rows with aligned columns, or as the body of a LaTeX tabular."""
    show = lambda v: "" if v is None else number.format(v) if isinstance(v, float) else str(v)
    rows = [df.columns, *([show(v) for v in r] for r in df.limit(most).collect())]
    if latex:
        return "\n".join(" & ".join(r) + r" \\" for r in rows)
    width = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, width)) for r in rows)


def timed(fn: Callable[[], object], times: int = 1) -> tuple[object, float]:
    """The last result and the mean seconds of a call."""
    began, out = time.perf_counter(), None
    for _ in range(times):
        out = fn()
    return out, (time.perf_counter() - began) / max(times, 1)
