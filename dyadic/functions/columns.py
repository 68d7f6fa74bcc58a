"""Scalar functions as Spark column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Lanczos approximation with g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log1p_exp(x: Column) -> Column:
    """log(1 + e^x) that overflows for no x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bound_weight(xi: Column) -> Column:
    """tanh(xi / 2) / (4 xi), the weight of the quadratic bound on the logistic function; 1/8 at 0."""
    return F.when(F.abs(xi) < 1e-12, F.lit(0.125)).otherwise(F.tanh(xi / 2) / (4 * xi))


def spline_link(a: float, eta: Column) -> Column:
    """A logistic curve with value a at 0 and slopes that fit on both sides; a = 1/2 is the ordinary one."""
    low = 2 * a / (1 + F.exp(-2 * (1 - a) * eta))
    high = 2 * a - 1 + 2 * (1 - a) / (1 + F.exp(-2 * a * eta))
    return F.when(eta < 0, low).otherwise(high)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def strictly_within(x: Column, low: float, high: float) -> Column:
    return (x > low) & (x < high)


def beta_size_from_var(mean: Column, var: Column) -> Column:
    """alpha + beta of a Beta distribution; infinite without variance."""
    return F.when(var == 0, F.lit(math.inf)).otherwise(mean * (1 - mean) / var - 1)


def beta_var(mean: Column, size: Column) -> Column:
    return mean * (1 - mean) / (size + 1)


def beta_rho(size: Column) -> Column:
    """Correlation of two draws that share a rate; 0 for an infinite size."""
    return 1 / (size + 1)


def beta_size_from_rho(rho: Column) -> Column:
    return F.when(rho == 0, F.lit(math.inf)).otherwise(1 / rho - 1)


def beta_cv(mean: Column, size: Column) -> Column:
    return F.sqrt(beta_var(mean, size)) / mean


def lgamma(x: Column) -> Column:
    """log Gamma for x > 0."""
    # Below 1/2 the recurrence moves the argument up.
    shift = F.when(x < 0.5, F.log(x)).otherwise(F.lit(0.0))
    z = F.when(x < 0.5, x).otherwise(x - 1)
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + k)
    t = z + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series) - shift


def rising_log_sum(a: Column, n: Column) -> Column:
    """log a + log(a + 1) + ... (n terms), exact for any a > 0; long runs through log Gamma."""
    n = n.cast("int")
    terms = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, j: s + F.log(a + j))
    return F.when(n <= 0, F.lit(0.0)).when(n <= 64, terms).otherwise(lgamma(a + n) - lgamma(a))


def log_choose(n: Column, x: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(x + 1.0) - lgamma(n - x + 1.0)


def betabinom_loglik(x: Column, n: Column, mean: Column, size: Column, choose: bool = True) -> Column:
    alpha = mean * size
    out = rising_log_sum(alpha, x) + rising_log_sum(size - alpha, n - x) - rising_log_sum(size, n)
    return out + log_choose(n, x) if choose else out


def betabinom_cdf(x: Column, n: Column, mean: Column, size: Column) -> Column:
    """P(X <= x): one term follows from the last by a ratio, in a fold over 0..x."""
    alpha = mean * size
    beta = size - alpha
    first = F.exp(rising_log_sum(beta, n) - rising_log_sum(size, n))

    def step(s: Column, i: Column) -> Column:
        term = s["t"] * ((i + alpha) * (n - i)) / ((i + 1) * (beta + n - i - 1))
        return F.struct(term.alias("t"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0), x.cast("int") - 1), F.struct(first.alias("t"), first.alias("sum")), step, lambda s: s["sum"])
    return F.when(x < 0, F.lit(0.0)).when(x >= n, F.lit(1.0)).when(x == 0, first).otherwise(total)


def dot(*vectors: Column) -> Column:
    """Sum over places of the product of two or more arrays."""
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda a, b: a * b)
    return F.aggregate(out, F.lit(0.0), lambda s, x: s + x)


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def bilinear(u: Column, m: Column, v: Column) -> Column:
    return dot(u, matvec(m, v))


def quadratic(m: Column, v: Column) -> Column:
    return bilinear(v, m, v)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    """Entries over their sum; zeros if the sum is 0."""
    total = array_sum(a)
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(total, F.size(a)).alias("t")), lambda p: F.when(p["t"] != 0, p["x"] / p["t"]).otherwise(0.0))


def repeated(value: Column, times: int) -> Column:
    return F.array_repeat(value, times)


def scaled_identity(scale: Column, n: int) -> Column:
    return F.array(*(F.array(*(scale if i == j else F.lit(0.0) for j in range(n))) for i in range(n)))


def inverse_2x2(m: Column) -> Column:
    """Inverse of a symmetric 2 x 2 array of arrays in closed form."""
    a, b, d = m[0][0], m[0][1], m[1][1]
    det = a * d - b * b
    return F.array(F.array(d / det, -b / det), F.array(-b / det, a / det))


def context_slice(factors: Column, context: Column, width: int) -> Column:
    """The block of a context (from 1 on) in an array of local factors."""
    return F.slice(factors, (context - 1) * width + 1, width)


def context_of(place: Column, width: int) -> Column:
    """The context (from 1 on) that a factor's place (from 1 on) belongs to."""
    return F.floor((place - 1) / width) + 1


def linear_index(places: list[Column], sizes: list[int]) -> Column:
    """A number for a tuple of places (from 0 on), the first one fastest."""
    out, step = F.lit(0).cast("long"), 1
    for p, n in zip(places, sizes):
        out, step = out + p * step, step * n
    return out


def index_places(index: Column, sizes: list[int]) -> list[Column]:
    out, step = [], 1
    for n in sizes:
        out.append(F.pmod(F.floor(index / step), F.lit(n)).cast("long"))
        step *= n
    return out


def format_timestamp(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "America/Los_Angeles") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), pattern)


def parse_timestamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "America/Los_Angeles") -> Column:
    """Seconds since 1970; null for text that doesn't fit the pattern."""
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone))
