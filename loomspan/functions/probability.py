"""Distribution functions: vectorised pandas UDFs where a tail needs a loop, Column expressions otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def poisson_pmf_values(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    lg = np.array([math.lgamma(v + 1) for v in k])
    with np.errstate(divide="ignore"):
        return np.where(rate > 0, np.exp(k * np.log(np.where(rate > 0, rate, 1.0)) - rate - lg), (k == 0).astype(float))


def poisson_cdf_values(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Sum of the pmf from 0 to k, term by term from the previous one."""
    out = np.zeros(len(k))
    if not len(k):
        return out
    order = np.argsort(k)
    log_term, total, at = -np.asarray(rate, float), np.exp(-np.asarray(rate, float)), 0
    with np.errstate(divide="ignore"):
        log_rate = np.where(rate > 0, np.log(np.where(rate > 0, rate, 1.0)), -np.inf)
    live = order
    out[order[k[order] < 0]] = 0.0
    live = order[k[order] >= 0]
    while len(live):
        done = live[k[live] == at]
        out[done] = total[done]
        live = live[k[live] > at]
        at += 1
        log_term[live] += log_rate[live] - math.log(at)
        total[live] += np.exp(log_term[live])
    return np.minimum(out, 1.0)


def scan_p_values(count: np.ndarray, rate: np.ndarray, window: np.ndarray, total: np.ndarray) -> np.ndarray:
    """P-value of ``count`` in a window of a scan over ``total`` positions with ``rate`` per position; 1 for counts up to 2."""
    mean = rate * window
    k = np.maximum(count, 1)
    a = (k - mean) / k * (rate * (total - window) * poisson_pmf_values(k - 1, mean))
    p = np.abs(1 - poisson_cdf_values(count - 1, mean) * np.exp(-a))
    return np.where(count <= 2, 1.0, np.minimum(p, 1.0))


def hypergeometric_tail_values(total: np.ndarray, marked: np.ndarray, drawn: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Sum of the pmf from ``hits`` up to, not including, the largest possible number of hits; 1 for no hits or an empty set."""
    lg = _log_factorials(int(total.max()) if len(total) else 0)
    choose = lambda n, k: lg[n] - lg[k] - lg[n - k]
    out = np.ones(len(total))
    for i, (n, m, d, k) in enumerate(zip(total, marked, drawn, hits)):
        if k > 0 and m > 0 and d > 0:
            j = np.arange(k, min(m, d))
            j = j[(d - j <= n - m) & (d - j >= 0)]
            out[i] = np.exp(choose(m, j) + choose(n - m, d - j) - choose(n, d)).sum() if len(j) else 0.0
    return out


@F.pandas_udf(T.DoubleType())
def poisson_cdf(k: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(poisson_cdf_values(k.to_numpy(), rate.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def scan_p_value(count: pd.Series, rate: pd.Series, window: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series(scan_p_values(count.to_numpy(), rate.to_numpy(float), window.to_numpy(float), total.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(total: pd.Series, marked: pd.Series, drawn: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series(hypergeometric_tail_values(*(x.to_numpy(np.int64) for x in (total, marked, drawn, hits))))


@F.pandas_udf(T.DoubleType())
def error_function(x: pd.Series) -> pd.Series:
    return x.map(math.erf)


def skellam_tail_values(k: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smaller of P(X <= k) and P(X >= k) for X the difference of two Poisson variables with rates ``first`` and ``second``, both above 0."""
    out = np.empty(len(k))
    for n, (x, a, b) in enumerate(zip(k, first, second)):
        top = int(np.ceil(b + 12 * np.sqrt(b) + 40))
        j = np.arange(top + 1)
        share = poisson_pmf_values(j, np.full(len(j), b))
        reach = int(x) + j  # the first variable that makes the difference k
        below = np.where(reach >= 0, poisson_cdf_values(np.maximum(reach, 0), np.full(len(j), a)), 0.0)
        at = np.where(reach >= 0, poisson_pmf_values(np.maximum(reach, 0), np.full(len(j), a)), 0.0)
        left = float(share @ below)
        out[n] = min(left, 1 - left + float(share @ at))
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def skellam_tail(k: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series(skellam_tail_values(k.to_numpy(), first.to_numpy(float), second.to_numpy(float)))


def poisson_pmf(k: Column, rate: Column) -> Column:
    """exp(k ln(rate) - rate - ln k!)."""
    return F.exp(k * F.log(rate) - rate - _log_factorial(k))


def _log_factorial(k: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))


def critical_value(rate: float, window: float, total: float, alpha: float, most: int = 100_000) -> int:
    """The first count whose scan p-value is below alpha."""
    for lo in range(1, most, 256):
        k = np.arange(lo, lo + 256)
        p = scan_p_values(k, np.full(256, rate), np.full(256, window), np.full(256, total))
        if (p < alpha).any():
            return int(k[p < alpha][0])
    raise ValueError("no count is below alpha")


#: Metrics on two arrays of doubles.
def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def trinary_hamming(a: Column, b: Column, threshold: float) -> Column:
    """Number of places whose values, each taken as up, down or neither by the threshold, differ."""
    tri = lambda v: F.when(v > threshold, 1).when(v < -threshold, -1).otherwise(0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (tri(x) != tri(y)).cast("int")), F.lit(0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, w: s + w)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
