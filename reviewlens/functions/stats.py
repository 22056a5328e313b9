"""Statistics and scoring functions as columns (pandas UDFs only where Spark has no built-in)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Band names in order, and the display name of each signal.
BANDS = ("clean", "mostly-clean", "mixed", "doubtful", "heavily-manipulated")
SIGNALS = {
    "ratingDeconvolution": "rating shape",
    "temporalBurst": "arrival timing",
    "verificationConcentration": "verification pattern",
    "textNearDuplication": "duplicate text",
    "listingDrift": "different product",
    "reviewerGraph": "reviewer network",
}


def poisson_quantiles(rate: np.ndarray, p: float = 0.99) -> np.ndarray:
    """Smallest k with P(X <= k) >= p for each rate, summed in log space so that large rates don't underflow; 0 for rate 0."""
    rate = np.asarray(rate, dtype=float)
    out = np.zeros(len(rate), np.int64)
    live = np.flatnonzero(rate > 0)
    log_rate = np.log(rate[live])
    log_term = -rate[live]
    total = np.exp(log_term)
    k = 0
    while len(live):
        done = total >= p
        out[live[done]] = k
        live, log_rate, log_term, total = live[~done], log_rate[~done], log_term[~done], total[~done]
        k += 1
        log_term = log_term + log_rate - math.log(k)
        total = total + np.exp(log_term)
        # rounding may hold the sum just under p far above the rate
        stuck = k > rate[live] + 60 * np.sqrt(rate[live]) + 60
        out[live[stuck]] = k
        live, log_rate, log_term, total = live[~stuck], log_rate[~stuck], log_term[~stuck], total[~stuck]
    return out


@F.pandas_udf(T.LongType())
def poisson_quantile(rate: pd.Series) -> pd.Series:
    """The 0.99 quantile of a Poisson variable."""
    unique, inverse = np.unique(rate.fillna(0).to_numpy(float), return_inverse=True)
    return pd.Series(poisson_quantiles(unique)[inverse]).where(rate.notna().to_numpy())


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def overlap_pvalue_of(n: int, a: int, b: int, overlap: int) -> float:
    """P(at least ``overlap`` common products) of two reviewers with a and b of n products."""
    if overlap <= 0:
        return 1.0
    base = _log_choose(n, b)
    tail = [math.exp(_log_choose(a, x) + _log_choose(n - a, b - x) - base) for x in range(max(overlap, a + b - n), min(a, b) + 1)]
    return min(1.0, math.fsum(tail))


@F.pandas_udf(T.DoubleType())
def overlap_pvalue(n: pd.Series, a: pd.Series, b: pd.Series, overlap: pd.Series) -> pd.Series:
    """``overlap_pvalue_of`` of each row; equal arguments are computed once."""
    seen: dict[tuple, float] = {}
    out = []
    for args in zip(n, a, b, overlap, strict=True):
        if args not in seen:
            seen[args] = overlap_pvalue_of(*map(int, args))
        out.append(seen[args])
    return pd.Series(out)


def edge_weight(p: Column) -> Column:
    """-log10 of a p-value, at most 300."""
    return F.when(p <= 0, 300.0).otherwise(F.least(-F.log10(p), F.lit(300.0)))


def disparity_alpha(share: Column, degree: Column) -> Column:
    """Significance of an edge that has this share of a node's strength; 0 for a node of degree 1."""
    return F.when(degree <= 1, 0.0).otherwise(F.pow(1 - share, degree - 1))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def quantile_value(sketch: list[float], at: Column) -> Column:
    """Linear interpolation in a quantile sketch at a fraction (clamped)."""
    last = len(sketch) - 1
    points = F.array(*[F.lit(float(v)) for v in sketch])
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)) * last
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.lit(last))
    weight = place - low
    return F.get(points, low) * (1 - weight) + F.get(points, high) * weight


def piecewise(points: list[tuple[float, float]], x: Column) -> Column:
    """Piecewise linear through sorted points, constant beyond the ends; x itself without points."""
    if not points:
        return x
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 > x0:
            out = out.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(points[-1][1]))


def band(p: Column) -> Column:
    """The band of a probability: equal fifths."""
    place = F.least(F.lit(len(BANDS) - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * len(BANDS)).cast("int"))
    return F.when(p.isNotNull(), F.get(F.array(*[F.lit(b) for b in BANDS]), place))


def strength(value: Column, weak: float, moderate: float) -> Column:
    """none, weak, moderate or strong."""
    return F.when(value.isNull(), "none").when(value < weak, "weak").when(value < moderate, "moderate").otherwise("strong")


def uniform(*parts: Column) -> Column:
    """A portable uniform draw in [0, 1): the first 52 bits of a SHA-256 over the parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def half_up(x: Column) -> Column:
    """Rounded, halves up."""
    return F.floor(x + 0.5)
