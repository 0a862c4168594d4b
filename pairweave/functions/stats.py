"""Exact tests and intervals as columns (b and n are counts; null counts give null).

Binomial tails are incomplete beta functions. Both sides of the beta density are integrated on a fixed number of points
over the range where it is not negligible, relative to its mode: the work for a row is the same for any n, nothing
underflows, and small tails keep their relative precision. A batch of rows is computed at once with numpy.
"""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gauss-Legendre points and weights on [0, 1], on each of PANELS equal parts of a range.
_POINTS, _WEIGHTS = (lambda x, w: ((x + 1) / 2, w / 2))(*np.polynomial.legendre.leggauss(10))
PANELS = 24
#: The density's range ends where it has fallen by this power of e.
FALL = 45.0


class _Beta:
    """The density t^a (1 - t)^b over its value at the mode, for arrays a, b >= 0."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.mode = np.where(a + b > 0, a / np.maximum(a + b, 1), 0.5)
        self.whole = self.side(self.mode, -1) + self.side(self.mode, 1)

    def log(self, t: np.ndarray) -> np.ndarray:
        a, b, m = ((x[:, None] if t.ndim == 2 else x) for x in (self.a, self.b, self.mode))
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(a > 0, a * np.log1p((t - m) / np.where(m > 0, m, 1)), 0.0)
            right = np.where(b > 0, b * np.log1p((m - t) / np.where(m < 1, 1 - m, 1)), 0.0)
        return left + right

    def side(self, x: np.ndarray, way: int) -> np.ndarray:
        """The integral from x down to 0 (way -1) or up to 1."""
        at, end = self.log(x), np.where(way < 0, 0.0, 1.0)
        near, far = np.zeros_like(x), np.abs(end - x)
        falls = at - self.log(x + way * far) > FALL
        for _ in range(60):  # where the density has fallen enough
            middle = (near + far) / 2
            enough = falls & (at - self.log(x + way * middle) > FALL)
            near, far = np.where(falls & ~enough, middle, near), np.where(enough, middle, far)
        places = ((np.arange(PANELS)[:, None] + _POINTS) / PANELS).ravel()
        values = np.exp(self.log(x[:, None] + way * far[:, None] * places))
        return far * (values * np.tile(_WEIGHTS, PANELS)).sum(1) / PANELS

    def tails(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shares below and above x; the smaller is not a difference."""
        below = x <= self.mode
        share = np.where(below, self.side(x, -1), self.side(x, 1)) / self.whole
        return np.where(below, share, 1 - share), np.where(below, 1 - share, share)


def tail(b: np.ndarray, n: np.ndarray, p: np.ndarray | float, upper: bool) -> np.ndarray:
    """P(X >= b) or P(X <= b) for X ~ Binomial(n, p), elementwise."""
    if not upper:
        return tail(n - b, n, 1 - np.asarray(p, dtype=np.float64), True)
    out = np.where((n <= 0) | (b <= 0), 1.0, 0.0)
    inner = np.flatnonzero((b > 0) & (b <= n))
    if len(inner):
        p = np.broadcast_to(np.asarray(p, dtype=np.float64), b.shape)[inner]
        out[inner] = _Beta(b[inner] - 1.0, n[inner] - b[inner] + 0.0).tails(p)[0]
    return np.clip(out, 0.0, 1.0)


def bound(x: np.ndarray, n: np.ndarray, alpha: float, upper: bool) -> np.ndarray:
    """The Clopper-Pearson bound of ``x`` of ``n`` (n > 0), elementwise."""
    out = np.full(len(x), 1.0 if upper else 0.0)
    inner = np.flatnonzero(x < n if upper else x > 0)
    if len(inner):
        x, n = x[inner], n[inner]
        # Upper: P(X <= x) = alpha, the share above p of the density with a = x; lower: P(X >= x), that below with a = x - 1.
        density = _Beta(x + 0.0, n - x - 1.0) if upper else _Beta(x - 1.0, n - x + 0.0)
        low, high = np.zeros(len(x)), np.ones(len(x))
        for _ in range(60):
            p = (low + high) / 2
            below, above = density.tails(p)
            less = above > alpha if upper else below < alpha
            low, high = np.where(less, p, low), np.where(less, high, p)
        out[inner] = (low + high) / 2
    return out


def _counted(run, x: Column, n: Column) -> Column:
    """``run`` over the counts of the rows where neither is null."""

    @F.arrow_udf("double")
    def over(x: pa.Array, n: pa.Array) -> pa.Array:
        known = np.asarray(pc.and_(x.is_valid(), n.is_valid()), dtype=bool)
        a, b = (v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) for v in (x, n))
        out = np.zeros(len(a))
        if known.any():
            out[known] = run(a[known], b[known])
        return pa.array(out, mask=~known)

    return over(x.cast("bigint"), n.cast("bigint"))


def upper_tail(b: Column, n: Column) -> Column:
    """P(X >= b) for X ~ Binomial(n, 1/2): the one-sided exact p; 1 for n = 0."""
    return _counted(lambda b, n: tail(b, n, 0.5, True), b, n)


def lower_tail(b: Column, n: Column) -> Column:
    """P(X <= b) for X ~ Binomial(n, 1/2); 1 for n = 0."""
    return _counted(lambda b, n: tail(b, n, 0.5, False), b, n)


def two_sided(b: Column, n: Column, empty: float | None = 1.0) -> Column:
    """Twice the smaller tail, at most 1; ``empty`` for n = 0 (1.0 or NaN, as a report asks)."""
    # The smaller tail of a symmetric distribution is that of the rarer side.
    twice = _counted(lambda b, n: np.minimum(1.0, 2 * tail(np.maximum(b, n - b), n, 0.5, True)), b, n)
    return F.when(n == 0, F.lit(empty)).otherwise(twice)


def clopper_pearson_upper(x: Column, n: Column, alpha: float = 0.05, empty: float | None = 1.0) -> Column:
    """The one-sided upper bound; ``empty`` for n = 0."""
    return F.when(n == 0, F.lit(empty)).otherwise(_counted(lambda x, n: bound(x, n, alpha, True), x, n))


def clopper_pearson_lower(x: Column, n: Column, alpha: float = 0.05, empty: float | None = 0.0) -> Column:
    """The one-sided lower bound; ``empty`` for n = 0."""
    return F.when(n == 0, F.lit(empty)).otherwise(_counted(lambda x, n: bound(x, n, alpha, False), x, n))


def log_choose(n: Column, k: Column) -> Column:
    """ln of the binomial coefficient, null outside 0 <= k <= n: that of C(n, k) = 1 / ((n + 1) B(k + 1, n - k + 1))."""

    def run(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        density = _Beta(k, n - k)
        peak = np.where(k > 0, k * np.log(np.maximum(density.mode, 1e-300)), 0.0) + np.where(
            n > k, (n - k) * np.log1p(-np.minimum(density.mode, 1 - 1e-16)), 0.0,
        )
        return -np.log(n + 1) - np.log(density.whole) - peak

    inside = (k >= 0) & (k <= n)
    return _counted(run, F.when(inside, k), F.when(inside, n))


def normal_two_sided(z: Column) -> Column:
    """The two-sided p of a standard normal deviate."""
    @F.arrow_udf("double")
    def run(z: pa.Array) -> pa.Array:
        return pa.array([None if x is None else erfc(abs(x) / sqrt(2)) for x in z.to_pylist()], pa.float64())

    return run(z.cast("double"))


def kappa(n: Column, agree: Column, expected: Column, certain: float | None = 1.0) -> Column:
    """Cohen's kappa from the rows, the agreements and the sum of the margins' products.

    ``certain`` where chance agreement is 1; NaN without rows.
    """
    po, pe = agree / n, expected / (n * n)
    return F.when(n == 0, float("nan")).when(pe == 1, F.lit(certain)).otherwise((po - pe) / (1 - pe))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at round(q * (n - 1)), halves to even, of a sorted array."""
    return F.element_at(values, (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def index_interval(values: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The ends of a percentile interval: places int(a * n) and int((1 - a) * n) - 1 of a sorted array."""
    a = (1 - level) / 2
    low, high = F.floor(F.size(values) * a).cast("int") + 1, F.floor(F.size(values) * (1 - a)).cast("int")
    return F.element_at(values, low), F.element_at(values, high)


def percent_text(k: Column, n: Column, places: int = 1) -> Column:
    """k of n as a percentage with fixed places; a dash for n = 0."""
    return F.when(n == 0, "—").otherwise(
        F.concat(F.format_string(f"%.{places}f", F.round(100 * k / n, places)), F.lit("%"))
    )
