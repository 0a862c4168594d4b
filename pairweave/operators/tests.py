"""Multiplicity, agreement, resampling and rank tests over DataFrames."""

from __future__ import annotations

from math import lgamma, log, pi
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from .scans import RANGE_ROWS, scanned


def adjusted(
    df: DataFrame, p: str, key: str, family: list[str] | None = None, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``holm`` (running maximum of (m - rank) * p) and ``bh`` (running minimum from the largest), ties by ``key``.

    All families are adjusted at once, by scans: no family is in a single task. ``df`` is read several times: write what is
    dear to compute.
    """
    by, one, m, rank = family or [], F.lit(1.0), F.col("_m"), F.col("_rank")
    count = F.lit(1).cast("long")
    ranked = scanned(df, by, [p, key], {"_rank": ("sum", count), "_m": ("onward sum", count)}, range_rows)
    ranked = ranked.withColumn("_m", m + rank - 1)
    each = {"holm": ("max", F.least(one, (m - rank + 1) * F.col(p))), "bh": ("onward min", F.least(one, F.col(p) * m / rank))}
    return scanned(ranked, by, [p, key], each, range_rows).select(*df.columns, "holm", "bh")


def sign_test(df: DataFrame, difference: Column, by: list[str] | None = None) -> DataFrame:
    """positive, negative, tied and the one-sided p of the signs, ties left out."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(difference > 0).alias("positive"), F.count_if(difference < 0).alias("negative"),
        F.count_if(difference == 0).alias("tied"),
    )
    return counts.withColumn("p", stats.upper_tail(F.col("positive"), F.col("positive") + F.col("negative")))


def kappa_of(df: DataFrame, a: str, b: str, certain: float | None = 1.0) -> DataFrame:
    """n, agree and Cohen's kappa of two label columns; rows with a null label are left out."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"),
    ).agg(F.count("*").alias("n"))
    margins = cells.select(F.col("a").alias("v"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")).union(
        cells.select("b", F.lit(0).cast("long"), "n")
    )
    products = margins.groupBy("v").agg((F.sum("na").cast("double") * F.sum("nb")).alias("product")).agg(
        F.sum("product").alias("expected")
    )
    total = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agree"),
    )
    # Both sides are one row.
    return total.withColumn("_one", F.lit(1)).join(products.withColumn("_one", F.lit(1)), "_one").select(
        "n", "agree", stats.kappa(F.col("n"), F.col("agree"), F.col("expected"), certain).alias("kappa"),
    )


def binary_kappa(df: DataFrame, a: str, b: str, classes: tuple[str, str], certain: float | None = 1.0) -> DataFrame:
    """``kappa_of`` on the rows where both labels are one of two classes, with how many other rows there were (``excluded``)."""
    both = F.col(a).isin(*classes) & F.col(b).isin(*classes)
    excluded = df.agg(F.count_if(~F.coalesce(both, F.lit(False)))).scalar()
    return kappa_of(df.where(both), a, b, certain).withColumn("excluded", excluded)


def leave_one_out(groups: DataFrame, group: str, counts: list[str]) -> DataFrame:
    """For each group (one row each), the sums of the counts over all other groups: totals minus its own, no pairs of groups."""
    whole = Window.partitionBy(F.lit(0))
    return groups.select(group, *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in counts])


def leave_two_out(groups: DataFrame, group: str, counts: list[str]) -> DataFrame:
    """The same for each two groups (a dimension table of a few rows)."""
    whole = Window.partitionBy(F.lit(0))
    totals = groups.select(group, *counts, *[F.sum(c).over(whole).alias(f"_{c}") for c in counts])
    other = groups.select(F.col(group).alias("_g"), *[F.col(c).alias(f"o_{c}") for c in counts])
    return totals.join(other, F.col(group) < F.col("_g")).select(
        F.col(group).alias("first_out"), F.col("_g").alias("second_out"),
        *[(F.col(f"_{c}") - F.col(c) - F.col(f"o_{c}")).alias(c) for c in counts],
    )


#: Pairs up to which a signed-rank p is exact.
EXACT_PAIRS = 50


def signed_rank_p(doubled: list[int], w_plus: int) -> float:
    """Twice the smaller tail, at most 1, of the sum of ranks whose signs are fair coins; all ranks and the sum are doubled.

    ``chances[s]``: of all subsets of the ranks so far, the share with sum s.
    """
    chances = np.zeros(sum(doubled) + 1)
    chances[0], reach = 1.0, 0
    for rank in doubled:
        reach += rank
        chances[rank : reach + 1] += chances[: reach + 1 - rank].copy()
        chances *= 0.5
    return min(1.0, 2 * min(chances[: w_plus + 1].sum(), chances[w_plus:].sum()))


def wilcoxon(
    df: DataFrame, difference: str, by: list[str], least: int = 5, exact: int = EXACT_PAIRS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """n, w_plus, z and p of the signed-rank test: zeros left out, average ranks for ties, two-sided p.

    With at most ``exact`` pairs p is exact, from the distribution of the sum of these very ranks under fair signs, ties
    included; with more it is the normal p with tie correction. z and p are null under ``least`` pairs. Sizes are ranked by a scan, so
    that no group is in one task; of a group, at most ``exact`` ranks come together.
    """
    d = df.where((F.col(difference) != 0) & F.col(difference).isNotNull()).withColumn("_abs", F.abs(difference))
    sizes = d.groupBy(*by, "_abs").agg(F.count("*").alias("_ties"), F.count_if(F.col(difference) > 0).alias("_up"))
    upto = scanned(sizes, by, ["_abs"], {"_upto": ("sum", F.col("_ties"))}, range_rows)
    t, doubled = F.col("_ties").cast("double"), 2 * F.col("_upto") - F.col("_ties") + 1
    few = F.when(F.col("_upto") <= exact, F.struct(doubled.alias("rank"), F.col("_ties").alias("ties")))
    sums = upto.groupBy(*by).agg(
        F.sum("_ties").alias("n"), F.sum(F.col("_up") * doubled).alias("_doubled"), F.sum(t * (t * t - 1)).alias("_t"),
        F.collect_list(few).alias("_ranks"),
    )

    @F.arrow_udf("double")
    def exact_p(ranks: pa.Array, doubled: pa.Array) -> pa.Array:
        both = zip(ranks.to_pylist(), doubled.to_pylist(), strict=True)
        every = [None if x is None else signed_rank_p([r["rank"] for r in x for _ in range(r["ties"])], w) for x, w in both]
        return pa.array(every, pa.float64())

    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    out = sums.withColumn("w_plus", F.col("_doubled") / 2).withColumn("z", F.when(n >= least, z))
    p = F.coalesce(exact_p(F.when((F.col("n") <= exact) & (n >= least), F.col("_ranks")), F.col("_doubled")), stats.normal_two_sided(F.col("z")))
    return out.withColumn("p", p).select(*by, "n", "w_plus", "z", "p")


#: Discordant counts whose chances are added up; where more are likely, as many evenly spaced ones stand for all.
POWER_COUNTS = 4_096


def critical_values(d: np.ndarray, alpha: float) -> np.ndarray:
    """The least k with P(X >= k) <= alpha for X ~ Binomial(d, 1/2), from a normal guess by steps of one; d + 1 where there is none."""
    k = np.clip(np.rint(d / 2 + NormalDist().inv_cdf(1 - alpha) * np.sqrt(d) / 2 + 0.5), 0, d + 1)
    holds = lambda k, at: (k > d[at]) | (stats.tail(k, d[at], 0.5, True) <= alpha)
    at = np.arange(len(d))
    while len(at):
        at = at[holds(k[at] - 1, at)]
        k[at] -= 1
    at = np.arange(len(d))
    while len(at):
        at = at[~holds(k[at], at)]
        k[at] += 1
    return k


def power_of(n: int, q: float, share: float, alpha: float) -> float:
    """Power with n pairs, each discordant with chance q, and b among those with chance ``share``."""
    width = 9 * (n * q * (1 - q)) ** 0.5 + 40  # what is outside has a chance under 1e-15
    low, high = max(1.0, np.floor(n * q - width)), min(float(n), np.ceil(n * q + width))
    if n < 1 or low > high:
        return 0.0
    d = np.unique(np.rint(np.linspace(low, high, int(min(high - low + 1, POWER_COUNTS)))))
    # Logarithms of the counts' chances but for a constant: of the distance from n q, and the density's square root.
    off = (d - n * q) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        log_weight = -d * np.log1p(off / q) - np.where(d < n, (n - d) * np.log1p(-off / (1 - q)) if q < 1 else 0.0, 0.0)
    log_weight += _stirling_rest(n, d)
    weight = np.exp(log_weight - log_weight.max())
    none = 0.0 if low > 1 else np.exp(n * np.log1p(-q) - log_weight.max() - _stirling_constant(n)) if q < 1 else 0.0
    reach = stats.tail(critical_values(d, alpha), d, share, True)
    return float((weight * reach).sum() / (weight.sum() + none))


def _correction(x: np.ndarray) -> np.ndarray:
    """ln x! less x ln x - x + ln(2 pi x) / 2, for x >= 1."""
    big = np.maximum(x, 16.0)
    series = 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    few = np.array([0.0] + [lgamma(i + 1) - i * log(i) + i - log(2 * pi * i) / 2 for i in range(1, 16)])
    return np.where(x < 16, few[np.minimum(x, 15).astype(int)], series)


def _stirling_constant(n: int) -> float:
    return float(_correction(np.array([float(n)]))[0]) - 0.5 * log(2 * pi) + 0.5 * log(n)


def _stirling_rest(n: int, d: np.ndarray) -> np.ndarray:
    """What ln C(n, d) has beside n ln n - d ln d - (n - d) ln (n - d) and a constant of n."""
    rest = n - d
    out = -0.5 * np.log(d) - _correction(d)
    inner = rest > 0
    out[inner] -= 0.5 * np.log(rest[inner]) + _correction(rest[inner])
    out[~inner] += 0.5 * log(2 * pi)
    return out


def mcnemar_power(pairs: Column, discordance: Column, share: Column, alpha: float = 0.05) -> Column:
    """Power of the one-sided exact test: a mixture over the number of discordant pairs of the chance to reach its critical value.

    The work for a row is bounded, for any number of pairs: only numbers of discordant pairs with a chance worth adding are
    taken, at most ``POWER_COUNTS`` of them (all, up to some 200,000 pairs).
    """

    @F.arrow_udf("double")
    def run(pairs: pa.Array, discordance: pa.Array, share: pa.Array) -> pa.Array:
        rows = zip(pairs.to_pylist(), discordance.to_pylist(), share.to_pylist(), strict=True)
        return pa.array([None if None in x else power_of(*x, alpha) for x in rows], pa.float64())

    return run(pairs.cast("long"), discordance.cast("double"), share.cast("double"))
