"""Bootstrap of clusters by multiplicities: how often each is drawn in a replicate, without a row for a draw.

The clusters of a group stand by key. A replicate draws as many as the group has, with replacement. How many of its draws
fall to a range of clusters is binomial, given how many fall to a range around it: the draws are halved over the tree of
blocks of clusters, then dealt out from cluster to cluster within a block. Each split inverts the binomial distribution at
a hash of seed, group, replicate and place, so that a task that holds a block finds its draws by itself, and the result is
the same at any parallelism.

In a group of more than a block, clusters stand by their counts instead, and those with equal counts are one run: what a
replicate adds up only depends on how many of its draws fall to the run, and that is binomial as well. So the work follows
the number of different counts, and no replicate is left out or drawn otherwise. (SQL repeats groups of one block.)

A row of a block and some replicates is one piece of work: its runs (at most ``BLOCK``) times its replicates (``AT_ONCE``)
numbers, in numpy. A task sums up what its pieces give to each replicate; those sums alone are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .scans import placed, scanned

BLOCK = 1 << 13
AT_ONCE = 2_500
#: Odd numbers that spread replicates and places over 32 bits, and the one that splits of blocks are marked with.
REPLICATE, PLACE, SPLIT = 0x9E3779B1, 0x85EBCA6B, 0x27D4EB2F
MIX, BITS32 = 0x45D9F3B, 0xFFFFFFFF
#: Means up to which a binomial quantile is found by adding up its masses from 0.
SMALL_MEAN = 40.0
#: Beyond, for draws up to so many, it is found in a table of masses, if that has at most so many for each number sought.
TABLED, TABLE_ENTRIES = 1 << 15, 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in which each bit depends on all."""
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX)) & np.uint64(BITS32)
    return x ^ (x >> np.uint64(16))


def streams(group: int, replicates: np.ndarray) -> np.ndarray:
    """One hash for each replicate of a group."""
    return mixed(np.uint64(group) ^ (replicates.astype(np.uint64) * np.uint64(REPLICATE) & np.uint64(BITS32)))


def uniform(stream: np.ndarray, place: int, salt: int = 0) -> np.ndarray:
    """A number in (0, 1) for each replicate at a place."""
    return (mixed(stream ^ np.uint64((place * PLACE ^ salt) & BITS32)).astype(np.float64) + 0.5) / 2.0**32


def quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The least k with P(X <= k) >= u for X ~ Binomial(n, p), elementwise in u and n."""
    if p >= 1.0:
        return n.copy()
    if n.max(initial=0) * p > SMALL_MEAN:
        return _quantile_of_many(u, n, p)
    k, odds = np.zeros(len(n), np.int64), p / (1 - p)
    mass = np.exp(n * np.log1p(-p))
    open_ = np.flatnonzero((u > mass) & (n > 0))
    mass, left, drawn = mass[open_], u[open_] - mass[open_], n[open_]
    step = 0
    while len(open_):
        step += 1
        mass = mass * (odds * (drawn - step + 1) / step)
        k[open_] = step
        left = left - mass
        more = (left > 0) & (drawn > step)
        if not more.all():
            open_, mass, left, drawn = open_[more], mass[more], left[more], drawn[more]
    return k


@cache
def _log_factorials() -> np.ndarray:
    return np.array([lgamma(i + 1) for i in range(TABLED + 1)])


def _quantile_by_table(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray | None:
    """From a row of masses for each different n, nine deviations wide; None where the rows are dearer than tails."""
    different, row = np.unique(n, return_inverse=True)
    deviation = np.sqrt(different * p * (1 - p))
    width = int(18 * deviation[-1]) + 6
    if different[-1] > TABLED or width * len(different) > TABLE_ENTRIES * len(u):
        return None
    base = np.maximum(0, np.floor(different * p - 9 * deviation - 2)).astype(np.int64)
    k, of = base[:, None] + np.arange(width), _log_factorials()
    most = different[:, None]
    least = np.minimum(k, most)
    mass = np.exp(of[most] - of[least] - of[most - least] + least * np.log(p) + (most - least) * np.log1p(-p))
    reach = np.cumsum(np.where(k <= most, mass, 0.0), axis=1)
    return np.minimum(base[row] + (reach[row] < u[:, None]).sum(axis=1), n)


def _quantile_of_many(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """From a table, or from a normal deviate with its first correction, by steps of one at exact tails."""
    if (found := _quantile_by_table(u, n, p)) is not None:
        return found
    z = np.fromiter(map(NormalDist().inv_cdf, u.tolist()), np.float64, len(u))
    guess = np.rint(n * p + z * np.sqrt(n * p * (1 - p)) + (1 - 2 * p) * (z * z - 1) / 6 - 0.5)
    k = np.clip(guess, 0, n).astype(np.int64)
    reaches = lambda k, at: stats.tail(k.astype(float), n[at].astype(float), p, False) >= u[at]
    at = np.arange(len(u))
    while len(at):  # down while the next lower still reaches
        at = at[k[at] > 0]
        at = at[reaches(k[at] - 1, at)] if len(at) else at
        k[at] -= 1
    at = np.arange(len(u))
    while len(at):  # up to the first that reaches
        at = at[(k[at] < n[at])]
        at = at[~reaches(k[at], at)] if len(at) else at
        k[at] += 1
    return k


def draws_of_block(stream: np.ndarray, block: int, clusters: int, size: int) -> np.ndarray:
    """How many of each replicate's ``clusters`` draws fall to a block of ``size`` clusters (the last may be smaller)."""
    low, high = 0, -(-clusters // size)
    draws = np.full(len(stream), clusters, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first, whole = (middle - low) * size, min(high * size, clusters) - low * size
        left = quantile(uniform(stream, middle, SPLIT), draws, first / whole)
        draws, low, high = (left, low, middle) if block < middle else (draws - left, middle, high)
    return draws


def sums_of_block(
    stream: np.ndarray, block: int, clusters: int, counts: np.ndarray, size: int, runs: list[int] | None = None,
) -> np.ndarray:
    """The drawn clusters' counts, summed up for each replicate: one row a cluster, or a run of as many as ``runs`` says."""
    runs = runs or [1] * len(counts)
    left, rest, at = draws_of_block(stream, block, clusters, size), sum(runs), block * size
    out = np.zeros((len(stream), counts.shape[1]), np.int64)
    for own, many in zip(counts, runs, strict=True):
        times = quantile(uniform(stream, at), left, many / rest)
        left, rest, at = left - times, rest - many, at + many
        if own.any():
            out += times[:, None] * own
    return out


def blocks_of_runs(clusters: DataFrame, key: str, counts: list[str], by: list[str], block: int = BLOCK) -> DataFrame:
    """``by``, ``block``, ``clusters`` (of the whole group) and ``rows``: the block's runs in order, each with ``_w`` clusters."""
    at = placed(clusters.select(*by, key, *counts), key, by)
    one = F.lit(1).cast("long")
    few = at.where(F.col("_n") <= block).select(*by, "_n", "_at", one.alias("_w"), *counts, F.lit(0).cast("long").alias("block"))
    equal = at.where(F.col("_n") > block).groupBy(*by, "_n", *counts).agg(F.count("*").alias("_many"))
    upto = scanned(equal, by, counts, {"_end": ("sum", F.col("_many"))}).withColumn("_begin", F.col("_end") - F.col("_many"))
    parts = upto.withColumn("block", F.explode(F.expr(f"sequence(_begin DIV {block}, (_end - 1) DIV {block})")))
    begin = F.greatest("_begin", F.col("block") * block)
    width = F.least(F.col("_end"), (F.col("block") + 1) * block) - begin
    runs = few.unionByName(parts.select(*by, "_n", begin.alias("_at"), width.alias("_w"), *counts, "block"))
    return runs.groupBy(*by, "block").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_w", *counts))).alias("rows"), F.first("_n").alias("clusters"),
    )


def summed_replicates(
    clusters: DataFrame, key: str, counts: list[str], replicates: int, seed: str, by: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``replicate`` (from 0) and the sums of ``counts`` over the clusters that it draws, within each group of ``by``.

    ``clusters`` has one row a cluster, in order of ``key``; there may be any number. Null counts count as 0; keys are
    not null. Without clusters there are no replicates.
    """
    by, named = by or [], [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in counts]
    name = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in by])
    blocks = blocks_of_runs(clusters.select(*by, key, *named), key, counts, by, block)
    chunks = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(AT_ONCE))).alias("first")
    work = blocks.select(
        F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long").alias("group"), "block", "clusters",
        F.col("rows").getField("_w").alias("runs"), *[F.col("rows").getField(c).alias(f"rows_{i}") for i, c in enumerate(counts)], chunks,
    )
    # A number of tasks is given, as rows are few but dear: Spark would put small partitions together.
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(tasks, "group", "block", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                group, own, n, first = (batch.column(c)[i].as_py() for c in ("group", "block", "clusters", "first"))
                table = np.stack([batch.column(f"rows_{k}")[i].values.to_numpy() for k in range(len(counts))], axis=1)
                stream = streams(group, np.arange(first, min(first + AT_ONCE, replicates)))
                found = sums_of_block(stream, own, n, table, block, batch.column("runs")[i].as_py())
                sums[first] = sums[first] + found if first in sums else found
        for first, found in sums.items():
            columns = [pa.array(np.arange(first, first + len(found))), *(pa.array(found[:, k]) for k in range(len(counts)))]
            yield pa.RecordBatch.from_arrays(columns, names=["replicate", *counts])

    parts = work.mapInArrow(run, ", ".join(f"`{c}` long" for c in ["replicate", *counts]))
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in counts])


def interval(values: DataFrame, value: Column) -> DataFrame:
    """Number of replicates, nearest ranks of .025, .5 and .975, and the interval's ends by index, of one value a replicate."""
    sorted_ = values.agg(F.array_sort(F.collect_list(value)).alias("v"))  # as many values as replicates
    v = F.col("v")
    low, high = stats.index_interval(v)
    ranks = {name: stats.nearest_rank(v, q) for name, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))}
    return sorted_.select(
        F.size(v).alias("replicates"), *[x.alias(name) for name, x in ranks.items()], low.alias("index_low"),
        high.alias("index_high"),
    )


def _hashed(name: str, source: str, start: str) -> str:
    """SQL CTEs that add ``x``, ``mixed`` of a 32-bit number."""
    turn = f"(xor(x, x >> 16) * {MIX}) & {BITS32}"
    return f"""{name}_1 AS (SELECT *, {start} AS x FROM {source}), {name}_2 AS (SELECT * EXCLUDE (x), {turn} AS x FROM {name}_1),
  {name}_3 AS (SELECT * EXCLUDE (x), {turn} AS x FROM {name}_2), {name} AS (SELECT * EXCLUDE (x), xor(x, x >> 16) AS x FROM {name}_3)"""


def sql(name: str, clusters: str, key: str, replicates: int, seed: str, by: str = "") -> str:
    """SQL CTEs, for groups of one block: ``name`` (replicate, n, b, c) from a CTE of clusters. WITH RECURSIVE goes before."""
    part, label = (f"PARTITION BY {by}", f"'{seed}|' || {by}") if by else ("", f"'{seed}'")
    o, reach = f"{name}_o", "CAST(greatest(12 * sqrt(m / r) + m / r + 30, 0) AS BIGINT)"
    return f"""{o} AS (SELECT n, b, c, row_number() OVER ({part} ORDER BY {key}) - 1 AS place, count(*) OVER ({part}) AS size,
  CAST('0x' || left(sha256({label}), 8) AS BIGINT) AS grp FROM {clusters}),
{_hashed(f'{name}_s', f'(SELECT DISTINCT grp, size, rep FROM {o}, (SELECT unnest(range({replicates})) AS rep))', f'xor(grp, (rep * {REPLICATE}) & {BITS32})')},
{_hashed(f'{name}_u', f'(SELECT s.grp, s.rep, p.place, p.size, p.n, p.b, p.c, s.x AS stream FROM {name}_s s JOIN {o} p USING (grp))', f'xor(stream, (place * {PLACE}) & {BITS32})')},
{name}_m AS (SELECT m, r, unnest(range(0, least(m, {reach}) + 1)) AS k FROM (SELECT unnest(range(max(size) + 1)) AS m FROM {o}),
  (SELECT unnest(range(2, max(size) + 1)) AS r FROM {o})),
{name}_t AS (SELECT m, r, list(cdf ORDER BY k) AS cdfs FROM (SELECT m, r, k, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1)
  - k * ln(r) + (m - k) * ln(1 - 1.0 / r))) OVER (PARTITION BY m, r ORDER BY k) AS cdf FROM {name}_m) GROUP BY 1, 2),
{name}_d AS (SELECT grp, rep, CAST(0 AS BIGINT) AS place, size, size AS m, CAST(0 AS BIGINT) AS times FROM {name}_s
  UNION ALL SELECT grp, rep, place + 1, size, m - drawn, drawn FROM (SELECT d.grp, d.rep, d.place, d.size, d.m, CASE
    WHEN d.place + 1 = d.size THEN d.m ELSE len(list_filter(t.cdfs, lambda c: c < (u.x + 0.5) / 4294967296.0)) END AS drawn
    FROM {name}_d d JOIN {name}_u u ON d.grp = u.grp AND d.rep = u.rep AND d.place = u.place
    LEFT JOIN {name}_t t ON t.m = d.m AND t.r = d.size - d.place)),
{name} AS (SELECT d.rep AS replicate, sum(times * n) AS n, sum(times * b) AS b, sum(times * c) AS c FROM {name}_d d
  JOIN {o} p ON d.grp = p.grp AND d.place = p.place + 1 GROUP BY 1)"""
