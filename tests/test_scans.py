"""Scans, ranks, signed ranks and the bootstrap by multiplicities, against brute force."""

import datetime as dt
import itertools
import random
from collections import Counter
from math import comb
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.operators import bootstrap, scans
from pairweave.operators import tests as operators

SIZES = [10_000, 10]


def rows_of_groups(n=240):
    """One group has most rows; another is null; times tie, some values are null."""
    rnd = random.Random(4)
    groups = ["hot"] * 8 + ["a", None]
    return [(i, rnd.choice(groups), rnd.randint(0, 40), rnd.choice([None, rnd.randint(-9, 9)])) for i in range(n)]


@pytest.mark.parametrize("size", SIZES)
def test_scans_of_hot_groups(spark, size):
    rows = rows_of_groups()
    x = F.col("x")
    got = scans.scanned(
        spark.createDataFrame(rows, "id int, g string, t int, x int"), ["g"], ["t", "id"], {
            "total": ("sum", F.coalesce(x, F.lit(0))), "most": ("max", x), "least": ("min", x), "header": ("last", x),
            "least_on": ("onward min", x), "rest": ("onward sum", F.lit(1)),
        }, size,
    )
    assert got.columns == ["id", "g", "t", "x", "total", "most", "least", "header", "least_on", "rest"]
    want = set()
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(own):
            before, after = ([v[3] for v in part if v[3] is not None] for part in (own[: k + 1], own[k:]))
            want.add((
                *r, sum(before), max(before, default=None), min(before, default=None), before[-1] if before else None,
                min(after, default=None), len(own) - k,
            ))
    assert set(map(tuple, got.collect())) == want


@pytest.mark.parametrize("size", SIZES)
def test_onward_values_grow_row_by_row(spark, size):
    """No frame ends at a group's last row: Spark adds those up anew for each row, which is quadratic in a range."""
    rows = rows_of_groups()
    x = F.col("x")
    df = scans.scanned(
        spark.createDataFrame(rows, "id int, g string, t int, x int"), ["g"], ["t", "id"], {
            "most": ("onward max", x), "total": ("onward sum", F.coalesce(x, F.lit(0))), "last": ("onward last", x),
        }, size,
    )
    frames = df._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in frames
    want = set()
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(own):
            after = [v[3] for v in own[k:] if v[3] is not None]
            want.add((*r, max(after, default=None), sum(after), after[-1] if after else None))
    assert set(map(tuple, df.collect())) == want


def clock_rows(spark):
    """Rows by times without a zone, of a week in which Berlin's clocks lose an hour; every eleventh time is null."""
    base = dt.datetime(2026, 3, 27)
    times = [None if i % 11 == 0 else base + dt.timedelta(minutes=17 * (i * 37 % 500), microseconds=i) for i in range(400)]
    rows = [(i, i % 3, str(t) if t else None, i * 7 % 29 if i % 4 == 0 else None) for i, t in enumerate(times)]
    return list(zip(rows, times)), spark.createDataFrame(rows, "id int, g int, t string, x int").withColumn("t", F.col("t").cast("timestamp_ntz"))


def own_rows(rows, g):
    return sorted((r for r in rows if r[0][1] == g), key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0][0]))


@pytest.mark.parametrize("size", SIZES)
def test_running_values_by_times_without_a_zone(spark, size):
    rows, df = clock_rows(spark)
    x, one = F.coalesce("x", F.lit(0)), F.lit(1)
    got = scans.scanned(df, ["g"], ["t", "id"], {"most": ("max", x), "least": ("min", x), "record": ("sum", x), "place": ("sum", one)}, size)
    want = set()
    for g in range(3):
        own = own_rows(rows, g)
        for k, (r, _) in enumerate(own):
            before = [v[3] or 0 for v, _ in own[: k + 1]]
            want.add((r[0], max(before), min(before), sum(before), k + 1))
    assert {(r.id, r.most, r.least, r.record, r.place) for r in got.collect()} == want


def test_headers_by_times_without_a_zone(spark):
    """Carried on in the clock's order also where the session's zone lacks some of the times."""
    rows, df = clock_rows(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = {r.id: r.header for r in scans.scanned(df, ["g"], ["t", "id"], {"header": ("last", F.col("x"))}, 10).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = {}
    for g in range(3):
        header = None
        for r, _ in own_rows(rows, g):
            header = want[r[0]] = header if r[3] is None else r[3]
    assert got == want


def test_ranges_hold_equal_keys_and_all_rows(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)] + [(float(i % 37),) for i in range(500)]
    spread, total = scans.ranged(spark.createDataFrame(rows, "k double"), "k", 20)
    got = spread.collect()
    assert total == len(got) == 504
    by_key = {}
    for r in got:
        by_key.setdefault(str(r.k), set()).add(r._bucket)
    assert all(len(b) == 1 for b in by_key.values()) and len({r._bucket for r in got}) > 10
    known = sorted((r.k, r._bucket) for r in got if r.k is not None and r.k == r.k)
    assert [b for _, b in known] == sorted(b for _, b in known)


@pytest.mark.parametrize("size", SIZES)
def test_places_and_ranks(spark, size):
    rows = [(k * 7 % 101, k % 3) for k in range(101)]
    out = scans.placed(spark.createDataFrame(rows, "k long, g long"), "k", ["g"], size)
    by_group = {g: sorted(k for k, x in rows if x == g) for g in range(3)}
    assert {(r.g, r.k): (r._at, r._n) for r in out.collect()} == {
        (g, k): (i, len(ks)) for g, ks in by_group.items() for i, k in enumerate(ks)
    }
    ties = [(v, g) for _, g, v, _ in rows_of_groups()]
    found = scans.ranks(spark.createDataFrame(ties, "v int, g string"), "v", ["g"], size).collect()
    count = Counter(ties)
    assert {(r.v, r.g): (r.ties, r["rank"]) for r in found} == {
        (v, g): (n, 1 + sum(m for (w, h), m in count.items() if h == g and w < v)) for (v, g), n in count.items()
    }


@pytest.mark.parametrize("size", [1000, 7])
def test_adjusted_and_nearest_ranks(spark, size):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.choice([0.001, 0.02, 0.2, round(rng.random(), 3)])) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, f int, p double")

    def brute(some):
        order = sorted(some, key=lambda r: (r[2], r[0]))
        m, holm, bh, top, low = len(order), {}, {}, 0.0, 1.0
        for i, (k, _, p) in enumerate(order):
            top = max(top, min(1.0, (m - i) * p))
            holm[k] = top
        for i, (k, _, p) in reversed(list(enumerate(order))):
            low = min(low, min(1.0, p * m / (i + 1)))
            bh[k] = low
        return {k: (holm[k], bh[k]) for k in holm}

    for family, groups in ((None, [rows]), (["f"], [[r for r in rows if r[1] == f] for f in (0, 1)])):
        got = {r.k: (r.holm, r.bh) for r in operators.adjusted(df, "p", "k", family, size).collect()}
        want = {k: v for some in groups for k, v in brute(some).items()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    ranks = scans.nearest_ranks(df, "p", ["f"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0, "e": 0.5}, size).collect()
    assert len(ranks) == 2
    for r in ranks:
        values = sorted(p for _, f, p in rows if f == r.f)
        assert [*r[1:]] == [values[round(q * (len(values) - 1))] for q in (0.0, 0.25, 0.5, 1.0, 0.5)]


@pytest.mark.parametrize("size", SIZES)
def test_signed_ranks_against_all_signs(spark, size):
    rnd = random.Random(9)
    groups = {g: [rnd.choice([-3, -2, -1.5, -1, 0, 1, 2, 2.5, 4, None]) for _ in range(n)] for g, n in enumerate([1, 4, 6, 9, 12, 15])}
    groups[6] = [1.0, 2.0, 3.0, 4.0, 5.0]
    groups[7] = [rnd.gauss(0.3, 1) for _ in range(60)]
    df = spark.createDataFrame([(g, float(v) if v is not None else None) for g, vs in groups.items() for v in vs], "g int, d double")
    got = {r.g: r for r in operators.wilcoxon(df, "d", ["g"], range_rows=size).collect()}
    for g, vs in groups.items():
        d = [v for v in vs if v]
        if not d:
            assert g not in got
            continue
        ranks = [sum(abs(w) < abs(v) for w in d) + (sum(abs(w) == abs(v) for w in d) + 1) / 2 for v in d]
        w, n = sum(r for r, v in zip(ranks, d, strict=True) if v > 0), len(d)
        assert (got[g].n, got[g].w_plus) == (n, w)
        if n < 5:
            assert got[g].z is None and got[g].p is None
            continue
        t = sum(k**3 - k for k in Counter(map(abs, d)).values())
        z = (w - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24 - t / 48) ** 0.5
        assert got[g].z == pytest.approx(z)
        if n <= 15:
            sums = [sum(s) for s in itertools.product(*[(0, r) for r in ranks])]
            p = min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))
        else:
            p = 2 * (1 - NormalDist().cdf(abs(z)))
        assert got[g].p == pytest.approx(p, rel=1e-6)
    assert got[6].p == 0.0625


def test_quantiles_invert_the_binomial_distribution():
    rnd = np.random.default_rng(1)
    for n, p in [(1, 0.5), (7, 0.2), (30, 1 / 30), (500, 1 / 3), (90, 0.999), (400, 0.9), (0, 0.5)]:
        u = rnd.random(300)
        got = bootstrap.quantile(u, np.full(300, n), p)
        reach = np.cumsum([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert (got == np.minimum(np.searchsorted(reach, u), n)).all()
    assert (bootstrap.quantile(np.full(3, 0.4), np.array([0, 4, 9]), 1.0) == [0, 4, 9]).all()


@pytest.mark.parametrize("block", [64, 7, 1])
def test_draws_are_those_of_resampling(block):
    """Each replicate draws as many clusters as there are; a cluster's draws are binomial, and two of them correlate by -1 / (n - 1)."""
    n, replicates = 37, 20_000
    stream = bootstrap.streams(12345, np.arange(replicates))
    parts = []
    for b in range(-(-n // block)):
        own = min(block, n - b * block)
        parts.append(bootstrap.sums_of_block(stream, b, n, np.eye(own, dtype=np.int64), block))
    times = np.concatenate(parts, axis=1)
    assert times.shape == (replicates, n) and (times.sum(axis=1) == n).all()
    assert abs(times.mean(axis=0) - 1).max() < 5 * (1 / replicates) ** 0.5
    for k in range(5):
        want = comb(n, k) * (1 / n) ** k * (1 - 1 / n) ** (n - k)
        assert abs((times == k).mean() - want) < 0.005
    pairs = np.corrcoef(times.T)[np.triu_indices(n, 1)]
    assert pairs.mean() == pytest.approx(-1 / (n - 1), abs=0.002) and abs(pairs).max() < 0.07


@pytest.mark.parametrize("by, block", [(["f"], 8192), ([], 8192), ([], 16), (["f"], 5)])
def test_intervals_are_those_of_resampling(spark, by, block):
    rnd = random.Random(2)
    clusters = [(u, u % 3, 5 + u % 7, rnd.randint(0, 5), rnd.randint(0, 3)) for u in range(90)]
    df = spark.createDataFrame(clusters, "u int, f int, n int, b int, c int")
    drawn = bootstrap.summed_replicates(df, "u", ["n", "b", "c"], 6_000, "s", by, block)
    rows = sorted(drawn.collect())
    assert [r.replicate for r in rows] == list(range(6_000))
    got = sorted((r.b - r.c) / r.n for r in rows)
    table, fresh = np.array([x[2:] for x in clusters]), np.random.default_rng(7)
    parts = [np.array([i for i, x in enumerate(clusters) if x[1] == f]) for f in range(3)] if by else [np.arange(90)]
    plain = []
    for _ in range(6_000):
        n, b, c = sum(table[own[fresh.integers(0, len(own), len(own))]].sum(axis=0) for own in parts)
        plain.append((b - c) / n)
    plain.sort()
    width = plain[5850] - plain[150]
    for q in (150, 1500, 3000, 4500, 5850):
        assert abs(got[q] - plain[q]) < 0.04 * width
    again = sorted(bootstrap.summed_replicates(df.repartition(5), "u", ["n", "b", "c"], 6_000, "s", by, block).collect())
    assert again == rows
    answer = bootstrap.interval(spark.createDataFrame([(float(v),) for v in got], "v double"), F.col("v")).first()
    assert (answer.replicates, answer.low, answer.index_low, answer.index_high) == (6_000, got[150], got[150], got[5849])


@pytest.mark.parametrize("by", [["f"], []])
def test_clusters_of_equal_counts_are_one_run(spark, by):
    """A group beyond a block has as many runs as different counts, and one more a block; its replicates are those of resampling."""
    n, block = 40_000, 1_000
    df = spark.range(n).select("id", (F.col("id") % 2).alias("f"), (F.col("id") % 5 + 1).alias("n"), (F.col("id") % 3 + 1).cast("int").alias("b"))
    rows = bootstrap.blocks_of_runs(df, "id", ["n", "b"], by, block).collect()
    assert sum(len(r.rows) for r in rows) <= (2 if by else 1) * 15 + n / block and sum(x._w for r in rows for x in r.rows) == n
    assert len(rows) == n / block and all(sum(x._w for x in r.rows) == block and r.clusters == (n // 2 if by else n) for r in rows)
    assert sum(x._w * x.n for r in rows for x in r.rows) == 3 * n and sum(x._w * x.b for r in rows for x in r.rows) == df.agg(F.sum("b")).first()[0]
    drawn = bootstrap.summed_replicates(df, "id", ["n", "b"], 3_000, "s", by, block).orderBy("replicate").toPandas()
    deviation = (2 * n) ** 0.5  # of n, 1 to 5 evenly; the frames have all of them
    assert abs(drawn.n.mean() - 3 * n) < 5 * deviation / 3_000**0.5 and abs(drawn.n.std() / deviation - 1) < 0.07
    assert abs(drawn.b.std() / (2 / 3 * n) ** 0.5 - 1) < 0.07 and abs(drawn[["n", "b"]].corr().iloc[0, 1]) < 0.1


def test_quantiles_by_table_are_those_by_tails(monkeypatch):
    rng = np.random.default_rng(5)
    cases = [(np.full(400, many) - rng.integers(0, 40, 400), rng.random(400), p) for many, p in [(8192, 0.01), (500, 0.5), (90, 0.97), (41, 0.999)]]
    tabled = [bootstrap.quantile(u, n, p) for n, u, p in cases]
    monkeypatch.setattr(bootstrap, "TABLED", 0)
    assert all((x == bootstrap.quantile(u, n, p)).all() for x, (n, u, p) in zip(tabled, cases, strict=True))


def test_no_clusters_no_replicates(spark):
    assert bootstrap.summed_replicates(spark.createDataFrame([], "u int, n int"), "u", ["n"], 50, "s").count() == 0
