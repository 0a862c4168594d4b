"""Exact tests, adjustments, agreement and resampling over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import bootstrap, pairs, scans, tests
from .base import Registry, table, written
from .relational import PAIRS_SQL, day_pairs, events

query = Registry()

#: Replicates of the cluster bootstrap.
REPLICATES = 10_000

#: SQL for the upper tail of Binomial(n, 1/2) at b.
TAIL = """CASE WHEN {n} = 0 OR {b} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range({b}, {n} + 1),
  lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) - {n} * ln(2))))) END"""
LOWER = """CASE WHEN {n} = 0 OR {b} >= {n} THEN 1.0
  ELSE least(1.0, list_sum(list_transform(range(0, {b} + 1), lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) -
  lgamma({n} - k + 1) - {n} * ln(2))))) END"""

SUPPLIER = """s AS (SELECT l_suppkey AS supplier, l_suppkey % 5 AS family, count(*) FILTER (l_returnflag = 'R') AS b,
  count(*) FILTER (l_returnflag IN ('R', 'A')) AS n FROM lineitem GROUP BY 1, 2)"""


def suppliers(spark, d):
    flag = F.col("l_returnflag")
    counts = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("supplier"), (F.col("l_suppkey") % 5).alias("family"),
    )
    return counts.agg(F.count_if(flag == "R").alias("b"), F.count_if(flag.isin("R", "A")).alias("n"))


@query(f"WITH {SUPPLIER} SELECT supplier, b, n, round({TAIL.format(b='b', n='n')}, 9) AS upper, round({LOWER.format(b='b', n='n')}, 9) AS lower, round(least(1.0, 2 * least({TAIL.format(b='b', n='n')}, {LOWER.format(b='b', n='n')})), 9) AS two_sided FROM s")
def x01_x02_x03_binomial_tails(spark, d):
    b, n = F.col("b"), F.col("n")
    return suppliers(spark, d).select(
        "supplier", "b", "n", F.round(stats.upper_tail(b, n), 9).alias("upper"),
        F.round(stats.lower_tail(b, n), 9).alias("lower"), F.round(stats.two_sided(b, n), 9).alias("two_sided"),
    )


def bisected(alpha: float, upper: bool) -> str:
    """SQL for a Clopper-Pearson bound of x of n, by 60 halvings of [0, 1]."""
    p = "((s.lo + s.hi) / 2)"
    terms = "range(0, x + 1)" if upper else "range(x, n + 1)"
    tail = f"list_sum(list_transform({terms}, lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"
    right, left = f"{{'lo': {p}, 'hi': s.hi}}", f"{{'lo': s.lo, 'hi': {p}}}"
    steps = f"list_reduce(list_prepend({{'lo': 0.0, 'hi': 1.0}}, list_transform(range(60), lambda k: {{'lo': 0.0, 'hi': 1.0}})), lambda s, k: CASE WHEN {tail} {'>' if upper else '<'} {alpha} THEN {right} ELSE {left} END)"
    return f"CASE WHEN {'x = n' if upper else 'x = 0'} THEN {1.0 if upper else 0.0} ELSE ({steps}.lo + {steps}.hi) / 2 END"


@query(f"""WITH s AS (SELECT l_suppkey AS supplier, count(*) FILTER (l_discount >= 0.095) AS x, count(*) AS n
  FROM lineitem GROUP BY 1)
  SELECT supplier, x, n, round({bisected(0.05, True)}, 7) AS upper_bound, round({bisected(0.025, False)}, 7) AS lower, round({bisected(0.025, True)}, 7) AS upper FROM s""")
def x04_x05_clopper_pearson(spark, d):
    """The one-sided 95 % upper bound, and both ends of the two-sided 95 % interval."""
    x, n = F.col("x"), F.col("n")
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count_if(F.col("l_discount") >= 0.095).alias("x"), F.count("*").alias("n"),
    )
    bounds = {
        "upper_bound": stats.clopper_pearson_upper(x, n), "lower": stats.clopper_pearson_lower(x, n, 0.025),
        "upper": stats.clopper_pearson_upper(x, n, 0.025),
    }
    return counts.select("supplier", "x", "n", *[F.round(bound, 7).alias(name) for name, bound in bounds.items()])


@query("""WITH c AS (SELECT l_partkey AS part, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem
  GROUP BY 1)
  SELECT part, n, k, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1), 7) AS log_choose, CASE
  WHEN n = 0 THEN '—' ELSE printf('%.1f%%', round(100 * k / n, 1)) END AS share FROM c""")
def m01_m02_coefficients_and_percents(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"),
    )
    n, k = F.col("n"), F.col("k")
    return counts.select(
        "part", "n", "k", F.round(stats.log_choose(n, k), 7).alias("log_choose"),
        stats.percent_text(k, n).alias("share"),
    )


@query(f"""WITH {PAIRS_SQL}, m AS (SELECT count(*) AS n, count(*) FILTER (v AND NOT c) AS b,
  count(*) FILTER (c AND NOT v) AS c FROM pair WHERE v IS NOT NULL AND c IS NOT NULL)
  SELECT n, b, c, round({TAIL.format(b='b', n='(b + c)')}, 6) AS p FROM m""")
def x06_mcnemar(spark, d):
    return pairs.discordant(day_pairs(spark, d), F.col("view"), F.col("click")).withColumn(
        "p", F.round(stats.upper_tail(F.col("b"), F.col("b") + F.col("c")), 6),
    )


ADJUSTED = f"""WITH {SUPPLIER}, p AS (SELECT supplier, family, round({TAIL.format(b='b', n='n')}, 9) AS p FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY {{part}}
  ORDER BY p, supplier) AS rk, count(*) OVER (PARTITION BY {{part}}) AS m FROM p)
SELECT supplier, family, p, round(max(least(1.0, (m - rk + 1) * p)) OVER (PARTITION BY {{part}}
  ORDER BY p, supplier ROWS UNBOUNDED PRECEDING), 8) AS holm,
round(min(least(1.0, p * m / rk)) OVER (PARTITION BY {{part}}
  ORDER BY p DESC, supplier DESC ROWS UNBOUNDED PRECEDING), 8) AS bh FROM r"""


def _adjusted(spark, d, family):
    p = written(
        suppliers(spark, d).select(
            "supplier", "family", F.round(stats.upper_tail(F.col("b"), F.col("n")), 9).alias("p"),
        )
    )
    return tests.adjusted(p, "p", "supplier", family).select(
        "supplier", "family", "p", F.round("holm", 8).alias("holm"), F.round("bh", 8).alias("bh"),
    )


@query(ADJUSTED.format(part="1"))
def x07_x08_holm_and_bh(spark, d):
    return _adjusted(spark, d, None)


@query(ADJUSTED.format(part="family"))
def x09_families(spark, d):
    return _adjusted(spark, d, ["family"])


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels
  WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS agree FROM c), ma AS (SELECT a AS v, sum(n) AS na FROM c
  GROUP BY 1), mb AS (SELECT b AS v, sum(n) AS nb FROM c GROUP BY 1)
  SELECT CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, round((agree / n - e / (n * n)) / (1 - e / (n * n)),
  6) AS kappa FROM t, (SELECT sum(CAST(na AS DOUBLE) * nb) AS e FROM ma JOIN mb USING (v))""")
def x10_kappa(spark, d):
    return tests.kappa_of(table(spark, d, "labels"), "quality", "toxic").withColumn("kappa", F.round("kappa", 6))


@query("""WITH k AS (SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid'
  ELSE 'low' END AS a, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'mid' ELSE 'none' END AS b FROM orders),
  u AS (SELECT * FROM k WHERE a IN ('high', 'mid') AND b IN ('high', 'mid')), t AS (SELECT count(*) AS n,
  count(*) FILTER (a = b) AS agree, CAST(count(*) FILTER (a = 'high') AS DOUBLE) * count(*) FILTER (b = 'high') +
  CAST(count(*) FILTER (a = 'mid') AS DOUBLE) * count(*) FILTER (b = 'mid') AS e FROM u)
  SELECT n, agree, round((agree / n - e / (CAST(n AS DOUBLE) * n)) / (1 - e / (CAST(n AS DOUBLE) * n)), 6) AS kappa,
  (SELECT count(*) FROM k) - n AS excluded FROM t""")
def x11_binary_kappa_with_exclusions(spark, d):
    price = F.col("o_totalprice")
    a = F.when(price > 200000, "high").when(price > 50000, "mid").otherwise("low")
    b = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "mid").otherwise("none")
    rated = table(spark, d, "orders").select(a.alias("a"), b.alias("b"))
    return tests.binary_kappa(rated, "a", "b", ("high", "mid")).withColumn("kappa", F.round("kappa", 6))


@query(f"""WITH g AS (SELECT o_custkey % 50 AS grp, avg(CASE
  WHEN o_orderstatus = 'F' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS diff
  FROM orders GROUP BY 1),
  s AS (SELECT count(*) FILTER (diff > 0) AS positive, count(*) FILTER (diff < 0) AS negative,
  count(*) FILTER (diff = 0) AS tied FROM g)
  SELECT positive, negative, tied, round({TAIL.format(b='positive', n='(positive + negative)')}, 6) AS p FROM s""")
def x12_sign_test(spark, d):
    status = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    groups = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("grp")).agg(
        (status("F") - status("O")).alias("diff")
    )
    return tests.sign_test(groups, F.col("diff")).withColumn("p", F.round("p", 6))


@query("""WITH u AS (SELECT user_id % 7 AS grp, user_id, round(avg(CASE
  WHEN event_type = 'view' THEN value END) - avg(CASE WHEN event_type = 'click' THEN value END), 6) AS diff
  FROM events GROUP BY 1, 2),
  z AS (SELECT grp, diff, abs(diff) AS a FROM u WHERE diff <> 0), r AS (SELECT *, rank() OVER (PARTITION BY grp
  ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2 AS rk, count(*) OVER (PARTITION BY grp, a) AS t FROM z),
  s AS (SELECT grp, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS w, sum(t * t - 1) AS ties,
  list(CAST(2 * rk AS BIGINT)) AS ranks FROM r GROUP BY 1),
  q AS (SELECT *, CASE WHEN n >= 5 THEN (w - n * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1)
  / 24 - ties / 48) END AS z FROM s),
  e AS (SELECT *, abs(z) / sqrt(2) AS x, CASE WHEN n BETWEEN 5 AND 50 THEN list_reduce(list_prepend(list_prepend(1.0::DOUBLE,
    list_transform(range(CAST(list_sum(ranks) AS BIGINT)), lambda s: 0.0::DOUBLE)), list_transform(ranks, lambda r: [r::DOUBLE])),
    lambda acc, r: list_transform(range(len(acc)), lambda s: 0.5 * acc[s + 1] + CASE WHEN s >= r[1] THEN
      0.5 * acc[s - CAST(r[1] AS BIGINT) + 1] ELSE 0 END)) END AS chances FROM q)
  SELECT grp, n, round(w, 3) AS w_plus, round(z, 6) AS z, round(CASE WHEN chances IS NOT NULL THEN least(1, 2 * least(
    list_sum(chances[1:CAST(2 * w AS BIGINT) + 1]), list_sum(chances[CAST(2 * w AS BIGINT) + 1:])))
  WHEN x < 3 THEN 1 - 2 / sqrt(pi()) * x * list_sum(list_transform(range(80), lambda k: exp(2 * k * ln(greatest(x,
  1e-300)) - lgamma(k + 1)) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END / (2 * k + 1)))
    ELSE 2 / sqrt(pi()) * (4.0 / 4000) * list_sum(list_transform(range(4000),
  lambda k: exp(-power(x + (k + 0.5) * 4.0 / 4000, 2)))) END, 5) AS p FROM e""")
def x13_wilcoxon(spark, d):
    side = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    users = events(spark, d).groupBy((F.col("user_id") % 7).alias("grp"), "user_id").agg(
        F.round(side("view") - side("click"), 6).alias("diff")
    )
    found = tests.wilcoxon(written(users), "diff", ["grp"])
    return found.select(
        "grp", "n", F.round("w_plus", 3).alias("w_plus"), F.round("z", 6).alias("z"), F.round("p", 5).alias("p"),
    )


FRAMES = f"""{PAIRS_SQL}, f AS (SELECT user_id % 8 AS frame, count(*) AS n, count(*) FILTER (v AND NOT c) AS b,
  count(*) FILTER (c AND NOT v) AS c FROM pair WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1)"""


def frames(spark, d):
    return pairs.discordant(
        day_pairs(spark, d).withColumn("frame", F.col("user_id") % 8), F.col("view"), F.col("click"), ["frame"],
    )


@query(f"""WITH {FRAMES} SELECT frame, CAST(n AS BIGINT) AS n, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c,
  round({TAIL.format(b='b', n='(b + c)')}, 6) AS p FROM
  (SELECT frame, CAST(sum(n) OVER () - n AS BIGINT) AS n, CAST(sum(b) OVER () - b AS BIGINT) AS b,
  CAST(sum(c) OVER () - c AS BIGINT) AS c FROM f)""")
def x14_leave_one_out(spark, d):
    return tests.leave_one_out(frames(spark, d), "frame", ["n", "b", "c"]).withColumn(
        "p", F.round(stats.upper_tail(F.col("b"), F.col("b") + F.col("c")), 6),
    )


@query(f"""WITH {FRAMES}, t AS (SELECT sum(n) AS n, sum(b) AS b, sum(c) AS c FROM f)
  SELECT x.frame AS first_out, y.frame AS second_out, CAST(t.n - x.n - y.n AS BIGINT) AS n,
  CAST(t.b - x.b - y.b AS BIGINT) AS b, CAST(t.c - x.c - y.c AS BIGINT) AS c FROM f x
  JOIN f y ON x.frame < y.frame, t""")
def x14_leave_two_out(spark, d):
    return tests.leave_two_out(frames(spark, d), "frame", ["n", "b", "c"])


def _interval(values: str, label: str = "") -> str:
    """SQL of ``bootstrap.interval`` of the risk differences of a table of replicates."""
    v = "v[CAST(round_even({q} * (len(v) - 1), 0) AS BIGINT) + 1] AS {n}"
    at = ", ".join(v.format(q=q, n=n) for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975)))
    return f"""SELECT {label}CAST(len(v) AS INTEGER) AS replicates, {at}, v[CAST(floor(0.025 * len(v)) AS BIGINT) + 1] AS index_low,
  v[CAST(floor(0.975 * len(v)) AS BIGINT)] AS index_high
  FROM (SELECT list_sort(list(round(coalesce((b - c) / nullif(n, 0), 0), 9))) AS v FROM {values})"""


def risk_difference():
    return F.round(F.coalesce(F.try_divide(F.col("b") - F.col("c"), "n"), F.lit(0.0)), 9)


@query(f"WITH RECURSIVE {FRAMES}, {bootstrap.sql('r', 'f', 'frame', REPLICATES, 'frames')} {_interval('r')}")
def x15_x18_x19_frame_bootstrap(spark, d):
    """Intervals of 10,000 replicates that draw frames."""
    drawn = bootstrap.summed_replicates(frames(spark, d), "frame", ["n", "b", "c"], REPLICATES, "frames")
    return bootstrap.interval(drawn, risk_difference())


@query(f"""WITH RECURSIVE {PAIRS_SQL}, u AS (SELECT user_id, user_id % 8 AS frame, count(*) AS n,
  count(*) FILTER (v AND NOT c) AS b, count(*) FILTER (c AND NOT v) AS c FROM pair
  WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2),
  {bootstrap.sql('w', 'u', 'user_id', REPLICATES, 'users', 'frame')}, {bootstrap.sql('a', 'u', 'user_id', REPLICATES, 'users')}
  {_interval('w', "'within frames' AS drawn, ")} UNION ALL {_interval('a', "'over all' AS drawn, ")}""")
def x16_x17_cluster_bootstrap(spark, d):
    """Intervals of 10,000 replicates that draw users within frames (X16) and over all (X17)."""
    users = written(
        pairs.discordant(day_pairs(spark, d), F.col("view"), F.col("click"), ["user_id"]).withColumn(
            "frame", F.col("user_id") % 8,
        )
    )

    def interval(kind: str, by: list[str]):
        drawn = bootstrap.summed_replicates(users, "user_id", ["n", "b", "c"], REPLICATES, "users", by)
        return bootstrap.interval(drawn, risk_difference()).select(F.lit(kind).alias("drawn"), "*")

    return interval("within frames", ["frame"]).union(interval("over all", []))


@query("""SELECT o_orderstatus, l[CAST(round_even(0.1 * (len(l) - 1), 0) AS BIGINT) + 1] AS p10,
  l[CAST(round_even(0.5 * (len(l) - 1), 0) AS BIGINT) + 1] AS p50
  FROM (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS l FROM orders GROUP BY 1)""")
def x18_nearest_rank(spark, d):
    return scans.nearest_ranks(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"], {"p10": 0.1, "p50": 0.5})


@query(f"""WITH {FRAMES} SELECT frame, round((b - c) / nullif(n, 0), 6) AS risk_difference, round(b / nullif(b + c,
  0), 6) AS share FROM f""")
def x20_risk_difference(spark, d):
    return frames(spark, d).select(
        "frame", F.round(F.try_divide(F.col("b") - F.col("c"), "n"), 6).alias("risk_difference"),
        F.round(F.try_divide("b", F.col("b") + F.col("c")), 6).alias("share"),
    )


@query(f"""WITH {FRAMES}, m AS (SELECT frame, n, (b + c) / n AS q, b / (b + c) AS s FROM f
  WHERE b + c > 0 AND b + c < n AND b > 0 AND c > 0),
  k AS (SELECT frame, n, q, s, unnest(range(n + 1)) AS d FROM m), r AS (SELECT *, unnest(range(d + 1)) AS x FROM k),
  a AS (SELECT *, {TAIL.format(b='x', n='d')} AS p FROM (SELECT DISTINCT d, x FROM r)),
  h AS (SELECT r.frame, r.n, q, s, r.d, sum(CASE WHEN p <= 0.05 THEN exp(lgamma(r.d + 1) - lgamma(r.x + 1) -
  lgamma(r.d - r.x + 1) + r.x * ln(s) + (r.d - r.x) * ln(1 - s)) ELSE 0 END) AS reach FROM r
  JOIN a ON r.d = a.d AND r.x = a.x GROUP BY ALL)
  SELECT frame, round(sum(reach * exp(lgamma(n + 1) - lgamma(d + 1) - lgamma(n - d + 1) + d * ln(q) + (n - d) * ln(1 -
  q))), 6) AS power FROM h GROUP BY 1""")
def x21_mcnemar_power(spark, d):
    # The SQL's sum grows with the square of n: it is for the smaller tables.
    m = frames(spark, d).where("b + c > 0 AND b + c < n AND b > 0 AND c > 0")
    return m.select(
        "frame",
        F.round(
            tests.mcnemar_power(
                F.col("n"), (F.col("b") + F.col("c")) / F.col("n"), F.col("b") / (F.col("b") + F.col("c")),
            ),
            6,
        ).alias("power"),
    )


@query("""WITH u AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN value END) AS x, avg(CASE
  WHEN event_type = 'click' THEN value END) AS y FROM events GROUP BY 1)
  SELECT count(*) AS n, round(avg(x - y), 6) AS mean_difference, count(*) FILTER (x < y) AS lt,
  count(*) FILTER (x > y) AS gt, count(*) FILTER (x = y) AS eq, round(max(abs(x - y)), 6) AS widest, round(avg(CASE
  WHEN abs(x - y) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS within_5 FROM u WHERE x IS NOT NULL AND y IS NOT NULL""")
def x22_x23_paired_differences(spark, d):
    side = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    u = events(spark, d).groupBy("user_id").agg(side("view").alias("x"), side("click").alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL"
    )
    diff = F.col("x") - F.col("y")
    return u.agg(
        F.count("*").alias("n"), F.round(F.avg(diff), 6).alias("mean_difference"), F.count_if(diff < 0).alias("lt"),
        F.count_if(diff > 0).alias("gt"), F.count_if(diff == 0).alias("eq"),
        F.round(F.max(F.abs(diff)), 6).alias("widest"),
        F.round(F.avg(F.when(F.abs(diff) <= 5, 1.0).otherwise(0.0)), 6).alias("within_5"),
    )


@query(f"""WITH {FRAMES}, p AS (SELECT frame, round({TAIL.format(b='b', n='(b + c)')}, 9) AS p
  FROM f), r AS (SELECT p, frame, (count(*) OVER () - row_number() OVER (ORDER BY p, frame) + 1) * p AS scaled FROM p),
  h AS (SELECT max(least(1.0, scaled)) OVER (ORDER BY p, frame ROWS UNBOUNDED PRECEDING) AS holm FROM r)
  SELECT count(*) FILTER (holm < 0.05) AS holm_passed, count(*) AS tests, CASE
  WHEN 3 * count(*) FILTER (holm < 0.05) >= 2 * count(*) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM h""")
def x24_verdict(spark, d):
    p = frames(spark, d).select("frame", F.round(stats.upper_tail(F.col("b"), F.col("b") + F.col("c")), 9).alias("p"))
    held = tests.adjusted(p, "p", "frame").agg(
        F.count_if(F.col("holm") < 0.05).alias("holm_passed"), F.count("*").alias("tests"),
    )
    return held.select(
        "holm_passed", "tests",
        F.when(3 * F.col("holm_passed") >= 2 * F.col("tests"), "PASS").otherwise("FAIL").alias("verdict"),
    )
