"""Tallies, rates, joins, pivots, windows and set operations over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..operators import contained, contracts, pairs, sampling, scans
from ..operators import tokens as token_tables
from ..streaming import resume
from .base import Registry, table

query = Registry()

#: Matched pairs of a user's day: the last view and the last click; an outcome holds above this value.
CUT = 20.0
PAIRS_SQL = f"""pair AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         arg_max(CASE WHEN event_type = 'view' THEN value > {CUT} END, CASE
  WHEN event_type = 'view' THEN (ts, event_id) END) AS v,
         arg_max(CASE WHEN event_type = 'click' THEN value > {CUT} END, CASE
  WHEN event_type = 'click' THEN (ts, event_id) END) AS c
  FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def day_pairs(spark: SparkSession, d: str) -> DataFrame:
    seen = events(spark, d).withColumn("high", F.col("value") > CUT)
    return pairs.matched(seen, ["user_id", "day"], "event_type", ["view", "click"], "high", ["ts", "event_id"])


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def a01_event_tally(spark, d):
    return events(spark, d).groupBy("event_type", "day").agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS k,
  count(*) FILTER (event_type <> 'error') AS n, count(*) FILTER (event_type = 'error') AS excluded,
  round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type <> 'error'), 0), 6) AS rate
  FROM events GROUP BY user_id""")
def a02_conditional_rate(spark, d):
    kind = F.col("event_type")
    counts = events(spark, d).groupBy("user_id").agg(
        F.count_if(kind == "purchase").alias("k"), F.count_if(kind != "error").alias("n"),
        F.count_if(kind == "error").alias("excluded"),
    )
    return counts.withColumn("rate", F.round(F.try_divide("k", "n"), 6))


@query("""SELECT o_orderpriority AS carrier, round(avg(CASE WHEN l_returnflag = 'R' THEN CASE
  WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END END)
  - avg(CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END END), 6) AS difference
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def a03_rate_difference_by_carrier(spark, d):
    high = F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)
    arm = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, high))
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("carrier")).agg(
        F.round(arm("R") - arm("N"), 6).alias("difference")
    )


@query("""SELECT r_name AS frame, c_mktsegment AS form, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def a04_frame_table(spark, d):
    # nation and region hold 25 and 5 rows at any scale; they are small enough for Spark to broadcast by itself.
    joined = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"),
    ).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("frame"), F.col("c_mktsegment").alias("form")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"),
    )


@query(f"""WITH {PAIRS_SQL} SELECT count(*) AS n, count(*) FILTER (v AND NOT c) AS b,
  count(*) FILTER (c AND NOT v) AS c FROM pair WHERE v IS NOT NULL AND c IS NOT NULL""")
def a05_discordant_pairs(spark, d):
    return pairs.discordant(day_pairs(spark, d), F.col("view"), F.col("click"))


@query(f"""WITH {PAIRS_SQL}, net AS (SELECT user_id, count(*) FILTER (v AND NOT c) - count(*) FILTER (c AND NOT v) AS
  net FROM pair WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1)
  SELECT count(*) FILTER (net > 0) AS positive, count(*) FILTER (net < 0) AS negative,
  count(*) FILTER (net = 0) AS tied FROM net""")
def a06_a07_cluster_net_signs(spark, d):
    net = pairs.discordant(day_pairs(spark, d), F.col("view"), F.col("click"), ["user_id"]).select(
        (F.col("b") - F.col("c")).alias("net")
    )
    return net.agg(
        F.count_if(F.col("net") > 0).alias("positive"), F.count_if(F.col("net") < 0).alias("negative"),
        F.count_if(F.col("net") == 0).alias("tied"),
    )


@query("""SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events
  GROUP BY 1""")
def a08_distinct_counts(spark, d):
    return events(spark, d).groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("day").alias("days"),
    )


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(avg(abs(value - 20)), 6) AS mean_abs,
  round(max(abs(value - 20)), 6) AS max_abs,
  round(count(*) FILTER (abs(value - 20) <= 5) / count(*), 6) AS within_5 FROM events GROUP BY 1""")
def a09_deviation_summary(spark, d):
    off = F.abs(F.col("value") - 20)
    return events(spark, d).groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(off), 6).alias("mean_abs"),
        F.round(F.max(off), 6).alias("max_abs"), F.round(F.count_if(off <= 5) / F.count("*"), 6).alias("within_5"),
    )


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 3")
def a10_confusion_top(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "quality", "toxic",
    ).limit(3)


@query("""WITH l AS (SELECT CAST(value AS VARCHAR) AS label FROM (VALUES (0), (1)) t(value))
  SELECT label, count(*) FILTER (CAST(quality AS VARCHAR) = label AND CAST(toxic AS VARCHAR) = label) AS hits,
  round(count(*) FILTER (CAST(quality AS VARCHAR) = label AND CAST(toxic AS VARCHAR) = label) / nullif(count(*) FILTER
  (CAST(quality AS VARCHAR) = label), 0), 6) AS precision,
  round(count(*) FILTER (CAST(quality AS VARCHAR) = label AND CAST(toxic AS VARCHAR) = label) / nullif(count(*) FILTER
  (CAST(toxic AS VARCHAR) = label), 0), 6) AS recall
  FROM labels, l GROUP BY 1""")
def a11_precision_recall(spark, d):
    both = F.array(
        F.struct(F.col("quality").cast("string").alias("label"), F.lit(1).alias("said"), F.lit(0).alias("gold")),
        F.struct(F.col("toxic").cast("string").alias("label"), F.lit(0).alias("said"), F.lit(1).alias("gold")),
    )
    hit = F.when(F.col("quality") == F.col("toxic"), 1).otherwise(0)
    long = table(spark, d, "labels").select(hit.alias("hit"), F.inline(both)).where("label IS NOT NULL")
    return long.groupBy("label").agg(
        F.sum(F.col("hit") * F.col("said")).alias("hits"),
        F.round(F.try_divide(F.sum(F.col("hit") * F.col("said")), F.sum("said")), 6).alias("precision"),
        F.round(F.try_divide(F.sum(F.col("hit") * F.col("gold")), F.sum("gold")), 6).alias("recall"),
    )


@query("SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM labels")
def a12_percent_agreement(spark, d):
    return table(spark, d, "labels").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(F.col("quality") == F.col("toxic"), 1.0).otherwise(0.0)), 6).alias("agreement"),
    )


@query("""SELECT coalesce(l_returnflag, 'total') AS flag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity),
  2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def a13_grand_totals(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
    ).select(F.coalesce("l_returnflag", F.lit("total")).alias("flag"), "n", "quantity")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events)
  SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM u CROSS JOIN t LEFT
  JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2""")
def a14_grid_with_zero_cells(spark, d):
    seen = events(spark, d)
    counts = seen.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # The grid's second side is a vocabulary of five kinds; a user's row is expanded rather than joined.
    kinds = seen.agg(F.collect_set("event_type").alias("k")).scalar()
    return seen.select("user_id").distinct().select("user_id", F.explode(kinds).alias("event_type")).join(
        counts, ["user_id", "event_type"], "left",
    ).na.fill(0, ["n"])


@query("""SELECT event_type, event_id, left(props, 20) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2""")
def a15_first_examples(spark, d):
    ranked = events(spark, d).withColumn(
        "r", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")),
    )
    return ranked.where("r <= 2").select("event_type", "event_id", F.left("props", F.lit(20)).alias("shown"))


@query(f"""WITH {PAIRS_SQL} SELECT count(*) AS n, count(*) FILTER (coalesce(v, true) AND NOT coalesce(c,
  false)) AS b_most, count(*) FILTER (coalesce(v, false) AND NOT coalesce(c, true)) AS b_least,
  count(*) FILTER (coalesce(c, true) AND NOT coalesce(v, false)) AS c_most FROM pair""")
def a16_imputation_bounds(spark, d):
    yes, no = F.lit(True), F.lit(False)
    v, c = F.col("view"), F.col("click")
    return day_pairs(spark, d).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(v, yes) & ~F.coalesce(c, no)).alias("b_most"),
        F.count_if(F.coalesce(v, no) & ~F.coalesce(c, yes)).alias("b_least"),
        F.count_if(F.coalesce(c, yes) & ~F.coalesce(v, no)).alias("c_most"),
    )


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS k FROM events
  GROUP BY 1)
  SELECT user_id, n, k, n >= 30 AND k >= 5 AS passed, concat_ws(',', CASE WHEN n < 30 THEN 'n' END, CASE
  WHEN k < 5 THEN 'correct' END) AS failures, k < 0.1 * n OR k > 0.9 * n AS saturated FROM g""")
def a17_a18_gate(spark, d):
    g = events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("k"),
    )
    failures = F.concat_ws(",", F.when(F.col("n") < 30, "n"), F.when(F.col("k") < 5, "correct"))
    return g.select(
        "user_id", "n", "k", ((F.col("n") >= 30) & (F.col("k") >= 5)).alias("passed"), failures.alias("failures"),
        ((F.col("k") < 0.1 * F.col("n")) | (F.col("k") > 0.9 * F.col("n"))).alias("saturated"),
    )


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS rate
  FROM events GROUP BY ALL)
  SELECT user_id, day FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id
  ORDER BY abs(rate - 0.5), day DESC) AS r FROM g) WHERE r = 1""")
def a19_closest_to_half(spark, d):
    g = events(spark, d).groupBy("user_id", "day").agg(
        F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).alias("rate")
    )
    return g.groupBy("user_id").agg(
        F.min_by("day", F.struct(F.abs(F.col("rate") - 0.5), -F.unix_date("day"))).alias("day")
    )


@query("""SELECT event_type, round(sum(value), 4) AS spent, sum(value) > 20000 AS over_cap,
  round(1.5 * avg(value) * 100, 4) AS forecast FROM events GROUP BY 1""")
def a20_cost_and_forecast(spark, d):
    return events(spark, d).groupBy("event_type").agg(
        F.round(F.sum("value"), 4).alias("spent"), (F.sum("value") > 20000).alias("over_cap"),
        F.round(1.5 * F.avg("value") * 100, 4).alias("forecast"),
    )


@query("""SELECT user_id, bool_or(event_type = 'purchase') AS any_purchase, bool_and(value < 100) AS all_small
  FROM events GROUP BY 1""")
def a21_any_all(spark, d):
    return events(spark, d).groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"),
        F.bool_and(F.col("value") < 100).alias("all_small"),
    )


@query("""SELECT doc_id, CASE WHEN quality = toxic THEN CAST(quality AS VARCHAR) ELSE 'DISAGREE' END AS consensus
  FROM labels""")
def a23_consensus(spark, d):
    return table(spark, d, "labels").select(
        "doc_id",
        F.when(
            F.col("quality") == F.col("toxic"), F.col("quality").cast("string"),
        ).otherwise("DISAGREE").alias("consensus"),
    )


@query("""SELECT d.doc_id, coalesce(CASE WHEN quality = toxic THEN CAST(quality AS VARCHAR) END, lang) AS gold,
  l.doc_id IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def a24_j02_j03_gold_resolution(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(
        table(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left",
    )
    agreed = F.when(F.col("quality") == F.col("toxic"), F.col("quality").cast("string"))
    return joined.select(
        "doc_id", F.coalesce(agreed, F.col("lang")).alias("gold"), F.col("known").isNull().alias("unlabelled"),
    )


@query("""SELECT lang, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (coalesce(toxic,
  0) = 1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def j03_missing_counts(spark, d):
    found = pairs.with_missing_count(
        table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", {"toxic": F.lit(0)},
    )
    return found.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if("missing").alias("missing"), F.count_if(F.col("toxic") == 1).alias("toxic"),
    )


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS first,
  bool_or(value > 60) AS bad FROM events WHERE event_type = 'view'
  GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS second,
  bool_or(value > 70) AS bad FROM events WHERE event_type = 'click' GROUP BY ALL)
  SELECT user_id, day, first, second FROM a JOIN b USING (user_id, day) WHERE NOT a.bad AND NOT b.bad""")
def j07_tombstoned_pairs(spark, d):
    side = lambda kind: events(spark, d).where(
        F.col("event_type") == kind
    ).withColumnRenamed("event_id", "ordinal")
    return pairs.two_source_pairs(
        side("view"), side("click"), ["user_id", "day"], "value", F.col("value") > 60, F.col("value") > 70,
    )


@query("""SELECT user_id FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id FROM events
  WHERE event_type = 'purchase' AND value > 80""")
def u02_except(spark, d):
    seen = events(spark, d)
    return seen.where("event_type = 'signup'").select("user_id").subtract(
        seen.where("event_type = 'purchase' AND value > 80").select("user_id")
    )


@query("""SELECT p_brand AS grp, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL
  SELECT p_type, count(*) FROM part WHERE p_size % 2 = 0 GROUP BY 1""")
def a22_f09_split_by_any_field(spark, d):
    even = table(spark, d, "part").where(F.col("p_size") % 2 == 0)
    return even.groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("n")).union(
        even.groupBy("p_type").agg(F.count("*"))
    )


@query("""SELECT event_id, user_id, value FROM events WHERE value > 20 AND event_type IN ('purchase', 'click')
  AND (event_type, hour(ts) < 12) IN (('purchase', true), ('click', false))""")
def f01_f02_f04_filters(spark, d):
    kind, morning = F.col("event_type"), F.hour("ts") < 12
    wanted = ((kind == "purchase") & morning) | ((kind == "click") & ~morning)
    seen = events(spark, d).where((F.col("value") > 20) & kind.isin("purchase", "click") & wanted)
    return seen.select("event_id", "user_id", "value")


@query("""SELECT count(*) FILTER (starts_with(event_type, 'err')) AS excluded,
  count(*) FILTER (NOT starts_with(event_type, 'err')) AS kept FROM events""")
def f03_excluded_errors(spark, d):
    bad = F.startswith("event_type", F.lit("err"))
    return events(spark, d).agg(F.count_if(bad).alias("excluded"), F.count_if(~bad).alias("kept"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN value > 20 THEN 'HIGH'
  ELSE 'LOW' END WHEN event_type = 'error' THEN 'EXCLUDED' ELSE 'OTHER' END AS label, event_type AS label_frozen
  FROM events""")
def f12_relabelled(spark, d):
    kind = F.col("event_type")
    label = F.when(
        kind.isin("view", "click"), F.when(F.col("value") > 20, "HIGH").otherwise("LOW"),
    ).when(kind == "error", "EXCLUDED").otherwise("OTHER")
    return events(spark, d).select("event_id", label.alias("label"), kind.alias("label_frozen"))


@query("""SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_totalprice > 200000""")
def j01_strict_lookup(spark, d):
    orders = table(spark, d, "orders").where(F.col("o_totalprice") > 200000).withColumnRenamed("o_custkey", "c_custkey")
    return pairs.strict_lookup(orders, table(spark, d, "customer"), "c_custkey").select("o_orderkey", "c_mktsegment")


@query("""WITH e AS (SELECT 'e1-' || user_id || '-' || CAST(ts AS DATE) AS id,
  max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events
  GROUP BY user_id, CAST(ts AS DATE))
  SELECT id, round(a, 4) AS "left", round(b, 4) AS "right" FROM e WHERE a IS NOT NULL AND b IS NOT NULL""")
def j04_j05_arm_swapped_self_join(spark, d):
    seen = events(spark, d).where(F.col("event_type").isin("view", "click")).withColumn(
        "id",
        F.concat(
            F.when(F.col("event_type") == "view", "e1-").otherwise("e2-"), F.col("user_id").cast("string"), F.lit("-"),
            F.col("day").cast("string"),
        ),
    )
    best = seen.groupBy("id").agg(F.round(F.max("value"), 4).alias("value"))
    return pairs.swapped_self_join(best, "id", "e1-", "e2-", "value", every=False)


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS x FROM events WHERE event_type = 'view'
  GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS y FROM events WHERE event_type = 'click'
  GROUP BY ALL)
  SELECT user_id, day, round(x, 6) AS x, round(y, 6) AS y FROM a FULL JOIN b USING (user_id, day)
  WHERE x IS NULL OR y IS NULL OR x > y""")
def j06_j07_two_source_pairs(spark, d):
    side = lambda kind, name: F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(name)
    # One pass and one shuffle instead of a join of the table with itself.
    both = events(spark, d).where(F.col("event_type").isin("view", "click")).groupBy("user_id", "day").agg(
        side("view", "x"), side("click", "y"),
    )
    return both.where("x IS NULL OR y IS NULL OR x > y").select(
        "user_id", "day", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
    )


@query("""SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a,
  count(*) FILTER (b AND NOT a) AS only_b FROM
  (SELECT user_id, bool_or(event_type = 'purchase' AND value > 80) AS a,
  bool_or(event_type = 'signup' AND value > 80) AS b FROM events GROUP BY 1)""")
def j08_key_overlap(spark, d):
    seen = events(spark, d)
    return pairs.key_overlap(
        seen.where("event_type = 'purchase' AND value > 80"), seen.where("event_type = 'signup' AND value > 80"),
        ["user_id"],
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j09_semi_join(spark, d):
    big = table(spark, d, "orders").where(F.col("o_totalprice") > 300000)
    return table(spark, d, "customer").join(
        big, F.col("c_custkey") == F.col("o_custkey"), "left_semi",
    ).select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders
  WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def j10_resume_anti_join(spark, d):
    log = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return resume.still_to_do(
        table(spark, d, "customer"), log, ["c_custkey"], F.col("o_orderstatus") == "F",
    ).select("c_custkey")


@query("""WITH done AS (SELECT DISTINCT user_id FROM events
  WHERE event_type = 'purchase' AND value > 60), derived AS (SELECT DISTINCT user_id FROM events
  WHERE event_type = 'click' AND value > 60)
  SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id
  FROM done) OR user_id NOT IN (SELECT user_id FROM derived)""")
def j11_composite_completeness(spark, d):
    seen = events(spark, d).groupBy("user_id").agg(
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("done"),
        F.bool_or((F.col("event_type") == "click") & (F.col("value") > 60)).alias("derived"),
    )
    return seen.where("NOT done OR NOT derived").select("user_id")


@query("SELECT r_name, p AS priority FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def j12_cross_grid(spark, d):
    return table(spark, d, "region").select("r_name").join(
        table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority")).distinct(), how="cross",
    )


@query("""WITH f AS (SELECT conv_id, turn, lower(strip_accents(text)) AS text, lower(strip_accents(split_part(text, ' ', 1))) AS own
  FROM conversations WHERE role = 'assistant'),
  w AS (SELECT list_filter(str_split(text, ' '), lambda x: x <> '') AS w FROM benchmark),
  t AS (SELECT DISTINCT lower(strip_accents(token)) AS token FROM (SELECT unnest(w) AS token FROM w UNION ALL
    SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w))
  SELECT conv_id, turn, token FROM f JOIN t ON contains(text, token) AND token <> own
    AND regexp_matches(text, '(^|[^a-z])' || regexp_escape(token) || '($|[^a-z])')""")
def j13_tokens_in_responses(spark, d):
    """Every other row's token in every response: the words, and each two words, of all items; a response's own token is its first word."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    two = F.transform(F.slice(words, 2, F.size(words)), lambda x, i: F.concat(words[i], F.lit(" "), x))
    tokens = table(spark, d, "benchmark").where("text IS NOT NULL").select(F.explode(F.concat(words, two)).alias("token"))
    responses = table(spark, d, "conversations").where(F.col("role") == "assistant")
    responses = responses.withColumn("own", F.substring_index("text", " ", 1))
    return token_tables.token_hits(responses, tokens.distinct(), ["conv_id", "turn"], own="own")


@query("""WITH t AS (SELECT item_id, text AS probe FROM benchmark),
  n AS (SELECT item_id, CAST(sum((length(text) - length(replace(text, probe, ''))) // length(probe)) AS BIGINT) AS n,
  count(*) AS documents FROM documents JOIN t ON contains(text, probe) GROUP BY 1)
  SELECT *, n >= 3 AS flagged FROM n""")
def j14_contained_counts(spark, d):
    return contained.counts(table(spark, d, "documents"), table(spark, d, "benchmark"), least=3)


@query("""SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def j15_three_way_join(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )
    # Lines are added up by order before the join.
    items = items.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("net").alias("net"))
    joined = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(
        F.sum("lines").alias("n"), F.round(F.sum("net"), 4).alias("revenue"),
    )


@query("""SELECT count(*) AS shared FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' INTERSECT
  SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')""")
def j17_u02_disjointness(spark, d):
    keys = lambda kind: events(spark, d).where(F.col("event_type") == kind).select("user_id")
    return keys("signup").intersect(keys("purchase")).agg(F.count("*").alias("shared"))


@query(f"WITH {PAIRS_SQL} SELECT user_id, day, v AS view, c AS click FROM pair")
def p01_last_wins_pairs(spark, d):
    return day_pairs(spark, d)


@query("""SELECT user_id, CAST(ts AS DATE) AS day, event_type, arg_max(value, (ts, event_id)) AS value FROM events e
  WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND CAST(x.ts AS DATE) = CAST(e.ts AS DATE) AND
  x.event_type = 'error') GROUP BY ALL""")
def p02_sticky_exclusion(spark, d):
    kept = pairs.without_tombstoned(events(spark, d), ["user_id", "day"], F.col("event_type") == "error")
    return pairs.last_wins(
        kept.select("user_id", "day", "event_type", "value", "ts", "event_id"), ["user_id", "day", "event_type"],
        ["ts", "event_id"],
    ).select("user_id", "day", "event_type", "value")


@query(f"""WITH {PAIRS_SQL} SELECT CASE WHEN v IS NULL THEN 'no view' WHEN c IS NULL THEN 'no click'
  ELSE 'complete' END AS reason, count(*) AS n FROM pair GROUP BY 1""")
def p03_incomplete_pairs(spark, d):
    return pairs.missing_reason(day_pairs(spark, d), ["view", "click"]).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) - count(DISTINCT (user_id, CAST(ts AS DATE))) AS collisions FROM events GROUP BY 1")
def p04_collisions(spark, d):
    cells = events(spark, d).groupBy("event_type", "user_id", "day").agg(F.count("*").alias("n"))
    return cells.groupBy("event_type").agg(F.sum(F.col("n") - 1).alias("collisions"))


@query("SELECT doc_id, unnest(str_split(text, ' ')) AS word, lang FROM documents")
def p05_explode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"), "lang")


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole, CAST(count(*) AS INTEGER) AS turns
  FROM conversations GROUP BY 1""")
def p05_concat_back(spark, d):
    # A conversation's own turns: its rows are one record in the input.
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p")
    )
    return parts.select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("whole"), F.size("p").alias("turns"),
    )


@query(f"""WITH {PAIRS_SQL} SELECT v AS view, c AS click, count(*) AS n FROM pair
  WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2""")
def p06_p08_cross_table(spark, d):
    return day_pairs(spark, d).where(
        "view IS NOT NULL AND click IS NOT NULL"
    ).groupBy("view", "click").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT user_id % 8 AS frame, weekday, count(*) FILTER (v AND NOT c) AS k, count(*) AS n
  FROM (SELECT *, CAST(isodow(day) AS INTEGER) AS weekday FROM pair) WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)
  SELECT frame, '{{' || string_agg('"' || weekday || '":[' || k || ',' || n || ']', ',' ORDER BY weekday) || '}}' AS forms FROM c GROUP BY 1""")
def p06_nested_table(spark, d):
    """frame -> form -> [k, n] as one object a frame: discordant and all pairs by weekday."""
    pair = day_pairs(spark, d).where("view IS NOT NULL AND click IS NOT NULL").withColumns({
        "frame": F.col("user_id") % 8, "weekday": F.weekday("day") + 1,
    })
    cells = pair.groupBy("frame", "weekday").agg(F.count_if(F.col("view") & ~F.col("click")).alias("k"), F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("weekday"), F.array("k", "n").alias("kn"))))
    nested = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["weekday"].cast("string"), e["kn"])))
    return cells.groupBy("frame").agg(F.to_json(nested).alias("forms"))


@query("""SELECT event_id, rank() OVER (PARTITION BY user_id
  ORDER BY value) AS rk, round((2 * rank() OVER (PARTITION BY user_id
  ORDER BY value) + count(*) OVER (PARTITION BY user_id, value) - 1) / 2, 1) AS average_rank FROM events""")
def w01_ranks(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "value")
    ranks = scans.ranks(rows, "value", ["user_id"])
    same = rows.user_id.eqNullSafe(ranks.user_id) & rows.value.eqNullSafe(ranks.value)
    average = F.round((2 * F.col("rank") + F.col("ties") - 1) / 2, 1)
    return rows.join(ranks, same).select("event_id", F.col("rank").cast("int").alias("rk"), average.alias("average_rank"))


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 4""")
def w02_first_of_group(spark, d):
    return table(spark, d, "orders").withColumn(
        "r", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")),
    ).where("r <= 4").select("o_orderpriority", "o_orderkey")


@query("""SELECT event_id, max(value) OVER w AS most, min(value) OVER w AS least, CAST(sum(CASE
  WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS record, row_number() OVER (PARTITION BY user_id
  ORDER BY ts, event_id) % 3 AS third
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w03_w05_w07_running(spark, d):
    signup = F.when(F.col("event_type") == "signup", 1).otherwise(0)
    found = scans.scanned(
        events(spark, d).select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"], {
            "most": ("max", F.col("value")), "least": ("min", F.col("value")), "record": ("sum", signup),
            "place": ("sum", F.lit(1)),
        },
    )
    return found.select("event_id", "most", "least", "record", (F.col("place") % 3).alias("third"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION
  BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events""")
def w06_carry_forward(spark, d):
    header = F.when(F.col("event_type") == "signup", F.col("event_id"))
    rows = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    return scans.scanned(rows, ["user_id"], ["ts", "event_id"], {"header": ("last", header)}).select("event_id", "header")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id
  ORDER BY sha256(concat_ws('|', 'order', event_id)), event_id) AS position, CAST(('0x' || left(sha256(concat_ws('|',
  event_type, event_id)), 2)) AS INTEGER) % 2 AS parity FROM events""")
def w08_h03_schedule(spark, d):
    return sampling.schedule(events(spark, d), "order", ["user_id"], "event_id").select(
        "event_id", F.col("position").cast("bigint").alias("position"),
        sampling.digest_parity(F.col("event_type"), F.col("event_id").cast("string")).alias("parity"),
    )


@query("""SELECT user_id, coalesce(arg_min(event_id, (ts, event_id)) FILTER (event_type <> 'error'), arg_max(event_id,
  (ts, event_id))) AS event_id, count(*) FILTER (event_type <> 'error') = 0 AS is_error FROM events GROUP BY 1""")
def w09_first_success(spark, d):
    return pairs.first_success(
        events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error",
    ).select("user_id", "event_id", "is_error")


@query("""SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts,
  event_id)) AS value FROM events GROUP BY 1, 2""")
def w10_last_wins(spark, d):
    return pairs.last_wins(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value",
    )


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 12")
def w11_w12_most_common(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.count("*").alias("n")
    ).orderBy(F.desc("n"), "p_brand").limit(12)


@query("""SELECT 'signup' AS source, user_id, value, NULL::VARCHAR AS props FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'purchase', user_id, NULL, props FROM events WHERE event_type = 'purchase'""")
def u01_union_of_sources(spark, d):
    seen = events(spark, d)
    a = seen.where("event_type = 'signup'").select(F.lit("signup").alias("source"), "user_id", "value")
    return a.unionByName(
        seen.where("event_type = 'purchase'").select(F.lit("purchase").alias("source"), "user_id", "props"),
        allowMissingColumns=True,
    ).select("source", "user_id", "value", "props")


@query("SELECT min(doc_id) AS doc_id, source, count(*) AS copies FROM documents GROUP BY source, text")
def u03_exact_dedup(spark, d):
    # By the text's whole digest: the shuffle moves 32 bytes a row, not the text.
    docs = table(spark, d, "documents").select("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("digest"))
    return docs.groupBy("source", "digest").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
    ).select("doc_id", "source", "copies")


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(str_split(text, ' ')) AS words FROM conversations)
  SELECT a.conv_id, a.turn, CAST(len(list_filter(b.words, lambda x: NOT list_contains(a.words,
  x))) AS BIGINT) AS added, CAST(len(list_filter(a.words, lambda x: NOT list_contains(b.words,
  x))) AS BIGINT) AS dropped FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def u04_block_difference(spark, d):
    # Two turns of a conversation follow each other: a window, not a join of the table with itself.
    words = table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = words.withColumns(
        {"next_words": F.lead("words").over(order), "next_turn": F.lead("turn").over(order)}
    ).where(F.col("next_turn") == F.col("turn") + 1)
    return following.select(
        "conv_id", "turn", F.size(F.array_except("next_words", "words")).cast("bigint").alias("added"),
        F.size(F.array_except("words", "next_words")).cast("bigint").alias("dropped"),
    )


@query("""SELECT 'unique' AS "check", o_custkey || '|' || CAST(o_orderdate AS DATE) AS key,
  CAST(count(*) AS VARCHAR) AS detail FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1
  UNION ALL SELECT 'reference', CAST(l_orderkey AS VARCHAR), 'unknown' FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  UNION ALL SELECT 'range', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders
  WHERE o_orderkey NOT BETWEEN 1 AND 1000
  UNION ALL SELECT 'allowed', CAST(event_id AS VARCHAR), event_type FROM events
  WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')
  UNION ALL SELECT 'cell', event_type || '|' || user_id, CAST(count(*) AS VARCHAR) FROM events
  GROUP BY event_type, user_id HAVING count(*) <> 12""")
def v02_v04_v05_v06_v09_contracts(spark, d):
    orders, seen = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), events(spark, d)
    known = orders.where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "l_orderkey")
    return contracts.all_of(
        contracts.unique(orders, ["o_custkey", "day"]),
        contracts.referential(table(spark, d, "lineitem"), known, "l_orderkey"),
        contracts.within(orders, "o_orderkey", "o_orderkey", F.lit(1), F.lit(1000)),
        contracts.allowed(seen, "event_id", "event_type", ["view", "click", "purchase", "signup"]),
        contracts.cell_counts(seen, ["event_type", "user_id"], 12),
    )


@query("""WITH g AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS
  JOIN (SELECT DISTINCT event_type FROM events) t),
  n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT 'grid' AS "check", g.user_id || '|' || g.event_type AS key, CAST(coalesce(n, 0) AS VARCHAR) AS detail FROM g
  LEFT JOIN n ON g.user_id = n.user_id AND g.event_type = n.event_type WHERE coalesce(n, 0) <> 1""")
def v03_j16_complete_grid(spark, d):
    seen = events(spark, d)
    return contracts.complete_grid(
        seen, seen.select("user_id").distinct(), seen.select("event_type").distinct(), ["user_id", "event_type"],
    )


@query("""WITH a AS (SELECT user_id, max(value) AS value, count(*) AS n FROM events WHERE event_type = 'view'
  GROUP BY 1), b AS (SELECT user_id, max(value) AS value, count(*) AS n FROM events WHERE event_type = 'click'
  GROUP BY 1)
  SELECT 'pair' AS "check", CAST(a.user_id AS VARCHAR) AS key, unnest(list_filter([CASE WHEN a.value IS DISTINCT
  FROM b.value THEN 'value' END, CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END], lambda x: x IS NOT NULL)) AS detail
  FROM a JOIN b ON a.user_id = b.user_id""")
def v08_pair_equality(spark, d):
    side = lambda kind: events(spark, d).where(F.col("event_type") == kind).groupBy("user_id").agg(
        F.max("value").alias("value"), F.count("*").alias("n"),
    )
    return contracts.pairs_equal_but(side("view"), side("click"), "user_id", [])


@query("""SELECT 'identity' AS "check", l_partkey || '|' || l_suppkey AS key,
  CAST(count(DISTINCT l_returnflag) AS VARCHAR) AS detail FROM lineitem GROUP BY l_partkey, l_suppkey
  HAVING count(DISTINCT l_returnflag) > 1""")
def v12_group_identity(spark, d):
    return contracts.same_in_group(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("""SELECT o_orderpriority, n, round(CASE WHEN n = 0 THEN 1.0 ELSE 1 - pow(0.05, 1.0 / n) END, 6) AS upper_bound
  FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def x04_zero_event_bound(spark, d):
    cells = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.lit(0).cast("long").alias("x"),
    )
    return cells.select(
        "o_orderpriority", "n", F.round(stats.clopper_pearson_upper(F.col("x"), F.col("n")), 6).alias("upper_bound"),
    )
