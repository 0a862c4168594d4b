"""5. URL filters: the log-likelihood ratio of two variable-order character models, in DataFrame and SQL functions only.

URLs that a rule allows or blocks train two Markov models over the characters as they stand (only A-Z are lower-cased)
and one sign for the end. A model mixes contexts of ``ORDER``, ..., 1, 0 characters with Witten-Bell weights: a context
that a URL kind has not shown gives way to the shorter one. A URL without a rule is judged by the difference of the two
log-likelihoods, divided by its length, against the threshold that best separates the rule-judged URLs left out of
training (one in five by SHA-256).

Everything counted is a table that grows with the input; there is no fixed alphabet and no cap. Equal URLs are counted
once with their number. A URL's grams (a context and its character) are counted once, and shorter grams are summed from
longer ones, so only distinct grams move. Levels are joined from the empty context up, each by the gram without its
first character, so no key holds more rows than there are characters. Each level is written, so that no plan holds them all,
and joins but those of hot keys are told to be by shuffle: a small file may be a large table in the driver. Ratios come to URLs by ``looked_up``: keys that
hold more than 1 of ``HOT`` of all rows, of which there are at most ``HOT``, are broadcast and summed where they stand,
the others are joined by shuffle.

Null or malformed urls have an empty host and path and fit no rule; they are still scored (a null as an empty url).
Without training urls of both kinds every ratio is 0 and the verdict is allow. Repeated rows repeat. Very long urls are
scored whole. An empty table gives an empty one. Columns other than the id and the url are not carried, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the longest context; the signs that stand before a URL and after it (no URL holds control characters).
ORDER, BEFORE, AFTER = 5, "\u0002", "\u0003"
#: A key with over 1 of so many rows is hot; there can't be more of them than this.
HOT = 4096
#: Steps of a score at which the threshold may lie, and how many on either side of 0.
STEP, STEPS = 0.02, 250

Rule = tuple[str, str, str]  # verdict, host, path


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with host and path of its column url."""
    out = df.withColumn(
        "_rest", F.expr("coalesce(CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END, '')"),
    )
    out = out.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0)
    return out.withColumns({"host": F.translate("_host", UPPER, LOWER), "path": path}).drop("_rest", "_host")


def longest_rule(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits columns host and path; null if none does."""
    found = F.lit(None)
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = (
            (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        ) & F.startswith(F.col("path"), F.lit(path))
        found = F.when(
            fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        ).otherwise(found)
    return found


def with_grams(urls: DataFrame) -> DataFrame:
    """A row with ``gram`` for each character of the url and its end: a string of it and the ``ORDER`` characters before."""
    whole = F.concat(F.lit(BEFORE * ORDER), F.translate("url", UPPER, LOWER), F.lit(AFTER))
    # As shifted arrays: a place in a long string would be found by counting from its start, each time.
    signs = urls.withColumn("signs", F.filter(F.split(whole, ""), lambda c: c != ""))
    shifted = [F.slice("signs", F.lit(k + 1), F.size("signs") - ORDER).alias(f"c{k}") for k in range(ORDER + 1)]
    each = signs.select(*urls.columns, F.inline(F.arrays_zip(*shifted)).alias(*[f"c{k}" for k in range(ORDER + 1)]))
    return each.select(*urls.columns, F.concat(*[f"c{k}" for k in range(ORDER + 1)]).alias("gram"))


def counted(urls: DataFrame) -> DataFrame:
    """gram, n (of all urls), n1 and n0 (of those that train, allowed and blocked).

    ``urls``: one row for each distinct url, with its number ``n`` and ``trains`` (true: allowed; false: blocked; null).
    """
    seen = with_grams(urls.select("url", "n", "trains"))
    kind = lambda allowed: F.sum(F.when(F.col("trains") == allowed, F.col("n")).otherwise(0))
    return seen.groupBy("gram").agg(F.sum("n").alias("n"), kind(True).alias("n1"), kind(False).alias("n0"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram, n, ratio: ln P(last character | those before; allowed) - ln P(...; blocked).

    P for a context of j characters is (count + kinds * P of j - 1) / (total + kinds), with the kinds of characters that
    followed the context; for an unseen context it is P of j - 1; for none it is (count + 1) / (total + all kinds + 1).
    Without training urls of both kinds every ratio is 0.
    """
    level = {ORDER: counts}
    for j in range(ORDER - 1, -1, -1):
        sums = [F.sum(c).alias(c) for c in ("n1", "n0")]
        level[j] = written(level[j + 1].groupBy(F.substring("gram", 2, j + 1).alias("gram")).agg(*sums), f"level{j}")
    total1, total0, signs = level[0].agg(
        F.sum("n1"), F.sum("n0"), F.count_if((F.col("n1") > 0) | (F.col("n0") > 0)) + 1,
    ).first()
    totals = {1: total1 or 0, 0: total0 or 0}
    if not all(totals.values()):
        return counts.select("gram", "n", F.lit(0.0).alias("ratio"))
    known = level[0].select(
        "gram", *[((F.col(f"n{k}") + 1) / F.lit(float(totals[k] + signs))).alias(f"p{k}") for k in (1, 0)],
    )
    for j in range(1, ORDER + 1):
        context, shorter = F.substring("gram", 1, j).alias("context"), F.substring("gram", 2, j).alias("shorter")
        of = [
            x
            for k in (1, 0)
            for x in (F.sum(f"n{k}").alias(f"of{k}"), F.count_if(F.col(f"n{k}") > 0).alias(f"kinds{k}"))
        ]
        contexts = level[j].groupBy(context).agg(*of)
        joined = level[j].select("*", context, shorter).join(contexts.hint("merge"), "context").join(
            known.withColumnRenamed("gram", "shorter").hint("merge"), "shorter",
        )
        mixed = [
            F.expr(
                f"CASE WHEN of{k} = 0 THEN p{k} ELSE (n{k} + kinds{k} * p{k}) / (of{k} + kinds{k}) END"
            ).alias(f"p{k}")
            for k in (1, 0)
        ]
        known = joined.select("gram", *(["n"] if j == ORDER else []), *mixed)
        if j < ORDER:
            known = written(known, f"known{j}")
    return known.select("gram", "n", (F.ln("p1") - F.ln("p0")).alias("ratio"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, reduced) -> DataFrame:
    """``reduced`` of ``rows`` with the columns of ``table`` (key, n: the key's rows, values), hot keys apart from the others."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot, others = table.where(F.col("n") * HOT > total).drop("n"), table.where(F.col("n") * HOT <= total).drop("n")
    return reduced(rows.join(F.broadcast(hot), key)).unionByName(
        reduced(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others.hint("merge"), key))
    )


def scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """url, score: the sum of the ratios of its grams over their number."""
    each = with_grams(urls.select("url"))
    sums = looked_up(
        each, ratios, "gram", lambda x: x.groupBy("url").agg(F.sum("ratio").alias("sum"), F.count("*").alias("size")),
    )
    return sums.groupBy("url").agg((F.sum("sum") / F.sum("size")).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the threshold (a step of STEP) of the best balanced accuracy; ties go to the one nearest 0; 0 without both kinds.

    ``scored``: columns score, allowed and n. Works on a histogram of 2 * STEPS + 1 bins.
    """
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(F.round("score", 9) / STEP))).cast("int")
    kind = lambda allowed: F.sum(F.when(F.col("allowed") == allowed, F.col("n")).otherwise(0))
    bins = scored.groupBy(step.alias("step")).agg(kind(True).alias("n1"), kind(False).alias("n0"))
    whole = Window.partitionBy(F.lit(0))
    upward = whole.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    right = F.try_divide(F.sum("n1").over(upward), F.sum("n1").over(whole)) + 1 - F.try_divide(
        F.sum("n0").over(upward), F.sum("n0").over(whole),
    )
    order = F.struct("right", -F.abs("step"), "step")
    best = bins.withColumn("right", F.round(right, 9)).agg(
        F.max_by("step", order).alias("step"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
    )
    return best.select(F.expr(f"CASE WHEN n0 > 0 AND n1 > 0 THEN step * {STEP}D ELSE 0D END").alias("threshold"))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    known = parsed(source).withColumn("found", longest_rule(rules)).withColumn("url", F.coalesce("url", F.lit("")))
    allowed = F.when(F.col("found").isNotNull(), F.col("found.verdict") == "allow")
    left_out = F.conv(F.left(F.sha2("url", 256), F.lit(8)), 16, 10).cast("long") % 5 == 0
    # Equal urls have equal hosts, paths and rules.
    distinct = written(known.groupBy("url").agg(F.count("*").alias("n"), F.any_value(allowed).alias("allowed")), "urls")
    counts = written(counted(distinct.withColumn("trains", F.when(~left_out, F.col("allowed")))), "grams")
    ratios = written(log_ratios(counts), "ratios")  # written, as several plans below read it
    found = written(scores(distinct, ratios).join(distinct.hint("merge"), "url"), "scores")
    limit = threshold(found.where(left_out & F.col("allowed").isNotNull())).scalar()
    own = F.when(F.round("score", 9) >= F.coalesce(limit, F.lit(0.0)), "allow").otherwise("block")
    out = looked_up(known, found.select("url", "n", "score"), "url", lambda x: x)
    return out.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), own).alias("verdict"), F.round("score", 6).alias("score"),
    )


def sql(rules: list[Rule]) -> str:
    """The same in DuckDB's SQL, over the view pages (page_id, url)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(
        f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN {{'rule': {quoted(h + p)}, 'verdict': {quoted(v)}}}"
        for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2]), reverse=True)
    )
    levels, p = [], []
    for j in range(ORDER - 1, -1, -1):
        levels.append(
            f"s{j} AS (SELECT substring(gram, 2, {j + 1}) AS gram, sum(n1) AS n1, sum(n0) AS n0 FROM s{j + 1} GROUP BY 1)"
        )
    for j in range(1, ORDER + 1):
        mixed = ", ".join(
            f"CASE WHEN of{k} = 0 THEN p{k} ELSE (n{k} + kinds{k} * p{k}) / (of{k} + kinds{k}) END AS p{k}"
            for k in (1, 0)
        )
        of = ", ".join(f"CAST(sum(n{k}) AS DOUBLE) AS of{k}, count(*) FILTER (n{k} > 0) AS kinds{k}" for k in (1, 0))
        p.append(f"""c{j} AS (SELECT left(gram, {j}) AS context, {of} FROM s{j} GROUP BY 1),
p{j} AS (SELECT s.gram, {mixed} FROM s{j} s JOIN c{j} ON context = left(s.gram, {j}) JOIN p{j - 1} q ON q.gram = substring(s.gram, 2, {j}))""")
    marked = f"(repeat(chr({ord(BEFORE)}), {ORDER}) || translate(url, '{UPPER}', '{LOWER}') || chr({ord(AFTER)}))"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE
  WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM a),
k AS (SELECT page_id, url, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substring(rest,
  length(raw) + 1), '^[^?#]*', 0) AS path FROM b),
known AS (SELECT *, CASE {cases} END AS found FROM k),
u AS (SELECT url, count(*) AS n, any_value(found.verdict = 'allow') AS allowed, CAST('0x' || left(sha256(url),
  8) AS BIGINT) % 5 = 0 AS left_out FROM known GROUP BY url),
g AS (SELECT url, n, CASE WHEN NOT left_out THEN allowed END AS trains, unnest(list_transform(range(1,
  length({marked}) - {ORDER} + 1), lambda i: substring({marked}, i, {ORDER + 1}))) AS gram FROM u),
s{ORDER} AS (SELECT gram, coalesce(sum(n) FILTER (trains), 0) AS n1, coalesce(sum(n) FILTER (NOT trains), 0) AS n0
  FROM g GROUP BY gram),
{", ".join(levels)},
t AS (SELECT CAST(sum(n1) AS DOUBLE) AS total1, CAST(sum(n0) AS DOUBLE) AS total0,
  count(*) FILTER (n1 > 0 OR n0 > 0) + 1 AS signs FROM s0),
p0 AS (SELECT gram, (n1 + 1) / (total1 + signs) AS p1, (n0 + 1) / (total0 + signs) AS p0 FROM s0, t),
{", ".join(p)},
f AS (SELECT u.url, n, allowed, left_out, CASE WHEN (SELECT total1 > 0 AND total0 > 0 FROM t) THEN score
  ELSE 0.0 END AS score
      FROM u JOIN (SELECT url, sum(ln(p1) - ln(p0)) / count(*) AS score FROM g JOIN p{ORDER} USING (gram)
  GROUP BY url) USING (url)),
h AS (SELECT CAST(greatest(-{STEPS}, least({STEPS}, floor(round(score, 9) / {STEP}))) AS INTEGER) AS step,
  coalesce(sum(n) FILTER (allowed), 0) AS n1, coalesce(sum(n) FILTER (NOT allowed), 0) AS n0
      FROM f WHERE left_out AND allowed IS NOT NULL GROUP BY 1),
r AS (SELECT step, round(sum(n1) OVER w / sum(n1) OVER () + 1 - sum(n0) OVER w / sum(n0) OVER (), 9) AS accuracy
  FROM h WINDOW w AS (ORDER BY step DESC ROWS UNBOUNDED PRECEDING)),
best AS (SELECT coalesce((SELECT CASE WHEN (SELECT sum(n1) > 0 AND sum(n0) > 0
  FROM h) THEN step * CAST({STEP} AS DOUBLE) ELSE 0.0 END
         FROM r ORDER BY accuracy DESC, abs(step), step DESC LIMIT 1), 0.0) AS threshold)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, CASE
  WHEN round(f.score, 9) >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(f.score, 6) AS score
FROM known JOIN f ON known.url = f.url, best"""
