"""Logs of attempts: the frozen final attempt of each item, and the digests that bind files to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def final_attempts(
    attempts: DataFrame, expected: DataFrame, resolutions: DataFrame, keys: list[str], attempt: str,
) -> DataFrame:
    """keys, attempt, status: one row for each expected key, each key with attempts and each resolution.

    A key with one attempt has it; one with several needs a resolution (keys and attempt, unique by keys) that names one
    of them. ``status``: single, resolved, or what is wrong: missing, unresolved, resolution of no recorded attempt,
    unknown item, unused resolution. ``attempt`` is null where it is wrong. No group is gathered: an attempt is
    compared with its key's resolution in place.
    """
    named = resolutions.select(*keys, F.col(attempt).alias("_named"))
    wanted = expected.select(*keys).distinct().withColumn("_expected", F.lit(True))
    logged = attempts.select(*keys, F.col(attempt).alias("_attempt"))
    counts = logged.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_attempt").alias("_one"))
    hits = logged.join(named, keys).where(
        F.col("_attempt") == F.col("_named")
    ).groupBy(*keys).agg(F.count("*").alias("_hits"))
    all_of = wanted.join(counts, keys, "full").join(
        named.withColumn("_has", F.lit(True)), keys, "full",
    ).join(hits, keys, "left")
    n, has = F.coalesce("_n", F.lit(0)), F.coalesce("_has", F.lit(False))
    status = (
        F.when(F.col("_expected").isNull() & (n > 0), "unknown item")
        .when(has & (n < 2), "unused resolution")
        .when(n == 0, "missing")
        .when(n == 1, "single")
        .when(~has | F.col("_named").isNull(), "unresolved")
        .when(F.coalesce("_hits", F.lit(0)) != 1, "resolution of no recorded attempt")
        .otherwise("resolved")
    )
    chosen = F.when(status == "single", F.col("_one")).when(status == "resolved", F.col("_named"))
    return all_of.select(*keys, chosen.alias(attempt), status.alias("status"))


def unbound(recorded: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem) where two tables of digests don't agree: changed, not recorded, or gone."""
    a, b = (
        df.select(F.col(key), F.col(digest).alias(name), F.lit(True).alias(f"_{name}"))
        for df, name in ((recorded, "recorded"), (actual, "actual"))
    )
    joined = a.join(b, key, "full")
    problem = F.when(F.col("_recorded").isNull(), "not recorded").when(F.col("_actual").isNull(), "gone").when(
        ~F.col("recorded").eqNullSafe(F.col("actual")), "changed",
    )
    return joined.select(F.col(key), problem.alias("problem")).where(F.col("problem").isNotNull())


def with_gate(result: DataFrame, problems: DataFrame) -> DataFrame:
    """``result``, whose rows are an error if there is any problem; ``problems`` is read once for it."""
    found = problems.agg(F.count("*")).scalar()
    first = result.columns[0]
    checked = F.when(
        found > 0, F.raise_error(F.concat(F.lit("problems: "), found.cast("string"))),
    ).otherwise(F.col(first))
    return result.withColumn(first, checked)
