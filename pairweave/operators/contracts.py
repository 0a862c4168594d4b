"""Contracts: each returns its violations, (check, key, detail); no rows means that it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"),
    )


def required(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    bad = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]
    return _report(df.withColumn("_c", F.explode(F.array_compact(F.array(*bad)))), "required", F.col(key), F.col("_c"))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return _report(
        df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), "unique", F.concat_ws("|", *keys), F.col("_n"),
    )


def complete_grid(df: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str], most: int = 2_000_000) -> DataFrame:
    """Exactly one row for each of ``rows`` x ``columns``; no key is null. ``keys`` names both sides' columns.

    The grid itself is not made: a row that has as many different columns as there are lacks none. Only rows that lack some
    meet the columns, so that what is made is what is missing or stands in such a row. Up to ``most`` columns are broadcast.
    """
    own, wanted = rows.distinct(), columns.distinct()
    n_columns = wanted.count()
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    # Cells of the grid only, so that a row's number of cells tells whether it is complete.
    inside = counted.join(F.broadcast(wanted) if n_columns <= most else wanted, wanted.columns, "left_semi")
    inside = inside.join(own, own.columns, "left_semi")
    repeated = inside.where("_n > 1")
    cells = inside.groupBy(*own.columns).agg(F.count("*").alias("_cells"))
    short = own.join(cells, own.columns, "left").where(F.coalesce("_cells", F.lit(0)) < n_columns).drop("_cells")
    missing = short.crossJoin(F.broadcast(wanted) if n_columns <= most else wanted).join(inside, keys, "left_anti")
    both = missing.select(*keys, F.lit(0).cast("long").alias("_n")).unionByName(repeated.select(*keys, "_n"))
    return _report(both, "grid", F.concat_ws("|", *keys), F.col("_n"))


def unique_folded(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once whatever their case."""
    folded = df.where(F.col(column).isNotNull()).select(F.lower(column).alias("_v"))
    return _report(
        folded.groupBy("_v").agg(F.count("*").alias("_n")).where("_n > 1"), "unique", F.col("_v"), F.col("_n"),
    )


def disjoint(df: DataFrame, role: str, key: str) -> DataFrame:
    """Keys that occur under more than one role."""
    roles = df.groupBy(key).agg(F.count_distinct(role).alias("_n")).where("_n > 1")
    return _report(roles, "disjoint", F.col(key), F.col("_n"))


def cell_counts(df: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    return _report(
        df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") != wanted), "cell", F.concat_ws("|", *keys),
        F.col("_n"),
    )


def referential(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return _report(df.join(other.select(key), key, "left_anti"), "reference", F.col(key), F.lit("unknown"))


def within(df: DataFrame, key: str, column: str, low: Column, high: Column) -> DataFrame:
    return _report(df.where(~F.col(column).between(low, high)), "range", F.col(key), F.col(column))


def allowed(df: DataFrame, key: str, column: str, values: list) -> DataFrame:
    return _report(df.where(~F.col(column).isin(values)), "allowed", F.col(key), F.col(column))


def banned(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _report(
        df.where(F.rlike(column, F.lit(pattern))), "banned", F.col(key),
        F.regexp_extract(F.col(column), f"({pattern})", 1),
    )


def same_in_group(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return _report(
        df.groupBy(*keys).agg(F.count_distinct(column).alias("_n")).where("_n > 1"), "identity",
        F.concat_ws("|", *keys), F.col("_n"),
    )


def pairs_equal_but(a: DataFrame, b: DataFrame, key: str, but: list[str]) -> DataFrame:
    """Columns (all but the declared ones) in which paired rows differ; nulls are equal."""
    shared = [c for c in a.columns if c in b.columns and c != key and c not in but]
    joined = a.alias("a").join(b.alias("b"), key)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in shared]))
    return _report(joined.select(key, F.explode(differ).alias("_c")), "pair", F.col(key), F.col("_c"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with their number."""
    text = lambda df: df.select(
        F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row")
    )
    counted = text(a).withColumn("_d", F.lit(1)).union(
        text(b).withColumn("_d", F.lit(-1))
    ).groupBy("row").agg(F.sum("_d").alias("_n"))
    return _report(counted.where("_n <> 0"), "rows", F.col("row"), F.col("_n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: count and an order-free digest of all rows, for comparing two builds."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


def all_of(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, reports)
