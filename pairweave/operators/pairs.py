"""Observations to matched pairs, and what is counted over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order``. Aggregates before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*keys, "_r.*")


def first_success(df: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """One row a key: the first that did not fail, else the last; ``is_error`` tells which."""
    rest, at = F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)
    out = df.groupBy(*keys).agg(
        F.min_by(F.when(~failed, rest), F.when(~failed, at)).alias("_ok"), F.max_by(rest, at).alias("_last"),
    )
    return out.select(
        *keys, F.col("_ok").isNull().alias("is_error"), F.coalesce("_ok", "_last").alias("_r"),
    ).select(*keys, "is_error", "_r.*")


def matched(df: DataFrame, keys: list[str], arm: str, arms: list[str], value: str, order: list[str]) -> DataFrame:
    """A row a key with a column for each arm: the last value there, null where there is none."""
    at = F.struct(*order)
    return df.where(F.col(arm).isin(arms)).groupBy(*keys).agg(
        *[F.max_by(F.when(F.col(arm) == a, F.col(value)), F.when(F.col(arm) == a, at)).alias(a) for a in arms]
    )


def without_tombstoned(df: DataFrame, keys: list[str], excluded: Column) -> DataFrame:
    """The rows of keys that never had an excluded row, whatever came later."""
    return df.join(df.where(excluded).select(*keys).distinct(), keys, "left_anti")


def missing_reason(pairs: DataFrame, arms: list[str]) -> DataFrame:
    """``reason``: complete, or which arms a key lacks."""
    lacking = F.array_join(
        F.filter(F.array(*[F.when(F.col(a).isNull(), F.lit(a)) for a in arms]), lambda x: x.isNotNull()), "+",
    )
    return pairs.withColumn("reason", F.when(lacking == "", "complete").otherwise(F.concat(F.lit("no "), lacking)))


def discordant(pairs: DataFrame, first: Column, second: Column, by: list[str] | None = None) -> DataFrame:
    """n pairs with both sides, b (only the first holds), c (only the second)."""
    both = pairs.where(first.isNotNull() & second.isNotNull())
    return both.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(first & ~second).alias("b"), F.count_if(second & ~first).alias("c"),
    )


def swapped_self_join(df: DataFrame, id_col: str, old: str, new: str, value: str, every: bool = True) -> DataFrame:
    """(id, left, right): rows whose id has ``old``, with the row whose id has ``new`` in its place (each place, or the first)."""
    swapped = F.replace(F.col(id_col), F.lit(old), F.lit(new)) if every else F.regexp_replace(
        id_col, f"^(.*?)\\Q{old}\\E", f"$1{new}",
    )
    left = df.where(F.contains(id_col, F.lit(old))).select(
        F.col(id_col), F.col(value).alias("left"), swapped.alias("_other"),
    )
    return left.join(
        df.select(F.col(id_col).alias("_other"), F.col(value).alias("right")), "_other",
    ).select(id_col, "left", "right")


def key_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, only in a, only in b."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return x.join(y, keys, "full").agg(
        F.count_if(F.expr("_a = 1 AND _b = 1")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def strict_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner equi-lookup in which an unknown key is an error when its row is read."""
    found = df.join(lookup.withColumn("_known", F.lit(True)), key, "left")
    checked = F.when(
        F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown key: "), F.col(key).cast("string"))),
    ).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("_known")


def two_source_pairs(
    a: DataFrame, b: DataFrame, keys: list[str], value: str, excluded_a: Column, excluded_b: Column,
) -> DataFrame:
    """keys, first, second for keys that both sources have and neither ever marked as excluded (one tombstone drops the key).

    The value is that of the last ``ordinal``.
    """
    side = lambda df, bad, name: df.groupBy(*keys).agg(
        F.max_by(value, "ordinal").alias(name), F.bool_or(bad).alias(f"_{name}"),
    )
    joined = side(a, excluded_a, "first").join(side(b, excluded_b, "second"), keys)
    return joined.where("NOT _first AND NOT _second").select(*keys, "first", "second")


def with_missing_count(df: DataFrame, other: DataFrame, key: str, default: dict[str, Column]) -> DataFrame:
    """Left lookup: columns of ``other`` or their defaults, and ``missing`` (true where ``other`` has no row)."""
    found = df.join(other.select(key, *default, F.lit(True).alias("_known")), key, "left")
    missing = F.col("_known").isNull()
    filled = [F.when(missing, value).otherwise(F.col(name)).alias(name) for name, value in default.items()]
    return found.select(*df.columns, *filled, missing.alias("missing"))
