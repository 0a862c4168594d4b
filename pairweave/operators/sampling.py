"""Samples and schedules by hash: the same rows in any engine and at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import scanned


def salted(salt: str, *ids: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in ids]), 256)


def per_stratum(df: DataFrame, strata: list[str], k: int, salt: str, *ids: str) -> DataFrame:
    """At most k rows of each stratum, those of least hash. Spark prunes to k a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(salted(salt, *ids), *ids))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def round_robin(df: DataFrame, strata: list[str], n: int, salt: str, *ids: str) -> DataFrame:
    """n rows, one stratum after the other."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(salted(salt, *ids), *ids))
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return ranked.orderBy("_rank", *strata).limit(n).drop("_rank")


Tier = tuple[str, Column, "int | None", list[str]]  # name, condition, cap (null: all), strata


def tiered(df: DataFrame, tiers: list[Tier], salt: str, key: str) -> DataFrame:
    """For each tier in turn, its rows that no earlier tier took, one stratum after the other up to its cap; ``tier`` names it.

    ``key`` is unique. What capped tiers took is bounded by their caps, and broadcast; a tier without a cap is joined by
    shuffle. Rank limits are literals, so that a task passes on no more than a cap of each stratum.
    """
    out, small = None, True
    for name, condition, cap, strata in tiers:
        rest = df.where(condition)
        if out is not None:
            taken = out.select(key)
            rest = rest.join(F.broadcast(taken) if small else taken, key, "left_anti")
        picked = rest if cap is None else round_robin(rest, strata, cap, salt, key)
        small = small and cap is not None
        picked = picked.select(*df.columns, F.lit(name).alias("tier"))
        out = picked if out is None else out.unionByName(picked)
    return out


def blind_views(sample: DataFrame, salt: str, key: str, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """What annotators see (``gid`` and ``shown``) and the key (``gid`` and all else), in an order by hash that tells nothing.

    ``sample`` is a bounded sample: its rows are numbered in one task.
    """
    numbered = sample.withColumn(
        "_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(salted(salt, key), key)),
    )
    numbered = numbered.withColumn("gid", F.format_string("g%03d", "_at")).drop("_at")
    return numbered.select("gid", *shown), numbered.select("gid", *[c for c in sample.columns if c not in shown])


def schedule(df: DataFrame, salt: str, groups: list[str], *ids: str) -> DataFrame:
    """``position`` of each row in its group's order of salted hashes, by a scan: no group is in one task."""
    hashed = df.withColumn("_hash", salted(salt, *ids))
    hashed = hashed.withColumn("_first", F.conv(F.substring("_hash", 1, 12), 16, 10).cast("long"))
    order = ["_first", "_hash", *ids]
    return scanned(hashed, groups, order, {"position": ("sum", F.lit(1).cast("long"))}).drop("_first", "_hash")


def digest_parity(*columns: Column) -> Column:
    """0 or 1 from the first byte of a digest: a balanced order of two options."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 2), 16, 10).cast("int") % 2
