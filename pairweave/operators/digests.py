"""A tree of digests over a table's rows, so that whole tables are bound by one root and differences are found by descending.

Rows have a key and a digest. A key's SHA-256 says in which leaf it is; a leaf's digest is that of its rows by key, an inner
node's that of its nodes in order. Two trees differ below a node if and only if the node's digests differ: rows are compared
only in the leaves where they do. A leaf is to hold some hundred rows: one more byte of ``depth`` makes 256 times as many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = ""


def leaf_of(key: str, depth: int):
    return F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2 * depth)


def tree(rows: DataFrame, key: str, digest: str, depth: int = 1) -> DataFrame:
    """``level`` (0: root), ``node`` (the first bytes of the keys' hashes, in hex) and ``digest`` of each node that has rows.

    Repeated rows count; null keys and digests are not allowed. A table without rows has a root, the digest of nothing.
    """
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.col(digest))
    nodes = rows.groupBy(leaf_of(key, depth).alias("node")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    levels = [nodes.select(F.lit(depth).alias("level"), "node", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))]
    for level in range(depth - 1, -1, -1):
        below = levels[-1].groupBy(F.substring("node", 1, 2 * level).alias("node")) if level else levels[-1].groupBy()
        lines = F.array_join(F.array_sort(F.collect_list(F.concat("node", F.lit(":"), "digest"))), "\n")
        made = below.agg(F.sha2(lines, 256).alias("digest"))
        node = F.col("node") if level else F.lit(ROOT).alias("node")
        levels.append(made.select(F.lit(level).alias("level"), node, "digest"))
    return reduce(DataFrame.unionByName, levels)


def root(of: DataFrame) -> DataFrame:
    return of.where("level = 0").select("digest")


def differing_leaves(a: DataFrame, b: DataFrame, depth: int = 1) -> DataFrame:
    """``node`` of the leaves that differ between two trees, by descending from nodes that do."""
    differ = None
    for level in range(depth + 1):
        x, y = (t.where(F.col("level") == level).select("node", F.col("digest").alias(name)) for t, name in ((a, "_a"), (b, "_b")))
        both = x.join(y, "node", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        if differ is not None:
            above = F.substring("node", 1, 2 * (level - 1)) if level > 1 else F.lit(ROOT)
            both = both.withColumn("_above", above).join(differ.select(F.col("node").alias("_above")), "_above", "left_semi").drop("_above")
        differ = both
    return differ


def differences(
    recorded: DataFrame, actual: DataFrame, key: str, digest: str, trees: tuple[DataFrame, DataFrame], depth: int = 1,
) -> DataFrame:
    """``key`` and ``problem`` (gone, not recorded, changed) of rows that differ; only rows of differing leaves are joined."""
    leaves = differing_leaves(*trees, depth)
    some = [
        t.withColumn("node", leaf_of(key, depth)).join(leaves, "node", "left_semi").select(F.col(key).alias("key"), F.col(digest).alias(name))
        for t, name in ((recorded, "_r"), (actual, "_a"))
    ]
    problem = F.when(F.col("_a").isNull(), "gone").when(F.col("_r").isNull(), "not recorded").otherwise("changed")
    return some[0].join(some[1], "key", "full").where(~F.col("_r").eqNullSafe(F.col("_a"))).select("key", problem.alias("problem"))
