"""Test items generated from tables of witnesses: grids by rule tables, mutations, variants, extracted pairs, redated copies.

A rule table is a frozen list in the code; each witness row is expanded by it where it stands, so that a grid grows with
the witnesses and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cell:
    """A component of a grid: in which arm, for which clusters (from ``least`` to below ``below``), and with which forms, gaps and carriers."""

    component: str
    arm: str
    below: int
    forms: tuple[str, ...]
    gaps: tuple[str, ...]
    carriers: tuple[str, ...] = ("plain",)
    frames: tuple[str, ...] = ()  # none: all
    least: int = 0


def expanded(witnesses: DataFrame, cells: list[Cell], frame: str = "frame", cluster: str = "cluster") -> DataFrame:
    """``witnesses`` x the cells that their cluster and frame belong to: component, arm, form, gap, carrier."""
    rows = [
        (c.component, c.arm, c.least, c.below, c.frames, form, gap, carrier)
        for c in cells
        for form in c.forms
        for gap in c.gaps
        for carrier in c.carriers
    ]
    names = ("component", "arm", "form", "gap", "carrier")
    table = F.array(*[
        F.struct(
            *[F.lit(v).alias(n) for n, v in zip(names, (component, arm, form, gap, carrier), strict=True)],
            F.lit(least).alias("least"), F.lit(below).alias("below"), F.array(*map(F.lit, frames)).cast("array<string>").alias("frames"),
        )
        for component, arm, least, below, frames, form, gap, carrier in rows
    ])
    fits = lambda c: (F.col(cluster) >= c["least"]) & (F.col(cluster) < c["below"]) & (
        (F.size(c["frames"]) == 0) | F.array_contains(c["frames"], F.col(frame))
    )
    return witnesses.withColumn("_cell", F.explode(F.filter(table, fits))).select(
        *witnesses.columns, *[F.col(f"_cell.{n}") for n in names],
    )


def by_turn(options: list[str], cluster: Column) -> Column:
    """One of the options, in turn."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(cluster, F.lit(len(options))) + 1).cast("int"))


def held_out(cluster: Column) -> Column:
    """The split of a cluster: one in five is for the test."""
    return F.when(F.pmod(cluster, F.lit(5)) == 4, "test").otherwise("dev")


def subset(
    grid: DataFrame, rules: list[tuple[str, int, tuple[str, ...], tuple[str, ...]]], key: str = "case_id",
) -> DataFrame:
    """Rows that a rule (component, clusters below, forms, frames; none: all) admits; reading the key of one outside dev is an error."""
    wanted = F.lit(False)
    for component, below, forms, frames in rules:
        one = (F.col("component") == component) & (F.col("cluster") < below)
        one = one & F.col("form").isin(*forms) if forms else one
        wanted = wanted | (one & F.col("frame").isin(*frames) if frames else one)
    checked = F.when(F.col("split") == "dev", F.col(key)).otherwise(F.raise_error(F.lit("a subset must stay in dev")))
    return grid.where(wanted).withColumn(key, checked)


def merged(base: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Records with the right side's fields in place of their own."""
    return base.withColumns(changes)


#: Rows of a group that stand together in one list, about.
LIST_ROWS = 1024


def unseen_pairs(
    left: DataFrame, right: DataFrame, on: list[str], seen: DataFrame, keys: list[str], list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Rows of ``left`` with those of ``right`` that share ``on``, but for pairs of keys that were seen.

    ``right`` has ``on`` and one of the keys. Pairs are never shuffled: ``right``'s keys stand in lists of a bounded length,
    what was seen of a list is taken out of it beside its row of ``left``, and the rest is listed where it stands.
    """
    (other,) = (k for k in keys if k in right.columns)
    own = [k for k in keys if k != other]
    counted = right.groupBy(*on, other).agg(F.count("*").alias("_copies"))  # equal rows keep their number
    most = counted.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64(other), F.lit(max(1, -(-most // list_rows)))).alias("_part")
    lists = counted.groupBy(*on, part, "_copies").agg(
        F.transform(F.collect_list(F.struct(other)), lambda x: x[other]).alias("_all"),
    )
    met = seen.select(*keys).join(right.select(*on, other).distinct(), other)
    met = met.join(left.select(*on, *own).distinct(), [*on, *own], "left_semi")
    known = met.groupBy(*on, *own, part).agg(F.collect_set(other).alias("_seen"))
    rows = left.join(lists.select(*on, "_part", "_copies"), on).join(known, [*on, *own, "_part"], "left")
    rows = rows.join(lists, [*on, "_part", "_copies"])
    rest = F.when(F.col("_seen").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_seen"))
    rows = rows.withColumn("_rest", rest).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return rows.select(*left.columns, F.explode("_rest").alias(other))


def mutated(seeds: DataFrame, mutations: dict[str, tuple[str, Column]], text: str) -> DataFrame:
    """``seeds`` x mutations: ``mutation``, ``gold`` and the changed ``text``. Mutations are a frozen list: name -> (gold, text)."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("mutation"), F.lit(gold).alias("gold"), change.alias("_text"))
            for name, (gold, change) in mutations.items()
        ]
    )
    kept = [c for c in seeds.columns if c != text]
    return seeds.select(*kept, F.inline(rows)).withColumnRenamed("_text", text)


def matched_pairs(df: DataFrame, text: str, pattern: str, groups: list[str], expected: dict[str, Column]) -> DataFrame:
    """``df`` with the named groups of a full match and ``reject``: why a row is no pair (null: it is one).

    ``pattern`` has its groups in the order of ``groups``; ``expected``: what some of them must be.
    """
    whole = f"^(?:{pattern})\\z"
    matches = F.rlike(text, F.lit(whole))
    out = df.withColumns({g: F.when(matches, F.regexp_extract(text, whole, i + 1)) for i, g in enumerate(groups)})
    reject = F.when(~F.coalesce(matches, F.lit(False)), "no match")
    for group, value in expected.items():
        reject = reject.when(~F.col(group).eqNullSafe(value), f"other {group}")
    return out.withColumn("reject", reject)


def copies(df: DataFrame, name: str, values: list) -> DataFrame:
    """Each row once for each of a frozen list of values."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
