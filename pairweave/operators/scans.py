"""Running values over a group in order, where no task sees a whole group.

Rows are dealt out by group and by range of the order's first key. A range's running values are a window over its rows
alone; what a range does to those after it is one associative summary (a sum, an extreme, the last known value), and the
summaries of the ranges before are added back to each row. So a group of any size is spread over many tasks, and the rows are
sorted once.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task orders, about.
RANGE_ROWS = 500_000

SO_FAR = (Window.unboundedPreceding, 0)
EARLIER, LATER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def as_number(df: DataFrame, key: str) -> Column:
    """A key as a double that rises with it. Times without a zone are read off the clock: a zone's lost hour has none."""
    kind, at = df.schema[key].dataType.typeName(), F.col(key)
    if kind not in ("timestamp_ntz", "date"):
        return at.cast("double")
    days = F.unix_date(at.cast("date")).cast("double") * 86400
    if kind == "date":
        return days
    return days + F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at).cast("double")


def ranged(df: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """``df`` with ``_bucket``, the range of its key (a number, a date or a time) in rising order, and the number of rows.

    The ranges' ends are approximate quantiles, found by bisection for each row: they decide how even the ranges are, not what
    is computed from them. Equal keys share a range. Nulls are a range before all others, NaN after.
    """
    total = df.count()
    buckets = max(1, -(-total // range_rows))
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0)), total
    spread = df.withColumn("_key", as_number(df, key))
    ends = spread.where(~F.isnan("_key")).approxQuantile("_key", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    splits = [float("-inf"), *sorted({e for e in ends if abs(e) != float("inf")}), float("inf")]
    spread = spread.withColumn("_known", F.when(F.col("_key").isNull() | F.isnan("_key"), 0.0).otherwise(F.col("_key")))
    found = Bucketizer(splits=splits, inputCol="_known", outputCol="_found").transform(spread)
    bucket = F.when(F.col("_key").isNull(), -1).when(F.isnan("_key"), len(splits)).otherwise(F.col("_found").cast("int"))
    return found.withColumn("_bucket", bucket).drop("_key", "_known", "_found"), total


#: Of each kind: what it makes of the rows of a frame, and of a range (given the order), and of ranges.
KINDS = {
    "sum": (F.sum, lambda x, order: F.sum(x), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda x, order: F.max(x), F.max, F.greatest),
    "min": (F.min, lambda x, order: F.min(x), F.min, F.least),
    "last": (
        lambda x: F.last(x, ignorenulls=True), lambda x, order: F.max_by(x, F.when(x.isNotNull(), order)),
        lambda x: F.last(x, ignorenulls=True), lambda a, b: F.coalesce(b, a),
    ),
}


def scanned(
    df: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column]], range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``df`` with a running value for each name: (kind, column), of the rows of its group up to it, itself included.

    Kinds are ``sum``, ``max``, ``min`` and ``last`` (the last value that is not null); with ``onward`` before, as in ``onward
    min``, of the rows from it on. The first column of ``order`` is a number, a date or a time; nulls come first. Groups may be null.
    """
    spread, total = ranged(df, order[0], range_rows)
    own = Window.partitionBy(*by, "_bucket").orderBy(*order)
    kinds = {name: (kind.removeprefix("onward "), kind.startswith("onward ")) for name, (kind, _) in columns.items()}
    # Spark adds up a frame that ends at the last row anew for each row. Read from the last place back, it grows row by row.
    local = spread.withColumn("_place", F.row_number().over(own))
    back = Window.partitionBy(*by, "_bucket").orderBy(F.desc("_place"))
    local = local.withColumns({
        name: (F.first(x, ignorenulls=True) if onward and kind == "last" else KINDS[kind][0](x)).over((back if onward else own).rowsBetween(*SO_FAR))
        for (name, (kind, onward)), (_, x) in zip(kinds.items(), columns.values(), strict=True)
    }).drop("_place")
    if total <= range_rows:
        return local.drop("_bucket")
    place = F.struct(*order)
    ranges = spread.groupBy(*by, "_bucket").agg(*[KINDS[k][1](columns[n][1], place).alias(n) for n, (k, _) in kinds.items()])
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")  # a row for each range of a group
    carried = ranges.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*by, "_bucket"]],
        *[KINDS[k][2](n).over(over.rowsBetween(*(LATER if o else EARLIER))).alias(f"_carried_{n}") for n, (k, o) in kinds.items()],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_bucket") == F.col("_of__bucket")]
    both = local.join(carried, same)
    return both.select(
        *df.columns, *[KINDS[k][3](*((F.col(n), F.col(f"_carried_{n}"))[:: 1 if o else -1])).alias(n) for n, (k, o) in kinds.items()],
    )


def placed(df: DataFrame, key: str, by: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_at``, its place (from 0) by ``key`` in its group of ``by``, and ``_n``, the group's rows."""
    one = F.lit(1).cast("long")
    both = scanned(df, by, [key], {"_at": ("sum", one), "_rest": ("onward sum", one)}, range_rows)
    return both.withColumns({"_n": F.col("_at") + F.col("_rest") - 1, "_at": F.col("_at") - 1}).drop("_rest")


def ranks(df: DataFrame, value: str, by: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``by``, ``value``, ``ties`` (rows of that value) and ``rank`` (one more than the rows of smaller ones) of each value of a group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    upto = scanned(counts, by, [value], {"rank": ("sum", F.col("ties"))}, range_rows)
    return upto.withColumn("rank", F.col("rank") - F.col("ties") + 1)


def nearest_ranks(
    df: DataFrame, value: str, by: list[str], wanted: dict[str, float], range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """A column for each (name, q): the value at place round(q * (n - 1)), halves to even, of each group's sorted values.

    Counts of ranges tell in which range a wanted place falls; only the rows of such ranges are counted by value and put in
    order. Null values are left out; no group may be null.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, value)
    spread, _ = ranged(known, value, range_rows)
    sizes = spread.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
    over = Window.partitionBy(*(by or [F.lit(0)]))
    ends = F.sum("_rows").over(over.orderBy("_bucket").rowsBetween(*SO_FAR))
    sizes = sizes.withColumns({"_end": ends, "_n": F.sum("_rows").over(over)})
    places = [F.struct(F.lit(i).alias("i"), F.bround(F.lit(q) * (F.col("_n") - 1)).cast("long").alias("at")) for i, q in enumerate(wanted.values())]
    before = F.col("_end") - F.col("_rows")
    here = F.filter(F.array(*places), lambda x: (x["at"] < F.col("_end")) & (x["at"] >= before))
    ranges = sizes.withColumn("_wanted", here).where(F.size("_wanted") > 0).select(*by, "_bucket", before.alias("_before"), "_wanted")
    counts = spread.join(ranges.select(*by, "_bucket"), [*by, "_bucket"], "left_semi").groupBy(*by, "_bucket", value).agg(
        F.count("*").alias("_rows")
    )
    upto = F.sum("_rows").over(Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(*SO_FAR))
    placed_counts = counts.withColumn("_end", upto).join(ranges, [*by, "_bucket"])
    end = F.col("_end") + F.col("_before")
    hit = F.filter("_wanted", lambda x: (x["at"] < end) & (x["at"] >= end - F.col("_rows")))
    found = placed_counts.withColumn("_wanted", hit).where(F.size("_wanted") > 0)
    of = lambda i: F.max(F.when(F.exists("_wanted", lambda x: x["i"] == i), F.col(value)))
    return found.groupBy(*by).agg(*[of(i).alias(name) for i, name in enumerate(wanted)])
