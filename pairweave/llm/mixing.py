"""13. Mixing sources to target weights, by systematic sampling.

Sources in code point order (null last) take the weights in turn and share ``share`` times all words; no target is above
``most`` times its source's words, and what is cut off is shared by weight among the others until none is above.

A document's expected copies are its source's target over its source's words.  Within a source the documents stand from
long to short, their expected copies are summed up from the first, one random offset is added, and a document is taken
once for each integer that its part of the sum crosses.  So no document is taken more than ``most`` times (rounded up), and
the words taken differ from the target by at most the words of the source's longest document, as each prefix of the
order holds its expected copies to within one.  Sums are integers (units of 2^-30 copies, modulo one), so they are exact
at any number of documents, and the offset is a hash of the source: reruns agree, at any parallelism.

Only DataFrame functions.  Texts are read once, to be counted; what is sorted holds an id, a source and a number a row.  The
sort is by source, size, id and row, so that its ranges split a source of any size; the ranges' counts alone meet in one
task.  Looking for the targets is one small sum over the sources a round: more are over their limit each time, and the
rounds end when none is added.

A null source is a source; a null text has no words; rows without words are expected to be taken as often as others of
their source, and add none; a source without words has target 0 and is not taken.  Null or repeated ids and equal rows
stand for themselves: rows of equal id, source and size may change places, which changes nothing in the table.  Texts of
any length are counted whole.  An empty table gives an empty one.  Columns of the input stay in ``doc`` of ``mix`` with
``carry``, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import looked_up, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Copies are counted in units of 2^-UNIT_BITS.
UNIT_BITS = 30
UNIT = 1 << UNIT_BITS
#: monotonically_increasing_id() holds the partition above so many bits, the row in it below.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written in an order, with ``name``, each row's place from 0.

    Ranges are sorted side by side; one task sees only how many rows each range has.
    """
    ordered = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "mix-order")
    ordered = ordered.withColumn("_range", F.shiftright("_at", ROW_BITS))
    counts = ordered.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return ordered.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_at", "_range", "_start")


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
) -> DataFrame:
    """``sources`` (``_key``, ``source_size``) with ``target``, the words that each is to give."""
    ranked = numbered(sources, [F.col("_key")], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).drop("_rank")
    limit, total = F.col("source_size") * most, F.sum("source_size")

    def shared(at_limit: Column) -> tuple[float, int]:
        """Words for each unit of weight when these sources stand at their limit, and how many those are."""
        row = ranked.agg(
            total, F.sum(F.when(at_limit, F.col("source_size"))), F.sum(F.when(~at_limit, F.col("_weight"))),
            F.count_if(at_limit),
        ).first()
        words, limited, weighed, n = (x or 0 for x in row)
        return ((share * words - most * limited) / weighed if weighed else 0.0), n

    unit, n, at_limit = *shared(F.lit(False)), F.lit(False)
    while True:
        # Sources that have been at their limit stay there, whatever rounding does.
        at_limit = at_limit | (limit <= F.lit(unit) * F.col("_weight"))
        found, more = shared(at_limit)
        if more == n:
            break
        unit, n = found, more
    target = F.when(at_limit, limit.cast("double")).otherwise(F.lit(unit) * F.col("_weight"))
    return ranked.withColumn("target", target).drop("_weight")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size) of each row.

    With ``carry``, ``doc`` holds the row's columns as they came; else texts are not moved at all.
    """
    source = F.col(source_col).cast("string")
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            # Null sorts last, and no key is null.
            F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("_key"),
            F.monotonically_increasing_id().alias("_row"), *([F.struct("*").alias("doc")] if carry else []),
        ), "mix-rows",
    )
    sources = rows.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    wanted = written(targets(sources, weights, share, most), "mix-sources")
    placed = numbered(rows, [F.col("_key"), F.desc("size"), F.col("doc_id"), F.col("_row")], "_place")
    starts = placed.groupBy("_key").agg(F.min("_place").alias("_first"))
    expected = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * UNIT)
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}/"), "_key"), 256), 1, 7), 16, 10).cast("long") * 4
    table = wanted.join(starts, "_key").select(
        "_key", "source_size", "target", "n", "_first", F.coalesce(expected, F.lit(0)).cast("long").alias("_expected"),
        offset.alias("_offset"),
    )
    # What the documents before leave of a copy, and how many copies this one's part fills up.
    before = (F.col("_offset") + (F.col("_place") - F.col("_first")) % UNIT * F.col("_expected")) % UNIT
    found = looked_up(placed, table, ["_key"]).withColumn("copies", F.shiftright(before + F.col("_expected"), UNIT_BITS))
    return found.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *(["doc"] if carry else []),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    taken = mix(docs, carry=True, **options).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def sql(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> str:
    """The same in SQL: targets by the order in which sources reach their limit."""
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
  {list(weights)}[(row_number() OVER (ORDER BY k) - 1) % {len(weights)} + 1] AS w FROM d GROUP BY k),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, k) AS r FROM s),
c AS (SELECT a.k, a.r, a.w, a.source_size, ({share} * (SELECT sum(source_size) FROM s)
    - {most} * coalesce((SELECT sum(source_size) FROM o b WHERE b.r < a.r), 0))
    / (SELECT sum(w) FROM o b WHERE b.r >= a.r) AS unit FROM o a),
u AS (SELECT coalesce((SELECT unit FROM c WHERE {most} * source_size > unit * w ORDER BY r LIMIT 1), 1e300) AS unit),
t AS (SELECT k, source_size, least(CAST({most} * source_size AS DOUBLE), unit * w) AS target,
  4 * CAST('0x' || substr(sha256('{seed}/' || k), 1, 7) AS BIGINT) AS offs FROM s, u),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size * {UNIT}) AS BIGINT) END AS f FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size DESC, doc_id NULLS FIRST) - 1 AS i FROM d)
SELECT doc_id, size, source_size, target, size * (((offs + i % {UNIT} * f) % {UNIT} + f) // {UNIT}) AS taken
FROM p JOIN e USING (k)"""
