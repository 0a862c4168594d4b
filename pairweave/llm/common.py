"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; set here only if it is unset, under a local master."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext.getCheckpointDir() or set_dir
    return set_dir.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again, so that lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with over 1 of so many rows is hot; there can't be more of them than this.
HOT_KEYS = 4096


def looked_up(
    rows: DataFrame, table: DataFrame, keys: list[str], total: int | None = None, hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """``rows`` with the columns of ``table``, an inner join in which no key gathers its rows in one task.

    ``table`` has one row a key, with ``n``, how many of ``rows`` have it (dropped). Keys with over 1 of ``hot_keys`` of
    all rows (``total``, else the sum of ``n``) are fewer than ``hot_keys``: they are broadcast, and their rows stay where
    they are. The other keys are joined by shuffle. Null keys have no match. ``rows`` and ``table`` are read twice.
    """
    if total is None:
        total = table.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * hot_keys > total
    hot, others = table.where(is_hot).drop("n"), table.where(~is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(others, keys))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def bytes_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def text_list(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def by_slices(column: pa.Array, kind: pa.DataType, run, rows: int = 128) -> pa.Array:
    """``run`` over a few rows of a batch at a time, so that a worker holds the Python values of those rows only."""
    parts = [run(column.slice(at, rows)) for at in range(0, len(column), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def groups_of(items: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with at most ``limit`` bytes together (or one longer item)."""
    start = size = 0
    for i, x in enumerate(items):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbouring values, by doubling."""
    m, step = values, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Memo(dict):
    """A dictionary that computes what it lacks and holds at most ``limit`` entries: a new and an old half, of which the old one goes."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.half, self.old = compute, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
