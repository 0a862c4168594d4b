"""How often whole strings stand in a table's texts, without comparing every string with every text.

Each string has an anchor: 1, 2, 4, 8, 16 or 32 of its middle bytes, the most that it has room for. Texts are hashed at
every byte for each width of anchor that occurs, in chunks of a bounded size; where a hash is an anchor's, the whole
string is compared. Strings are sent to the tasks in blocks of at most ``BLOCK_BYTES``, each searched against all rows.

Occurrences are counted from the left without overlap, as ``replace`` finds them. Null and empty strings are not searched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK_BYTES = 32 << 20
#: Bytes of texts that are brought together, and that are hashed at once.
SHARD_BYTES, CHUNK = 4 << 20, 1 << 20
WIDEST = 32
BITS = 22
#: Between texts; no byte of UTF-8.
GAP = b"\xff"


def hashes(data: np.ndarray, widths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each width (a power of two), the hash of as many bytes from each position on."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if width in widths:
            yield width, h
        if width >= max(widths, default=0) or len(h) <= width:
            return
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        width *= 2


def slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)


class Probes:
    """Strings by the hash of their anchors."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.by_width: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, x in enumerate(strings):
            width = min(WIDEST, 1 << (len(x).bit_length() - 1))
            at = (len(x) - width) // 2
            ((_, h),) = hashes(np.frombuffer(x, np.uint8, width, at), {width})
            self.by_width.setdefault(width, {}).setdefault(int(h[0]), []).append((i, at))
        self.keys = {
            w: np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))
            for w, found in self.by_width.items()
        }

    def tables(self) -> dict[int, np.ndarray]:
        out = {w: np.zeros(1 << BITS, dtype=bool) for w in self.keys}
        for w, keys in self.keys.items():
            out[w][slot(keys)] = True
        return out

    def count(self, texts: list[bytes], tables: dict[int, np.ndarray]) -> dict[int, list[int]]:
        """[occurrences, texts] of each string that occurs."""
        starts = np.cumsum([0, *(len(x) + 1 for x in texts)]).tolist()
        whole = GAP.join(texts)
        data, widths = np.frombuffer(whole, np.uint8), set(self.keys)
        out: dict[int, list[int]] = {}
        last: dict[int, tuple[int, int]] = {}  # of each string: its last text, and where its last occurrence ends
        for begin in range(0, len(data), CHUNK):
            for width, h in hashes(data[begin : begin + CHUNK + WIDEST - 1], widths):
                h, keys = h[:CHUNK], self.keys[width]
                near = np.flatnonzero(tables[width][slot(h)])
                near = near[keys[np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)] == h[near]]
                for at, key in zip((near + begin).tolist(), h[near].tolist(), strict=True):
                    for i, before in self.by_width[width][key]:
                        p = at - before
                        text, end = last.get(i, (-1, 0))
                        if p >= end and whole.startswith(self.strings[i], p):
                            own = bisect_right(starts, p) - 1
                            n = out.setdefault(i, [0, 0])
                            n[0] += 1
                            n[1] += own != text
                            last[i] = own, p + len(self.strings[i])
        return out


def by_blocks(
    probes: DataFrame, block_bytes: int, plain: Callable[[Row], object], search: Callable[[Broadcast], DataFrame],
) -> DataFrame:
    """``search`` over blocks of about ``block_bytes`` of ``probes`` (by their ``text``), put together.

    One block at a time is on the driver: it is broadcast, its result is written, and it goes before the next one comes.
    """
    spark = probes.sparkSession
    total = probes.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))

    def shared(i: int) -> Broadcast:
        return spark.sparkContext.broadcast([plain(r) for r in probes.where(block == i).toLocalIterator()])

    if blocks == 1:
        return search(shared(0))
    parts = []
    for i in range(blocks):
        one = shared(i)
        parts.append(written(search(one)))
        one.destroy()
    return reduce(DataFrame.union, parts)


def counts(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, least: int | None = None,
) -> DataFrame:
    """item_id, n (occurrences) and documents (rows that hold it) of each item that occurs; several items of one id are added up.

    With ``least``, ``flagged`` tells items that occur at least so often.
    """
    kind = items.schema[item_id].dataType
    probes = items.where(F.octet_length(item_text) > 0).groupBy(
        F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"),
    ).agg(F.count("*").alias("copies"))

    def search(shared) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            own = Probes([x.encode() for x, _, _ in rows])
            tables = own.tables()
            for batch in batches:
                held: list[bytes] = []
                size = 0
                for i, x in enumerate(batch.column(0)):
                    held.append(x.as_py() or b"")
                    size += len(held[-1])
                    if size >= SHARD_BYTES or i == batch.num_rows - 1:
                        found = own.count(held, tables)
                        held, size = [], 0
                        yield pa.RecordBatch.from_pydict({
                            "item_id": pa.array([rows[i][1] for i in found], pa.string()), "n": pa.array(
                                [n * rows[i][2] for i, (n, _) in found.items()], pa.int64(),
                            ),
                            "documents": pa.array([k * rows[i][2] for i, (_, k) in found.items()], pa.int64()),
                        })

        return df.select(F.col(text).cast("binary").alias("text")).mapInArrow(
            run, "item_id string, n bigint, documents bigint",
        )

    found = by_blocks(probes, block_bytes, lambda r: (r["text"], r["item_id"], r["copies"]), search)
    total = found.groupBy(F.col("item_id").cast(kind).alias("item_id")).agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents"),
    )
    return total if least is None else total.withColumn("flagged", F.col("n") >= least)
