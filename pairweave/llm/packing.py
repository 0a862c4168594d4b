"""2. Token-ID / binary output: best-fit-decreasing packing into fixed-width id matrices.

A task fills a buffer of a fixed number of tokens from its rows, sorts the buffer's segments by falling length and puts
each into the fullest pack that still has room, found by a segment tree over free capacities. Documents longer than a
pack are cut into whole packs and a rest, losing nothing. There is no shuffle; memory is bounded by the buffer and the
longest document; a text of any length is encoded and cut whole. What a pack holds, and its ``pack_id``, depend on how
Spark splits the input, never on timing, so a task that runs again on another executor gives the same packs; two runs
that split the input otherwise hold the same segments in other packs.

Null and empty texts have no tokens and appear in no pack; an empty table gives no packs. Repeated rows are packed once
each. Null ids stay null in ``doc_ids``. Only the id and the token ids are carried, so no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import made, parse_ranks
from .common import text_list

#: Tokens that a task gathers before it packs them: 2 MB of ids, 256 packs of 2,048.
BUFFER_TOKENS = 1 << 19
#: Rows of a batch whose values are Python objects at a time, and characters without white space that the library isn't given.
SLICE, ENDLESS = 128, 8_192


class FreeSpace:
    """A segment tree over capacities 0..n: how many packs have just that much left; finds the least that fits."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.packs: list[list[int]] = [[] for _ in range(n + 1)]

    def _add(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, pack: int, free: int) -> None:
        self.packs[free].append(pack)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The pack with the least free space of at least ``need`` and that space, taken out; None if there is none."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._add(free, -1)
        return self.packs[free].pop(), free


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the segments of each pack; ties keep the order of the input."""
    space, packs = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = space.take(lengths[i])
        if found is None:
            packs.append([i])
            pack, free = len(packs) - 1, capacity
        else:
            pack, free = found
            packs[pack].append(i)
        space.put(pack, free - lengths[i])
    return packs


def _packed(segments: list[tuple], capacity: int, pad: int, first: int, schema: pa.Schema) -> pa.RecordBatch:
    rows: dict[str, list] = {name: [] for name in schema.names}
    for n, members in enumerate(best_fit_decreasing([len(s[2]) for s in segments], capacity)):
        parts = [segments[i] for i in members]
        ends = np.cumsum([0, *(len(p[2]) for p in parts)])
        ids = np.full(capacity, pad, dtype="<u4")
        ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
        positions = np.zeros(capacity, dtype="<i4")
        positions[: ends[-1]] = np.concatenate([np.arange(len(p[2]), dtype="<i4") for p in parts])
        for name, value in zip(
            schema.names,
            (
                first + n, int(ends[-1]), [p[0] for p in parts], [p[1] for p in parts], ends.tolist(), ids.tobytes(),
                positions.tobytes(),
            ),
            strict=True,
        ):
            rows[name].append(value)
    return pa.RecordBatch.from_pydict(rows, schema=schema)


def pack(
    df: DataFrame, capacity: int = 2048, pad: int = 0, doc_id: str = "doc_id", ids: str = "ids",
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Packs of the token ids (binary, little-endian unsigned 32-bit; null: none) of each row.

    Returns pack_id long, n_tokens int, doc_ids array, starts array<long> (where a segment begins in its document),
    cu_seqlens array<int> (from 0 to n_tokens), input_ids binary and position_ids binary (``capacity`` little-endian
    32-bit numbers each; positions begin at 0 with each segment; the rest is ``pad`` and 0).
    """

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            for key, value in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                yield key, np.frombuffer(value or b"", dtype="<u4")

    return _pack(
        df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), rows_of, capacity, pad, buffer_tokens,
    )


def _pack(source: DataFrame, rows_of, capacity: int, pad: int, buffer_tokens: int) -> DataFrame:
    """``rows_of``: id and token ids of each row of a batch of ``source``, whose first column is doc_id."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = source.schema["doc_id"].dataType.simpleString()
    out = f"pack_id bigint, n_tokens int, doc_ids array<{kind}>, starts array<bigint>, cu_seqlens array<int>, input_ids binary, position_ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        schema, segments, held = None, [], 0
        for batch in batches:
            if schema is None:
                numbers, key_kind = pa.list_(pa.int32()), batch.schema.field(0).type
                schema = pa.schema([
                    ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(key_kind)), (
                        "starts", pa.list_(pa.int64()),
                    ),
                    ("cu_seqlens", numbers), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
                ])
            for key, tokens in rows_of(batch):
                for at in range(0, len(tokens), capacity):
                    segments.append((key, at, tokens[at : at + capacity]))
                    held += len(segments[-1][2])
                    if held >= buffer_tokens:
                        yield (full := _packed(segments, capacity, pad, first, schema))
                        first, segments, held = first + full.num_rows, [], 0
        if segments:
            yield _packed(segments, capacity, pad, first, schema)

    return source.mapInArrow(run, out)


def matrix(values: list[bytes], dtype: str = "<u4") -> np.ndarray:
    """The id or position matrix of collected packs: one row a pack."""
    return np.array([np.frombuffer(v, dtype=dtype) for v in values])


def write_packs(packs: DataFrame, path: str) -> None:
    """Write packs as Parquet: the fixed-width binary columns are the rows of the id and position matrices."""
    packs.write.mode("errorifexists").parquet(path)


def pack_texts(
    df: DataFrame, ranks, pattern: str, capacity: int = 2048, pad: int = 0, doc_id: str = "doc_id", text: str = "text",
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """``pack`` of the ids that the public library gives for each text, encoded in the task that packs them.

    ``ranks``: a broadcast rank file. Ids never leave the Python worker but as packs.
    """

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        encode = _library(ranks.value, pattern)
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            for key, value in zip(some.column(0).to_pylist(), text_list(some.column(1)), strict=True):
                yield key, np.array(encode(value), dtype="<u4")

    return _pack(
        df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), rows_of, capacity, pad,
        buffer_tokens,
    )


_ENCODERS: dict[tuple[str, str], object] = {}


def _library(data: bytes, pattern: str):
    """Text to its ids, by the library; texts with an endless word go to the linear encoder of operator 1, with equal ids."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _ENCODERS:
        import tiktoken

        ordinary = tiktoken.Encoding(
            key[0], pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={},
        ).encode_ordinary

        def encode(text: str) -> list[int] | np.ndarray:
            # The library's merging takes the square of a word's length.
            if len(text) > ENDLESS and max(map(len, text.split()), default=0) > ENDLESS:
                return np.frombuffer(made(data, pattern).encode(text), dtype="<u4")
            return ordinary(text)

        _ENCODERS.clear()
        _ENCODERS[key] = encode
    return _ENCODERS[key]
