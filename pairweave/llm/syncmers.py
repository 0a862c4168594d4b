"""3. Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the least hash among its inner s-mers lies at its first or last place. Whether
a k-mer is chosen depends on nothing around it, so equal passages give equal anchors wherever they stand. A fingerprint
holds the anchors of least hash (a bottom sketch) with their byte positions; two fingerprints are matched on equal
anchors that lie on one common shift, which is what keeps chance anchors of unrelated texts out.

Texts without any syncmer (under ``K`` bytes, mostly) have one anchor, the hash of the whole text; empty and null texts
have an empty fingerprint, which is 1.0 like another empty one and 0.0 like any other. Ids are integers, decimals or texts (by
code points). Ids are meant to be unique: repeated ids are taken in the order of their texts and rows with a null id
follow the smallest id, each such group as one stream through one task. A single row is its own next row. Texts of any
length are fingerprinted whole, chunk by chunk. An empty table gives an empty one. Other columns are not carried, so none can clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix64, sliding_min

K, S, SKETCH = 16, 8, 48
#: Bytes of a text that are hashed at once: a text of any length takes some 40 times as many bytes, beside itself.
CHUNK = 1 << 20


def syncmers(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and byte positions of all closed syncmers. ``s`` is 8, so that an s-mer is one 64-bit word; k is twice s."""
    n = len(data)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = mix64(np.ndarray((n - s + 1,), dtype="<u8", buffer=data, strides=(1,)).copy())
    width = k - s + 1
    least = sliding_min(hashes, width)
    at = np.flatnonzero((hashes[: len(least)] == least) | (hashes[width - 1 :] == least))
    return mix64(hashes[at] ^ (hashes[at + s] << np.uint64(1))) >> np.uint64(32), at


def anchors(data: bytes, k: int = K, s: int = S, chunk: int = CHUNK, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A text's closed syncmers, or the hash of the whole text if it has none, ``chunk`` bytes at a time.

    With ``size``, of each chunk only those that can be among so many different ones of least hash.
    """
    found = []
    for start in range(0, max(1, len(data) - k + 1), chunk):
        hashes, at = syncmers(data[start : start + chunk + k - 1] if len(data) > chunk else data, k, s)
        if size and len(data) > chunk:
            few, where = np.unique(hashes, return_index=True)
            hashes, at = few[:size], at[where[:size]]
        found.append((hashes, at + start))
    hashes, at = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    if len(at) or not data:
        return hashes, at
    return np.array([xxhash.xxh64_intdigest(data) >> 32], dtype=np.uint64), np.zeros(1, dtype=np.int64)


def sketch(data: bytes, size: int = SKETCH, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """The ``size`` anchors of least hash, each at its first position, by position."""
    hashes, at = anchors(data, chunk=chunk, size=size)
    if len(hashes) > 4 * size:
        keep = hashes <= np.partition(hashes, 4 * size - 1)[4 * size - 1]
        few, where = np.unique(hashes[keep], return_index=True)
        if len(few) >= size:
            return sorted(zip(few[:size].tolist(), at[keep][where[:size]].tolist(), strict=True), key=lambda x: x[1])
    few, where = np.unique(hashes, return_index=True)
    return sorted(zip(few[:size].tolist(), at[where[:size]].tolist(), strict=True), key=lambda x: x[1])


def as_text(anchor_list: list[tuple[int, int]]) -> str:
    """``hash@position`` in hexadecimal, dot-joined."""
    return ".".join([f"{h:08x}@{p:x}" for h, p in anchor_list])


def from_text(fingerprint: str) -> list[tuple[int, int]]:
    return [
        (int(h, 16), int(p, 16))
        for h, _, p in (x.partition("@") for x in fingerprint.split("."))
    ] if fingerprint else []


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]], size: int = SKETCH) -> float:
    """Twice the common anchors on the commonest shift, over all anchors, both below the least full sketch's end; 0 to 1."""
    if not a or not b:
        return float(not a and not b)
    end = min(max(h for h, _ in x) if len(x) >= size else 1 << 32 for x in (a, b))
    of_b = {h: p for h, p in b if h <= end}
    of_a = {h: p for h, p in a if h <= end}
    shifts = Counter(p - of_b[h] for h, p in of_a.items() if h in of_b)
    return 2 * max(shifts.values()) / (len(of_a) + len(of_b)) if shifts else 0.0


def edited_text(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by the first as many of the following text."""
    part = len(text) // 3
    return text[: len(text) - part] + following[:part]


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; the next text is that of the next smaller id.

    Ids are cut into ranges at quantiles (their number follows ``spark.sql.shuffle.partitions``, and only the ranges'
    ends reach the driver); a range's first row is sent along to the range before it, and the first of all to the last.
    So each text crosses the network once and no task sees more than its range, as a stream.
    """
    spark = df.sparkSession
    kept = df.schema[doc_id].dataType
    whole = isinstance(kept, (T.IntegralType, T.DecimalType))
    kind = kept if isinstance(kept, T.DecimalType) else T.LongType() if whole else T.StringType()
    source = df.select(
        F.col(doc_id).cast(kind).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if whole:
        ends = source.agg(
            F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000)
        ).first()[0] or []
    else:  # quantiles of the ids of least hash, some for each range
        some = source.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(
            F.xxhash64("doc_id"), "doc_id",
        ).limit(32 * parts)
        some = sorted(r[0] for r in some.collect())
        ends = [some[len(some) * i // parts] for i in range(1, parts)] if some else []
    splits = sorted(set(ends))

    def place(key) -> int:
        """0 for the range of the largest ids, the last for null."""
        return len(splits) + 1 if key is None else len(splits) - bisect_left(splits, key)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array([place(x) for x in ids.to_pylist()], pa.int32())

    tops = sorted(
        (r["place"], r["top"])
        for r in source.select(
            range_of("doc_id").alias("place"), "doc_id",
        ).groupBy("place").agg(F.max("doc_id").alias("top")).collect()
    )
    before = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        """Twice the row's own range; one more than twice a range that it follows."""
        own = [(x, 2 * place(x)) for x in ids.to_pylist()]
        return pa.array([[at, 2 * before[x] + 1] if x in before else [at] for x, at in own], pa.list_(pa.int32()))

    dealt = source.select(
        F.explode(places("doc_id")).alias("at"), "doc_id", "text",
    ).withColumn("place", F.expr("at DIV 2"))
    # By range: a place is a partition or nearly so, where hashing would deal several to one and none to others.
    ordered = dealt.repartitionByRange(parts, "place").sortWithinPartitions(
        "place", F.expr("at % 2"), F.desc_nulls_last("doc_id"), "text",
    )
    names = [
        ("doc_id", to_arrow_type(kind)), ("n_chars", pa.int64()),
        *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
    ]
    schema = pa.schema([*names, ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def row(key, value: str, own: list, following: str, after: list) -> tuple:
        changed = edited_text(value, following).encode()
        other = sketch(changed)
        return key, len(value), hashlib.sha256(changed).hexdigest(), as_text(own), as_text(other), likeness(
            own, other,
        ), likeness(own, after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next row has not come yet
        for batch in batches:
            rows = []
            for at, key, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and held[0] // 2 != at // 2:
                    held = None  # only a row that was sent along ends a range
                if held and held[0] % 2:
                    continue  # rows of equal id, sent along behind the one that was used
                own = sketch(value.encode())
                if held:
                    rows.append(row(held[1], held[2], held[3], value, own))
                held = at, key, value, own
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [
                    pa.array([], t)
                    for t in schema.types
                ],
                schema=schema,
            )

    out = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("at", "doc_id", "text").mapInArrow(run, out)
