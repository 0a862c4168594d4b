"""10. Suffix-array deduplication by a distributed difference-cover algorithm.

A byte goes if a string of ``LENGTH`` bytes that covers it starts at two places or more.

Sharding. Each ``LENGTH``-byte window belongs to an anchor: the leftmost of its ``GRAM``-byte strings with the least
hash. Equal windows have equal anchors at equal offsets, so windows whose anchor occurs once in the corpus cannot
repeat and are let go after one count. The windows of one anchor's occurrence form a piece, about 270 bytes. Equal
pieces are grouped with their count (all their windows repeat). Where an anchor has different pieces, they go, once
each, to a shard chosen by the anchor.

Sorting. A shard sorts the suffixes of its pieces by difference cover: it sorts the triples at places that are 1 or 2
modulo 3, names them, recurses on the names, sorts the remaining suffixes by one symbol and a name, and merges. Then
prefixes of neighbours in the suffix array are compared: windows that agree over ``LENGTH`` bytes repeat.

Anchors with more different pieces than a shard holds (a passage within a large share of all documents) are split: their
windows are parted by how far the anchor stands from the window's start, in two halves. All windows of a half hold more
than the anchor, the bytes beside it that even the outermost window has; these longer strings are the anchors of the
half, and its pieces are counted, grouped and sorted like any others. Halving ends, after eight rounds at most, with
strings of whole windows. Text of a short period repeats one piece again and again: such a run is one row with its
number, whatever its length, so rows stay under 1 of 20 bytes or so for any text.

Texts that are null or shorter than ``LENGTH`` lose nothing; empty tables give empty results. Rows with equal ids or a
null id are told apart by their text; rows with equal text are copies of each other and lose all their windows. Ids are of any
type. Texts of any length are cut chunk by chunk. Of other columns nothing is read, and names that clash are kept apart.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_slices, bytes_list, fresh, groups_of, looked_up, mix64, sliding_min, written

LENGTH, GRAM = 200, 64
SHARD_BYTES = 1 << 20
#: Windows of a text that are hashed at once: a text of any length takes some 50 times as many bytes, beside itself and a
#: number for each piece.
CHUNK = 1 << 19
#: A shard sorts whole anchors together until they hold so many bytes: windows of different anchors differ.
SORTED_BYTES = 1 << 18

_ROLL = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the rolling base and of its inverse, modulo 2^64; no more than a chunk needs."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _POWERS[:] = [
            np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, x, dtype=np.uint64))))
            for x in (_ROLL, pow(_ROLL, -1, 1 << 64))
        ]
    return _POWERS[0], _POWERS[1]


def grams(data: bytes, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a text's rolling hash, and the hash of each of its ``gram``-byte strings."""
    n = len(data)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[np.frombuffer(data, dtype=np.uint8)] * down[:n], out=prefix[1:])
    return prefix, mix64((prefix[gram:] - prefix[:-gram]) * up[: n - gram + 1])


def pieces(data: bytes, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """first window, windows, anchor hash, piece hash and times of each piece of a text, ``chunk`` windows at a time.

    ``times``: the piece is followed by itself so many times in all, each time ``windows`` bytes further.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    found = []
    for start in range(0, n - length + 1, chunk):
        # The window before a chunk tells whether the chunk's first one begins a piece.
        low = max(0, start - 1)
        part = data[low : start + chunk - 1 + length] if n - length + 1 > chunk else data
        hashes = grams(part, gram)[1]
        least = sliding_min(hashes, length - gram + 1)
        own = np.flatnonzero((least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])) + 1
        own = own if start else np.concatenate(([0], own))
        found.append((own + low, least[own]))
    begins, least = (np.concatenate(x) for x in zip(*found, strict=True))
    ends = np.concatenate((begins[1:], [n - length + 1]))
    windows, anchor = ends - begins, least.view(np.int64)
    # Of another kind than the anchor's hash, and independent of it.
    digest = xxhash.xxh3_64_intdigest
    bounds = zip(begins.tolist(), (ends - 1 + length).tolist(), strict=True)
    whole = np.fromiter((digest(data[a:b]) for a, b in bounds), np.uint64, len(begins)).view(np.int64)
    again = (windows[1:] == windows[:-1]) & (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])
    heads = np.flatnonzero(np.concatenate(([True], ~again)))
    times = np.diff(np.append(heads, len(begins)))
    for i in np.flatnonzero(times > 1):  # equal hashes are made sure of: the run has the period that it seems to have
        a, p = int(begins[heads[i]]), int(windows[heads[i]])
        end = a + p * int(times[i]) + length - 1
        if data[a : end - p] != data[a + p : end]:
            return begins, windows, anchor, whole, np.ones(len(begins), dtype=np.int64)
    return begins[heads], windows[heads], anchor[heads], whole[heads], times


def halves(body: bytes, low: int, high: int, length: int = LENGTH, gram: int = GRAM) -> list[
    tuple[int, int, int, int, bytes]
]:
    """The piece ``body``, whose windows have their anchor ``low`` to ``high`` bytes from their start, in two: for each half that
    has windows, its low, high, first window, windows and the bytes that all windows of such a half hold around the anchor."""
    at = int(grams(body[:length], gram)[1].argmin())  # the anchor, as of the first window
    middle, count, out = (low + high) // 2, len(body) - length + 1, []
    for a, b in ((low, middle), (middle + 1, high)):
        first, last = max(0, at - b), min(count - 1, at - a)
        if a <= b and first <= last:
            out.append((a, b, first, last - first + 1, body[at - a : at + length - b]))
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array (int32) of positive numbers, by difference cover modulo 3.

    Arrays go as soon as they have been used, before the recursion above all, so that a level holds 40 bytes a number at most.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int32)
    top = int(s.max()) + 1
    padded = np.zeros(n + 3, dtype=np.int32)
    padded[:n] = s

    def sample() -> np.ndarray:
        # A place n, of zeros only, keeps a triple that runs over the end apart from those of the other residue.
        return np.concatenate((np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)))

    sampled = sample()
    if top < 1 << 20:
        key = padded[sampled].astype(np.int64)
        for i in (1, 2):
            key *= top
            key += padded[sampled + i]
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = key[1:] != key[:-1]
        del key
    else:
        triples = [padded[sampled + i] for i in range(3)]
        order = np.lexsort(triples[::-1]).astype(np.int32)
        new = np.any([t[order][1:] != t[order][:-1] for t in triples], axis=0)
        del triples
    if not new.all():
        names = np.empty(len(sampled), dtype=np.int32)
        names[order[0]] = 1
        names[order[1:]] = 1 + np.cumsum(new, dtype=np.int32)
        del order, sampled, new
        order = suffix_array(names)
        del names
        sampled = sample()
    ordered = sampled[order]
    del order, sampled
    rank = np.zeros(n + 3, dtype=np.int32)
    rank[ordered] = np.arange(1, len(ordered) + 1, dtype=np.int32)
    rest, m = np.arange(0, n, 3, dtype=np.int32), len(ordered) + 1
    ordered = ordered[ordered < n]

    def symbol_and_rank(at: np.ndarray) -> np.ndarray:
        return padded[at].astype(np.int64) * m + rank[at + 1]

    key = symbol_and_rank(rest)
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    del by
    before = np.searchsorted(symbol_and_rank(ordered[ordered % 3 == 1]), key)
    del key
    second = ordered[ordered % 3 == 2]
    pairs = [padded[at].astype(np.int64) * top + padded[at + 1] for at in (second, rest)]
    if top >= 1 << 20 or m >= 1 << 23:
        pairs = np.split(np.unique(np.concatenate(pairs), return_inverse=True)[1], [len(second)])
    pairs = [pair * m + rank[at + 2] for pair, at in zip(pairs, (second, rest), strict=True)]
    before += np.searchsorted(*pairs)
    del pairs, second, rank, padded
    before += np.arange(len(rest))
    taken = np.zeros(n, dtype=bool)
    taken[before] = True
    out = np.empty(n, dtype=np.int32)
    out[before], out[~taken] = rest, ordered
    return out


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, the starts of its ``length``-byte strings that start twice or more among all of them."""
    joined = b"\0".join(texts) + b"\0" * (length + 8)  # 0 is shifted away from bytes below
    raw = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    size = int(sizes.sum() + len(texts))
    symbols = raw[:size].astype(np.int32) + 1
    symbols[starts + sizes] = 257  # ends
    valid = np.zeros(size, dtype=bool)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        valid[a : a + n - length + 1] = n >= length
    order = suffix_array(symbols)
    del symbols
    order = order[valid[order]]
    words = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    a, b = order[:-1], order[1:]
    for step in [*range(0, length - 7, 8), length - 8]:
        same = words[a + step] == words[b + step]
        a, b = a[same], b[same]
    repeats = np.unique(np.concatenate((a, b)))
    cut = np.searchsorted(repeats, np.append(starts, size))
    return [repeats[cut[i] : cut[i + 1]] - starts[i] for i in range(len(texts))]


def covered(windows: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The merged spans that windows of ``length`` bytes at ascending starts cover."""
    if not len(windows):
        return []
    cuts = np.flatnonzero(windows[1:] > windows[:-1] + length)
    begins, ends = windows[np.concatenate(([0], cuts + 1))], windows[
        np.concatenate((cuts, [len(windows) - 1]))
    ] + length
    return list(zip(begins.tolist(), ends.tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _keyed(df: DataFrame, doc_id: str, text: str, key: str) -> DataFrame:
    """``df`` with ``key``, which tells texts apart: the id, or if ids are null or repeat, the id and the text's digest."""
    ids = df.groupBy(F.col(doc_id).alias("k")).agg(F.count("*").alias("n"))
    plain = not ids.where(F.col("k").isNull() | (F.col("n") > 1)).limit(1).count()
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(
        key,
        F.col(doc_id) if plain else F.concat_ws(":", F.col(doc_id).cast("string"), F.sha2(body.cast("binary"), 256)),
    )


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
    hot_bytes: int | None = None,
) -> DataFrame:
    """k, spans array<struct<b,e>> (bytes, not merged) for the texts of columns k, body that lose any byte.

    Rows with an equal k have equal bodies. Anchors with over ``hot_bytes`` (a shard's, if null) of different pieces are split.
    """
    kind = docs.schema["k"].dataType.simpleString()
    columns = f"k {kind}, first int, windows int, anchor bigint, piece bigint, times int, covers int, low smallint, high smallint"

    def cut(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            keys, data = batch.column(0), bytes_list(batch.column(1))
            for start, end in groups_of(data, 1 << 20):
                found = [pieces(x, length, gram) for x in data[start:end]]
                whose = np.repeat(np.arange(start, end), [len(f[0]) for f in found])
                first, windows, anchor, piece, times = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _rows(
                    keys.take(pa.array(whose)), first, windows, anchor, piece, times, windows * times,
                    np.zeros(len(first)), np.full(len(first), length - gram),
                )

    long_enough = docs.where(F.octet_length("body") >= length)
    every, out = written(long_enough.mapInArrow(cut, columns), "pieces"), []
    while True:
        spans, hot = _round(docs, every, length, shard_bytes, hot_bytes or shard_bytes)
        out += spans
        if hot is None:
            break
        every = written(_split(docs, hot, kind, columns, length, gram), "pieces")
    everything = reduce(DataFrame.unionByName, out)
    return everything.groupBy("k").agg(F.collect_list("span").alias("spans"))  # a text's own spans only


_NUMBERS = {
    "first": pa.int32(), "windows": pa.int32(), "anchor": pa.int64(), "piece": pa.int64(), "times": pa.int32(),
    "covers": pa.int32(), "low": pa.int16(), "high": pa.int16(),
}


def _rows(keys: pa.Array, *values: np.ndarray) -> pa.RecordBatch:
    numbers = [
        pa.array(np.asarray(v).astype(t.to_pandas_dtype()), t)
        for v, t in zip(values, _NUMBERS.values(), strict=True)
    ]
    return pa.RecordBatch.from_arrays([keys, *numbers], names=["k", *_NUMBERS])


def _bodies(docs: DataFrame, wanted: DataFrame, length: int, columns: dict[str, str]) -> DataFrame:
    """``wanted`` (k, first, windows and ``columns``, with their types) with ``body``, the piece's bytes; texts are read once."""
    kind = docs.schema["k"].dataType.simpleString()
    names = ["first", "windows", *columns]
    asked = wanted.groupBy("k").agg(F.collect_list(F.struct(*names)).alias("wanted"))  # a text's own pieces only

    def fetch(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                lists = some.column(2)
                whose = np.repeat(np.arange(some.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                data, first, windows = bytes_list(
                    some.column(1)
                ), flat.field("first").to_numpy(), flat.field("windows").to_numpy()
                bodies = [
                    data[d][a : a + w + length - 1]
                    for d, a, w in zip(whose.tolist(), first.tolist(), windows.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(whose)), *[flat.field(c) for c in names],
                        pa.array(bodies, pa.binary()),
                    ],
                    names=["k", *names, "body"],
                )

    types = ", ".join(f"{c} {t}" for c, t in ({"first": "int", "windows": "int"} | columns).items())
    return docs.join(asked, "k").select("k", "body", "wanted").mapInArrow(fetch, f"k {kind}, {types}, body binary")


def _round(docs: DataFrame, every: DataFrame, length: int, shard_bytes: int, hot_bytes: int) -> tuple[
    list[DataFrame], DataFrame | None,
]:
    """Spans (k, span) of the windows that repeat among pieces, but for the anchors that are too large; those pieces, or None."""
    kind = docs.schema["k"].dataType.simpleString()
    arrow_kind = to_arrow_type(docs.schema["k"].dataType)
    span = F.struct(F.col("first").alias("b"), (F.col("first") + F.col("covers") + (length - 1)).alias("e"))
    # An anchor may stand in a large share of all pieces: its rows are found where they are.
    anchors = written(
        every.groupBy("anchor").agg(
            F.count("*").alias("n"), F.sum("times").alias("times"), (F.min("piece") != F.max("piece")).alias("several"),
        ).where("times > 1").drop("times"),
        "anchors",
    )
    shared = written(looked_up(every, anchors, ["anchor"]), "shared")
    alike = shared.where("NOT several").select("k", span.alias("span"))

    several = shared.where("several")
    at = F.min(F.struct("k", "first", "windows", "low", "high"))
    different = written(
        several.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.sum("times").alias("times"), at.alias("at")),
        "different",
    )
    copies = written(
        looked_up(
            several, different.where("times > 1").select("anchor", "piece", "n"), ["anchor", "piece"],
        ).select("k", span.alias("span")),
        "copies",
    )

    # Anchors all of whose pieces are copies need no sorting: every window of theirs repeats.
    size = (F.col("at.windows") + (length - 1)).cast("long")
    kinds = different.groupBy("anchor").agg(
        F.sum(size).alias("bytes"), F.count("*").alias("n"), F.count_if(F.col("times") == 1).alias("lone"),
    ).where("lone > 0")
    kinds = written(kinds.select("anchor", "bytes", "n", (F.col("bytes") > hot_bytes).alias("hot")), "kinds")
    total, too_large = kinds.agg(F.sum(F.when(~F.col("hot"), F.col("bytes"))), F.count_if("hot")).first()
    shards = max(1, -(-int(total or 0) // shard_bytes))
    lone = F.when(F.col("times") == 1, 1).otherwise(2).alias("times")
    ones = different.select("anchor", "at.*", lone)

    def sort(table: pa.Table) -> pa.Table:
        anchors: dict[int, dict[bytes, tuple]] = {}
        for key, first, anchor, times, body in zip(
            *(table.column(c).to_pylist() for c in ("k", "first", "anchor", "times", "body")), strict=True,
        ):
            anchors.setdefault(anchor, {}).setdefault(body, (key, first, times))  # rows with an equal k ask twice
        rows: list[tuple] = []
        block: list[tuple[bytes, tuple]] = []
        held = 0
        while anchors:
            some = anchors.popitem()[1]
            block += some.items()
            held += sum(map(len, some))
            if not anchors or held >= SORTED_BYTES:
                found = repeated_windows([body for body, _ in block], length)
                rows += [
                    (key, first + a, first + b)
                    for (_, (key, first, times)), w in zip(block, found, strict=True) if times == 1
                    for a, b in covered(w, length)
                ]
                block, held = [], 0
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table(
            [pa.array(columns[0], arrow_kind), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
            names=["k", "b", "e"],
        )

    cold = looked_up(ones, kinds.where("NOT hot").select("anchor", "n"), ["anchor"])
    bodies = written(_bodies(docs, cold, length, {"anchor": "bigint", "times": "int"}), "bodies")
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    dealt = bodies.select(shard, "k", "first", "anchor", "times", "body").groupBy("shard")
    sorted_out = dealt.applyInArrow(sort, f"k {kind}, b int, e int").select("k", F.struct("b", "e").alias("span"))
    hot = looked_up(ones, kinds.where("hot").select("anchor", "n"), ["anchor"]) if too_large else None
    return [alike, copies, sorted_out], hot


def _split(docs: DataFrame, hot: DataFrame, kind: str, columns: str, length: int, gram: int) -> DataFrame:
    """Pieces of halves: of fewer windows each, under longer anchors."""
    types = {"times": "int", "anchor": "bigint", "low": "smallint", "high": "smallint"}

    def run(batches):
        for batch in batches:
            whose, rows = [], []
            values = (batch.column(c).to_pylist() for c in ("first", "times", "anchor", "low", "high", "body"))
            for i, (first, times, anchor, low, high, body) in enumerate(zip(*values, strict=True)):
                for a, b, at, windows, core in halves(body, low, high, length, gram):
                    own = body[at : at + windows + length - 1]
                    longer = xxhash.xxh3_64_intdigest(core, (anchor ^ (a << 8) ^ b) & (2**64 - 1))
                    rows.append(
                        (first + at, windows, longer, xxhash.xxh3_64_intdigest(own, windows), times, windows, a, b)
                    )
                    whose.append(i)
            first, windows, longer, piece, times, covers, low, high = (
                np.array(x, dtype=np.uint64)
                for x in zip(*rows, strict=True)
            ) if rows else [np.zeros(0, np.uint64)] * 8
            yield _rows(
                batch.column("k").take(pa.array(whose, pa.int64())), first, windows, longer.view(np.int64),
                piece.view(np.int64), times, covers, low, high,
            )

    wanted = hot.select("k", "first", "windows", *types)
    return _bodies(docs, wanted, length, types).mapInArrow(run, columns)


def kept_bytes(data: bytes, spans: list[tuple[int, int]], whole_characters: bool) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs.

    With ``whole_characters`` a span is first narrowed to the characters that lie wholly in it.
    """
    runs = []
    for a, b in merged(spans):
        if whole_characters:
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
        if a < b:
            runs.append((a, b))
    left, at = [], 0
    for a, b in runs:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]]), sum(b - a for a, b in runs), len(runs)


RESULT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def deduplicated(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, whole_characters: bool = False,
    **kept,
) -> tuple[DataFrame, str]:
    """``df`` with one more column, whose name is returned too: n_bytes, n_removed, n_spans, kept (binary)."""
    name, key, own = (fresh(df, stem) for stem in ("kept", "key", "spans"))
    keyed = _keyed(df, doc_id, text, key)
    docs = keyed.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    spans = repeated_spans(docs, length, **kept)

    kind = pa.struct(
        [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
    )

    @F.arrow_udf(RESULT)
    def apply(texts: pa.Array, found: pa.Array) -> pa.Array:
        def run(both: pa.Array) -> pa.Array:
            rows = []
            for data, some in zip(bytes_list(both.field(0)), both.field(1).to_pylist(), strict=True):
                left, removed, runs = kept_bytes(data, [(s["b"], s["e"]) for s in some or []], whole_characters)
                rows.append((len(data), removed, runs, left))
            return pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], fields=list(kind),
            )

        return by_slices(pa.StructArray.from_arrays([texts, found], ["text", "found"]), kind, run)

    joined = keyed.join(spans.select(F.col("k").alias(key), F.col("spans").alias(own)), key, "left")
    return joined.withColumn(name, apply(F.col(text), F.col(own))).select(*df.columns, name), name


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **kept) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    found, k = deduplicated(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **kept)
    return found.select(
        "doc_id", *[F.col(f"{k}.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans")],
        F.sha2(F.col(f"{k}.kept"), 256).alias("kept_sha256"),
    )


def with_kept_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **kept) -> DataFrame:
    """``df`` with its texts cut (whole characters only, so that they stay text); null texts stay null."""
    found, k = deduplicated(df, doc_id, text, whole_characters=True, **kept)
    return found.withColumn(
        text, F.when(F.col(text).isNotNull(), F.col(f"{k}.kept").cast("string")),
    ).select(*df.columns)


