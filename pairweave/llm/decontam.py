"""4. Benchmark decontamination by training suffix arrays.

The texts that a task holds, a few megabytes at a time, are a shard. Its words become numbers (those of the benchmark;
0 for any other word), and the shard's suffix array holds every suffix that begins with at least as many benchmark
words as the shortest window has, in the order of all the benchmark words that follow: no other suffix can begin with a
window. Each benchmark suffix is binary-searched in each shard. A range of the array is the list of its window's
verbatim occurrences; from the suffix's own place in that range, the common prefixes of neighbours give the length of
the match at every occurrence. The longest match of a text and where it stands come from there. No text is shuffled.

The benchmark is cut into blocks of at most ``BLOCK_BYTES`` by whole items: usually there is one. It is broadcast as
arrays of numbers, 50 bytes for each word of text or so. With more blocks, each is searched against all rows in a pass
of its own, one at a time, and what is found (spans and names, by the text's digest) is brought together by shuffle.

Null and empty texts have no words. Items without words have no window. Rows with equal text get equal results. A null
item id marks words but is not listed. Empty tables give empty results or no match. Texts of any length are searched whole.
New columns take names that are free, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_list, fresh, groups_of, looked_up, written

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
#: A-Z to a-z; digits, a-z and bytes of other characters stay; all else separates.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def keys_of(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class TestSuffixes:
    """The words of benchmark items as numbers, and the suffixes that begin with a window, sorted by it."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        each = [
            np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words_of(data)), dtype=np.uint32)
            for _, data in items
        ]
        sizes = np.array([len(x) for x in each], dtype=np.int64)
        #: All items' words, each item ended by a 0.
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int64)
        self.words = np.zeros(int(self.starts[-1]) + window, dtype=np.uint32)
        for at, x in zip(self.starts.tolist(), each, strict=False):
            self.words[at : at + len(x)] = x
        places = [
            np.arange(max(1, n - window + 1) if n else 0) + at
            for n, at in zip(sizes.tolist(), self.starts.tolist(), strict=False)
        ]
        places = np.concatenate(places).astype(np.int64) if places else np.zeros(0, dtype=np.int64)
        ends = self.starts[np.searchsorted(self.starts, places, "right")] - 1
        lengths = np.minimum(window, ends - places)
        rows = self.words[places[:, None] + np.arange(window)]
        rows[np.arange(window) >= lengths[:, None]] = 0
        order = np.argsort(keys_of(rows), kind="stable")
        self.places, self.lengths, self.left = places[order], lengths[order], (ends - places)[order]
        self.low = keys_of(rows[order])
        rows[np.arange(window) >= lengths[:, None]] = 0xFFFFFFFF
        self.high = keys_of(rows[order])
        self.least = int(lengths.min()) if len(lengths) else 0


def suffix_order(ids: np.ndarray, run: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``begins`` in the order of their first ``run`` words, and the sorted keys of their windows.

    By doubling: suffixes in the order of their first words, and those a step further on, give the order of twice as many.
    """
    sampled = [begins]
    while len(sampled[-1]):
        further = sampled[-1][run[sampled[-1]] > window] + window
        sampled.append(further[~np.isin(further, begins, assume_unique=True)] if len(further) else further)
    every = np.unique(np.concatenate(sampled))
    rows = ids[every[:, None] + np.arange(window)]
    rows[np.arange(window) >= run[every][:, None]] = 0
    keys = keys_of(rows)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(every), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([1], keys[order][1:] != keys[order][:-1]))) if len(every) else 0
    step, longest = window, int(run[every].max(initial=0))
    while step < longest and rank.max(initial=0) < len(every):
        at = np.searchsorted(every, every + step)
        there = (run[every] > step) & (at < len(every))
        there[there] = every[at[there]] == every[there] + step
        second = np.where(there, rank[np.minimum(at, len(every) - 1)], 0)
        pair = rank * (len(every) + 1) + second
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([1], pair[order][1:] != pair[order][:-1])))
        step *= 2
    wanted = np.isin(every[order], begins, assume_unique=True)
    chosen = order[wanted]
    return every[chosen], keys[chosen]


def common_words(ids: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words follow alike from a and from b, at most ``most``."""
    out, alive, n = np.zeros(len(a), dtype=np.int64), np.flatnonzero(most > 0), 0
    while len(alive):
        alive = alive[ids[a[alive] + n] == ids[b[alive] + n]]
        n += 1
        out[alive] = n
        alive = alive[most[alive] > n]
    return out


def search(texts: list[bytes], tests: TestSuffixes) -> list[tuple]:
    """For each text of a shard: words, merged spans of hit words, names of items, and the longest match (words, where it
    begins in the text, the item's name, where it begins there; the first such place, item and place)."""
    each = [words_of(x) for x in texts]
    sizes = np.array([len(w) for w in each], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a 0 ends each text
    ids = np.zeros(int(starts[-1]) + tests.window, dtype=np.uint32)
    get = tests.number.get
    for at, words in zip(starts.tolist(), each, strict=False):
        ids[at : at + len(words)] = np.fromiter(map(get, words, repeat(0)), dtype=np.uint32, count=len(words))
    out = [(int(n), [], [], 0, None, None, None) for n in sizes]
    if not len(tests.places):
        return out
    # How many benchmark words follow from each position.
    outside = np.flatnonzero(ids == 0)  # the last word is one
    run = outside[np.searchsorted(outside, np.arange(len(ids)))] - np.arange(len(ids))
    begins = np.flatnonzero(run[: int(starts[-1])] >= tests.least)
    if not len(begins):
        return out
    begins, keys = suffix_order(ids, run, begins, tests.window)  # the suffix array
    low, high = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    hits: list[tuple[np.ndarray, ...]] = []
    for w in np.flatnonzero(high > low).tolist():
        where = begins[low[w] : high[w]]
        place, left = int(tests.places[w]), int(tests.left[w])
        item = int(np.searchsorted(tests.starts, place, "right")) - 1
        if left > tests.window:
            length = match_lengths(ids, run, where, tests.words[place : place + left])
        else:
            length = np.full(len(where), left)
        hits.append(
            (
                where, np.full(len(where), tests.lengths[w]), np.full(len(where), item),
                np.full(len(where), place - tests.starts[item]), length,
            )
        )
    if not hits:
        return out
    where, window, item, place, length = (np.concatenate(x) for x in zip(*hits, strict=True))
    text = np.searchsorted(starts, where, "right") - 1
    order = np.lexsort((where, text))
    cuts = np.flatnonzero(np.diff(text[order])) + 1
    for rows in np.split(order, cuts):
        t = int(text[rows[0]])
        at = where[rows] - starts[t]
        end = np.maximum.accumulate(at + window[rows])
        apart = np.flatnonzero(at[1:] > end[:-1])
        spans = list(
            zip(at[np.append(0, apart + 1)].tolist(), end[np.append(apart, len(rows) - 1)].tolist(), strict=True)
        )
        names = sorted({tests.names[i] for i in np.unique(item[rows]).tolist()} - {None})
        best = rows[length[rows] == length[rows].max()]
        first = min(
            (int(where[i] - starts[t]), tests.names[item[i]] is None, tests.names[item[i]] or "", int(place[i]), int(i))
            for i in best.tolist()
        )
        out[t] = out[t][0], spans, names, int(length[first[-1]]), first[0], tests.names[item[first[-1]]], first[3]
    return out


def match_lengths(ids: np.ndarray, run: np.ndarray, where: np.ndarray, test: np.ndarray) -> np.ndarray:
    """How many words of ``test`` stand at each of ``where``, a range of the suffix array."""

    def agree(at: int) -> int:
        n = min(len(test), int(run[at]))
        differ = np.flatnonzero(ids[at : at + n] != test[:n])
        return int(differ[0]) if len(differ) else n

    def before(at: int) -> bool:  # whether the suffix comes before the test
        n = agree(at)
        return n < len(test) and (n == run[at] or ids[at + n] < test[n])

    a, b = 0, len(where)
    while a < b:
        middle = (a + b) // 2
        a, b = (middle + 1, b) if before(int(where[middle])) else (a, middle)
    between = common_words(ids, where[:-1], where[1:], np.minimum(run[where[:-1]], run[where[1:]]))
    out = np.empty(len(where), dtype=np.int64)
    if a < len(where):  # from the test's place on, the match shrinks to what neighbours have in common
        out[a:] = np.minimum.accumulate(np.concatenate(([agree(int(where[a]))], between[a:])))
    if a:
        out[:a] = np.minimum.accumulate(np.concatenate(([agree(int(where[a - 1]))], between[: a - 1][::-1])))[::-1]
    return out


SPANS = "array<struct<begin:bigint,end:bigint>>"
LONGEST = "longest:bigint,longest_at:bigint,longest_item:string,longest_place:bigint"
RESULT = f"struct<n_words:bigint,spans:{SPANS},items:array<string>,{LONGEST}>"
_KIND = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), (
        "items", pa.list_(pa.string()),
    ),
    ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("longest_place", pa.int64()),
])


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[
    list[tuple[str | None, bytes]]
]:
    """The items in blocks of a bounded size."""
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for i in range(blocks):
        yield [(r["item_id"], r["text"].encode()) for r in (items.where(block == i) if blocks > 1 else items).collect()]


def _searcher(shared):
    """Column function: text to what ``search`` finds in it."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), 1_000):  # a task holds the Python values of these rows only
            data = bytes_list(texts.slice(at, 1_000))
            for a, b in groups_of(data, SHARD_BYTES):
                found += search(data[a:b], shared.value)
        columns = list(zip(*found, strict=True)) if found else [[]] * len(_KIND)
        columns[1] = [[{"begin": a, "end": b} for a, b in x] for x in columns[1]]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, _KIND, strict=True)], fields=list(_KIND),
        )

    return run


def matches(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """``df`` with one more column, whose name is returned too: a struct of n_words, spans of hit words, items, and the longest
    match: longest (words; 0: none), longest_at (its first word in the text, from 0), longest_item, longest_place (in the item)."""
    context, name = df.sparkSession.sparkContext, fresh(df, "matches")
    blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return df.withColumn(name, _searcher(context.broadcast(TestSuffixes(first, window)))(F.col(text))), name
    key = fresh(df, "digest")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts, parts = df.select(F.sha2(body, 256).alias(key), body.alias("text")), []
    for block in _chained(first, second, blocks):
        shared = context.broadcast(TestSuffixes(block, window))
        hit = texts.select(key, _searcher(shared)("text").alias("m")).where(F.size("m.spans") > 0).groupBy(key).agg(
            F.any_value("m").alias("m"), F.count("*").alias("n"),
        )
        parts.append(written(hit, "block"))
        shared.unpersist()
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    order = F.array_sort(
        F.flatten(F.collect_list("m.spans"))
    )  # a text's own spans, at most a span for each window of words
    together = union.groupBy(key).agg(
        F.max("n").alias("n"), F.max("m.n_words").alias("n_words"), order.alias("spans"), F.array_sort(
            F.array_distinct(F.flatten(F.collect_list("m.items")))
        ).alias("items"),
        F.min_by(
            "m",
            F.struct(
                -F.col("m.longest"), "m.longest_at", F.col("m.longest_item").isNull(), "m.longest_item",
                "m.longest_place",
            ),
        ).alias("top"),
    )
    start = F.array().cast(SPANS)
    last = lambda out: F.element_at(out, -1)
    joined = lambda out, s: F.concat(
        F.slice(out, F.lit(1), F.size(out) - 1),
        F.array(F.struct(last(out)["begin"].alias("begin"), F.greatest(last(out)["end"], s["end"]).alias("end"))),
    )
    merged = F.aggregate(
        "spans", start,
        lambda out, s: F.when(
            (F.size(out) > 0) & (s["begin"] <= last(out)["end"]), joined(out, s),
        ).otherwise(F.concat(out, F.array(s))),
    )
    found = written(
        together.select(
            key, "n",
            F.struct(
                "n_words", merged.alias("spans"), "items",
                *[F.col(f"top.{c}") for c in ("longest", "longest_at", "longest_item", "longest_place")],
            ).alias(name),
        ),
        "matches",
    )
    keyed = df.withColumn(key, F.sha2(body, 256))
    none = F.struct(
        _words(body).alias("n_words"), start.alias("spans"), F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("bigint").alias("longest"),
        *[
            F.lit(None).cast(t).alias(c)
            for c, t in (("longest_at", "bigint"), ("longest_item", "string"), ("longest_place", "bigint"))
        ],
    )
    without = keyed.join(found.select(key), key, "left_anti").withColumn(name, none)
    return looked_up(keyed, found, [key]).unionByName(without).select(*df.columns, name), name


def _chained(first, second, rest):
    yield first
    yield second
    yield from rest


def _words(text: Column) -> Column:
    """The number of words, by Spark's own functions."""
    parts = F.split(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("bigint")


def digests(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kept) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row, and its longest match."""
    found, m = matches(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **kept)
    n_hit = F.expr(f"aggregate({m}.spans, 0L, (n, s) -> n + s.end - s.begin)")
    items = F.sha2(F.array_join(F.array_sort(f"{m}.items"), ",").cast("binary"), 256)
    return found.select(
        "doc_id", F.col(
            f"{m}.n_words"
        ).alias("n_words"), n_hit.alias("n_hit"), F.size(f"{m}.items").cast("long").alias("n_items"), items.alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), *[
            F.col(f"{m}.{c}").alias(c)
            for c in ("longest", "longest_at", "longest_item", "longest_place")
        ],
    )


def without_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **kept) -> DataFrame:
    """The rows of ``df`` that hold no window of the benchmark."""
    found, m = matches(df, benchmark, text, **kept)
    return found.where(F.size(F.col(f"{m}.spans")) == 0).drop(m)
