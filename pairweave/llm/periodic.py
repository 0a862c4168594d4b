"""11. Periodic run detection: stretches of words that repeat at least three times in a row.

A run is a longest stretch of words with smallest period q, of at least ``SHORTEST`` words and three periods.

Periods are taken by octave: [P, 2P), and [1, 16) with the first, P = 8.  In each octave a grid point stands at every P-th
word, and its tile is the words from P before it to 4P after it.  The words i of a run that equal the word i + q are at least
2P - 1 in a row, so they hold the whole block of P words at some grid point, and tiles can be solved independently:

* Blocks and all windows of P words have names, made by doubling.  A tile whose block's name does not come again at a
  distance of the octave holds no run; names only choose tiles.
* In the others, the Z-function of the words from the grid point on gives, exactly, how far each distance matches forward,
  and the Z-function of the words before it, reversed, how far backward.  A distance that has a divisor's period over the
  block and the distance is no smallest period and goes.
* What a tile finds is an interval of matching words for a period, cut off at the tile's ends.  Neighbouring tiles' intervals
  of one document and period overlap; they are stitched together and only then measured.

A text of up to ``TILE_BYTES`` bytes is one task's work: its tiles are solved side by side with those of the batch's other
texts, and stitched where they are.  A longer one is exploded: its words' numbers go out as rows of tiles (all octaves up to
``TILE_WORDS`` / 8 together, each further octave by itself), dealt out by text and tile; the intervals are shuffled by text
and period to be stitched, and the text meets its runs again by key.  So only numbers of words of long texts are shuffled, and
long texts themselves once.

A null text is an empty one, and has no runs.  Repeated rows give repeated results.  Texts of any length: beside the text,
a task that explodes or prints a long one holds 20 bytes a word and the distinct words.  Of runs of equal exponent the first
is the greatest, then the one of smaller period.  An empty table gives an empty one.  Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bytes_list, mix64

SHORTEST = 24
LEAST_P = 8
TILE_BYTES = 1 << 16
TILE_WORDS = 1 << 13
#: Bytes of texts that one call solves side by side.
SIDE_BY_SIDE = 1 << 20

Run = tuple[int, int, int]  # start, length, period
Fragment = tuple[int, int, int]  # period, first word that equals the one a period on, end of such words


def primes_of(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] if n > 1 else out


def z_function(s: list[int], places: int) -> list[int]:
    """How many words from each of the first ``places`` places on equal those from the start on."""
    n, z, left, right = len(s), [0] * places, 0, 0
    z[0] = n
    for i in range(1, places):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(words: np.ndarray, at: int, p: int, distances: list[int]) -> Iterator[Fragment]:
    """The matching intervals of these distances that hold the block at ``at``, as far as the tile shows them."""
    before, after = max(0, at - p), words[at : at + 4 * p].tolist()
    forward = z_function(after, min(len(after), 2 * p))
    back: list[int] | None = None
    for q in distances:
        if q >= len(forward) or forward[q] < p or any(forward[q // r] >= q + p - q // r for r in primes_of(q)):
            continue
        if back is None:
            head = words[before:at][::-1].tolist()
            tail = words[before : at + 2 * p][::-1].tolist()
            shown = len(tail) - (at - before)  # of the words from the block on
            back = z_function([*head, -1, *tail], len(head) + 1 + len(tail))[len(head) + 1 :]
        yield q, at - min(back[shown - q], at - before), at + min(forward[q], 2 * p)


def joined_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) + right)


def solve(words: np.ndarray, p_least: int, p_most: int, lo: int, hi: int, ends: list[int] | None = None) -> list[Fragment]:
    """All tiles of these octaves with a grid point in [lo, hi); ``lo`` is on the grid of each octave.

    ``ends``: for each octave, how many of the words it concerns.  Numbers of words are 0 or more; a number under -1 occurs
    once.
    """
    found: list[Fragment] = []
    names, length, p, octave = mix64(words.astype(np.int64).view(np.uint64) + np.uint64(1)), 1, p_least, 0
    while p <= p_most:
        if ends is not None:
            words = words[: ends[octave]]
        while length < p:
            names = joined_names(names[:-length], names[length:]) if len(names) > length else names[:0]
            length *= 2
        names = names[: max(0, len(words) - p + 1)]
        if not len(names):
            break
        rows = -(-len(names) // p) + 1
        grid = np.zeros(rows * p, np.uint64)
        grid[: len(names)] = names
        grid = grid.reshape(rows, p)
        block, q = np.nonzero(grid[1:] == grid[:-1, :1])
        q += p
        if p == LEAST_P:
            near_block, near_q = np.nonzero(grid[:, 1:] == grid[:, :1])
            block, q = np.concatenate([block, near_block]), np.concatenate([q, near_q + 1])
        at = block * p
        inside = (at >= lo) & (at < hi) & (at + q < len(names))
        at, q = at[inside], q[inside]
        order = np.lexsort((q, at))
        at, q = at[order], q[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for some in np.split(np.arange(len(at)), cuts) if len(at) else []:
            c = int(at[some[0]])
            for period, s, e in solve_tile(words, c, p, q[some].tolist()):
                cut_off = s == c - p or e == c + 2 * p
                if cut_off or long_enough(e - s + period, period):
                    found.append((period, s, e))
        p, octave = 2 * p, octave + 1
    return found


def long_enough(length: int, period: int) -> bool:
    return length >= max(SHORTEST, 3 * period)


def stitched(fragments: list[Fragment]) -> list[Fragment]:
    """Intervals of one period that overlap or adjoin become one."""
    out: list[list[int]] = []
    for period, s, e in sorted(fragments):
        if out and out[-1][0] == period and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([period, s, e])
    return [tuple(x) for x in out]


class Numbers(dict):
    """Numbers words in the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class LongText:
    """The words of a text by their places, for texts whose words should not all be Python values."""

    CHUNK = 1 << 22
    WHITE = np.zeros(256, bool)
    WHITE[[0x20, *range(0x09, 0x0E)]] = True

    def __init__(self, data: bytes):
        self.data, starts, ends, white_before = data, [], [], True
        for at in range(0, len(data), self.CHUNK):
            white = self.WHITE[np.frombuffer(data, np.uint8, min(self.CHUNK, len(data) - at), at)]
            shifted = np.concatenate([[white_before], white[:-1]])
            starts.append(np.flatnonzero(shifted & ~white) + at)
            ends.append(np.flatnonzero(~shifted & white) + at)
            white_before = bool(white[-1])
        if not white_before:
            ends.append(np.array([len(data)]))
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, places: np.ndarray) -> list[bytes]:
        data = self.data
        return [data[s:e] for s, e in zip(self.starts[places].tolist(), self.ends[places].tolist(), strict=True)]


class ShortText:
    def __init__(self, data: bytes):
        self.words = data.split()  # at the six white characters of ASCII

    def __len__(self) -> int:
        return len(self.words)

    def take(self, places: np.ndarray) -> list[bytes]:
        return [self.words[i] for i in places.tolist()]


Text = ShortText | LongText
#: What a text's words become before runs are sought: of a row's hash and number of words, the word in each place, or None.
Edit = Callable[[int, int], np.ndarray | None]


def text_of(data: bytes) -> Text:
    return ShortText(data) if len(data) <= TILE_BYTES else LongText(data)


def numbers_of(text: Text, ids: Numbers) -> np.ndarray:
    parts = [
        np.fromiter(map(ids.__getitem__, text.take(np.arange(i, min(i + (1 << 16), len(text))))), np.int32)
        for i in range(0, len(text), 1 << 16)
    ] if isinstance(text, LongText) else [np.fromiter(map(ids.__getitem__, text.words), np.int32, len(text))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def printed(text: Text, order: np.ndarray | None, runs: list[Run]) -> Iterator[bytes]:
    """The text's words without those that a run repeats, joined by spaces, bit by bit."""
    if isinstance(text, ShortText) and order is None and not runs:
        yield b" ".join(text.words)
        return
    kept = np.ones(len(text), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    places = np.flatnonzero(kept)
    if order is not None:
        places = order[places]
    for i in range(0, len(places), 1 << 16):
        yield (b" " if i else b"") + b" ".join(text.take(places[i : i + (1 << 16)]))


def greatest(runs: list[Run]) -> Run | None:
    best: Run | None = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = [("runs", pa.list_(_RUN)), ("best", _RUN), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_FOUND_TYPE = (
    "runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, "
    "runs_sha256 string, collapsed_sha256 string"
)


def batch_of(ids: pa.Array, schema: pa.Schema, rows: list[tuple[Text, np.ndarray | None, list[Run]]], with_text: bool):
    """Arrow rows of what was found in each text."""
    columns: list[list] = [[], [], [], []]
    texts = []
    for text, order, runs in rows:
        best = greatest(runs)
        named = [dict(zip(("start", "length", "period"), x, strict=True)) for x in runs]
        columns[0].append(named)
        columns[1].append(None if best is None else dict(zip(("start", "length", "period"), best, strict=True)))
        columns[2].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
        whole, kept = hashlib.sha256(), []
        for part in printed(text, order, runs):
            whole.update(part)
            if with_text:
                kept.append(part)
        columns[3].append(whole.hexdigest())
        if with_text:
            texts.append(b"".join(kept).decode())
    arrays = [pa.array(x, kind) for x, (_, kind) in zip(columns, _FOUND, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *arrays, *([pa.array(texts, pa.string())] if with_text else [])], schema=schema)


def schema_of(id_kind: pa.DataType, with_text: bool) -> pa.Schema:
    return pa.schema([("doc_id", id_kind), *_FOUND, *([("collapsed", pa.string())] if with_text else [])])


def in_place(datas: list[bytes], hashes: list[int], edit: Edit | None) -> list[tuple[Text, np.ndarray | None, list[Run]]]:
    """Texts and their runs; the tiles of all of them are solved together, longer texts first."""
    ids, rows, numbers = Numbers(), [], []
    for data, h in zip(datas, hashes, strict=True):
        text = text_of(data)
        order = edit(h, len(text)) if edit else None
        own = numbers_of(text, ids)
        numbers.append(own if order is None else own[order])
        rows.append((text, order, []))
    by_size = sorted((i for i, x in enumerate(numbers) if len(x) >= SHORTEST), key=lambda i: -len(numbers[i]))
    if not by_size:
        return rows
    sizes = np.array([len(numbers[i]) for i in by_size])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(starts[-1], np.int32)
    for k, i in enumerate(by_size):
        words[starts[k] : starts[k + 1] - 1] = numbers[i]
        words[starts[k + 1] - 1] = -2 - k
    ends, p = [], LEAST_P
    while p == LEAST_P or 3 * p <= sizes[0]:
        ends.append(int(starts[np.count_nonzero(sizes >= (SHORTEST if p == LEAST_P else 3 * p))]))
        p *= 2
    fragments = stitched(solve(words, LEAST_P, p // 2, 0, len(words), ends))
    runs = [(s, e - s + q, q) for q, s, e in fragments if long_enough(e - s + q, q)]
    for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])):
        k = int(np.searchsorted(starts, s, "right")) - 1
        rows[by_size[k]][2].append((s - int(starts[k]), n, q))
    return rows


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SIDE_BY_SIDE:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def solver_in_place(edit: Edit | None, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = schema_of(batch.schema.field(0).type, with_text)
            sizes = [x or 0 for x in batch.column("size").to_pylist()]
            for lo, hi in slices(sizes):
                part = batch.slice(lo, hi - lo)
                rows = in_place(bytes_list(part.column("text")), part.column("hash").to_pylist(), edit)
                yield batch_of(part.column(0), schema, rows, with_text)

    return run


_TILE = pa.schema([
    ("key", pa.string()), ("first", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("p_least", pa.int64()),
    ("p_most", pa.int64()), ("width", pa.int32()), ("words", pa.binary()),
])
_TILE_TYPE = "key string, first long, lo long, hi long, p_least long, p_most long, width int, words binary"


def tiles_of(n: int, tile_words: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """p_least, p_most, lo and hi (of the grid points) and begin and end (of the words) of each row of tiles."""
    together = max(LEAST_P, tile_words // 8)
    p_least, p_most = LEAST_P, together
    while p_least == LEAST_P or 3 * p_least <= n:
        core = max(tile_words, 4 * p_most)
        for lo in range(0, n, core):
            yield p_least, p_most, lo, lo + core, max(0, lo - p_most), min(n, lo + core + 4 * p_most)
        p_least = p_most = 2 * p_most


def exploder(edit: Edit | None, tile_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                text, ids = LongText(bytes_list(row.column("text"))[0]), Numbers()
                numbers = numbers_of(text, ids)
                order = edit(row.column("hash")[0].as_py(), len(text)) if edit else None
                if order is not None:
                    numbers = numbers[order]
                width = 2 if len(ids) <= 1 << 16 else 4
                numbers = numbers.astype(f"<u{width}")
                key = row.column("key")[0].as_py()
                for p_least, p_most, lo, hi, begin, end in tiles_of(len(numbers), tile_words):
                    words = numbers[begin:end].tobytes()
                    made = {"key": key, "first": begin, "lo": lo, "hi": hi, "p_least": p_least, "p_most": p_most}
                    yield pa.RecordBatch.from_pylist([made | {"width": width, "words": words}], schema=_TILE)

    return run


def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals of each row of tiles, stitched within it."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            words = np.frombuffer(row["words"], f"<u{row['width']}").astype(np.int32)
            first = row["first"]
            found = stitched(solve(words, row["p_least"], row["p_most"], row["lo"] - first, row["hi"] - first))
            if found:
                period, start, end = zip(*found, strict=True)
                arrays = [
                    pa.array([row["key"]] * len(found), pa.string()), pa.array(period, pa.int64()),
                    pa.array([s + first for s in start], pa.int64()), pa.array([e + first for e in end], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "period", "start", "end"])


def stitched_runs(fragments: DataFrame) -> DataFrame:
    """``key`` and ``runs`` (by start, then period) of intervals dealt out by key and period."""
    own = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = fragments.withColumn("apart", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = apart.withColumn("island", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    runs = whole.withColumn("length", length).where(F.col("length") >= F.greatest(F.lit(SHORTEST), F.col("period") * 3))
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def printer(edit: Edit | None, with_text: bool):
    """Texts that have met their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = schema_of(batch.schema.field(0).type, with_text)
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                text = LongText(bytes_list(row.column("text"))[0])
                runs = [(x["start"], x["length"], x["period"]) for x in row.column("runs")[0].as_py() or []]
                runs.sort(key=lambda x: (x[0], x[2]))
                order = edit(row.column("hash")[0].as_py(), len(text)) if edit else None
                yield batch_of(row.column(0), schema, [(text, order, runs)], with_text)

    return run


def found(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None, with_text: bool = False,
    tile_bytes: int = TILE_BYTES, tile_words: int = TILE_WORDS,
) -> DataFrame:
    """``doc_id``, ``runs`` (by start, then period), ``best`` (of greatest length over period), their digests of each row.

    With ``with_text``, ``collapsed`` is the text without the words that a run holds after its first period.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)), "hash": F.crc32(id_text.cast("binary")),
    })
    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_FOUND_TYPE}{', collapsed string' * with_text}"
    short = rows.where(F.col("size") <= tile_bytes).mapInArrow(solver_in_place(edit, with_text), kind)
    # Rows of equal id and text share their tiles' intervals; finding them twice changes nothing.
    long = rows.where(F.col("size") > tile_bytes).withColumn("key", F.sha2(F.concat(id_text, F.lit("\n"), "text"), 256))
    tiles = long.mapInArrow(exploder(edit, tile_words), _TILE_TYPE).repartition("key", "p_least", "first")
    fragments = tiles.mapInArrow(solve_tiles, "key string, period long, start long, end long")
    met = long.join(stitched_runs(fragments), "key", "left").select("doc_id", "text", "hash", "runs")
    return short.unionByName(met.mapInArrow(printer(edit, with_text), kind))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``start`` (number of the first word), ``length`` and ``period`` (in words) of each run."""
    return found(docs, id_col, text_col).select("doc_id", F.inline("runs"))


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, without the words that a run holds after its first period, joined by single spaces."""
    return found(docs, id_col, text_col, with_text=True).select("doc_id", F.col("collapsed").alias("text"))


def repeated_tail(h: int, n: int) -> np.ndarray | None:
    """A tenth of the documents by hash: from some word on, the words repeat those before."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def digests(docs: DataFrame, edit: Edit | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    best = {name: F.col(f"best.{name}") for name in ("start", "length", "period")}
    return found(docs, id_col, text_col, edit).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[x.alias(name) for name, x in best.items()],
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
