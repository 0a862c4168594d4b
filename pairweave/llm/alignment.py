"""12. Cross-tokenizer alignment: how the tokens of a byte-level BPE vocabulary (A) and of a piece model (B) share a text's bytes.

Both tokenize a space and the text.  Merging the ends of A's and B's tokens, as byte offsets, gives the alignment: between two
neighbouring ends lies one overlap of an A and a B token (a link), and where both end, a group ends.

Merge-path partitioning divides that merge: a binary search on each diagonal of the two lists of ends finds how many ends of
each list come before it, so that every piece has ``PIECE_ENDS`` ends, whatever the tokens look like.  A piece carries the
tokens that end in it and the next token of each side, which may reach into it, and needs nothing else to emit its links.
Groups that a piece's border cuts are stitched: each piece gives what stands before its first and after its last common end.

1. Texts are encoded once and written as rows of pieces (most texts are one).
2. Pieces give links, counted by pair of ids within a task, then by a shuffle of the different pairs.
3. Pieces give links again and look up their pairs' counts.  A pair with over 1 of ``HOT_PAIRS`` of all links is hot; there
   are at most as many, and they are broadcast.  The other pairs meet their counts by a shuffle, each with few rows.

The highest count of each B id is a table bounded by B's vocabulary.

B's model must add one space in front and leave texts as they are (no normalization). Whole texts are encoded by the public
libraries; a memory of chunks did not pay where an eighth of all words are new. Null and empty texts have no tokens, nor have texts whose tokens' bytes don't join to a space and the text;
then all numbers are 0 and the groups are ''.  Repeated rows give repeated results and count as often.  A text of any length
is encoded in one task, and aligned in many.  Highest counts tie.  An empty table gives an empty one.  Only the named columns
are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_list, written

PIECE_ENDS = 1 << 15
HOT_PAIRS = 1 << 20
#: Different pairs that a task counts before it hands them on.
COUNTED_PAIRS = 1 << 21
#: Token ends that one call aligns.
CALL_ENDS = 1 << 19
SPACE = "▁"


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the signs from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(tokenizer: bytes) -> dict[bytes, int]:
    """The tokens of a byte-level BPE tokenizer's JSON, without special ones; their ids rise in the order of the merges."""
    parsed, signs = json.loads(tokenizer), byte_of_sign()
    special = {x["id"] for x in parsed["added_tokens"]}
    return {bytes(map(signs.__getitem__, t)): i for t, i in parsed["model"]["vocab"].items() if i not in special}


class Lengths:
    """Of each token in bytes, and the integers that hold a side's ids."""

    def __init__(self, ranks: dict[bytes, int], pieces: list[bytes]):
        self.a, self.b = np.zeros(max(ranks.values()) + 1, np.int64), np.array([len(x) for x in pieces], np.int64)
        for token, i in ranks.items():
            self.a[i] = len(token)
        self.a_kind, self.b_kind = ("<u2" if len(x) <= 1 << 16 else "<u4" for x in (self.a, self.b))


def bytes_of_pieces(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    named = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(named)]


class Tokenizers:
    """Both encoders, and the length of each token in bytes."""

    def __init__(self, byte_level: bytes, pieces: bytes, pattern: str):
        ranks = ranks_of(byte_level)
        # The public library merges by rank, so the JSON's vocabulary needs no encoder of its own.
        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = bytes_of_pieces(self.b)
        self.lengths = Lengths(ranks, self.b_bytes)
    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids by A and by B; none if text is empty or either side's bytes are not a space and the text."""
        none = np.zeros(0, np.uint32)
        b = self.b.encode(text)
        if not text or b"".join(map(self.b_bytes.__getitem__, b)) != (" " + text).encode():
            return none, none
        # A's side is exact for any text, as every byte is a token.
        return np.array(self.a.encode_ordinary(" " + text), np.uint32), np.array(b, np.uint32)


_MADE: dict[tuple, Tokenizers] = {}


def made(models: Broadcast) -> Tokenizers:
    """One pair of encoders in a Python worker."""
    key = tuple(hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest() for x in models.value)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokenizers(*models.value)
    return _MADE[key]


def diagonals(a_ends: np.ndarray, b_ends: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B come before each ``every``-th end of their merge, equal ends never being parted."""
    d = np.arange(every, len(a_ends) + len(b_ends), every)
    low, high = np.maximum(0, d - len(b_ends)), np.minimum(d, len(a_ends))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        i, j = np.minimum(middle, len(a_ends) - 1), np.clip(d - 1 - middle, 0, len(b_ends) - 1)
        first = open_ & (a_ends[i] <= b_ends[j])
        low, high = np.where(first, middle + 1, low), np.where(open_ & ~first, middle, high)
    a, b = low, d - low
    b += (b < len(b_ends)) & (a > 0) & (a_ends[a - 1] == b_ends[np.minimum(b, len(b_ends) - 1)])
    return a, b


def pieces_of(
    a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, ends: int,
) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """How many tokens of A and B end in a piece, where its first ones begin (from its border), and its tokens."""
    if len(a) + len(b) <= ends:
        yield len(a), len(b), 0, 0, a, b
        return
    i, j = diagonals(a_ends, b_ends, ends)
    i, j = np.concatenate([[0], i, [len(a)]]).tolist(), np.concatenate([[0], j, [len(b)]]).tolist()
    for k in range(len(i) - 1):
        a_begin, b_begin = (int(x[n - 1]) if n else 0 for x, n in ((a_ends, i[k]), (b_ends, j[k])))
        border = max(a_begin, b_begin)
        yield (
            i[k + 1] - i[k], j[k + 1] - j[k], a_begin - border, b_begin - border,
            a[i[k] : i[k + 1] + 1], b[j[k] : j[k + 1] + 1],
        )


_PIECE_TYPE = (
    "row long, doc_id {}, piece int, pieces int, a_own int, b_own int, a_begin int, b_begin int, a binary, b binary"
)


def encoded(
    docs: DataFrame, models: Broadcast, id_col: str = "doc_id", text_col: str = "text", piece_ends: int = PIECE_ENDS,
) -> DataFrame:
    """Rows of pieces, written: every later step reads these and no text."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = made(models)
        a_kind, b_kind = both.lengths.a_kind, both.lengths.b_kind
        for batch in batches:
            for at in range(0, len(batch), 128):
                some = batch.slice(at, 128)
                columns: list[list] = [[] for _ in range(9)]
                for i, (a, b) in enumerate(map(both.encode, text_list(some.column("text")))):
                    a_ends, b_ends = np.cumsum(both.lengths.a[a]), np.cumsum(both.lengths.b[b])
                    cut = list(pieces_of(a, b, a_ends, b_ends, piece_ends))
                    for k, (a_own, b_own, a_begin, b_begin, a_ids, b_ids) in enumerate(cut):
                        made_row = (i, k, len(cut), a_own, b_own, a_begin, b_begin, a_ids.astype(a_kind), b_ids.astype(b_kind))
                        for column, value in zip(columns, made_row, strict=True):
                            column.append(value)
                places = pa.array(columns[0], pa.int64())
                ints = [pa.array(x, pa.int32()) for x in columns[1:7]]
                ids = [pa.array([y.tobytes() for y in x], pa.binary()) for x in columns[7:]]
                names = ["row", "doc_id", "piece", "pieces", "a_own", "b_own", "a_begin", "b_begin", "a", "b"]
                kept = [some.column("row").take(places), some.column("doc_id").take(places)]
                yield pa.RecordBatch.from_arrays([*kept, *ints, *ids], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return written(rows.mapInArrow(run, _PIECE_TYPE.format(kind)), "pieces")


@dataclass
class Links:
    """The links of some pieces, in order, and where their groups end. Pieces stand one behind the other, as bytes."""

    pieces: int
    #: Of each link: the piece, the ids, and whether a group ends with it.
    piece: np.ndarray
    a: np.ndarray
    b: np.ndarray
    closes: np.ndarray
    #: Of each token that ends in a piece, by side: piece, end and id.
    a_tokens: tuple[np.ndarray, np.ndarray, np.ndarray]
    b_tokens: tuple[np.ndarray, np.ndarray, np.ndarray]
    ends: np.ndarray
    #: The end of each piece.
    borders: np.ndarray


def side(batch: pa.RecordBatch, name: str, kind: str, lengths: np.ndarray):
    """Piece, end from the piece's border, id, and whether it ends in the piece, of one side's tokens."""
    data = batch.column(name)
    counts = pc.binary_length(data).to_numpy() // np.dtype(kind).itemsize
    ids = np.frombuffer(b"".join(data.to_pylist()), kind).astype(np.int32)
    first = np.cumsum(counts) - counts
    piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    ends = np.cumsum(lengths[ids], dtype=np.int64)
    begin = batch.column(f"{name}_begin").to_numpy() - np.concatenate([[0], ends])[first]
    own = batch.column(f"{name}_own").to_numpy()
    ends += np.repeat(begin, counts)
    # Only a text of several pieces has tokens that reach beyond one.
    is_own = None if (own == counts).all() else np.arange(len(ids)) - np.repeat(first, counts) < np.repeat(own, counts)
    return piece, ends, ids, is_own, counts


def counts_before(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place."""
    out = np.empty(len(marks) + 1, np.int32)
    out[0] = 0
    np.cumsum(marks, dtype=np.int32, out=out[1:])
    return out[:-1]


def links_of(batch: pa.RecordBatch, lengths: Lengths) -> Links:
    """Merge the ends of many pieces at once, by marks on their bytes."""
    n = len(batch)
    sides = [side(batch, "a", lengths.a_kind, lengths.a), side(batch, "b", lengths.b_kind, lengths.b)]
    span = np.zeros(n, np.int64)
    for _, ends, _, _, counts in sides:
        last = np.cumsum(counts) - 1
        some = counts > 0
        span[some] = np.maximum(span[some], ends[last[some]])
    borders = np.cumsum(span)
    size = int(borders[-1]) + 1 if n else 1
    marks, own_marks, before, tokens = [], np.zeros(size, bool), [], []
    for piece, ends, ids, own, counts in sides:
        ends += np.repeat(borders - span, counts)
        mark = np.zeros(size, bool)
        mark[ends] = True
        marks.append(mark)
        before.append(counts_before(mark))
        tokens.append((piece, ends, ids) if own is None else (piece[own], ends[own], ids[own]))
        own_marks[tokens[-1][1]] = True
    ends = np.flatnonzero(own_marks)
    a_at, b_at = before[0][ends], before[1][ends]  # the first tokens that end there or after
    a_ids, b_ids = sides[0][2][a_at].astype(np.int64), sides[1][2][b_at].astype(np.int64)
    piece = sides[0][0][a_at].astype(np.int64)
    return Links(n, piece, a_ids, b_ids, marks[0][ends] & marks[1][ends], *tokens, ends, borders)


def calls(batch: pa.RecordBatch, lengths: Lengths) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CALL_ENDS`` token ends."""
    sizes = batch.column("a_own").to_numpy() + batch.column("b_own").to_numpy()
    reach, start = np.cumsum(sizes), 0
    while start < len(batch):
        limit = (reach[start - 1] if start else 0) + CALL_ENDS
        end = max(start + 1, int(np.searchsorted(reach, limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sum of their weights."""
    order = None if weights is None else np.argsort(keys)
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))  # keys are 0 or more
    ends = np.append(first[1:], len(keys))[: len(first)]
    if order is None:
        return keys[first], ends - first
    sums = np.append(0, np.cumsum(weights[order]))
    return keys[first], sums[ends] - sums[first]


def pair_counts(pieces: DataFrame, lengths: Broadcast) -> DataFrame:
    """``pair`` (A's id times the size of B's vocabulary, plus B's id) and ``n``, its links in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def handed() -> pa.RecordBatch:
            keys, n = counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        for batch in batches:
            for some in calls(batch, own):
                found = links_of(some, own)
                held.append(counted(found.a * len(own.b) + found.b))
                n_held += len(held[-1][0])
                if n_held > COUNTED_PAIRS:
                    held[:] = [counted(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    n_held = len(held[0][0])
                    if n_held > COUNTED_PAIRS // 2:
                        yield handed()
                        held.clear()
                        n_held = 0
        if held:
            yield handed()

    parts = pieces.mapInArrow(run, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


class GroupTexts:
    """Prints groups: ids of A, a bar, ids of B, a semicolon."""

    def __init__(self, lengths: Lengths):
        self.n_a, n_b = len(lengths.a), len(lengths.b)
        a, b = [b"%d" % i for i in range(self.n_a)], [b"%d" % i for i in range(n_b)]
        #: A's ids before another one of A and before B's, B's before another one of B and before the next group.
        self.table = np.array([x + y for ids, ends in ((a, b",|"), (b, b",;")) for y in (ends[:1], ends[1:]) for x in ids], object)
        self.b_from, self.n_b = 2 * self.n_a, n_b

    def printed(self, found: Links) -> tuple[np.ndarray, np.ndarray]:
        """Table rows in the order of printing, and where each piece's part of them ends. A piece's border ends a group."""
        marks = np.zeros(int(found.borders[-1]) + 1 if found.pieces else 1, bool)
        marks[found.ends[found.closes]] = True
        marks[found.borders] = True
        group = counts_before(marks)
        (a_piece, a_ends, a_ids), (b_piece, b_ends, b_ids) = found.a_tokens, found.b_tokens
        a_group, b_group = group[a_ends], group[b_ends]
        groups = int(group[-1]) + 1
        n_a, n_b = (np.cumsum(np.bincount(x, minlength=groups)) for x in (a_group, b_group))
        out = np.empty(len(a_ids) + len(b_ids), np.int32)
        at_a, at_b = np.arange(len(a_ids)), np.arange(len(b_ids))
        a_last, b_last = n_a[a_group] == at_a + 1, n_b[b_group] == at_b + 1
        out[at_a + np.append(0, n_b)[a_group]] = a_ids + self.n_a * a_last
        out[at_b + n_a[b_group]] = self.b_from + b_ids + self.n_b * b_last
        both = np.bincount(a_piece, minlength=found.pieces) + np.bincount(b_piece, minlength=found.pieces)
        return out, np.cumsum(both)


def parts_of(found: Links, k: int) -> dict:
    """Of one piece of several: what it has of the group before, its whole groups, what it has of the group after."""
    own = [[x[t[0] == k].tolist() for x in t[1:]] for t in (found.a_tokens, found.b_tokens)]
    closing = found.ends[found.closes & (found.piece == k)]
    sides = []
    for ends, ids in own:
        group = np.searchsorted(closing, ends).tolist()
        lists: list[list[str]] = [[] for _ in range(len(closing) + 1)]
        for g, i in zip(group, ids, strict=True):
            lists[g].append(str(i))
        sides.append([",".join(x) for x in lists])
    a, b = sides
    closed = len(closing) > 0
    return {
        "head_a": a[0], "head_b": b[0], "closed": closed, "tail_a": a[-1] * closed, "tail_b": b[-1] * closed,
        "middle": ";".join(map("|".join, zip(a[1:-1], b[1:-1], strict=True))),
    }


_PARTS = "struct<piece:int,head_a:string,head_b:string,closed:boolean,tail_a:string,tail_b:string,middle:string>"


def stitched(parts: list[dict]) -> str:
    """The groups of a text from its pieces in order."""
    out: list[str] = []
    a: list[str] = []
    b: list[str] = []
    for x in parts:
        a += [x["head_a"]] * bool(x["head_a"])
        b += [x["head_b"]] * bool(x["head_b"])
        if x["closed"]:
            out.append(f"{','.join(a)}|{','.join(b)}")
            out += [x["middle"]] * bool(x["middle"])
            a, b = [x["tail_a"]] * bool(x["tail_a"]), [x["tail_b"]] * bool(x["tail_b"])
    return ";".join(out)


def stitched_groups(parts: Column) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else stitched(x) for x in column.to_pylist()], pa.string())

    return run(parts)


@dataclass
class HotPairs:
    """Pairs in order, with their number of links and whether that is the highest of their B id."""

    pair: np.ndarray
    n: np.ndarray
    best: np.ndarray

    def found(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs stand, and whether they do."""
        at = np.minimum(np.searchsorted(self.pair, pairs), max(0, len(self.pair) - 1))
        return at, self.pair[at] == pairs if len(self.pair) else np.zeros(len(pairs), bool)


def sums_by(groups: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Exact sums of groups that stand in order."""
    total = np.append(0, np.cumsum(values))
    return np.diff(total[np.searchsorted(groups, np.arange(n + 1))])


def measured(pieces: DataFrame, lengths: Broadcast, hot: Broadcast, with_groups: bool) -> DataFrame:
    """Each piece's numbers, groups, and links of pairs that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = lengths.value, hot.value
        texts, every = GroupTexts(own), len(own.a) * len(own.b)
        for batch in batches:
            for some in calls(batch, own):
                found = links_of(some, own)
                keys, times = counted(found.piece * every + found.a * len(own.b) + found.b)
                piece, pairs = np.divmod(keys, every)
                at, is_hot = known.found(pairs)
                hot_times, hot_piece, at = times[is_hot], piece[is_hot], at[is_hot]
                items, reach = texts.printed(found)
                start, digests, groups, parts = 0, [], [], []
                for k, (end, n) in enumerate(zip(reach.tolist(), some.column("pieces").to_pylist(), strict=True)):
                    text = b"".join(texts.table[items[start:end]].tolist())[:-1] if n == 1 else None
                    whole = text is not None
                    digests.append((hashlib.sha256(text).hexdigest() if text else "") if whole else None)
                    groups.append(text.decode() if whole and with_groups else None)
                    parts.append(None if whole else {"piece": some.column("piece")[k].as_py(), **parts_of(found, k)})
                    start = end
                cold_piece = piece[~is_hot]
                offsets = np.searchsorted(cold_piece, np.arange(len(some) + 1))
                cold = pa.StructArray.from_arrays(
                    [pa.array(pairs[~is_hot], pa.int64()), pa.array(times[~is_hot], pa.int64())], names=["pair", "times"],
                )
                numbers = [
                    np.bincount(found.piece, minlength=len(some)), np.bincount(found.piece[found.closes], minlength=len(some)),
                    sums_by(hot_piece, len(some), hot_times * known.best[at]), sums_by(hot_piece, len(some), hot_times * known.n[at]),
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row"), some.column("doc_id"),
                        some.column("a_own").cast(pa.int64()), some.column("b_own").cast(pa.int64()),
                        *[pa.array(x, pa.int64()) for x in numbers], pa.array(digests, pa.string()),
                        pa.array(groups, pa.string()), pa.array(parts, _parts_type()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cold),
                    ],
                    names=[
                        "row", "doc_id", "n_a", "n_b", "n_links", "n_groups", "n_best", "count_sum", "sha", "groups",
                        "parts", "cold",
                    ],
                )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.mapInArrow(run, (
        f"row long, doc_id {kind}, n_a long, n_b long, n_links long, n_groups long, n_best long, count_sum long, sha string, "
        f"groups string, parts {_PARTS}, cold array<struct<pair:long,times:long>>"
    ))


def _parts_type() -> pa.DataType:
    text = [(x, pa.string()) for x in ("head_a", "head_b")]
    tail = [(x, pa.string()) for x in ("tail_a", "tail_b", "middle")]
    return pa.struct([("piece", pa.int32()), *text, ("closed", pa.bool_()), *tail])


def aligned(
    docs: DataFrame, byte_level: str, piece_model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_groups: bool = False, piece_ends: int = PIECE_ENDS, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """The contract's columns of each row; with ``with_groups`` also ``groups`` themselves.

    ``byte_level`` and ``piece_model`` are paths on the driver; ``pattern`` is what the byte-level tokenizer splits texts by.
    """
    spark = docs.sparkSession
    with open(byte_level, "rb") as f, open(piece_model, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read(), pattern))
    model = sentencepiece.SentencePieceProcessor(model_proto=models.value[1])
    lengths = spark.sparkContext.broadcast(Lengths(ranks_of(models.value[0]), bytes_of_pieces(model)))
    pieces = encoded(docs, models, id_col, text_col, piece_ends)
    counts = written(pair_counts(pieces, lengths), "pairs")
    b_id = F.col("pair") % len(lengths.value.b)
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    # One row for each id of B's vocabulary at most.
    ranked = counts.withColumn("b", b_id).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * hot_pairs > total
    hot = ranked.where(is_hot).orderBy("pair").toArrow()
    known = HotPairs(*(hot.column(x).to_numpy() for x in ("pair", "n", "best")))
    rows = written(measured(pieces, lengths, spark.sparkContext.broadcast(known), with_groups), "alignment")
    links = rows.select("row", F.inline("cold")).join(ranked.where(~is_hot), "pair")
    looked_up = links.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    sums = ("n_a", "n_b", "n_links", "n_groups", "n_best", "count_sum")
    every = rows.drop("cold").unionByName(looked_up, allowMissingColumns=True)
    whole = every.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums],
        F.max("sha").alias("sha"), F.max("groups").alias("groups"),
        F.sort_array(F.collect_list("parts")).alias("parts"),
    )
    text = stitched_groups(F.when(F.size("parts") > 0, F.col("parts")))
    done = whole.withColumn("text", text)
    sha = F.coalesce("sha", F.sha2(F.col("text").cast("binary"), 256))
    groups = [F.coalesce("groups", "text").alias("groups")] if with_groups else []
    return done.select("doc_id", *sums, sha.alias("groups_sha256"), *groups)
