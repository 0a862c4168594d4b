"""1. Byte-level BPE encoding and decoding.

The rank file is read on the driver and broadcast (its size is fixed by the vocabulary, under 1 MB for 50k ranks).
A task maps bytes to Latin-1 so that one Aho-Corasick automaton lists every vocabulary match of a piece. Encoding then
goes from left to right with the longest match and backtracks to shorter prefixes where two neighbouring tokens could
not both survive the merges; that test of two tokens is memoised. Each (position, end) is tried once, so the work is
linear in the piece, and the result equals merging by rank.

Null texts count as empty: no tokens, the digests of the empty string. Repeated rows give repeated results; an empty table
gives an empty one. Texts of any length are encoded whole, 128 rows at a time. Columns other than the id are not carried
by ``digests``, and ``encode_decode`` adds its own under free names, so none can clash.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_slices, fresh, text_list

#: Pieces up to this many characters are remembered.
REMEMBERED_LENGTH = 64
REMEMBERED_CHUNKS = 150_000
REMEMBERED_PAIRS = 200_000
#: Unicode's White_Space characters: before a run of them, after any other character, the pattern always ends a piece.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word of Latin letters with only punctuation between it and the next white space, and that punctuation, are pieces by
#: themselves; anything else is taken up to the next such place and left to the pattern.
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?"
CHUNK = re.compile(
    f" ?[{LATIN}]+(?=[{MARKS}]*(?:[{WHITE}]|\\Z))|[{MARKS}]+(?=[{WHITE}]|\\Z)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"
)
PIECE = re.compile(f" ?[{LATIN}]+|[{MARKS}]+").fullmatch


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of ``base64(token) rank`` lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class BytePairs:
    """Encoder and decoder of one vocabulary of ranks, for whole texts that a pattern splits into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        # Chunks and pieces without the pattern are known of this one only; texts under others are split as a whole.
        self.by_chunks = pattern == public_tokenizers.PATTERN
        # The last merge that makes each token; tokens that merging never makes stay out of the automaton.
        self.halves: dict[int, tuple[int, int]] = {}
        self.lengths: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[i] = (i, i)
            else:
                parts = self._merged(token, i)
                if len(parts) != 2:
                    continue
                self.halves[i] = pair = (ranks[parts[0]], ranks[parts[1]])
                self.joined[pair] = i
            self.lengths[i] = len(token)
        made = {self.bytes_of[i] for i in self.lengths}
        self.shorter = {
            ranks[t]: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), None)
            for t in made
        }
        self.automaton = ahocorasick.Automaton()
        self.single = [ranks[bytes([b])] for b in range(256)]
        for t in made:
            if len(t) > 1:
                self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, ranks[t]))
        self.automaton.make_automaton()
        self.size = max(ranks.values(), default=0) + 1
        self.fits = Memo(self._fits, REMEMBERED_PAIRS)
        self.chunks = Memo(self._chunk, REMEMBERED_CHUNKS)

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """The token's bytes after all merges of a rank under ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: int) -> bool:
        """Whether two neighbouring tokens survive: no merge across their border comes before those inside them."""
        left, right = divmod(pair, self.size)
        limit = self.size + 1
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, self.halves[left][1]
                if left == limit:
                    return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest = list(map(self.single.__getitem__, piece))
        for end, (n, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n] = token  # ends ascend, so the longest stays
        lengths, shorter, fits, size, base = self.lengths, self.shorter, self.fits, len(piece), self.size
        shut_ends: set[int] = set()
        out: list[int] = []
        at, last, token = 0, None, longest[0] if size else None
        while token is not None:
            while token is not None:
                end = at + lengths[token]
                if (last is None or fits[last * base + token]) and end not in shut_ends:
                    out.append(token)
                    at, last, token = end, token, longest[end] if end < size else None
                    break
                token = shorter[token]
            else:
                shut_ends.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else None
        return out

    def _chunk(self, chunk: str) -> bytes:
        if self.by_chunks and PIECE(chunk):
            return array("I", self.encode_piece(chunk.encode())).tobytes()
        ids: list[int] = []
        for piece in self.pieces(chunk):
            ids += self.encode_piece(piece.encode())
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not self.by_chunks:
            return self._chunk(text)
        chunks = CHUNK.findall(text)
        if chunks and max(map(len, chunks)) > REMEMBERED_LENGTH:
            return b"".join([self.chunks[c] if len(c) <= REMEMBERED_LENGTH else self._chunk(c) for c in chunks])
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_MADE: dict[tuple[str, str], BytePairs] = {}


def made(data: bytes, pattern: str) -> BytePairs:
    """One encoder for each vocabulary in a Python worker."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = BytePairs(parse_ranks(data), pattern)
        gc.set_threshold(200_000, 50, 100)  # the memories hold many small objects and no cycles
    return _MADE[key]


def encoder(ranks: Broadcast, pattern: str):
    """Column function: text to ids (binary, little-endian unsigned 32-bit)."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        encode_one = made(ranks.value, pattern).encode
        return by_slices(texts, pa.binary(), lambda some: pa.array(map(encode_one, text_list(some)), pa.binary()))

    return encode


def decoder(ranks: Broadcast, pattern: str):
    """Column function: ids, as ``encoder`` gives them, to the bytes that they stand for."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        decode_one = made(ranks.value, pattern).decode
        return by_slices(
            ids, pa.binary(),
            lambda some: pa.array([None if x is None else decode_one(x) for x in some.to_pylist()], pa.binary()),
        )

    return decode


def round_trip(ranks: Broadcast, pattern: str):
    """Column function: text to struct(ids, decoded), as ``encoder`` and then ``decoder`` give them; each text is encoded once."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        own = made(ranks.value, pattern)

        def run(some: pa.Array) -> pa.Array:
            ids = [own.encode(x) for x in text_list(some)]
            return pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], fields=list(kind),
            )

        return by_slices(texts, kind, run)

    return both


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with two new columns: ``ids`` (binary) and ``decoded`` (binary), under names that are still free.

    Returns the frame; the names are its last two columns. ``vocabulary`` is the path of the rank file on the driver.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    both, ids, decoded = fresh(df, "both"), fresh(df, "ids"), fresh(df, "decoded")
    # One function for both: Spark would run encode again inside decode(encode(text)).
    out = df.withColumn(both, round_trip(ranks, pattern)(F.col(text)))
    return out.select(*df.columns, F.col(f"{both}.ids").alias(ids), F.col(f"{both}.decoded").alias(decoded))


def hex_sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def digests(df: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    out = encode_decode(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), vocabulary, pattern)
    return out.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        hex_sha256(F.col("ids")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )
