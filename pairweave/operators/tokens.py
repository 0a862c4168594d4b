"""Which tokens of a table stand in which texts of another, letter-bounded, in any script.

Texts and tokens are folded (quotes, compatibility forms, marks) and lower-cased alike. A token counts where no ASCII letter
touches it; it may hold spaces. Tokens go out in blocks of bounded size, one at a time: each is an automaton that passes over
every text once, whatever the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from .contained import by_blocks

BLOCK_BYTES = 16 << 20


def plain(x: str | None) -> str:
    return folded(x or "").lower()


def plain_column(column: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(map(plain, values.to_pylist()), pa.string())

    return run(column)


def is_letter(x: str) -> bool:
    return x.isascii() and x.isalpha()


class Tokens:
    def __init__(self, tokens: list[str]):
        self.automaton = ahocorasick.Automaton()
        for t in tokens:
            self.automaton.add_word(t, t)
        if tokens:
            self.automaton.make_automaton()
        self.any = bool(tokens)

    def found(self, text: str) -> set[str]:
        """The tokens that stand in a folded text with no letter at either side."""
        out: set[str] = set()
        if not self.any:
            return out
        for last, token in self.automaton.iter(text):
            if token not in out:
                first = last - len(token) + 1
                if not (first and is_letter(text[first - 1])) and not (last + 1 < len(text) and is_letter(text[last + 1])):
                    out.add(token)
        return out


def token_hits(
    responses: DataFrame, tokens: DataFrame, keys: list[str], text: str = "text", token: str = "token",
    own: str | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keys`` and ``token`` (folded) of each response and each token that stands in it; a row's own token, if any, is left out.

    Null and empty tokens are not searched; tokens that fold to the same count once. Null texts hold nothing. Keys need not
    be unique: each row gives its own hits.
    """
    wanted = tokens.select(plain_column(F.col(token).cast("string")).alias("text")).where("text <> ''").distinct()
    rows = responses.select(*keys, F.col(text).alias("_text"), (F.col(own) if own else F.lit(None)).cast("string").alias("_own"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Tokens(shared.value)
            for batch in batches:
                places, hits = [], []
                for i, (x, mine) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_own").to_pylist(), strict=True)):
                    for t in known.found(plain(x)) - {plain(mine)} if x else ():
                        places.append(i)
                        hits.append(t)
                at = pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(at) for k in keys], pa.array(hits, pa.string())], names=[*keys, "token"],
                )

        return rows.mapInArrow(run, f"{kind}, token string")

    return by_blocks(wanted, block_bytes, lambda r: r["text"], search)
