"""An inventory of patterns: which of many named patterns a text matches, and with what.

A pattern can match only where one of its required literals stands. These are read off the pattern, and searched first: the
pattern itself runs only on texts that hold one. All of it stays in the JVM.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Named(NamedTuple):
    category: str
    name: str
    pattern: str
    ignore_case: bool


def required_literals(pattern: str) -> frozenset[str]:
    """Lower-case ASCII strings of which each match holds one at least, in any case; none if the pattern demands no literal."""
    return _required(parser.parse(pattern))


def _better(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    """The one whose shortest literal is longer; then the smaller."""
    worth = lambda x: (min(map(len, x)), -len(x)) if x else (0, 0)
    return a if worth(a) >= worth(b) else b


def _required(parsed) -> frozenset[str]:
    best, run = frozenset(), ""
    for op, value in [*parsed, (None, None)]:
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op is C.AT:
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        own = frozenset()
        if op is C.SUBPATTERN:
            own = _required(value[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            own = _required(value[2])
        elif op is C.BRANCH:
            each = [_required(x) for x in value[1]]
            own = frozenset().union(*each) if all(each) else own
        elif op is C.IN and all(o is C.LITERAL and v < 128 for o, v in value):
            own = frozenset(chr(v).lower() for _, v in value)
        best = _better(best, own)
    return best


def may_match(lower: Column, pattern: str) -> Column:
    """Whether a lower-case text holds what the pattern demands."""
    literals = sorted(required_literals(pattern))
    return reduce(or_, [F.contains(lower, F.lit(x)) for x in literals]) if literals else F.lit(True)


def hits(text: Column, inventory: list[Named]) -> Column:
    """An array of (category, name, match) of the patterns that the text matches, in their order, with each one's first match.

    Null for a null text. Classes, borders of words and case are those of Unicode, as in Python's patterns on text.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def one(x: Named, low: Column) -> Column:
        java = ("(?iuU)" if x.ignore_case else "(?U)") + x.pattern
        found = F.when(may_match(low, x.pattern), F.when(F.rlike(text, F.lit(java)), F.regexp_extract(text, java, 0)))
        return F.struct(F.lit(x.category).alias("category"), F.lit(x.name).alias("name"), found.alias("match"))

    # The lower-case text is made once, as the element of an array.
    rows = F.transform(F.array(lower), lambda low: F.array(*[one(x, low) for x in inventory]))
    return F.when(text.isNotNull(), F.filter(F.element_at(rows, 1), lambda h: h["match"].isNotNull()))
