"""Patterns by inventory and tokens by automaton, against every pattern and every token on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pairweave.functions import inventory
from pairweave.functions import patterns as P
from pairweave.functions.text import folded
from pairweave.operators import tokens

FIXED = [inventory.Named(*x) for x in P.TEMPORARY_FACTS]


@pytest.mark.parametrize(
    "pattern, literals",
    [
        (r"\bI'?a?m (?:now )?(?:renting|using)\b", {"renting", "using"}), (r"(?:a|b)?xyz", {"xyz"}), (r"\w+", set()),
        (r"for the next (?:few|\d+)", {"for the next "}), (r"(?:ab|\d)", set()), (r"(?:abc)+q", {"abc"}), (r"(?:abc)*q", {"q"}),
        (r"[xy]\d", {"x", "y"}), (r"Über", {"ber"}), (r"ABC|de", {"abc", "de"}), ("", set()),
    ],
)
def test_required_literals(pattern, literals):
    assert inventory.required_literals(pattern) == literals


def test_each_match_holds_a_required_literal():
    rnd = random.Random(1)
    words = "I'm I am currently now staying living at in renting the have been until till March next week for few 3 short-term while my dog is with me".split()
    for _ in range(4_000):
        text = " ".join(rnd.choice(words) for _ in range(8))
        for x in FIXED:
            if re.search(x.pattern, text, re.IGNORECASE):
                assert any(y in text.lower() for y in inventory.required_literals(x.pattern)), (x, text)


def test_hits_are_those_of_every_pattern(spark):
    texts = [
        "I'm currently staying at my aunt's. I'm renting a van", "she is living with us for the next 3 days, Short-Term", "nothing",
        "I have been working there until the end of May", "IM STAYING AT HOME", "while our cat gets fed; for now", "", None,
        "Im using it; Iam driving", "éfor now", "for nowé", "I'm taking the bus, till march, TILL MARCH",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.hits for r in df.select("i", inventory.hits(F.col("text"), FIXED).alias("hits")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        want = [(x.category, x.name, m[0]) for x in FIXED if (m := re.search(x.pattern, t, re.IGNORECASE * x.ignore_case))]
        assert [tuple(h) for h in got[i]] == want, t
    assert {h.category for hits in got.values() for h in hits or []} == {"PROG", "PERF_PROG", "BOUND", "TEMP_ADV", "THIRD_PROG"}


def test_texts_without_a_literal_reach_no_pattern(spark):
    """This pattern would run for hours on these texts."""
    slow = [inventory.Named("SLOW", "nested", r"(?:(?:a+)+)+b\bwanted", False)]
    df = spark.createDataFrame([("a" * 200,)] * 50, "text string")
    assert all(r.hits == [] for r in df.select(inventory.hits(F.col("text"), slow).alias("hits")).collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_token_hits(spark, block_bytes):
    names = ["Café", "cafe", "New York", "ﬁn", "王", "it's", "a", "x-1", "", None, "york", "Ｗide", "no such", "b a"]
    texts = [
        "The CAFÉ in new york", "cafes and Newyork", "new  york", "a fin; it’s 王王", "x-1x x-12", None, "", "b a b", "wide", "ayork york_",
        "y" * 50 + " york",
    ]
    rows = [(i % 9, t, "cafe" if i == 0 else None) for i, t in enumerate(texts)]
    got = tokens.token_hits(
        spark.createDataFrame(rows, "k int, text string, mine string").repartition(2), spark.createDataFrame([(n,) for n in names], "token string"),
        ["k"], own="mine", block_bytes=block_bytes,
    )
    fold = lambda x: folded(x).lower()
    want = sorted(
        (k, t)
        for k, text, mine in rows
        for t in {fold(n) for n in names if n}
        if text and t != fold(mine or "") and re.search(f"(?<![A-Za-z]){re.escape(t)}(?![A-Za-z])", fold(text))
    )
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_no_tokens_no_hits(spark):
    none = tokens.token_hits(spark.createDataFrame([(1, "x")], "k int, text string"), spark.createDataFrame([], "token string"), ["k"])
    assert none.count() == 0
