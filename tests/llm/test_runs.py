"""Operator 11 against brute force over every period."""

import hashlib
import random
import zlib

import pytest

from pairweave.llm import periodic, queries

WHITE = " \t\n\x0b\x0c\r"


def brute(words):
    """Runs by start and period: every period's stretches, each under its smallest period."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(24, 3 * q):
                seen.setdefault((start, length), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda x: (x[0], x[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def some_text(rnd):
    words = []
    for _ in range(rnd.randint(1, 5)):
        base = [rnd.choice("abcé"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 40))]
        if rnd.random() < 0.4:
            base = base[:2] * rnd.randint(2, 6) + base[2:]
        words += (base * rnd.randint(1, 9))[: rnd.randint(1, 300)] + [rnd.choice("abcdef") for _ in range(rnd.randint(0, 20))]
    return "".join(w + rnd.choice(WHITE) * rnd.randint(1, 2) for w in words)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    texts = [some_text(rnd) for _ in range(120)]
    texts += ["", None, " \n ", "a", "a " * 23, "a " * 24, " ".join("ab" * 20), "x y z " * 2000, ("p q " * 9 + "r ") * 40]
    out = list(enumerate(texts)) + [(None, "k " * 90), (7, texts[7]), (7, "k l " * 50)]
    return out


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("tile_bytes, tile_words", [(periodic.TILE_BYTES, periodic.TILE_WORDS), (300, 64), (0, 256)])
def test_runs_equal_brute_force(spark, rows, tile_bytes, tile_words):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = periodic.found(docs, edit=periodic.repeated_tail, tile_bytes=tile_bytes, tile_words=tile_words, with_text=True)
    want = sorted((expected(i, t) for i, t in rows), key=str)
    seen = []
    for r in got.collect():
        best = tuple(r.best) if r.best else (None,) * 3
        milli = 1000 * best[1] // best[2] if r.best else None
        seen.append((r.doc_id, len(r.runs), *best, milli, r.runs_sha256, r.collapsed_sha256))
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert sorted(seen, key=str) == want


def test_query_on_a_table(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, runs string, size int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(i, t) for i, t in rows), key=str)


def test_runs_and_texts(spark):
    docs = spark.createDataFrame([(1, "go  now " + "tick tock " * 20 + "end")], "n int, body string")
    assert [tuple(r) for r in periodic.runs(docs, "n", "body").collect()] == [(1, 2, 40, 2)]
    assert [tuple(r) for r in periodic.collapsed(docs, "n", "body").collect()] == [(1, "go now tick tock end")]


def test_empty_table(spark):
    assert periodic.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_words():
    rnd = random.Random(3)
    for size in (0, 1, 50, 4000):
        data = "".join(rnd.choice("ab" + WHITE + "é") for _ in range(size)).encode()
        text = periodic.LongText(data)
        assert text.take(slice(None)) == data.split()
