"""Each exact operator against brute force, over small tables with edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pairweave.llm import bpe, decontam, packing, simhash, suffix, syncmers, viterbi
from pyspark.sql import functions as F

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, fp long, k string, kept string, spans int"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, "x", "y", 3) for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(
        "".join(
            rng.choice(["th", "er", "on", "é", "ß", "an", "stre", "ló"])
            for _ in range(rng.randint(1, 4))
        ) + rng.choice(["", "", ".", ",\n"])
        for _ in range(n)
    )


@pytest.fixture(scope="module")
def texts():
    passage, copied = prose(1, 90), prose(2, 60)
    near = copied.split(" ")
    near[30] = "changed"
    odd = [
        "", None, " ", "a", "Ab aB", "don't  stop\t\n x", "漢字 ½²  \x1c y", "é" * 500, "ab" * 400, "z" * 3000,
        "word " * 900, "\x00\x01 ok", "😀" * 40,
    ]
    docs = [
        *odd, copied, copied, " ".join(near), passage,
        *(prose(i, 50) + " " + passage[10:420] + " " + prose(i + 99, 40) for i in range(10, 16)),
        *(prose(i, 30 * i) for i in range(20, 28)),
    ]
    return [
        *((3 * i + 1, t) for i, t in enumerate(docs)), (4, "same id, other text"), (1, ""), (None, copied),
        (None, None), (None, "no id"),
    ]


def test_bpe_equals_the_library(spark, texts):
    ranks = bpe.parse_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(t or "")] += 1
    assert Counter(map(tuple, bpe.digests(frame(spark, texts), RANKS, P.PATTERN).collect())) == want
    out = bpe.encode_decode(frame(spark, texts).withColumn("ids", F.lit(1)), RANKS, P.PATTERN)
    assert out.columns[-2:] == ["_ids", "decoded"]


def test_empty_tables_and_very_long_texts(spark):
    vocabulary = viterbi.unigram_vocabulary(P.path("piece_bpe_32k.model"))
    none = frame(spark, [])
    assert bpe.digests(none, RANKS, P.PATTERN).count() == viterbi.token_counts(none, vocabulary).count() == 0
    long = "the rest of it, and on. " * 40_000
    ranks = bpe.parse_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.digests(frame(spark, [(1, long)]), RANKS, P.PATTERN).first()
    assert (got.n_tokens, got.decoded_sha256) == (len(library.encode_ordinary(long)), sha(long))
    once, whole = (viterbi.token_counts(frame(spark, [(1, t)]), vocabulary).first().n_tokens for t in (long[:24].strip(), long.strip()))
    assert whole == 40_000 * once


def test_bpe_on_random_pieces():
    own = bpe.BytePairs(bpe.parse_ranks(open(RANKS, "rb").read()), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "abcdeé ñßü'stllre  \n\t0123½²!?.漢字😀́\x1c\x85​　\xa0"
    for _ in range(4000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode_ordinary(s)
        assert own.decode(own.encode(s)) == s.encode()
    for s in ("a" * 20_000, " " * 20_000, "the" * 9_000):
        assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode_ordinary(s)


def segments_of(rows, capacity):
    """(id, start, ids) of every segment of packs, whose layout is checked on the way."""
    out = Counter()
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(positions) == capacity
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= capacity
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            out[d, start, ids[a:b].tobytes()] += 1
            assert positions[a:b].tolist() == list(range(b - a)) and b > a
        assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
    assert len({r.pack_id for r in rows}) == len(rows)
    return out


def brute_segments(rows, capacity):
    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(open(RANKS, "rb").read()), special_tokens={},
    )
    out = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.update((i, a, np.array(ids[a : a + capacity], "<u4").tobytes()) for a in range(0, len(ids), capacity))
    return out


def test_packs_lose_nothing(spark, texts, tmp_path):
    """Null, empty, repeated ids and rows, and texts longer than many packs."""
    with open(RANKS, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = [*texts, texts[20], (77, "the end " * 20_000)]
    packs = packing.pack_texts(frame(spark, rows).repartition(3), ranks, P.PATTERN, capacity=64, buffer_tokens=2000)
    assert segments_of(packs.collect(), 64) == brute_segments(rows, 64)
    packing.write_packs(packs, f"{tmp_path}/packs")
    back = spark.read.parquet(f"{tmp_path}/packs").orderBy("pack_id").collect()
    assert segments_of(back, 64) == brute_segments(rows, 64)
    first = packs.orderBy("pack_id").collect()
    ids, positions = packing.matrix([r.input_ids for r in back]), packing.matrix([r.position_ids for r in back], "<i4")
    assert ids.shape == positions.shape == (len(back), 64)
    assert ids.tobytes() == b"".join(bytes(r.input_ids) for r in first) and (positions.max(1) < 64).all()
    with pytest.raises(Exception, match="already exists"):
        packing.write_packs(packs, f"{tmp_path}/packs")
    assert packing.pack_texts(frame(spark, []), ranks, P.PATTERN).count() == 0
    assert packing.matrix([]).size == 0


def test_packs_of_given_ids(spark):
    rows = [
        (1, np.arange(150, dtype="<u4").tobytes()), (None, np.arange(7, dtype="<u4").tobytes()), (1, None), (2, b""),
    ]
    packs = packing.pack(spark.createDataFrame(rows, "doc_id int, ids binary"), capacity=64, pad=0).collect()
    want = Counter({(1, a, np.arange(a, min(150, a + 64), dtype="<u4").tobytes()): 1 for a in (0, 64, 128)})
    want[None, 0, np.arange(7, dtype="<u4").tobytes()] = 1
    assert segments_of(packs, 64) == want


def test_endless_words_have_the_library_s_ids():
    encode = packing._library(open(RANKS, "rb").read(), P.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(open(RANKS, "rb").read()), special_tokens={},
    )
    for s in ("ab" * 6000, "x " + "ba" * 5000 + " 12 é", "short"):
        assert list(encode(s)) == library.encode_ordinary(s)


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [j for j in range(len(free)) if free[j] >= lengths[i]]
            if fits:
                least = min(free[j] for j in fits)
                free[max((j for j in fits if free[j] == least), key=lambda j: want[j][-1])] -= 0
                want_fill = least
            else:
                want_fill = capacity
                free.append(capacity)
                want.append([])
                j = len(free) - 1
            if fits:
                j = next(j for j in fits if free[j] == least)
            free[j] -= lengths[i]
            want[j].append(i)
            assert want_fill >= lengths[i]
        packs = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for p in packs for i in p) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in p) for p in packs) == sorted(capacity - f for f in free)


M = 0xD6E8FEB86659FD93


def brute_mix(h):
    for _ in range(2):
        h = (h ^ h >> 32) * M % 2**64
    return h ^ h >> 32


def brute_sketch(data, size=48, k=16, s=8):
    """The anchors of all closed syncmers by the definition: k-mers whose least s-mer hash stands first or last."""
    inner = [brute_mix(int.from_bytes(data[i : i + s], "little")) for i in range(len(data) - s + 1)]
    chosen = {}
    for i in range(len(data) - k + 1):
        mine = inner[i : i + k - s + 1]
        if min(mine) in (mine[0], mine[-1]):
            anchor = brute_mix(inner[i] ^ (inner[i + s] << 1) % 2**64) >> 32
            chosen.setdefault(anchor, i)
    if not chosen and data:
        chosen = {xxhash.xxh64_intdigest(data) >> 32: 0}
    return dict(sorted(chosen.items())[:size])


def brute_likeness(a, b, size=48):
    if not a or not b:
        return float(not a and not b)
    end = min(max(x) if len(x) >= size else 2**32 for x in (a, b))
    a, b = ({h: p for h, p in x.items() if h <= end} for x in (a, b))
    shifts = [p - b[h] for h, p in a.items() if h in b]
    return 2 * max((shifts.count(x) for x in shifts), default=0) / (len(a) + len(b))


def test_syncmers(spark, texts):
    rows = syncmers.fingerprints(frame(spark, texts), parts=3).collect()
    order = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    written_out = lambda x: ".".join(f"{h:08x}@{p:x}" for h, p in sorted(x.items(), key=lambda a: a[1]))
    want, near = Counter(), {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, other, following = (brute_sketch(x.encode()) for x in (t, changed, after))
        want[
            i, len(t), sha(changed), written_out(own), written_out(other), brute_likeness(own, other),
            brute_likeness(own, following),
        ] += 1
        near[i, t] = brute_likeness(own, other), brute_likeness(own, following)
    assert Counter(map(tuple, rows)) == want
    long = [v for (i, t), v in near.items() if len(t) > 300 and len(set(t)) > 5]
    assert np.mean([a for a, _ in long]) > 0.5
    assert dict(syncmers.from_text(rows[0].fingerprint)) is not None
    one = syncmers.fingerprints(frame(spark, [(5, "a single row of text that is long enough")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert syncmers.fingerprints(frame(spark, [])).count() == 0


def test_syncmers_of_text_ids(spark, texts):
    rows = [(f"é{i}" if i % 5 else f"{i}", t or "") for i, t in texts if i not in (None, 1, 4)]
    got = {
        r.doc_id: r.edited_sha256
        for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id string, text string"), parts=4).collect()
    }
    order = sorted(rows, reverse=True)
    assert got == {
        i: sha(t[: len(t) - len(t) // 3] + after[: len(t) // 3])
        for (i, t), (_, after) in zip(order, order[1:] + order[:1])
    }


def test_syncmers_are_context_free():
    body = prose(3, 60).encode()
    h, at = syncmers.anchors(body)
    h2, at2 = syncmers.anchors(b"other start " + body + b" other end")
    assert set(zip(h.tolist(), (at + 12).tolist())) <= set(zip(h2.tolist(), at2.tolist()))


def brute_matches(doc, items, window=10):
    number = lambda t: decontam.words_of((t or "").encode())
    words, hit, names, best = number(doc), set(), set(), (0,)
    for name, t in dict.fromkeys(items):
        w = number(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            g = w[at : at + window]
            for i in range(len(words) - len(g) + 1):
                if words[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    names |= {str(name)} - {"None"}
                    n = next(
                        (n for n in range(len(g), len(w) - at) if words[i + n : i + n + 1] != [w[at + n]]), len(w) - at,
                    )
                    best = min(best, (-n, i, name is None, "" if name is None else str(name), at))
    longest = (-best[0], best[1], best[3] if not best[2] else None, best[4]) if hit else (0, None, None, None)
    return len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit), *longest


def items_of(texts):
    passage = next(t for i, t in texts if i == 1 + 3 * 16)
    return [
        (10, passage[30:300]), (9, passage[30:300].upper()), (2, "Ab ab"), (3, ""), (4, None), (None, "don't stop x"),
        (7, prose(77, 30)), (8, "word word word"), (11, "word " * 25), (12, "ab cd " + passage[40:260] + " xyz"),
        (12, passage[100:390]),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_decontamination(spark, texts, block_bytes):
    items = items_of(texts)
    benchmark = spark.createDataFrame(
        [(i, t, 5) for i, t in [*items, items[0]]], "item_id long, text string, n_words int",
    )
    docs = frame(spark, texts).withColumn("digest", F.lit(1))
    got = decontam.digests(docs, benchmark, block_bytes=block_bytes).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_matches(t, items)) for i, t in texts)
    left = decontam.without_contaminated(docs, benchmark, block_bytes=block_bytes)
    assert left.columns == docs.columns
    assert left.count() == sum(not brute_matches(t, items)[4] for _, t in texts)
    assert decontam.digests(frame(spark, texts), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.digests(frame(spark, []), benchmark, block_bytes=block_bytes).count() == 0


def test_matches_on_few_words():
    """Texts and items of few different words: every suffix has many neighbours."""
    rng = random.Random(12)
    draw = lambda n: " ".join(rng.choice("ab" if rng.random() < 0.9 else "abcz") for _ in range(n))
    for trial in range(60):
        items = [(str(i), draw(rng.randint(1, 14))) for i in range(rng.randint(1, 4))] + (
            [(None, draw(6))] if trial % 3 == 0 else []
        )
        texts = [draw(rng.randint(0, 30)) for _ in range(4)]
        found = decontam.search(
            [t.encode() for t in texts], decontam.TestSuffixes([(i, t.encode()) for i, t in items], 4),
        )
        for text, (n, spans, names, *longest) in zip(texts, found):
            assert (
                n, sum(b - a for a, b in spans), len(names), sha(",".join(names)), bool(spans), *longest,
            ) == brute_matches(text, items, 4)


def test_a_large_benchmark_stays_small_in_memory():
    """A block of 4 MB: arrays of some 50 bytes a word, and the numbers of its distinct words."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40_000)]
    items = [(str(i), " ".join(words[j] for j in rng.integers(0, len(words), 200)).encode()) for i in range(3000)]
    assert sum(len(t) for _, t in items) > 3_500_000
    tests = decontam.TestSuffixes(items)
    arrays = (tests.words, tests.starts, tests.places, tests.lengths, tests.left, tests.low, tests.high)
    assert sum(a.nbytes for a in arrays) < 130 * len(tests.words)


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = viterbi.unigram_vocabulary(P.path("piece_bpe_32k.model"))
    for fallback in (True, False):
        library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
        assert Counter(map(tuple, viterbi.token_counts(frame(spark, texts), vocabulary, fallback).collect())) == want


def test_token_counts_on_ties():
    from tokenizers import Tokenizer, models

    rng = random.Random(6)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(12)} | {"▁"}
        vocabulary = [("<unk>", 0.0), *((p, -float(rng.randint(1, 4))) for p in sorted(pieces))]
        library, own = Tokenizer(
            models.Unigram(vocabulary, unk_id=0, byte_fallback=False)
        ), viterbi.CountViterbi(vocabulary, False)
        for _ in range(10):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert own.count_word(word) == len(library.encode(word, add_special_tokens=False).ids), (vocabulary, word)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, fingerprint=brute_fingerprint, radius=2):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {c: min((i for (i, _), x in zip(rows, label) if x == c and i is not None), default=None) for c in label}
    return Counter((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, label))


def test_simhash_classes(spark, texts):
    assert Counter(map(tuple, simhash.digests(frame(spark, texts)).collect())) == brute_classes(texts)
    assert simhash.digests(frame(spark, [])).count() == 0
    assert fingerprints_agree([t for _, t in texts])


def fingerprints_agree(texts):
    return all(simhash.fingerprint((t or "").encode()) == brute_fingerprint(t) for t in texts)


def test_near_links_over_many_shards(spark):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = set(centres)
    for c in centres[:12]:
        for _ in range(60):
            c ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(c)
    values |= {rng.getrandbits(64) for _ in range(1500)} | {
        centres[0] ^ (1 << i) ^ (1 << j)
        for i in range(20)
        for j in range(i)
    }
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.local_links(fps, 2, shard=100)).collect()}
    points = np.array(values, dtype=np.uint64)
    forest = simhash.Forest(len(points))
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2)
        forest.join(np.full(len(near), i), near)
    roots = forest.roots(np.arange(len(points)))
    want = {}
    for i, r in enumerate(roots.tolist()):
        want.setdefault(r, []).append(signed[i])
    assert got == {v: min(group) for group in want.values() if len(group) > 1 for v in group}
    tree = simhash.VantageTree(points, len(points), 2, 50)
    assert tree.leaves > 5
    rows, leaf, home = tree.deal(points)
    assert sorted(rows[home].tolist()) == list(range(len(points)))


def test_an_unsplit_leaf_is_dealt_into_parts(spark):
    """Points of one dense ball, which no vantage point parts, and a hub that all of a class link to."""
    centre = 0x0123456789ABCDEF
    values = sorted(
        {
            centre, *(centre ^ (1 << i) for i in range(64)),
            *(centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)),
        }
    )
    points = np.array(values, dtype=np.uint64)
    tree = simhash.VantageTree(points, len(points), 2, 20)
    rows, leaf, home = tree.deal(points)
    assert sorted(rows[home].tolist()) == list(range(len(points))) and np.bincount(leaf[home]).max() < 60
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.components(
        simhash.local_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, shard=20)
    ).collect()
    assert {r.node: r.root for r in got} == dict.fromkeys(signed, min(signed))


def test_copies_of_a_fingerprint():
    """A point is sent to few shards at the number of shards that is used for millions of points."""
    points = np.random.default_rng(1).integers(0, 2**64, 1 << 18, dtype=np.uint64)
    tree = simhash.VantageTree(points[: 1 << 14], len(points), 2, len(points) // simhash.SHARDS)
    rows, _, home = tree.deal(points)
    assert home.sum() == len(points) and len(rows) < 4 * len(points)


def test_one_of_each(spark, texts):
    """One row of each class, with its least id; classes that share their least id, where ids repeat, keep one each."""
    unique = [(i, t) for i, t in {i: t for i, t in texts if i is not None}.items()]
    for rows in (
        texts, unique,
        [(1, "one text"), (1, "and another text"), (1, "one text"), (None, "a third"), (None, "a third")],
    ):
        out = simhash.one_of_each(frame(spark, rows))
        assert out.columns == frame(spark, rows).columns
        kept = out.select("doc_id", "text").collect()
        fps = [brute_fingerprint(t) for _, t in rows]
        groups = []
        for f in set(fps):
            near = [g for g in groups if any((f ^ x).bit_count() <= 2 for x in g)]
            groups = [g for g in groups if g not in near] + [set().union({f}, *near)]
        want = Counter(
            min((i for (i, _), f in zip(rows, fps) if f in g and i is not None), default=None)
            for g in groups
        )
        assert Counter(r.doc_id for r in kept) == want
        assert len(
            {next(k for k, g in enumerate(groups) if brute_fingerprint(r.text) in g) for r in kept}
        ) == len(groups)


def brute_removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    times = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = Counter()
    for (i, _), x in zip(rows, data):
        gone = bytearray(len(x))
        for j in range(len(x) - length + 1):
            if times[x[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        runs = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(x)))
        out[i, len(x), sum(gone), runs, sha(bytes(b for b, g in zip(x, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("length, gram, hot_bytes, shard_bytes", [(200, 64, None, 1 << 21), (40, 12, 300, 3000)])
def test_suffix_dedup(spark, texts, length, gram, hot_bytes, shard_bytes):
    for rows in (texts, [(i, t) for i, t in {i: t for i, t in texts if i is not None}.items()]):
        got = suffix.digests(
            frame(spark, rows), length=length, gram=gram, hot_bytes=hot_bytes, shard_bytes=shard_bytes,
        ).collect()
        assert Counter(map(tuple, got)) == brute_removed(rows, length)
    assert suffix.digests(frame(spark, [])).count() == 0


def test_hot_anchors_are_split(spark):
    """One passage in many texts whose surroundings differ: every piece is another one, and some windows occur once."""
    passage = prose(5, 12)[:55]
    rows = [
        (i, prose(1000 + i % 37, 6)[: 20 + i % 11] + passage + prose(2000 + i % 41, 6)[: 15 + i % 13])
        for i in range(120)
    ]
    for hot_bytes in (1, 400, 5000):
        got = suffix.digests(frame(spark, rows), length=40, gram=12, hot_bytes=hot_bytes, shard_bytes=5000).collect()
        assert Counter(map(tuple, got)) == brute_removed(rows, 40)


def test_halves_hold_every_window():
    body = prose(7, 40).encode()[:100]
    at = int(suffix.grams(body[:40], 12)[1].argmin())
    windows = [i for i in range(61) if int(suffix.grams(body[i : i + 40], 12)[1].argmin()) == at - i]
    body = body[windows[0] : windows[-1] + 40]
    parts, todo = [], [(0, 28, 0, body)]
    while todo:
        low, high, first, part = todo.pop()
        for a, b, start, count, core in suffix.halves(part, low, high, 40, 12):
            own = part[start : start + count + 39]
            assert all(core in own[i : i + 40] for i in range(count)) and len(core) == 40 - (b - a)
            (parts if a == b else todo).append((a, b, first + start, own))
    assert sorted(first for _, _, first, _ in parts) == list(range(len(windows))) and all(
        len(own) == 40
        for *_, own in parts
    )


@pytest.mark.parametrize("unit", ["z", "ab", "abcdefg", "0123456789012345678"])
def test_periodic_text_takes_few_rows(unit):
    found = suffix.pieces((unit * (1_000_000 // len(unit))).encode())
    assert len(found[0]) < 50_000 and (found[1] * found[4]).sum() == 1_000_000 // len(unit) * len(unit) - 199


def test_periodic_texts_against_brute_force(spark):
    runs = [
        "z" * 900, "z" * 201, "z" * 200, "ab" * 300, "b" + "ab" * 150, "xyz" * 300 + prose(4, 30),
        prose(4, 30) + "xyz" * 120, "ab" * 99 + "a", "zz" + prose(9, 60) + "z" * 230,
    ]
    rows = list(enumerate(runs))
    for length, gram, hot_bytes in ((200, 64, None), (40, 12, 200)):
        got = suffix.digests(frame(spark, rows), length=length, gram=gram, hot_bytes=hot_bytes).collect()
        assert Counter(map(tuple, got)) == brute_removed(rows, length)
    alone = suffix.digests(frame(spark, [(1, "z" * 200), (2, "q" * 1_000_000), (3, "ab" * 500_000)])).collect()
    assert {r.doc_id: r.n_removed for r in alone} == {1: 0, 2: 1_000_000, 3: 1_000_000}


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 5, 300])) for _ in range(rng.randint(0, 70))]
        assert suffix.suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_kept_text_stays_text(spark, texts):
    out = suffix.with_kept_text(frame(spark, texts), length=40, gram=12)
    assert out.columns == frame(spark, texts).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in texts)
    assert "�" not in "".join(r.text or "" for r in out.collect())
    assert sum(r.text is None for r in out.collect()) == sum(t is None for _, t in texts)


@pytest.mark.parametrize("pattern", [r"\w+|\W", r"[a-z]{1,3}|[^a-z]+", r"\s*\S+|\s+"])
def test_other_patterns_split_as_they_say(pattern):
    with open(RANKS, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    own = bpe.BytePairs(ranks, pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in (prose(5, 200), "", "Straße 12, the end...\n\n x\tyz", " a  b "):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_decontamination_beside_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", 9, "x", "y"), (2, None, 8, "x", "y")], "doc_id long, text string, matches int, digest string, m string")
    bench = spark.createDataFrame([("a", "Two, three", 1)], "item_id string, text string, matches int")
    for size in (1 << 20, 1):
        found, name = decontam.matches(docs, bench.union(spark.createDataFrame([("b", "none of it", 2)], bench.schema)), block_bytes=size)
        assert found.columns == [*docs.columns, name] and name not in docs.columns
        assert {r.doc_id: r[name]["n_words"] for r in found.collect()} == {1: 3, 2: 0}
    assert decontam.digests(docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontam.digests(docs, bench.limit(0)).collect()] == [False, False]
