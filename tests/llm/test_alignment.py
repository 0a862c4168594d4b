"""Operator 12 against the public tokenizers and a merge of ends, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairweave.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, piece int, row string"


def tokens(texts):
    byte_level, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    byte_level.encode_special_tokens = True
    signs = alignment.byte_of_sign()
    for text in texts:
        a, b = byte_level.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        a_bytes = [bytes(map(signs.__getitem__, byte_level.id_to_token(i))) for i in a]
        b_bytes = [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        whole = (" " + text).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            yield [], [], [], []
        else:
            yield a, b, np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()


def expected(rows):
    parsed, counts = [], Counter()
    for (doc_id, _), (a, b, a_ends, b_ends) in zip(rows, tokens([t or "" for _, t in rows]), strict=True):
        links, groups, i, j, ga, gb = [], [], 0, 0, [], []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = a_ends[i], b_ends[j]
            if x <= y:
                ga.append(str(a[i]))
                i += 1
            if y <= x:
                gb.append(str(b[j]))
                j += 1
            if x == y:
                groups.append(f"{','.join(ga)}|{','.join(gb)}")
                ga, gb = [], []
        counts.update(links)
        parsed.append((doc_id, len(a), len(b), links, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    for doc_id, n_a, n_b, links, groups in parsed:
        text = ";".join(groups)
        yield (
            doc_id, n_a, n_b, len(links), len(groups), sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text,
        )


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    signs = ["the", " ", "  ", "\n", "\t", "tion", "é", "ß", "日本", "語", "🙂", "́", "1234", "'ll", "...", "x" * 30, "\x00", "ب", "ไทย", " ", "　"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(rnd.choice(["alpha", "beta", "of", "walking,", "Über"]) for _ in range(400)) for _ in range(4)]
    texts += ["", None, " ", "   ", "\n", "a▁b", "▁", "<|endoftext|> <s></s> <unk> <0x0A>", "z" * 3000, "-" * 500, "﻿x", "ﬁ Ⅷ ½"]
    return [*enumerate(texts), (None, "null id"), (3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize("options", [{}, {"piece_ends": 7, "hot_pairs": 50}, {"piece_ends": 100, "hot_pairs": 1}])
def test_alignment_equals_a_merge(spark, rows, options):
    docs = spark.createDataFrame([(*r, 1, "r") for r in rows], SCHEMA).repartition(3)
    got = alignment.aligned(docs, A, B, P.PATTERN, with_groups=True, **options)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_query_on_a_table(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "r") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_links", "n_groups", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((x[:-1] for x in expected(rows)), key=str)


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A, B, P.PATTERN).count() == 0


def test_diagonals_part_the_merge_evenly():
    rnd = random.Random(1)
    for _ in range(300):
        sides = [sorted(rnd.sample(range(1, 60), rnd.randint(1, 40))) for _ in range(2)]
        last = max(sides[0][-1], sides[1][-1])
        a, b = (np.array(x if x[-1] == last else [*x, last]) for x in sides)
        every = rnd.randint(1, 9)
        i, j = alignment.diagonals(a, b, every)
        merged = sorted([*a.tolist(), *b.tolist()])
        for d, x, y in zip(range(every, len(merged), every), i.tolist(), j.tolist(), strict=True):
            assert x + y - d in (0, 1)
            assert sorted([*a[:x].tolist(), *b[:y].tolist()]) == merged[: x + y]
            assert x + y == len(merged) or merged[x + y] > merged[x + y - 1]
