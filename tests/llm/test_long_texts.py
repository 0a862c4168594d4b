"""Texts of any length are hashed chunk by chunk: the same results at any chunk, and memory that is stated."""

import random
import subprocess
import sys
from decimal import Decimal

import numpy as np
import pytest

from pairweave.llm import langid, simhash, suffix, syncmers


def some_bytes(seed, n):
    rnd = random.Random(seed)
    words = ["the", "of", "Éa", "zz", "aab", "\n", "\t ", "x" * 30, "日本"]
    out = " ".join(rnd.choice(words) for _ in range(n))
    return (out + "ab" * 300 + out[: n // 2]).encode()


@pytest.mark.parametrize("n", [0, 1, 3, 40, 500])
@pytest.mark.parametrize("chunk", [64, 301, 1000])
def test_chunks_change_nothing(n, chunk):
    for data in (some_bytes(n, n), b"q" * n, b" " * n, b""):
        assert (langid.counts(data, chunk) == langid.counts(data)).all()
        assert simhash.fingerprint(data, 3, chunk) == simhash.fingerprint(data)
        assert syncmers.sketch(data, 48, chunk) == syncmers.sketch(data)
        for a, b in zip(suffix.pieces(data, 50, 16, chunk), suffix.pieces(data, 50, 16), strict=True):
            assert np.array_equal(a, b)


MEASURE = """
import resource, sys
from pairweave.llm import langid, simhash, suffix, syncmers
rng = __import__("random").Random(1)
part = " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(20_000)).encode()
data = b" ".join([part] * (50_000_000 // len(part)))
run = {"counts": langid.counts, "fingerprint": simhash.fingerprint, "sketch": syncmers.sketch, "pieces": suffix.pieces}[sys.argv[1]]
run(data[:5_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
run(data)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("what, most", [("counts", 150), ("fingerprint", 100), ("sketch", 100), ("pieces", 200)])
def test_memory_of_a_text_of_50_mb(what, most):
    """MB beside the text itself."""
    done = subprocess.run([sys.executable, "-c", MEASURE, what], capture_output=True, text=True, check=True)
    assert int(done.stdout) < most


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(12,2)", "string"])
def test_ids_of_any_type(spark, kind):
    shared = "a passage that stands in two texts, word for word, and is well over two hundred bytes long, " * 3
    rows = [(i, shared + str(i) if i in (9, 10) else f"text number {i}") for i in (9, 10, 11, 100)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    cut = {int(Decimal(str(r.doc_id))): r.n_removed for r in suffix.digests(docs).collect()}
    assert cut[9] > 200 and cut[10] > 200 and cut[11] == cut[100] == 0
    found = {int(Decimal(str(r.doc_id))): r for r in syncmers.fingerprints(docs).collect()}
    order = sorted((r[0] for r in rows), key=str if kind == "string" else int, reverse=True)
    texts = dict(rows)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        changed = syncmers.edited_text(texts[a], texts[b]).encode()
        assert found[a].edited_fingerprint == syncmers.as_text(syncmers.sketch(changed))
