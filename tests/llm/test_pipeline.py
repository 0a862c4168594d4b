"""The pipeline as a whole against brute force, stage by stage, and on odd tables."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pairweave.llm import bpe, toxicity
from pairweave.llm.common import split_remainder
from test_exact import RANKS, brute_classes, brute_matches, prose, sha

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _k string, kept string, digest string"


def documents():
    rng = random.Random(31)
    passage, item = prose(41, 70), prose(42, 30)
    texts = [prose(i, rng.randint(5, 90)) for i in range(60)]
    texts += [f"{prose(200 + i, 30)} {passage} {prose(300 + i, 20)}" for i in range(4)]
    texts += [f"{prose(400 + i, 25)} {item} {prose(500 + i, 25)}" for i in range(3)]
    texts += [f"{prose(600 + i, 30)} vilebad {prose(700 + i, 30)} nastyword" for i in range(50)]
    texts += [texts[3], texts[3], texts[7].replace(" ", "  "), "", None, "é" * 700, "short"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    toxic = {i for i, n in enumerate(order) if 67 <= n < 117}
    return [(i, texts[n]) for i, n in enumerate(order)], toxic, [(1, item), (2, "never there at all"), (3, None)]


def saved(spark, folder, docs, labels, items):
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, "k", "x", "d") for i, t in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def run_stages(spark, folder):
    """Each stage's rows, written and read again as the next one's documents."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        out.append(docs)
    return out


def brute_kept_text(rows, length=200):
    """What suffix deduplication leaves: removed runs are narrowed to whole characters."""
    data = [(t or "").encode() for _, t in rows]
    times = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for (i, t), x in zip(rows, data):
        gone = bytearray(len(x))
        for j in range(len(x) - length + 1):
            if times[x[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        at, left = 0, []
        for c in t or "":
            n = len(c.encode())
            left += [] if all(gone[at : at + n]) else [c]
            at += n
        out.append((i, None if t is None else "".join(left)))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, toxic, items = documents()
    labels = [(i, 1, int(i in toxic)) for i, _ in docs if i % 3]
    saved(spark, tmp_path, docs, labels, items)
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    stages = run_stages(spark, tmp_path)
    assert [s.columns for s in stages[:4]] == [columns] * 4

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), split_remainder("doc_id", 4) != 2)
    kept = [(i, t) for i, t in docs if model.score_text(t or "") < toxicity.THRESHOLD]
    assert {i for i, _ in docs} - {i for i, _ in kept} == toxic
    rows = lambda df: Counter(map(tuple, df.select("doc_id", "text").collect()))
    assert rows(stages[0]) == Counter(kept)

    classes = {c for _, _, c in brute_classes(kept)}
    kept = [(i, t) for i, t in kept if i in classes]
    assert rows(stages[1]) == Counter(kept)

    kept = brute_kept_text(kept)
    assert rows(stages[2]) == Counter(kept)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages[2].collect())

    kept = [(i, t) for i, t in kept if not brute_matches(t, items)[4]]
    assert rows(stages[3]) == Counter(kept) and len(kept) < len(rows(stages[2]))

    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(open(RANKS, "rb").read()), special_tokens={},
    )
    ids = [(i, t or "", library.encode_ordinary(t or "")) for i, t in kept]
    want = Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t)) for i, t, x in ids)
    assert Counter(map(tuple, stages[4].collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize(
    "docs",
    [
        [], [(None, None)],
        [
            (1, "same id"), (1, "another text"), (1, "same id"), (None, "x y z"), (None, "x y z"), (None, None),
            (2, ""), (2, None),
        ],
    ],
)
def test_pipeline_on_odd_tables(spark, tmp_path, docs):
    """Empty tables, null ids and texts, repeated ids and rows: no stage fails, and no text is lost but for its copies."""
    saved(spark, tmp_path, docs, [(1, 1, 0), (None, 0, None)], [(1, "no such words as these here")])
    *stages, last = run_stages(spark, tmp_path)
    texts = {t or "" for _, t in docs}
    for stage in stages:
        found = [r.text or "" for r in stage.collect()]
        assert set(found) == texts
    assert last.count() == stages[-1].count() and last.columns[:4] == [
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256",
    ]
