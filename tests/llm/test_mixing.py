"""Operator 13 against its SQL on odd tables, and what systematic sampling promises."""

import random
from collections import Counter

import pytest
from oracle import connection, differences

from pairweave.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, target string, _key int, copies int"


def table(spark, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA).coalesce(1)
    docs.write.parquet(f"{tmp_path}/t")
    next(tmp_path.joinpath("t").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(13)
    sources = ["a", "b", "B", "é", "\U0001f642", "", None, "hot"]
    out = []
    for i in range(900):
        source = "hot" if rnd.random() < 0.4 else rnd.choice(sources)
        out.append((i, "w " * min(4000, int(rnd.paretovariate(0.9))), source))
    return [*out, (None, None, "nulls"), (None, "x", None), (5, " \t\n", "blank"), (5, "", "blank"), *[(7, "same words", "twins")] * 9]


def test_mix_equals_sql(spark, rows, tmp_path):
    table(spark, rows, tmp_path)
    assert not differences(queries.op13_source_mix(spark, str(tmp_path)), connection(str(tmp_path)), mixing.sql())


@pytest.mark.parametrize("share, most", [(0.5, 2), (1.5, 2), (1.99, 2), (3, 4), (2, 2), (5, 2)])
def test_targets_are_met(spark, rows, tmp_path, share, most):
    docs = table(spark, rows, tmp_path)
    found = mixing.mix(docs, share=share, most=most, carry=True).selectExpr("*", "doc.source AS source").collect()
    assert len(found) == len(rows)
    sizes, by_source = Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        by_source.setdefault(r.source, []).append(r)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    # The targets again, by taking the limit from one source at a time.
    limited, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in limited]
        rest = share * total - most * sum(sizes[s] for s in limited)
        target = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if target[s] >= most * sizes[s]]
        if not above:
            break
        limited.add(above[0])
    target |= {s: most * sizes[s] for s in limited}
    for s, own in by_source.items():
        assert own[0].source_size == sizes[s]
        assert own[0].target == pytest.approx(target[s], rel=1e-9, abs=1e-6)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= most for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own) + 1e-3


def test_mixed_repeats_whole_rows(spark, rows, tmp_path):
    docs = table(spark, rows, tmp_path)
    copies = Counter()
    for r in mixing.mix(docs, carry=True).collect():
        copies[tuple(r.doc)] += r.copies
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(map(tuple, mixed.collect())) == +copies


def test_parallelism_changes_nothing(spark, rows, tmp_path):
    docs = table(spark, rows, tmp_path)
    once, again = (Counter(map(tuple, mixing.mix(x).collect())) for x in (docs, docs.repartition(7)))
    assert once == again


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
