"""Queries do the whole job: against brute force, where SQL can't show it or is too slow on larger tables."""

import hashlib
import random
from collections import Counter
from math import comb, exp, lgamma, log
from pathlib import Path
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from pairweave.operators import contained, contracts, digests, generation
from pairweave.operators import tests as operators
from pairweave.sources import records

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"


def mass(n, k, p):
    return exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))


def power(n, q, s, alpha=0.05):
    total = 0.0
    for d in range(1, n + 1):
        tail, critical = 0, d + 1
        while 20 * (tail + comb(d, critical - 1)) <= round(20 * alpha) * 2**d:
            critical -= 1
            tail += comb(d, critical)
        total += mass(n, d, q) * sum(mass(d, x, s) for x in range(critical, d + 1))
    return total


def test_mcnemar_power_of_any_number_of_pairs(spark):
    cases = [
        (1, 0.5, 0.5), (6, 0.9, 0.9), (60, 0.3, 0.7), (400, 0.5, 0.55), (401, 0.5, 0.55), (700, 0.45, 0.53),
        (700, 0.9, 0.1),
    ]
    df = spark.createDataFrame(cases, "n bigint, q double, s double")
    got = {
        (r.n, r.q, r.s): r.power
        for r in df.withColumn("power", operators.mcnemar_power(F.col("n"), F.col("q"), F.col("s"))).collect()
    }
    for case in cases:
        assert got[case] == pytest.approx(power(*case), abs=1e-9)


def test_mcnemar_power_takes_bounded_work(spark):
    """The power of a fixed effect in deviations hardly depends on the number of pairs, whichever counts are added up."""
    cases = [(300_000, 0.3, 0.5 + 2 / 300_000**0.5), (3_000_000_000, 0.3, 0.5 + 2 / 3_000_000_000**0.5)]
    df = spark.createDataFrame(cases, "n bigint, q double, s double")
    rows = df.select(operators.mcnemar_power(F.col("n"), F.col("q"), F.col("s")).alias("power")).collect()
    # b - c has mean 4 n q d and variance n q: the normal power at 4 (n q)^.5 d = 4 * .3^.5, to the size of a step.
    want = NormalDist().cdf(4 * 0.3**0.5 - NormalDist().inv_cdf(0.95))
    assert rows[0].power == pytest.approx(want, abs=3e-3) and rows[1].power == pytest.approx(want, abs=1e-4)


def test_x21_keeps_frames_of_over_400_pairs(spark):
    rows = entry_module.queries()["x21_mcnemar_power"](spark, LARGER).collect()
    assert sorted(r.frame for r in rows) == list(range(8))
    assert all(0 <= r.power <= 1 for r in rows)


def test_p05_explodes_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert any(len(r.text) > 200 for r in docs if r.text is not None)
    want = Counter((r.doc_id, w, r.lang) for r in docs if r.text is not None for w in r.text.split(" "))
    assert Counter(map(tuple, entry_module.queries()["p05_explode"](spark, SMALL).collect())) == want


def brute_counts(texts, items):
    out = {}
    for name, item in items:
        if item and any(item in t for t in texts if t):
            n = out.setdefault(name, [0, 0])
            n[0] += sum(t.count(item) for t in texts if t)
            n[1] += sum(item in t for t in texts if t)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_contained_counts_of_any_strings(spark, block_bytes):
    long = "a passage of well over forty characters, which departs only at its end"
    texts = [
        f"x {long}: one", f"{long}: two {long}: two", f"{long}", None, "", "aaaaa", "grün grün", "ab", "c",
        f"so {long[30:]}",
    ]
    items = [
        (1, f"{long}: one"), (2, f"{long}: two"), (3, long), (4, "aa"), (5, "ün"), (6, "bc"), (7, ""), (8, None),
        (9, "a"), (9, "c"), (10, "aa"), (10, "aa"), (None, "grün"), (11, long[30:]),
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = contained.counts(
        docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes,
    ).collect()
    assert {r.item_id: [r.n, r.documents] for r in got} == brute_counts(texts, items)
    assert len(got) == len({r.item_id for r in got})


def test_j14_counts_whole_items(spark, tmp_path):
    start = "the same forty characters begin each item, "
    items, texts = [(1, f"{start}one"), (2, f"{start}two"), (3, "short")], [
        f"{start}one", f"{start}three", "two short short",
    ]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = entry_module.queries()["j14_contained_counts"](spark, str(tmp_path)).collect()
    assert {r.item_id: [r.n, r.documents] for r in got} == brute_counts(texts, items) == {1: [1, 1], 3: [2, 1]}


def bound(x, n, alpha, upper):
    if x == (n if upper else 0):
        return float(upper)
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(mass(n, k, p) for k in (range(x + 1) if upper else range(x, n + 1)))
        low, high = (p, high) if (tail > alpha) == upper else (low, p)
    return (low + high) / 2


def test_x04_x05_count_all_line_items_and_give_both_bounds(spark):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_suppkey", "l_discount").collect()
    n, x = Counter(r.l_suppkey for r in items), Counter(r.l_suppkey for r in items if r.l_discount >= 0.095)
    got = entry_module.queries()["x04_x05_clopper_pearson"](spark, SMALL).collect()
    assert {r.supplier: (r.x, r.n) for r in got} == {s: (x[s], n[s]) for s in n}
    for r in got:
        want = (bound(r.x, r.n, 0.05, True), bound(r.x, r.n, 0.025, False), bound(r.x, r.n, 0.025, True))
        assert (r.upper_bound, r.lower, r.upper) == pytest.approx(want, abs=1e-7)


def test_x16_x17_give_intervals_of_10000_replicates(spark):
    rows = {r.drawn: r for r in entry_module.queries()["x16_x17_cluster_bootstrap"](spark, SMALL).collect()}
    assert set(rows) == {"within frames", "over all"}
    frames = entry_module.queries()["x15_x18_x19_frame_bootstrap"](spark, SMALL).collect()
    rows["frames"] = frames[0]
    assert all(r.replicates == 10_000 and -1 <= r.low <= r.middle <= r.high <= 1 for r in rows.values())


def test_h01_digests_every_file(spark):
    files = {p.name: p.read_bytes() for p in Path(SMALL).glob("*.parquet")}
    want = {name: (len(x), hashlib.sha256(x).hexdigest()) for name, x in files.items()}
    name_of = lambda rows: {r.file.rpartition("/")[2]: (r.n_bytes, r.sha256) for r in rows}
    assert name_of(entry_module.queries()["h01_file_digests"](spark, SMALL).collect()) == want
    streamed = records.file_digests(spark, [SMALL], whole_bytes=100_000)  # larger ones block by block
    assert name_of(streamed.collect()) == want and any(len(x) > 100_000 for x in files.values())


def test_reports_in_many_splits(spark, tmp_path):
    """Headers carry over the splits of a file, and stop at its end."""
    rng, want = random.Random(6), Counter()
    for f in range(3):
        lines, section = [], None
        for _ in range(3_000):
            kind = rng.random()
            if kind < 0.01:
                section = f"s{rng.randint(0, 99)}"
                lines.append(f"### {section}")
            elif kind < 0.6:
                lines.append(f"item {rng.randint(0, 9)}")
                want[(section, lines[-1])] += 1
            else:
                lines.append("nothing of interest")
        tmp_path.joinpath(f"{f}.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for rows in (1_000_000, 500):
            read = records.read_report(spark, str(tmp_path), r"^### (\w+)", r"^item \d", rows)
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
            assert Counter((r.section, r.line) for r in read.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_shards_of_any_kind(spark, tmp_path):
    rows = [(1, "click"), (2, "a new kind"), (3, "an error kind"), (4, None), (5, "click")]
    df = spark.createDataFrame(rows, "n long, shard string")
    for _ in range(2):
        records.append_shards(df, str(tmp_path), "shard")
    read = records.read_shard_folders(spark, str(tmp_path), "n long", "shard", ["error"])
    assert Counter((r.n, r.shard) for r in read.collect()) == {r: 2 for r in rows if r[0] != 3}
    assert not any("error" in f for f in read.inputFiles()) or "PartitionFilters" in read._jdf.queryExecution().toString()


@pytest.mark.parametrize("depth", [1, 2])
def test_digest_trees_find_what_differs(spark, depth):
    def of(rows):
        return spark.createDataFrame(rows, "key string, digest string")

    before = [(str(i), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3_000)]
    now = [(k, "x" if k == "17" else d) for k, d in before if k not in ("5", "999")] + [("new", "y")]
    trees = digests.tree(of(before), "key", "digest", depth), digests.tree(of(now).repartition(7), "key", "digest", depth)
    leaves = [r.node for r in digests.differing_leaves(*trees, depth).collect()]
    assert set(leaves) == {hashlib.sha256(k.encode()).hexdigest()[: 2 * depth] for k in ("17", "5", "999", "new")}
    found = digests.differences(of(before), of(now), "key", "digest", trees, depth).collect()
    assert {tuple(r) for r in found} == {("17", "changed"), ("5", "gone"), ("999", "gone"), ("new", "not recorded")}
    same = digests.tree(of(before[::-1]), "key", "digest", depth)
    assert digests.differing_leaves(trees[0], same, depth).count() == 0
    assert digests.root(trees[0]).first() == digests.root(same).first() != digests.root(trees[1]).first()
    empty = digests.tree(of([]), "key", "digest", depth)
    assert [tuple(r) for r in digests.root(empty).collect()] == [(hashlib.sha256(b"").hexdigest(),)]
    assert digests.differences(of(before[:2]), of([]), "key", "digest", (digests.tree(of(before[:2]), "key", "digest", depth), empty), depth).count() == 2


def test_f11_takes_every_item_of_its_rules(spark):
    """Notes are two components of the grid, those at the boundary one of their own; the subset has both."""
    both, every = ("fresh", "stale"), ("prog", "simple", "bound")
    rules = [
        ("core", "behavioral", 2, every, both), ("notes", "e1", 2, ("prog",), ("stale",)), ("notes-edge", "e1", 2, ("prog",), ("boundary",)),
        ("choice", "anchor", 1, every, both), ("gradient", "behavioral", 1, ("prog",), ("near", "expired_soon", "stale_long")),
    ]
    want = Counter(
        f"v2-{arm}-{part.p_brand}-{part.p_partkey}-plain-{form}-{gap}-{component}"
        for part in spark.read.parquet(f"{SMALL}/part.parquet").collect()
        for component, arm, below, forms, gaps in rules
        if part.p_partkey % 20 < below and (component != "core" or part.p_brand in ("Brand#1", "Brand#12"))
        for form in forms
        for gap in gaps
    )
    assert sum(k.endswith("-boundary-notes-edge") for k in want) == 20
    assert Counter(r.case_id for r in entry_module.queries()["f11_smoke_subset"](spark, SMALL).collect()) == want


def test_complete_grids_without_making_them(spark):
    cells = [(u, k) for u in range(5) for k in "abc" if (u, k) not in {(1, "a"), (4, "c"), (4, "b")}] + [(2, "b"), (9, "a"), (0, "z")]
    df = spark.createDataFrame(cells, "u int, k string")
    rows, columns = spark.range(6).selectExpr("CAST(id AS INT) AS u"), spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string")
    for most in (1_000, 0):
        got = {(r.key, r.detail) for r in contracts.complete_grid(df, rows, columns, ["u", "k"], most).collect()}
        assert got == {("1|a", "0"), ("4|c", "0"), ("4|b", "0"), ("5|a", "0"), ("5|b", "0"), ("5|c", "0"), ("2|b", "2")}


def test_a_grid_of_a_million_columns(spark):
    columns = spark.range(1_000_000).selectExpr("id AS k")
    rows = spark.range(3).selectExpr("id AS u")
    df = columns.crossJoin(rows).where("NOT (u = 1 AND k = 77)").select("u", "k")
    assert [tuple(r) for r in contracts.complete_grid(df, rows, columns, ["u", "k"]).collect()] == [("grid", "1|77", "0")]


@pytest.mark.parametrize("list_rows", [1024, 3])
def test_unseen_pairs_stay_where_they_are_listed(spark, list_rows):
    """Equal rows keep their number, null keys were never seen, null groups have no pairs; no pair is shuffled."""
    left = [(p, p % 3 if p % 11 else None) for p in range(40)] + [(7, 1), (None, 2)]
    right = [(s, s % 4) for s in range(60)] + [(5, 1), (5, 1), (5, 2), (None, 1), (None, 1), (9, None)]
    seen = [(p, s) for p in range(41) for s in range(61) if (p * s) % 5 == 1] + [(1, None), (None, 6), (7, 5), (7, 5)]
    pairs = generation.unseen_pairs(
        spark.createDataFrame(left, "part int, nation int"), spark.createDataFrame(right, "supplier int, nation int"), ["nation"],
        spark.createDataFrame(seen, "part int, supplier int"), ["part", "supplier"], list_rows,
    )
    want = Counter((p, n, s) for p, n in left for s, m in right if n is not None and n == m and not (None not in (p, s) and (p, s) in set(seen)))
    assert Counter((r.part, r.nation, r.supplier) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_rest") < plan.index("Join")
