"""Label rules, tails, samples, sources, streams and attempts on small cases, each with its expected value."""

import json
import os
import random
import unicodedata
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from oracle import connection, differences
from pairweave.functions import patterns, stats, text, tools
from pairweave.operators import attempts, contracts, generation, pairs, sampling
from pairweave.operators import tests as operators
from pairweave.sources import records
from pairweave.streaming import resume

TOPIC = "address|place|home"


def labels(spark, arm, cases, token="Marlow"):
    """The labels of (text, form) cases."""
    df = spark.createDataFrame([(i, t, form) for i, (t, form) in enumerate(cases)], "i int, t string, form string")
    df = df.select("i", "form", text.norm(F.col("t")).alias("t"), F.lit(token).alias("tok"))
    found = df.select(
        "i", text.case_label(F.lit(arm), F.col("t"), F.array("tok"), F.lit(TOPIC), F.col("form")).alias("label"),
    )
    return [r.label for r in found.orderBy("i").collect()]


BEHAVIOURAL = [
    ("The parcel goes to Marlow House tomorrow.", "PROCEED"),
    ("The parcel goes to Marlow House, assuming you're still there.", "PROCEED-WITH-CAVEAT"),
    ("The parcel goes to Marlow House. Please confirm the address.", "PROCEED-WITH-CAVEAT"),
    ("Are you still at Marlow House?", "HEDGE"),
    ("You mentioned Marlow House, which may be outdated. Could you confirm the place?", "HEDGE"),
    ("What is your home address?", "HEDGE"),
    ("Let me know your place first.", "HEDGE"),
    ("I have on file an old address. It was long ago. Please verify it.", "HEDGE"),
    ("Dear sir, it goes to 14 Long Street.", "CONFAB-COMMIT"),
    ("Deliver it to [your address here].", "TEMPLATE"),
    ("Deliver it to XXXX, your place.", "TEMPLATE"),
    ("Deliver it to [something].", "RESIDUAL"),
    ("All done.", "RESIDUAL"),
    ("Confirm the booking. Send a driver to the place.", "RESIDUAL"),
    ("Could the driver pick me up at Marlow House?", "PROCEED"),
    ("Marlowe's is elsewhere.", "RESIDUAL"),
    ("", "RESIDUAL"),
]


def test_behavioural_labels(spark):
    for arm in ("behavioral", "e2", "l2e2"):
        assert labels(spark, arm, [(t, "prog") for t, _ in BEHAVIOURAL]) == [want for _, want in BEHAVIOURAL]


NOTES = [
    ("Nothing of it.", "prog", "WITNESS-DROPPED"),
    ("Currently at Marlow House.", "prog", "MANUFACTURE"),
    ("They are staying at Marlow House.", "prog", "MANUFACTURE"),
    ("They have been staying at Marlow House.", "perf_prog", "MANUFACTURE"),
    ("They are staying at Marlow House (Dec 2025).", "prog", "PRESERVED"),
    ("They live at Marlow House.", "prog", "COERCED-STATIVE"),
    ("They live at Marlow House.", "simple", "PRESERVED"),
    ("Marlow House for a time.", "bound", "BOUND-DROPPED"),
    ("They are staying at Marlow House until May.", "bound", "PRESERVED"),
    ("They live at Marlow House until May.", "bound", "COERCED-STATIVE"),
    ("Currently at Marlow House.", "perf_sim", "EXTRACTED-AS-CURRENT"),
    ("They are living at Marlow House.", "perf_sim", "EXTRACTED-AS-CURRENT"),
    ("They used to live at Marlow House.", "perf_sim", "PRESERVED"),
    ("They live at Marlow House.", "perf_sim", "EXTRACTED-AS-CURRENT"),
    ("Home: Marlow House", "perf_sim", "RESIDUAL"),
    ("Currently elsewhere.\rMarlow House: home", "simple", "PRESERVED"),
]


def test_note_labels(spark):
    for arm in ("e1", "l2"):
        assert labels(spark, arm, [(t, form) for t, form, _ in NOTES]) == [want for _, _, want in NOTES]


def test_explicit_and_choice_labels(spark):
    explicit = [
        ("Yes, it is.", "YES"), ("**No.** It changed.", "NO"), ("  - no", "NO"), ("Not at all", "UNPARSED"),
        ("It depends: yes", "UNPARSED"), ("", "UNPARSED"),
    ]
    assert labels(spark, "explicit", [(t, "prog") for t, _ in explicit]) == [want for _, want in explicit]
    anchors = [
        ("ACTION: SEND", "SEND"), ("x\naction: Check First", "CHECK-FIRST"), ("**Action : **send**", "SEND"),
        ("ACTION:CHECKFIRST", "CHECK-FIRST"), ("ACTION: SEND, so ACTION: SEND", "SEND"),
        ("ACTION: SEND or ACTION: CHECK-FIRST", "UNPARSED"), ("I would send it", "UNPARSED"),
        ("ACTION - SEND", "UNPARSED"),
    ]
    assert labels(spark, "anchor", [(t, "prog") for t, _ in anchors]) == [want for _, want in anchors]


def test_an_unknown_arm_is_an_error(spark):
    for arm in ("other", None):
        with pytest.raises(Exception, match="unknown arm"):
            labels(spark, arm, [("x", "prog")])


def test_tokens_are_folded(spark):
    rows = [
        ("Škoda is here", "Škoda", True), ("Skoda", "Škoda", True), ("ŠKODA!", "škoda", True),
        ("Škodas", "Škoda", False), ("l’été", "l'été", True), ("a.b", "a.b", True), ("axb", "a.b", False),
        ("Ångström 5", "Ångström", True),
    ]
    df = spark.createDataFrame(rows, "t string, tok string, want boolean").select(
        text.norm(F.col("t")).alias("t"), "tok", "want",
    )
    assert all(
        r.got == r.want
        for r in df.select("want", text.has_token(F.col("t"), F.col("tok")).alias("got")).collect()
    )
    odd = "½ ﬁ Å … ﻿é² ǆ Ⅳ ｱ 漢 각 ß"
    assert spark.createDataFrame([(odd,)], "t string").select(text.norm(F.col("t"))).first()[0] == "".join(
        c
        for c in unicodedata.normalize("NFKD", odd) if not unicodedata.combining(c)
    )


def test_marker_fates(spark):
    rows = [
        ("At Marlow for now.", "T", "MARKER-KEPT-SAME"), ("At Marlow at the moment.", "T", "MARKER-KEPT-CROSS"),
        ("At Marlow at the moment.", "C", "MARKER-KEPT-SAME"), ("They are working at Marlow.", "T", "PROG-CONVERTED"),
        ("They work at Marlow (Jan 2026).", "T", "DATE-ONLY"), ("They work at Marlow.", "C", "DROPPED"),
        ("Marlow", "C", "RESIDUAL"), ("x", "C", "WITNESS-DROPPED"),
    ]
    df = spark.createDataFrame(rows, "t string, m string, want string")
    assert all(
        r[0] == r[1]
        for r in df.select("want", text.marker_label(F.col("t"), F.lit("Marlow"), F.col("m"))).collect()
    )


def test_text_functions(spark):
    one = spark.range(1)
    of = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert [
        of(text.percent(lit(t)))
        for t in ("I am 85% sure", "about 1.5", "100", "101", "", "3 or 4")
    ] == [85, None, 100, None, None, 3]
    assert [of(text.choice(lit(t))) for t in ("I commit", "ABSTAIN", "commit, abstain", "commitment")] == [
        "COMMIT", "ABSTAIN", "MIXED", "UNPARSED",
    ]
    assert of(text.residue(lit("a<k>b<k>"), lit("<k>"))) == ("a", "b<k>") and of(
        text.residue(lit("a"), lit("x"))
    ) is None
    assert of(text.between(lit("x <a> one </a> <a>2</a>"), "<a>", "</a>")) == "one" and of(
        text.between(lit("x"), "<a>", "</a>")
    ) is None
    assert of(text.speaker_turns(lit("User: one\ntwo\nBot: no\nUser: three"), "User")) == ["one\ntwo", "three"]
    assert of(text.first_line_with(lit("a\nF: b\nF: c"), "F: ")) == "b"
    assert of(text.clean_line(lit("> * - **a** __b__  "))) == "a b"
    assert of(
        text.replace_tokens(lit("the cat, The end; other"), F.array(lit("the")), lit("$1\\"))
    ) == "$1\\ cat, $1\\ end; other"
    assert of(text.bold_tokens(lit("the the"), F.array(lit("the")))) == "**the** **the**"
    assert of(text.drop_units(lit("One the. Two. La three!"), F.array(lit("the"), lit("la")))) == "Two."
    assert of(text.case_tokens(lit("vehicle"), lit("a red  kite"), lit("red"))) == ["red", "kite"] and of(
        text.case_tokens(lit("place"), lit("a b"), lit("a"))
    ) == ["a"]
    assert of(text.writer_label(lit("She is currently walking"))) == "PRESERVED" and of(
        text.writer_label(lit("She walks"))
    ) == "FLATTENED"
    flags = lambda x: tuple(of(text.stored_flags(lit(x))))
    assert flags("They are working there for now, until May") == (True, True, True, True)
    assert flags("They have worked there for about three months") == (False, True, False, False)
    assert flags("He's now moving; as of 2024") == (True, False, False, True)
    edit = lambda x, frame, to: of(text.verb_edit(lit(x), lit(frame), to, patterns.VERB_EDITS))
    assert edit("She Is Staying at the inn, is staying at it", "lodging", "FLAT") == "She lives at the inn, is staying at it"
    assert edit("He works at a bank", "workplace", "PROG") == "He is working at a bank"
    assert edit("He reworks at night", "workplace", "PROG") is None and edit("He works at a bank", "lodging", "PROG") is None
    assert edit("She is driving an old van", "vehicle", "FLAT") == "She drives an old van"
    found = of(text.field_records(lit("- **Said:** a\n> fact: b\nnone\nsaid: c\nFORM: d")))
    twice = of(text.field_records(lit("fact: a\nfact: b\nsaid: c\nsaid: d\nfact: e\nfact: f")))
    assert twice == [{"fact": "b"}, {"said": "c"}, {"said": "d", "fact": "f"}]
    assert found == [{"said": "a", "fact": "b"}, {"said": "c", "form": "d"}] and of(text.field_records(lit(""))) == []
    persons = [("The user lives", "I live")]
    assert of(
        text.control_record(lit("As of 2026-01-06, The user lives here."), lit("now"), persons)
    ) == 'said: "I live here."\nfact: The user lives here\nform: simple present\nobserved: now'
    assert "only through 2026-03-01" in of(
        text.control_record(lit("The user lives here. This was true only through 2026-03-01."), lit("now"), persons)
    )
    assert of(text.control_record(lit("Nobody lives here."), lit("now"), persons)) is None
    assert of(text.redated(lit("on 2026-01-06"), [("2026-01-06", "2025-07-06")], "2026-01")) == "on 2025-07-06"
    assert of(text.redated(lit("on 2026-01-07"), [("2026-01-06", "2025-07-06")], "2026-01")) is None
    assert of(text.occurrences(lit("aaa"), lit("aa"))) == 1 and of(text.occurrences(lit("aaa"), lit(""))) == 0
    assert sorted(of(text.perturbed(lit("it's Ann"), F.array(lit("Ann")))).values()) == sorted(
        ["Sure thing! it's Ann", "it’s Ann", "it's Ann\n\nHope that helps!", "it's **Ann**"]
    )
    assert set(patterns.DESTROYED) == {"MANUFACTURE", "COERCED-STATIVE", "BOUND-DROPPED"}


def test_tool_calls(spark):
    call = lambda name, arguments: [(name, arguments)]
    cases = [
        (None, None, "no_tool_call"), ([], None, "no_tool_call"), (
            call("run", "{}") * 2, None, "multiple_tool_calls",
        ), (call("run", "{"), None, "malformed_arguments"), (call("run", None), None, "malformed_arguments"),
        (call("run", "[1]"), None, "arguments_not_object"), (call("run", '"x"'), None, "arguments_not_object"), (call("run", '{"a": "ANN"}'), "EXECUTE", None), (call("run", '{"a": {"b": "Ann"}}'), None, "execute_missing_or_invented_value"),
        (
            call("run", '{"a": "Bob", "n": 3}'), None, "execute_missing_or_invented_value",
        ), (call("ask", '{"field": "home"}'), "VERIFY", None), (call("ask", '{"field": "car"}'), None, "verify_wrong_field"), (call("ask", '{"field": 3}'), None, "verify_wrong_field"),
        (call("ask", "{}"), None, "verify_wrong_field"), (call("other", "{}"), None, "unexpected_tool"),
    ]
    df = spark.createDataFrame(
        [(i, c) for i, (c, _, _) in enumerate(cases)], "i int, c array<struct<name:string,arguments:string>>",
    )
    score = lambda wanted: tools.first_call(
        F.col("c"), F.lit("run"), F.lit("ask"), F.lit(wanted), F.lit("home"),
    )
    got = [(r.s.score, r.s.parse_error) for r in df.orderBy("i").select(score("Ann").alias("s")).collect()]
    assert got == [(s or "UNPARSED", e) for _, s, e in cases]
    assert df.where("i = 7").select(score("").alias("s")).first().s.parse_error == "item_missing_scoring_fields"


def test_tails_equal_exact_sums(spark):
    cases = [
        (n, b)
        for n in (1, 2, 5, 40, 128, 600, 2000)
        for b in sorted({0, 1, n // 3, n // 2, n // 2 + 1, n - 1, n})
    ]
    df = spark.createDataFrame([*cases, (0, 0), (None, 1), (5, None), (5, 6), (5, -1)], "n long, b long")
    n, b = F.col("n"), F.col("b")
    rows = {
        (r.n, r.b): r
        for r in df.select(
            "n", "b", stats.upper_tail(b, n).alias("u"), stats.lower_tail(b, n).alias("l"),
            stats.two_sided(b, n).alias("t"), stats.log_choose(n, b).alias("c"),
        ).collect()
    }
    for n, b in cases:
        upper, lower = (Fraction(sum(comb(n, k) for k in ks), 2**n) for ks in (range(b, n + 1), range(b + 1)))
        r = rows[n, b]
        assert r.u == pytest.approx(float(upper), rel=1e-10) and r.l == pytest.approx(float(lower), rel=1e-10)
        assert r.t == pytest.approx(min(1.0, 2 * float(min(upper, lower))), rel=1e-10)
        assert r.c == pytest.approx(float(__import__("math").log(comb(n, b))), abs=1e-9)
    assert (
        rows[0, 0].u, rows[0, 0].l, rows[0, 0].t,
    ) == (1, 1, 1) and rows[None, 1].u is None and rows[5, None].l is None
    assert rows[5, 6].u == 0 and rows[5, 6].l == 1 and rows[5, -1].u == 1 and rows[5, -1].l == 0


def test_published_p_values_and_large_counts(spark):
    df = spark.createDataFrame(
        [(104, 104), (79, 79), (61, 61), (36, 42), (3_000_000_000, 3_000_000_000), (1_500_030_000, 3_000_000_000)],
        "b long, n long",
    )
    got = [r[0] for r in df.select(stats.upper_tail(F.col("b"), F.col("n"))).collect()]
    assert [f"{p:.3e}" for p in got[:4]] == ["4.930e-32", "1.654e-24", "4.337e-19", "1.414e-06"]
    assert got[4] == 0 and got[5] == pytest.approx(0.136665, abs=1e-4)
    ends = spark.createDataFrame([(0, 584), (584, 584), (0, 0), (5, 100)], "x long, n long").select(
        stats.clopper_pearson_upper(F.col("x"), F.col("n")).alias("u"),
        stats.clopper_pearson_lower(F.col("x"), F.col("n")).alias("l"),
    ).collect()
    assert round(ends[0].u, 4) == 0.0051 and ends[0].l == 0 and ends[1].u == 1 and (ends[2].u, ends[2].l) == (1, 0)
    assert ends[3].u == pytest.approx(0.10225, abs=1e-4) and ends[3].l == pytest.approx(0.019913, abs=1e-4)


def test_power_of_a_thousand_pairs(spark):
    df = spark.createDataFrame([(200, 0.603), (400, 0.871), (1000, 0.9985)], "n long, want double")
    for r in df.select("want", operators.mcnemar_power(F.col("n"), F.lit(0.5), F.lit(0.6)).alias("p")).collect():
        assert r.p == pytest.approx(r.want, abs=2e-3)


def test_tiers_take_what_earlier_ones_left(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "id int, s string")
    both = F.col("id") >= 0
    got = sampling.tiered(df, [("A", both, 3, ["s"]), ("B", both, 3, ["s"])], "salt", "id").collect()
    assert len(got) == len({r.id for r in got}) == 6 and [sum(r.tier == t for r in got) for t in "AB"] == [3, 3]
    assert {r.s for r in got if r.tier == "A"} == {"x", "y"}
    every = sampling.tiered(df, [("A", F.col("id") < 4, None, ["s"]), ("B", both, 20, ["s"])], "salt", "id").collect()
    assert sorted(r.id for r in every if r.tier == "A") == [0, 1, 2, 3] and len(every) == 10
    shown, key = sampling.blind_views(df, "salt", "id", ["s"])
    assert shown.columns == ["gid", "s"] and key.columns == ["gid", "id"] and shown.join(key, "gid").count() == 10


def test_kappa_with_excluded_classes(spark):
    rows = [("a", "a")] * 4 + [("a", "b"), ("b", "b"), ("c", "a"), (None, "a")]
    r = operators.binary_kappa(spark.createDataFrame(rows, "x string, y string"), "x", "y", ("a", "b")).first()
    expected = (5 * 4 + 1 * 2) / 36
    assert (r.n, r.agree, r.excluded) == (6, 5, 2) and r.kappa == pytest.approx((5 / 6 - expected) / (1 - expected))


def test_final_attempts(spark):
    logged = spark.createDataFrame(
        [
            ("a", 1, 10), ("a", 2, 11), ("a", 2, 12), ("a", 3, 13), ("a", 3, 14), ("a", 4, 15), ("a", 4, 16),
            ("a", 9, 17), ("a", 6, 18),
        ],
        "c string, i int, t int",
    )
    wanted = spark.createDataFrame([("a", i) for i in range(1, 7)], "c string, i int")
    named = spark.createDataFrame([("a", 2, 12), ("a", 3, 99), ("a", 6, 18), ("a", 8, 1)], "c string, i int, t int")
    got = {r.i: (r.t, r.status) for r in attempts.final_attempts(logged, wanted, named, ["c", "i"], "t").collect()}
    assert got == {
        1: (10, "single"), 2: (12, "resolved"), 3: (None, "resolution of no recorded attempt"), 4: (None, "unresolved"),
        5: (None, "missing"), 6: (None, "unused resolution"), 8: (None, "unused resolution"), 9: (None, "unknown item"),
    }
    gate = attempts.unbound(
        spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, d string"),
        spark.createDataFrame([(1, "x"), (2, "z"), (4, "w")], "k int, d string"), "k", "d",
    )
    assert {r.k: r.problem for r in gate.collect()} == {2: "changed", 3: "gone", 4: "not recorded"}
    assert attempts.with_gate(wanted, gate.where("k = 0")).count() == 6
    with pytest.raises(Exception, match="problems: 3"):
        attempts.with_gate(wanted, gate).collect()


def test_errors_of_lookups_and_subsets(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="unknown key"):
        pairs.strict_lookup(a, b, "k").collect()
    grid = spark.createDataFrame(
        [("core", 4, "prog", "f", "test", "id")],
        "component string, cluster int, form string, frame string, split string, case_id string",
    )
    with pytest.raises(Exception, match="stay in dev"):
        generation.subset(grid, [("core", 9, (), ())]).collect()
    assert generation.subset(grid, [("core", 4, (), ())]).count() == 0


def test_contracts_on_small_tables(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string"), spark.createDataFrame(
        [(1, "x"), (3, None)], "k int, v string",
    )
    got = {json.loads(r.key)["k"]: int(r.detail) for r in contracts.same_rows(a, b).collect()}
    assert got == {1: 1, 2: 1, 3: -1}
    assert contracts.fingerprint(a).first() == contracts.fingerprint(
        a.orderBy(F.desc("k"))
    ).first() != contracts.fingerprint(b).first()
    assert [
        (r.key, r.detail)
        for r in contracts.unique_folded(
            spark.createDataFrame([("Ab",), ("aB",), ("c",), (None,)], "v string"), "v",
        ).collect()
    ] == [("ab", "2")]


def test_strict_sources(spark, tmp_path):
    schema = "a int, b string"
    (tmp_path / "good.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "é\\n"}\n')
    assert [
        tuple(r)
        for r in records.read_jsonl(spark, f"{tmp_path}/good.jsonl", schema, strict=True).orderBy("a").collect()
    ] == [(1, "x"), (2, "é\n")]
    for name, body in (("bad", '{"a": 1}\n{"a": \n'), ("list", "[1]\n"), ("number", "3\n")):
        (tmp_path / f"{name}.jsonl").write_text(body)
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
            records.read_jsonl(spark, f"{tmp_path}/{name}.jsonl", schema, strict=True).collect()
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(ValueError, match="no records"):
        records.read_jsonl(spark, f"{tmp_path}/empty.jsonl", schema, strict=True)
    (tmp_path / "one.json").write_text('{\n "a": 5,\n "b": "y"\n}')
    assert tuple(records.read_object(spark, f"{tmp_path}/one.json", schema).first()) == (5, "y")
    (tmp_path / "items.js").write_text('window.ITEMS = [{"a": 1, "b": "x"},\n {"a": 2}];\n')
    assert {
        tuple(r)
        for r in records.read_assigned_array(spark, f"{tmp_path}/items.js", schema).collect()
    } == {(1, "x"), (2, None)}
    (tmp_path / "report.txt").write_text("p=9\n### One\np=1\nx\np=2\n### Two\np=3\n")
    assert [
        (r.section, r.line)
        for r in records.read_report(spark, f"{tmp_path}/report.txt", r"^### (\w+)", r"^p=\d").orderBy("n").collect()
    ] == [(None, "p=9"), ("One", "p=1"), ("One", "p=2"), ("Two", "p=3")]


def test_sinks_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    for name in ("one", "two.rep2"):
        records.write_jsonl(df, f"{tmp_path}/{name}.jsonl")
    with pytest.raises(Exception, match="already exists"):
        records.write_jsonl(df, f"{tmp_path}/one.jsonl")
    records.write_jsonl(df, f"{tmp_path}/one.jsonl", "append")
    got = records.read_shards(spark, f"{tmp_path}/*.jsonl", "a int, b string", leave_out=["rep2"], depth=1)
    assert sorted((r.shard, r.a, r.b or "") for r in got.collect()) == [("one", 1, "é")] * 2 + [("one", 2, "")] * 2
    nested = spark.createDataFrame([(({"b": 1, "a": 2}), (3, "x"))], "m map<string,int>, s struct<z:int,y:string>")
    assert nested.select(records.canonical_json(nested)).first()[0] == '{"m":{"a":2,"b":1},"s":{"y":"x","z":3}}'
    import hashlib

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc" * 1000)
    assert [tuple(r) for r in records.file_digests(spark, [f"{tmp_path}/f"]).collect()] == [
        ("f/x.bin", 3000, hashlib.sha256(b"abc" * 1000).hexdigest())
    ]


def test_streams_of_attempts(spark, tmp_path):
    """A log that grows by files: first attempts and windowed tallies, one batch after the other."""
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    row = lambda key, at: json.dumps({"key": key, "at": f"2026-01-01T{at}:00"}) + "\n"
    (log / "1.json").write_text(row("a", "10:00") + row("a", "10:05") + row("b", "10:15"))
    (log / "2.json").write_text(row("b", "10:20") + row("c", "12:00"))
    (log / "3.json").write_text(row("d", "09:00") + row("e", "14:00"))
    for i in (1, 2, 3):  # files come in the order of their times
        os.utime(log / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))

    def run(df, name):
        stream = df.writeStream.format("parquet").option(
            "checkpointLocation", f"{out}/check-{name}",
        ).trigger(availableNow=True).start(f"{out}/{name}")
        stream.awaitTermination(120)
        return spark.read.parquet(f"{out}/{name}")

    stream = resume.stream_log(spark, str(log), "key string, at timestamp", files_per_batch=1)
    assert sorted(r.key for r in run(resume.first_attempts(stream, "key", "at"), "first").collect()) in (
        ["a", "b", "c", "e"], ["a", "b", "c", "d", "e"],
    )
    tally = run(resume.windowed_tally(stream, "at", ["key"]), "tally").collect()
    got = {(r.key, r.window.start.hour, r.window.start.minute): r["count"] for r in tally}
    assert got[("a", 10, 0)] == 2 and got[("b", 10, 10)] == 1 and ("d", 9, 0) not in got
    done = spark.createDataFrame([("a",), ("z",)], "key string")
    left = resume.still_to_do(spark.createDataFrame([("a",), ("b",)], "key string"), done, ["key"])
    assert [r.key for r in left.collect()] == ["b"]


def test_configuration_problems(spark):
    rows = [
        ("a", "m", "p", ("a", None)), ("a", "x", "p", ("a", "other model or provider")),
        ("q", "m", "p", (None, "unknown configuration")), (None, "m", "p", ("a", None)),
        (None, "n", "p", (None, "not identified")), (None, "z", "p", (None, "not identified")),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, c string, m string, p string")
    known = {"a": ("m", "p"), "b": ("n", "p"), "c": ("n", "p")}
    got = df.orderBy("i").select(tools.configuration([F.col("c")], F.col("m"), F.col("p"), known).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [r[3] for r in rows]
    messages, named = tools.with_defaults(
        F.lit(None).cast("array<struct<role:string,content:string>>"), F.lit(None).cast("array<string>"), F.lit("hi"),
        F.lit("x"), F.lit("y"),
    )
    assert spark.range(1).select(messages, named).first()[:] == ([("user", "hi")], ["x", "y"])


def test_marker_fates_have_the_words_of_their_sql(spark, tmp_path):
    """A letter beyond ASCII ends a word there; the rule itself has Unicode words."""
    texts = ["Er ßteach hier\nund dort.", "Er ist Ørtuses da, ßtakes.", "Sie uses dem.", "Nein, oнlives oder livesо in 20٣٤.", "Es ist so for nowß."]
    rows = [(3 * i, turn, "user", t) for i, t in enumerate(texts * 5) for turn in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    df = entry_module.queries()["t12_marker_fates"](spark, str(tmp_path))
    assert not differences(df, connection(tmp_path), entry_module.oracle_sql()["t12_marker_fates"])
    label = text.marker_label(F.lit("At Marlow he ßteach."), F.lit("Marlow"), F.lit("T"))
    assert spark.range(1).select(label).first()[0] == "RESIDUAL"


def test_records_of_long_notes_are_read_once(spark):
    rnd = random.Random(2)
    pairs = [(rnd.choice(["said", "fact", "form", "observed"]), str(i)) for i in range(400)]
    want = []
    for k, v in pairs:
        if k == "said" or not want:
            want.append({})
        want[-1][k] = v
    note = "\n".join(f"- {k}: {v}" for k, v in pairs)
    df = spark.createDataFrame([(note,), (None,), ("none",)], "note string").select(text.field_records(F.col("note")).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
    assert [r.r for r in df.collect()] == [want, [], []]
