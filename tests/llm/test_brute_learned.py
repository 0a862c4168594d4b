"""Operators 6 and 7 against plain versions of their methods: every document, feature and codeword in turn."""

import random
import re
import zlib
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.llm import langid, queries, toxicity


def documents(n=160):
    rnd = random.Random(61)
    plain = "the house garden river small green walks over bridge and some people talk while evening comes slowly".split()
    bad = "vile scum wretched vermin idiotic".split()
    german = "das haus garten fluss kleine grüne geht über brücke und einige leute reden während abend langsam kommt".split()
    rows, labels = [], []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        words = [rnd.choice(german if lang == "de" else plain) for _ in range(rnd.randint(5, 30))]
        toxic = rnd.random() < 0.3
        if toxic:
            words += rnd.sample(bad, 2)
        rnd.shuffle(words)
        rows.append((i, " ".join(words) if i % 37 else None, lang if i % 11 else None))
        if rnd.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = documents()
    path = str(tmp_path_factory.mktemp("learned"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def features(text):
    words = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
    return words | {w[:5] + "*" for w in words if len(w) >= 5}


def bucket(f):
    return zlib.crc32(f.encode()) % (1 << 20)


def plain_toxicity(rows, labels):
    """Scores by id: the same screen, risk and steps, one document and one feature at a time."""
    learn = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    marked = {i: t for i, _, t in labels if learn(i)}
    prior = min(0.9, max(1e-4, sum(marked.values()) / len(marked)))
    text = {i: t for i, t, _ in rows}
    sets = {i: frozenset(map(bucket, features(t))) for i, t in text.items()}
    positive = sorted({sets[i] for i, t in marked.items() if t}, key=sorted)
    unlabelled = sorted({sets[i] for i in text if learn(i)}, key=sorted)
    chosen = []
    for f in sorted(set().union(*positive, *unlabelled)):
        in_p, in_u = sum(f in d for d in positive), sum(f in d for d in unlabelled)
        expected = len(positive) * (in_u + 0.5) / (len(unlabelled) + 1)
        ratio = 2 * (in_p * log(max(in_p, 1) / expected) - (in_p - expected))
        if in_p + in_u >= 3 and ratio >= 10 and (in_p <= expected or prior * in_p / expected >= 0.6):
            chosen.append(f)
    w, bias = dict.fromkeys(chosen, 0.0), -2.0
    m, v = dict.fromkeys([*chosen, "bias"], 0.0), dict.fromkeys([*chosen, "bias"], 0.0)
    sig = lambda z: 1 / (1 + exp(-z))
    score = lambda d: bias + sum(w[f] for f in d if f in w)
    for step in range(1, toxicity.ROUNDS + 1):
        zp, zu = [score(d) for d in positive], [score(d) for d in unlabelled]
        negative = sum(log(1 + exp(z)) for z in zu) / len(zu) - prior * sum(log(1 + exp(z)) for z in zp) / len(zp)
        slope = dict.fromkeys(m, 0.0)
        for docs, zs, part in ((positive, zp, "p"), (unlabelled, zu, "u")):
            for d, z in zip(docs, zs, strict=True):
                up = (prior if part == "p" else 1) * sig(z) / len(docs)
                if negative >= 0:
                    g = up if part == "u" else -prior * (1 - sig(z)) / len(docs) - up
                else:
                    g = -up if part == "u" else up
                slope["bias"] += g
                for f in d:
                    if f in w:
                        slope[f] += g
        for f in w:
            slope[f] += toxicity.DECAY * w[f]
        for k, g in slope.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            move = toxicity.RATE * m[k] / (1 - 0.9**step) / ((v[k] / (1 - 0.999**step)) ** 0.5 + 1e-8)
            if k == "bias":
                bias -= move
            else:
                w[k] -= move
    return {i: sig(score(sets[i])) for i in text}, len(chosen)


def test_toxicity_equals_its_plain_version(spark, tables):
    path, rows, labels = tables
    want, chosen = plain_toxicity(rows, labels)
    assert chosen >= 3
    got = queries.op6_toxicity(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_slope_of_the_risk_is_that_of_differences(shift):
    """With low scores the negative part is below zero, and the slope is that which brings it back."""
    rng = np.random.default_rng(5)
    some = lambda n: tuple(np.array(x) for x in zip(*sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, n, 60), rng.integers(0, 7, 60), strict=True)}), strict=True))
    p, u = some(12), some(30)
    risk = toxicity.Risk(p, 12, u, 30, 7, 0.6)
    weights, bias = rng.normal(size=7), shift
    if shift:
        weights = np.full(7, 3.0)
        u = (np.arange(30), np.zeros(30, int))
        risk = toxicity.Risk((np.repeat(np.arange(12), 7), np.tile(np.arange(7), 12)), 12, u, 30, 7, 0.6)
    negative = risk.parts(weights, bias)[1]
    assert (negative < 0) == bool(shift)
    value = (lambda w, b: -risk.parts(w, b)[1]) if shift else (lambda w, b: sum(risk.parts(w, b)))
    slope, step = risk.slope(weights, bias), 1e-6
    for k in range(8):
        at = lambda s, k=k: value(weights + s * step * (np.arange(7) == k), bias + s * step * (k == 7))
        assert slope[k] == pytest.approx((at(1) - at(-1)) / (2 * step), abs=1e-6)


def plain_counts(text):
    data = b" " + text.encode() + b" "
    code = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
    out = np.zeros(4096)
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            value = 0
            for b in code[i : i + n]:
                value = value * 257 + b
            out[((value + ((n - 1) << 40)) * 0x9E3779B97F4A7C15) % 2**64 >> 52] += 1
    return out


def test_language_equals_a_search_of_all_codewords(spark, tables):
    path, rows, _ = tables
    learn = [(t, lang) for i, t, lang in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 5]
    model = langid.train(
        np.array([langid.vector(plain_counts(t)) for t, _ in sorted(learn, key=lambda x: (x[1], plain_counts(x[0]).astype("<u4").tobytes()))]),
        sorted(lang for _, lang in learn),
    )
    for r in queries.op7_language(spark, path).collect():
        text = rows[r.doc_id][1]
        if text is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = np.sqrt(plain_counts(text))
        x /= np.linalg.norm(x)
        losses = []
        for c, word in enumerate(model.code.tolist()):
            margins = [min(4, max(-4, float(x @ model.weights[:, b] + model.bias[b]))) for b in range(len(word))]
            losses.append(log(sum(model.trust[c][b] * exp(-bit * z) for b, (bit, z) in enumerate(zip(word, margins, strict=True)))))
        odds = [exp(-2 * (v - min(losses))) for v in losses]
        assert r.lang_pred == model.languages[losses.index(min(losses))]
        assert r.score == pytest.approx(max(odds) / sum(odds), abs=2e-3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_bits_fall_by_their_logistic_loss():
    """More steps of a bit's classifier do not raise its loss: the slope is that of the logistic loss."""
    rng = np.random.default_rng(2)
    x, y = rng.random((60, 5)).astype(np.float32), ["a", "b", "c"] * 20
    x[:, 0] += np.array([v == "a" for v in y])
    model = langid.train(x, y)
    target = model.code[[model.languages.index(v) for v in y]]
    loss = lambda w, b: np.log1p(np.exp(-target * (x @ w + b))).mean(0)
    start = loss(np.zeros_like(model.weights), np.zeros_like(model.bias))
    assert (loss(model.weights, model.bias) < start).all()


def test_toxicity_beside_clashing_names_and_nothing(spark, tables):
    path, _, _ = tables
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.col("doc_id") % 4 != 2
    clash = docs.selectExpr("*", "1.0 AS score", "2 AS toxic", "'x' AS positive", "3 AS buckets", "4 AS n", "5 AS marked")
    plain, other = (toxicity.fit(d, labels.selectExpr("*", "9 AS score", "'t' AS text"), learn) for d in (docs, clash))
    assert plain.known and plain.weights == other.weights and plain.bias == other.bias
    scored = clash.select(plain.score(F.col("text"), spark).alias("s"))
    assert scored.count() == docs.count() and clash.limit(0).select(plain.score(F.col("text"), spark)).count() == 0
    for nothing in (toxicity.fit(docs.limit(0), labels, learn), toxicity.fit(docs, labels.limit(0), learn)):
        assert not nothing.known and nothing.score_text("vile scum") == 0.0


def test_a_score_at_the_threshold_is_a_rejection():
    """The threshold is the sigmoid of a bias alone."""
    bias = log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    score = toxicity.Toxicity({}, bias + 1e-12, True).score_text("any text")
    assert score >= toxicity.THRESHOLD and toxicity.Toxicity({}, bias - 1e-9, True).score_text("") < toxicity.THRESHOLD
