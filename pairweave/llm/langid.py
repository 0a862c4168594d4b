"""7. Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; one binary classifier for each bit is fitted by logistic regression on
hashed byte n-grams (1 to 3 bytes, A-Z lower-cased, other ASCII signs as a space). Decoding adds the exponential losses
of the bits, each weighted by how well its classifier did on that language in training, and takes the nearest codeword;
a text whose two nearest codewords are almost as near is flagged.

Only the training sample is bounded: about ``SAMPLE`` documents of least hash, equally many of each language. Over
``LANGUAGES`` languages are an error: so few documents of each would be left that nothing could be learnt. Counts go to the driver as 4,096 numbers a document; the
weights go to the tasks. Every whole text is predicted, however long, without a shuffle.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learnt (an empty
table, no languages). Ties go to the first language by name. Repeated rows repeat. Only the text and the language are
read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, bytes_list

SAMPLE, LANGUAGES = 4_000, 512
#: Bytes of a text that are hashed at once: a text of any length takes 60 times as many bytes, beside itself.
CHUNK = 1 << 20
DIMENSIONS = 4096
AMBIGUOUS = 0.2
UNDETERMINED = "und"
#: A-Z to a-z; letters and bytes of other characters stay; all else is a space.
LETTER_BYTES = np.array(
    [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint64,
)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(data: bytes, chunk: int = CHUNK) -> np.ndarray:
    """Hashed counts of n-grams of 1 to 3 bytes, ``chunk`` bytes of the text at a time."""
    data, total = b" " + data + b" ", np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, len(data), chunk):
        b = LETTER_BYTES[np.frombuffer(data, np.uint8, min(chunk + 2, len(data) - at), at)]
        two = b[:-1] * np.uint64(257) + b[1:]
        three = two[:-1] * np.uint64(257) + b[2:]
        for n, code in enumerate((b, two, three)):
            slot = ((code[:chunk] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            total += np.bincount(slot.astype(np.int64), minlength=DIMENSIONS)
    return total


def vector(count: np.ndarray) -> np.ndarray:
    x = np.sqrt(count).astype(np.float32)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords: all splits of up to 5 classes, else random ones of the widest least distance among 300 draws."""
    if n <= 5:
        return np.array(
            [[1 if i == 0 else 1 - 2 * (bits >> (i - 1) & 1) for bits in range(1, 1 << (n - 1))] for i in range(n)],
            dtype=np.int8,
        ).reshape(n, -1)
    rng, width = np.random.default_rng(7), int(10 * np.ceil(np.log2(n)))

    def distance(code: np.ndarray) -> int:
        apart = (code[:, None, :] != code[None, :, :]).sum(-1)
        return int(apart[~np.eye(n, dtype=bool)].min()) if not (abs(code.sum(0)) == n).any() else -1

    return max((rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width)) for _ in range(300)), key=distance)


class CodedClassifier:
    def __init__(
        self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray,
    ):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def predict(self, x: np.ndarray) -> list[tuple[str, float, bool]]:
        """Language, score and ambiguity for each row of feature vectors."""
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0, False)] * len(x)
        margins = np.clip(x @ self.weights + self.bias, -4, 4)
        losses = np.einsum("rb,cb->rc", np.exp(-margins), self.trust * (self.code > 0)) + np.einsum(
            "rb,cb->rc", np.exp(margins), self.trust * (self.code < 0),
        )
        losses = np.log(losses)
        best = losses.argmin(1)
        odds = np.exp(-2 * (losses - losses.min(1, keepdims=True)))
        score = odds.max(1) / odds.sum(1)
        two = np.sort(losses, 1)[:, :2]
        return [
            (self.languages[b], float(s), bool(d < AMBIGUOUS))
            for b, s, d in zip(best, score, two[:, 1] - two[:, 0], strict=True)
        ]


def train(x: np.ndarray, languages: list[str]) -> CodedClassifier:
    """``x``: a feature vector a row; ``languages``: the language of each row."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    code = codewords(len(names))
    if len(names) == 1:
        return CodedClassifier(names, code, np.zeros((x.shape[1], 0)), np.zeros(0), np.ones((1, 0)))
    target = code[y].astype(np.float32)
    weights, bias = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    moment, square = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32), np.zeros(
        (x.shape[1] + 1, code.shape[1]), np.float32,
    )
    for step in range(1, 121):
        pull = -target / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30))) / len(x)
        slope = np.vstack([x.T @ pull + 1e-5 * weights, pull.sum(0)])
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.2 * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    right = ((x @ weights + bias) * target > 0).astype(float)
    trust = np.array([right[y == c].mean(0) for c in range(len(names))]) + 1e-6
    return CodedClassifier(names, code, weights, bias, trust / trust.sum(1, keepdims=True))


def count_bytes(text: str) -> Column:
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        of = lambda some: [counts(x).astype("<u4").tobytes() for x in bytes_list(some)]
        return by_slices(texts, pa.binary(), lambda some: pa.array(of(some), pa.binary()))

    return run(text)


def fit(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE,
    languages: int = LANGUAGES,
) -> CodedClassifier | None:
    """Train on the rows where ``learn`` holds and text and language are given; None if there are none."""
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"),
    )
    sizes = {
        r["lang"]: r["n"]
        for r in rows.groupBy("lang").agg(
            F.count("*").alias("n")
        ).limit(languages + 1).collect()
    }
    if len(sizes) > languages:
        raise ValueError(f"over {languages} languages to learn: raise languages and sample")
    if not sizes:
        return None
    each = sample / len(sizes)
    chance = F.xxhash64("text", F.lit(7)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, each / n))])[F.col("lang")]
    # Copies share their hash, so the limit is what bounds the sample.
    picked = rows.where(chance < share).orderBy(chance).limit(2 * sample).select(
        "lang", count_bytes("text").alias("counts"),
    ).toArrow()
    picked = sorted(zip(picked.column(0).to_pylist(), picked.column(1).to_pylist(), strict=True))
    if not picked:
        picked = sorted(
            (r["lang"], bytes(r["counts"]))
            for r in rows.where(F.col("lang").isin(list(sizes))).limit(sample).select(
                "lang", count_bytes("text").alias("counts"),
            ).collect()
        )
    return train(np.array([vector(np.frombuffer(c, dtype="<u4")) for _, c in picked]), [v for v, _ in picked])


def predictor(model: CodedClassifier | None, spark):
    """Column function: text to struct(lang, score, ambiguous)."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        model, found = shared.value, []
        for at in range(0, len(texts), 256):
            block = texts.slice(at, 256).to_pylist()
            lettered = [i for i, x in enumerate(block) if model is not None and x and has_letter(x)]
            rows = [{"lang": UNDETERMINED, "score": 0.0, "ambiguous": True} for _ in block]
            if lettered:
                x = np.array([vector(counts(block[i].encode())) for i in lettered])
                for i, (name, score, ambiguous) in zip(lettered, model.predict(x), strict=True):
                    rows[i] = {"lang": name, "score": score, "ambiguous": ambiguous}
            found += rows
        return pa.array(found, kind)

    return run
