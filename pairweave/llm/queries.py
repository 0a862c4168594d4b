"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, langid, mixing, packing, periodic, simhash, suffix, syncmers, toxicity, urls, viterbi
from .common import split_remainder, table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_LEVEL = "byte_bpe_50k.json"
UNIGRAM_MODEL = "piece_bpe_32k.model"
PACK_WIDTH = 2048
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op2_token_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(BPE_RANKS), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    packs = packing.pack_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, PACK_WIDTH)
    digest = {
        f"{name}_sha256": F.sha2(column, 256)
        for name, column in (("ids", "input_ids"), ("positions", "position_ids"))
    }
    return packs.select(
        "pack_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", *[x.alias(name) for name, x in digest.items()],
    )


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op4_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), split_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), model.score(F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), split_remainder("doc_id", 5) == 0
    model = langid.fit(docs, ~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predictor(model, spark)("text").alias("found"))
    return found.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.col("found.ambiguous").alias("ambiguous"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = viterbi.unigram_vocabulary(public_tokenizers.path(UNIGRAM_MODEL))
    return viterbi.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op9_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"), periodic.repeated_tail)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(UNIGRAM_MODEL),
        public_tokenizers.PATTERN,
    )


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_token_packs, op3_syncmer_fingerprints, op4_benchmark_matches, op5_url_verdicts, op6_toxicity,
        op7_language, op8_token_counts, op9_simhash_classes, op10_suffix_dedup, op11_periodic_runs, op12_token_alignment, op13_source_mix,
    )
}

#: Words and windows in SQL: A-Z lower-cased, every other sign below 0x80 but digits and a-z separates.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op13_source_mix": mixing.sql(),
    "op5_url_verdicts": urls.sql(URL_RULES),
    "op4_benchmark_matches": f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w
  FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, text FROM benchmark)),
win AS (SELECT item, item_id, i AS place, w[i:i + least(len(w), 10) - 1] AS g
        FROM (SELECT item, item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
gram AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT gram.doc_id, gram.i, gram.n, win.item, win.item_id, win.place FROM gram JOIN win ON gram.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit)
  GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id),
chain AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - place ORDER BY i) AS island FROM hit),
runs AS (SELECT doc_id, item_id, min(i) - 1 AS begins, min(place) - 1 AS place, count(*) + any_value(n) - 1 AS n
  FROM chain GROUP BY doc_id, item, item_id, i - place, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY n DESC, begins, item_id IS NULL, item_id, place) AS r FROM runs) WHERE r = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated, CAST(coalesce(b.n, 0) AS BIGINT) AS longest,
       CAST(b.begins AS BIGINT) AS longest_at, b.item_id AS longest_item, CAST(b.place AS BIGINT) AS longest_place
FROM doc d LEFT JOIN pos p ON d.doc_id = p.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id LEFT
  JOIN best b ON d.doc_id = b.doc_id""",
}
