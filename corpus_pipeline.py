"""A training corpus from documents, in five stages: each takes the rows that the one before it kept.

1. toxicity: documents that the positive-unlabelled classifier rejects go.
2. near_dedup: one document (the least id) of each SimHash class stays.
3. suffix_dedup: bytes of repeated 200-byte strings go; documents stay, with the rest of their text and its n_chars.
4. decontamination: documents that hold a window of the benchmark go.
5. encode: the digests of the byte-level BPE ids of what is left.

Null and empty texts are scored like any text without words; they share a fingerprint, so one of them stays; they lose no
bytes, hold no window, and have no tokens. Repeated rows are copies of each other: the first of a class by id stays, and of
rows that tie in id one, by its text. Texts of any length are taken whole. An empty table gives an empty one, and without
labels no document is rejected. Further columns are carried up to the last stage; working columns take names that are free.
"""

from __future__ import annotations

import public_tokenizers
from pairweave.llm import bpe, decontam, simhash, suffix, toxicity
from pairweave.llm.common import fresh, split_remainder, table
from pairweave.llm.queries import BPE_RANKS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), split_remainder("doc_id", 4) != 2)
    score = fresh(docs, "score")
    return docs.withColumn(score, model.score(F.col("text"), spark)).where(
        F.col(score) < toxicity.THRESHOLD
    ).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix.with_kept_text(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
    ("decontamination", decontaminate), ("encode", encode),
]

#: Training, tree search and merges by rank are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
