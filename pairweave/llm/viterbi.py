"""8. Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's matches of a word; dynamic programming over ends carries the best
score and the number of pieces, no back-pointers. Ties go to the match that begins first, as in the public unigram
tokenizer; an unknown character scores the least score minus 10 and falls back to its bytes. Texts are split before
each word mark, as that tokenizer does, so a word's count depends on the word alone and is remembered.

Null and empty texts count 0. Repeated rows repeat; an empty table gives an empty result. Texts of any length are counted
whole: the work is linear in them, and what is held is a word's. Only the id is carried, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, text_list

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED_WORDS = 300_000
REMEMBERED_LENGTH = 64


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class CountViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.byte_fallback = byte_fallback
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.known = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.words = Memo(self.count_word, REMEMBERED_WORDS)

    def count_word(self, word: str) -> int:
        n = len(word)
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        if self.known >= set(word):  # no fall-back: each end's matches come with the earliest start first
            for end, (length, score) in self.automaton.iter(word):
                score += best[end + 1 - length]
                if score > best[end + 1]:
                    best[end + 1], count[end + 1] = score, count[end + 1 - length] + 1
            return count[n]
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):
            at[end + 1].append(match)
        loose = [False] * (n + 1)
        for end in range(1, n + 1):
            for length, score in at[end]:
                score += best[end - length]
                if score > best[end]:
                    best[end], count[end] = score, count[end - length] + 1
            if word[end - 1] not in self.known and best[end - 1] + self.unknown > best[end]:
                best[end], loose[end] = best[end - 1] + self.unknown, True
                count[end] = count[end - 1] + (
                    len(word[end - 1].encode()) if self.byte_fallback else not loose[end - 1]
                )
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = [MARK + w for w in marked.removeprefix(MARK).split(MARK)]
        if max(map(len, words)) > REMEMBERED_LENGTH:
            return sum([self.words[w] if len(w) <= REMEMBERED_LENGTH else self.count_word(w) for w in words])
        return sum(map(self.words.__getitem__, words))


_MADE: dict[str, CountViterbi] = {}


def token_counts(
    df: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_tokens of each row. The vocabulary (a few hundred kilobytes) is broadcast."""
    data = pickle.dumps((vocabulary, byte_fallback))
    shared, key = df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = CountViterbi(*pickle.loads(shared.value))
        one = _MADE[key].count
        return pa.array([one(x) for x in text_list(texts)], pa.int64())

    return df.select(F.col(doc_id).alias("doc_id"), count(F.col(text)).alias("n_tokens"))
