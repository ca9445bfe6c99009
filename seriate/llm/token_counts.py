"""Operator 1: token counts of a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton over the vocabulary lists all matches in a word; dynamic programming over their end positions carries the
best score and the number of pieces, never the pieces. Ties go as in the tokenizer: a later match replaces an earlier one only with a
strictly higher score, matches come by ascending start, and a character that no one-character piece covers may stand as unknown
(score: the vocabulary's least less 10). Adjacent unknown characters are one unknown, which falls back to one token a byte.

No ordinary piece holds the word mark anywhere but in front (runs of marks alone aside), so every best path passes the place before
each mark that follows another character, and words are scored each by itself. A worker keeps the counts of words it has met.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import groups_of
from .common import texts_of

#: Fixed values of the vocabulary files: the mark that stands for a space, and what an unknown costs below the least score.
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words that a worker keeps.
CACHE_ENTRIES = 250_000

_GAPS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary pieces; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(k), model.get_score(k))
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]


class CountViterbi:
    """Counts the tokens of texts under a unigram vocabulary with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.inner = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.cache: dict[str, tuple[int, int, float]] = {}

    def word(self, text: str) -> tuple[int, int, float]:
        """(tokens, tokens that are fallback bytes, best score) of a word."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        for last, (size, score) in self.automaton.iter(text):
            ends[last].append((size, score))
            if size == 1:
                single[last] = True
        best, pieces, raw, open_ = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for at in range(1, n + 1):
            found, source, fallback = None, 0, False
            for size, score in ends[at - 1]:  # longest first: ascending starts
                score += best[at - size]
                if found is None or score > found:
                    found, source = score, at - size
            if not single[at - 1]:
                score = self.unknown + best[at - 1]
                if found is None or score > found:
                    found, source, fallback = score, at - 1, True
            best[at] = found
            if fallback:
                size = len(text[at - 1].encode())
                pieces[at], raw[at], open_[at] = pieces[source] + size, raw[source] + size, True
            else:
                pieces[at], raw[at] = pieces[source] + 1, raw[source]
        return pieces[n], raw[n], best[n]

    def text(self, text: str) -> tuple[int, int, float]:
        """The same of a whole text; an empty one has no tokens."""
        if not text:
            return 0, 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        words = _GAPS.findall(marked) if not self.inner else [marked]
        cache, tokens, raw, score = self.cache, 0, 0, 0.0
        for w, times in Counter(words).items():
            got = cache.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= 64:
                    cache[w] = got
            tokens += times * got[0]
            raw += times * got[1]
            score += times * got[2]
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        return tokens, raw, score


_COUNTERS: dict[str, CountViterbi] = {}


def counter(path: str) -> CountViterbi:
    if path not in _COUNTERS:
        _COUNTERS[path] = CountViterbi(vocabulary(path))
    return _COUNTERS[path]


def token_counts(df: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens, n_byte_tokens, score) of every whole text, one row a row.

    A null or empty text has no tokens and score 0. Repeated rows give repeated results; other columns are ignored. Texts of any
    length are taken whole.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        viterbi = counter(vocabulary_file)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in groups_of(texts):
                rows = [(len(t), *viterbi.text(t)) for t in texts[a:b]]
                chars, tokens, raw, score = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()), pa.array(raw, pa.int64()), pa.array(score, pa.float64())],
                    ["id", "n_chars", "n_tokens", "n_byte_tokens", "score"],
                )

    out = texts_of(df, df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_chars long, n_tokens long, n_byte_tokens long, score double")
    return out.withColumnRenamed("id", id_col)
