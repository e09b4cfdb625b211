"""Operator 3, token counts under a unigram model without making the tokens.

The vocabulary is that of a public tokenizer file; a piece's log probability is -ln(rank + 10),
its rank in the file (Zipf's law; nothing is trained). Texts are split at Unicode white space,
each word gets the word mark, and an Aho-Corasick automaton enumerates all pieces in a word; the
dynamic programming carries the best score and the piece count of it. Rules of the tokenizers
library's Unigram model: a later path replaces an earlier one only if its score is greater, so
the earliest start wins ties; a character without a piece of its own costs the least score less
10; runs of unknown characters are one token. Words are counted once a worker, in a bounded cache.

Defined results: null and empty texts have 0 tokens; repeated rows are each counted; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_binary import tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK, UNK_PENALTY, CACHE_WORDS, CACHE_CHARS = "▁", 10.0, 600_000, 64
#: Unicode's white space.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = re.compile(f"[^{SPACE}]+").findall
PARTS = re.compile(f"{MARK}?[^{MARK}]+|{MARK}").findall


def vocabulary(name: str = MODEL) -> list[tuple[str, float]]:
    """(piece, log probability) by id; the unknown token is id 0."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    return [(sp.id_to_piece(i), -math.log(i + 10)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """counter[word] is its number of tokens; at most CACHE_WORDS words are kept, of CACHE_CHARS characters at most."""

    def __init__(self, vocab: list[tuple[str, float]], unk_id: int = 0):
        super().__init__()
        self.auto = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            if piece:
                self.auto.add_word(piece, (len(piece), score, i == unk_id))
        self.auto.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unk = min(s for _, s in vocab) - UNK_PENALTY

    def segment(self, text: str) -> int:
        n = len(text)
        score, count, unknown, done = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), 0
        known = [False] * (n + 1)

        def single(end: int) -> None:  # the unknown character before `end`, after all pieces that end there
            if text[end - 1] not in self.single:
                s = self.unk + score[end - 1]
                if not known[end] or s > score[end]:
                    score[end], known[end], unknown[end] = s, True, True
                    count[end] = count[end - 1] + (not unknown[end - 1])

        for last, (length, piece, is_unk) in self.auto.iter(text):
            end = last + 1
            while done < end - 1:
                done += 1
                single(done)
            start = end - length
            s = piece + score[start]
            if not known[end] or s > score[end]:
                score[end], known[end], unknown[end] = s, True, is_unk
                count[end] = count[start] + (not (is_unk and unknown[start]))
        while done < n:
            done += 1
            single(done)
        return count[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = sum(map(self.segment, PARTS(word if word.startswith(MARK) else MARK + word)))
        if len(word) <= CACHE_CHARS:
            self[word] = n
        return n


_counters: dict[str, Counter] = {}


def counter(name: str = MODEL) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(vocabulary(name))
    return _counters[name]


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = counter(model).__getitem__
        for b in batches:
            words, tokens = [], []
            for text in b["text"]:
                w = WORDS(text or "")
                words.append(len(w))
                tokens.append(sum(map(get, w)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": pd.Series(words, dtype="int64"), "n_tokens": pd.Series(tokens, dtype="int64")})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_words long, n_tokens long")


def op3_viterbi_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
