"""Operator 8, secrets, by patterns and by the guess cost of values in credential context.

Base kinds: assign (a credential word, a sign of assignment, a value of 6+ characters), access
(AKIA and upper-case letters or digits, 20+), hex (24+). The method: a value's guess cost is the
least sum, over all its segmentations, of the decimal logarithms of the guesses for words (by rank
among frequent passwords and the whole words of a public vocabulary), dates, repeats (units of up
to UNITS characters), keyboard walks and brute-force spans, whatever their lengths. It is taken of the assigned values (the
least is reported, and how many are weak: under GUESSES), and of values in wider credential context (the base words and others,
any symbols in the value, "=>", "Bearer x"), which become spans of kind guess if the cost is at
least GUESSES, two kinds of characters occur and no base span or earlier span overlaps. A value
that is itself a credential word with a sign of assignment is searched in turn.

All of it is linear in the text: a run of characters without white space is costed once, from its end,
for every value that starts in it, and spans are held against base spans by bisection.

Defined results: null text is empty and has no span; texts and values of any length are searched whole; repeated rows are each searched; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_binary import tokenizer_path

GUESSES = 10.0
#: The public vocabulary whose whole words are the dictionary; the longest unit of a repeat.
WORDS, UNITS = "word_bpe_49k.json", 8
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Up to the value, of which at least six characters follow.
WIDER = re.compile(
    r"(?:(?:password|passwd|secret|token|api_?key|(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|pin|credentials?|auth|authorization|login|private_?key|access_?key|client_?key|signing_?key|key))"
    r"[\"']?[\x20\t]*(?:=>|[:=])[\x20\t]*(?:bearer\x20+|basic\x20+)?|(?<![A-Za-z0-9])bearer\x20+)[\"']?(?=[!-&(-~]{6})",
    re.I | re.A,
)
RUN = re.compile(r"[!-&(-~]+")
#: Frequent passwords and parts of them, the likeliest first.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou princess sunshine football baseball shadow superman batman trustno1 "
    "hello freedom whatever secret test guest root user changeme default pass love god money access flower hunter killer summer winter spring autumn january february "
    "march april may june july august september october november december monday friday sunday company server database example sample demo temp token key api secure "
    "security system network office mail cloud data service prod production staging develop dev local host home web site app mobile phone computer internet apple google "
    "orange banana coffee cookie cheese pepper ginger silver golden diamond tiger lion eagle falcon wolf bear horse jordan michael jennifer thomas robert daniel andrew "
    "joshua matthew charlie maggie bailey the and for you are with this that from have"
).split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("013457@$!", "oleastasi")
#: Rows of keys and runs in which neighbours are a walk.
WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik,9ol.0p;/")
NEXT = {(a, b) for row in WALKS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
_Y, _M, _D, _S = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "[-/.]?"
DATES = [(re.compile(p), math.log10(n)) for p, n in ((_Y, 150), (_Y + _S + _M + _S + _D, 365 * 150), (_D + _S + _M + _S + _Y, 365 * 150))]
KINDS = ("assign", "access", "hex", "guess")


_brute: dict[str, float] = {}


def brute(c: str) -> float:
    if c not in _brute:
        _brute[c] = math.log10(10 if c in "0123456789" else 26 if c.isalpha() else 33)
    return _brute[c]


_ranks: dict[str, dict[str, int]] = {}
_finders: dict[str, ahocorasick.Automaton] = {}


def ranks(words: str = WORDS) -> dict[str, int]:
    """Rank of each known word: the frequent passwords, then the whole words of a public vocabulary in its order."""
    if words not in _ranks:
        from tokenizers import Tokenizer

        vocab = Tokenizer.from_file(tokenizer_path(words)).get_vocab()
        whole = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and re.fullmatch("[a-z]{3,20}", w[:-4]))
        _ranks[words] = {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *(w for _, w in whole)]))}
    return _ranks[words]


def backward_words(text: str, words: str) -> Iterator[tuple[int, int, int]]:
    """(end, start, rank) of all known words in a text that is told backwards, by end; (-1, -1, 0) at last."""
    if words not in _finders:
        _finders[words] = ahocorasick.Automaton()
        for w, r in ranks(words).items():
            if len(w) > 1:
                _finders[words].add_word(w[::-1], (len(w), r))
        _finders[words].make_automaton()
    for last, (n, r) in _finders[words].iter(text):
        yield last + 1, last + 1 - n, r
    yield -1, -1, 0


class Track:
    """Least cost of a span that ends here in a run, over its starts: best[start] + log10(length / unit).

    Of two starts the earlier gains on the later as the run goes on, so a later start is kept only if it
    is ahead at once, and an earlier one only if its best is less: few are left, whatever the run's length.
    """

    def __init__(self, unit: int):
        self.unit, self.starts = unit, [[] for _ in range(unit)]

    def clear(self) -> None:
        for x in self.starts:
            x.clear()

    def at(self, end: int, start: int, best: array) -> float:
        """With one more start, which is a whole number of units before end."""
        held, cost = self.starts[end % self.unit], lambda i: best[i] + math.log10((end - i) // self.unit)
        new, least = cost(start), min(map(cost, held), default=math.inf)
        if new < least:
            held[:] = [i for i in held if best[i] < best[start]]
            held.append(start)
        return min(new, least)


def guess_cost(value: str, words: str = WORDS) -> float:
    """Decimal logarithm of the least guesses for value over all its segmentations; 0 for the empty one."""
    return _short_cost(value, words) if len(value) <= 64 else suffix_costs(value, words)[0]


def suffix_costs(value: str, words: str = WORDS) -> array:
    """guess_cost of value[i:] for every i up to its length: the value is read backwards once."""
    rank, n, back = ranks(words), len(value), value[::-1]
    low = back.translate(LOWER)
    plain = low.translate(LEET)
    best, sums = array("d", bytes(8 * n + 8)), array("d", bytes(8 * n + 8))
    tracks, run = [(u, 3 if u == 1 else 2 * u, Track(u)) for u in range(1, UNITS + 1)], [0] * (UNITS + 1)
    walk, steps = Track(1), 0
    as_low, as_plain = backward_words(low, words), backward_words(plain if plain != low else "", words)
    end, start, r = next(as_low)
    end2, start2, r2 = next(as_plain)
    for j in range(1, n + 1):
        c = back[j - 1]
        cost = brute(c)
        least = best[j - 1] + cost
        sums[j] = sums[j - 1] + cost
        while end == j:
            least = min(least, best[start] + math.log10(r + 1) + 0.3 * (back[start:j] != low[start:j]))
            end, start, r = next(as_low)
        while end2 == j:
            if low[start2:j][::-1] not in rank:
                least = min(least, best[start2] + math.log10(r2 + 1) + 0.3 * (1 + (back[start2:j] != low[start2:j])))
            end2, start2, r2 = next(as_plain)
        if c in "0123456789":
            for pattern, date in DATES:
                if m := pattern.match(value, n - j):
                    least = min(least, best[n - m.end()] + date)
        for u, fewest, track in tracks:  # u characters told again: a run of one three times, of more twice
            if j > u and c == back[j - 1 - u]:
                run[u] += 1
                if run[u] + u >= fewest:
                    least = min(least, sums[j] - sums[j - u] + track.at(j, j - fewest, best))
            elif run[u]:
                run[u] = 0
                track.clear()
        if j > 1 and (low[j - 2], low[j - 1]) in NEXT:
            steps += 1
            if steps >= 2:
                least = min(least, math.log10(47 * 2) + walk.at(j, j - 3, best))
        elif steps:
            steps = 0
            walk.clear()
        best[j] = least
    best.reverse()
    return best


@lru_cache(maxsize=100_000)
def _short_cost(value: str, words: str) -> float:
    return suffix_costs(value, words)[0]


class Values:
    """The values that runs of characters without white space hold from any place on, asked for from left to right."""

    def __init__(self, text: str):
        self.text, self.runs = text, RUN.finditer(text)
        self.end = -1

    def at(self, start: int) -> tuple[int, int, int]:
        """(end of the run, end of the value, kinds of characters in it) of the value that starts here."""
        while self.end <= start:
            run = next(self.runs)
            self.end, self.costs, self.first = run.end(), None, 0
            self.stop = run.start() + len(run[0].rstrip("\"'.,;:)]}"))
            self.kinds = [next((i for i in range(self.stop - 1, run.start() - 1, -1) if kind(self.text[i])), -1) for kind in (str.isdigit, str.islower, str.isupper)]
        return self.end, max(start, self.stop), sum(k >= start for k in self.kinds)

    def cost(self, start: int) -> float:
        """guess_cost of the value that starts here; costs of a run are found once."""
        if self.stop - start <= 64:
            return guess_cost(self.text[start : self.stop])
        if self.costs is None:
            self.costs, self.first = suffix_costs(self.text[start : self.stop]), start
        return self.costs[start - self.first]


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[float]]:
    """(base spans, added spans, guess costs of the assigned values), spans as (start, end, kind)."""
    base = []
    costs: list[float] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            base.append((m.start(), m.end(), "assign"))
            costs.append(guess_cost(m[2]))
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=order)
    starts, ends = [s for s, *_ in base], list(accumulate((e for _, e, _ in base), max))
    added, values = [], Values(text)
    m = WIDER.search(text)
    while m:
        start = m.end()
        stop, end, classes = values.at(start)
        k = bisect_left(starts, end)  # base spans that start before the value ends
        free = classes >= 2 and not (k and ends[k - 1] > start)
        if free and end - start >= 6 and values.cost(start) >= GUESSES:
            added.append((start, end, "guess"))
            at = stop
        else:  # inside the value again; of one kind of characters, no rest of it has two: only a word at its end, 32 characters at most, matters
            at = start if classes >= 2 else max(start, stop - 32)
        m = WIDER.search(text, at)
    return base, added, costs


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, least_guess_log10, n_weak of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                base, added, costs = spans_of(text or "")
                n = [sum(k == kind for *_, k in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(base + added), len(added), min(costs, default=None), sum(c < GUESSES for c in costs)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "least_guess_log10", "n_weak"])
            out.insert(0, "doc_id", b["doc_id"].reset_index(drop=True))
            yield out.astype({c: "int64" for c in ("n_assign", "n_access", "n_hex", "n_guess", "n_weak")} | {"least_guess_log10": "float64"})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, least_guess_log10 double, n_weak long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def op8_secret_guess_cost(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
