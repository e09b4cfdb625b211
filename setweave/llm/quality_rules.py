"""Operator 10, a quality classifier made of a sparse ensemble of rules.

Shallow trees are grown on random rows and statistics; every path from a root becomes a
conjunctive rule; a logistic model with an L1 penalty weighs the rules (the penalty is chosen
on a part of the training rows); rules of non-zero weight are compiled into one Spark column
expression over the statistics columns.

Learned from at most TRAIN_ROWS labelled rows, those of least hash of doc_id, whose
crc32(doc_id as text) mod 5 is not 0. Statistics are of the text alone. Every row is scored.

Defined results: null text counts as empty and is scored like any other; a document labelled
repeatedly counts once, with the mean label rounded; of several texts of one labelled doc_id that
of least statistics is learned from; null labels are ignored; with no label, or
labels of one class, every score is (n1 + 1) / (n + 2); an empty table gives no rows; a null
doc_id is not held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, tidied

TRAIN_ROWS = 8_000
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
TREES, DEPTH, THRESHOLDS, SEED = 30, 3, 16, 10
#: The largest penalty stays that errs on no more than SLACK of the checking rows beyond the best.
PENALTIES, SLACK = (0.05, 0.02, 0.01, 0.005, 0.002), 0.001
STATS = ["log_words", "word_len", "upper", "symbols", "bars", "bangs", "digits", "stops", "breaks", "wide", "unique", "short", "long", "odd_end", "run", "line_rep"]
_kind = np.zeros((256, 9), dtype=np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@^~=+<>\\{}[]_", b"|", b"!?", b"0123456789", b".,;:", b"\n")):
    _kind[list(_chars), _i] = 1
_kind[128:192, 7] = 1  # continuation bytes: the rest of characters beyond ASCII
_kind[[*range(65, 91), *range(97, 123)], 8] = 1


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, sym, bars, bangs, digits, stops, breaks, wide, letters = (count @ _kind).tolist()
    words = data.split()
    n, size = len(words), max(1, len(data))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1, dtype=np.int64)
    odd = sum(w[-1] < 48 and w[-1] not in b".,)'\"-" or w[-1] in b"|*" for w in words) / max(1, n)
    run = sum(map(eq, words[1:], words)) / (n - 1) if n > 1 else 0.0
    lines = data.split(b"\n")
    return [
        float(np.log1p(n)), float(lens.mean()), upper / max(1, letters), sym / size, bars / size, bangs / size, digits / size, stops / size, breaks / size,
        wide / size, len(set(words)) / max(1, n), float((lens <= 3).mean()), float((lens >= 14).mean()), odd, run, 1 - len(set(lines)) / len(lines),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text dropped, the columns STATS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.array([statistics(t) for t in b["text"]], dtype=np.float64).reshape(-1, len(STATS))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(m, columns=STATS)], axis=1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidied(run), "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above the threshold?, threshold)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rule: Rule, out: set[Rule]) -> None:
    """One tree by Gini impurity, on a random half of the statistics at each node; adds its paths to out."""
    if len(rule):
        out.add(tuple(sorted(rule)))
    if len(rule) == DEPTH or len(y) < 20 or y.min() == y.max():
        return
    best, total = (1e-9, -1, 0.0), y.sum()
    for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
        above = x[:, f, None] > cuts[None]
        n1, p1 = above.sum(0), (above & (y[:, None] > 0)).sum(0)
        n0, p0 = len(y) - n1, total - p1
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = p1**2 / n1 + p0**2 / n0 - total**2 / len(y)
        gain = np.where((n1 >= 5) & (n0 >= 5), gain, -1)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float(cuts[k]))
    gain, f, t = best
    if f < 0:
        return
    for above in (False, True):
        part = (x[:, f] > t) == above
        grow(x[part], y[part], rng, (*rule, (f, above, t)), out)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    a = np.hstack([r, np.ones((len(r), 1), dtype=r.dtype)])
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(1e-9, float(v @ (a.T @ (a @ v))))
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / len(y)
        new = z - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * penalty)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


class RuleModel:
    """Weighted rules; score() is a column over the columns STATS."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self, prefix: str = "") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            cond = F.lit(True)
            for f, above, t in rule:
                c = F.col(prefix + STATS[f])
                cond = cond & ((c > t) if above else (c <= t))
            total = total + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> RuleModel:
    n, n1 = len(y), float(y.sum()) if len(y) else 0.0
    if n < 10 or n1 in (0, n):
        p = (n1 + 1) / (n + 2)
        return RuleModel([], [], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    found: set[Rule] = set()
    for _ in range(TREES):
        rows = rng.integers(0, n, min(n, 2000))
        grow(x[rows], y[rows], rng, (), found)
    rules = sorted(found)
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float32)
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold on the same rows count once
    rules, r = [rules[i] for i in sorted(first)], r[:, sorted(first)]
    check = rng.random(n) < 0.25
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check = np.zeros(n, dtype=bool)
    tried = []
    for p in PENALTIES if check.any() else ():
        w, b = lasso(r[~check], y[~check], p)
        tried.append((float(np.mean((1 / (1 + np.exp(-(r[check] @ w + b))) >= CUT) != (y[check] > 0))), p))
    penalty = next((p for wrong, p in tried if wrong <= min(tried)[0] + SLACK), PENALTIES[-1])
    w, b = lasso(r, y, penalty)
    keep = [i for i in np.argsort(-np.abs(w)) if abs(w[i]) > 1e-3]
    if keep:  # the chosen rules are weighed anew with little penalty, which shrank them
        w, b = lasso(r[:, keep], y, penalty / 20)
    return RuleModel([rules[i] for i in keep], [float(x) for x in w[: len(keep)]], b)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `rows` labelled documents of the training folds."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.round(F.avg("quality")).alias("quality")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    # at most `rows` rows of two numbers are broadcast and collected
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id", "left_semi")
    one = with_statistics(chosen).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("x"))  # of texts that share a doc_id always the same one
    got = one.join(F.broadcast(known), "doc_id").select("doc_id", "x.*", "quality").toPandas().sort_values("doc_id")
    return got[STATS].to_numpy(np.float64), got["quality"].to_numpy(np.float64)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    model = fit_rules(*training_rows(docs, labels, rows))
    scored = with_statistics(docs).select("doc_id", model.score().alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are predicted 1, columns as they are."""
    model = fit_rules(*training_rows(docs, labels, rows))
    # the text passes through Python once and is not returned: Python gives back a row's statistics only
    stat = F.pandas_udf(lambda s: pd.DataFrame([statistics(t) for t in s], columns=STATS) if len(s) else pd.DataFrame(columns=STATS, dtype=float), ", ".join(f"{s} double" for s in STATS))
    held, mark = fresh(docs, "stat", "q")
    named = docs.withColumn(held, stat(F.col("text")))
    named = named.select(*columns_of(docs), *[F.col(f"{held}.{s}").alias(mark + s) for s in STATS])
    return named.where(model.score(mark) >= CUT).select(*columns_of(docs))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
