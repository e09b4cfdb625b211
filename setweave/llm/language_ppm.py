"""Operator 5, language ID by prediction with partial matching (PPM).

Each language has byte contexts of orders 0 to 3 with frozen counts. In a context seen with
total n and d distinct successors, a successor of count c has probability c / (n + d) and the
escape to the next shorter context d / (n + d) (method C); below order 0 all 256 bytes are
alike. Since counts are frozen, a byte's code length depends on the last four bytes only and is
tabled. A text's language is the one of least code length; its score is that language's share of
the languages' probabilities, tempered by the square root of the length.

Bytes: A-Z are lower-cased, other ASCII bytes but letters become a space, runs of spaces one.

Learned from at most SAMPLE_DOCS texts and some SAMPLE_BYTES a language, those of least hash of doc_id
and text, of the rows with a non-null lang whose crc32(doc_id as text) mod 3 is not 1; equal rows
count once. All contexts of the sample are kept; a model of more than MODEL_BYTES is an error.

Defined results: null texts and texts without a letter are und with score 0; without training
rows everything is und; ties go to the first language by code point; a null doc_id is not held
out and not learned from; repeated rows are each predicted and learned from once; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, uniform

SAMPLE_DOCS, FOLDS, HELD_OUT, SEED = 300, 3, 1, 5
#: Bytes of text of a language's sample, but for the text that reaches them.
SAMPLE_BYTES = 16 << 20
#: Most bytes of the tables of a model, which is broadcast.
MODEL_BYTES = 1 << 30
SPACE = 32
_fold = np.arange(256)
_fold[65:91] += 32
_fold[[i for i in range(128) if not chr(i).isalpha()]] = SPACE


def folded(text: str) -> np.ndarray:
    """Bytes as the model sees them, with three spaces before."""
    b = _fold[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    b = np.concatenate([[SPACE, SPACE, SPACE], b])
    return b[np.concatenate([[True, True, True], (b[3:] != SPACE) | (b[2:-1] != SPACE)])]


class Rows:
    """The place of a key (0 or more) among sorted distinct keys, or -1: an open-addressing table."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key, self.row = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left], step)
            free = self.key[at] < 0
            at, here = at[free], left[free]
            at, first = np.unique(at, return_index=True)
            self.key[at], self.row[at] = keys[here[first]], here[first]
            left, step = np.setdiff1d(left, here[first]), step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for step in range(self.steps):
            at = self._slot(keys[left], step)
            here = self.key[at] == keys[left]
            out[left[here]] = self.row[at[here]]
            left = left[~here & (self.key[at] >= 0)]
            if not len(left):
                break
        return out


class PPM:
    """Code lengths (bits) of a folded byte in its context, by language.

    Held are the successors seen in any language, with the bits in every language: of order 3 by their
    four bytes, of order 2 by three; and the bits of the escape from every context. Bytes that were
    seen in no language after a context take its escape and the next shorter context.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        data = {lang: [folded(t) for t in texts[lang]] for lang in self.langs}
        used = np.unique(np.concatenate([np.array([SPACE])] + [b for bs in data.values() for b in bs]))
        self.size = a = len(used) + 1
        self.symbol = np.full(256, a - 1, dtype=np.int64)  # the last symbol: any byte never seen
        self.symbol[used] = np.arange(len(used))
        grams = []
        for lang in self.langs:
            keys = [np.zeros(0, dtype=np.int64)]
            for b in data[lang]:
                s = self.symbol[b]
                keys.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
            grams.append(np.unique(np.concatenate(keys), return_counts=True))
        every = np.unique(np.concatenate([np.zeros(0, dtype=np.int64)] + [k for k, _ in grams]))
        keys3, contexts3 = np.unique(every % a**3), np.unique(every // a)
        self.find4, self.find3, self.find_context = Rows(every), Rows(keys3), Rows(contexts3)
        n = len(self.langs)
        self.bits1, self.escape2 = np.zeros((a * a, n)), np.zeros((a * a, n))
        self.bits2, self.bits3, self.escape3 = np.zeros((len(keys3), n)), np.zeros((len(every), n)), np.zeros((len(contexts3), n))
        self.nbytes = sum(x.nbytes for x in (self.bits1, self.escape2, self.bits2, self.bits3, self.escape3))
        if self.nbytes > MODEL_BYTES:
            raise ValueError(f"a model of {self.nbytes} bytes is more than {MODEL_BYTES}: lower `sample`")
        for at, (keys, count) in enumerate(grams):
            p0 = self._mix(np.bincount(keys % a, weights=count, minlength=a)[None], np.full((1, a), 8.0))[0]  # order -1: 8 bits
            p1 = self._mix(np.bincount(keys % a**2, weights=count, minlength=a * a).reshape(a, a), np.broadcast_to(p0, (a, a))).ravel()
            self.bits1[:, at] = p1
            own = np.zeros(len(keys3))
            np.add.at(own, self.find3(keys % a**3), count)
            self.bits2[:, at], self.escape2[:, at] = self._sparse(own, keys3 // a, a * a, p1[keys3 % (a * a)])
            own = np.zeros(len(every))
            own[self.find4(keys)] = count
            self.bits3[:, at], self.escape3[:, at] = self._sparse(own, self.find_context(every // a), len(contexts3), self.bits2[self.find3(every % a**3), at])

    @staticmethod
    def _mix(count: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Bits of each successor: its own share, or the escape's and those of the shorter context."""
        n, d = count.sum(-1, keepdims=True), (count > 0).sum(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            own, esc = -np.log2(count / (n + d)), np.where(n > 0, -np.log2(d / (n + d)), 0.0)
        return np.where(count > 0, own, esc + below)

    @staticmethod
    def _sparse(count: np.ndarray, context: np.ndarray, contexts: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _mix for successors told with their context: (bits of each, escape of each context)."""
        n, d = np.bincount(context, weights=count, minlength=contexts), np.bincount(context, weights=count > 0, minlength=contexts)
        with np.errstate(divide="ignore", invalid="ignore"):
            esc = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            own = -np.log2(count / (n + d)[context])
        return np.where(count > 0, own, esc[context] + below), esc

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths of texts, by language."""
        out = np.zeros((len(texts), len(self.langs)))
        a = self.size
        for i, t in enumerate(texts):
            s = self.symbol[folded(t)]
            if len(s) <= 3:
                continue
            keys = ((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:]
            row = self.find4(keys)
            out[i] = self.bits3[row[row >= 0]].sum(0)
            keys = keys[row < 0]
            if not len(keys):
                continue
            context = self.find_context(keys // a)
            out[i] += self.escape3[context[context >= 0]].sum(0)
            row = self.find3(keys % a**3)
            out[i] += self.bits2[row[row >= 0]].sum(0)
            keys = keys[row < 0]
            out[i] += self.escape2[keys // a % (a * a)].sum(0) + self.bits1[keys % (a * a)].sum(0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letter = [bool(self.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
        bits = self.lengths([t for t, ok in zip(texts, letter) if ok])
        langs, scores, k = [], [], 0
        for t, ok in zip(texts, letter):
            if not ok:
                langs.append("und")
                scores.append(0.0)
                continue
            b = bits[k] * np.log(2) / np.sqrt(max(1, len(t)))
            best = int(np.argmin(b))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(b[best] - b).sum()))
            k += 1
        return langs, scores


def fold_of(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_texts(docs: DataFrame, sample: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """At most `sample` texts a language, of least hash, until they reach `most_bytes`; in the order of doc_id and hash.

    Keys alone are ordered, of rows that a first draw by hash leaves: some three times the sample, whatever the rows.
    """
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    learn = learn.withColumn("u", uniform(SEED, F.col("doc_id"), F.xxhash64("text")))
    n = checked_broadcast(learn.groupBy(F.col("lang").alias("_l")).agg(F.approx_count_distinct("u").alias("_n")))
    few = learn.join(n, F.col("lang") == F.col("_l")).where(F.col("u") * F.col("_n") < 3 * sample + 20).select("lang", "doc_id", "u", F.octet_length("text").alias("size")).distinct()
    order = W.partitionBy("lang").orderBy("u", "doc_id", "size")  # of the few
    few = few.withColumns({"nth": F.row_number().over(order), "before": F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    few = few.where((F.col("nth") <= sample) & (F.col("before") < most_bytes)).select(*[F.col(c).alias("_" + c) for c in ("lang", "doc_id", "u")])
    same = (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_doc_id")) & (F.col("u") == F.col("_u"))
    part = learn.join(checked_broadcast(few), same, "left_semi").select("lang", "doc_id", "u", "text").dropDuplicates(["lang", "doc_id", "u"])
    out: dict[str, list[tuple]] = {}
    for r in part.toLocalIterator():  # at most `sample` a language
        out.setdefault(r["lang"], []).append((r["doc_id"], r["u"], r["text"]))
    return {k: [t for _, _, t in sorted(v)] for k, v in out.items()}


def predict_language(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang)."""
    # its size is checked against MODEL_BYTES
    model = docs.sparkSession.sparkContext.broadcast(PPM(training_texts(docs, sample)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores = model.value.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": pd.Series(langs, dtype="str"), "score": pd.Series(scores, dtype="float64")})

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_ppm_language(spark, sf_dir: str) -> DataFrame:
    return predict_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))
