"""Operator 12, substring dedup by relative Lempel-Ziv parsing.

A window is WINDOW consecutive words of one document; it is a repeat if its words also start in a
document of smaller doc_id. All words that repeats cover are removed.

Texts that are equal word for word are told by digest: but for those of the least doc_id they go as a
whole. Of the others, each window has a seed, the run of SEED_WORDS words of least hash in it, which
equal windows share. Seeds are counted by an ordinary aggregation (hot seeds are summed in the tasks
that read them), and only windows whose seed stands in documents of different ids go on:

* Windows around one seed make a piece of a document, and all pieces of a seed make a block, which one
  task gets in the order of doc_id. The block's index is its seed: its pieces lie side by side with
  their seeds in line, and a window that holds the seed can only be met there. Each piece is parsed
  greedily into factors, the longest runs of words that stand in the block's pieces of smaller doc_id,
  or single words. A factor of WINDOW words or more is a repeat. A shorter repeat can cross one factor
  boundary at most, since the factor that starts inside it reaches its end, so where two neighbours
  have WINDOW words together, the windows across their boundary are looked up too.
* A seed of more than HOT pieces would make too large a block. Equal pieces of hot seeds are told by
  digest: all but those of the least doc_id are repeats as a whole. The distinct pieces are references to
  each other by window: the least doc_id of each window's digest is aggregated, in place of a task that
  holds the pieces. A bitmap of fixed size of the windows that stand in several of them leaves each piece
  its runs of windows that can be repeats; equal runs are told by digest in turn, and only the windows of
  distinct runs are looked up one by one. So a passage in very many documents costs a row a document and
  seed, not a row a window, and all of it are aggregations and ordinary joins that may be split anywhere.

Nothing is compared by seeds or hashes alone but by whole words, or by MD5 (texts, hot pieces and windows).
Work and rows moved are in proportion to the words; a text is moved by digest at most twice.

Defined results: null text has no words; a null doc_id is greater than any other, and documents of
equal doc_ids (or of null ones) are not repeats of each other; repeated rows give equal rows; texts of
fewer than WINDOW words stay whole; texts of any length are taken whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, durable
from .simhash import mixed, word_hashes
from .token_binary import pieces, split_words

WINDOW, SEED_WORDS, HOT = 50, 16, 400
#: Bits of the bitmap of windows.
BITMAP = 1 << 23
#: Stands for a null doc_id: greater than any other.
LAST = 2**63 - 1
FACTOR = 0x9E3779B97F4A7C15
#: Bits of a place in a batch of words, when places break the ties of seeds.
PLACE_BITS = 28


def plain(text: Column) -> Column:
    """The words of a text, joined by one space. Texts whose words stand apart by one space or line end each need no pattern."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    odd = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in ("\t", "\x0b", "\x0c", "\r", "  ")])
    return F.trim(F.when(odd, F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).otherwise(text))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, id (never null), text (its words), n_words and key (MD5 of the words) of every row of docs."""
    spaces = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" ")))
    told = lambda t: F.struct(t.alias("text"), F.when(t == "", 0).otherwise(spaces(t) + 1).cast("long").alias("n_words"), F.unhex(F.md5(t)).alias("key"))
    doc_id = F.col("doc_id").cast("long")
    # inline(): a filter on n_words cannot be pushed below it, so that each text is made plain once
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("id"), F.inline(F.transform(F.array(plain(F.col("text"))), told)))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` of these hashes, from differences of one running sum."""
    factor = np.full(len(h), FACTOR, dtype=np.uint64)
    back = np.full(len(h), pow(FACTOR, -1, 1 << 64), dtype=np.uint64)
    factor[:1] = back[:1] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * np.cumprod(factor), dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * np.cumprod(back)[: max(0, len(h) - size + 1)], size)


def window_seeds(h: np.ndarray, n: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, place of its seed) of all windows of texts of n words each, whose words' hashes are h, and the hashes of all runs of `size`."""
    none = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return none, none, none.astype(np.uint64)
    runs = run_hashes(h, size)
    least = runs & ~np.uint64((1 << PLACE_BITS) - 1) | np.arange(len(runs), dtype=np.uint64)  # the leftmost of equals
    span, wide = 1, window - size + 1
    while 2 * span <= wide:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    k = np.maximum(0, n - window + 1)
    start = np.repeat(np.cumsum(n) - n, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return start, (least[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), runs


def seeds_of(texts: DataFrame, window: int, size: int) -> DataFrame:
    """(seed, id, key) of the seeds of all windows, once a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                words, n = split_words(b.column("text"))
                start, place, runs = window_seeds(word_hashes(words), n, window, size)
                place = place[np.flatnonzero(np.diff(place, prepend=-1))]
                owner = pa.array(np.searchsorted(np.cumsum(n), place, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array(runs[place].view(np.int64)), b.column("id").take(owner), b.column("key").take(owner)], ["seed", "id", "key"])

    return texts.select("id", "key", "text").mapInArrow(run, "seed long, id long, key binary")


def pieces_of(texts: DataFrame, window: int, size: int) -> DataFrame:
    """(seed, hot, id, key, start, seed_at, count, piece): the words of the `count` windows around each place of a seed that texts (id, key, text, cold, hot: seeds) are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                words, n = split_words(b.column("text"))
                start, place, runs = window_seeds(word_hashes(words), n, window, size)
                if not len(start):
                    continue
                first = np.flatnonzero(np.diff(place, prepend=-1))  # of the windows around one place
                last = np.append(first[1:], len(place)) - 1
                owner = np.searchsorted(np.cumsum(n), place[first], side="right")
                seed = runs[place[first]].view(np.int64)
                begins, at = np.cumsum(n) - n, np.searchsorted(owner, np.arange(len(n) + 1))
                of = {c: b.column(c) for c in ("cold", "hot")}
                took, is_hot, text = [], [], []
                for row in range(b.num_rows):
                    mine = seed[at[row] : at[row + 1]]
                    cold, hot = (np.isin(mine, of[c][row].values.to_numpy(zero_copy_only=False)) for c in ("cold", "hot"))
                    some = np.flatnonzero(cold | hot)
                    if len(some):
                        own = words.slice(begins[row], n[row]).to_pylist()
                        text += [" ".join(own[s : e + window]) for s, e in zip((start[first[at[row] + some]] - begins[row]).tolist(), (start[last[at[row] + some]] - begins[row]).tolist())]
                        took.append(at[row] + some)
                        is_hot.append(hot[some])
                if not took:
                    continue
                took = np.concatenate(took)
                row, s = pa.array(owner[took]), start[first[took]]
                cols = [pa.array(seed[took]), pa.array(np.concatenate(is_hot)), b.column("id").take(row), b.column("key").take(row), pa.array(s - begins[owner[took]]), pa.array(place[first[took]] - s), pa.array(last[took] - first[took] + 1), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["seed", "hot", "id", "key", "start", "seed_at", "count", "piece"])

    return texts.select("id", "key", "text", "cold", "hot").mapInArrow(run, "seed long, hot boolean, id long, key binary, start long, seed_at long, count long, piece string")


class Block:
    """Reference pieces of one seed, in the order of doc_id, side by side with their seeds in line."""

    def __init__(self, window: int, size: int):
        self.window, self.middle, self.width = window, window - size, 2 * window - size
        self.numbers: dict[str, int] = {}
        self.ids: list[int] = []
        self.rows = np.zeros((8, self.width), dtype=np.int32)
        self.first: dict[tuple[int, str], int] = {}

    def repeats(self, doc: int, seed_at: int, piece: str) -> list[tuple[int, int]]:
        """(first, count) of the windows of a piece that stand in pieces of smaller doc_id. Pieces come in the order of doc_id."""
        known = self.first.setdefault((seed_at, piece), doc)
        words = piece.split(" ")
        if known < doc:
            return [(0, len(words) - self.window + 1)]
        row = np.full(self.width, -1, dtype=np.int32)
        left = self.middle - seed_at
        row[left : left + len(words)] = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
        before = int(np.searchsorted(self.ids, doc))  # strictly smaller
        found = self._parse(row, left, left + len(words), before) if before else []
        if len(self.ids) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(self.ids)] = row
        self.ids.append(doc)
        return [(s - left, k) for s, k in found]

    def _parse(self, row: np.ndarray, begin: int, end: int, before: int) -> list[tuple[int, int]]:
        same = (self.rows[:before, begin:end] == row[begin:end]) & (row[begin:end] >= 0)
        some = same.any(axis=0)

        def longest(at: int) -> int:
            """Words from here on that stand in one reference."""
            if not some[at - begin]:
                return 0
            rest = same[:, at - begin :]
            stop = rest.argmin(axis=1)
            return int(np.where(rest[np.arange(before), stop], rest.shape[1], stop).max())

        factors, at = [], begin
        while at < end:
            k = longest(at)
            if k:
                factors.append((at, at + k))
            at += max(1, k)
        starts = set()
        for s, e in factors:
            starts.update(range(s, e - self.window + 1))
        for (s, b), (c, e) in zip(factors, factors[1:]):
            if b == c and e - s >= self.window:  # a repeat may cross the boundary
                starts.update(w for w in range(max(s, b - self.window + 1), min(b, e - self.window + 1)) if longest(w) >= self.window)
        out: list[tuple[int, int]] = []
        for w in sorted(starts):
            if out and out[-1][0] + out[-1][1] == w:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((w, 1))
        return out


def block_repeats(rows: DataFrame, window: int, size: int) -> DataFrame:
    """(key, start, count) of the repeats among pieces of cold seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, block = None, None
        for batch in batches:
            keys, starts, counts = [], [], []
            for this, doc, key, start, seed_at, piece in zip(*(batch.column(c).to_pylist() for c in ("seed", "id", "key", "start", "seed_at", "piece"))):
                if this != seed:
                    seed, block = this, Block(window, size)
                for first, k in block.repeats(doc, seed_at, piece):
                    keys.append(key)
                    starts.append(start + first)
                    counts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["key", "start", "count"])

    dealt = rows.repartition("seed").sortWithinPartitions("seed", "id", "seed_at", "start")
    return dealt.mapInArrow(run, "key binary, start long, count long")


def window_digests(words: list[str], window: int) -> np.ndarray:
    """(windows, 2) int64: MD5 of each window."""
    return np.frombuffer(b"".join(hashlib.md5(" ".join(words[k : k + window]).encode()).digest() for k in range(len(words) - window + 1)), dtype="<i8").reshape(-1, 2)


def windows_of(rows: DataFrame, window: int) -> DataFrame:
    """(b1, b2, digest, id, at): digests of the windows of rows (digest, id, at, piece), `at` places on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "piece"):
                found = [window_digests(t.split(" "), window) for t in b.column("piece").to_pylist()]
                if not found:
                    continue
                n = np.array([len(x) for x in found])
                row, both = pa.array(np.repeat(np.arange(len(n)), n)), np.concatenate(found)
                at = np.repeat(b.column("at").to_numpy(), n) + np.arange(len(both)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), b.column("digest").take(row), b.column("id").take(row), pa.array(at)], ["b1", "b2", "digest", "id", "at"])

    return rows.select("digest", "id", "at", "piece").mapInArrow(run, "b1 long, b2 long, digest binary, id long, at long")


def bitmap(windows: DataFrame) -> np.ndarray:
    """BITMAP bits, of which those are set that b1 of some window names; a fixed number of 64-bit words comes to the driver."""
    bit = F.col("b1").bitwiseAND(F.lit(BITMAP - 1))
    rows = windows.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(b1 & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(BITMAP // 64, dtype=np.int64)
    out[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return out


def runs_of(rows: DataFrame, bits: np.ndarray, window: int) -> DataFrame:
    """(digest, id, at, count, piece): runs of windows of rows (digest, id, piece) whose bits are set, with their words."""
    held = rows.sparkSession.sparkContext.broadcast(bits)  # BITMAP bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "piece"):
                took, at, count, text = [], [], [], []
                for i, piece in enumerate(b.column("piece").to_pylist()):
                    words = piece.split(" ")
                    bit = window_digests(words, window)[:, 0] & (BITMAP - 1)
                    on = held.value[bit >> 6] >> (bit & 63) & 1
                    for s, e in np.flatnonzero(np.diff(on, prepend=0, append=0)).reshape(-1, 2).tolist():
                        took.append(i)
                        at.append(s)
                        count.append(e - s)
                        text.append(" ".join(words[s : e + window - 1]))
                row = pa.array(took, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("digest").take(row), b.column("id").take(row), pa.array(at, pa.int64()), pa.array(count, pa.int64()), pa.array(text, pa.string())], ["digest", "id", "at", "count", "piece"])

    return rows.select("digest", "id", "piece").mapInArrow(run, "digest binary, id long, at long, count long, piece string")


def hot_repeats(rows: DataFrame, window: int) -> DataFrame:
    """(key, start, count) of the repeats among pieces (id, key, start, count, piece) of hot seeds."""
    md5 = F.unhex(F.md5("piece"))
    rows = rows.withColumn("digest", md5)
    distinct = durable(rows.groupBy("digest").agg(F.min("id").alias("id"), F.max("id").alias("most"), F.first("piece").alias("piece")))
    copied = distinct.where("id < most").select("digest", F.col("id").alias("least"))
    whole = rows.select("digest", "id", "key", "start", "count").join(copied, "digest").where("least < id").select("key", "start", "count")
    shared = windows_of(distinct.withColumn("at", F.lit(0).cast("long")), window).groupBy("b1", "b2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    shared = durable(shared.select("b1", "b2", "least"))
    runs = durable(runs_of(distinct, bitmap(shared), window).withColumn("run", md5))
    first = durable(runs.groupBy("run").agg(F.min("id").alias("least"), F.max("id").alias("most")))
    told = runs.select("digest", "id", "at", "count", "run").join(first.where("least < most").select("run", "least"), "run").where("least < id").select("digest", "id", "at", "count")
    own = runs.join(first.select("run", F.col("least").alias("id")), ["run", "id"], "left_semi")
    one = windows_of(own, window).join(shared, ["b1", "b2"]).where("least < id").select("digest", "id", "at", F.lit(1).cast("long").alias("count"))
    part = told.unionByName(one).withColumnRenamed("count", "n")
    part = rows.select("digest", "id", "key", "start").join(part, ["digest", "id"]).select("key", (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("count"))
    return whole.unionByName(part)


def repeats(texts: DataFrame, window: int = WINDOW, size: int = SEED_WORDS, hot: int = HOT) -> DataFrame:
    """(key, start, count): runs of windows of texts (id, key, text; no two with the same words and different ids) that start in a text of smaller id."""
    seeds = durable(seeds_of(texts, window, size))
    shared = seeds.groupBy("seed").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most")
    shared = durable(shared.select("seed", (F.col("n") > hot).alias("hot")))
    wanted = seeds.join(shared, "seed").groupBy("key").agg(F.collect_set(F.when(~F.col("hot"), F.col("seed"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("seed"))).alias("hot"))  # seeds of one text
    found = durable(pieces_of(texts.join(wanted, "key"), window, size))
    return block_repeats(found.where("not hot"), window, size).unionByName(hot_repeats(found.where("hot"), window))


def without_repeats(docs: DataFrame, window: int = WINDOW, size: int = SEED_WORDS, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of first word, end), kept (text, words joined by one space) of every row of docs (doc_id, text)."""
    texts = texts_of(docs)
    long_ones = texts.where(F.col("n_words") >= window)
    copies = long_ones.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    copies = checked_broadcast(copies)
    first = long_ones.join(copies, "key", "left").where(F.coalesce(F.col("least") == F.col("id"), F.lit(True)))
    runs = repeats(first.select("id", "key", "text"), window, size, hot)
    runs = durable(runs.groupBy("key").agg(F.collect_set(F.struct("start", "count")).alias("runs")))  # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                spans, kept, removed = [], [], []
                for text, own in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                    words = text.split(" ")
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in own:
                        edge[r["start"]] += 1
                        edge[r["start"] + r["count"] - 1 + window] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
                    spans.append([{"start": int(s), "end": int(e)} for s, e in turn])
                    removed.append(int(gone.sum()))
                    kept.append(" ".join(w for w, g in zip(words, gone.tolist()) if not g))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"
    marked = checked_broadcast(runs.select(F.col("key").alias("_key"), F.lit(True).alias("marked")))
    rows = texts.join(copies, "key", "left").withColumn("copy", F.coalesce(F.col("least") < F.col("id"), F.lit(False))).join(marked, F.col("key") == F.col("_key"), "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start: long, end: long>>")
    plainly = rows.where(F.col("copy") | F.col("marked").isNull())
    plainly = plainly.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("copy"), whole).otherwise(none).alias("spans"), F.when(F.col("copy"), "").otherwise(F.col("text")).alias("kept"))
    changed = rows.where(~F.col("copy") & F.col("marked").isNotNull()).select("doc_id", "n_words", "key", "text").join(runs, "key").select("doc_id", "n_words", "text", "runs").mapInArrow(cut, schema)
    return plainly.unionByName(changed)


def op12_relative_lz(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows as strings, grouped.
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT r, coalesce(doc_id, {LAST}) AS id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
m AS (SELECT h, min(id) AS least FROM s GROUP BY h),
c AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM s JOIN m USING (h) WHERE least < id),
g AS (SELECT r, list(k) AS gone FROM c GROUP BY r),
e AS (SELECT d.r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
t AS (SELECT e.r, string_agg(x, ' ' ORDER BY k) AS kept FROM e ANTI JOIN c USING (r, k) GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN t USING (r)
"""
