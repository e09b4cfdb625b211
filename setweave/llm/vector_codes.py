"""Operator 13, vector code compression: product quantisation on columnar NumPy blocks.

Components become integers, floor(SCALE * x). Rows are packed once into blocks of at most BLOCK_ROWS
rows, each a (dimension, row) matrix of int64 held in one binary value of a durable table, so every
round reads columns and no row objects. A round is one RDD treeAggregate over the blocks: distances to
the codebooks of the PARTS parts accumulate dimension by dimension, np.add.at adds each part to the
sum and count tensors of its nearest entry (ties to the lower index), and the tensors, whose size
depends on the codebooks alone, merge through a reduction tree. The driver floors the means, unused
entries stay, and the next round's codebooks are broadcast (at most ENTRIES vectors). All arithmetic is
of whole numbers, so neither the order of blocks nor a task that runs twice changes a bit.

Codebooks start as the parts of the ENTRIES smallest vec_ids.

Defined results: rows are dropped whose vector is null or holds null, NaN or an infinity, and rows
whose vector is not as long as that of the smallest vec_id; that length must be a multiple of PARTS
(else an error), and no component may be above LARGEST in size (else an error: squares would not be
exact). Rows with a null vec_id come last in the order, rows with the same vec_id by their components;
each of them is coded. With fewer rows than entries the codebook is shorter. Equal labels share
label_error, null labels too. No kept row: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, durable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK_ROWS = 8192
#: Rows whose distances to all entries are held at a time.
AT_A_TIME = 2048
#: Components up to this size have exact squared distances over 4,096 dimensions.
LARGEST = float(1 << 13)


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label, x (array<long>) of the rows that are kept, whatever their length."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is greater than infinity
    rows = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    large = F.raise_error(F.lit(f"a component is above {LARGEST} in size"))
    whole = F.transform("x", lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c * SCALE)).otherwise(large.cast("long")))
    return rows.select("vec_id", "label", whole.alias("x"))


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, label: arrays, x: bytes of a (width, rows) int64 matrix) of runs of rows (vec_id, label, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, width)
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], ["vec_id", "label", "x"])

    return rows.where(F.size("x") == width).mapInArrow(run, "vec_id array<long>, label array<long>, x binary")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of book (entries, dimensions) for each column of x (dimensions, rows)."""
    entry, least = np.empty(x.shape[1], dtype=np.int64), np.empty(x.shape[1], dtype=np.int64)
    for at in range(0, x.shape[1], AT_A_TIME):
        some = x[:, at : at + AT_A_TIME]
        dist = np.zeros((some.shape[1], len(book)), dtype=np.int64)
        for d in range(len(x)):
            off = some[d][:, None] - book[None, :, d]
            off *= off
            dist += off
        entry[at : at + AT_A_TIME] = best = dist.argmin(axis=1)  # the first of equals
        least[at : at + AT_A_TIME] = dist[np.arange(len(best)), best]
    return entry, least


def matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(width, -1)


def moved(blocks: DataFrame, books: np.ndarray, depth: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, dimensions of a part) after one round over the blocks."""
    parts, entries, wide = books.shape
    held = blocks.sparkSession.sparkContext.broadcast(books)  # at most ENTRIES vectors

    def add(got, block):
        sums, counts = got
        x = matrix(block["x"], parts * wide)
        for p in range(parts):
            part = x[p * wide : (p + 1) * wide]
            entry, _ = nearest(part, held.value[p])
            for d in range(wide):
                np.add.at(sums[p, :, d], entry, part[d])
            np.add.at(counts[p], entry, 1)
        return sums, counts

    def merge(one, two):
        return one[0] + two[0], one[1] + two[1]

    zero = (np.zeros((parts, entries, wide), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64))
    sums, counts = blocks.select("x").rdd.treeAggregate(zero, add, merge, depth)
    held.unpersist()
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row of the blocks."""
    held = blocks.sparkSession.sparkContext.broadcast(books)  # at most ENTRIES vectors
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = matrix(batch.column("x")[i].as_py(), parts * wide)
                found = [nearest(x[p * wide : (p + 1) * wide], held.value[p]) for p in range(parts)]
                code = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                n = 2 * parts
                codes = [code[k : k + n] for k in range(0, len(code), n)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(codes, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, code string, error long")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every kept row of rows (vec_id, embedding, label); the final codebooks)."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    kept = integers(rows)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).select(F.size("x").alias("n")).collect()
    width = first[0]["n"] if first else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("x") == width)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # `entries` rows at most
    books = np.array([r["x"] for r in start], dtype=np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    if not start:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    blocks = durable(blocks_of(kept, width))
    for _ in range(rounds):
        books = moved(blocks, books)
    return coded(blocks, books), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with one more column, label_error: the errors of all rows of the same label."""
    total = checked_broadcast(codes.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")))
    return codes.join(total, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(durable(codes))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _rounds() -> str:
    """Each round by lists: nearest entry of every part, then floors of means."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""a{k} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT r, v.p, e, list_sum([CAST(z[1] - z[2] AS BIGINT) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)]) AS d FROM v JOIN c{k} c ON v.p = c.p) GROUP BY r, p)""")
        if k < ROUNDS:
            out.append(f"""c{k + 1} AS (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM (
  SELECT p, e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT a.p, a.e, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS i FROM a{k} a JOIN v USING (r, p)) GROUP BY p, e, i) GROUP BY p, e) n USING (p, e))""")
    return ",\n".join(out)


#: The rounds written out, one after another.
OP13_SQL = f"""
WITH g AS (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r FROM g),
v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS x FROM o, (SELECT CAST(unnest(range({PARTS})) AS INTEGER) AS p)),
c0 AS (SELECT p, r - 1 AS e, x FROM v WHERE r <= {ENTRIES}),
{_rounds()},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}),
s AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN s USING (r), h
"""
