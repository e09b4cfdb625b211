"""Multinomial bootstrap counts by recursive binomial splitting, so that no task needs another's draws.

A replicate deals n draws over n units, numbered from 0. A range of units that has c draws gives its
lower half Binomial(c, its share) of them, the upper half the rest, and so on down to single units:
the counts are multinomial whatever the order of splitting. The split of a range is drawn by md5 of
seed, stratum, range and replicate, by inversion of the binomial's distribution, so a task that needs
some units' counts of all replicates walks down to these units alone and finds what any other task
would. No rows by unit and replicate are ever made, moved or joined. A task goes along a range of units
and keeps the splits above it; rows that are then sorted by score bring their unit's counts along, packed
(some bits a replicate), so counts are drawn once.
"""

from __future__ import annotations

import math
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import md5_words
from ..storage import durable

#: Rows whose units' packed counts are held at a time, and units whose counts are where rows are summed at once;
#: draws up to which splits come from one table, and its steps along the uniform number.
AT_A_TIME, UNITS, FEW, STEPS = 256, 1024, 32, 1024
#: Least size of a range whose split is kept for the units that come next, and how many are.
WIDE, KEPT = 64, 96


def uniforms(keys: list[str], replicates: int) -> np.ndarray:
    """(keys, replicates): numbers strictly between 0 and 1, 32 bits of md5 each, four a digest."""
    words = md5_words([f"{key}:".encode() for key in keys], np.arange(-(-replicates // 4)))
    return (words.reshape(len(keys), -1)[:, :replicates] + 0.5) / 2.0**32


def binomial_cdf(c: int, half: int, size: int) -> tuple[int, np.ndarray]:
    """(first, chances of first, first + 1, ... successes or fewer) of c trials with a chance of half / size; those before are below 1e-20."""
    p = half / size
    spread = 10 * math.sqrt(c * p * (1 - p)) + 40
    first, last = max(0, int(c * p - spread)), min(c - 1, int(c * p + spread))
    j = np.arange(first, last, dtype=np.float64)
    start = math.lgamma(c + 1) - math.lgamma(first + 1) - math.lgamma(c - first + 1) + first * math.log(p) + (c - first) * math.log(1 - p)
    steps = np.log((c - j) / (j + 1)) + math.log(p) - math.log(1 - p)
    return first, np.cumsum(np.exp(start + np.concatenate([[0.0], np.cumsum(steps)])))


#: binomial_cdf of few trials, which come again and again.
held_cdf = lru_cache(maxsize=4096)(binomial_cdf)


@lru_cache(maxsize=64)
def few_cdfs(half: int, size: int) -> np.ndarray:
    """binomial_cdf of 0 to FEW trials as rows, ones behind."""
    out = np.ones((FEW + 1, FEW))
    for c in range(1, FEW + 1):
        out[c, :c] = binomial_cdf(c, half, size)[1]
    return out


@lru_cache(maxsize=64)
def few_steps(half: int, size: int) -> np.ndarray:
    """(draws, step) -> successes, for 0 to FEW draws and numbers within this step of [0, 1); -1 where the number itself decides."""
    edges = np.arange(STEPS + 1) / STEPS
    at = np.array([np.searchsorted(cdf, edges, side="left") for cdf in few_cdfs(half, size)])
    return np.where(at[:, :-1] == at[:, 1:], at[:, :-1], -1).astype(np.int8).ravel()


def lower_half(c: np.ndarray, half: int, size: int, u: np.ndarray) -> np.ndarray:
    """How many of c draws fall into the lower `half` of `size` units: the number of successes whose chance, with all below, is less than u."""
    k = few_steps(half, size)[np.minimum(c, FEW) * STEPS + (u * STEPS).astype(np.int64)].astype(np.int64)
    near = np.flatnonzero((k < 0) & (c <= FEW))
    k[near] = (few_cdfs(half, size)[c[near]] < u[near, None]).sum(axis=1)
    many = np.flatnonzero(c > FEW)
    many = many[np.argsort(c[many], kind="stable")]
    values, starts = np.unique(c[many], return_index=True)
    for v, own in zip(values.tolist(), np.split(many, starts[1:])):
        first, cdf = (held_cdf if v < 2048 else binomial_cdf)(v, half, size)
        k[own] = first + np.searchsorted(cdf, u[own], side="left")
    return np.minimum(k, c)


#: Splits of wide ranges that this process met last: (seed, units, replicates, range) -> draws in the lower half.
_splits: OrderedDict[tuple, np.ndarray] = OrderedDict()


def unit_weights(units: np.ndarray, n: int, replicates: int, seed: str) -> np.ndarray:
    """(units, replicates) int64: how often each of these units (sorted, of 0 to n - 1) is drawn. Ranges are split level by level, those of a level together."""
    out = np.zeros((len(units), replicates), dtype=np.int64)
    todo = [(0, n, np.full(replicates, n, dtype=np.int64), 0, len(units))] if len(units) else []
    while todo:
        for lo, hi, c, i, _ in todo:
            if hi - lo == 1:
                out[i] = c
        todo = [x for x in todo if x[1] - x[0] > 1]
        lower: dict[int, np.ndarray] = {}
        for at, (lo, hi, *_) in enumerate(todo):
            key = (seed, n, replicates, lo, hi)
            if key in _splits:
                _splits.move_to_end(key)
                lower[at] = _splits[key]
        new = [at for at in range(len(todo)) if at not in lower]
        for size in {todo[at][1] - todo[at][0] for at in new}:
            like = [at for at in new if todo[at][1] - todo[at][0] == size]
            u = uniforms([f"{seed}:{todo[at][0]}:{todo[at][1]}" for at in like], replicates)
            k = lower_half(np.concatenate([todo[at][2] for at in like]), size // 2, size, u.ravel()).reshape(len(like), replicates)
            for at, own in zip(like, k):
                lower[at] = own
                if size >= WIDE:
                    _splits[(seed, n, replicates, *todo[at][:2])] = own.copy()
                    if len(_splits) > KEPT:
                        _splits.popitem(last=False)
        below = []
        for at, (lo, hi, c, i, j) in enumerate(todo):
            mid = lo + (hi - lo) // 2
            m = i + int(np.searchsorted(units[i:j], mid))
            if i < m:
                below.append((lo, mid, lower[at], i, m))
            if m < j:
                below.append((mid, hi, c - lower[at], m, j))
        todo = below
    return out


def weights_of(rows: pd.DataFrame, strata: list[str], replicates: int, seed: str) -> np.ndarray:
    """(rows, replicates) of rows with strata, unit_no and n_units."""
    out = np.zeros((len(rows), replicates), dtype=np.int64)
    parts = rows.groupby(strata, dropna=False, sort=False).indices.items() if strata else [((), np.arange(len(rows)))]
    for key, at in parts:
        units, back = np.unique(rows["unit_no"].to_numpy()[at], return_inverse=True)
        names = [str(k) for k in (key if isinstance(key, tuple) else (key,))]
        out[at] = unit_weights(units, int(rows["n_units"].iloc[at[0]]), replicates, ":".join([seed, *names]))[back]
    return out


def unit_batches(rows: pd.DataFrame, strata: list[str]) -> Iterator[tuple[list[str], pd.DataFrame]]:
    """(stratum, rows) of at most UNITS units of rows in the order of strata and units."""
    parts = rows.groupby(strata, dropna=False, sort=False).indices.items() if strata else [((), np.arange(len(rows)))]
    for key, at in parts:
        own = rows.iloc[at]
        nth = np.cumsum(np.diff(own["unit_no"].to_numpy(), prepend=own["unit_no"].iloc[:1]) != 0) // UNITS
        for lo, hi in zip(first := np.flatnonzero(np.diff(nth, prepend=-1)), [*first[1:], len(own)]):
            yield [str(k) for k in (key if isinstance(key, tuple) else (key,))], own.iloc[lo:hi]


def with_unit_totals(rows: DataFrame, units: DataFrame, strata: list[str], unit: str) -> DataFrame:
    """rows with unit_no and n_units, from units (strata, unit, unit_no)."""
    n = units.groupBy(*strata).agg(F.count("*").alias("n_units"))  # a row a stratum
    rows = rows.join(units, [*strata, unit])
    return rows.join(F.broadcast(n), strata) if strata else rows.crossJoin(F.broadcast(n))


def tasks_of(df: DataFrame) -> int:
    """A number of ranges that Spark does not make fewer of for small rows: each row is thousands of draws."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _by_unit(rows: DataFrame, columns: list[str], strata: list[str]) -> DataFrame:
    """These columns of rows, dealt by ranges of units, in their order."""
    return rows.select(*dict.fromkeys(columns)).repartitionByRange(tasks_of(rows), *[F.col(s) for s in strata], F.col("unit_no")).sortWithinPartitions(*strata, "unit_no")


def pack(counts: np.ndarray) -> bytes:
    """Counts of all replicates as bytes; those of 256 or more take two or four bytes each."""
    return zlib.compress(counts.astype(next(t for t in ("<u1", "<u2", "<u4") if counts.max(initial=0) <= np.iinfo(t).max)).tobytes(), 1)


def unpack(packed: bytes, replicates: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, dtype=f"<u{len(raw) // replicates}")


def resampled_sums(rows: DataFrame, groups: list[str], values: list[str], replicates: int, seed: str, strata: list[str]) -> DataFrame:
    """groups, replicate, values: sums of rows (groups, strata, unit_no, n_units, values) under each replicate's counts. A task tells a row a group and replicate."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for stratum, rows in unit_batches(batch, strata):
                units, back = np.unique(rows["unit_no"].to_numpy(), return_inverse=True)
                w = unit_weights(units, int(rows["n_units"].iloc[0]), replicates, ":".join([seed, *stratum])).astype(np.float64)
                for key, own in rows.groupby(groups, dropna=False, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    at, v = np.unique(back[own]), np.zeros((len(units), len(values)))
                    np.add.at(v, back[own], rows[values].to_numpy(np.float64)[own])
                    got = v.T @ w if 2 * len(at) > len(units) else v[at].T @ w[at]
                    held[key] = held[key] + got if key in held else got
        for key, got in held.items():
            yield pd.DataFrame({**{g: [k] * replicates for g, k in zip(groups, key)}, "replicate": np.arange(replicates), **dict(zip(values, got))})

    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["replicate long"] + [f"`{v}` double" for v in values])
    return _by_unit(rows, [*groups, *strata, "unit_no", "n_units", *values], strata).mapInPandas(run, schema).groupBy(*groups, "replicate").agg(*[F.sum(v).alias(v) for v in values])


def _weighted(batches: Iterator[pd.DataFrame], groups: list[str], replicates: int) -> Iterator[tuple]:
    """(group, score, pos, neg) of the runs of equal scores in batches that come in order; pos and neg by replicate. A run may be told in pieces."""
    for batch in batches:
        for at in range(0, len(batch), AT_A_TIME):
            b = batch.iloc[at : at + AT_A_TIME].reset_index(drop=True)
            w = np.stack([unpack(x, replicates) for x in b["w"]]).astype(np.float64)
            keys = list(b[groups].itertuples(index=False, name=None)) if groups else [()] * len(b)
            score, pos, neg = (b[c].to_numpy(np.float64) for c in ("score", "pos", "neg"))
            cut = [0, *(i for i in range(1, len(b)) if keys[i] != keys[i - 1] or score[i] != score[i - 1]), len(b)]
            for i, j in zip(cut, cut[1:]):
                yield keys[i], float(score[i]), pos[i:j] @ w[i:j], neg[i:j] @ w[i:j]


def ranged(rows: DataFrame, groups: list[str], replicates: int, seed: str, strata: list[str]) -> DataFrame:
    """rows with w, their unit's packed counts, and `part`, the range of (groups, score, unit) that they are dealt to, in order within it; durable."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_A_TIME):
                b = batch.iloc[at : at + AT_A_TIME].reset_index(drop=True)
                yield b.assign(w=[pack(c) for c in weights_of(b, strata, replicates, seed)])

    columns = list(dict.fromkeys([*groups, *strata, "unit_no", "n_units", "score", "pos", "neg"]))
    order = [F.col(c) for c in (*groups, "score", *strata, "unit_no")]
    rows = _by_unit(rows.where(F.col("score").isNotNull() & ~F.isnan("score")), columns, strata)
    rows = durable(rows.mapInPandas(run, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["w binary"])))
    return durable(rows.repartitionByRange(tasks_of(rows), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def stretches(ranged: DataFrame, groups: list[str], replicates: int) -> DataFrame:
    """groups, replicate, at, tie, part, p, n, u, durable: by replicate the sums of stretches of scores, in the order of `at`.

    A tied score may be in several tasks: a task tells its first and its last score apart (tie), which are
    then summed, and all scores between them as one stretch, with u, its own pairs: some three rows a task
    and replicate.
    """
    kinds = dict(ranged.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero, part = np.zeros(replicates), []
        key, first, inner, last = None, None, None, None  # (score, p, n, u)

        def flush() -> Iterator[pd.DataFrame]:
            for x, tie in ((first, True), (inner, False), (last, True)):
                if x is not None:
                    yield pd.DataFrame({**{g: [k] * replicates for g, k in zip(groups, key)}, "at": x[0], "tie": tie, "part": part[0], "replicate": np.arange(replicates), "p": x[1], "n": x[2], "u": x[3]})

        def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    part[:] = [int(b["part"].iloc[0])]
                    yield b

        for this, score, p, n in _weighted(seen(batches), groups, replicates):
            if this != key:
                yield from flush()
                key, first, inner, last = this, None, None, None
            if last is not None and last[0] == score:
                last = (score, last[1] + p, last[2] + n, zero)
                continue
            if last is not None and first is None:
                first = last
            elif last is not None:
                s, ip, in_, iu = inner or (last[0], zero, zero, zero)
                inner = (s, ip + last[1], in_ + last[2], iu + last[1] * (in_ + last[2] / 2))
            last = (score, p, n, zero)
        yield from flush()

    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["at double", "tie boolean", "part int", "replicate long", "p double", "n double", "u double"])
    out = ranged.mapInPandas(run, schema).groupBy(*groups, "replicate", "at", "tie").agg(F.min("part").alias("part"), *[F.sum(c).alias(c) for c in "pnu"])
    return durable(out)


def resampled_auc(rows: DataFrame, groups: list[str], replicates: int, seed: str, strata: list[str], held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """groups, replicate, auc of rows (groups, strata, unit_no, n_units, score, pos, neg) under each replicate's counts; ties count half; replicates of one class have none.

    held: ranged() rows and their stretches(), if other metrics want them too.
    """
    parts = held[1] if held else stretches(ranged(rows, groups, replicates, seed, strata), groups, replicates)
    before = W.partitionBy(*groups, "replicate").orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # some three rows a task
    pairs = F.when(F.col("tie"), F.col("p") * F.col("n") / 2).otherwise(F.col("u")) + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0))
    out = parts.withColumn("pairs", pairs).groupBy(*groups, "replicate").agg(F.sum("pairs").alias("pairs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.where("p > 0 and n > 0").select(*groups, "replicate", (F.col("pairs") / (F.col("p") * F.col("n"))).alias("auc"))


def resampled_ap(rows: DataFrame, groups: list[str], replicates: int, seed: str, strata: list[str], held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """groups, replicate, ap: step-wise average precision of the same rows; a tied score is one threshold.

    What stands above a stretch is known from the stretches' sums; each task then goes down its own scores from there.
    """
    own = held[0] if held else ranged(rows, groups, replicates, seed, strata)
    parts = held[1] if held else stretches(own, groups, replicates)
    above = W.partitionBy(*groups, "replicate").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)  # some three rows a task
    parts = durable(parts.withColumns({"tp": F.coalesce(F.sum("p").over(above), F.lit(0.0)), "fp": F.coalesce(F.sum("n").over(above), F.lit(0.0))}))
    t = F.col("tp") + F.col("p")
    ties = parts.where("tie and p > 0").select(*groups, "replicate", (F.col("p") * t / (t + F.col("fp") + F.col("n"))).alias("s"))
    total = parts.groupBy(*groups, "replicate").agg(F.sum("p").alias("p"))
    ends = own.groupBy(*groups, "part").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    heads = parts.where("not tie").groupBy(*groups, "part").agg(F.array_sort(F.collect_list(F.struct("replicate", "tp", "fp"))).alias("r"))  # a row a replicate
    heads = heads.join(ends, [*groups, "part"]).select(*groups, "part", "lo", "hi", F.col("r.tp").alias("tp"), F.col("r.fp").alias("fp"), F.lit(0).alias("kind"))
    both = own.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    kinds = dict(own.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads: dict[tuple, tuple] = {}

        def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = b.groupby(["part", *groups], dropna=False, sort=False).indices
                for place, own in sorted(at.items(), key=lambda x: x[1][0]):
                    rows = b.iloc[own]
                    place = place if isinstance(place, tuple) else (place,)
                    head = rows[rows["kind"] == 0]
                    if len(head):
                        heads[place] = (head["lo"].iloc[0], head["hi"].iloc[0], np.array(head["tp"].iloc[0]), np.array(head["fp"].iloc[0]))
                    if place in heads:
                        lo, hi, *_ = heads[place]
                        rows = rows[(rows["kind"] == 1) & (rows["score"] > lo) & (rows["score"] < hi)]
                        if len(rows):
                            now[:] = [place]
                            yield rows

        now: list[tuple] = []
        held: dict[tuple, list] = {}
        for key, score, p, n in _weighted(inside(batches), groups, replicates):
            place = now[0]
            if place not in held:
                held[place] = [*heads[place][2:], np.zeros(replicates), score, np.zeros(replicates), np.zeros(replicates)]
            x = held[place]
            if x[3] != score:  # the score before is complete
                _step(x)
                x[3] = score
            x[4] = x[4] + p
            x[5] = x[5] + n
        for place, x in held.items():
            _step(x)
            yield pd.DataFrame({**{g: [k] * replicates for g, k in zip(groups, place[1:])}, "replicate": np.arange(replicates), "s": x[2]})

    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["replicate long", "s double"])
    dealt = both.repartition(tasks_of(both), "part").sortWithinPartitions("part", *groups, "kind", F.desc("score"), *strata, "unit_no")
    every = ties.unionByName(dealt.mapInPandas(run, schema)).groupBy(*groups, "replicate").agg(F.sum("s").alias("s"))
    return total.where("p > 0").join(every, [*groups, "replicate"]).select(*groups, "replicate", (F.col("s") / F.col("p")).alias("ap"))


def _step(x: list) -> None:
    """Adds a threshold to [true and false positives above, sum, score, its positives, its negatives]."""
    x[0], x[1] = x[0] + x[4], x[1] + x[5]
    x[2] = x[2] + np.divide(x[4] * x[0], x[0] + x[1], out=np.zeros(len(x[0])), where=x[4] > 0)
    x[4], x[5] = np.zeros(len(x[0])), np.zeros(len(x[0]))


def counts_sql(units: str, strata: list[str], seed: str, replicates: int, levels: int = 20) -> str:
    """CTEs that end in w (strata, replicate, unit_no, w) of the table `units` (strata, unit_no), all splits level by level; up to 2 ** levels units."""
    s = "".join(f"{x}, " for x in strata)
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({x} AS VARCHAR)" for x in strata], "lo", "hi", "(replicate // 4)"])
    u = f"(CAST('0x' || substr(md5({text}), CAST(8 * (replicate % 4) + 1 AS INTEGER), 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)"
    chance = "exp(lgamma(c + 1) - lgamma(j + 1) - lgamma(c - j + 1) + j * ln(CAST(half AS DOUBLE) / size) + (c - j) * ln(1 - CAST(half AS DOUBLE) / size))"
    out = [f"t0 AS MATERIALIZED (SELECT {s}replicate, CAST(0 AS BIGINT) AS lo, n AS hi, n AS c FROM (SELECT {s}count(*) AS n FROM {units} {'GROUP BY ' + s[:-2] if s else ''}), range({replicates}) r(replicate))"]
    for k in range(levels):
        out.append(f"""s{k} AS MATERIALIZED (SELECT *, (hi - lo) // 2 AS half, hi - lo AS size, {u} AS u FROM t{k} WHERE hi - lo > 1 AND c > 0),
f{k} AS MATERIALIZED (SELECT c, half, size, list(cdf ORDER BY j) AS cdfs FROM (SELECT c, half, size, j, sum({chance}) OVER (PARTITION BY c, half, size ORDER BY j) AS cdf
  FROM (SELECT *, unnest(range(c)) AS j FROM (SELECT DISTINCT c, half, size FROM s{k}))) GROUP BY ALL),
g{k} AS MATERIALIZED (SELECT s{k}.*, CAST(len(list_filter(cdfs, lambda z: z < u)) AS BIGINT) AS k FROM s{k} JOIN f{k} USING (c, half, size)),
t{k + 1} AS MATERIALIZED (SELECT {s}replicate, lo, lo + half AS hi, k AS c FROM g{k} UNION ALL SELECT {s}replicate, lo + half, hi, c - k FROM g{k})""")
    leaves = " UNION ALL ".join(f"SELECT {s}replicate, lo AS unit_no, c AS w FROM t{k} WHERE hi - lo = 1 AND c > 0" for k in range(levels + 1))
    return ",\n".join([*out, f"w AS MATERIALIZED ({leaves})"])
