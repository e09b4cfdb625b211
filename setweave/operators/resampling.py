"""Units, intervals and p-values of the bootstrap (its counts: multinomial.py; by facet: resampled_shares), and agreement statistics.

Resamples are weights of rows that were summed by unit first; no replicate's rows are made one by one.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import md5_words
from ..storage import durable, numbered
from .multinomial import tasks_of

#: Units at a time (whole bytes of bits), and replicates of a task.
BLOCK, AT_ONCE = 4096, 16


def numbered_units(rows: DataFrame, unit: str, strata: list[str]) -> DataFrame:
    """strata, unit, unit_no: the distinct units of rows, numbered from 0 within their stratum."""
    units = numbered(rows.select(*strata, unit).distinct(), "no", *[F.col(c) for c in (*strata, unit)])
    first = units.groupBy(*strata).agg(F.min("no").alias("first"))  # a row a stratum
    units = units.join(F.broadcast(first), strata) if strata else units.crossJoin(F.broadcast(first))
    return units.select(*strata, unit, (F.col("no") - F.col("first")).alias("unit_no"))


def resampled_shares(outcomes: DataFrame, group: str, unit: str, ok: str, replicates: int, seed: str) -> DataFrame:
    """group, replicate, share: of as many draws as the group has units (one row each), how many meet one with ok (0 or 1), over their number.

    Draw k of a replicate is that of keys.draw(seed, group, replicate, k), modulo the units, which are numbered in order. A task
    has some replicates of a group, counts along its draws and looks them up in the group's outcomes, a bit each: no row a draw is made.
    """
    o = outcomes.where(F.col(group).isNotNull())
    o = o.join(numbered_units(o, unit, [group]), [group, unit]).select(F.col(group).alias("g"), "unit_no", F.col(ok).cast("int").alias("ok"))
    n = o.groupBy("g").agg(F.count("*").alias("n"))  # a row a group

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(np.fromiter((r["ok"] for r in x), dtype=np.uint8, count=len(x))).tobytes() for x in rows])

    part = o.groupBy("g", F.floor(F.col("unit_no") / BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct("unit_no", "ok"))).alias("rows")).select("g", "b", packed("rows").alias("bits"))
    bits = durable(part.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("b", "bits"))).alias("x")).join(n, "g").select("g", "n", F.col("x.bits").alias("bits")))  # a bit a unit
    tasks = bits.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(AT_ONCE)))).repartition(4 * tasks_of(bits), "g", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, n, bits, first in zip(b["g"], b["n"], b["bits"], b["first"]):
                held = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8))[:n]
                own = np.arange(first, min(first + AT_ONCE, replicates))
                prefixes, hits = [f"{seed}:{g}:{k}:".encode() for k in own], np.zeros(len(own), dtype=np.int64)
                for at in range(0, n, BLOCK):
                    drawn = md5_words(prefixes, np.arange(at, min(n, at + BLOCK)), 1)[:, :, 0] % np.uint32(n)
                    hits += held[drawn].sum(axis=1, dtype=np.int64)
                yield pd.DataFrame({group: g, "replicate": own, "share": hits / n})

    return tasks.mapInPandas(run, f"`{group}` {dict(outcomes.dtypes)[group]}, replicate long, share double")


def interval(df: DataFrame, groups: list[str], value: str, level: float = 0.95) -> DataFrame:
    """ci_low, ci_high by linear interpolation."""
    a = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return df.groupBy(*groups).agg(q[0].alias("ci_low"), q[1].alias("ci_high"))


def two_sided_p(df: DataFrame, groups: list[str], diff: str) -> DataFrame:
    """min(1, 2 (min(#<=0, #>=0) + 1) / (B + 1))."""
    tail = F.least(F.count_if(F.col(diff) <= 0), F.count_if(F.col(diff) >= 0))
    return df.groupBy(*groups).agg(F.least(F.lit(1.0), 2.0 * (tail + 1) / (F.count("*") + 1)).alias("p_value"))


def binomial_p(a, b):
    """Exact two-sided sign test of a against b discordant outcomes; 1 without any."""
    n, k = (a + b).cast("int"), F.least(a, b).cast("int")
    # term k + 1 from term k: a factor (n - k) / (k + 1); in logarithms, so that no power underflows alone
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("t"), F.exp(-n * F.ln(F.lit(2.0))).alias("s"))

    def step(acc, i):
        t = acc["t"] + F.ln((n - i + 1) / i)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(terms, start, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def rank_agreement(ranks: DataFrame, keys: list[str], most: int = 7) -> DataFrame:
    """keys, n, rho, tau, rho_p, tau_p from ranks (keys, x, y: two arrays of average ranks of the same items).

    rho is Spearman's, tau Kendall's with correction for ties; both are null if all ranks of a side are equal.
    p-values are exact and two-sided, over all orders of y, of `most` items or fewer; else null.
    """
    place = lambda c, i: F.element_at(c, i)
    at = F.sequence(F.lit(1), F.size("x"))
    zero = F.lit(0.0)

    def product(a: str, b: str):
        mean = (F.size("x") + 1) / 2
        return F.aggregate(F.transform(at, lambda i: (place(a, i) - mean) * (place(b, i) - mean)), zero, lambda s, v: s + v)

    def concord(a: str, b: str):
        sign = lambda c, i, j: F.signum(place(c, i) - place(c, j))
        rows = F.transform(at, lambda i: F.aggregate(F.transform(at, lambda j: F.when(i < j, sign(a, i, j) * sign(b, i, j)).otherwise(zero)), zero, lambda s, v: s + v))
        return F.aggregate(rows, zero, lambda s, v: s + v)

    base = ranks.withColumns({"n": F.size("x"), "d": product("x", "y"), "c": concord("x", "y")})
    orders = [(k, list(p)) for k in range(2, most + 1) for p in permutations(range(1, k + 1))]  # 5,912 rows for 7
    orders = ranks.sparkSession.createDataFrame(orders, "n int, p array<int>")
    told = base.join(F.broadcast(orders), "n").withColumn("z", F.transform("p", lambda i: F.element_at("y", i)))
    told = told.groupBy(*keys).agg(*[F.avg((F.abs(f("x", "z")) >= F.abs(F.col(c))).cast("double")).alias(n) for n, f, c in (("rho_p", product, "d"), ("tau_p", concord, "c"))])
    of = lambda f, c: F.try_divide(F.col(c), F.sqrt(f("x", "x") * f("y", "y")))
    out = base.select(*keys, F.col("n").cast("long").alias("n"), of(product, "d").alias("rho"), of(concord, "c").alias("tau")).join(told, keys, "left")
    return out.withColumns({f"{c}_p": F.when(F.col(c).isNotNull(), F.col(f"{c}_p")) for c in ("rho", "tau")})
