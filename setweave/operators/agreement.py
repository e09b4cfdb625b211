"""Kendall's tau of rankings of any length by counting inversions over ranges, with its null distribution.

Equal (x, y) are counted first. In the order of (x, y), a pair is discordant exactly if the order of (y, x)
turns it round, ties of either side included, so discordant pairs are the inversions between two orders
without ties. Rows are dealt by ranges of both orders. Inversions within a range of the first order, and
within a range of the second, are counted by merging in the task that holds the range; those within both
were counted twice; all others follow from the counts of rows in each pair of ranges, a table whose size
depends on the ranges alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable

#: Rows whose pairs are compared at once at the bottom of a merge; most items of an exact distribution.
BOTTOM, EXACT = 48, 170


def inversions(y: np.ndarray, w: np.ndarray) -> float:
    """The weight of all pairs i < j with y[i] > y[j], weights multiplied: halves are counted, sorted and merged."""

    def count(y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if len(y) <= BOTTOM:
            order = np.argsort(y, kind="stable")
            return float((np.triu(y[:, None] > y[None], 1) * (w[:, None] * w[None])).sum()), y[order], w[order]
        a, ya, wa = count(y[: len(y) // 2], w[: len(y) // 2])
        b, yb, wb = count(y[len(y) // 2 :], w[len(y) // 2 :])
        upto = np.concatenate([[0.0], np.cumsum(wa)])
        across = float(((upto[-1] - upto[np.searchsorted(ya, yb, side="right")]) * wb).sum())
        both, weights = np.concatenate([ya, yb]), np.concatenate([wa, wb])
        order = np.argsort(both, kind="stable")
        return a + b + across, both[order], weights[order]

    return count(np.asarray(y), np.asarray(w, dtype=np.float64))[0]


def discordant_pairs(rows: DataFrame, groups: list[str]) -> DataFrame:
    """groups, discordant of distinct rows (groups, x, y, n)."""
    rows = rows.repartitionByRange(*[F.col(g) for g in groups], F.col("x"), F.col("y")).withColumn("p", F.spark_partition_id())
    rows = rows.repartitionByRange(*[F.col(g) for g in groups], F.col("y"), F.col("x")).withColumn("q", F.spark_partition_id())
    rows = durable(rows)
    names = ", ".join(f"`{g}` {t}" for g, t in rows.select(*groups).dtypes)

    def within(keys: list[str], sign: int) -> DataFrame:
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["x", "y"])
            place = np.empty(len(part), dtype=np.int64)
            place[np.lexsort((part["x"], part["y"]))] = np.arange(len(part))
            return pd.DataFrame([[*key[: len(groups)], sign * inversions(place, part["n"].to_numpy())]])

        return rows.groupBy(*groups, *keys).applyInPandas(run, f"{names + ', ' if names else ''}d double")  # rows of a range

    def between(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((cells["p"].max() + 1, cells["q"].max() + 1))
        grid[cells["p"], cells["q"]] = cells["n"]
        above = np.zeros_like(grid)
        above[1:, :-1] = np.cumsum(np.cumsum(grid, axis=0)[:-1, ::-1], axis=1)[:, ::-1][:, 1:]
        return pd.DataFrame([[*key, float((grid * above).sum())]])

    cells = rows.groupBy(*groups, "p", "q").agg(F.sum("n").alias("n"))
    far = cells.groupBy(*groups).applyInPandas(between, f"{names + ', ' if names else ''}d double")  # ranges by ranges
    every = far.unionByName(within(["p"], 1)).unionByName(within(["q"], 1)).unionByName(within(["p", "q"], -1))
    return every.groupBy(*groups).agg(F.sum("d").alias("discordant"))


def kendall(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """groups, n, concordant, discordant, tied_x, tied_y, tau (b), p_value, p_kind of rows with numbers x and y; rows with a null in either do not count.

    tau is null if a side is all ties. p_value is two-sided, of no association: exact up to EXACT items if at most one
    side has ties, by the distribution of inversions; else by the normal approximation with its correction for ties
    (p_kind tells which); null where tau is.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    rows = durable(rows)
    pairs = lambda n: n * (n - 1) / 2.0
    v = F.col("n").cast("double")

    def ties(side: str) -> DataFrame:
        t = rows.groupBy(*groups, side).agg(F.sum("n").cast("double").alias("t"))
        t1 = F.col("t")
        sums = {"pairs": pairs(t1), "v": t1 * (t1 - 1) * (2 * t1 + 5), "triples": t1 * (t1 - 1) * (t1 - 2)}
        # the tied sizes themselves, of groups that are small enough for an exact distribution
        sizes = F.when(F.sum("t") <= EXACT, F.collect_list("t"))
        return t.groupBy(*groups).agg(*[F.sum(c).alias(f"{k}_{side}") for k, c in sums.items()], sizes.alias(f"sizes_{side}"))

    base = rows.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum(pairs(v)).alias("same"))
    join = lambda a, b: a.join(b, groups) if groups else a.crossJoin(F.broadcast(b))  # noqa: E731  (a row a group; one row without groups)
    out = join(join(join(base, ties("x")), ties("y")), discordant_pairs(rows, groups))
    total = pairs(F.col("n").cast("double"))
    agree = total - F.col("pairs_x") - F.col("pairs_y") + F.col("same") - F.col("discordant")
    out = out.withColumns({"concordant": agree, "tau": F.try_divide(agree - F.col("discordant"), F.sqrt((total - F.col("pairs_x")) * (total - F.col("pairs_y"))))})

    @F.pandas_udf("p_value double, p_kind string")
    def p_of(n: pd.Series, c: pd.Series, d: pd.Series, px: pd.Series, py: pd.Series, vx: pd.Series, vy: pd.Series, tx: pd.Series, ty: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([two_sided(*r) for r in zip(n, c, d, px, py, vx, vy, tx, ty, sx, sy)], columns=["p_value", "p_kind"])

    told = p_of("n", "concordant", "discordant", "pairs_x", "pairs_y", "v_x", "v_y", "triples_x", "triples_y", "sizes_x", "sizes_y")
    out = out.withColumn("p", F.when(F.col("tau").isNotNull(), told))
    whole = lambda c: F.col(c).cast("long")
    return out.select(*groups, whole("n").alias("n"), whole("concordant").alias("concordant"), whole("discordant").alias("discordant"), whole("pairs_x").alias("tied_x"), whole("pairs_y").alias("tied_y"), "tau", F.col("p.p_value").alias("p_value"), F.col("p.p_kind").alias("p_kind"))


def two_sided(n, c, d, px, py, vx, vy, tx, ty, sizes_x, sizes_y) -> tuple[float | None, str | None]:
    """(p, kind) of c concordant and d discordant pairs of n items; px, vx, tx: sums over ties of x of their pairs, t(t - 1)(2t + 5) and triples."""
    total = n * (n - 1) / 2
    if total - px <= 0 or total - py <= 0:
        return None, None
    if n <= EXACT and (px == 0 or py == 0):
        sizes = sizes_x if px else sizes_y
        chances = inversion_chances(tuple(sorted(int(t) for t in sizes)) if px or py else (1,) * int(n))
        far = min(c, d)  # the distribution is symmetric about half of the pairs that are not tied
        tail = chances[: int(round(far)) + 1].sum()
        return float(min(1.0, 2 * tail if 2 * far < len(chances) - 1 else 1.0)), "exact"
    var = (n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + 2 * px * py / (n * (n - 1))
    if n > 2:
        var += tx * ty / (9 * n * (n - 1) * (n - 2))
    return math.erfc(abs(c - d) / math.sqrt(var) / math.sqrt(2)), "normal"


@lru_cache(maxsize=256)
def inversion_chances(sizes: tuple[int, ...]) -> np.ndarray:
    """Chances of 0, 1, ... inversions of a random order of items with ties of these sizes.

    A block of t equal items that joins m others adds the inversions of a random choice of t of m + t places: the
    Gaussian binomial. Its chances are found place by place: a place is one of the block's with a chance of what is
    left of the block to the places left, and then all others that have come before it are inverted with it.
    """
    out, m = np.ones(1), 0
    for t in sizes:
        if m:
            out = np.convolve(out, _places(m, t))
        m += t
    return out


@lru_cache(maxsize=4096)
def _places(m: int, t: int) -> np.ndarray:
    """Chances of each number of inversions of m items, then t equal ones less than all, in random places."""
    if t == 1:
        return np.full(m + 1, 1 / (m + 1))
    # held[j]: chances of inversions with j of the block placed
    held = [np.zeros(m * t + 1) for _ in range(t + 1)]
    held[0][0] = 1.0
    for place in range(m + t):
        new = [np.zeros(m * t + 1) for _ in range(t + 1)]
        for j in range(max(0, place - m), min(t, place) + 1):
            others, left = place - j, m + t - place
            mine = (t - j) / left
            if mine < 1:
                new[j] += held[j] * (1 - mine)
            if mine > 0:
                new[j + 1][others:] += held[j][: m * t + 1 - others] * mine
        held = new
    return held[t]
