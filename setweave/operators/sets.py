"""Operators over item sets in long form (set_id, item_id): canonical sets, pairs, modes, joins with checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import before, durable, ranges, running

#: Most rows whose dominators are listed, which compares them pair by pair.
PAIRED = 20_000


def canonical(items: DataFrame, set_id: str = "set_id", item_id: str = "item_id") -> DataFrame:
    """set_id, items: sorted distinct items of each set (sets are of bounded size)."""
    return items.groupBy(set_id).agg(F.array_sort(F.collect_set(item_id)).alias("items"))


def dedup_first(sets: DataFrame, order: list[str], key: str = "items") -> DataFrame:
    """key, kept_set_id, n_sets: of equal canonical sets the first by order stays."""
    return sets.groupBy(key).agg(F.min_by("set_id", F.struct(*order)).alias("kept_set_id"), F.count("*").alias("n_sets"))


def pairs(items: DataFrame, set_id: str, index: str, value: str) -> DataFrame:
    """set_id, a, b: values of all pairs with index i < j of each set (sets are of bounded size)."""
    a = items.select(set_id, F.col(index).alias("_i"), F.col(value).alias("a"))
    b = items.select(set_id, F.col(index).alias("_j"), F.col(value).alias("b"))
    return a.join(b, set_id).where("_i < _j").select(set_id, "a", "b")


def pair_means(v: np.ndarray) -> np.ndarray:
    """(sets, 2 * width): the mean over pairs of |a - b|, then of a * b, of sets (sets, n, width) of n vectors each.

    Without making pairs: by dimension, differences follow from the sorted values (the k-th of n counts 2k - n + 1
    times), products from the sum and the sum of squares.
    """
    n = v.shape[1]
    times = 2.0 * np.arange(n) - n + 1
    apart = np.einsum("k,skd->sd", times, np.sort(v, axis=1))
    total = v.sum(axis=1)
    return np.concatenate([apart, (total * total - np.einsum("skd,skd->sd", v, v)) / 2], axis=1) / max(1.0, n * (n - 1) / 2)


def features(items: DataFrame, set_id: str, value: str, table=None) -> DataFrame:
    """set_id, n_pairs, feature: the mean over pairs of |a - b| followed by that of a * b, of sets of two or more items. Sets are of bounded size.

    Sets of like size are one matrix to NumPy; vectors of different widths in a set, and null components, are errors. With a
    vector_table(), values are codes that are looked up in it.
    """

    @F.pandas_udf("array<double>")
    def told(sets_: pd.Series) -> pd.Series:
        of, out, like = list(sets_), [None] * len(sets_), {}
        for i, vs in enumerate(of):
            widths = {len(v) for v in vs} if table is None else {table.value[1].shape[1]}
            if len(widths) != 1:
                raise ValueError("vectors of different widths")
            like.setdefault((len(vs), widths.pop()), []).append(i)
        for at in like.values():
            for k in range(0, len(at), 512):
                some = at[k : k + 512]
                if table is None:
                    v = np.stack([np.stack(list(of[i])).astype(np.float64) for i in some])
                else:
                    v = table.value[1][np.searchsorted(table.value[0], np.stack([of[i] for i in some]))]
                for i, f in zip(some, pair_means(v)):
                    out[i] = f
        return pd.Series(out, dtype=object)

    x = items.groupBy(set_id).agg(F.collect_list(value).alias("vs")).withColumn("n", F.size("vs")).where("n >= 2")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return x.select(set_id, pairs.cast("long").alias("n_pairs"), told("vs").alias("feature"))


def mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n, n_values: the most frequent value, the least of tied ones."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = F.min_by(value, F.struct((-F.col("n")).alias("a"), F.col(value).alias("b")))
    return n.groupBy(key).agg(best.alias(value), F.max("n").alias("n"), F.count("*").alias("n_values"))


def validated_left_join(left: DataFrame, right: DataFrame, keys: list[str], must: str) -> DataFrame:
    """A left join that fails unless keys are unique on both sides and every left row finds `must`.

    The checks are part of the plan: a duplicated key or a missing row raises when it runs.
    """

    def once(df: DataFrame, side: str) -> DataFrame:
        w = W.partitionBy(*keys)
        n = F.count("*").over(w)
        check = F.when(n > 1, F.raise_error(F.lit(f"duplicate key on the {side}")).cast("int")).otherwise(F.lit(1))
        return df.withColumn(f"_{side}", check).where(f"_{side} = 1").drop(f"_{side}")

    out = once(left, "left").join(once(right, "right"), keys, "left")
    return out.withColumn(must, F.when(F.col(must).isNull(), F.raise_error(F.lit("unmatched key"))).otherwise(F.col(must)))


def dominated(df: DataFrame, key: str, metric: str, cost: str) -> DataFrame:
    """key, metric, cost, dominated, dominators: others no worse in both and better in one (metric high, cost low)."""
    if df.limit(PAIRED + 1).count() > PAIRED:
        raise ValueError(f"dominators are listed for {PAIRED} rows at most: every pair is compared")
    a = df.select(F.col(key), F.col(metric), F.col(cost))
    b = df.select(F.col(key).alias("_k"), F.col(metric).alias("_m"), F.col(cost).alias("_c"))
    on = (F.col("_m") >= F.col(metric)) & (F.col("_c") <= F.col(cost)) & ((F.col("_m") > F.col(metric)) | (F.col("_c") < F.col(cost)))
    out = a.join(b, on, "left").groupBy(key, metric, cost).agg(F.array_join(F.array_sort(F.collect_list("_k")), ";").alias("dominators"))
    return out.withColumn("dominated", F.col("dominators") != "")


def rejoined(df: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns that told has for its keys, null keys too."""
    told = told.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(told, same).drop(*[f"_k{i}" for i in range(len(keys))])


def pareto_flags(df: DataFrame, metric: str, cost: str) -> DataFrame:
    """df with dominated: whether another row is no worse in both and better in one (metric high, cost low).

    A row is dominated if the best metric of any lower cost is as good, or that of its own cost is better: a running
    maximum over the distinct costs, no pairs of rows. Rows with a null in either are dominated by none and dominate none.
    """
    best = df.where(F.col(metric).isNotNull() & F.col(cost).isNotNull()).groupBy(cost).agg(F.max(metric).alias("_best"))
    best = before(ranges(best, [], F.col(cost)), [], [F.col(cost)], {"_lower": ("max", F.col("_best"))}).drop("_part")
    best = durable(best).withColumnRenamed(cost, "_c")
    out = df.join(best, F.col(cost) == F.col("_c"), "left")
    return out.withColumn("dominated", F.coalesce((F.col("_lower") >= F.col(metric)) | (F.col("_best") > F.col(metric)), F.lit(False))).drop("_c", "_best", "_lower")


def ranks(df: DataFrame, groups: list[str], value: str, descending: bool = True) -> DataFrame:
    """df with rank_min (1 + rows that are better) and rank_avg (the mean place of equal values) within its group; nulls come last.

    Equal values are counted first and places are running sums over the distinct values, so a group, or a tie, of any
    size is no task's own.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    n = running(df.groupBy(*groups, value).agg(F.count("*").alias("_n")), groups, order, {"_before": "_n"})
    places = durable(n.select(*groups, value, (F.col("_before") + 1).alias("rank_min"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("rank_avg")))
    return rejoined(df, places, [*groups, value])


def largest_remainder(counts: DataFrame, key: str, n: str, whole: int) -> DataFrame:
    """key, target: whole dealt in proportion to n, remainders to the largest, ties by key. One row a key."""
    share = F.col(n) * F.lit(float(whole)) / F.sum(n).over(W.partitionBy(F.lit(1)))
    c = counts.withColumn("_x", share).withColumn("_f", F.floor("_x"))
    left = F.lit(whole) - F.sum("_f").over(W.partitionBy(F.lit(1)))
    rn = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), key))
    return c.withColumn("_left", left).withColumn("_rn", rn).select(key, (F.col("_f") + (F.col("_rn") <= F.col("_left")).cast("long")).alias("target"))


def average_rank(score: str, *groups: str, descending: bool = True) -> Column:
    order = F.desc(score) if descending else F.asc(score)
    return F.rank().over(W.partitionBy(*groups).orderBy(order)) + (F.count("*").over(W.partitionBy(*groups, score)) - 1) / 2


def holm(df: DataFrame, p: str, key: str, *groups: str) -> DataFrame:
    """Adds p_adjusted: Holm's step-down within each family, a running maximum clipped at 1; families of any size, over ranges of (p, key), which is unique."""
    order, families = [F.col(p), F.col(key)], list(groups)
    rows = before(ranges(df, families, *order), families, order, {"_nth": ("sum", F.lit(1).cast("long"))})
    m = durable(df.groupBy(*families).agg(F.count("*").alias("_m")))
    rows = rejoined(rows, m, families).withColumn("_step", (F.col("_m") - F.col("_nth")) * F.col(p))
    out = before(rows, families, order, {"_max": ("max", F.col("_step"))})
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.greatest("_max", "_step"))).drop("_part", "_nth", "_m", "_step", "_max")
