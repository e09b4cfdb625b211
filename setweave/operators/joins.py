"""Joins with checks that are part of the plan: gathers, positional pairs, remaps over cached copies, ordered fallbacks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V


def gather(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of wanted with its row of held (keys are unique there); a key that is not held raises when the plan runs."""
    found = held.withColumn("_found", F.lit(True))
    out = wanted.join(found, keys, "left")
    check = F.when(F.col("_found").isNull(), F.raise_error(F.concat_ws(" ", F.lit("key not held:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")).otherwise(F.col("_found"))
    return out.withColumn("_found", check).where("_found").drop("_found")


def paired(one: DataFrame, two: DataFrame, groups: list[str], key: str) -> DataFrame:
    """groups, k, one, two: the k-th key of a group on one side with the k-th on the other."""
    nth = F.row_number().over(W.partitionBy(*groups).orderBy(key)).cast("long")
    a = one.select(*groups, nth.alias("k"), F.col(key).alias("one"))
    return a.join(two.select(*groups, nth.alias("k"), F.col(key).alias("two")), [*groups, "k"])


def remapped(wanted: DataFrame, cached: DataFrame, key: str, split: str, value: str, cosine: float = 0.99999, apart: float = 1e-3) -> DataFrame:
    """key, first_split, copies, held, agree of every wanted key: the copy of the first split stands, others must agree with it."""
    first = cached.groupBy(key).agg(F.min(F.struct(split, value)).alias("f"), F.count("*").alias("copies"))
    j = cached.join(first, key)
    same = (V.cosine(F.col(value), F.col("f")[value]) >= cosine) & (V.max_abs_diff(F.col(value), F.col("f")[value]) <= apart)
    agree = j.groupBy(key).agg(F.first("f")[split].alias("first_split"), F.first("copies").alias("copies"), F.bool_and(same).alias("agree"))
    out = wanted.select(key).distinct().join(agree, key, "left")
    return out.select(key, "first_split", F.coalesce("copies", F.lit(0)).alias("copies"), F.col("copies").isNotNull().alias("held"), F.coalesce("agree", F.lit(True)).alias("agree"))


def first_variant(variants: DataFrame, key: str, order: str, usable: Column, value: str) -> DataFrame:
    """key, chosen (value of the first usable variant in this order, or null), variants, usable."""
    return variants.groupBy(key).agg(F.min_by(F.when(usable, F.col(value)), F.when(usable, F.col(order))).alias("chosen"), F.count("*").alias("variants"), F.count_if(usable).alias("usable"))
