"""Exact quantiles of groups of any size by refining histograms."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..storage import durable
from .sets import rejoined

#: Leading bits of a number that a pass adds; distinct values up to which an interval is put in order.
BITS, FEW = 12, 4096


@F.pandas_udf(LongType())
def sortable(v: pd.Series) -> pd.Series:
    """The bits of a double as a long that has its order."""
    b = v.to_numpy(np.float64).view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(2**63 - 1)))


def quantiles(df: DataFrame, groups: list[str], value: str, qs: list[float], bits: int = BITS, few: int = FEW) -> DataFrame:
    """groups, q, value of the quantiles qs of each group, by linear interpolation between neighbours (numpy's default); nulls and NaN do not count.

    Each wanted place has an interval that holds it: numbers that agree in their leading bits, at first in none. A pass
    counts an interval's values by `bits` more bits and goes on with the part that holds the place, until that is one
    value or holds at most `few` distinct ones, which are then put in order. So 64 / bits passes are the most, whatever
    the values; equal values are one row from the start.
    """
    v = F.col(value).cast("double")
    x = df.select(*groups, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*groups, "v").agg(F.count("*").alias("n"))
    x = durable(x.withColumn("b", sortable("v")))
    g = x.groupBy(*groups).agg(F.sum("n").alias("rows"), F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.col("q") * (F.col("rows") - 1)
    g = g.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("share", at - F.floor(at))
    g = g.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rank", F.least(F.floor(at) + F.col("side"), F.col("rows") - 1))
    names = [*groups, "q", "share", "side", "rank", "inside", "lo", "hi", "head"]
    todo = durable(g.withColumn("head", F.lit(0).cast("long")).select(*names))
    keys, shift, found = [*groups, "head"], 64, []
    while True:
        # the interval of a number is its leading bits
        held = x.withColumn("head", F.shiftright("b", shift) if shift < 64 else F.lit(0).cast("long"))
        one, wide = F.col("lo") == F.col("hi"), todo.where((F.col("lo") < F.col("hi")) & (F.col("inside") > few))
        found.append(todo.where(one).select(*groups, "q", "share", "side", F.col("lo").alias("v")))
        small = todo.where(~one & (F.col("inside") <= few))
        rows = rejoined(held, small.select(*keys).distinct(), keys)
        upto = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # `few` rows
        rows = rows.withColumn("from", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        place = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("from") + F.col("n"))
        found.append(rejoined(small, rows, keys).where(place).select(*groups, "q", "share", "side", "v"))
        if shift == 0 or wide.isEmpty():
            break
        shift = max(0, shift - bits)
        rows = rejoined(held, wide.select(*keys).distinct(), keys)
        h = rows.withColumn("part", F.shiftright("b", shift)).groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.count("*").alias("_inside"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        upto = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # 2 ** bits rows
        h = h.withColumn("from", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        met = rejoined(wide, h, keys).where(place).withColumn("rank", F.col("rank") - F.col("from"))
        todo = durable(met.drop("inside", "lo", "hi", "head").withColumnsRenamed({"_inside": "inside", "_lo": "lo", "_hi": "hi", "part": "head"}).select(*names))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    two = out.groupBy(*groups, "q").agg(F.max("share").alias("share"), F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    return two.select(*groups, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))
