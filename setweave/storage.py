"""Durable intermediate tables in the folder that the driver and the executors share, and numbering and running aggregates over ranges."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A session that runs in one process may leave it unset and gets a folder of its own."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        given = tempfile.mkdtemp(prefix="setweave-")
    sc.setCheckpointDir(given)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage and outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Spark's setting by which an execution's shuffle files go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a DataFrame as Parquet below the shared folder and reads it back, for as long as the block runs; then all of these files go.

    Parquet takes a fraction of what a checkpoint does, and shuffle files go as soon as a table is written. Rows come
    back in other partitions, so what leans on a partition's rows or their order wants durable().
    """
    root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path, held = f"{root}/{uuid.uuid4().hex}", spark.conf.get(FREED)
        spark.conf.set(FREED, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(FREED, held)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df (made durable) with its rows numbered from 0 in this order, over ranges of it: no task needs more than its range."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = durable(rows.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(sizes), "_part")  # a row a partition
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def ranges(df: DataFrame, groups: list[str], *order: Column) -> DataFrame:
    """df (made durable) dealt by ranges of (groups, order), with the range as `_part`: what before() goes along."""
    return durable(df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_part", F.spark_partition_id()))


#: How totals of whole ranges, and a total and a range's own value, come together.
JOINED = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def before(rows: DataFrame, groups: list[str], order: list[Column], told: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows of ranges() with, for each new column: (sum, max or min; column), that aggregate over the group's rows before, in this order, which has no ties.

    A window spans one range, and totals of whole ranges are carried over: no task needs more than its range, whatever
    the group. A sum over no rows is 0, an extreme null. A null is a group like any other.
    """
    of = {new: (f"_w{k}", f"_b{k}", *told[new]) for k, new in enumerate(told)}
    tot = rows.groupBy(*groups, "_part").agg(*[JOINED[f][0](c).alias(b) for _, b, f, c in of.values()])
    ahead = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    tot = tot.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_part").alias("_p"), *[JOINED[f][0](b).over(ahead).alias(b) for _, b, f, _ in of.values()])
    here = W.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumns({w: JOINED[f][0](c).over(here) for w, _, f, c in of.values()})
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = out.join(tot, same).withColumns({new: JOINED[f][1](F.col(w), F.col(b)) for new, (w, b, f, _) in of.items()})
    return out.drop("_p", *[f"_g{k}" for k in range(len(groups))], *[w for w, *_ in of.values()], *[b for _, b, *_ in of.values()])


def running(df: DataFrame, groups: list[str], order: Column, sums: dict[str, str]) -> DataFrame:
    """df with, for each new column: old column, the sum of old over the group's rows before, in this order, which has no ties."""
    return before(ranges(df, groups, order), groups, [order], {new: ("sum", F.col(old)) for new, old in sums.items()}).drop("_part")
