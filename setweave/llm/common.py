"""Helpers shared by the corpus operators: durable intermediate tables, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, numbered, shared_dir  # noqa: F401  (numbered: for the operators)

#: ASCII white space, as the contracts word it: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows that checked_broadcast() broadcasts; callers pass rows of at most some 100 bytes.
BROADCAST_ROWS = 100_000
#: Most edges that one task joins.
TASK_EDGES = 10_000


def give_back() -> None:
    """Gives memory of this process that is free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run):
    """The function of batches `run`; when a task ends, its Python worker, which lives on, gives memory that is free back to the system."""

    @wraps(run)
    def tidy(*args, **how):
        try:
            yield from run(*args, **how)
        finally:
            give_back()

    return tidy


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (made durable), with a broadcast hint if it has at most `rows` rows; else joins shuffle it."""
    df = durable(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text):
    """Lower-cases A-Z only. Texts of ASCII alone take the quick lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns that clash with none of df's, in any case."""
    taken = "".join(df.columns).lower()
    mark = "_"
    while mark in taken and any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def columns_of(df: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def n_words(text):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(seed: int, *keys):
    """A number strictly between 0 and 1 that depends on the seed and the keys only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(2**53)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, up) of at most TASK_EDGES edges: up is the least node reachable."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    yield pd.DataFrame({"node": pd.Series(list(root), dtype="int64"), "up": pd.Series([find(x) for x in list(root)], dtype="int64")})


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node in edges (a, b: long): root is the least node reachable.

    Contraction: each node hooks to its least neighbour if that is less, the trees are flattened by
    pointer jumping, and edges within a tree are dropped, so the next round has the trees' roots for
    nodes. Both loops take rounds in the logarithm of the component; all rounds are durable. Once at
    most `task_edges` edges are left, one task joins them.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = durable(edges.where("a <> b").select(*ends("a", "b")).distinct())
    lab = left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    for nth in range(max_rounds):
        few = left.limit(task_edges + 1).count() <= task_edges
        if few:
            up = left.coalesce(1).mapInPandas(_joined, "node long, up long")
        else:
            both = left.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("up")))
            up = durable(both.groupBy("node").agg(F.least(F.min("up"), F.col("node")).alias("up")))
            for _ in range(max_rounds):
                one = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
                new = durable(up.join(one, "up").select("node", "up", "top"))
                done = new.where("up <> top").isEmpty()
                up = new.select("node", F.col("top").alias("up"))
                if done:
                    break
            else:
                raise RuntimeError(f"trees are not flat in {max_rounds} rounds")
        if nth == 0:
            lab = up.select("node", F.col("up").alias("root"))
        else:
            lab = lab.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        lab = durable(lab)
        if few:
            return lab
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = durable(left.join(a, "a").join(b, "b").where("ua <> ub").select(*ends("ua", "ub")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
