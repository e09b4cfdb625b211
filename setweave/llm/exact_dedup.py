"""Operator 9, exact dedup by a heavy-hitter split.

Digests of the normalised texts are made durable first (some 40 bytes a row). Misra-Gries
summaries of every partition name the digests that may be frequent; their exact counts and
winners (at most `counters` rows) are broadcast, so that the copies of a frequent text never
meet in one task. All other digests are grouped by an ordinary shuffle.

Defined results: null text counts as empty; of equal texts the largest doc_id stays; a null
doc_id never wins over another; rows with the same doc_id and text are all kept or all dropped;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

COUNTERS = 256


def misra_gries(batches: Iterator[pd.DataFrame], counters: int) -> Iterator[pd.DataFrame]:
    """At most `counters` (digest, n) of a partition; n falls short of the count by rows / (counters + 1) at most."""
    held: pd.Series | None = None
    for batch in batches:
        seen = batch["digest"].value_counts()
        held = seen if held is None else held.add(seen, fill_value=0)
        if len(held) > counters:
            held = held.sort_values(ascending=False)
            held = (held - held.iloc[counters])[lambda x: x > 0]
    if held is not None and len(held):
        yield pd.DataFrame({"digest": held.index, "n": held.to_numpy().astype("int64")})


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them every one that makes up over 2 / counters of all rows."""
    part = digests.select("digest").mapInPandas(lambda it: misra_gries(it, counters), "digest string, n long")
    return part.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    digests = durable(docs.select("doc_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("digest")))
    names = durable(frequent_digests(digests, counters))
    agg = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    hot = durable(digests.join(F.broadcast(names), "digest", "left_semi").groupBy("digest").agg(*agg))
    # hot has at most `counters` rows: limit() of frequent_digests bounds it
    known = digests.join(F.broadcast(hot), "digest", "left")
    rest = digests.join(F.broadcast(names), "digest", "left_anti")
    found = rest.join(rest.groupBy("digest").agg(*agg), "digest")
    cols = ("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    return known.where(F.col("group_size").isNotNull()).select(*cols).unionByName(found.select(*cols))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
