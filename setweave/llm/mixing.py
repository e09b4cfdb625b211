"""Operator 2, mixing sources to target weights by Pareto order sampling.

A source's target follows from its weight: sources are filled in the order of size to weight, and
those whose share would be above CAP times their size stop there (one pass over a row a source).
Within a source, a document's expected copies are e = min(cap, c * m), where m falls slowly with its
size class (long texts repeat less) and c is solved so that the expected words meet the target.
floor(e) copies are certain. The fraction l = e - floor(e), in 2^-20ths, is the odds of one more:
documents are ranked by (u / (1 - u)) / (l / (1 - l)), u uniform from a hash of doc_id, and taken
in that order until their words reach the sum of l * size (the fixed size, counted in words).

The cut in a source of any size needs no task that holds the source: words are summed by
(source, bin of the rank), the bin with the cut is found from these sums, and only that bin's
keys are ordered. Sums are of whole numbers, so reruns agree to the bit. The plan by (source, size
class), the cuts and the cut bins' takers are small beside the documents and are broadcast once
their size is checked, so texts are not shuffled.

Rows that agree in doc_id, text and source have one rank and are counted before they are ordered.
If the cut falls among them, it takes as many of them as fit, and these are dealt by number: rows are
numbered within the partition that they are read from, and partitions by their counts.

Defined results: null text has size 0; null is a source of its own, last; documents of size 0
take 0; u is drawn from doc_id and text; of rows that agree in doc_id, text and source some may be
taken once more than others, which of them is not told; an empty table gives no rows; other columns
are not read (mix_rows returns them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, columns_of, durable, fresh, n_words

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BINS = 2048
DAMPING = 0.125
SEED = 20
#: Odds are whole numbers of this many parts.
PARTS = 1 << 20
KEYS = ["doc_id", "source", "size", "u"]


def size_class(size):
    """The place of the highest bit of a size; 0 for 0."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))) - 1


def draw(doc_id, text, seed: int):
    """A number strictly between 0 and 1 from doc_id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and u of every row of docs."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size). One row a source; the excess over cap * size is reshared."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    src = src.select("source", "source_size", weight.alias("w"))
    order, every = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()), W.partitionBy(F.lit(1))  # a row a source
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    src = src.withColumns({"level": level, "nth": F.row_number().over(order)}).withColumn("full", F.col("w") * F.col("level") > cap * F.col("source_size"))
    last = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(every)["level"]
    return src.select("source", "source_size", F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.col("w") * last).alias("target"))


def _marked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns and q, the rank of rows with odds, and its bin."""
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_s"]) & (size_class(F.col("size")) == plan["_band"]), "left")
    odds = F.col("_l") / PARTS
    q = (F.col("u") / (1 - F.col("u"))) / (odds / (1 - odds))
    rows = rows.withColumn("_q", F.when((F.col("_l") > 0) & (F.col("size") > 0), q / (1 + q)))
    return rows.withColumn("_bin", F.least(F.floor(F.col("_q") * BINS), F.lit(BINS - 1)).cast("int"))


def sampling(sizes: DataFrame, goal: DataFrame, cap: float = CAP, damping: float = DAMPING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """plan (by source and size class), cut (by source) and takers (the keys taken within the cut bins)."""
    by = sizes.groupBy("source", size_class(F.col("size")).alias("_band")).agg(F.sum("size").alias("words"))
    m = F.element_at(F.array(*[F.lit(2.0 ** (-damping * k)) for k in range(64)]), F.col("_band") + 1)
    by = by.join(goal, by["source"].eqNullSafe(goal["source"])).select(by["source"], "_band", "words", m.alias("m"), "source_size", "target")
    up = W.partitionBy("source").orderBy(F.desc("m"))
    by = by.withColumns({
        "before": F.coalesce(F.sum("words").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum(F.col("m") * F.col("words")).over(up.rowsBetween(0, W.unboundedFollowing)),
    }).withColumn("c", F.when(F.col("rest") > 0, (F.col("target") - cap * F.col("before")) / F.col("rest")))
    ok = F.when(F.col("c") * F.col("m") <= cap * (1 + 1e-12), F.col("c"))
    by = by.withColumn("level", F.coalesce(F.max(ok).over(W.partitionBy("source")), F.lit(cap) * 2.0**16))
    copies = F.least(F.lit(cap), F.col("level") * F.col("m"))
    by = by.withColumn("_sure", F.floor(copies + 1e-6).cast("long"))
    part = F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.round((copies - F.col("_sure")) * PARTS))).cast("long")
    plan = checked_broadcast(by.select(F.col("source").alias("_s"), "_band", "source_size", "target", "_sure", part.alias("_l")))
    live = _marked(sizes, plan).where(F.col("_q").isNotNull()).select(*KEYS, "_q", "_bin", "_l")
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    binned = live.groupBy("source", "_bin").agg(F.sum("size").alias("words"), whole(F.col("size") * F.col("_l")).alias("want"))
    run = W.partitionBy("source").orderBy("_bin")  # BINS rows a source at most
    binned = binned.withColumns({"end": F.sum("words").over(run), "goal": (F.sum("want").over(W.partitionBy("source")).cast("double") / PARTS)})
    cut = binned.where(F.col("end") >= F.col("goal")).groupBy("source").agg(F.min(F.struct("_bin", (F.col("end") - F.col("words")).alias("start"), "goal")).alias("c"))
    cut = checked_broadcast(cut.select(F.col("source").alias("_c"), F.col("c._bin").alias("_cut"), F.col("c.start").alias("_start"), F.col("c.goal").alias("_goal")))
    edge = live.join(cut, live["source"].eqNullSafe(cut["_c"]) & (live["_bin"] == cut["_cut"]))
    edge = edge.groupBy(*KEYS, "_q", "_start", "_goal").agg(F.count("*").alias("_all"))  # equal rows are one key
    order = W.partitionBy("source").orderBy("_q", "doc_id", "size", "u").rowsBetween(W.unboundedPreceding, -1)  # of one bin's keys
    before = F.col("_start") + F.coalesce(F.sum(F.col("size") * F.col("_all")).over(order), F.lit(0))
    edge = edge.withColumn("_take", F.least(F.col("_all"), F.floor((F.col("_goal") - before) / F.col("size") + 0.5))).where("_take > 0")
    takers = checked_broadcast(edge.select(*[F.col(k).alias("_t" + k) for k in KEYS], "_take", "_all"))
    return plan, cut, takers


def _some(rows: DataFrame) -> DataFrame:
    """Of the rows with KEYS and _take: `more` is 1 for _take rows of a key, else 0."""
    rows = durable(rows.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    own = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias("_k" + k) for k in KEYS] + [F.col("doc_id").isNull().alias("_n1"), F.col("source").isNull().alias("_n2")]
    rows = rows.withColumn("_key", F.struct(*own))
    n = rows.groupBy("_key", "_part").agg(F.count("*").alias("_rows"))
    ahead = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    n = n.select("_key", "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    nth = F.col("_before") + F.row_number().over(W.partitionBy("_key", "_part").orderBy("_id"))  # of a partition's rows
    return rows.join(n, ["_key", "_part"]).withColumn("more", (nth <= F.col("_take")).cast("int")).drop("_key", "_part", "_id", "_before")


def taken_copies(rows: DataFrame, plan: DataFrame, cut: DataFrame, takers: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to rows with the columns KEYS."""
    names = rows.columns
    rows = _marked(rows, plan)
    rows = rows.join(cut.select("_c", "_cut"), rows["source"].eqNullSafe(cut["_c"]), "left")

    def with_takers(takers: DataFrame) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(takers["_tdoc_id"]) & rows["source"].eqNullSafe(takers["_tsource"]) & (rows["size"] == takers["_tsize"]) & (rows["u"] == takers["_tu"])
        return rows.join(takers, same, "left")

    out = with_takers(takers)
    # a key a source at most is taken in part: the one that the cut falls on
    whole = F.when(F.col("_q").isNull(), 0).when(F.col("_bin") < F.col("_cut"), 1).when((F.col("_bin") == F.col("_cut")) & (F.col("_take") == F.col("_all")), 1).otherwise(0)
    some = takers.where("_take < _all")
    n = F.when(F.col("size") > 0, F.coalesce(F.col("_sure"), F.lit(0)) + F.col("more")).otherwise(0).cast("long")
    told = lambda x: x.select(*names, "source_size", "target", n.alias("copies"))
    if some.isEmpty():
        return told(out.withColumn("more", whole))
    cut_off = F.coalesce((F.col("_bin") == F.col("_cut")) & (F.col("_take") < F.col("_all")), F.lit(False))
    return told(out.where(~cut_off).withColumn("more", whole)).unionByName(told(_some(out.where(cut_off))))


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, damping: float = DAMPING, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs (doc_id, text, source)."""
    sizes = durable(keyed(docs, seed))
    goal = checked_broadcast(targets(sizes, weights, cap))
    out = taken_copies(sizes, *sampling(sizes, goal, cap, damping))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, damping: float = DAMPING, seed: int = SEED) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...), each as often as the mix takes it; columns as they are."""
    sizes = durable(keyed(docs, seed))
    goal = checked_broadcast(targets(sizes, weights, cap))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u"), F.struct(*columns_of(docs)).alias("row"))
    rows = taken_copies(rows, *sampling(sizes, goal, cap, damping)).where("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_pareto_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "copies")


_M = "[" + ", ".join(f"CAST({2.0 ** (-DAMPING * k)!r} AS DOUBLE)" for k in range(64)) + "]"
#: The mix by plain windows over whole sources.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE) AS u FROM documents),
k AS (SELECT *, length(bin(greatest(size, 1))) - 1 AS band FROM d),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, [CAST(5 AS DOUBLE), 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM s0),
s2 AS (SELECT *, row_number() OVER o AS nth, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s1 WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
s3 AS (SELECT *, w * level > 3 * source_size AS full_ FROM s2),
s AS (SELECT source, source_size, CASE WHEN full_ THEN 3 * source_size ELSE w * (SELECT arg_min(level, nth) FROM s3 WHERE NOT full_) END AS target FROM s3),
b0 AS (SELECT source, band, sum(size) AS words, {_M}[band + 1] AS m FROM k GROUP BY source, band),
b1 AS (SELECT b0.*, target, coalesce(sum(words) OVER (PARTITION BY b0.source ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
  sum(m * words) OVER (PARTITION BY b0.source ORDER BY band ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM b0 JOIN s ON b0.source IS NOT DISTINCT FROM s.source),
b2 AS (SELECT *, (target - 3 * before_) / nullif(rest, 0) AS c FROM b1),
b3 AS (SELECT *, coalesce(max(CASE WHEN rest > 0 AND c * m <= CAST(3 AS DOUBLE) * (1 + CAST(1e-12 AS DOUBLE)) THEN c END) OVER (PARTITION BY source), CAST({CAP * 2.0**16} AS DOUBLE)) AS level FROM b2),
b4 AS (SELECT source, band, least(CAST(3 AS DOUBLE), level * m) AS copies FROM b3),
b AS (SELECT source, band, CAST(floor(copies + CAST(1e-6 AS DOUBLE)) AS BIGINT) AS sure, CAST(least({PARTS - 1}, greatest(0, round((copies - floor(copies + CAST(1e-6 AS DOUBLE))) * {PARTS}))) AS BIGINT) AS l FROM b4),
r AS (SELECT k.*, sure, l, CASE WHEN l > 0 AND size > 0 THEN (u / (1 - u)) / ((CAST(l AS DOUBLE) / {PARTS}) / (1 - CAST(l AS DOUBLE) / {PARTS})) END AS o FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.band = b.band),
q AS (SELECT *, o / (1 + o) AS q FROM r),
e AS (SELECT *, q IS NOT NULL AND sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size, u ROWS UNBOUNDED PRECEDING) - size / CAST(2 AS DOUBLE)
  <= CAST(sum(CASE WHEN q IS NOT NULL THEN CAST(size AS HUGEINT) * l END) OVER (PARTITION BY source) AS DOUBLE) / {PARTS} AS takes FROM q),
t AS (SELECT *, CASE WHEN size > 0 THEN sure + CAST(takes AS BIGINT) ELSE 0 END AS copies FROM e)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken, t.source, CAST(copies AS BIGINT) AS copies FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source
"""
