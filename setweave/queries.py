"""Every query of the engine by name, and the SQL that DuckDB checks it with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.keys import draw, draw_sql, uniform, uniform_sql
from .operators import graph, metrics, multinomial, resampling, sets
from .operators.agreement import kendall
from .operators.quantiles import quantiles
from .plans.questions import FITB_SQL, NEGATIVES_SQL, cp_negatives, cuts, fitb_each, fitb_questions, fitb_sql
from .sources.tables import PREDICTIONS, SET_ITEMS, VECTORS, predictions, set_items, split_of, split_sql, table, vectors
from .storage import before, durable, ranges, scratch

QUERIES: dict = {}
SQL: dict = {}
R = 6


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r(col, n: int = R):
    return F.round(col, n)


# ---- sets and features


@query(f"""WITH {SET_ITEMS}, {VECTORS}, x AS (SELECT set_id, si.item_id, v FROM si JOIN vec USING (item_id)),
p AS (SELECT a.set_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS l1,
  list_sum(list_transform(list_zip(a.v, b.v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS d FROM x a JOIN x b ON a.set_id = b.set_id AND a.item_id < b.item_id)
SELECT set_id, count(*) AS n_pairs, round(avg(l1), 6) AS mean_l1, round(avg(d), 6) AS mean_dot FROM p GROUP BY set_id""")
def pair_feature_summary(spark, sf):
    f = sets.features(set_items(spark, sf).join(vectors(spark, sf), "item_id"), "set_id", "v")
    half = (F.size("feature") / 2).cast("int")
    part = lambda at: V.total(F.slice("feature", at, half))
    return f.select("set_id", "n_pairs", r(part(F.lit(1))).alias("mean_l1"), r(part(half + 1)).alias("mean_dot"))


@query(f"""WITH {SET_ITEMS}, c AS (SELECT set_id, list_sort(list(item_id)) AS items FROM si GROUP BY set_id)
SELECT array_to_string(items, ',') AS items, min(set_id) AS kept_set_id, count(*) AS n_sets FROM c WHERE len(items) >= 2 GROUP BY items""")
def set_dedup_first(spark, sf):
    c = sets.canonical(set_items(spark, sf)).where(F.size("items") >= 2)
    return sets.dedup_first(c, ["set_id"]).withColumn("items", F.array_join("items", ","))


@query("""WITH n AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) AS rn,
count(*) OVER (PARTITION BY l_partkey) AS n_values FROM n) SELECT l_partkey, l_returnflag, n, n_values FROM k WHERE rn = 1""")
def category_mode(spark, sf):
    return sets.mode(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderpriority")
def value_counts_norm(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.withColumn("share", r(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))))


@query("""WITH d AS (SELECT unnest(range(1, 8)) AS bucket), n AS (SELECT least(l_linenumber, 7) AS bucket, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(bucket AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (bucket)""")
def value_counts_support(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.least("l_linenumber", F.lit(7)).alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(1, 8).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {SET_ITEMS}, c AS (SELECT set_id, count(*) AS n FROM si GROUP BY set_id)
SELECT count(*) AS sets, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, median(n) AS median, min(n) AS lo, max(n) AS hi, quantile_cont(n, 0.9) AS p90 FROM c""")
def length_stats(spark, sf):
    c = set_items(spark, sf).groupBy("set_id").agg(F.count("*").alias("n"))
    c = durable(c)
    q = quantiles(c, [], "n", [0.5, 0.9]).agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"), F.max(F.when(F.col("q") == 0.9, F.col("value"))).alias("p90"))
    n = c.agg(F.count("*").alias("sets"), r(F.avg("n")).alias("mean"), r(F.stddev_samp("n")).alias("sd"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    return n.crossJoin(F.broadcast(q)).select("sets", "mean", "sd", "median", "lo", "hi", "p90")  # one row each


@query(f"""WITH {SET_ITEMS}, c AS (SELECT set_id, count(*) AS n FROM si GROUP BY set_id)
SELECT CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) ELSE '6+' END AS length_group, count(*) AS n, round(sum(n * o_totalprice) / sum(n), 6) AS weighted_price
FROM c JOIN orders ON set_id = o_orderkey GROUP BY 1""")
def length_groups_weighted(spark, sf):
    c = set_items(spark, sf).groupBy("set_id").agg(F.count("*").alias("n")).join(table(spark, sf, "orders"), F.col("set_id") == F.col("o_orderkey"))
    g = F.when(F.col("n") <= 5, F.col("n").cast("string")).otherwise("6+")
    return c.groupBy(g.alias("length_group")).agg(F.count("*").alias("n"), r(F.sum(F.col("n") * F.col("o_totalprice")) / F.sum("n")).alias("weighted_price"))


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY l_returnflag")
def pivot_metric(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(r(F.avg("l_quantity")))


@query(f"""WITH {VECTORS} SELECT item_id, round(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm,
len(v) AS width, abs(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) <= 0.002 AS unit FROM vec""")
def vector_norms(spark, sf):
    n = V.norm(F.col("v"))
    return vectors(spark, sf).select("item_id", r(n, 5).alias("norm"), F.size("v").cast("long").alias("width"), (F.abs(n - 1) <= 0.002).alias("unit"))


@query("""WITH x AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding) AS x FROM embeddings),
s AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS sd FROM x WHERE vec_id % 10 < 7 GROUP BY dim)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round((CAST(x AS DOUBLE) - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS z FROM x JOIN s USING (dim)""")
def standardise_train_only(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumns({"dim": (F.col("dim") + 1).cast("long"), "x": F.col("x").cast("double")})
    s = x.where("vec_id % 10 < 7").groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return x.join(s, "dim").select("vec_id", "dim", r((F.col("x") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")), 5).alias("z"))


@query()
def logistic_grid(spark, sf):
    from .operators.learners import select_logistic

    return select_logistic(table(spark, sf, "embeddings").select("embedding", F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0).alias("label"), (F.col("vec_id") % 10).alias("fold")))


# ---- joins and set operations


@query("SELECT p_partkey, p_type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def semi_items(spark, sf):
    hot = table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_partkey")
    return table(spark, sf, "part").join(hot, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def anti_items(spark, sf):
    hot = table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_partkey")
    return table(spark, sf, "part").join(hot, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_type")


@query("SELECT c_custkey, n_name, r_name, round(c_acctbal, 2) AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_joins(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name", r(F.col("c_acctbal"), 2).alias("c_acctbal"))


@query("""SELECT a.lang, a.source, a.n AS n_a, b.n AS n_b, a.n - coalesce(b.n, 0) AS delta FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) a
LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents WHERE n_chars > 1500 GROUP BY ALL) b ON a.lang = b.lang AND a.source = b.source""")
def composite_left_join(spark, sf):
    d = table(spark, sf, "documents")
    a, b = d.groupBy("lang", "source").agg(F.count("*").alias("n_a")), d.where("n_chars > 1500").groupBy("lang", "source").agg(F.count("*").alias("n_b"))
    return a.join(b, ["lang", "source"], "left").withColumn("delta", F.col("n_a") - F.coalesce("n_b", F.lit(0)))


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def validated_left_join(spark, sf):
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return region_names(table(spark, sf, "nation"), regions)


def region_names(nations: DataFrame, regions: DataFrame) -> DataFrame:
    """Every nation with its region's name. A nation without a region, and a region told twice, raise."""
    keyed = nations.select("n_regionkey", F.struct("n_nationkey", "n_name").alias("n"))
    sides = keyed.groupBy("n_regionkey").agg(F.collect_list("n").alias("n"))  # the few nations of a region: keys are unique
    out = sets.validated_left_join(sides, regions, ["n_regionkey"], "r_name")
    return out.select("n_regionkey", "r_name", F.inline("n"))


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS only_documents, count(*) FILTER (d.doc_id IS NULL) AS only_labels, count(*) FILTER (l.quality <> l.toxic) AS differ,
count(*) FILTER (length(d.text) <> d.n_chars) AS wrong_length FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def alignment_mismatches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("n"), F.lit(1).alias("in_d"))
    j = d.join(table(spark, sf, "labels").withColumn("in_l", F.lit(1)), "doc_id", "full")
    return j.agg(F.count_if(F.col("in_l").isNull()).alias("only_documents"), F.count_if(F.col("in_d").isNull()).alias("only_labels"), F.count_if(F.col("quality") != F.col("toxic")).alias("differ"), F.count_if(F.col("n") != F.col("n_chars")).alias("wrong_length"))


@query("""WITH g AS (SELECT p_brand || '/' || p_type AS key, round(avg(p_size), 3) AS metric, round(avg(p_retailprice), 2) AS cost FROM part GROUP BY ALL),
j AS (SELECT a.key, a.metric, a.cost, string_agg(b.key, ';' ORDER BY b.key) AS dominators FROM g a LEFT JOIN g b ON b.metric >= a.metric AND b.cost <= a.cost AND (b.metric > a.metric OR b.cost < a.cost) GROUP BY ALL)
SELECT key, metric, cost, coalesce(dominators, '') AS dominators, dominators IS NOT NULL AS dominated FROM j""")
def pareto_dominated(spark, sf):
    g = table(spark, sf, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("key")).agg(r(F.avg("p_size"), 3).alias("metric"), r(F.avg("p_retailprice"), 2).alias("cost"))
    return sets.dominated(g, "key", "metric", "cost")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, floor(p_retailprice / 10) AS price FROM part)
SELECT p_partkey, p_brand, EXISTS (SELECT 1 FROM p b WHERE b.p_size >= a.p_size AND b.price <= a.price AND (b.p_size > a.p_size OR b.price < a.price)) AS dominated FROM p a""")
def pareto_flags(spark, sf):
    """Whether another part is no smaller and no dearer, and larger or cheaper: of all parts, without pairs."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.floor(F.col("p_retailprice") / 10).alias("price"))
    return sets.pareto_flags(p, "p_size", "price").select("p_partkey", "p_brand", "dominated")


FACETS = (("tiny", 0, 499), ("short", 500, 1999), ("middle", 2000, 9999), ("long", 10000, 10**9))


@query("SELECT facet, count(*) AS n, sum(n_chars) AS chars FROM documents JOIN (VALUES ('tiny', 0, 499), ('short', 500, 1999), ('middle', 2000, 9999), ('long', 10000, 1000000000)) f(facet, lo, hi) ON n_chars BETWEEN lo AND hi GROUP BY facet")
def range_facet(spark, sf):
    f = F.broadcast(spark.createDataFrame(FACETS, "facet string, lo long, hi long"))  # four rows
    return table(spark, sf, "documents").join(f, F.col("n_chars").between(F.col("lo"), F.col("hi"))).groupBy("facet").agg(F.count("*").alias("n"), F.sum("n_chars").cast("decimal(38,0)").alias("chars"))


@query("""SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer
UNION ALL BY NAME SELECT 'part' AS kind, p_partkey AS key, p_brand AS brand FROM part""")
def union_ragged(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query(f"""WITH x AS (SELECT DISTINCT {split_sql("l_orderkey")} AS split, l_partkey FROM lineitem)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.split < b.split GROUP BY ALL""")
def split_overlap(spark, sf):
    x = table(spark, sf, "lineitem").select(split_of(F.col("l_orderkey")).alias("split"), "l_partkey").groupBy("l_partkey").agg(F.array_sort(F.collect_set("split")).alias("s"))
    a = x.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b"))  # three splits at most
    return a.where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


@query(f"""WITH x AS (SELECT DISTINCT {split_sql("o_orderkey")} AS split, o_custkey FROM orders)
SELECT o_custkey, string_agg(split, ',' ORDER BY split) AS splits FROM x GROUP BY o_custkey HAVING count(*) > 1""")
def overlap_users(spark, sf):
    x = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(split_of(F.col("o_orderkey")))).alias("s"))
    return x.where(F.size("s") > 1).select("o_custkey", F.array_join("s", ",").alias("splits"))


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS both_n,
(SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_customers,
(SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS all_n""")
def set_operations(spark, sf):
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    tags = c.select("k", F.lit(1).alias("c"), F.lit(0).alias("o")).unionByName(o.select("k", F.lit(0).alias("c"), F.lit(1).alias("o"))).groupBy("k").agg(F.max("c").alias("c"), F.max("o").alias("o"))
    return tags.agg(F.count_if((F.col("c") == 1) & (F.col("o") == 1)).alias("both_n"), F.count_if((F.col("c") == 1) & (F.col("o") == 0)).alias("only_customers"), F.count("*").alias("all_n"))


# ---- ranks and windows


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, floor(s_acctbal / 1000) AS level FROM supplier)
SELECT s_suppkey, s_nationkey, rank() OVER w AS rank_min, rank() OVER w + (count(*) OVER (PARTITION BY s_nationkey, level) - 1) / CAST(2 AS DOUBLE) AS rank_avg FROM s WINDOW w AS (PARTITION BY s_nationkey ORDER BY level DESC)""")
def rank_min_avg(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("level"))
    return sets.ranks(s, ["s_nationkey"], "level").select("s_suppkey", "s_nationkey", "rank_min", "rank_avg")


@query(f"""WITH p AS (SELECT p_partkey, p_type, {uniform_sql("p", "p_partkey")} / 50 AS p FROM part),
s AS (SELECT *, (count(*) OVER (PARTITION BY p_type) - row_number() OVER (PARTITION BY p_type ORDER BY p, p_partkey) + 1) * p AS step FROM p)
SELECT p_partkey, p_type, round(p, 9) AS p, round(least(1.0, max(step) OVER (PARTITION BY p_type ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM s""")
def holm_adjust(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", (uniform("p", F.col("p_partkey")) / 50).alias("p"))
    return sets.holm(p, "p", "p_partkey", "p_type").select("p_partkey", "p_type", r(F.col("p"), 9).alias("p"), r(F.col("p_adjusted"), 9).alias("p_adjusted"))


@query("""SELECT o_orderkey, row_number() OVER w - 1 AS nth, (row_number() OVER w - 1) % 4 AS slot, sum(1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_n,
round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def cumulative_sums(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nth = (F.row_number().over(w) - 1).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", nth.alias("nth"), F.pmod(nth, F.lit(4)).alias("slot"), F.sum(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, -1)).cast("decimal(38,0)").alias("before_n"), r(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")
def topk_groups(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("""SELECT l_orderkey, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS predicted_index, max(l_quantity) AS best_score FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""".replace("arg_min(l_linenumber, (-l_quantity, l_linenumber))", "(list(l_linenumber ORDER BY l_quantity DESC, l_linenumber))[1]"))
def argmax_candidate(spark, sf):
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return metrics.first_argmax(one, ["l_orderkey"], "l_linenumber", "q")


# ---- metrics over predictions


@query(f"""WITH {PREDICTIONS}, b AS (SELECT model, score, sum(label) AS p, sum(1 - label) AS n FROM pred GROUP BY ALL), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT model, round(sum(p * (below + n / CAST(2 AS DOUBLE))) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY model""")
def roc_auc(spark, sf):
    return metrics.roc_auc(predictions(spark, sf), ["model"]).select("model", r(F.col("auc")).alias("auc"))


@query(f"""WITH {PREDICTIONS}, b AS (SELECT model, score, sum(label) AS p, count(*) AS n FROM pred GROUP BY ALL), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS t FROM b WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, round(sum(CAST(p AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(t AS DOUBLE)) / CAST(sum(p) AS DOUBLE), 6) AS ap FROM c GROUP BY model""")
def pr_auc(spark, sf):
    return metrics.average_precision(predictions(spark, sf), ["model"]).select("model", r(F.col("ap")).alias("ap"))


_CLIP = "least(greatest(score, CAST(2.220446049250313e-16 AS DOUBLE)), CAST(1 AS DOUBLE) - CAST(2.220446049250313e-16 AS DOUBLE))"


@query(f"WITH {PREDICTIONS} SELECT model, round(avg((score - label) * (score - label)), 6) AS brier, round(avg(-CASE WHEN label = 1 THEN ln({_CLIP}) ELSE ln(CAST(1 AS DOUBLE) - {_CLIP}) END), 6) AS log_loss FROM pred GROUP BY model")
def brier_logloss(spark, sf):
    return metrics.brier_logloss(predictions(spark, sf), ["model"]).select("model", r(F.col("brier")).alias("brier"), r(F.col("log_loss")).alias("log_loss"))


@query(f"""WITH {PREDICTIONS}, x AS (SELECT model, label, CAST((CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = label AS INTEGER) AS ok FROM pred)
SELECT model, round(avg(ok), 6) AS accuracy, round((avg(ok) FILTER (label = 1) + avg(ok) FILTER (label = 0)) / 2, 6) AS balanced_accuracy FROM x GROUP BY model""")
def accuracy_balanced(spark, sf):
    return metrics.accuracy(predictions(spark, sf), ["model"]).select("model", r(F.col("accuracy")).alias("accuracy"), r(F.col("balanced_accuracy")).alias("balanced_accuracy"))


_BIN = "CAST(least(floor(score * 15), 14) AS INTEGER)"


@query(f"WITH {PREDICTIONS}, b AS (SELECT model, {_BIN} AS bin, count(*) AS n, sum(score) AS s, sum(label) AS y FROM pred GROUP BY ALL) SELECT model, round(sum(abs(s - y)) / sum(n), 6) AS ece FROM b GROUP BY model")
def ece_15(spark, sf):
    return metrics.ece(predictions(spark, sf), ["model"], 15).select("model", r(F.col("ece")).alias("ece"))


@query(f"""WITH {PREDICTIONS}, b AS (SELECT model, {_BIN} AS bin, count(*) AS n, avg(score) AS s, avg(label) AS y FROM pred GROUP BY ALL),
g AS (SELECT DISTINCT model, CAST(k AS INTEGER) AS bin FROM pred, range(15) t(k))
SELECT model, bin, round(bin / CAST(15 AS DOUBLE), 6) AS lower, round((bin + 1) / CAST(15 AS DOUBLE), 6) AS upper, coalesce(n, 0) AS n, round(s, 6) AS mean_probability, round(y, 6) AS positive_rate FROM g LEFT JOIN b USING (model, bin)""")
def reliability_bins(spark, sf):
    b = metrics.reliability(predictions(spark, sf), ["model"], 15)
    return b.select("model", "bin", "n", *[r(F.col(c)).alias(c) for c in ("lower", "upper", "mean_probability", "positive_rate")])


@query(f"""WITH {PREDICTIONS}, e AS (SELECT model, lang FROM pred GROUP BY ALL HAVING count(*) >= 20 AND sum(label) > 0 AND sum(label) < count(*)),
b AS (SELECT model, lang, score, sum(label) AS p, sum(1 - label) AS n FROM pred JOIN e USING (model, lang) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model, lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT model, lang, round(sum(p * (below + n / CAST(2 AS DOUBLE))) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY ALL""")
def subgroup_auc(spark, sf):
    p = predictions(spark, sf)
    big = p.groupBy("model", "lang").agg(F.count("*").alias("n")).where("n >= 20").select("model", "lang")
    return metrics.roc_auc(p.join(big, ["model", "lang"], "left_semi"), ["model", "lang"]).select("model", "lang", r(F.col("auc")).alias("auc"))


@query(f"""WITH {PREDICTIONS}, c AS (SELECT doc_id, sum(CAST((score >= 0.5) = (label = 1) AS INTEGER)) AS k FROM pred GROUP BY doc_id)
SELECT CAST(k AS BIGINT) AS correct_models, count(*) AS n FROM c GROUP BY k""")
def consensus_failure(spark, sf):
    ok = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("long")
    return predictions(spark, sf).groupBy("doc_id").agg(F.sum(ok).alias("correct_models")).groupBy("correct_models").agg(F.count("*").alias("n"))


# ---- questions


@query(NEGATIVES_SQL)
def cp_negative_sets(spark, sf):
    return cp_negatives(spark, sf)


@query(FITB_SQL)
def fitb_question_sets(spark, sf):
    return fitb_questions(spark, sf)


@query(f"""WITH q AS ({FITB_SQL}), s AS (SELECT set_id, correct_index, CAST(unnest(range(4)) AS INTEGER) AS candidate_index, unnest(string_split(candidates, ',')) AS c FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {draw_sql("fitb", "set_id", "c")} % 10 DESC, candidate_index) AS rn FROM s)
SELECT correct_index, count(*) AS n, round(avg(CAST(candidate_index = correct_index AS INTEGER)), 6) AS accuracy FROM k WHERE rn = 1 GROUP BY correct_index""")
def fitb_accuracy(spark, sf):
    q = fitb_questions(spark, sf).select("set_id", "correct_index", F.posexplode(F.split("candidates", ",")).alias("candidate_index", "c"))
    q = q.withColumn("score", draw("fitb", F.col("set_id"), F.col("c")) % 10)
    best = metrics.first_argmax(q, ["set_id", "correct_index"], "candidate_index", "score")
    return best.groupBy("correct_index").agg(F.count("*").alias("n"), r(F.avg((F.col("predicted_index") == F.col("correct_index")).cast("double"))).alias("accuracy"))


#: Seeds of the question sweep.
SEEDS = (42, 43, 44, 45, 46)


@query("WITH q AS (" + " UNION ALL ".join(f"SELECT {s} AS seed, * FROM ({fitb_sql(s)})" for s in SEEDS) + f"""), s AS (SELECT seed, set_id, correct_index, CAST(unnest(range(4)) AS INTEGER) AS candidate_index, unnest(string_split(candidates, ',')) AS c FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY seed, set_id ORDER BY {draw_sql("fitb", "set_id", "c")} % 10 DESC, candidate_index) AS rn FROM s),
a AS (SELECT seed, count(*) AS n, avg(CAST(candidate_index = correct_index AS INTEGER)) AS m FROM k WHERE rn = 1 GROUP BY seed)
SELECT seed, n, round(m, 6) AS accuracy, round(m - avg(m) OVER (), 6) AS from_mean, round(stddev_samp(m) OVER (), 6) AS sd, round(max(m) OVER () - min(m) OVER (), 6) AS spread FROM a""")
def fitb_seed_sweep(spark, sf):
    """Fill-in-the-blank questions made anew under each seed from the same items, and how far accuracy moves."""

    def told(q: DataFrame) -> DataFrame:
        score = F.transform(F.split("candidates", ","), lambda c: draw("fitb", F.col("set_id"), c) % 10)
        best = F.array_position(score, F.array_max(score)) - 1  # the first of the highest
        return q.groupBy(F.col("seed").cast("int").alias("seed")).agg(F.count("*").alias("n"), F.avg((best == F.col("correct_index")).cast("double")).alias("m"))

    a = fitb_each(spark, sf, SEEDS, told)
    every = W.partitionBy(F.lit(1))  # a row a seed
    m = F.col("m")
    return a.select("seed", "n", r(m).alias("accuracy"), r(m - F.avg(m).over(every)).alias("from_mean"), r(F.stddev_samp(m).over(every)).alias("sd"), r(F.max(m).over(every) - F.min(m).over(every)).alias("spread"))


@query(f"""WITH q AS ({FITB_SQL}), s AS (SELECT correct_index, CAST(unnest(range(4)) AS INTEGER) AS i, CAST(unnest(string_split(candidates, ',')) AS BIGINT) AS item_id FROM q),
u AS (SELECT item_id, count(*) AS n FROM s WHERE i <> correct_index GROUP BY item_id)
SELECT (SELECT count(*) FROM q) AS questions, count(*) AS items, max(n) AS most_reused, round(avg(n), 6) AS mean_reuse, count(*) FILTER (n > 1) AS reused,
(SELECT count(*) FROM q WHERE correct_index = 0) AS slot_0, (SELECT count(*) FROM q WHERE correct_index = 3) AS slot_3 FROM u""")
def distractor_usage(spark, sf):
    """How often questions reuse a distractor, and how many have the right answer in the outer slots."""
    q = fitb_questions(spark, sf)
    s = q.select("correct_index", F.posexplode(F.split("candidates", ",")).alias("i", "item_id")).where("i <> correct_index")
    u = s.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.count("*").alias("n"))
    u = u.agg(F.count("*").alias("items"), F.max("n").alias("most_reused"), r(F.avg("n")).alias("mean_reuse"), F.count_if(F.col("n") > 1).alias("reused"))
    n = q.agg(F.count("*").alias("questions"), F.count_if(F.col("correct_index") == 0).alias("slot_0"), F.count_if(F.col("correct_index") == 3).alias("slot_3"))
    return n.crossJoin(F.broadcast(u))  # one row each


@query(f"""WITH n AS ({NEGATIVES_SQL}), {SET_ITEMS}, p AS (SELECT DISTINCT array_to_string(list_sort(list(item_id)), ',') AS items FROM si GROUP BY set_id),
d AS (SELECT negative, count(*) AS k FROM n WHERE complete GROUP BY negative)
SELECT (SELECT count(*) FROM n) AS sets, (SELECT count(*) FROM n WHERE complete) AS complete, (SELECT count(*) FROM d JOIN p ON negative = items) AS equal_positive, (SELECT coalesce(sum(k) FILTER (k > 1), 0)::BIGINT FROM d) AS repeated,
(SELECT count(*) FROM n WHERE complete AND len(list_distinct(string_split(negative, ','))) < n_items) AS repeats_an_item""")
def protocol_audit(spark, sf):
    """Balance and validity of the negative sets: completeness, negatives equal to a positive, repeated negatives, repeated items."""
    own = F.count_if(F.col("complete") & (F.size(F.array_distinct(F.split("negative", ","))) < F.col("n_items")))
    with scratch(spark) as keep:
        n = cp_negatives(spark, sf, keep)
        a = keep(n.agg(F.count("*").alias("sets"), F.count_if("complete").alias("complete"), own.alias("repeats_an_item")))
        lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("item_id"))
        p = keep(sets.canonical(lines).select(F.array_join("items", ",").alias("negative")))
        parts = []
        for c in cuts(max(1, n.count()), ["negative"]):  # equal sets are in one part
            d = n.where("complete").where(c).groupBy("negative").agg(F.count("*").alias("k"))
            d = d.join(p.where(c).distinct().withColumn("hit", F.lit(True)), "negative", "left")
            parts.append(keep(d.agg(F.count("hit").alias("equal_positive"), F.sum(F.when(F.col("k") > 1, F.col("k"))).alias("repeated"))))
        b = reduce(DataFrame.unionByName, parts).agg(F.sum("equal_positive").alias("equal_positive"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"))
        return durable(a.crossJoin(F.broadcast(b)))  # one row each


@query("""WITH x AS (SELECT sha256(coalesce(text, '')) AS sha, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT a.source AS source_a, b.source AS source_b, count(*) AS digests, CAST(sum(a.n) AS BIGINT) AS rows_a, CAST(sum(b.n) AS BIGINT) AS rows_b FROM x a JOIN x b ON a.sha = b.sha AND a.source < b.source GROUP BY ALL""")
def corpus_overlap(spark, sf):
    """Equal contents between every two corpora (here: sources), by digest."""
    x = table(spark, sf, "documents").groupBy(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha"), "source").agg(F.count("*").alias("n"))
    b = x.select("sha", F.col("source").alias("source_b"), F.col("n").alias("n_b"))
    j = x.join(b, "sha").where("source < source_b")  # a row a corpus and digest: as many pairs as two corpora, whatever the copies
    return j.groupBy(F.col("source").alias("source_a"), "source_b").agg(F.count("*").alias("digests"), F.sum("n").alias("rows_a"), F.sum("n_b").alias("rows_b"))


@query("""WITH d AS (SELECT sha256(coalesce(text, '')) AS value, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT CAST(n_chars AS VARCHAR) AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 20)
SELECT 'copies' AS part, CAST(n AS VARCHAR) AS value, count(*) AS n FROM d WHERE n > 1 GROUP BY n UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'n_chars', value, n FROM t""")
def content_audit(spark, sf):
    """The content report: groups of copies by their size, kinds by count, and the 20 commonest lengths (a top-20 report)."""
    x = table(spark, sf, "documents")
    d = x.groupBy(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha")).agg(F.count("*").alias("c")).where("c > 1")
    parts = [d.groupBy(F.lit("copies").alias("part"), F.col("c").cast("string").alias("value")).agg(F.count("*").alias("n"))]
    parts += [x.groupBy(F.lit(c).alias("part"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for c in ("lang", "source")]
    top = x.groupBy(F.lit("n_chars").alias("part"), F.col("n_chars").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [*parts, top.orderBy(F.desc("n"), "value").limit(20)])


# ---- resampling and agreement

B = 2000


def _bootstrap(spark, sf, unit: str, strata: list[str]) -> DataFrame:
    """(model, replicate, accuracy) under paired draws of units."""
    ok = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("long")
    base = predictions(spark, sf).groupBy("model", *strata, unit).agg(F.sum(ok).alias("ok"), F.count("*").alias("n"))
    rows = multinomial.with_unit_totals(base, resampling.numbered_units(base, unit, strata), strata, unit)
    drawn = multinomial.resampled_sums(rows, ["model"], ["ok", "n"], B, "boot", strata)
    return drawn.select("model", "replicate", (F.col("ok") / F.col("n")).alias("accuracy"))


def _bootstrap_sql(unit: str, strata: str = "") -> str:
    s, on = (f"{strata}, ", f"{strata}, ") if strata else ("", "")
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""WITH {PREDICTIONS}, base AS (SELECT model, {s}{unit}, sum(CAST((score >= 0.5) = (label = 1) AS INTEGER)) AS ok, count(*) AS n FROM pred GROUP BY ALL),
u AS (SELECT {s}{unit}, row_number() OVER ({part} ORDER BY {unit}) - 1 AS unit_no FROM (SELECT DISTINCT {s}{unit} FROM base)),
{multinomial.counts_sql("u", [strata] if strata else [], "boot", B)},
acc AS (SELECT model, replicate, CAST(sum(ok * w) AS DOUBLE) / sum(n * w) AS accuracy FROM base JOIN u USING ({on}{unit}) JOIN w USING ({on}unit_no) GROUP BY ALL)"""


_CI = " SELECT model, round(quantile_cont(accuracy, 0.025), 6) AS ci_low, round(quantile_cont(accuracy, 0.975), 6) AS ci_high FROM acc GROUP BY model"


def _ci(df: DataFrame) -> DataFrame:
    return resampling.interval(df, ["model"], "accuracy").select("model", r(F.col("ci_low")).alias("ci_low"), r(F.col("ci_high")).alias("ci_high"))


@query(_bootstrap_sql("doc_id") + _CI)
def boot_iid_ci(spark, sf):
    return _ci(_bootstrap(spark, sf, "doc_id", []))


@query(_bootstrap_sql("doc_id", "label") + _CI)
def boot_stratified_ci(spark, sf):
    return _ci(_bootstrap(spark, sf, "doc_id", ["label"]))


@query(_bootstrap_sql("source") + _CI)
def boot_cluster_ci(spark, sf):
    return _ci(_bootstrap(spark, sf, "source", []))


@query(_bootstrap_sql("source") + """, x AS (SELECT a.model AS model_a, b.model AS model_b, b.accuracy - a.accuracy AS diff FROM acc a JOIN acc b ON a.replicate = b.replicate AND a.model < b.model)
SELECT model_a, model_b, round(quantile_cont(diff, 0.025), 6) AS ci_low, round(quantile_cont(diff, 0.975), 6) AS ci_high,
round(least(1.0, 2.0 * (least(count(*) FILTER (diff <= 0), count(*) FILTER (diff >= 0)) + 1) / (count(*) + 1)), 6) AS p_value FROM x GROUP BY ALL""")
def boot_paired_diff(spark, sf):
    acc = _bootstrap(spark, sf, "source", [])
    a, b = acc.select(F.col("model").alias("model_a"), "replicate", F.col("accuracy").alias("x")), acc.select(F.col("model").alias("model_b"), "replicate", F.col("accuracy").alias("y"))
    x = a.join(b, "replicate").where("model_a < model_b").withColumn("diff", F.col("y") - F.col("x"))  # pairs of models
    keys = ["model_a", "model_b"]
    out = resampling.interval(x, keys, "diff").join(resampling.two_sided_p(x, keys, "diff"), keys)
    return out.select(*keys, *[r(F.col(c)).alias(c) for c in ("ci_low", "ci_high", "p_value")])


@query(f"""WITH {PREDICTIONS}, c AS (SELECT model, doc_id, (score >= 0.5) = (label = 1) AS ok FROM pred),
x AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.ok AND NOT b.ok) AS only_a, count(*) FILTER (b.ok AND NOT a.ok) AS only_b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.model < b.model GROUP BY ALL)
SELECT *, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(least(only_a, only_b) + 1), lambda k:
exp(lgamma(only_a + only_b + 1.0) - lgamma(k + 1.0) - lgamma(only_a + only_b - k + 1.0) - (only_a + only_b) * ln(2.0))))), 6) END AS p_value FROM x""")
def mcnemar_counts(spark, sf):
    c = predictions(spark, sf).select("model", "doc_id", ((F.col("score") >= 0.5) == (F.col("label") == 1)).alias("ok"))
    a, b = c.select(F.col("model").alias("model_a"), "doc_id", F.col("ok").alias("x")), c.select(F.col("model").alias("model_b"), "doc_id", F.col("ok").alias("y"))
    x = a.join(b, "doc_id").where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(F.col("y") & ~F.col("x")).alias("only_b"))
    return x.withColumn("p_value", r(resampling.binomial_p(F.col("only_a"), F.col("only_b"))))


_RANKS = f"""WITH {PREDICTIONS}, g AS (SELECT model, source, round(avg(score), 3) AS s FROM pred GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY s DESC) + (count(*) OVER (PARTITION BY model, s) - 1) / CAST(2 AS DOUBLE) AS rk FROM g)"""


def _ranks(spark, sf):
    g = predictions(spark, sf).groupBy("model", "source").agg(r(F.avg("score"), 3).alias("s"))
    return g.withColumn("rk", sets.average_rank("s", "model"))


@query(_RANKS + " SELECT a.model AS model_a, b.model AS model_b, round(corr(a.rk, b.rk), 6) AS rho FROM k a JOIN k b ON a.source = b.source AND a.model < b.model GROUP BY ALL")
def spearman_rho(spark, sf):
    k = _ranks(spark, sf)
    a, b = k.select(F.col("model").alias("model_a"), "source", F.col("rk").alias("x")), k.select(F.col("model").alias("model_b"), "source", F.col("rk").alias("y"))
    return a.join(b, "source").where("model_a < model_b").groupBy("model_a", "model_b").agg(r(F.corr("x", "y")).alias("rho"))


@query(_RANKS + """, j AS (SELECT a.model AS model_a, b.model AS model_b, a.source, a.s AS x, b.s AS y FROM k a JOIN k b ON a.source = b.source AND a.model < b.model),
p AS (SELECT j.model_a, j.model_b, sign(j.x - i.x) AS dx, sign(j.y - i.y) AS dy FROM j JOIN j i ON j.model_a = i.model_a AND j.model_b = i.model_b AND j.source < i.source)
SELECT model_a, model_b, round(sum(dx * dy) / sqrt(CAST(sum(abs(dx)) AS DOUBLE) * sum(abs(dy))), 6) AS tau, count(*) FILTER (dx * dy < 0) AS reversals FROM p GROUP BY ALL""")
def kendall_tau_reversals(spark, sf):
    return kendall(_two_models(_ranks(spark, sf)), ["model_a", "model_b"], "x", "y").select("model_a", "model_b", r(F.col("tau")).alias("tau"), F.col("discordant").alias("reversals"))


def _two_models(k: DataFrame) -> DataFrame:
    """model_a, model_b, source, x, y: the scores s of every two models."""
    a, b = k.select(F.col("model").alias("model_a"), "source", F.col("s").alias("x")), k.select(F.col("model").alias("model_b"), "source", F.col("s").alias("y"))
    return a.join(b, "source").where("model_a < model_b")


@query(f"""WITH RECURSIVE {PREDICTIONS}, k AS (SELECT model, source, round(avg(score * score), 9) AS s FROM pred GROUP BY ALL),
j AS (SELECT a.model AS model_a, b.model AS model_b, a.source, a.s AS x, b.s AS y FROM k a JOIN k b ON a.source = b.source AND a.model < b.model),
c AS (SELECT j.model_a, j.model_b, count(*) FILTER ((j.x - i.x) * (j.y - i.y) > 0) AS concordant, count(*) FILTER ((j.x - i.x) * (j.y - i.y) < 0) AS discordant FROM j JOIN j i ON j.model_a = i.model_a AND j.model_b = i.model_b AND j.source < i.source GROUP BY ALL),
m AS (SELECT 1 AS k, [CAST(1 AS DOUBLE)] AS f UNION ALL SELECT k + 1, [list_sum(f[greatest(1, i - k):least(i, len(f))]) / (k + 1) FOR i IN range(1, len(f) + k + 1)] FROM m WHERE k < (SELECT count(DISTINCT source) FROM j)),
d AS (SELECT f FROM m ORDER BY k DESC LIMIT 1)
SELECT model_a, model_b, concordant, discordant, round(CAST(concordant - discordant AS DOUBLE) / (concordant + discordant), 6) AS tau, 'exact' AS p_kind,
round(CASE WHEN concordant = discordant THEN 1 ELSE least(1, 2 * list_sum(f[1:least(concordant, discordant) + 1])) END, 9) AS p_value FROM c, d""")
def kendall_exact(spark, sf):
    """Kendall's tau of every two models over all sources, with the exact p-value."""
    g = predictions(spark, sf).groupBy("model", "source").agg(r(F.avg(F.col("score") * F.col("score")), 9).alias("s"))
    k = kendall(_two_models(g), ["model_a", "model_b"], "x", "y")
    return k.select("model_a", "model_b", "concordant", "discordant", r(F.col("tau")).alias("tau"), "p_kind", r(F.col("p_value"), 9).alias("p_value"))


@query("""WITH a AS (SELECT l_linenumber AS k, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linenumber AS k, count(*) / sum(count(*)) OVER () AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM a FULL JOIN b ON a.k = b.k)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 9) AS js_bits FROM j""")
def js_divergence(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    tot = W.partitionBy(F.lit(1))
    n = n.select((F.col("a") / F.sum("a").over(tot)).alias("p"), (F.col("b") / F.sum("b").over(tot)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)) / 2
    return n.agg(r(part("p") + part("q"), 9).alias("js_bits"))


@query(f"WITH {PREDICTIONS}, s AS (SELECT model, doc_id % 5 AS seed, avg(score) AS m FROM pred GROUP BY ALL) SELECT model, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(avg(m) - 2.7764451051977987 * stddev_samp(m) / sqrt(5), 6) AS ci_low, round(avg(m) + 2.7764451051977987 * stddev_samp(m) / sqrt(5), 6) AS ci_high FROM s GROUP BY model")
def student_t_ci(spark, sf):
    s = predictions(spark, sf).groupBy("model", (F.col("doc_id") % 5).alias("seed")).agg(F.avg("score").alias("m"))
    half = 2.7764451051977987 * F.stddev_samp("m") / F.sqrt(F.lit(5.0))  # the t quantile of 4 degrees of freedom
    return s.groupBy("model").agg(r(F.avg("m")).alias("mean"), r(F.stddev_samp("m")).alias("sd"), r(F.avg("m") - half).alias("ci_low"), r(F.avg("m") + half).alias("ci_high"))


# ---- graph, duplicates, splits


@query()
def components(spark, sf):
    return graph.set_components(set_items(spark, sf))


@query()
def component_stats(spark, sf):
    n = graph.set_components(set_items(spark, sf)).groupBy("component").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), (F.max("n") / F.sum("n")).alias("largest_share"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_hash_groups(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha"), "doc_id", "source")
    return d.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).where("n > 1")


@query(f"SELECT sha256(text) AS sha, count(*) AS n, string_agg(DISTINCT {split_sql('doc_id')}, ',' ORDER BY {split_sql('doc_id')}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {split_sql('doc_id')}) > 1")
def cross_split_dups(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split_of(F.col("doc_id")))).alias("s"))
    return d.where(F.size("s") > 1).select("sha", "n", F.array_join("s", ",").alias("splits"))


@query("""WITH c AS (SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT key, n * CAST(1000 AS DOUBLE) / sum(n) OVER () AS x FROM c),
k AS (SELECT key, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, key) AS rn, 1000 - sum(floor(x)) OVER () AS left_n FROM x)
SELECT key, CAST(f + CASE WHEN rn <= left_n THEN 1 ELSE 0 END AS BIGINT) AS target FROM k""")
def largest_remainder(spark, sf):
    return sets.largest_remainder(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n")), "key", "n", 1000)


@query(f"""WITH k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {draw_sql("fraction", "doc_id")}, doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT quality, fraction, count(*) AS n, min(doc_id) AS first_id FROM k, (SELECT unnest([10, 25, 50, 100]) AS fraction) WHERE rn <= greatest(1, floor(fraction * n / 100.0)) GROUP BY ALL""")
def label_fraction(spark, sf):
    order, by = [draw("fraction", F.col("doc_id")), F.col("doc_id")], ["quality"]
    d = table(spark, sf, "labels").select("doc_id", "quality")
    k = before(ranges(d, by, *order), by, order, {"rn": ("sum", F.lit(1).cast("long"))})
    k = sets.rejoined(k, durable(d.groupBy("quality").agg(F.count("*").alias("n"))), by)
    k = k.withColumn("fraction", F.explode(F.array(*[F.lit(i) for i in (10, 25, 50, 100)]))).where(F.col("rn") < F.greatest(F.lit(1), F.floor(F.col("fraction") * F.col("n") / 100)))
    return k.groupBy("quality", "fraction").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# ---- scalar functions and checks


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY event_type")
def json_props_filter(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).where("k >= 50")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").cast("decimal(38,0)").alias("k_sum"))


@query("""SELECT c_custkey, split_part(c_name, '#', 1) AS head, split_part(c_name, '#', -1) AS tail, lower(trim(c_mktsegment)) AS segment, coalesce(nullif(c_mktsegment, 'BUILDING'), '<missing>') AS known,
c_custkey || '_' || c_nationkey AS key, lpad(lower(to_hex(c_custkey)), 16, '0') AS hex16, sha256(c_name) AS sha, starts_with(c_name, 'Customer#') AS prefixed, contains(coalesce(c_mktsegment, ''), 'AUTO') AS auto,
least(1.0, greatest(0.0, c_acctbal / 10000)) AS clamped, CAST(sign(c_acctbal) AS INTEGER) AS sgn FROM customer""")
def scalar_functions(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.substring_index("c_name", "#", 1).alias("head"), F.substring_index("c_name", "#", -1).alias("tail"), F.lower(F.trim("c_mktsegment")).alias("segment"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("<missing>")).alias("known"), F.concat_ws("_", "c_custkey", "c_nationkey").alias("key"), F.lpad(F.lower(F.hex("c_custkey")), 16, "0").alias("hex16"),
        F.sha2("c_name", 256).alias("sha"), F.startswith("c_name", F.lit("Customer#")).alias("prefixed"), F.coalesce(F.contains("c_mktsegment", F.lit("AUTO")), F.lit(False)).alias("auto"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000)).alias("clamped"), F.signum("c_acctbal").cast("int").alias("sgn"))


@query(f"""WITH {SET_ITEMS}, a AS (SELECT set_id, list_sort(list(item_id)) AS v FROM si GROUP BY set_id)
SELECT set_id, len(v) AS n, v[1] AS first_item, list_contains(v, set_id) AS has_own, array_to_string(list_slice(v, 1, 2), ';') AS head, len(v) >= 2 AND len(v) = len(list_distinct(v)) AS valid FROM a""")
def array_functions(spark, sf):
    a = sets.canonical(set_items(spark, sf))
    v = F.col("items")
    return a.select("set_id", F.size(v).cast("long").alias("n"), F.element_at(v, 1).alias("first_item"), F.array_contains(v, F.col("set_id")).alias("has_own"), F.array_join(F.slice(v, 1, 2), ";").alias("head"), ((F.size(v) >= 2) & (F.size(v) == F.size(F.array_distinct(v)))).alias("valid"))


@query("""SELECT 'orders' AS tbl, count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS dup_keys, count(*) FILTER (o_totalprice IS NULL OR isnan(o_totalprice) OR isinf(o_totalprice)) AS bad_values, count(DISTINCT o_orderstatus) <= 1 AS is_constant FROM orders
UNION ALL SELECT 'documents', count(*), count(*) - count(DISTINCT doc_id), count(*) FILTER (n_chars NOT BETWEEN 0 AND 1000000), count(DISTINCT lang) <= 1 FROM documents
UNION ALL SELECT 'labels', count(*), count(*) - count(DISTINCT doc_id), count(*) FILTER (quality NOT IN (0, 1)), count(DISTINCT quality) <= 1 FROM labels""")
def quality_gate(spark, sf):
    def gate(name, key, bad, value):
        return table(spark, sf, name).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(key)).alias("dup_keys"), F.count_if(bad).alias("bad_values"), (F.count_distinct(value) <= 1).alias("is_constant")).select(F.lit(name).alias("tbl"), "n", "dup_keys", "bad_values", "is_constant")

    p = F.col("o_totalprice")
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return gate("orders", "o_orderkey", bad, "o_orderstatus").unionByName(gate("documents", "doc_id", ~F.col("n_chars").between(0, 1000000), "lang")).unionByName(gate("labels", "doc_id", ~F.col("quality").isin(0, 1), "quality"))


@query("""WITH u AS (SELECT user_id AS run_id, ts, event_id, event_type FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM u) SELECT run_id, event_id, event_type FROM k WHERE rn = 1""")
def run_registry_upsert(spark, sf):
    e = table(spark, sf, "events")
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return e.groupBy(F.col("user_id").alias("run_id")).agg(last.alias("x")).select("run_id", "x.event_id", "x.event_type")


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END AS code, p_size BETWEEN 10 AND 20 AS mid, NOT (p_brand IN ('Brand#11', 'Brand#12')) AS other, p_retailprice - p_size AS margin FROM part""")
def mapped_columns(spark, sf):
    code = F.create_map(*[F.lit(x) for k in (("SMALL", 1), ("MEDIUM", 2), ("LARGE", 3)) for x in k])
    return table(spark, sf, "part").select("p_partkey", F.try_element_at(code, "p_type").alias("code"), F.col("p_size").between(10, 20).alias("mid"), (~F.col("p_brand").isin("Brand#11", "Brand#12")).alias("other"), (F.col("p_retailprice") - F.col("p_size")).alias("margin"))


from . import more_queries  # noqa: E402,F401
