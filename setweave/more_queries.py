"""More queries with their SQL: feature matrix and learners, checked joins, five-choice tasks, splits and packers, protocol reports."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.keys import draw, draw_sql, uniform, uniform_sql
from .operators import choices, graph, metrics, multinomial, resampling, sets
from .operators.joins import first_variant, gather, paired, remapped
from .operators.quantiles import quantiles
from .plans.questions import CLASS_SQL, FITB_SQL, NEGATIVES_SQL, class_questions, cp_negatives, cuts, fitb_questions, item_classes
from .queries import B, query, r
from .sources.tables import PREDICTIONS, SET_ITEMS, VECTORS, predictions, set_items, split_of, split_sql, table, vectors
from .storage import durable, scratch, shared_dir

# ---- features and vectors


@query(f"""WITH {SET_ITEMS}, {VECTORS}, x AS (SELECT set_id, si.item_id, v FROM si JOIN vec USING (item_id)),
p AS (SELECT a.set_id, generate_subscripts(a.v, 1) AS d, unnest(a.v) AS x, unnest(b.v) AS y FROM x a JOIN x b ON a.set_id = b.set_id AND a.item_id < b.item_id),
f AS (SELECT set_id, d, avg(abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))) AS l, avg(CAST(x AS DOUBLE) * CAST(y AS DOUBLE)) AS m, count(*) AS n_pairs FROM p GROUP BY ALL)
SELECT set_id, max(n_pairs) AS n_pairs, 2 * count(*) AS width, round(sum(d * l + (d + 64) * m), 5) AS by_place, round(max(l), 6) AS largest, round(min(m), 6) AS least FROM f GROUP BY set_id""")
def set_feature_matrix(spark, sf):
    """The pair feature of every set (|a - b| and a * b, mean over pairs), told by sums over its places."""
    f = sets.features(set_items(spark, sf).join(vectors(spark, sf), "item_id"), "set_id", "v")
    half = (F.size("feature") / 2).cast("int")
    by_place = F.aggregate(F.transform("feature", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return f.select("set_id", "n_pairs", F.size("feature").cast("long").alias("width"), r(by_place, 5).alias("by_place"), r(F.array_max(F.slice("feature", F.lit(1), half))).alias("largest"), r(F.array_min(F.slice("feature", half + 1, half))).alias("least"))


@query()
def pca_explained(spark, sf):
    """Explained variance of the train-only principal components, and whether all vectors are of unit length after."""
    from .operators.learners import train_only_pca

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out, share = train_only_pca(e, 8, F.col("vec_id") % 10 < 7)
    n = out.agg(F.count("*").alias("rows"), F.max(F.abs(V.norm(F.col("pca")) - 1) < 1e-9).alias("unit"))
    return n.crossJoin(F.broadcast(spark.createDataFrame([(8, round(share, 9))], "k int, explained double")))  # one row each


@query()
def learner_chain(spark, sf):
    """Positive and negative sets by split: train-only components, pair features, logistic grid, refit check, test AUC and AP."""
    from .operators.learners import benchmark_chain

    return benchmark_chain(_examples(spark, sf), vectors(spark, sf), 16)


@query()
def pca_randomised(spark, sf):
    """Explained variance of the randomised components beside that of the exact ones, and how far the two are apart."""
    from .operators.learners import train_only_pca

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    train = F.col("vec_id") % 10 < 7
    out, share = train_only_pca(e, 8, train, randomised=True)
    exact = train_only_pca(e, 8, train)[1]
    n = out.agg(F.count("*").alias("rows"), F.max(F.abs(V.norm(F.col("pca")) - 1) < 1e-9).alias("unit"))
    return n.crossJoin(F.broadcast(spark.createDataFrame([(8, round(share, 9), round(exact, 9), abs(share - exact) < 1e-3)], "k int, explained double, exact double, close boolean")))  # one row each


def _examples(spark, sf, store=durable) -> DataFrame:
    """set_id, item_id, label, split: positive sets and the negatives made of them."""
    neg = cp_negatives(spark, sf, store).where("complete").select("set_id", F.explode(F.split("negative", ",").cast("array<long>")).alias("item_id"))
    return set_items(spark, sf).withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0))).withColumn("split", split_of(F.col("set_id")))


@query()
def fitb_learner_accuracy(spark, sf):
    """Accuracy of a fitted chain on fill-in-the-blank questions of the test split, and of scores that are uniform by hash."""
    from .operators import completion
    from .operators.learners import fit_chain

    chain = fit_chain(_examples(spark, sf), vectors(spark, sf), 16)
    guess = F.transform("scores", lambda _, i: uniform("guess", F.col("key"), i))
    right = lambda scores: F.sum((choices.first_max(scores) == F.col("correct_index")).cast("long"))
    parts = []
    with scratch(spark) as keep:
        q = fitb_questions(spark, sf, store=keep).where(split_of(F.col("set_id")) == "test").withColumnRenamed("set_id", "key")
        for s in completion.scored_parts(q, chain.items.withColumnRenamed("pca", "v"), chain.raw(), keep):
            parts.append(keep(s.withColumn("guess", guess).agg(F.count("*").alias("n"), right(F.col("scores")).alias("model"), right(F.col("guess")).alias("uniform"))))
        if not parts:
            parts.append(spark.createDataFrame([], "n long, model long, uniform long"))
        sums = reduce(DataFrame.unionByName, parts).agg(*[F.sum(c).alias(c) for c in ("n", "model", "uniform")]).where("n > 0")
        each = sums.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("scorer"), F.col(c).alias("right")) for c in ("model", "uniform")])).alias("x"))
        return durable(each.select("x.scorer", "n", r(F.col("x.right") / F.col("n")).alias("accuracy")))


#: Weights of a linear model of the pair feature of 64 numbers, by md5.
_GIVEN = f"g AS (SELECT CAST(d AS BIGINT) AS d, {uniform_sql('weight', 'd')} - CAST(0.5 AS DOUBLE) AS wl, {uniform_sql('weight', 'd + 64')} - CAST(0.5 AS DOUBLE) AS wm FROM range(64) t(d))"


@query(f"""WITH q AS ({FITB_SQL}), {VECTORS}, c AS (SELECT set_id, correct_index, CAST(unnest(range(4)) AS INTEGER) AS i, unnest(string_split(candidates, ',')) AS c, question FROM q),
m AS (SELECT set_id, correct_index, i, CAST(unnest(list_append(string_split(question, ','), c)) AS BIGINT) AS item_id FROM c),
x AS (SELECT m.*, [CAST(y AS DOUBLE) FOR y IN v] AS v FROM m JOIN vec USING (item_id)), {_GIVEN}, w AS (SELECT list(wl ORDER BY d) AS wl, list(wm ORDER BY d) AS wm FROM g),
p AS (SELECT a.set_id, a.correct_index, a.i, list_sum([abs(z[1] - z[2]) * z[3] + z[1] * z[2] * z[4] FOR z IN list_zip(a.v, b.v, wl, wm)]) AS s FROM x a JOIN x b ON a.set_id = b.set_id AND a.i = b.i AND a.item_id < b.item_id, w),
s AS (SELECT set_id, correct_index, i, round(avg(s), 9) AS s FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY s DESC, i) AS rn FROM s)
SELECT correct_index, count(*) AS n, round(avg(CAST(i = correct_index AS INTEGER)), 6) AS accuracy, round(avg(s), 5) AS mean_score FROM k WHERE rn = 1 GROUP BY correct_index""")
def fitb_given_weights(spark, sf):
    """Accuracy of a linear model with given weights on every fill-in-the-blank question, by the right answer's slot."""
    import numpy as np

    from .operators import completion
    from .operators.learners import Logistic

    rows = spark.range(128).select("id", (uniform("weight", F.col("id")) - 0.5).alias("w")).orderBy("id").collect()  # 128 weights
    model = Logistic(np.ones(1), np.array([[x["w"] for x in rows]]), np.zeros(1))
    logit, parts = F.transform("scores", lambda p: F.round(F.ln(p / (1 - p)), 9)), []
    with scratch(spark) as keep:
        q = fitb_questions(spark, sf, store=keep).withColumnRenamed("set_id", "key")
        for s in completion.scored_parts(q, vectors(spark, sf), model, keep):
            a = s.select("correct_index", logit.alias("scores")).withColumn("right", (choices.first_max(F.col("scores")) == F.col("correct_index")).cast("long"))
            parts.append(keep(a.groupBy("correct_index").agg(F.count("*").alias("n"), F.sum("right").alias("right"), F.sum(F.array_max("scores")).alias("total"))))
        if not parts:
            parts.append(spark.createDataFrame([], "correct_index int, n long, right long, total double"))
        a = reduce(DataFrame.unionByName, parts).groupBy("correct_index").agg(*[F.sum(c).alias(c) for c in ("n", "right", "total")])
        return durable(a.select("correct_index", "n", r(F.col("right") / F.col("n")).alias("accuracy"), r(F.col("total") / F.col("n"), 5).alias("mean_score")))


@query("SELECT label, CAST(d AS BIGINT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings) GROUP BY ALL")
def mean_vector(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    return x.groupBy("label", (F.col("d") + 1).cast("long").alias("dim")).agg(r(F.avg(F.col("x").cast("double"))).alias("mean"))


@query("""WITH x AS (SELECT a.vec_id, a.embedding AS v, b.embedding AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
p AS (SELECT vec_id, list_transform(list_zip(v, w), lambda z: {'a': CAST(z[1] AS DOUBLE), 'b': CAST(z[2] AS DOUBLE)}) AS z FROM x)
SELECT vec_id, round(list_sum(list_transform(z, lambda t: t.a * t.b)) / sqrt(list_sum(list_transform(z, lambda t: t.a * t.a))) / sqrt(list_sum(list_transform(z, lambda t: t.b * t.b))), 5) AS cosine,
round(list_max(list_transform(z, lambda t: abs(t.a - t.b))), 6) AS max_abs_diff, round(list_max(list_transform(z, lambda t: t.a)) / sqrt(list_sum(list_transform(z, lambda t: t.a * t.a))), 5) AS largest_unit FROM p""")
def vector_agreement(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    v, w = F.col("embedding"), F.col("w")
    return e.join(b, "vec_id").select("vec_id", r(V.cosine(v, w), 5).alias("cosine"), r(V.max_abs_diff(v, w)).alias("max_abs_diff"), r(F.array_max(V.unit(v)), 5).alias("largest_unit"))


@query(f"""WITH {SET_ITEMS}, a AS (SELECT set_id, list_sort(list(item_id)) AS v FROM si GROUP BY set_id)
SELECT set_id, array_to_string(list_concat(v[1:6], list_transform(range(greatest(0, 6 - len(v))), lambda k: -1)), ',') AS padded, least(6, len(v)) AS used, len(v) > 6 AS too_long FROM a""")
def padded_index(spark, sf):
    """Sets as rows of a fixed width, -1 where there is no item."""
    a = sets.canonical(set_items(spark, sf))
    n = F.size("items")
    pad = F.concat(F.slice("items", 1, 6), F.array_repeat(F.lit(-1).cast("long"), F.greatest(F.lit(0), 6 - n)))
    return a.select("set_id", F.array_join(pad, ",").alias("padded"), F.least(F.lit(6), n).cast("long").alias("used"), (n > 6).alias("too_long"))


@query(f"""WITH {PREDICTIONS}, l AS (SELECT model, label, 4 * score - 2 AS z FROM pred), p AS (SELECT model, label, 1 / (1 + exp(-z)) AS p FROM l)
SELECT model, round(avg(p), 6) AS mean_sigmoid, round(avg(-CASE WHEN label = 1 THEN CAST(0.75 AS DOUBLE) * (1 - p) * (1 - p) * ln(p) ELSE CAST(0.25 AS DOUBLE) * p * p * ln(1 - p) END), 6) AS focal FROM p GROUP BY model""")
def focal_loss(spark, sf):
    p = predictions(spark, sf).select("model", "label", (1 / (1 + F.exp(2 - 4 * F.col("score")))).alias("p"))
    return p.groupBy("model").agg(r(F.avg("p")).alias("mean_sigmoid"), r(F.avg(metrics.focal(F.col("label"), F.col("p"), 2.0, 0.75))).alias("focal"))


# ---- joins and aggregates


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def index_gather(spark, sf):
    """Every order's customer by key; a key that is not held raises."""
    return gather(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("o_orderkey", "c_name")


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
SELECT a.o_custkey, a.k, a.o_orderkey AS one, b.o_orderkey AS two FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.k = b.k WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F'""")
def paired_examples(spark, sf):
    """The k-th open order of a customer with the k-th filled one."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    return paired(side("O"), side("F"), ["o_custkey"], "o_orderkey")


@query("""WITH c AS (SELECT vec_id, CASE WHEN vec_id % 3 < 2 THEN 'train' ELSE 'test' END AS split, embedding FROM embeddings UNION ALL SELECT vec_id, 'valid', embedding FROM embeddings WHERE vec_id % 3 > 0),
w AS (SELECT p_partkey AS vec_id FROM part) SELECT w.vec_id, min(split) AS first_split, count(split) AS copies, count(split) > 0 AS held, TRUE AS agree FROM w LEFT JOIN c USING (vec_id) GROUP BY w.vec_id""")
def fallback_remap(spark, sf):
    """Vectors that are cached under one or more splits, looked up by id: the first split has them, copies must agree, missing ids are told."""
    e = table(spark, sf, "embeddings")
    c = e.select("vec_id", F.when(F.col("vec_id") % 3 < 2, "train").otherwise("test").alias("split"), "embedding").unionByName(e.where("vec_id % 3 > 0").select("vec_id", F.lit("valid").alias("split"), "embedding"))
    return remapped(table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id")), c, "vec_id", "split", "embedding")


@query("SELECT l_partkey, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) FILTER (l_quantity > 25) AS chosen, count(*) AS variants, count(*) FILTER (l_quantity > 25) AS usable FROM lineitem GROUP BY l_partkey")
def ordered_fallback(spark, sf):
    """The first usable variant of each item, in the order of variants."""
    v = table(spark, sf, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return first_variant(v, "l_partkey", "at", F.col("l_quantity") > 25, "l_orderkey")


@query("SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_big, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY o_custkey")
def bool_aggregates(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 50000).alias("all_big"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


@query("""WITH a AS (SELECT s_nationkey, round(avg(s_acctbal), 4) AS mean, round(min(s_acctbal), 4) AS least, round(max(s_acctbal), 4) AS most FROM supplier GROUP BY s_nationkey)
SELECT s_nationkey, metric, value FROM a UNPIVOT (value FOR metric IN (mean, least, most))""")
def melt_long(spark, sf):
    a = table(spark, sf, "supplier").groupBy("s_nationkey").agg(*[r(f("s_acctbal"), 4).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])
    return a.unpivot("s_nationkey", ["mean", "least", "most"], "metric", "value")


_BRANDS = "b AS (SELECT p_brand, round(avg(p_retailprice), 2) AS price FROM part GROUP BY p_brand)"


@query(f"WITH {_BRANDS} SELECT p_brand, price, rank() OVER (ORDER BY price DESC) AS rank_all FROM b")
def global_rank(spark, sf):
    b = table(spark, sf, "part").groupBy("p_brand").agg(r(F.avg("p_retailprice"), 2).alias("price"))
    return b.withColumn("rank_all", F.rank().over(W.orderBy(F.desc("price"))).cast("long"))  # a row a brand


@query(f"""WITH {_BRANDS}, o AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 50), k AS (SELECT * FROM b WHERE p_brand NOT IN (SELECT p_brand FROM o) OR price > 1400)
SELECT p_brand, rank() OVER (ORDER BY k.price DESC) AS rank_kept, a.rank_all, rank() OVER (ORDER BY k.price DESC) - a.rank_all AS moved FROM k JOIN (SELECT p_brand, rank() OVER (ORDER BY price DESC) AS rank_all FROM b) a USING (p_brand)""")
def provenance_rerank(spark, sf):
    """Ranks anew without the groups of a provenance, beside their ranks among all."""
    b = global_rank(spark, sf)
    o = table(spark, sf, "part").where("p_size = 50").select("p_brand").distinct()
    k = b.join(o.withColumn("out", F.lit(True)), "p_brand", "left").where("out is null or price > 1400")
    kept = F.rank().over(W.orderBy(F.desc("price"))).cast("long")  # a row a brand
    return k.withColumn("rank_kept", kept).select("p_brand", "rank_kept", "rank_all", (F.col("rank_kept") - F.col("rank_all")).alias("moved"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50")
def sorted_prefix(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(50)


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS seconds, round(count(*) / sum(value), 6) AS rate, round(max(value), 6) AS most, round(sum(octet_length(CAST(props AS BLOB))) / CAST(1048576 AS DOUBLE), 6) AS mb FROM events GROUP BY event_type""")
def cache_statistics(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("seconds"), r(F.count("*") / F.sum("value")).alias("rate"), r(F.max("value")).alias("most"), r(F.sum(F.octet_length("props")) / 1048576.0).alias("mb"))


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 224 WHEN 'MEDIUM' THEN 336 WHEN 'LARGE' THEN 384 END AS side FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE')
UNION ALL SELECT p_partkey, 512 FROM part WHERE p_type NOT IN ('SMALL', 'MEDIUM', 'LARGE')""")
def encoder_lookup(spark, sf):
    """A small registry joined by key; an unknown key raises."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), F.col("p_type")).otherwise("OTHER").alias("key"))
    registry = spark.createDataFrame([("SMALL", 224), ("MEDIUM", 336), ("LARGE", 384), ("OTHER", 512)], "key string, side int")
    return gather(p, registry, ["key"]).select("p_partkey", "side")


# ---- metrics by group


@query(f"""WITH {PREDICTIONS}, p AS (SELECT pred.*, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS length_group FROM pred JOIN documents USING (doc_id)),
e AS (SELECT model, length_group FROM p GROUP BY ALL HAVING sum(label) > 0 AND sum(label) < count(*)),
b AS (SELECT model, length_group, score, sum(label) AS p, sum(1 - label) AS n FROM p JOIN e USING (model, length_group) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model, length_group ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT model, length_group, CAST(sum(p + n) AS BIGINT) AS rows_, round(sum(p * (below + n / CAST(2 AS DOUBLE))) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY ALL""")
def length_group_auc(spark, sf):
    """AUC by length group, of groups of both classes."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long").alias("length_group"))
    p = predictions(spark, sf).join(d, "doc_id")
    keys = ["model", "length_group"]
    big = p.groupBy(*keys).agg(F.count("*").alias("rows_"), F.sum("label").alias("pos")).where("pos > 0 and pos < rows_").select(*keys, "rows_")
    return metrics.roc_auc(p.join(big, keys, "left_semi"), keys).join(big, keys).select(*keys, "rows_", r(F.col("auc")).alias("auc"))


@query(f"""WITH n AS ({NEGATIVES_SQL}), o AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS item_id FROM lineitem),
x AS (SELECT set_id, 1 AS label, item_id FROM o UNION ALL SELECT set_id, 0, CAST(unnest(string_split(negative, ',')) AS BIGINT) FROM n WHERE complete),
c AS (SELECT DISTINCT set_id, label, p_brand AS category, round(0.3 * label + CAST(0.7 AS DOUBLE) * {uniform_sql("contains", "set_id", "label")}, 3) AS score FROM x JOIN part ON p_partkey = item_id),
e AS (SELECT category FROM c GROUP BY category HAVING count(*) >= 200 AND sum(label) > 0 AND sum(label) < count(*)),
b AS (SELECT category, score, sum(label) AS p, sum(1 - label) AS n FROM c JOIN e USING (category) GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY category ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT category, CAST(sum(p + n) AS BIGINT) AS examples, round(sum(p * (below + n / CAST(2 AS DOUBLE))) / (sum(p) * sum(n)), 6) AS auc FROM r GROUP BY category""")
def contains_category_auc(spark, sf):
    """AUC over the sets that contain a category, of categories in 200 sets or more and both classes."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"))
    with scratch(spark) as keep:
        x, parts = _examples(spark, sf, keep).select("set_id", "label", "item_id"), []
        for c in cuts(max(1, 2 * table(spark, sf, "lineitem").count()), ["set_id"]):
            own = x.where(c).join(part, "item_id").select("set_id", "label", "category").distinct()
            own = own.withColumn("score", r(0.3 * F.col("label") + 0.7 * uniform("contains", F.col("set_id"), F.col("label")), 3))
            parts.append(keep(own.groupBy("category", "label", "score").agg(F.count("*").alias("w"))))
        c = durable(reduce(DataFrame.unionByName, parts).groupBy("category", "label", "score").agg(F.sum("w").alias("w")))  # some 2,000 rows a category
    n = c.groupBy("category").agg(F.sum("w").alias("examples"), F.sum(F.col("label") * F.col("w")).alias("pos")).where("examples >= 200 and pos > 0 and pos < examples").select("category", "examples")
    auc = metrics.roc_auc(c.join(n, "category", "left_semi"), ["category"], weight=F.col("w"))
    return auc.join(n, "category").select("category", "examples", r(F.col("auc")).alias("auc"))


@query(f"""WITH q AS ({FITB_SQL}), s AS (SELECT set_id, blank, correct_index, CAST(unnest(range(4)) AS INTEGER) AS i, unnest(string_split(candidates, ',')) AS c FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {draw_sql("fitb", "set_id", "c")} % 10 DESC, i) AS rn FROM s)
SELECT p_brand AS category, count(*) AS n, round(avg(CAST(i = correct_index AS INTEGER)), 6) AS accuracy FROM k JOIN part ON p_partkey = blank WHERE rn = 1 GROUP BY p_brand HAVING count(*) >= 100""")
def blank_category_accuracy(spark, sf):
    q = fitb_questions(spark, sf).select("set_id", "blank", "correct_index", F.posexplode(F.split("candidates", ",")).alias("i", "c"))
    best = metrics.first_argmax(q.withColumn("score", draw("fitb", F.col("set_id"), F.col("c")) % 10), ["set_id", "blank", "correct_index"], "i", "score")
    j = best.join(table(spark, sf, "part").select(F.col("p_partkey").alias("blank"), F.col("p_brand").alias("category")), "blank")
    return j.groupBy("category").agg(F.count("*").alias("n"), r(F.avg((F.col("predicted_index") == F.col("correct_index")).cast("double"))).alias("accuracy")).where("n >= 100")


@query(f"""WITH {PREDICTIONS}, c AS (SELECT doc_id, sum(CAST((score >= 0.5) = (label = 1) AS INTEGER)) AS k FROM pred GROUP BY doc_id)
SELECT count(*) AS examples, count(*) FILTER (k = 0) AS unanimous_failure, count(*) FILTER (k <= 1) AS majority_failure, count(*) FILTER (k BETWEEN 1 AND 3) AS disagreement, count(*) FILTER (k = 4) AS all_right FROM c""")
def consensus_classes(spark, sf):
    k = predictions(spark, sf).groupBy("doc_id").agg(F.sum(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int")).alias("k"))
    n = {"unanimous_failure": F.col("k") == 0, "majority_failure": F.col("k") <= 1, "disagreement": F.col("k").between(1, 3), "all_right": F.col("k") == 4}
    return k.agg(F.count("*").alias("examples"), *[F.count_if(c).alias(a) for a, c in n.items()])


@query(f"""WITH d AS (SELECT n_chars, {split_sql("doc_id")} = 'train' AS retained FROM documents)
SELECT retained, count(*) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, quantile_cont(n_chars, 0.9) AS p90 FROM d GROUP BY retained""")
def retained_vs_excluded(spark, sf):
    d = table(spark, sf, "documents").select("n_chars", (split_of(F.col("doc_id")) == "train").alias("retained"))
    return _spread(d, ["retained"], "n_chars")


def _spread(d: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, n, mean, median, p90 of a value."""
    d = durable(d)
    q = quantiles(d, groups, value, [0.5, 0.9]).groupBy(*groups).agg(*[F.max(F.when(F.col("q") == k, F.col("value"))).alias(name) for name, k in (("median", 0.5), ("p90", 0.9))])
    return sets.rejoined(d.groupBy(*groups).agg(F.count("*").alias("n"), r(F.avg(value)).alias("mean")), q, groups)


@query(f"""WITH {SET_ITEMS}, s AS (SELECT set_id, {split_sql("set_id")} = 'train' AS retained, count(*) AS items FROM si GROUP BY set_id),
u AS (SELECT o_custkey, count(*) AS sets FROM orders GROUP BY o_custkey), f AS (SELECT item_id, count(*) AS sets FROM si GROUP BY item_id),
x AS (SELECT 'length' AS part, retained, items AS v FROM s UNION ALL SELECT 'activity', retained, sets FROM s JOIN orders ON set_id = o_orderkey JOIN u USING (o_custkey)
UNION ALL SELECT 'frequency', retained, f.sets FROM si JOIN s USING (set_id) JOIN f USING (item_id))
SELECT part, retained, count(*) AS n, round(avg(v), 6) AS mean, median(v) AS median, quantile_cont(v, 0.9) AS p90 FROM x GROUP BY ALL""")
def retention_diagnostics(spark, sf):
    """Sets that are retained and those that are not: their lengths, how active their users are, how frequent their items."""
    si, o = set_items(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("set_id"), "o_custkey")
    s = durable(si.groupBy("set_id").agg(F.count("*").alias("v")).withColumn("retained", split_of(F.col("set_id")) == "train"))
    activity = s.drop("v").join(o, "set_id").join(o.groupBy("o_custkey").agg(F.count("*").alias("v")), "o_custkey")
    frequency = si.join(s.drop("v"), "set_id").join(si.groupBy("item_id").agg(F.count("*").alias("v")), "item_id")
    parts = [x.select(F.lit(name).alias("part"), "retained", "v") for name, x in (("length", s), ("activity", activity), ("frequency", frequency))]
    return _spread(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["part", "retained"], "v")


@query(f"""WITH {PREDICTIONS}, g AS (SELECT lang, model, round(avg(abs(score - label)), 4) AS loss FROM pred GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY loss) AS rk FROM g)
SELECT a.model, a.lang AS track_a, b.lang AS track_b, a.rk AS rank_a, b.rk AS rank_b, b.rk - a.rk AS moved, round(b.loss - a.loss, 6) AS delta FROM k a JOIN k b ON a.model = b.model AND a.lang < b.lang""")
def rank_stability(spark, sf):
    """Ranks of models on every two tracks (here: languages), and how far they move."""
    g = predictions(spark, sf).groupBy("lang", "model").agg(r(F.avg(F.abs(F.col("score") - F.col("label"))), 4).alias("loss"))
    k = g.withColumn("rk", F.rank().over(W.partitionBy("lang").orderBy("loss")).cast("long"))
    side = lambda s: k.select("model", F.col("lang").alias(f"track_{s}"), F.col("rk").alias(f"rank_{s}"), F.col("loss").alias(f"loss_{s}"))
    j = side("a").join(side("b"), "model").where("track_a < track_b")  # a row a model and track
    return j.select("model", "track_a", "track_b", "rank_a", "rank_b", (F.col("rank_b") - F.col("rank_a")).alias("moved"), r(F.col("loss_b") - F.col("loss_a")).alias("delta"))


@query(f"""WITH {PREDICTIONS}, g AS (SELECT model, model % 2 AS family, {split_sql("doc_id")} AS split, round(avg(abs(score - label)), 6) AS loss FROM pred GROUP BY ALL),
b AS (SELECT family, arg_min(model, (loss, model)) AS model FROM g WHERE split = 'valid' GROUP BY family)
SELECT family, model, loss AS test_loss FROM b JOIN g USING (family, model) WHERE split = 'test'""".replace("arg_min(model, (loss, model))", "(list(model ORDER BY loss, model))[1]"))
def validation_selected(spark, sf):
    """The best model of each family on validation, and its test loss."""
    g = predictions(spark, sf).groupBy("model", (F.col("model") % 2).alias("family"), split_of(F.col("doc_id")).alias("split")).agg(r(F.avg(F.abs(F.col("score") - F.col("label")))).alias("loss"))
    b = g.where("split = 'valid'").groupBy("family").agg(F.min_by("model", F.struct("loss", "model")).alias("model"))
    return b.join(g.where("split = 'test'"), ["family", "model"]).select("family", "model", F.col("loss").alias("test_loss"))


# ---- five-choice questions

_FIVE = f"""c AS (SELECT c_custkey AS question_num, c_mktsegment AS dimension, unnest(range(5)) AS i FROM customer),
s AS (SELECT *, {draw_sql("five", "question_num", "i")} % 20 AS score, 1 + {draw_sql("vote", "question_num", "i")} % 9 AS votes FROM c),
q AS (SELECT question_num, dimension, (list(i ORDER BY score DESC, i))[1] AS predicted, (list(i ORDER BY votes DESC, i))[1] AS majority, {draw_sql("gold", "question_num")} % 5 AS archive, sum(votes) AS votes FROM s GROUP BY question_num, dimension),
a AS (SELECT q.*, s.votes / CAST(q.votes AS DOUBLE) AS share FROM q JOIN s ON q.question_num = s.question_num AND s.i = q.predicted)"""


def five_questions(spark, sf) -> DataFrame:
    """question_num, dimension, scores, gt_distribution, archive_gt_index of synthetic questions: one a customer."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("question_num"), F.col("c_mktsegment").alias("dimension"))
    of = lambda seed: F.array(*[draw(seed, F.col("question_num"), F.lit(i)) for i in range(5)])
    votes = F.transform(of("vote"), lambda x: 1 + x % 9)
    c = c.withColumns({"scores": F.transform(of("five"), lambda x: (x % 20).cast("double")), "votes": votes})
    share = F.transform("votes", lambda x: x / F.aggregate("votes", F.lit(0).cast("long"), lambda s, v: s + v))
    return c.select("question_num", "dimension", "scores", share.alias("gt_distribution"), (draw("gold", F.col("question_num")) % 5).cast("int").alias("archive_gt_index"))


@query(f"WITH {_FIVE} SELECT dimension, count(*) AS n, round(avg(CAST(predicted = archive AS INTEGER)), 6) AS archive_accuracy, round(avg(CAST(predicted = majority AS INTEGER)), 6) AS majority_accuracy, round(avg(share), 6) AS human_agreement FROM a GROUP BY dimension")
def five_choice_facets(spark, sf):
    return choices.by_facet(choices.answered(five_questions(spark, sf)), "dimension")


@query(f"WITH {_FIVE} SELECT question_num, CAST(majority AS INTEGER) AS majority_gt_index, CAST(archive AS INTEGER) AS archive_gt_index FROM q WHERE majority <> archive")
def label_disagreement(spark, sf):
    return choices.answered(five_questions(spark, sf)).where("majority_gt_index <> archive_gt_index").select("question_num", "majority_gt_index", "archive_gt_index")


# ---- splits, graph, protocol


_COMPONENTS = """WITH RECURSIVE e AS (SELECT doc_id AS s, sha256(coalesce(text, '')) AS i FROM documents UNION SELECT doc_id, concat_ws('/', source, lang, n_chars) FROM documents),
p AS (SELECT DISTINCT a.s, b.s AS t FROM e a JOIN e b USING (i)), reach AS (SELECT s, t FROM p UNION SELECT reach.s, p.t FROM reach JOIN p ON reach.t = p.s) SELECT s AS set_id, min(t) AS component FROM reach GROUP BY s"""


@query(_COMPONENTS)
def document_components(spark, sf):
    """Documents that share a text, or a source, language and length, also through others."""
    d = table(spark, sf, "documents")
    e = d.select(F.col("doc_id").alias("set_id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("item_id")).unionByName(d.select(F.col("doc_id").alias("set_id"), F.concat_ws("/", "source", "lang", "n_chars").alias("item_id")))
    return graph.set_components(e)


@query("""WITH RECURSIVE k AS (SELECT doc_id, lang || '/' || n_chars AS item_id, lang || '/' || source || '/' || (n_chars // 3) AS cls FROM documents),
e AS (SELECT doc_id AS s, item_id AS i FROM k UNION SELECT k.doc_id, c.cls FROM k JOIN (SELECT DISTINCT item_id, min(cls) OVER (PARTITION BY item_id) AS cls FROM k) c USING (item_id)),
p AS (SELECT DISTINCT a.s, b.s AS t FROM e a JOIN e b USING (i)), reach AS (SELECT s, t FROM p UNION SELECT reach.s, p.t FROM reach JOIN p ON reach.t = p.s), c AS (SELECT s, min(t) AS component FROM reach GROUP BY s),
n AS (SELECT component, count(*) AS n FROM c GROUP BY component) SELECT count(*) AS components, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, round(max(n) / sum(n), 6) AS largest_share FROM n""")
def class_component_stats(spark, sf):
    """Components of documents that share a language and length, where lengths of one source and class are one item as well."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("set_id"), F.concat_ws("/", "lang", "n_chars").alias("item_id"), F.concat_ws("/", "lang", "source", F.floor(F.col("n_chars") / 3)).alias("cls"))
    classes = d.groupBy("item_id").agg(F.min("cls").alias("cls"))
    n = graph.set_components(d.select("set_id", "item_id"), classes=classes).groupBy("component").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), r(F.max("n") / F.sum("n")).alias("largest_share"))


_AT = "CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END"


@query(f"""WITH {SET_ITEMS}, c AS (SELECT set_id, {split_sql("set_id")} AS split, list_sort(list(item_id)) AS items FROM si GROUP BY set_id),
k AS (SELECT *, first_value(set_id) OVER w AS kept, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY items ORDER BY {_AT}, set_id)) SELECT kept AS kept_set_id, set_id AS removed_set_id, split FROM k WHERE rn > 1""")
def duplicate_sets(spark, sf):
    """Sets with the items of an earlier one, in the order of splits, and which of them stays."""
    from .sources.assembly import duplicate_log

    x = set_items(spark, sf).withColumn("split", split_of(F.col("set_id")))
    return duplicate_log(x, F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2))


@query(f"""WITH {SET_ITEMS}, x AS (SELECT 'item' AS kind, {split_sql("l_orderkey")} AS split, CAST(l_partkey AS VARCHAR) AS k FROM lineitem UNION SELECT 'user', {split_sql("o_orderkey")}, CAST(o_custkey AS VARCHAR) FROM orders
UNION SELECT 'set', {split_sql("set_id")}, array_to_string(list_sort(list(item_id)), ',') FROM si GROUP BY set_id UNION SELECT 'digest', {split_sql("doc_id")}, sha256(coalesce(text, '')) FROM documents)
SELECT kind, a.split AS split_a, b.split AS split_b, count(*) AS shared FROM x a JOIN x b USING (kind, k) WHERE a.split < b.split GROUP BY ALL""")
def split_overlap_kinds(spark, sf):
    """What every two splits share: items, users, whole sets, contents by digest."""
    part = lambda kind, split, k, df: df.select(F.lit(kind).alias("kind"), split_of(F.col(split)).alias("split"), k.cast("string").alias("k"))
    x = part("item", "l_orderkey", F.col("l_partkey"), table(spark, sf, "lineitem")).unionByName(part("user", "o_orderkey", F.col("o_custkey"), table(spark, sf, "orders")))
    x = x.unionByName(part("set", "set_id", F.array_join("items", ","), sets.canonical(set_items(spark, sf))))
    x = x.unionByName(part("digest", "doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256), table(spark, sf, "documents")))
    x = x.groupBy("kind", "k").agg(F.array_sort(F.collect_set("split")).alias("s"))
    a = x.select("kind", F.explode("s").alias("split_a"), "s").select("kind", "split_a", F.explode("s").alias("split_b"))  # three splits at most
    return a.where("split_a < split_b").groupBy("kind", "split_a", "split_b").agg(F.count("*").alias("shared"))


@query("""SELECT event_id, CAST(json_object('k', coalesce(json_extract_string(props, '$.k'), '<missing>'), 'type', event_type, 'user', CAST(user_id AS VARCHAR)) AS VARCHAR) AS told FROM events""")
def merged_maps(spark, sf):
    """Maps parsed, given defaults, merged and written as JSON."""
    e = table(spark, sf, "events")
    held = F.from_json("props", "map<string,string>")
    both = F.map_concat(F.create_map(F.lit("k"), F.coalesce(F.try_element_at(held, F.lit("k")), F.lit("<missing>"))), F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    return e.select("event_id", F.to_json(both).alias("told"))


@query(f"WITH {SET_ITEMS} SELECT item_id, min(set_id) AS first_set, count(*) AS sets FROM si GROUP BY item_id")
def first_set_map(spark, sf):
    return set_items(spark, sf).groupBy("item_id").agg(F.min("set_id").alias("first_set"), F.count("*").alias("sets"))


_PURE = f"""u AS (SELECT o_orderkey AS set_id, {split_sql("o_custkey")} AS split FROM orders), {SET_ITEMS},
n AS (SELECT item_id, split, count(*) AS n FROM si JOIN u USING (set_id) GROUP BY ALL),
k AS (SELECT item_id, split, row_number() OVER (PARTITION BY item_id ORDER BY n / sqrt(CASE split WHEN 'train' THEN CAST(0.7 AS DOUBLE) WHEN 'valid' THEN 0.1 ELSE 0.2 END) DESC, CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END) AS rn FROM n),
w AS (SELECT item_id, split AS owner FROM k WHERE rn = 1), y AS (SELECT set_id, u.split, bool_and(owner = u.split) AS pure FROM si JOIN u USING (set_id) JOIN w USING (item_id) GROUP BY ALL)"""


@query(f"WITH {_PURE} SELECT split, count(*) AS sets, count(*) FILTER (pure) AS pure FROM y GROUP BY split")
def pure_set_counts(spark, sf):
    """Sets split by their users; an item is owned by the split that holds it most; sets whose split owns all items stay."""
    items = set_items(spark, sf)
    of = table(spark, sf, "orders").select(F.col("o_orderkey").alias("set_id"), split_of(F.col("o_custkey")).alias("split"))
    owners = graph.owned_items(items, of, {"train": 0.7, "valid": 0.1, "test": 0.2})
    return graph.pure_sets(items, of, owners).groupBy("split").agg(F.count("*").alias("sets"), F.count_if("pure").alias("pure"))


@query()
def packed_sets(spark, sf):
    """Sets of documents by source dealt to splits by their owners, whole capacities filled."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("set_id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("item_id"))
    n = d.count()
    return graph.pack_sets(d, {"train": n // 2, "valid": n // 20, "test": n // 10})


@query(f"""WITH {SET_ITEMS}, b AS (SELECT set_id FROM si GROUP BY set_id HAVING count(*) >= 2), x AS (SELECT {split_sql("set_id")} AS split, set_id, item_id FROM si JOIN b USING (set_id))
SELECT split, count(DISTINCT set_id) AS sets, count(DISTINCT item_id) AS items, count(DISTINCT set_id) AS positives, count(DISTINCT set_id) AS negatives, count(DISTINCT set_id) AS questions,
(count(DISTINCT set_id) + 3) // 4 AS slot_0, count(DISTINCT set_id) // 4 AS slot_3, CAST(0 AS BIGINT) AS unresolved FROM x GROUP BY split""")
def regenerated_protocol(spark, sf):
    """A protocol assembled from given splits, its questions made anew, and read back from its files; the files go afterwards."""
    from .sources import assembly, protocol

    x = set_items(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category")), "item_id")
    at = F.row_number().over(W.partitionBy("set_id").orderBy("item_id"))  # sets are of bounded size
    x = x.select(split_of(F.col("set_id")).alias("split"), F.col("set_id").cast("string").alias("set_id"), at.alias("index"), F.col("item_id").cast("string").alias("item_id"), "category", F.count("*").over(W.partitionBy("set_id")).alias("n"))
    path = f"{shared_dir(spark)}/protocol-{uuid.uuid4().hex}"
    assembly.assemble(x.where("n >= 2").drop("n"), path, 42)
    with scratch(spark) as keep:
        parts = []
        for s in protocol.SPLITS:  # every file is parsed once
            sets_, cp, q = [keep(x) for x in (protocol.read_sets(spark, path, s).drop("category"), protocol.read_compatibility(spark, path, s), protocol.read_fitb(spark, path, s))]
            used = cp.select(F.explode("keys").alias("key")).unionByName(q.select(F.explode(F.concat("question", "answers")).alias("key")))
            used = used.groupBy("key").agg(F.count("*").alias("n"))
            one = sets_.agg(F.count_distinct("set_id").alias("sets"), F.count_distinct("item_id").alias("items")).crossJoin(F.broadcast(cp.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))))
            one = one.crossJoin(F.broadcast(q.agg(F.count("*").alias("questions"), F.count_if(F.col("correct_index") == 0).alias("slot_0"), F.count_if(F.col("correct_index") == 3).alias("slot_3"))))
            lost = used.join(protocol.item_keys(sets_), "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("unresolved"))
            parts.append(durable(one.crossJoin(F.broadcast(lost)).select(F.lit(s).alias("split"), "*")))  # one row each
    assembly.remove(spark, path)
    return reduce(DataFrame.unionByName, parts)


_SPLITS = f"x AS (SELECT l_orderkey AS set_id, l_partkey AS item_id, {split_sql('l_orderkey')} AS split FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_SPLITS}, q AS (SELECT split, count(*) AS fitb, count(*) FILTER (correct_index = 0) AS slot_0 FROM (SELECT {split_sql('set_id')} AS split, correct_index FROM ({FITB_SQL})) GROUP BY split),
n AS (SELECT split, count(*) FILTER (complete) AS negatives FROM (SELECT {split_sql('set_id')} AS split, complete FROM ({NEGATIVES_SQL})) GROUP BY split)
SELECT split, count(DISTINCT set_id) AS sets, count(DISTINCT item_id) AS items, any_value(negatives) AS negatives, any_value(fitb) AS fitb, any_value(slot_0) AS slot_0 FROM x JOIN q USING (split) JOIN n USING (split) GROUP BY split""")
def split_report(spark, sf):
    x = set_items(spark, sf).withColumn("split", split_of(F.col("set_id"))).groupBy("split").agg(F.count_distinct("set_id").alias("sets"), F.count_distinct("item_id").alias("items"))
    q = fitb_questions(spark, sf).groupBy(split_of(F.col("set_id")).alias("split")).agg(F.count("*").alias("fitb"), F.count_if(F.col("correct_index") == 0).alias("slot_0"))
    n = cp_negatives(spark, sf).groupBy(split_of(F.col("set_id")).alias("split")).agg(F.count_if("complete").alias("negatives"))
    return x.join(q, "split").join(n, "split").select("split", "sets", "items", "negatives", "fitb", "slot_0")


@query(f"""WITH n AS ({NEGATIVES_SQL}), a AS (SELECT set_id, list_sort(list(p_brand)) AS cats FROM (SELECT DISTINCT l_orderkey AS set_id, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY set_id),
b AS (SELECT set_id, list_sort(list(p_brand)) AS cats FROM (SELECT set_id, CAST(unnest(string_split(negative, ',')) AS BIGINT) AS item_id FROM n WHERE complete) JOIN part ON p_partkey = item_id GROUP BY set_id)
SELECT count(*) AS negatives, count(*) FILTER (a.cats = b.cats) AS same_categories FROM a JOIN b USING (set_id)""")
def category_match(spark, sf):
    """Whether negatives have the multiset of categories of their positives."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_brand")
    cats = lambda x, name: x.join(part, "item_id").groupBy("set_id").agg(F.array_sort(F.collect_list("p_brand")).alias(name))
    with scratch(spark) as keep:
        n, parts = cp_negatives(spark, sf, keep).where("complete").select("set_id", F.explode(F.split("negative", ",").cast("array<long>")).alias("item_id")), []
        for c in cuts(max(1, 2 * table(spark, sf, "lineitem").count()), ["set_id"]):
            j = cats(set_items(spark, sf).where(c), "a").join(cats(n.where(c), "b"), "set_id")
            parts.append(keep(j.agg(F.count("*").alias("negatives"), F.count_if(F.col("a") == F.col("b")).alias("same_categories"))))
        return durable(reduce(DataFrame.unionByName, parts).agg(*[F.sum(k).alias(k) for k in ("negatives", "same_categories")]))


@query(f"""WITH q AS ({FITB_SQL}), c AS (SELECT set_id, question, blank, correct_index, CAST(unnest(range(4)) AS INTEGER) AS i, CAST(unnest(string_split(candidates, ',')) AS BIGINT) AS item_id FROM q),
d AS (SELECT c.*, p_brand, p_name FROM c JOIN part ON p_partkey = item_id), o AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS item_id FROM lineitem),
b AS (SELECT d.*, t.p_brand AS blank_brand, t.p_name AS blank_name FROM d JOIN part t ON t.p_partkey = blank),
f AS (SELECT set_id, array_to_string(list_sort(list(item_id)), ',') AS items FROM o GROUP BY set_id),
g AS (SELECT array_to_string(list_sort(list_append(list_transform(string_split(question, ','), lambda z: CAST(z AS BIGINT)), item_id)), ',') AS items FROM c WHERE i <> correct_index)
SELECT (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM b WHERE p_brand <> blank_brand) AS other_category, (SELECT count(*) FROM b JOIN o USING (set_id, item_id) WHERE i <> correct_index) AS own_distractor,
(SELECT count(*) FROM (SELECT set_id FROM c GROUP BY set_id HAVING count(DISTINCT item_id) < 4)) AS repeated_candidate, (SELECT count(*) FROM g WHERE items IN (SELECT items FROM f)) AS completes_positive, (SELECT count(*) FROM b WHERE i = correct_index AND item_id <> blank) AS wrong_slot""")
def question_safeguards(spark, sf):
    """Questions whose candidates break a rule: other category, an own item, one told twice, one that completes a positive set, wrong slot."""
    with scratch(spark) as keep:
        q = fitb_questions(spark, sf)
        c = q.select("set_id", "question", "blank", "correct_index", F.posexplode(F.split("candidates", ",")).alias("i", "c")).withColumn("item_id", F.col("c").cast("long"))
        part = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_brand")
        own = set_items(spark, sf).withColumn("own", F.lit(True))
        whole = sets.canonical(set_items(spark, sf)).select(F.array_join("items", ",").alias("items")).distinct().withColumn("positive", F.lit(True))
        blank = q.select("set_id", "blank").join(part.select(F.col("item_id").alias("blank"), F.col("p_brand").alias("blank_brand")), "blank").drop("blank")
        b = keep(c.join(part, "item_id")).join(keep(blank), "set_id").join(own, ["set_id", "item_id"], "left")
        items = F.array_join(F.array_sort(F.array_append(F.transform(F.split("question", ","), lambda z: z.cast("long")), F.col("item_id"))), ",")
        b = keep(b.withColumn("items", items).drop("question", "c")).join(whole, "items", "left")
        wrong = F.col("i") != F.col("correct_index")
        by = b.groupBy("set_id").agg(F.count_if(F.col("p_brand") != F.col("blank_brand")).alias("other_category"), F.count_if(wrong & F.col("own").isNotNull()).alias("own_distractor"), (F.count_distinct("item_id") < 4).cast("long").alias("repeated_candidate"),
                                    F.count_if(wrong & F.col("positive").isNotNull()).alias("completes_positive"), F.count_if(~wrong & (F.col("item_id") != F.col("blank"))).alias("wrong_slot"))
        names = ["other_category", "own_distractor", "repeated_candidate", "completes_positive", "wrong_slot"]
        return durable(by.agg(F.count("*").alias("questions"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))


@query(CLASS_SQL)
def fitb_class_questions(spark, sf):
    """Fill-in-the-blank questions in which items of one class stand for the same thing."""
    return class_questions(spark, sf)


@query(f"""WITH q AS ({CLASS_SQL}), k AS (SELECT p_partkey AS item_id, p_partkey % (SELECT count(*) FROM embeddings) AS cls, p_brand FROM part),
c AS (SELECT set_id, question, blank, correct_index, CAST(unnest(range(4)) AS INTEGER) AS i, CAST(unnest(string_split(candidates, ',')) AS BIGINT) AS item_id FROM q), o AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS item_id FROM lineitem),
f AS (SELECT set_id, array_to_string(list_sort(list(item_id)), ',') AS items, array_to_string(list_sort(list(cls)), ',') AS classes FROM o JOIN k USING (item_id) GROUP BY set_id),
m AS (SELECT set_id, i, CAST(unnest(string_split(question, ',')) AS BIGINT) AS item_id FROM c WHERE i <> correct_index UNION ALL SELECT set_id, i, item_id FROM c WHERE i <> correct_index),
d AS (SELECT set_id, i, array_to_string(list_sort(list(item_id)), ',') AS items, array_to_string(list_sort(list(cls)), ',') AS classes FROM m JOIN k USING (item_id) GROUP BY ALL),
w AS (SELECT c.*, k.cls, k.p_brand FROM c JOIN k USING (item_id)), oc AS (SELECT DISTINCT set_id, cls FROM o JOIN k USING (item_id)), n AS (SELECT correct_index, count(*) AS n FROM q GROUP BY 1)
SELECT (SELECT count(*) FROM q) AS questions, (SELECT max(n) - min(n) FROM n) AS slot_spread, (SELECT count(*) FROM w JOIN k b ON b.item_id = blank WHERE w.p_brand <> b.p_brand) AS other_category,
(SELECT count(*) FROM w JOIN o USING (set_id, item_id) WHERE i <> correct_index) AS own_by_id, (SELECT count(*) FROM w JOIN oc USING (set_id, cls) WHERE i <> correct_index) AS own_by_class,
(SELECT count(*) FROM (SELECT set_id FROM w GROUP BY set_id HAVING count(DISTINCT item_id) < 4)) AS repeated_by_id, (SELECT count(*) FROM (SELECT set_id FROM w GROUP BY set_id HAVING count(DISTINCT cls) < 4)) AS repeated_by_class,
(SELECT count(*) FROM d WHERE items IN (SELECT items FROM f)) AS positive_by_id, (SELECT count(*) FROM d WHERE classes IN (SELECT classes FROM f)) AS positive_by_class""")
def class_safeguards(spark, sf):
    """Questions by class whose distractors break a rule, by id and by class: own item, repeated, one that completes a positive set."""
    with scratch(spark) as keep:
        q = class_questions(spark, sf, store=keep)
        k = keep(item_classes(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_brand"), "item_id"))
        own = keep(set_items(spark, sf).join(k.select("item_id", "cls"), "item_id").groupBy("set_id").agg(F.collect_list(F.struct("item_id", "cls")).alias("own")))  # sets are of bounded size
        of = lambda v, f: F.transform(v, lambda x: x[f])
        # sets and completed sets are compared by 128 bits of hash, by id and by class
        hashed = lambda v: F.array(*[F.struct(F.lit(f).alias("by"), *[F.xxhash64(F.lit(n), F.array_sort(of(v, f))).alias(f"h{n}") for n in (1, 2)]) for f in ("item_id", "cls")])
        whole = own.select(F.inline(hashed(F.col("own"))))
        ids = lambda c: F.split(c, ",").cast("array<long>")
        # a question is one row again once its items (-1: the blank, -2: the question's) have met their classes
        told = F.concat(F.transform(ids("candidates"), lambda x, i: F.struct(i.alias("i"), x.alias("item_id"))), F.array(F.struct(F.lit(-1).alias("i"), F.col("blank").alias("item_id"))), F.transform(ids("question"), lambda x: F.struct(F.lit(-2).alias("i"), x.alias("item_id"))))
        c, wrong = F.filter("items", lambda x: x["i"] >= 0), F.filter("items", lambda x: (x["i"] >= 0) & (x["i"] != F.col("correct_index")))
        rest = F.transform(F.filter("items", lambda x: x["i"] == -2), lambda x: F.struct(x["item_id"].alias("item_id"), x["cls"].alias("cls")))
        among = lambda f: F.size(F.filter("wrong", lambda x: F.array_contains(of("own", f), x[f])))
        few = lambda f: (F.size(F.array_distinct(of("c", f))) < 4).cast("long")
        names, parts = ["other_category", "own_by_id", "own_by_class", "repeated_by_id", "repeated_by_class", "positive_by_id", "positive_by_class"], []
        for part in cuts(2 * q.count(), ["set_id"]):
            x = q.where(part).select("set_id", "correct_index", F.inline(told)).join(k, "item_id").groupBy("set_id", "correct_index").agg(F.collect_list(F.struct("i", "item_id", "cls", "p_brand")).alias("items"))
            x = x.join(own.where(part), "set_id", "left").withColumns({"c": c, "wrong": wrong, "rest": rest, "brand": F.filter("items", lambda x: x["i"] == -1)[0]["p_brand"]})
            made = F.flatten(F.transform("wrong", lambda x: hashed(F.array_append("rest", F.struct(x["item_id"].alias("item_id"), x["cls"].alias("cls"))))))
            with scratch(spark) as once:
                x = once(x.select(F.size(F.filter("c", lambda x: x["p_brand"] != F.col("brand"))).alias("other_category"), among("item_id").alias("own_by_id"), among("cls").alias("own_by_class"), few("item_id").alias("repeated_by_id"), few("cls").alias("repeated_by_class"), made.alias("made")))
                parts.append(keep(x.agg(*[F.sum(n).alias(n) for n in names[:5]], F.lit(0).cast("long").alias(names[5]), F.lit(0).cast("long").alias(names[6]))))
                hit = x.select(F.inline("made")).join(whole, ["by", "h1", "h2"], "left_semi")
                parts.append(keep(hit.agg(*[F.lit(0).cast("long").alias(n) for n in names[:5]], F.count_if(F.col("by") == "item_id").alias(names[5]), F.count_if(F.col("by") == "cls").alias(names[6]))))
        slots = q.groupBy("correct_index").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("questions"), (F.max("n") - F.min("n")).alias("slot_spread"))
        if not parts:
            parts.append(spark.range(0).select(*[F.col("id").alias(n) for n in names]))
        sums = reduce(DataFrame.unionByName, parts).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        out = slots.crossJoin(F.broadcast(sums))  # one row each
        return durable(out.select("questions", "slot_spread", "other_category", "own_by_id", "own_by_class", "repeated_by_id", "repeated_by_class", "positive_by_id", "positive_by_class"))


@query(f"""WITH {PREDICTIONS} SELECT model, count(*) AS n, count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) FILTER (score NOT BETWEEN 0 AND 1 OR score IS NULL) AS bad_scores, count(DISTINCT label) AS labels,
(SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) - count(*) AS missing FROM pred GROUP BY model""")
def package_checks(spark, sf):
    """Rows, ids, ranges, labels and missing examples of every model's results."""
    want = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("want"))
    s = F.col("score")
    p = predictions(spark, sf).groupBy("model").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"), F.count_if(s.isNull() | ~s.between(0, 1)).alias("bad_scores"), F.count_distinct("label").alias("labels"))
    return p.crossJoin(F.broadcast(want)).withColumn("missing", F.col("want") - F.col("n")).drop("want")  # want is one row


@query(f"""WITH {PREDICTIONS}, p AS (SELECT *, 1 + doc_id % 3 AS w FROM pred), b AS (SELECT model, score, sum(label * w) AS p, sum((1 - label) * w) AS n FROM p GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER d AS tp, sum(p + n) OVER d AS t FROM b WINDOW d AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, round(sum(p * (below + n / CAST(2 AS DOUBLE))) / (sum(p) * sum(n)), 6) AS auc, round(sum(CAST(p AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(t AS DOUBLE)) / CAST(sum(p) AS DOUBLE), 6) AS ap FROM c GROUP BY model""")
def weighted_auc_ap(spark, sf):
    p = predictions(spark, sf)
    w = (1 + F.col("doc_id") % 3).cast("double")
    a, b = metrics.roc_auc(p, ["model"], weight=w, strict=True), metrics.average_precision(p, ["model"], weight=w)
    return a.join(b, "model").select("model", r(F.col("auc")).alias("auc"), r(F.col("ap")).alias("ap"))


# ---- intervals of ranking metrics and questions, agreement of ranks


_RANKED = """b AS (SELECT model, replicate, score, sum(label * w * weight) AS p, sum((1 - label) * w * weight) AS n FROM pw JOIN u USING (unit) JOIN w USING (unit_no) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model, replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
m AS (SELECT model, replicate, sum(p * (below + n / CAST(2 AS DOUBLE))) / (sum(p) * sum(n)) AS auc FROM c GROUP BY ALL HAVING sum(p) > 0 AND sum(n) > 0)"""


@query(f"""WITH {PREDICTIONS}, pw AS (SELECT *, doc_id AS unit, 1 + doc_id % 3 AS weight FROM pred), u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS unit_no FROM (SELECT DISTINCT unit FROM pw)), {multinomial.counts_sql("u", [], "rank", B)}, {_RANKED},
d AS (SELECT model, replicate, sum(CAST(p AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(t AS DOUBLE)) / CAST(sum(p) AS DOUBLE) AS ap FROM (SELECT *, sum(p) OVER e AS tp, sum(p + n) OVER e AS t FROM b WINDOW e AS (PARTITION BY model, replicate ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) WHERE t > 0 GROUP BY ALL)
SELECT model, round(quantile_cont(auc, 0.025), 6) AS auc_low, round(quantile_cont(auc, 0.975), 6) AS auc_high, round(quantile_cont(ap, 0.025), 6) AS ap_low, round(quantile_cont(ap, 0.975), 6) AS ap_high FROM m JOIN d USING (model, replicate) GROUP BY model""")
def boot_ranking_ci(spark, sf):
    """Intervals of AUC and average precision under paired draws of documents, which weigh 1 to 3."""
    p = predictions(spark, sf)
    w = 1 + F.col("doc_id") % 3
    p = p.groupBy("model", "doc_id", "score").agg(F.sum(F.col("label") * w).alias("pos"), F.sum((1 - F.col("label")) * w).alias("neg"))
    rows = durable(multinomial.with_unit_totals(p, resampling.numbered_units(p, "doc_id", []), [], "doc_id"))
    ranged = multinomial.ranged(rows, ["model"], B, "rank", [])
    held = ranged, multinomial.stretches(ranged, ["model"], B)
    each = multinomial.resampled_auc(rows, ["model"], B, "rank", [], held).join(multinomial.resampled_ap(rows, ["model"], B, "rank", [], held), ["model", "replicate"])
    each = durable(each)
    ends = lambda m: resampling.interval(each, ["model"], m).select("model", r(F.col("ci_low")).alias(f"{m}_low"), r(F.col("ci_high")).alias(f"{m}_high"))
    return ends("auc").join(ends("ap"), "model")


@query(_COMPONENTS.replace(" SELECT s AS set_id, min(t) AS component FROM reach GROUP BY s", f""", comp AS (SELECT s AS doc_id, min(t) AS unit FROM reach GROUP BY s), {PREDICTIONS}, pw AS (SELECT pred.*, unit, 1 AS weight FROM pred JOIN comp USING (doc_id)),
u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS unit_no FROM (SELECT DISTINCT unit FROM pw)), {multinomial.counts_sql("u", [], "component", B)}, {_RANKED},
a AS (SELECT model, replicate, CAST(sum(CAST((score >= 0.5) = (label = 1) AS INTEGER) * w) AS DOUBLE) / sum(w) AS acc FROM pw JOIN u USING (unit) JOIN w USING (unit_no) GROUP BY ALL),
g AS (SELECT count(*) AS components, max(n) AS largest FROM (SELECT unit, count(DISTINCT doc_id) AS n FROM pw GROUP BY unit))
SELECT model, any_value(components) AS components, any_value(largest) AS largest, round(quantile_cont(auc, 0.025), 6) AS auc_low, round(quantile_cont(auc, 0.975), 6) AS auc_high, round(quantile_cont(acc, 0.025), 6) AS acc_low, round(quantile_cont(acc, 0.975), 6) AS acc_high
FROM m JOIN a USING (model, replicate), g GROUP BY model"""))
def boot_component_ci(spark, sf):
    """Intervals of AUC and accuracy with whole components of documents that share contents as the units: dependent examples are drawn together."""
    p = predictions(spark, sf).join(document_components(spark, sf).withColumnRenamed("set_id", "doc_id"), "doc_id")
    ok = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("long")
    one = p.groupBy("model", "component", "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"), F.sum(ok).alias("ok"), F.count("*").alias("n"))
    units = resampling.numbered_units(one, "component", [])
    rows = durable(multinomial.with_unit_totals(one, units, [], "component"))
    acc = multinomial.resampled_sums(rows, ["model"], ["ok", "n"], B, "component", []).select("model", "replicate", (F.col("ok") / F.col("n")).alias("acc"))
    each = durable(multinomial.resampled_auc(rows, ["model"], B, "component", []).join(acc, ["model", "replicate"]))
    size = p.groupBy("component").agg(F.count_distinct("doc_id").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    ends = lambda m: resampling.interval(each, ["model"], m).select("model", r(F.col("ci_low")).alias(f"{m}_low"), r(F.col("ci_high")).alias(f"{m}_high"))
    return ends("auc").join(ends("acc"), "model").crossJoin(F.broadcast(size))  # size is one row


@query(f"""WITH {_FIVE}, f AS (SELECT question_num, unnest([dimension, 'all']) AS facet, CAST(predicted = archive AS INTEGER) AS ok FROM q),
u AS (SELECT facet, ok, row_number() OVER (PARTITION BY facet ORDER BY question_num) - 1 AS unit_no FROM f), nn AS (SELECT facet, count(*) AS cnt FROM u GROUP BY facet),
d AS (SELECT facet, replicate, {draw_sql("facet", "facet", "replicate", "k")} % cnt AS unit_no FROM (SELECT *, unnest(range(cnt)) AS k FROM nn), range({B}) t(replicate)),
m AS (SELECT facet, replicate, avg(ok) AS accuracy FROM d JOIN u USING (facet, unit_no) GROUP BY ALL)
SELECT facet, round(quantile_cont(accuracy, 0.025), 6) AS ci_low, round(quantile_cont(accuracy, 0.975), 6) AS ci_high FROM m GROUP BY facet""")
def boot_question_ci(spark, sf):
    """Intervals of the five-choice accuracy, of all questions and by facet."""
    a = choices.answered(five_questions(spark, sf)).select("question_num", F.explode(F.array("dimension", F.lit("all"))).alias("facet"), F.col("archive_correct").cast("long").alias("ok"))
    each = resampling.resampled_shares(a, "facet", "question_num", "ok", B, "facet").withColumnRenamed("share", "accuracy")
    return resampling.interval(each, ["facet"], "accuracy").select("facet", r(F.col("ci_low")).alias("ci_low"), r(F.col("ci_high")).alias("ci_high"))


@query(f"""WITH {PREDICTIONS}, g AS (SELECT lang, model, round(avg(abs(score - label)), 4) AS loss FROM pred GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY loss) + (count(*) OVER (PARTITION BY lang, loss) - 1) / CAST(2 AS DOUBLE) AS rk FROM g),
j AS (SELECT a.lang AS track_a, b.lang AS track_b, list(a.rk ORDER BY a.model) AS x, list(b.rk ORDER BY a.model) AS y FROM k a JOIN k b ON a.model = b.model AND a.lang < b.lang GROUP BY ALL),
o AS (SELECT [a, b, c, d] AS p FROM range(1, 5) t(a), range(1, 5) u(b), range(1, 5) v(c), range(1, 5) w(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d),
z AS (SELECT j.*, list_transform(p, lambda i: y[i]) AS z, [[1, 2], [1, 3], [1, 4], [2, 3], [2, 4], [3, 4]] AS e FROM j, o),
s AS (SELECT track_a, track_b, list_sum(list_transform(range(1, 5), lambda i: (x[i] - 2.5) * (z[i] - 2.5))) AS dz, list_sum(list_transform(range(1, 5), lambda i: (x[i] - 2.5) * (y[i] - 2.5))) AS dy,
  list_sum(list_transform(range(1, 5), lambda i: (x[i] - 2.5) * (x[i] - 2.5))) AS xx, list_sum(list_transform(range(1, 5), lambda i: (y[i] - 2.5) * (y[i] - 2.5))) AS yy,
  list_sum(list_transform(e, lambda t: sign(x[t[1]] - x[t[2]]) * sign(z[t[1]] - z[t[2]]))) AS cz, list_sum(list_transform(e, lambda t: sign(x[t[1]] - x[t[2]]) * sign(y[t[1]] - y[t[2]]))) AS cy,
  list_sum(list_transform(e, lambda t: abs(sign(x[t[1]] - x[t[2]])))) AS tx, list_sum(list_transform(e, lambda t: abs(sign(y[t[1]] - y[t[2]])))) AS ty FROM z)
SELECT track_a, track_b, CAST(4 AS BIGINT) AS n, round(any_value(dy) / nullif(sqrt(any_value(xx) * any_value(yy)), 0), 6) AS rho, round(CAST(any_value(cy) AS DOUBLE) / nullif(sqrt(CAST(any_value(tx) * any_value(ty) AS DOUBLE)), 0), 6) AS tau,
CASE WHEN any_value(xx * yy) > 0 THEN round(avg(CAST(abs(dz) >= abs(dy) AS INTEGER)), 6) END AS rho_p, CASE WHEN any_value(xx * yy) > 0 THEN round(avg(CAST(abs(cz) >= abs(cy) AS INTEGER)), 6) END AS tau_p FROM s GROUP BY ALL""")
def rank_agreement(spark, sf):
    """Rank correlations of models between every two tracks (here: languages), with exact p-values."""
    g = predictions(spark, sf).groupBy("lang", "model").agg(r(F.avg(F.abs(F.col("score") - F.col("label"))), 4).alias("loss"))
    k = g.withColumn("rk", sets.average_rank("loss", "lang", descending=False))
    side = lambda s, c: k.select("model", F.col("lang").alias(f"track_{s}"), F.col("rk").alias(c))
    keys = ["track_a", "track_b"]
    j = side("a", "x").join(side("b", "y"), "model").where("track_a < track_b").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("model", "x", "y"))).alias("m"))  # a row a model and two tracks
    out = resampling.rank_agreement(j.select(*keys, F.col("m.x").alias("x"), F.col("m.y").alias("y")), keys)
    return out.select(*keys, "n", *[r(F.col(c)).alias(c) for c in ("rho", "tau", "rho_p", "tau_p")])
