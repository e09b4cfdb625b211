"""Input tables, and the views of them that stand for sets, items, vectors and predictions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import uniform, uniform_sql

MODELS = (0, 1, 2, 3)
SPLITS = ("test", "train", "valid")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred without a schema."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def append_runs(rows: DataFrame, path: str, settings: list[str], key: str) -> None:
    """Appends rows to the CSV table at path; other settings than those held, and a key that is held, are errors."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        held = read_csv(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes))
        if not rows.select(settings).distinct().join(held.select(settings).distinct(), settings, "left_anti").isEmpty():
            raise ValueError(f"settings {settings} differ from those at {path}")
        if not rows.join(held, key, "left_semi").isEmpty():
            raise ValueError(f"a {key} is at {path} already")
    rows.write.mode("append").option("header", True).csv(path)


def set_items(spark: SparkSession, sf: str) -> DataFrame:
    """(set_id, item_id): the distinct parts of each order."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("item_id")).distinct()


SET_ITEMS = "si AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS item_id FROM lineitem)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, v, code): each part's vector, that of p_partkey modulo the number of vectors, and that number, which tells equal vectors."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    parts = table(spark, sf, "part").select("p_partkey").crossJoin(F.broadcast(n))  # n is one row
    return parts.join(e, parts["p_partkey"] % F.col("n") == e["vec_id"]).select(F.col("p_partkey").alias("item_id"), F.col("embedding").alias("v"), F.col("vec_id").alias("code"))


VECTORS = "vec AS (SELECT p_partkey AS item_id, embedding AS v FROM part JOIN embeddings ON p_partkey % (SELECT count(*) FROM embeddings) = vec_id)"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(model, doc_id, label, score, lang, source): four models' scores of the labelled documents, with ties."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    m = d.withColumn("model", F.explode(F.array(*[F.lit(i) for i in MODELS])))
    score = F.round(0.1 * F.col("model") * F.col("quality") + (1 - 0.1 * F.col("model")) * uniform("score", F.col("model"), F.col("doc_id")), 2)
    return m.select("model", "doc_id", F.col("quality").alias("label"), score.alias("score"), "lang", "source")


PREDICTIONS = f"""pred AS (SELECT model, doc_id, quality AS label, lang, source,
  round(CAST(0.1 AS DOUBLE) * model * quality + (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE) * model) * {uniform_sql("score", "model", "doc_id")}, 2) AS score
  FROM labels JOIN documents USING (doc_id), (SELECT unnest([0, 1, 2, 3]) AS model))"""


def split_of(key):
    u = uniform("split", key)
    return F.when(u < 0.7, "train").when(u < 0.8, "valid").otherwise("test")


def split_sql(key: str) -> str:
    u = uniform_sql("split", key)
    return f"(CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.8 THEN 'valid' ELSE 'test' END)"
