"""Readers and writers of the protocol files: set JSON, compatibility text, fill-in-the-blank JSON, manifests.

Paths are opened by Spark alone. Violations (unknown split, bad label, ambiguous or unknown key, not
exactly one right answer) raise when the plan runs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

SPLITS = ("train", "valid", "test")
SET_SCHEMA = "set_id string, user_id string, items array<struct<item_id:string,index:int,semantic_category:string>>"
FITB_SCHEMA = "question array<string>, blank_position int, answers array<string>"
PREDICTION_SCHEMA = "model_key string, example_id string, label int, score double"


def _split(split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return split


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(paths)


def read_sets(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(set_id, user_id, index, item_id, category, key); key is set_id_index."""
    names = [_split(split)] + (["validation"] if split == "valid" else [])
    path = first_existing(spark, *[f"{root}/{n}.json" for n in names])
    line = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line"), F.substring(F.ltrim("value"), 1, 1).alias("head"))
    if not text.where("head <> ''").groupBy("file").agg(F.min_by("head", "line").alias("head")).where("head <> '['").isEmpty():
        raise ValueError(f"{path} is no list of sets")
    s = spark.read.schema(SET_SCHEMA).option("multiLine", True).json(path)
    s = s.select("set_id", "user_id", F.explode("items").alias("i"))
    return s.select("set_id", "user_id", "i.index", "i.item_id", F.coalesce(F.nullif("i.semantic_category", F.lit("")), F.lit("<missing>")).alias("category"), F.concat_ws("_", "set_id", "i.index").alias("key"))


def item_keys(items: DataFrame) -> DataFrame:
    """(key, item_id), one row a key; a key of two items raises."""
    k = items.groupBy("key").agg(F.max("item_id").alias("last"), F.min("item_id").alias("item_id"))
    return k.select("key", F.when(F.col("last") > F.col("item_id"), F.raise_error(F.concat(F.lit("ambiguous key "), "key"))).otherwise(F.col("item_id")).alias("item_id"))


def resolve(examples: DataFrame, id_cols: list[str], keys: str, index: DataFrame) -> DataFrame:
    """id_cols, item_ids in the order of the array column `keys`; an unknown key raises."""
    x = examples.select(*id_cols, F.posexplode(keys).alias("pos", "key")).join(index, "key", "left")
    item = F.when(F.col("item_id").isNull(), F.raise_error(F.concat(F.lit("unknown key "), "key"))).otherwise(F.col("item_id"))
    x = x.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item_id")))).alias("x"))  # one example's items
    return x.select(*id_cols, F.transform("x", lambda s: s["item_id"]).alias("item_ids"))


def read_compatibility(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(line, label, keys) of `label key key ...` lines; blank lines are skipped, other labels raise."""
    path = first_existing(spark, f"{root}/compatibility_{_split(split)}.txt", f"{root}/compatibility_{split}_new.txt")
    t = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), "\\s+").alias("p"))
    label = F.when(F.col("p")[0].isin("0", "1"), F.col("p")[0].cast("int")).otherwise(F.raise_error(F.lit("label must be 0 or 1")).cast("int"))
    return t.select(F.monotonically_increasing_id().alias("line"), label.alias("label"), F.slice("p", F.lit(2), F.size("p") - 1).alias("keys"))


def read_fitb(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(line, question, answers, correct_index): the one answer whose key starts with the question's set_id."""
    path = first_existing(spark, f"{root}/fill_in_blank_{_split(split)}.json", f"{root}/fill_in_the_blank_{split}.json")
    q = spark.read.schema(FITB_SCHEMA).option("multiLine", True).json(path).withColumn("set_id", F.split_part(F.col("question")[0], F.lit("_"), F.lit(1)))
    hits = F.transform("answers", lambda a: F.split_part(a, F.lit("_"), F.lit(1)) == F.col("set_id"))
    n = F.size(F.filter(hits, lambda h: h))
    at = F.when(n == 1, (F.array_position(hits, True) - 1).cast("int")).otherwise(F.raise_error(F.lit("not exactly one right answer")).cast("int"))
    return q.select(F.monotonically_increasing_id().alias("line"), "question", "answers", at.alias("correct_index"))


def write_compatibility(examples: DataFrame, path: str) -> None:
    """Lines `label key ...` from (label, keys); refuses to overwrite."""
    examples.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join("keys", " ")).alias("value")).write.mode("errorifexists").text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, CSV with header, or JSON; refuses to overwrite."""
    w = df.write.mode("errorifexists").option("header", True)
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def markdown(df: DataFrame, places: int = 4, most: int = 1000) -> str:
    """A small result as a Markdown table: numbers to the right, fractions to `places`, nulls empty; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")

    def told(v) -> str:
        text = "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
        return text.replace("|", "\\|").replace("\n", " ")

    right = [not isinstance(f.dataType, (StringType, BooleanType)) for f in df.schema]
    head = [df.columns, ["---:" if x else ":---" for x in right]]
    return "".join(f"| {' | '.join(cells)} |\n" for cells in [*head, *[[told(v) for v in row] for row in rows]])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, crc32, sha256) of every file below path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.crc32("content").alias("crc32"), F.sha2("content", 256).alias("sha256"))


def manifest_matches(spark: SparkSession, path: str, held: DataFrame) -> bool:
    """Whether the files below path are those of a held manifest, byte for byte: only then may a run be skipped."""
    now = manifest(spark, path).select("path", "sha256")
    held = held.select("path", "sha256")
    return now.exceptAll(held).isEmpty() and held.exceptAll(now).isEmpty()


def once(spark: SparkSession, path: str, work) -> bool:
    """Runs work(), which writes path, unless a completion marker beside it holds the digests of all its files; whether it ran.

    Files that are not those of the marker are an error: neither kept nor overwritten.
    """
    marker = f"{path}.done"
    at = spark._jvm.org.apache.hadoop.fs.Path(marker)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        if not manifest_matches(spark, path, spark.read.parquet(marker)):
            raise ValueError(f"files at {path} have changed since they were completed")
        return False
    work()
    manifest(spark, path).write.parquet(marker)
    return True
