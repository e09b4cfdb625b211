"""Five-choice tasks as they come in an archive: a list of questions per task, and the pictures that they name."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.choices import first_max
from .archives import contents, members

# The facets of the questions of task AAT, by number, ends included.
FACETS = (("Color", 1, 20), ("Style", 21, 52), ("Occasion", 53, 67), ("Season", 68, 79), ("Material", 80, 91), ("Balance", 92, 100))
#: As the files spell it.
LABELS = "array<struct<quesion_num:string,question:array<string>,answers:array<string>,gt:string,gt_distribution:array<string>>>"


def named(references, task: str):
    """(item_id, picture) of an array of references: LAT's are told apart behind the first underscore, AAT's behind the last."""

    def one(x):
        if task != "LAT":
            tail = F.substring_index(x, "_", -1)
            return F.struct(F.concat(F.lit("AAT_"), tail).alias("item_id"), F.concat(tail, F.lit(".jpg")).alias("picture"))
        behind = lambda t: F.regexp_replace(t, "^[^_]*_", "")
        return F.struct(F.concat(F.lit("LAT_"), behind(F.substring_index(x, "/", -1))).alias("item_id"), F.concat(behind(x), F.lit(".jpg")).alias("picture"))

    return F.transform(references, one)


def read_task(spark: SparkSession, path: str, task: str, options: int = 5) -> DataFrame:
    """task, question_num, question and answers (item ids), archive_gt_index, gt_distribution and majority_gt_index (LAT), dimension (AAT).

    No list or more than one, a list that is no JSON of the form, a picture that the archive lacks, and a distribution that
    is not of `options` shares that sum to 1 are errors.
    """
    if task not in ("LAT", "AAT"):
        raise ValueError("task must be LAT or AAT")
    found = contents(spark, path, f"/{task}/label/{task}.json".lower()).where(F.col("entry").endswith(f"/{task}/label/{task}.json"))
    n = found.count()  # a list a task
    if n != 1:
        raise ValueError(f"{n} lists of {task}")
    rows = F.from_json(F.decode("content", "UTF-8"), LABELS)
    rows = found.select(F.explode(F.when(rows.isNull(), F.raise_error(F.lit(f"no list of {task}")).cast(LABELS)).otherwise(rows)).alias("r")).select("r.*")
    q = rows.select(F.col("quesion_num").cast("int").alias("question_num"), named(F.col("question"), task).alias("q"), named(F.col("answers"), task).alias("a"), (F.col("gt").cast("int") - 1).alias("archive_gt_index"), F.col("gt_distribution").cast("array<double>").alias("gt_distribution"))
    held = members(spark, path).where(F.col("entry").contains(f"/{task}/image/") & F.lower("entry").endswith(".jpg")).select(F.col("basename").alias("picture")).distinct().withColumn("there", F.lit(True))
    asked = q.select("question_num", F.explode(F.concat("q", "a")).alias("x")).select("question_num", "x.picture").join(held, "picture", "left")
    lacks = asked.where("there is null").groupBy("question_num").agg(F.min("picture").alias("lacks"))  # a question's pictures
    q = q.join(lacks, "question_num", "left")
    shares = F.aggregate("gt_distribution", F.lit(0.0), lambda s, x: s + x)
    bad = F.when(F.col("lacks").isNotNull(), F.concat(F.lit("the archive lacks "), "lacks"))
    if task == "LAT":
        fine = F.coalesce((F.size("gt_distribution") == options) & (F.abs(shares - 1) <= 1e-6), F.lit(False))
        bad = bad.when(~fine, F.concat(F.lit("no distribution of question "), F.col("question_num").cast("string")))
    index = F.when(bad.isNotNull(), F.raise_error(bad).cast("int")).otherwise(F.col("archive_gt_index"))
    facet = F.lit(None).cast("string")
    for name, lo, hi in FACETS:
        facet = F.when(F.col("question_num").between(lo, hi), name).otherwise(facet)
    mine = F.lit(task == "LAT")
    return q.select(F.lit(task).alias("task"), "question_num", F.col("q.item_id").alias("question"), F.col("a.item_id").alias("answers"), index.alias("archive_gt_index"),
                    F.when(mine, F.col("gt_distribution")).alias("gt_distribution"), F.when(mine, first_max(F.col("gt_distribution"))).alias("majority_gt_index"), F.when(~mine, facet).alias("dimension"))
