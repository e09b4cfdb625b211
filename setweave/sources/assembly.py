"""Protocols assembled from sets that are dealt to splits: set files, negatives, questions, a log of duplicates and a manifest.

All files are written aside, part by part, each with the digests of its files; a run that failed goes on with
the parts that are missing or not as told. Once the manifest agrees with what is read back, the folder is renamed,
once, so a protocol at its path is whole. Negatives and questions take items of their own split only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.questions import negatives_of, pool_of, questions_of
from ..storage import scratch
from .protocol import SPLITS, manifest

#: Most rows of a file, by estimate: a list is read by one task, whole, and digested so.
FILE_ROWS = 50_000


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def in_files(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows in this order over as many ranges as files of FILE_ROWS rows need."""
    return rows.repartitionByRange(max(1, -(-rows.count() // FILE_ROWS)), *order).sortWithinPartitions(*order)


def write_lists(rows: DataFrame, value: Column, order: list[Column], path: str) -> None:
    """Files that are a JSON list each, of `value` of the rows, in this order over the files; refuses to overwrite."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = "["
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [(head if i == 0 else ",") + t for i, t in enumerate(b["value"])]})
                head = ","
        if head == ",":
            yield pd.DataFrame({"value": ["]"]})

    in_files(rows, order).select(F.to_json(value).alias("value")).mapInPandas(run, "value string").write.mode("errorifexists").text(path)


def files_of(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every data file below path, by its place relative to it (some files a part)."""
    root = _fs(spark, path)[1].toUri().getPath().rstrip("/") + "/"
    rows = manifest(spark, path).select(F.substring_index("path", root, -1).alias("file"), "sha256").collect()
    return {r["file"]: r["sha256"] for r in rows if not r["file"].rpartition("/")[2].startswith(("_", "."))}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all."""
    fs, at = _fs(spark, path)
    aside = _fs(spark, path + ".part")[1]
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def step(spark: SparkSession, root: str, part: str, work: Callable[[str], None]) -> bool:
    """work(path) for a part below root, unless its files are there as its marker tells; whether it ran. Leavings of a failed run go."""
    path, marker = f"{root}/{part}", f"{root}/done/{part}.json"
    if exists(spark, marker) and exists(spark, path) and json.loads(read_text(spark, marker)) == files_of(spark, path):
        return False
    remove(spark, path)
    work(path)
    write_text(spark, marker, json.dumps(files_of(spark, path), sort_keys=True))
    return True


def parts_of(sets: DataFrame, seed: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, Callable[[str], None]], DataFrame]:
    """The writers of a protocol's parts, and (split, sets, items, negatives, questions, most_used, slot_0..3).

    What several parts are made of is made once, when the first of them is written, and held by `keep` (of a scratch()). sets: (split, set_id, index, item_id, category), and cls (items of one class stand for the same thing), all but index strings.
    """
    comma = F.col("item_id").contains(",") | F.col("set_id").contains("/")
    sets = sets.withColumn("item_id", F.when(comma, F.raise_error(F.lit("a comma in an item, or a slash in a set id"))).otherwise(F.col("item_id")))
    sets = keep(sets if "cls" in sets.columns else sets.withColumn("cls", F.col("item_id")))
    key = F.concat_ws("_", "set_id", F.col("index").cast("string"))
    place = F.concat(F.lit(f"{seed}:"), F.col("split"))
    x = sets.select(place.alias("seed"), "set_id", "item_id", F.col("category").alias("cat"), "cls")
    keys = keep(sets.groupBy("split", "item_id").agg(F.min_by(key, F.struct("set_id", "index")).alias("key")))  # the first set's
    pool = keep(pool_of(x.select("seed", "cat", F.col("item_id").alias("candidate"), "cls").distinct()))
    q = keep(questions_of(x, pool, store=keep).withColumn("split", F.split_part("seed", F.lit(":"), F.lit(2))).drop("seed"))
    both = lambda c: F.concat_ws("/", F.split_part("seed", F.lit(":"), F.lit(2)), c)
    n = negatives_of(x.select(both("set_id").alias("set_id"), "item_id", both("cat").alias("cat")), keep(pool.select(both("cat").alias("cat"), "place", "candidate", "size")), f"n{seed}", keep)
    n = keep(n.where("complete").select(F.split_part("set_id", F.lit("/"), F.lit(1)).alias("split"), F.split_part("set_id", F.lit("/"), F.lit(2)).alias("set_id"), F.split("negative", ",").alias("items")))
    own = F.struct("index", "item_id", "category", key.alias("key"))

    def named(rows: DataFrame, column: str) -> DataFrame:
        """rows (split, set_id, an array `column` of structs with pos and item_id) with (pos, key) in its place, in order."""
        r = rows.select("split", "set_id", F.explode(column).alias("i")).select("split", "set_id", "i.pos", "i.item_id").join(keys, ["split", "item_id"])
        return r.groupBy("split", "set_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias(column))

    placed = lambda c: F.transform(c, lambda i, k: F.struct(k.alias("pos"), i.alias("item_id")))
    key_in = lambda c: F.transform(c, lambda i: i["key"])

    @cache
    def whole() -> DataFrame:
        return keep(sets.groupBy("split", "set_id").agg(F.array_sort(F.collect_list(own)).alias("items")))  # sets are of bounded size

    @cache
    def lines() -> DataFrame:
        out = whole().select("split", F.lit(1).alias("label"), "set_id", key_in("items").alias("keys"))
        return keep(out.unionByName(named(n.withColumn("items", placed("items")), "items").select("split", F.lit(0).alias("label"), "set_id", key_in("items").alias("keys"))))

    @cache
    def asked() -> DataFrame:
        """A set's own items have its own keys, distractors, which are never its own, those of their first sets."""
        ids = q.select("split", "set_id", F.split("question", ",").alias("question"), F.split("candidates", ",").alias("answers"), "blank", "correct_index")
        others = named(ids.select("split", "set_id", F.filter(placed("answers"), lambda i: i["pos"] != F.col("correct_index")).alias("others")), "others")
        r = ids.join(others, ["split", "set_id"]).join(whole(), ["split", "set_id"])
        of = lambda item: F.filter("items", lambda i: i["item_id"] == item)  # noqa: E731  (more than one where a set repeats an item)
        right = F.transform(of(F.col("blank")), lambda i: F.struct(F.col("correct_index").alias("pos"), i["key"].alias("key")))
        question = F.flatten(F.transform("question", lambda item: F.array_sort(key_in(of(item)))))
        first = F.array_min(F.transform(of(F.col("blank")), lambda i: i["index"])).alias("blank_position")
        return keep(r.select("split", "set_id", question.alias("question"), first, key_in(F.array_sort(F.concat("others", right))).alias("answers")))

    out: dict[str, Callable[[str], None]] = {}
    for s in SPLITS:
        here = F.col("split") == s
        told = F.struct("set_id", F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), i["index"].alias("index"), i["category"].alias("semantic_category"))).alias("items"))
        out[f"{s}.json"] = lambda path, here=here, told=told: write_lists(whole().where(here), told, [F.col("set_id")], path)
        text = F.concat_ws(" ", F.col("label").cast("string"), F.array_join("keys", " ")).alias("value")
        order = [F.col("label").desc(), F.col("set_id")]
        out[f"compatibility_{s}.txt"] = lambda path, here=here, text=text, order=order: in_files(lines().where(here), order).select(text).write.mode("errorifexists").text(path)
        out[f"fill_in_blank_{s}.json"] = lambda path, here=here: write_lists(asked().where(here), F.struct("question", "blank_position", "answers"), [F.col("set_id")], path)
    used = q.select("split", "correct_index", F.posexplode(F.split("candidates", ",")).alias("i", "item_id")).where("i <> correct_index").groupBy("split", "item_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.max("n").alias("most_used"))
    report = sets.groupBy("split").agg(F.count_distinct("set_id").alias("sets"), F.count_distinct("item_id").alias("items"))
    report = report.join(n.groupBy("split").agg(F.count("*").alias("negatives")), "split", "left")
    report = report.join(q.groupBy("split").agg(F.count("*").alias("questions"), *[F.count_if(F.col("correct_index") == k).alias(f"slot_{k}") for k in range(4)]), "split", "left").join(used, "split", "left")
    return out, report


def duplicate_log(sets: DataFrame, order: Column) -> DataFrame:
    """kept_set_id, removed_set_id, split of sets with the items of one that comes first (by order, then set_id): what a deduplication removes."""
    c = sets.groupBy("split", "set_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.min(order).alias("at"))
    first = c.groupBy("items").agg(F.min_by("set_id", F.struct("at", "set_id")).alias("kept_set_id"), F.min(F.struct("at", "set_id")).alias("least"), F.count("*").alias("n")).where("n > 1")
    return c.join(first, "items").where(F.struct("at", "set_id") > F.col("least")).select("kept_set_id", F.col("set_id").alias("removed_set_id"), "split")


def assemble(sets: DataFrame, path: str, seed: int, name: str = "protocol", removed: DataFrame | None = None) -> dict:
    """Writes the protocol of sets (as in parts_of()) to path and returns its manifest; refuses to overwrite.

    The files are those that protocol.py reads, and manifest.json. `removed` is kept as duplicates_removed.json. A staged
    run under other settings is an error.
    """
    spark = sets.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path}.staged"
    with scratch(spark) as keep:
        sets = keep(sets)
        if not sets.where(~F.col("split").isin(*SPLITS) | F.col("split").isNull()).isEmpty():
            raise ValueError(f"splits are {SPLITS}")
        digest = sets.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sets.columns).cast("decimal(38,0)")).cast("string").alias("x")).first()
        settings = json.dumps({"protocol": name, "seed": seed, "rows": digest["n"], "digest": digest["x"]}, sort_keys=True)
        if exists(spark, f"{staged}/settings.json"):
            if read_text(spark, f"{staged}/settings.json") != settings:
                raise ValueError(f"{staged} holds a run under other settings")
        else:
            write_text(spark, f"{staged}/settings.json", settings)
        parts, report = parts_of(sets, seed, keep)
        if removed is not None:
            parts["duplicates_removed.json"] = lambda p: write_lists(removed, F.struct(*removed.columns), [F.col("kept_set_id"), F.col("removed_set_id")], p)
        for part, work in parts.items():
            step(spark, staged, part, work)
        files = {f"{part}/{f}": h for part in parts for f, h in json.loads(read_text(spark, f"{staged}/done/{part}.json")).items()}
        splits = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in report.orderBy("split").collect()}  # three rows
        held = {"protocol": name, "seed": seed, "splits": splits, "sha256": dict(sorted(files.items()))}
    write_text(spark, f"{staged}/manifest.json", json.dumps(held, sort_keys=True, indent=1))
    if not verified(spark, staged):
        raise ValueError(f"files at {staged} are not those of the manifest")
    fs, at = _fs(spark, staged)
    fs.delete(_fs(spark, f"{staged}/done")[1], True)
    fs.delete(_fs(spark, f"{staged}/settings.json")[1], False)
    if not fs.rename(at, _fs(spark, path)[1]):
        raise OSError(f"cannot rename {staged}")
    return held


def verified(spark: SparkSession, path: str) -> bool:
    """Whether the files below path are those of its manifest, byte for byte, no more and no fewer."""
    held = json.loads(read_text(spark, f"{path}/manifest.json"))["sha256"]
    now = {f: h for f, h in files_of(spark, path).items() if f not in ("manifest.json", "settings.json") and not f.startswith("done/")}
    return now == held
