"""What is moved and left on disk: questions a slice at a time, scratch files, vectors looked up by code."""

import os

import numpy as np
from pyspark.sql import functions as F

from setweave.operators import blocks, completion
from setweave.operators.learners import Logistic
from setweave.plans import questions
from setweave.queries import QUERIES
from setweave.storage import scratch, shared_dir

SF = "/root/testdata/sf0.001"


def _files(spark) -> set:
    root = shared_dir(spark).removeprefix("file:")
    return {d for d in os.listdir(root)}


def test_scratch_files_and_their_shuffles_go(spark):
    before = _files(spark)
    with scratch(spark) as keep:
        held = keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
        assert held.agg(F.sum("n")).first()[0] == 1000 and len(_files(spark) - before) == 1
    assert _files(spark) == before


def test_negatives_and_questions_leave_only_their_result(spark):
    for make in (questions.cp_negatives, lambda s, sf: questions.fitb_questions(s, sf, 1, 2), questions.class_questions):
        before = _files(spark)
        make(spark, SF).count()
        assert not any(d.startswith("scratch-") for d in _files(spark) - before)


def test_slices_make_the_same_sets_and_questions(spark, monkeypatch):
    made = lambda: [sorted(f(spark, SF).collect()) for f in (questions.cp_negatives, questions.fitb_questions, questions.class_questions)]
    whole = made()
    monkeypatch.setattr(questions, "AT_A_TIME", 5000)
    assert made() == whole and all(whole)


def test_questions_of_a_seed_go_before_those_of_the_next(spark):
    seen = []

    def told(q):
        assert not any(os.path.exists(f.removeprefix("file://")) for f in seen)
        seen.extend(q.inputFiles())
        return q.groupBy("seed").agg(F.count("*").alias("n"))

    n = questions.fitb_each(spark, SF, (1, 2), told)
    assert seen and {r["seed"]: r["n"] for r in n.collect()} == {r["seed"]: r["count"] for r in questions.fitb_questions(spark, SF, 1, 2).groupBy("seed").count().collect()}


def test_audits_by_parts_are_those_of_the_whole_and_leave_little(spark, monkeypatch):
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files)
    for name in ("contains_category_auc",):
        monkeypatch.setattr(questions, "AT_A_TIME", 20_000_000)
        whole = sorted(QUERIES[name](spark, SF).collect())
        monkeypatch.setattr(questions, "AT_A_TIME", 9000)
        before = size()
        assert sorted(QUERIES[name](spark, SF).collect()) == whole and whole
        assert size() - before < 400_000


def test_scores_by_code_equal_those_of_joined_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, i % 5, rng.random(4).tolist()) for i in range(5)], "item_id long, code long, v array<float>")
    vectors = vectors.unionByName(vectors.withColumn("item_id", F.col("item_id") + 5))
    q = spark.createDataFrame([(k, ",".join(map(str, rng.permutation(10)[:3])), ",".join(map(str, rng.permutation(10)[:4])), int(k % 4)) for k in range(20)], "key long, question string, candidates string, correct_index int")
    model = Logistic(np.ones(1), rng.random((1, 8)), np.zeros(1))
    told = lambda: {(r["key"], r["candidate_index"]): round(r["score"], 12) for r in completion.scores_by_code(q, vectors, model).collect()}
    assert "FloatType" not in str(completion.posed(q, vectors, by_code=True).schema)
    looked_up = told()
    monkeypatch.setattr(blocks, "TABLE_BYTES", 0)
    assert told() == looked_up and len(looked_up) == 80
