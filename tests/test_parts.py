"""Distractors by stretches of a category, and questions scored in parts, against the ways that look up places and candidates one by one."""

import os

import pytest
from pyspark.sql import functions as F

from setweave.operators import completion
from setweave.operators.learners import Logistic
from setweave.plans import questions
from setweave.queries import QUERIES
from setweave.storage import scratch, shared_dir

SF = "/root/testdata/sf0.001"


def _size(spark) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files)


@pytest.mark.parametrize("window", [1, 4, 64])
def test_stretches_go_round_their_category(spark, window):
    sizes = {"a": 1, "b": 3, "c": 16, "d": 17, "e": 70}
    pool = spark.createDataFrame([("", c, p, 100 * p + n, p % 3, n) for c, n in sizes.items() for p in range(n)], "seed string, cat string, place long, candidate long, cls long, size long")
    got = {(x["cat"], x["stretch"]): [p["candidate"] for p in x["places"]] for x in questions._stretches(pool, window).collect()}
    assert sorted(got) == [(c, k) for c, n in sizes.items() for k in range(-(-n // questions.STRETCH))]
    for (c, k), places in got.items():
        n = sizes[c]
        assert places == [100 * ((k * questions.STRETCH + o) % n) + n for o in range(questions.STRETCH + window - 1)]


def test_questions_by_stretches_are_those_by_places(spark, monkeypatch):
    made = lambda: [sorted(map(tuple, f(spark, SF).collect())) for f in (questions.fitb_questions, questions.class_questions)]
    near = made()
    monkeypatch.setattr(questions, "NEAR", 0)
    assert made() == near and all(near)


def test_small_categories_and_completed_sets(spark, monkeypatch):
    """Categories of one to nine items of which a few complete positive sets: further windows are needed, and some questions have no answer."""
    rows = [("", s, i, f"c{i % 3}", i // 2) for s in range(60) for i in {s % 27, (s * 7) % 27, (s * s) % 12}]
    rows += [("", 100 + i, j, f"c{j % 3}", j // 2) for i in range(8) for j in (0, i + 1)]
    x = spark.createDataFrame(rows, "seed string, set_id long, item_id long, cat string, cls long")
    items = [("", f"c{i % 3}", i, i // 2) for i in range(27)]
    pool = questions.pool_of(spark.createDataFrame(items, "seed string, cat string, candidate long, cls long"))
    made = lambda: sorted(map(tuple, questions.questions_of(x, pool).collect()))
    near = made()
    monkeypatch.setattr(questions, "NEAR", 0)
    assert made() == near and near


def test_questions_scored_in_parts(spark, monkeypatch):
    whole = sorted(map(tuple, QUERIES["fitb_given_weights"](spark, SF).collect()))
    monkeypatch.setattr(questions, "AT_A_TIME", 4000)
    before, seen = _size(spark), []
    posed = completion.posed
    monkeypatch.setattr(completion, "posed", lambda *a, **k: seen.append(1) or posed(*a, **k))
    assert sorted(map(tuple, QUERIES["fitb_given_weights"](spark, SF).collect())) == whole and len(whole) == 4
    assert len(seen) > 1 and _size(spark) - before < 200_000  # questions do not stay


def test_question_scores_are_those_of_candidates(spark):
    vectors = spark.createDataFrame([(i, i % 5, [float(i % 5), 1.0 / (1 + i % 5)]) for i in range(12)], "item_id long, code long, v array<double>")
    q = spark.createDataFrame([(k, ",".join(map(str, range(k % 3 + 1))), f"{k % 12},{(k + 3) % 12},7", k % 3) for k in range(30)], "key long, question string, candidates string, correct_index int")
    model = Logistic([1.0], [[0.3, -0.2, 0.7, 0.1]], [0.1])
    want = {(x["key"], x["candidate_index"]): x["score"] for x in completion.scores_by_code(q, vectors, model).collect()}
    with scratch(spark) as keep:
        got = [x for part in completion.scored_parts(keep(q), vectors, model, keep) for x in part.select("key", F.posexplode("scores").alias("i", "s")).collect()]
    assert len(want) == 90 and {(x["key"], x["i"]): x["s"] for x in got} == pytest.approx(want)


def test_audit_by_class_counts_broken_questions_as_the_sql_does(spark, monkeypatch):
    import duckdb

    from setweave import more_queries
    from setweave.queries import SQL

    q = questions.class_questions(spark, SF).orderBy("set_id").limit(300).toPandas()
    for i, x in q.iterrows():
        c, at = x["candidates"].split(","), (x["correct_index"] + 1) % 4
        # an own item, one told twice, one that completes a positive set, one of another category
        c[at] = [x["question"].split(",")[0], c[(at + 1) % 4], str(x["blank"]), str(int(c[at]) % 150 + 1), c[at]][i % 5]
        q.at[i, "candidates"] = ",".join(c)
    given = spark.createDataFrame(q)
    monkeypatch.setattr(more_queries, "class_questions", lambda spark, sf, store: store(given))
    monkeypatch.setattr(questions, "AT_A_TIME", 200)  # in parts
    with duckdb.connect() as con:
        for name in ("lineitem", "part", "embeddings"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        con.register("bad", q)
        sql = SQL["class_safeguards"].replace(questions.CLASS_SQL, "SELECT * FROM bad")
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
    got = QUERIES["class_safeguards"](spark, SF)
    assert got.columns == names and [tuple(x) for x in got.collect()] == want and min(want[0]) > 0


def test_sums_over_rows_are_those_over_blocks(spark):
    import numpy as np

    from setweave.operators.blocks import blocks, tree_sum

    x = np.random.default_rng(4).normal(0, 1, (9000, 3))
    rows = spark.createDataFrame([(v.tolist(), float(i % 2)) for i, v in enumerate(x)], "x array<double>, y double").repartition(3)
    direct = blocks(rows, "x", "y", keep=False)
    assert direct.columns == ["x", "y"]  # a pass takes rows as they are: no blocks are made for it
    tell = lambda x, y: (len(x), x.T @ x, x.T @ y)
    a, b = tree_sum(direct, tell), tree_sum(blocks(rows, "x", "y"), tell)
    assert a[0] == b[0] == 9000 and all(np.allclose(p, q) for p, q in zip(a, b)) and np.allclose(a[1], x.T @ x)
    assert tree_sum(direct.limit(0), tell) is None
