"""Bootstrap counts by recursive splitting: their distribution, their SQL, and metrics under them against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.operators import multinomial as M
from setweave.operators import resampling

B = 200


def test_counts_are_multinomial():
    n, b = 37, 8000
    w = M.unit_weights(np.arange(n), n, b, "t")
    assert (w.sum(0) == n).all()
    assert abs(w.mean(1) - 1).max() < 0.06 and abs(w.var(1) - (1 - 1 / n)).max() < 0.12
    far = np.corrcoef(w)[~np.eye(n, dtype=bool)]
    assert abs(far.mean() + 1 / (n - 1)) < 0.002 and abs(far).max() < 0.09
    share = np.bincount(w.ravel(), minlength=6)[:6] / w.size
    want = [np.exp(sum(np.log(n - i) - np.log(i + 1) for i in range(k)) + k * np.log(1 / n) + (n - k) * np.log(1 - 1 / n)) for k in range(6)]
    assert share == pytest.approx(want, abs=0.004)


def test_counts_of_some_units_are_those_of_all():
    every = M.unit_weights(np.arange(1000), 1000, 50, "t")
    some = np.array([0, 1, 499, 500, 777, 999])
    assert (M.unit_weights(some, 1000, 50, "t") == every[some]).all()
    assert (M.unit_weights(np.array([0]), 1, 50, "t") == 1).all()
    big = M.unit_weights(np.arange(5_000_000, 5_000_200), 10_000_000, 50, "t")
    assert abs(big.mean() - 1) < 0.05 and abs(big.var() - 1) < 0.1


def test_splits_follow_the_binomial():
    for c, half, size in ((5, 1, 3), (40, 7, 15), (5000, 1, 2), (100_000, 333, 1000)):
        u = (np.arange(20_000) + 0.5) / 20_000
        k = M.lower_half(np.full(20_000, c), half, size, u)
        p = half / size
        assert k.mean() == pytest.approx(c * p, rel=1e-3) and k.var() == pytest.approx(c * p * (1 - p), rel=5e-3)


def test_counts_equal_their_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE u AS SELECT g, unit_no FROM (VALUES ('a', 61), ('b', 1), ('c', 130)) t(g, n), range(n) r(unit_no)")
    got = {(g, r, i): w for g, r, i, w in con.execute(f"WITH {M.counts_sql('u', ['g'], 's', 9)} SELECT g, replicate, unit_no, w FROM w").fetchall()}
    want = {(g, r, i): int(w[i, r]) for g, n in (("a", 61), ("b", 1), ("c", 130)) for w in [M.unit_weights(np.arange(n), n, 9, f"s:{g}")] for i in range(n) for r in range(9) if w[i, r]}
    assert got == want


@pytest.fixture(scope="module")
def scores(spark):
    """Two models' scores, with heavy ties and a group of one class, of units in two strata."""
    rng = np.random.default_rng(6)
    rows = [(m, int(i % 90), "s%d" % (i % 90 % 2), float(rng.choice([0.5, np.round(rng.random(), 2), rng.random()])), int(rng.random() < 0.4)) for m in "ab" for i in range(700)]
    rows += [("c", i, "s%d" % (i % 2), 0.5, 1) for i in range(20)]
    return rows, spark.createDataFrame(rows, "model string, unit long, stratum string, score double, label long")


def test_metrics_equal_brute_force(scores, spark):
    rows, df = scores
    strata = ["stratum"]
    units = resampling.numbered_units(df, "unit", strata)
    number = {(r["stratum"], r["unit"]): r["unit_no"] for r in units.collect()}
    w = {s: M.unit_weights(np.arange(n), n, B, f"x:{s}") for s in ("s0", "s1") for n in [sum(k[0] == s for k in number)]}
    base = df.groupBy("model", "unit", "stratum", "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"), F.count("*").alias("n"))
    base = M.with_unit_totals(base, units, strata, "unit")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # ties straddle ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        auc = {(r["model"], r["replicate"]): r["auc"] for r in M.resampled_auc(base, ["model"], B, "x", strata).collect()}
        ap = {(r["model"], r["replicate"]): r["ap"] for r in M.resampled_ap(base, ["model"], B, "x", strata).collect()}
        sums = {(r["model"], r["replicate"]): (r["pos"], r["n"]) for r in M.resampled_sums(base, ["model"], ["pos", "n"], B, "x", strata).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not any(m == "c" for m, _ in auc) and len(auc) == 2 * B
    for m in "ab":
        own = [r for r in rows if r[0] == m]
        score, label = np.array([r[3] for r in own]), np.array([r[4] for r in own])
        each = np.stack([w[r[2]][number[r[2], r[1]]] for r in own])
        for b in range(0, B, 17):
            c = each[:, b]
            more = (score[:, None] > score[None]) + 0.5 * (score[:, None] == score[None])
            p, n = c * label, c * (1 - label)
            assert auc[m, b] == pytest.approx((p[:, None] * n[None] * more).sum() / p.sum() / n.sum())
            cuts = np.unique(score[p > 0])
            got = sum((p[score == t].sum()) * p[score >= t].sum() / c[score >= t].sum() for t in cuts) / p.sum()
            assert ap[m, b] == pytest.approx(got)
            assert sums[m, b] == (p.sum(), c.sum())


def test_plan_moves_no_row_a_unit_and_replicate(scores, spark):
    """The rows that reach an exchange are those given and a few a task and replicate."""
    rows, df = scores
    base = df.groupBy("model", "unit").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    out = M.resampled_sums(M.with_unit_totals(base, resampling.numbered_units(base, "unit", []), [], "unit"), ["model"], ["pos", "n"], B, "x", [])
    plan = out._jdf.queryExecution().toString()
    assert "Generate" not in plan and out.count() == 3 * B
