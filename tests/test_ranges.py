"""Aggregates over ranges, ranks, flags, quantiles and Kendall's tau against brute force, with ties, nulls and groups in many ranges."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.operators import agreement, sets
from setweave.operators.quantiles import quantiles
from setweave.storage import before, ranges


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_aggregates_before(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, rng.randrange(100)])) for i, g in enumerate(["a"] * 200 + ["b"] * 3 + [None] * 50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v long")
    told = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "n": ("sum", F.lit(1))}
    got = before(ranges(df, ["g"], F.col("i")), ["g"], [F.col("i")], told)
    assert got.select("_part").distinct().count() > 3
    for r in got.collect():
        vs = [v for g, i, v in rows if g == r["g"] and i < r["i"]]
        known = [v for v in vs if v is not None]
        assert (r["s"], r["hi"], r["lo"], r["n"]) == (sum(known), max(known, default=None), min(known, default=None), len(vs))
    assert before(ranges(df.limit(0), ["g"], F.col("i")), ["g"], [F.col("i")], told).count() == 0


@pytest.mark.parametrize("descending", [True, False])
def test_ranks(spark, descending):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random()]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = {r["i"]: r for r in sets.ranks(df, ["g"], "v", descending).collect()}
    key = lambda v: (v is None, (-v if descending else v) if v is not None else 0)
    assert len(got) == 300
    for g, v, i in rows:
        mine = [key(w) for h, w, _ in rows if h == g]
        less, same = sum(k < key(v) for k in mine), sum(k == key(v) for k in mine)
        assert got[i]["rank_min"] == less + 1 and got[i]["rank_avg"] == less + (same + 1) / 2
    whole = sets.ranks(df, [], "v", descending).where("v = 1.0").first()
    assert whole["rank_min"] == 1 + sum(key(w) < key(1.0) for _, w, _ in rows)


def test_pareto_flags(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.randrange(12)]), rng.choice([None, rng.randrange(12)])) for i in range(300)] + [(900, 3, 3)] * 2
    df = spark.createDataFrame(rows, "k long, m long, c long")
    got = sets.pareto_flags(df, "m", "c").collect()
    assert len(got) == len(rows)
    known = [(m, c) for _, m, c in rows if m is not None and c is not None]
    for r in got:
        want = r["m"] is not None and r["c"] is not None and any(m >= r["m"] and c <= r["c"] and (m > r["m"] or c < r["c"]) for m, c in known)
        assert r["dominated"] == want


def test_holm_by_family(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k, round(rng.random() ** 3 / 20, 3)) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, p double")
    got = {r["k"]: r["p_adjusted"] for r in sets.holm(df, "p", "k", "g").collect()}
    for g in ("a", "b", None):
        mine = sorted((p, k) for h, k, p in rows if h == g)
        steps = [(len(mine) - i) * p for i, (p, _) in enumerate(mine)]
        for i, (_, k) in enumerate(mine):
            assert got[k] == pytest.approx(min(1.0, max(steps[: i + 1])))


@pytest.mark.parametrize("few", [1, 4096])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.random(500), "ties": rng.integers(0, 3, 400).astype(float), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 200), [-1e308, 1e308]]),
        "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "same": np.full(50, 0.1), "tiny": rng.random(300) * 5e-322, "negative": -rng.random(300) ** 9,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in quantiles(df, ["g"], "v", qs, bits=16, few=few).collect()}
    assert len(got) == 5 * (len(groups) + 1)
    for g, vs in {**groups, None: np.array([5.0])}.items():
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-322), (g, q)
    whole = {r["q"]: r["value"] for r in quantiles(df.where("g = 'even'"), [], "v", [0.3], bits=10, few=few).collect()}
    assert whole[0.3] == pytest.approx(np.quantile(groups["even"], 0.3))
    assert quantiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_inversions():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 47, 49, 300):
        y, w = rng.integers(0, 40, n), rng.integers(1, 4, n)
        assert agreement.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


def test_inversion_chances():
    for sizes in ((1, 1, 1, 1, 1, 1), (2, 3), (1, 2, 2), (1, 1, 2, 3), (4,)):
        base = [i for i, t in enumerate(sizes) for _ in range(t)]
        told = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(base)]
        want = np.bincount(told) / len(told)
        assert agreement.inversion_chances(sizes) == pytest.approx(want)
    assert agreement.inversion_chances((1,) * 100).sum() == pytest.approx(1)


def test_kendall(spark):
    rng = np.random.default_rng(7)
    data = {}
    for g, n, kx, ky in (("plain", 12, None, None), ("x ties", 9, 4, None), ("y ties", 8, None, 3), ("both", 60, 5, 6), ("long", 400, None, None), ("long ties", 300, 20, 25), ("flat", 6, 1, None), ("heavy", 250, 2, 3), ("pair", 2, None, None), ("one", 1, None, None)):
        side = lambda k: rng.permutation(n).astype(float) if k is None else rng.integers(0, k, n).astype(float)  # noqa: B023, E731
        x = side(kx)
        data[g] = (x, x * 0.02 * rng.random(n) + side(ky) if g == "long" else side(ky))
    rows = [(g, float(a), float(b)) for g, (x, y) in data.items() for a, b in zip(x, y)] + [("plain", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {r["g"]: r for r in agreement.kendall(df, ["g"], "x", "y").collect()}
    assert set(got) == set(data)
    for g, (x, y) in data.items():
        s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        c, d, n = int((s > 0).sum() / 2), int((s < 0).sum() / 2), len(x)
        tx, ty = (int(((v[:, None] == v).sum() - n) / 2) for v in (x, y))
        r = got[g]
        assert (r["n"], r["concordant"], r["discordant"], r["tied_x"], r["tied_y"]) == (n, c, d, tx, ty), g
        total = n * (n - 1) / 2
        if total == tx or total == ty:
            assert r["tau"] is None and r["p_value"] is None and r["p_kind"] is None
            continue
        assert r["tau"] == pytest.approx((c - d) / math.sqrt((total - tx) * (total - ty)))
        assert r["p_kind"] == ("exact" if n <= 170 and not (tx and ty) else "normal") and 0 < r["p_value"] <= 1
        if n <= 9:
            every = [abs(sum(np.sign(x[i] - x[j]) * np.sign(z[i] - z[j]) for i in range(n) for j in range(i))) >= abs(c - d) for z in itertools.islice(itertools.permutations(y), 5040)] if n <= 7 else None
            if every:
                assert r["p_value"] == pytest.approx(np.mean(every))
    draws = np.array([abs((np.sign(data["x ties"][0][:, None] - data["x ties"][0]) * np.sign(z[:, None] - z)).sum()) for z in (rng.permutation(data["x ties"][1]) for _ in range(4000))])
    s = abs((np.sign(data["x ties"][0][:, None] - data["x ties"][0]) * np.sign(data["x ties"][1][:, None] - data["x ties"][1])).sum())
    assert got["x ties"]["p_value"] == pytest.approx((draws >= s).mean(), abs=0.04)
    whole = agreement.kendall(df.where("g = 'both'"), [], "x", "y").first()
    assert whole["discordant"] == got["both"]["discordant"] and whole["p_value"] == got["both"]["p_value"]
