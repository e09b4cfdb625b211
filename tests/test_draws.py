"""Digests of many texts at once, splits that are kept, and shares of draws against those told one by one."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from setweave.functions.digests import md5_words
from setweave.operators import multinomial as M
from setweave.operators import resampling


def test_md5_words_are_those_of_hashlib():
    prefixes = [b"", b"a:", b"boot:1:2:", "é:".encode(), b"y" * 52, b"y" * 53, b"y" * 70]
    numbers = np.array([0, 9, 10, 99, 100, 12345])
    got = md5_words(prefixes, numbers)
    for i, p in enumerate(prefixes):
        for j, n in enumerate(numbers):
            assert (got[i, j] == np.frombuffer(hashlib.md5(p + str(n).encode()).digest(), dtype=">u4")).all()


def test_counts_do_not_depend_on_what_was_drawn_before():
    n = 50_000
    a = M.unit_weights(np.arange(30_000, 30_200), n, 40, "k")
    assert any(key[0] == "k" for key in M._splits)  # wide ranges are split once
    M._splits.clear()
    assert (M.unit_weights(np.arange(29_990, 30_300), n, 40, "k")[10:210] == a).all() and len(M._splits) <= M.KEPT


def test_packed_counts_come_back():
    for top in (3, 255, 256, 70_000):
        c = np.array([0, 1, top] * 50, dtype=np.int64)
        assert (M.unpack(M.pack(c), len(c)) == c).all()


def test_rows_by_unit_are_many_tasks_however_few(spark):
    rows = spark.range(100).select(F.col("id").alias("unit_no"), F.lit(100).alias("n_units"))
    assert M._by_unit(rows, ["unit_no", "n_units"], []).rdd.getNumPartitions() >= 4  # one, when small ranges were joined


@pytest.mark.parametrize("most", [20, 4099])
def test_shares_equal_draws_one_by_one(spark, most):
    rng = np.random.default_rng(2)
    rows = [(g, i * 3, int(rng.random() < 0.3)) for g, n in (("a", most), ("b b", 7), ("c", 1)) for i in range(n)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, u long, ok long")
    out = resampling.resampled_shares(df, "g", "u", "ok", 21, "s")
    assert "Generate explode(sequence(cast(" not in out._jdf.queryExecution().toString()
    got = {(r["g"], r["replicate"]): r["share"] for r in out.collect()}
    assert len(got) == 3 * 21
    for g in ("a", "b b", "c"):
        ok = [r[2] for r in rows if r[0] == g]
        for k in (0, 15, 16, 20):
            drawn = [int(hashlib.md5(f"s:{g}:{k}:{i}".encode()).hexdigest()[:8], 16) % len(ok) for i in range(len(ok))]
            assert got[g, k] == pytest.approx(sum(ok[i] for i in drawn) / len(ok))


def test_splits_by_steps_are_those_of_the_distribution():
    for half, size in ((1, 2), (1, 3), (5, 11), (16, 32)):
        edges = np.concatenate([M.few_cdfs(half, size).ravel(), np.arange(M.STEPS) / M.STEPS])
        u = np.clip(np.concatenate([edges, edges + 1e-12, edges - 1e-12, np.random.default_rng(1).random(2000)]), 1e-13, 1 - 1e-13)
        for c in range(M.FEW + 3):
            exact = np.searchsorted(M.binomial_cdf(c, half, size)[1], u, side="left") if c else np.zeros(len(u))
            assert (M.lower_half(np.full(len(u), c), half, size, u) == np.minimum(exact, c)).all()


def test_units_are_drawn_together_and_none_is_parted():
    n = 3 * M.UNITS + 7
    rows = pd.DataFrame({"label": np.repeat([0, 1], 4 * n), "unit_no": np.tile(np.repeat(np.arange(n), 4), 2), "model": np.tile(np.arange(4), 2 * n)})
    got = list(M.unit_batches(rows, ["label"]))
    assert [len(b) for _, b in got] == [4 * M.UNITS, 4 * M.UNITS, 4 * M.UNITS, 28] * 2 and [s for s, _ in got] == [["0"]] * 4 + [["1"]] * 4
    assert pd.concat([b for _, b in got]).equals(rows) and [s for s, _ in M.unit_batches(rows.drop(columns="label")[:8], [])] == [[]]
    assert not list(M.unit_batches(rows[:0], []))
