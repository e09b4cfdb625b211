"""Protocols assembled, read back, resumed after a failure, and refused."""

import json
import os
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from setweave.sources import assembly, protocol

SCHEMA = "split string, set_id string, index int, item_id string, category string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for s, n in (("train", 60), ("valid", 20), ("test", 30)):
        for k in range(n):
            items = rng.sample(range(90), rng.randrange(2, 6))
            out += [(s, f"{s[0]}{k}", 10 + i, f"{s}-{x}", f"c{x % 3}") for i, x in enumerate(items)]
    return out


def test_a_protocol_is_read_back_equal(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame(rows, SCHEMA)
    gone = spark.createDataFrame([("a", "b", "train")], "kept_set_id string, removed_set_id string, split string")
    held = assembly.assemble(df, path, 7, removed=gone)
    assert assembly.verified(spark, path) and not os.path.exists(path + ".staged") and held["splits"]["train"]["sets"] == 60
    positives = {}
    for s in protocol.SPLITS:
        read = protocol.read_sets(spark, path, s)
        assert {(s, r["set_id"], r["index"], r["item_id"], r["category"]) for r in read.collect()} == {r for r in rows if r[0] == s}
        own = {f"{r[1]}_{r[2]}": r for r in rows if r[0] == s}
        cat = {r[3]: r[4] for r in rows if r[0] == s}
        sets = {}
        for r in rows:
            if r[0] == s:
                sets.setdefault(r[1], []).append(r[3])
        positives[s] = {tuple(sorted(v)) for v in sets.values()}
        keys = protocol.item_keys(read)
        cp = protocol.resolve(protocol.read_compatibility(spark, path, s), ["line", "label"], "keys", keys).collect()
        assert sorted(tuple(r["item_ids"]) for r in cp if r["label"] == 1) == sorted(tuple(v) for v in sets.values())
        negative = [tuple(sorted(r["item_ids"])) for r in cp if r["label"] == 0]
        assert len(negative) == len(sets) == len(set(negative)) and not set(negative) & positives[s]
        assert sorted(sorted(cat[i] for i in v) for v in negative) == sorted(sorted(cat[i] for i in v) for v in sets.values())
        q = protocol.read_fitb(spark, path, s).collect()
        assert len(q) == len(sets) and max(q, key=lambda r: r["correct_index"])["correct_index"] == 3
        for r in q:
            set_id = r["question"][0].split("_")[0]
            assert len(set(r["answers"])) == 4 and len({cat[own[a][3]] for a in r["answers"]}) == 1
            known = [own[k][3] for k in r["question"]]
            assert sorted([*known, own[r["answers"][r["correct_index"]]][3]]) == sorted(sets[set_id])
            assert all(tuple(sorted([*known, own[a][3]])) not in positives[s] for i, a in enumerate(r["answers"]) if i != r["correct_index"])
        n = [sum(r["correct_index"] == k for r in q) for k in range(4)]
        assert max(n) - min(n) <= 1 and [held["splits"][s][f"slot_{k}"] for k in range(4)] == n
    assert spark.read.option("multiLine", True).json(f"{path}/duplicates_removed.json").first()["removed_set_id"] == "b"
    with pytest.raises(FileExistsError):
        assembly.assemble(df, path, 7)
    again = assembly.assemble(df, str(tmp_path / "q"), 7)
    assert again["splits"] == held["splits"] and {f.split("/")[0]: 0 for f in again["sha256"]}.keys() == {f.split("/")[0]: 0 for f in held["sha256"] if "duplicates" not in f}.keys()
    name = next(f for f in held["sha256"] if f.startswith("valid.json"))
    with open(f"{path}/{name}", "a") as f:
        f.write(" ")
    crc = f"{path}/{os.path.dirname(name)}/.{os.path.basename(name)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert not assembly.verified(spark, path)


def test_a_failed_run_goes_on(spark, rows, tmp_path, monkeypatch):
    path, df = str(tmp_path / "p"), spark.createDataFrame(rows, SCHEMA)
    real, seen = assembly.step, []

    def broken(spark, root, part, work):
        if part == "fill_in_blank_valid.json" and not seen:
            seen.append(part)
            spark.range(3).select(F.col("id").cast("string").alias("value")).write.text(f"{root}/{part}")  # half of a part
            raise RuntimeError("lost")
        return real(spark, root, part, work)

    monkeypatch.setattr(assembly, "step", broken)
    with pytest.raises(RuntimeError, match="lost"):
        assembly.assemble(df, path, 7)
    assert not os.path.exists(path) and os.path.exists(path + ".staged/train.json")
    with pytest.raises(ValueError, match="other settings"):
        assembly.assemble(df, path, 8)
    ran = []
    monkeypatch.setattr(assembly, "step", lambda spark, root, part, work: ran.append((part, real(spark, root, part, work))))
    held = assembly.assemble(df, path, 7)
    did = dict(ran)
    assert not did["train.json"] and not did["compatibility_train.txt"] and did["fill_in_blank_valid.json"] and did["test.json"]
    assert assembly.verified(spark, path) and held["splits"]["test"]["questions"] == 30
    assert protocol.read_fitb(spark, path, "valid").count() == 20


def test_bad_sets_are_errors(spark, tmp_path):
    bad = spark.createDataFrame([("holdout", "s", 0, "a", "c"), ("holdout", "s", 1, "b", "c")], SCHEMA)
    with pytest.raises(ValueError, match="splits"):
        assembly.assemble(bad, str(tmp_path / "p"), 1)
    comma = spark.createDataFrame([("train", "s", 0, "a,b", "c"), ("train", "s", 1, "b", "c")], SCHEMA)
    with pytest.raises(Exception, match="comma"):
        assembly.assemble(comma, str(tmp_path / "r"), 1)


def test_duplicates_are_told(spark):
    rows = [("train", "1", "a"), ("train", "1", "b"), ("valid", "0", "b"), ("valid", "0", "a"), ("test", "2", "a"), ("train", "3", "a"), ("train", "3", "b")]
    df = spark.createDataFrame(rows, "split string, set_id string, item_id string")
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    got = {tuple(r) for r in assembly.duplicate_log(df, order).collect()}
    assert got == {("1", "0", "valid"), ("1", "3", "train")}


def test_lists_are_files_of_few_rows_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assembly, "FILE_ROWS", 50)
    path = str(tmp_path / "l")
    assembly.write_lists(spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("set_id")), F.struct("set_id"), [F.col("set_id")], path)
    lists = [json.load(open(f"{path}/{f}")) for f in sorted(os.listdir(path)) if f.startswith("part-") and os.path.getsize(f"{path}/{f}")]
    assert len(lists) >= 15 and max(map(len, lists)) <= 150
    assert [r["set_id"] for part in lists for r in part] == [f"{k:04d}" for k in range(1000)]


def test_a_blank_is_drawn_once_an_item(spark, monkeypatch):
    """No filter compares items with the blank: it would be drawn anew for each item, in a set of n items n times."""
    from setweave.plans import questions

    plans, real = [], questions.scratch

    @contextmanager
    def watched(spark):
        with real(spark) as keep:
            yield lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1]

    monkeypatch.setattr(questions, "scratch", watched)
    questions.fitb_questions(spark, "/root/testdata/sf0.001").count()
    filters = [line for p in plans for line in p.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert any("md5" in p for p in plans) and filters and not any("md5" in f and "NOT (" in f for f in filters)
