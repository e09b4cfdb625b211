import hashlib
import itertools
import json
import math
import random
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from setweave.functions import vectors as V
from setweave import queries, storage
from setweave.operators import choices, graph, joins, metrics, resampling, sets
from setweave.queries import QUERIES, SQL
from setweave.sources import archives, protocol, tables
from setweave.streaming.calibration import windowed_means

SF = "/root/testdata/sf0.001"


def scored(spark, labels, scores):
    return spark.createDataFrame([("g", y, float(s)) for y, s in zip(labels, scores)], "g string, label int, score double")


def brute_auc(labels, scores):
    pos, neg = [s for y, s in zip(labels, scores) if y], [s for y, s in zip(labels, scores) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("places", [3, 1])
def test_auc_with_ties(spark, places):
    rng = random.Random(places)
    labels = [rng.randrange(2) for _ in range(80)] + [0, 1]
    scores = [round(rng.random(), places) for _ in labels]
    df = scored(spark, labels, scores)
    auc = metrics.roc_auc(df, ["g"]).first()["auc"]
    assert auc == pytest.approx(brute_auc(labels, scores))
    assert metrics.roc_auc(df.withColumn("score", -F.col("score")), ["g"]).first()["auc"] == pytest.approx(1 - auc)
    weights = [rng.randrange(1, 4) for _ in labels]  # a weight of n is n rows
    many = [(y, s) for y, s, w in zip(labels, scores, weights) for _ in range(w)]
    heavy = spark.createDataFrame([("g", y, s, float(w)) for y, s, w in zip(labels, scores, weights)], "g string, label int, score double, w double")
    flat = scored(spark, *zip(*many))
    for f, c in ((metrics.roc_auc, "auc"), (metrics.average_precision, "ap")):
        assert f(heavy, ["g"], weight=F.col("w")).first()[c] == pytest.approx(f(flat, ["g"]).first()[c])
    assert metrics.roc_auc(flat, ["g"]).first()["auc"] == pytest.approx(brute_auc(*zip(*many)))


@pytest.mark.parametrize("labels, scores", [((1, 1, 1), (0.3, 0.1, 0.4)), ((), ()), ((0, 1), (0.5, float("nan"))), ((0, 1), (float("inf"), 0.5))])
def test_no_ranking_is_an_error(spark, labels, scores):
    with pytest.raises(ValueError, match="no ranking"):
        metrics.roc_auc(scored(spark, labels, scores), ["g"], strict=True)


def test_calibration(spark):
    rng = random.Random(4)
    p = [rng.random() for _ in range(200)] + [0.0, 1.0, 0.25, 0.5]
    y = [int(rng.random() < x) for x in p]
    bins, want = 8, 0.0
    for k in range(bins):
        mine = [(a, b) for a, b in zip(p, y) if min(int(a * bins), bins - 1) == k]
        want += abs(sum(a - b for a, b in mine)) / len(p)
    df = scored(spark, y, p)
    assert metrics.ece(df, ["g"], bins).first()["ece"] == pytest.approx(want)
    told = metrics.reliability(df, ["g"], 300).collect()
    assert len(told) == 300 and sum(r["n"] for r in told) == len(p) and all(r["mean_probability"] is None for r in told if not r["n"])
    assert all(r["lower"] <= r["mean_probability"] <= r["upper"] for r in told if r["n"])
    for bad in (-0.001, 1.001, float("nan"), None):
        with pytest.raises(Exception, match="probability"):
            metrics.ece(spark.createDataFrame([("g", 0, bad)], "g string, label int, score double"), ["g"], bins).collect()
    with pytest.raises(ValueError):
        metrics.reliability(df, ["g"], 1)


def test_first_argmax(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.1), (2, 2, 0.9)], "q int, i int, s double")
    assert {r["q"]: r["predicted_index"] for r in metrics.first_argmax(df, ["q"], "i", "s").collect()} == {1: 0, 2: 2}


def test_pair_feature_is_symmetric(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5])], "a array<float>, b array<float>")
    x, y = df.select(V.pair_feature(F.col("a"), F.col("b")), V.pair_feature(F.col("b"), F.col("a"))).first()
    assert x == y == [0.5, 0.5, 0.5, 0.0]


def test_holm(spark):
    rng = random.Random(7)
    p = [rng.random() ** 4 for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = [r["p_adjusted"] for r in sets.holm(df, "p", "k").orderBy("p").collect()]
    want = [min(1.0, max((30 - i) * x for i, x in enumerate(sorted(p)[: k + 1]))) for k in range(30)]
    assert got == pytest.approx(want)


def test_features_match_pairs(spark):
    rng = random.Random(8)
    rows = [(s, i, [rng.uniform(-1, 1) for _ in range(5)]) for s in range(6) for i in range(s)]
    got = {r["s"]: r["feature"] for r in sets.features(spark.createDataFrame(rows, "s int, i int, v array<double>"), "s", "v").collect()}
    assert sorted(got) == [2, 3, 4, 5]  # fewer than two items have no pairs
    for s, f in got.items():
        vs = [v for t, _, v in rows if t == s]
        pairs = list(itertools.combinations(vs, 2))
        want = [sum(abs(a[d] - b[d]) for a, b in pairs) / len(pairs) for d in range(5)] + [sum(a[d] * b[d] for a, b in pairs) / len(pairs) for d in range(5)]
        assert f == pytest.approx(want)
    with pytest.raises(Exception, match="widths"):
        sets.features(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "s int, v array<double>"), "s", "v").collect()


def test_components_of_training_rows(spark):
    import numpy as np

    from setweave.operators.learners import train_only_pca

    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1]) + 2
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "i int, embedding array<double>")
    out, explained = train_only_pca(df, 2, F.col("i") < 60)
    z = (x - x[:60].mean(0)) / x[:60].std(0)
    w, v = np.linalg.eigh(np.cov(z[:60].T))
    assert explained == pytest.approx(w[-2:].sum() / w.sum())
    want = z @ v[:, ::-1][:, :2]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r["pca"] for r in out.orderBy("i").collect()])
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)


def test_learner_chain(spark):
    r = QUERIES["learner_chain"](spark, SF).first()
    assert r["refit_error"] <= 1e-8 and 0 < r["explained"] <= 1 and 0.3 < r["test_auc"] < 0.7 and r["examples"] > 2000


def test_checked_joins(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    want = spark.createDataFrame([(2,), (2,), (1,)], "k int")
    assert sorted(r["v"] for r in joins.gather(want, held, ["k"]).collect()) == ["a", "b", "b"]
    with pytest.raises(Exception, match="key not held"):
        joins.gather(want.union(spark.createDataFrame([(3,)], "k int")), held, ["k"]).collect()
    cached = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0004]), (2, "a", [1.0, 0.0]), (2, "c", [0.0, 1.0])], "k int, s string, v array<double>")
    got = {r["k"]: (r["first_split"], r["copies"], r["held"], r["agree"]) for r in joins.remapped(want.union(spark.createDataFrame([(9,)], "k int")), cached, "k", "s", "v").collect()}
    assert got == {1: ("a", 2, True, True), 2: ("a", 2, True, False), 9: (None, 0, False, True)}
    nation, region = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("nation", "region"))
    named = region.withColumnRenamed("r_regionkey", "n_regionkey")
    assert queries.region_names(nation, named).count() == nation.count()
    with pytest.raises(Exception, match="unmatched"):
        queries.region_names(nation, named.where("n_regionkey > 0")).collect()


def test_five_choices(spark):
    rows = [(1, "x", [0.1, 0.9, 0.9, 0.0, 0.2], [0.2, 0.3, 0.1, 0.1, 0.3], 1), (2, "x", [0.5, 0.1, 0.1, 0.1, 0.1], None, 3)]
    df = spark.createDataFrame(rows, "q int, f string, scores array<double>, gt_distribution array<double>, archive_gt_index int")
    a, b = choices.answered(df).orderBy("q").collect()
    assert (a["predicted_index"], a["majority_gt_index"], a["archive_correct"], a["majority_correct"], a["human_agreement"]) == (1, 1, True, True, 0.3)
    assert (b["predicted_index"], b["archive_correct"], b["majority_correct"], b["human_agreement"]) == (0, False, None, None)
    for scores, dist in (([0.1] * 4, None), ([0.1] * 5, [0.5] * 5)):
        with pytest.raises(Exception, match="form"):
            choices.answered(spark.createDataFrame([(1, "x", scores, dist, 0)], df.schema)).collect()


def test_negatives_and_questions_are_valid(spark):
    a = QUERIES["protocol_audit"](spark, SF).first()
    assert a["equal_positive"] == a["repeated"] == a["repeats_an_item"] == 0 and a["complete"] >= 0.99 * a["sets"]
    q = QUERIES["question_safeguards"](spark, SF).first()
    assert [q[c] for c in ("other_category", "own_distractor", "repeated_candidate", "completes_positive", "wrong_slot")] == [0] * 5
    m = QUERIES["category_match"](spark, SF).first()
    assert m["negatives"] == m["same_categories"] == a["complete"] and q["questions"] >= 0.99 * a["sets"]


def test_validated_join(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "x")], "d string, m string")
    right = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "d string, m string, v int")
    assert sets.validated_left_join(left, right, ["d", "m"], "v").count() == 2
    with pytest.raises(Exception, match="unmatched"):
        sets.validated_left_join(left, right.limit(1), ["d", "m"], "v").collect()
    with pytest.raises(Exception, match="duplicate"):
        sets.validated_left_join(left, right.union(right), ["d", "m"], "v").collect()


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(f"s{rng.randrange(60)}", rng.randrange(90)) for _ in range(90)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, i in edges:
        a, b = find(("s", s)), find(("i", i))
        parent[a] = b
    want = {}
    for s, _ in edges:
        want.setdefault(find(("s", s)), set()).add(s)
    got = {}
    for r in graph.set_components(spark.createDataFrame(edges, "set_id string, item_id int")).collect():
        got.setdefault(r["component"], set()).add(r["set_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())


def test_components_of_item_classes(spark):
    rows = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (4, "f"), (5, None), (6, "g")]
    items = spark.createDataFrame(rows, "set_id int, item_id string")
    classes = spark.createDataFrame([("b", "x"), ("c", "x"), ("d", "y"), ("f", "y"), ("g", None)], "item_id string, cls string")
    got = {r["set_id"]: r["component"] for r in graph.set_components(items.where("item_id is not null"), classes=classes).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 6: 6}
    alone = {r["set_id"]: r["component"] for r in graph.set_components(items.where("item_id is not null")).collect()}
    assert alone == {1: 1, 2: 2, 3: 3, 4: 4, 6: 6}


def test_reports_that_must_hold(spark):
    from setweave.operators import checks

    good = spark.createDataFrame([(10, 0, 0)], "sets long, overlaps long, bad long")
    assert checks.valid(good, ["overlaps", "bad"]).first()["sets"] == 10
    bad = spark.createDataFrame([("train", 2, 0), ("test", 1, None)], "split string, overlaps long, bad long")
    assert checks.violations(bad, ["overlaps", "bad"]) == {"overlaps": 3, "bad": 0}
    with pytest.raises(ValueError, match="bad 0, overlaps 3"):
        checks.valid(bad, ["overlaps", "bad"])
    report = QUERIES["class_safeguards"](spark, SF)
    wrong = [c for c in report.columns if c not in ("questions", "slot_spread")]
    assert checks.valid(report, wrong).first()["questions"] > 1000


def test_best_fit():
    sizes = [("a", 50), ("b", 7), ("c", 7), ("d", 3), ("e", 3), ("f", 1)]
    got = graph.best_fit(sizes, {"train": 50, "valid": 10, "test": 11})
    assert got == {"a": "train", "b": "valid", "c": "test", "d": "valid", "e": "test", "f": "test"}
    assert graph.best_fit([("g", 4), ("h", 2), ("i", 2)], {"test": 2, "valid": 2, "train": 4}) == {"g": "train", "h": "valid", "i": "test"}  # ties: valid before test
    for sizes, targets in (([], {"train": 0}), ([("a", 5)], {"train": 4, "test": 1}), ([("a", 5)], {"train": 5, "test": 1})):
        with pytest.raises(ValueError):
            graph.best_fit(sizes, targets)


def test_packer_by_hand():
    p = graph.Packer({"train": 2, "valid": 1, "test": 1})
    #         all equal: train; then valid, test lack all; x is train's; two owners; full; the last room
    assert [p.deal(g) for g in (["x"], ["y"], ["z"], ["x", "y"], ["y"], ["x", "w"], ["q"])] == ["train", "valid", "test", None, None, "train", None]
    p.close()
    with pytest.raises(ValueError):
        graph.Packer({"train": 1}).close()


def test_pack_sets(spark):
    rows = [(s, f"g{(s * 7 + k) % 60}") for s in range(200) for k in range(2)]
    items = spark.createDataFrame(rows, "set_id long, item_id string")
    want = {"train": 60, "valid": 10, "test": 15}
    got = {r["set_id"]: r["split"] for r in graph.pack_sets(items, want).collect()}
    assert Counter(got.values()) == want
    owner = {}
    for s, g in rows:
        if s in got:
            assert owner.setdefault(g, got[s]) == got[s]
    with pytest.raises(Exception, match="capacities"):
        graph.pack_sets(items, {"train": 300, "valid": 1, "test": 1}).collect()


def test_users_and_owners(spark):
    shares = {"train": 0.5, "valid": 0.25, "test": 0.25}
    got = graph.assign_users([("u", 6), ("v", 3), ("w", 2), ("x", 1)], shares)  # targets 6, 3, 3
    assert got == {"u": "train", "v": "valid", "w": "test", "x": "test"}
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "c"), (4, "b")], "set_id int, item_id string")
    of = spark.createDataFrame([(1, "train"), (2, "valid"), (3, "valid"), (4, "test")], "set_id int, split string")
    owners = graph.owned_items(items, of, {"train": 0.6, "valid": 0.2, "test": 0.2})
    assert {r["item_id"]: r["owner"] for r in owners.collect()} == {"a": "valid", "b": "test", "c": "valid"}
    assert {r["set_id"]: r["pure"] for r in graph.pure_sets(items, of, owners).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_sign_test(spark):
    df = spark.createDataFrame([(3, 9), (0, 0), (0, 5)], "a long, b long")
    got = [r[0] for r in df.select(resampling.binomial_p(F.col("a"), F.col("b"))).collect()]
    want = [min(1, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n) for n, m in ((12, 3), (0, 0), (5, 0))]
    assert got == pytest.approx([want[0], 1.0, want[2]])


def test_rank_agreement(spark):
    rng = random.Random(5)

    def ranks(v):
        return [sum(o < a for o in v) + (sum(o == a for o in v) + 1) / 2 for a in v]

    def both(x, y):
        n, sign = len(x), lambda d: (d > 0) - (d < 0)
        pairs = list(itertools.combinations(range(n), 2))
        return sum((a - (n + 1) / 2) * (b - (n + 1) / 2) for a, b in zip(x, y)), sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in pairs)

    cases = [(f"{n}-{top}", ranks([rng.randrange(top) for _ in range(n)]), ranks([rng.randrange(top) for _ in range(n)])) for n in (2, 4, 5, 8) for top in (3, 50)]
    cases.append(("flat", [2.0, 2.0, 2.0], [1.0, 2.0, 3.0]))
    got = {r["k"]: r for r in resampling.rank_agreement(spark.createDataFrame(cases, "k string, x array<double>, y array<double>"), ["k"], most=5).collect()}
    assert len(got) == len(cases)
    for k, x, y in cases:
        own, one, two = both(x, y), both(x, x), both(y, y)
        for c, name in enumerate(("rho", "tau")):
            if one[c] * two[c] == 0:
                assert got[k][name] is None and got[k][f"{name}_p"] is None
                continue
            assert got[k][name] == pytest.approx(own[c] / math.sqrt(one[c] * two[c]))
            if len(x) > 5:
                assert got[k][f"{name}_p"] is None
            else:
                every = [abs(both(x, z)[c]) >= abs(own[c]) for z in itertools.permutations(y)]
                assert got[k][f"{name}_p"] == pytest.approx(sum(every) / len(every))


def test_models_are_kept(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from setweave.operators.learners import fitted, held_model, keep_model, scored

    rng = random.Random(6)
    rows = spark.createDataFrame([(float(i % 2), [rng.random() + i % 2, rng.random()]) for i in range(40)], "label double, v array<double>").select("label", array_to_vector("v").alias("features"))
    model = fitted(rows, 40, 1.0)
    keep_model(model, f"{tmp_path}/model")
    again = held_model(spark, f"{tmp_path}/model")
    assert scored(again, rows).exceptAll(scored(model, rows)).isEmpty()
    with pytest.raises(Exception, match="exist"):
        keep_model(model, f"{tmp_path}/model")


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1, 0.123456), (None, 2, None)], "name string, n int, x double")
    assert protocol.markdown(df, 2) == "| name | n | x |\n| :--- | ---: | ---: |\n| a\\|b | 1 | 0.12 |\n|  | 2 |  |\n"
    with pytest.raises(ValueError, match="more than 1 rows"):
        protocol.markdown(df, most=1)


def test_largest_remainder(spark):
    df = spark.createDataFrame([("train", 5), ("valid", 3), ("test", 3)], "k string, n long")
    assert sum(r["target"] for r in sets.largest_remainder(df, "k", "n", 10).collect()) == 10


def test_protocol_files(spark, tmp_path):
    names = {"s7": ["hat", "bag", "coat"], "s8": ["sock", "belt"]}
    sets_ = [{"set_id": s, "items": [{"item_id": i, "index": k + 4, "semantic_category": "" if k else "c"} for k, i in enumerate(items)]} for s, items in names.items()]
    root = str(tmp_path)
    (tmp_path / "validation.json").write_text(json.dumps(sets_))
    (tmp_path / "compatibility_valid_new.txt").write_text("0 s7_4 s8_5 s7_6\n \n1 s8_4 s8_5\n")
    (tmp_path / "fill_in_the_blank_valid.json").write_text(json.dumps([{"question": ["s7_5", "s7_6"], "answers": ["s8_4", "s8_5", "s7_4"]}]))
    read = protocol.read_sets(spark, root, "valid")
    assert {r["category"] for r in read.collect()} == {"c", "<missing>"}
    keys = protocol.item_keys(read)
    cp = protocol.read_compatibility(spark, root, "valid")
    assert {r["label"]: r["item_ids"] for r in protocol.resolve(cp, ["line", "label"], "keys", keys).collect()} == {0: ["hat", "belt", "coat"], 1: ["sock", "belt"]}
    assert protocol.read_fitb(spark, root, "valid").first()["correct_index"] == 2
    with pytest.raises(Exception, match="unknown key"):
        protocol.resolve(spark.createDataFrame([(1, ["s7_99"])], "line long, keys array<string>"), ["line"], "keys", keys).collect()
    with pytest.raises(ValueError):
        protocol.read_sets(spark, root, "holdout")
    (tmp_path / "train.json").write_text(json.dumps(sets_[0]))
    with pytest.raises(ValueError, match="no list"):
        protocol.read_sets(spark, root, "train")
    for text in ("2 s7_4", "x s7_4"):
        (tmp_path / "compatibility_test.txt").write_text(text)
        with pytest.raises(Exception, match="label"):
            protocol.read_compatibility(spark, root, "test").collect()
    protocol.write_compatibility(cp, f"{root}/out")
    with pytest.raises(Exception):
        protocol.write_compatibility(cp, f"{root}/out")
    held = protocol.manifest(spark, f"{root}/out")
    assert protocol.manifest_matches(spark, f"{root}/out", held)


def test_csv_append(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda seed, lr: spark.createDataFrame([(seed, lr, 0.5 + seed / 100)], "seed int, lr double, auc double")
    tables.append_runs(rows(1, 0.1), path, ["lr"], "seed")
    tables.append_runs(rows(2, 0.1), path, ["lr"], "seed")
    with pytest.raises(ValueError, match="settings"):
        tables.append_runs(rows(3, 0.2), path, ["lr"], "seed")
    with pytest.raises(ValueError, match="seed"):
        tables.append_runs(rows(2, 0.1), path, ["lr"], "seed")
    assert sorted(map(tuple, tables.read_csv(spark, path, "seed int, lr double, auc double").collect())) == [(1, 0.1, 0.51), (2, 0.1, 0.52)]
    assert dict(tables.read_csv(spark, path).dtypes)["auc"] == "double"


def test_completed_runs_are_skipped(spark, tmp_path):
    path, done = str(tmp_path / "out"), []

    def work():
        done.append(1)
        protocol.write_table(spark.range(3), path)

    assert protocol.once(spark, path, work) and not protocol.once(spark, path, work) and len(done) == 1
    (tmp_path / "out" / "extra.txt").write_text("x")
    with pytest.raises(ValueError, match="changed"):
        protocol.once(spark, path, work)


def test_shared_folder_is_asked_for(monkeypatch, spark):
    class Local:
        master = "spark://elsewhere:7077"
        _jsc = None

    class Unset:
        def isDefined(self):
            return False

    class Session:
        sparkContext = Local()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    Local._jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Unset)}))})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_archives(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name, data in {"x/one.json": '{"set_id": "s", "n": 3}', "x/bad.json": "{oops", "x/p.jpg": b"\x00\x01", "__MACOSX/x/p.jpg": b"", "x/._p.jpg": b"", "y/q.jpg": b"q", "z/q.jpg": b"r"}.items():
            z.writestr(name, data)
    m = {r["entry"]: (r["basename"], r["crc32"], r["size"]) for r in archives.members(spark, path).collect()}
    assert m["x/p.jpg"] == ("p.jpg", zlib.crc32(b"\x00\x01"), 2) and len(m) == 5
    j = {r["entry"]: (r["data"], r["problem"]) for r in archives.json_members(spark, path, "set_id string, n int").collect()}
    assert tuple(j["x/one.json"][0]) == ("s", 3) and j["x/bad.json"] == (None, "malformed JSON")
    want = spark.createDataFrame([("p.jpg",), ("p.jpg",)], "basename string")
    got = archives.extract(spark, path, want).collect()
    assert [(r["content"], r["sha256"]) for r in got] == [(b"\x00\x01", hashlib.sha256(b"\x00\x01").hexdigest())]
    for name in ("none.jpg", "q.jpg"):
        with pytest.raises(Exception, match="member"):
            archives.extract(spark, path, spark.createDataFrame([(name,)], "basename string")).collect()
    held = spark.createDataFrame([("p.jpg", "0")], "basename string, sha256 string")
    with pytest.raises(Exception, match="changed member"):
        archives.unchanged(archives.extract(spark, path, want), held).collect()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_means(stream).writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").count() == windowed_means(events).count()


def test_bootstrap_has_2000_replicates(spark):
    p = [r["p_value"] * 2001 / 2 for r in QUERIES["boot_paired_diff"](spark, SF).collect()]  # 1 or 2 (k + 1) / (B + 1)
    assert p and all(x == 1000.5 or abs(x - round(x)) < 0.01 for x in p)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")

    def rows(df):
        df = df[sorted(df.columns)]
        tidy = lambda v: "" if v is None or str(v) in ("<NA>", "nan", "None") else v if isinstance(v, (str, bool)) else round(float(v), 5)
        return sorted(tuple(map(str, map(tidy, r))) for r in df.astype(object).itertuples(index=False))

    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(SQL[name]).df())
