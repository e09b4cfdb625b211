"""Fill-in-middle, substring dedup and vector codes against brute force and their SQL, on small odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from setweave.llm import relative_lz, rope_fim, vector_codes

DOCS = "doc_id long, text string, n string, form string, spans string, least long, key string, seed long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, at):
    """rows of (doc_id, text), with more columns whose names clash, as documents.parquet in the folder `at`."""
    df = spark.createDataFrame([(d, t, "n", "f", "s", 0, "k", 1) for d, t in rows], DOCS)
    df.write.parquet(f"{at}/documents.parquet")
    return df


def by_sql(sql, at, name="documents"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return Counter(tuple(r) for r in con.execute(sql).fetchall())


# ---- 11


def odd_texts():
    rng = np.random.default_rng(11)
    texts = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\n\nb", "é\nüñ\n漢字\n😀 x", "has <P> inside\nb", "<S>", "x <M>\ny", "ends with <\nP>", "<P\n>", "no\r\nunix\rline", "z" * 9000, ("long line " * 700 + "\n") * 3]
    texts += ["".join(rng.choice(["a", "\n", "<", "P", ">", "é", "S"], rng.integers(0, 60))) for _ in range(300)]
    return texts + ["l%d\n" % i * 3000 for i in range(2)] + ["\n" * 5000]


def test_fim_against_its_definition_and_sql(spark, tmp_path):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(None, "null id\nb\nc"), (None, None), (4, "one line"), (4, "other\ntext\n"), (-9, "minus\nnine\n")]
    df = table(spark, rows, tmp_path)
    want = Counter()
    for doc_id, t in rows:
        t = t or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(lines)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sizes = (None, None) if form == "plain" else (len(p), len(m))
        want[doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = rope_fim.op11_rope_fim(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want == by_sql(rope_fim.OP11_SQL, tmp_path)
    some = rope_fim.to_fim(df, seed=3, fim_percent=40, spm_percent=0)
    assert {r["form"] for r in some.select("form").collect()} == {"plain", "psm"}
    back = rope_fim.from_fim(some).select("doc_id", "restored").collect()
    assert Counter(map(tuple, back)) == Counter((d, t or "") for d, t in rows)
    assert rope_fim.from_fim(rope_fim.to_fim(df.limit(0))).count() == 0


def test_ropes_stay_balanced_and_split_anywhere():
    rng = np.random.default_rng(5)
    text = "".join("x" * int(rng.integers(0, 30)) + "\n" * int(rng.random() < 0.7) for _ in range(4000))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    rope = rope_fim.Rope.of(text, 64)
    assert (rope.units, rope.chars, str(rope)) == (len(lines), len(text), text)
    for k in rng.integers(0, len(lines) + 1, 60).tolist():
        a, b = rope.split(k, "units")
        assert str(a) == "".join(lines[:k]) and str(b) == "".join(lines[k:]) and a.units == k
        again = b + a
        assert str(again) == str(b) + str(a) and again.height <= 2 * np.log2(len(text) / 16)
    for k in rng.integers(0, len(text) + 1, 60).tolist():
        a, b = rope.split(k, "chars")
        assert (str(a), str(b)) == (text[:k], text[k:])


# ---- 12


def removed(rows, window):
    """(doc_id, n_words, n_removed, kept) by all windows."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = defaultdict(lambda: np.inf)
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least[k], relative_lz.LAST if d is None else d)
    out = Counter()
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (relative_lz.LAST if d is None else d):
                gone.update(range(i, i + window))
        out[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("letters,hot", [(2, 3), (3, 10_000), (12, 4), (12, 10_000)])
def test_substring_dedup_by_small_windows(spark, letters, hot):
    """Few letters repeat everywhere, so seeds tie, blocks are large and windows cross factors."""
    rng = np.random.default_rng(letters)
    shared = [rng.integers(0, letters, 25) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [rng.integers(0, letters, rng.integers(0, 12)) if rng.random() < 0.6 else shared[rng.integers(4)][rng.integers(0, 12) : rng.integers(13, 25)] for _ in range(rng.integers(0, 5))]
        text = rng.choice([" ", "\t", "\n "]).join("w%d" % x for p in parts for x in p)
        rows.append((None if rng.random() < 0.05 else int(rng.integers(0, 100)), text))
    rows += rows[:10] + [(None, None), (500, ""), (501, rows[0][1]), (3, rows[1][1]), (502, " ".join(["w1"] * 200)), (503, " ".join(["w1"] * 150))]
    df = spark.createDataFrame([(d, t, "n", "f", "s", 0, "k", 1) for d, t in rows], DOCS)
    got = relative_lz.without_repeats(df, window=6, size=3, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == removed(rows, 6)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_substring_dedup_query_and_sql(spark, tmp_path):
    rng = np.random.default_rng(12)
    word = lambda n: ["x%d" % x for x in rng.integers(0, 3000, n)]
    passages = [word(n) for n in (49, 50, 51, 60, 75, 130, 300)]
    rows = []
    for i in range(150):
        body = word(int(rng.integers(0, 90)))
        for p in rng.integers(0, len(passages), rng.integers(0, 3)).tolist():
            body += passages[p] + word(int(rng.integers(0, 40)))
        rows.append((int(rng.integers(0, 10_000)), " ".join(body)))
    long = word(30_000)
    rows += [(20_000, " ".join(long)), (20_001, "\n".join(long)), (20_002, " ".join(long[:29_000] + ["end"])), (20_003, "pad " * 5000), (20_004, "pad " * 3000), (None, rows[0][1]), (None, None)]
    table(spark, rows, tmp_path)
    got = Counter(map(tuple, relative_lz.op12_relative_lz(spark, str(tmp_path)).collect()))
    want = Counter()
    for (d, n, k, kept), m in removed(rows, 50).items():
        want[d, n, k, hashlib.sha256(kept.encode()).hexdigest()] += m
    assert got == want == by_sql(relative_lz.OP12_SQL, tmp_path)


def test_substring_dedup_of_empty_and_short(spark):
    df = spark.createDataFrame([(d, t, "n", "f", "s", 0, "k", 1) for d, t in [(1, "a b"), (2, "a b"), (3, None)]], DOCS)
    assert Counter(map(tuple, relative_lz.without_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect())) == Counter([(1, 2, 0, "a b"), (2, 2, 0, "a b"), (3, 0, 0, "")])
    assert relative_lz.without_repeats(df.limit(0)).count() == 0


# ---- 13


def by_hand(rows, parts=4, entries=256, rounds=4):
    """vec_id, code, error, label_error, the codebooks' digest of rows (vec_id, label, vector), in Python's whole numbers."""
    kept = [(i, lab, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = len(kept[0][2]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for _, _, v in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((dist(x, b), e) for e, b in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for x in cut[p]:
                held[near(x, books[p])[1]].append(x)
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[near(cut[p][r], books[p]) for p in range(parts)] for r in range(len(kept))]
    total = Counter()
    for (_, lab, _), f in zip(kept, found):
        total[lab] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for book in books for b in book for c in b).encode()).hexdigest()
    return Counter((i, "".join("%02x" % e for _, e in f), sum(d for d, _ in f), total[lab], digest) for (i, lab, _), f in zip(kept, found))


def test_vector_codes_against_whole_numbers_and_sql(spark, tmp_path):
    rng = np.random.default_rng(13)
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), [float(np.float32(x)) for x in rng.normal(0, 1, 8) * 10.0 ** rng.integers(-3, 2)]) for i in rng.permutation(420)]
    rows += [(5, 1, rows[0][2]), (5, 1, rows[1][2]), (None, 2, rows[2][2]), (None, None, rows[2][2]), (900, 1, None), (901, 1, [None] + rows[0][2][1:]), (-4, 0, [float("nan")] + rows[0][2][1:]), (902, 0, [float("-inf")] + rows[0][2][1:])]
    df = spark.createDataFrame([(i, v, lab, "c", 0) for i, lab, v in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(map(tuple, vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()))
    assert got == by_hand(rows) == by_sql(vector_codes.OP13_SQL, tmp_path, "embeddings")


def test_vector_codes_of_few_none_and_bad_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = [(3, [0.5, -0.5, 1.0, 2.0], 1), (1, [0.25, 0.0, -3.0, 2.0], None), (2, [1.0], 1), (4, [], 1)]
    codes, books = vector_codes.compress(spark.createDataFrame(few, schema))
    assert books.shape == (4, 2, 1)
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in codes.collect()) == Counter([(3, "01010100", 0), (1, "00000000", 0)])
    none = spark.createDataFrame([(1, None, 1)], schema)
    assert vector_codes.with_label_error(vector_codes.compress(none)[0]).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], schema))
    with pytest.raises(Exception, match="above"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 4, 1)], schema))


def test_blocks_are_moved_alike_however_they_are_dealt(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist(), 0) for i in range(900)], "vec_id long, embedding array<double>, label int")
    one, two = (vector_codes.compress(rows.repartition(k), entries=16)[1] for k in (1, 7))
    assert (one == two).all()
