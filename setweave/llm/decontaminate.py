"""Operator 1, benchmark decontamination by template canonicalisation. DataFrame functions only.

A text becomes a sequence of tokens; numbers, names (capitalised words inside a sentence) and
units behind a number become typed placeholders, all other words are lower-cased. Windows of
WINDOW tokens (or a whole shorter item) with at least LITERALS literal words are hashed, and all
windows as their lower-cased raw tokens too, which match word for word in any case (a window that
is too generic as a template is searched for that way only). All windows of a document are made in
one scan and joined to the benchmark's, which are broadcast in blocks of at most BLOCK_ROWS (one
block up to that many; each further one is another scan), so the documents' windows are never
shuffled. Hits are compared token by token, so a hash alone proves nothing, and a template window
counts if its slots are consistent: along one alignment, each value of an item's slots stands for
one value of the document's. A document leaks an item if its windows cover at least COVER of the
item's tokens.

Result: one row a leaking (document, item). Re-parameterised items (other numbers, names,
units) are found like exact ones; `exact_slots` tells them apart.

Defined results: null and empty texts leak nothing; an item of fewer than WINDOW tokens is searched
for as a whole, one without tokens not at all; rows are judged one by one, a row being its doc_id
and text: rows that repeat a doc_id do not hide each other, and the one that covers most of an item
stands for the doc_id; equal rows give one row; items that repeat an item_id are searched apart,
likewise; a null doc_id or item_id is an id of its own; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, durable, fresh

WINDOW, LITERALS, COVER = 5, 3, 0.5
BLOCK_ROWS = 2_000_000
#: Units replaced behind a number.
UNITS = "km m cm mm mi ft kg g mg lb oz l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur gbp dollars dollar cents percent mph kmh kwh w kw v hz c f k apples miles meters metres grams pounds euros tonnes liters litres"
NUM, NAME, UNIT = "⟨n⟩", "⟨p⟩", "⟨u⟩"
_GAP = "[^\\p{L}\\p{M}\\p{N}·⟨⟩]+"


def spaced(text: Column) -> Column:
    """Numbers as one run of digits and middle dots, apart from letters."""
    has = text.rlike("[0-9]")
    out = F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", "·")
    out = F.regexp_replace(out, "(?<=[0-9])(?=\\p{L})|(?<=\\p{L})(?=[0-9])", " ")
    return F.when(has, out).otherwise(text)


def templated(clean: Column) -> Column:
    """Placeholders for names, numbers and units, token for token; literals lower-cased."""
    names = F.regexp_replace(clean, "\\p{Lu}(?<=[^.!?:;\\s|>][ \\t]\\p{Lu})[\\p{Ll}\\p{M}]+", NAME)
    nums = F.regexp_replace(F.lower(names), "[0-9][0-9·]*", NUM)
    units = F.regexp_replace(nums, f"(?<={NUM}[ \\t]?)[ \\t]?(?:{'|'.join(UNITS.split())})(?![\\p{{L}}\\p{{M}}\\p{{N}}])", " " + UNIT)
    return F.when(clean.rlike("[0-9]"), units).otherwise(F.lower(names))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda t: t != "")


def both_windows(toks: Column, raw: Column, n: int) -> Column:
    """(p, hash, raw_hash) of all runs of n tokens, in order; raw_hash is that of the raw ones, null if a text's tokens are all as written."""
    at = F.sequence(F.lit(0), F.size(toks) - n)
    hashed = lambda c, p: F.xxhash64(*[F.get(c, p + k) for k in range(n)])
    same = F.transform(at, lambda p: F.struct(p.alias("p"), hashed(toks, p).alias("hash"), F.lit(None).cast("long").alias("raw_hash")))
    both = F.transform(at, lambda p: F.struct(p.alias("p"), hashed(toks, p).alias("hash"), hashed(raw, p).alias("raw_hash")))
    none = F.array().cast("array<struct<p:int,hash:bigint,raw_hash:bigint>>")
    return F.when(F.size(toks) < n, none).when(toks == raw, same).otherwise(both)


def item_windows(bench: DataFrame, window: int, literals: int) -> DataFrame:
    """item (of an id and text), item_id, n_tokens, len, q (place), win (tokens that are hashed), raw (the window as written), verbatim (win is raw)."""
    b = bench.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    b = b.select(F.xxhash64("item_id", "text").alias("item"), "item_id", spaced(F.col("text")).alias("clean"))
    b = b.select("item", "item_id", tokens(templated(F.col("clean"))).alias("t"), tokens(F.lower("clean")).alias("raw")).withColumn("n_tokens", F.size("t"))
    b = b.where("n_tokens > 0").withColumn("len", F.least(F.lit(window), F.col("n_tokens")))
    b = b.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("len"))))
    b = b.withColumn("win", F.slice("t", F.col("q") + 1, F.col("len"))).withColumn("raw", F.slice("raw", F.col("q") + 1, F.col("len")))
    lit = F.size(F.filter("win", lambda t: ~t.isin(NUM, NAME, UNIT)))
    template = F.when(lit >= F.least(F.lit(literals), F.col("len")), F.struct(F.col("win"), F.lit(False).alias("verbatim")))
    same = F.when(template.isNull() | (F.col("win") != F.col("raw")), F.struct(F.col("raw").alias("win"), F.lit(True).alias("verbatim")))
    kinds = F.explode(F.filter(F.array(template, same), lambda x: x.isNotNull()))
    return b.select("item", "item_id", "n_tokens", "len", "q", "raw", kinds.alias("kind")).select("item", "item_id", "n_tokens", "len", "q", "raw", "kind.win", "kind.verbatim")


def leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW, literals: int = LITERALS, cover: float = COVER, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, sha (of the text), item_id, n_windows, covered, coverage, exact_slots of every row of docs that leaks an item."""
    wins = item_windows(bench, window, literals)
    hashed = F.lit(None).cast("long")
    for n in range(1, window + 1):
        hashed = F.when(F.col("len") == n, F.xxhash64(*[F.element_at("win", k + 1) for k in range(n)])).otherwise(hashed)
    wins = durable(wins.withColumn("hash", hashed))
    sizes = {r[0]: r[1] for r in wins.groupBy("len").count().collect()}  # at most `window` rows
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("sha"), text.alias("text"))
    toks = base.withColumn("clean", spaced(F.col("text"))).select("doc_id", "sha", tokens(templated(F.col("clean"))).alias("t"), tokens(F.lower("clean")).alias("raw"))
    # one pass tells both hashes of a window; most are the same, so few windows are two rows
    with_len = lambda n: F.transform(both_windows(F.col("t"), F.col("raw"), n), lambda w: F.struct(w["p"], w["hash"], w["raw_hash"], F.lit(n).alias("len")))
    lens = sorted(sizes) or [window]
    placed = with_len(lens[0]) if len(lens) == 1 else F.concat(*map(with_len, lens))
    hashes = F.when(F.col("raw_hash") != F.col("hash"), F.array("hash", "raw_hash")).otherwise(F.array("hash"))
    seen = toks.select("doc_id", "sha", F.inline(placed)).select("doc_id", "sha", "p", "len", F.explode(hashes).alias("hash"))
    blocks = max(1, -(-sum(sizes.values()) // block_rows))
    found = None
    for k in range(blocks):
        part = wins.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k).select("hash", "len").distinct()
        hit = seen.join(F.broadcast(part), ["hash", "len"], "left_semi").select("doc_id", "sha", "p", "hash", "len")
        found = hit if found is None else found.unionByName(hit)
    found = durable(found)
    # documents with a hit, again, for the tokens and the values in their slots
    at = found.groupBy(F.col("doc_id").alias("_d"), F.col("sha").alias("_s")).agg(F.collect_set(F.struct("p", "hash", "len")).alias("at"))  # of one document's windows
    key = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sha") == F.col("_s"))
    clean = spaced(F.col("text"))
    again = base.join(found.select(F.col("doc_id").alias("_d"), F.col("sha").alias("_s")).distinct(), key, "left_semi").distinct().select("doc_id", "sha", tokens(templated(clean)).alias("t"), tokens(F.lower(clean)).alias("raw"))
    slots = again.join(at, key).select("doc_id", "sha", F.explode("at").alias("w"), "t", "raw")
    cut = lambda c: F.slice(c, F.col("w.p") + 1, F.col("w.len"))
    slots = slots.select("doc_id", "sha", F.col("w.p").alias("p"), F.col("w.hash").alias("hash"), F.col("w.len").alias("len"), cut("t").alias("doc_t"), cut("raw").alias("doc_raw"))
    met = slots.join(wins, ["hash", "len"]).where((F.col("win") == F.col("doc_raw")) | (~F.col("verbatim") & (F.col("win") == F.col("doc_t"))))
    pair = F.transform(F.arrays_zip("win", "raw", "doc_raw"), lambda x: F.when(x["win"].isin(NUM, NAME, UNIT), F.struct(F.concat(x["win"], x["raw"]).alias("i"), x["doc_raw"].alias("d"))))
    slots = F.when(F.col("verbatim"), F.array().cast("array<struct<i:string,d:string>>")).otherwise(F.filter(pair, lambda x: x.isNotNull()))
    doc = ("doc_id", "sha", "item", "item_id", "n_tokens")
    met = met.select(*doc, "q", "len", "verbatim", (F.col("p") - F.col("q")).alias("shift"), slots.alias("slots"))
    lines = met.groupBy(*doc, "len", "shift").agg(
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
        F.collect_set(F.when(F.col("verbatim"), F.col("q"))).alias("same_q"), F.collect_set(F.when(~F.col("verbatim"), F.col("q"))).alias("slot_q"))
    # windows met word for word count whatever the other windows' slots are
    ok = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    same = ~ok | F.forall("slots", lambda s: F.substring(s["i"], 4, 1 << 30) == s["d"])
    lines = lines.withColumn("q", F.when(ok, F.array_union("same_q", "slot_q")).otherwise(F.col("same_q")))
    places = F.flatten(F.transform("q", lambda q: F.sequence(q, q + F.col("len") - 1)))
    out = lines.where(F.size("q") > 0).select(*doc, F.size("q").alias("n"), places.alias("places"), same.alias("same")).groupBy(*doc).agg(
        F.sum("n").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.bool_and("same").alias("exact_slots"))
    out = out.withColumn("coverage", F.col("covered") / F.col("n_tokens")).where(F.col("coverage") >= cover)
    return out.select("doc_id", "sha", "item_id", "n_windows", "covered", "coverage", "exact_slots")


def decontaminate(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_windows, covered, coverage, exact_slots of every leak; options as of leaks()."""
    most = F.max(F.struct("coverage", "n_windows", "covered", "exact_slots")).alias("m")
    return leaks(docs, bench, **how).groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", "m.n_windows", "m.covered", "m.coverage", "m.exact_slots")


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, columns as they are."""
    key, sha = fresh(docs, "leak", "sha")
    bad = checked_broadcast(leaks(docs, bench).select(F.col("doc_id").alias(key), F.col("sha").alias(sha)).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[key]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad[sha]), "left_anti")


def op1_template_decontam(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
