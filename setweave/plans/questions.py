"""Question generation, declaratively: items of a category stand in an md5 order, and slot k of a set
takes the item `offset + k` places on, skipping excluded items; more places are looked at for the sets
that need them, so a slot stays empty only if the category is too small.

Negative sets keep a set's length and categories. One that equals a positive set or another negative
is made again from another start until none is left, or ROUNDS times; a set that still collides is not
complete (the SQL writes SQL_ROUNDS rounds out). Fill-in-the-blank questions hide one item and add three of its category, none of which
completes a positive set. A category is p_brand. Everything is an equi-join on (category, place). A
seed gives other pools, starts and blanks over the same items. A set is one row; what is looked up by place is a few
numbers a row, so that little is moved, and many sets are taken a slice at a time. Sets are compared by 128 bits of hash.

Questions by class hold items of one class (here: equal vectors) for the same thing: no distractor has the
class of an own item or of another distractor, and none completes a positive set class for class. The right
answers' slots go round by the questions' numbers.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import draw, draw_sql
from ..sources.tables import SET_ITEMS, table
from ..storage import before, durable, ranges, scratch

ROUNDS, SQL_ROUNDS, DISTRACTORS = 100, 6, 3
#: Rows that are looked up by place at a time.
AT_A_TIME = 20_000_000
#: Most places a question looks at in a stretch of its category; beyond, places are looked up one by one. Places that begin a stretch.
NEAR, STRETCH = 64, 16


def pool_of(items: DataFrame) -> DataFrame:
    """items (seed, cat, candidate, ...) with place, its number from 0 in the md5 order of its category under the seed, and size, the category's; durable."""
    by, order = ["seed", "cat"], [draw(F.concat(F.lit("pool"), F.col("seed")), F.col("candidate")), F.col("candidate")]
    p = before(ranges(items, by, *order), by, order, {"place": ("sum", F.lit(1).cast("long"))}).drop("_part")
    return durable(p.join(items.groupBy(*by).agg(F.count("*").alias("size")), by))


def _pool(spark, sf, seed="") -> DataFrame:
    """(cat, place, candidate, size): the items of a category in md5 order."""
    items = table(spark, sf, "part").select(F.lit(str(seed)).alias("seed"), F.col("p_brand").alias("cat"), F.col("p_partkey").alias("candidate"))
    return pool_of(items).drop("seed")


def _pool_sql(seed="") -> str:
    return f"""{SET_ITEMS}, pool AS (SELECT p_brand AS cat, p_partkey AS candidate, row_number() OVER (PARTITION BY p_brand ORDER BY {draw_sql(f"pool{seed}", "p_partkey")}, p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS size FROM part),
n AS (SELECT set_id FROM si GROUP BY set_id HAVING count(*) >= 2), x AS (SELECT set_id, item_id, p_brand AS cat FROM si JOIN n USING (set_id) JOIN part ON item_id = p_partkey),
pos AS (SELECT set_id, list_sort(list(item_id)) AS v FROM x GROUP BY set_id)"""


def _sets(spark, sf, parts: DataFrame | None = None) -> DataFrame:
    """(set_id, items: array of (item_id, cat, cls)) of sets of two or more items, without those that are no part; parts (item_id, cat, cls)."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("cat"), F.col("p_partkey").alias("cls")) if parts is None else parts
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("item_id"))
    x = lines.join(parts.withColumn("held", F.lit(True)), "item_id", "left")
    s = x.groupBy("set_id").agg(F.collect_set(F.struct("item_id", "cat", "cls", "held")).alias("items")).where(F.size("items") >= 2)  # sets are of bounded size
    held = F.transform(F.filter("items", lambda i: i["held"]), lambda i: F.struct(i["item_id"].alias("item_id"), i["cat"].alias("cat"), i["cls"].alias("cls")))
    return s.select("set_id", F.array_sort(held).alias("items")).where(F.size("items") > 0)


def _of(items, field: str):
    """One field of an array of items."""
    return F.transform(items, lambda i: i[field])


def _hashes(v) -> list:
    """h1, h2: 128 bits of hash of an array."""
    return [F.xxhash64(F.lit(n), v).alias(f"h{n}") for n in (1, 2)]


def cuts(rows: int, key: list[str]) -> list:
    """Conditions that deal rows by hash of their key to as many parts as AT_A_TIME asks for; none without rows."""
    n = -(-rows // AT_A_TIME)
    return [F.pmod(F.xxhash64(F.lit("slice"), *key), F.lit(n)) == k for k in range(n)]


def slices(rows: DataFrame, each: int, key: list[str]) -> list[DataFrame]:
    """rows (stored) in parts, of which each row makes `each` rows."""
    return [rows.where(c) for c in cuts(rows.count() * each, key)]


def _fill_sql(slots: str, excluded: str, want: int, start: str, tag: str = "") -> str:
    return f"""e{tag} AS (SELECT s.set_id, s.cat, s.n, t, ({draw_sql(start, "s.set_id", "s.cat")} + t) % z.size AS place FROM {slots} s JOIN (SELECT cat, max(size) AS size FROM pool GROUP BY cat) z USING (cat), LATERAL (SELECT unnest(range(CAST(least(s.n * {want} + s.skip, z.size) AS BIGINT))) AS t)),
f{tag} AS (SELECT e{tag}.*, candidate FROM e{tag} JOIN pool USING (cat, place) WHERE NOT EXISTS (SELECT 1 FROM {excluded} o WHERE o.set_id = e{tag}.set_id AND o.candidate = pool.candidate)),
g{tag} AS (SELECT *, row_number() OVER (PARTITION BY set_id, cat ORDER BY t) AS k FROM f{tag}), got{tag} AS (SELECT * FROM g{tag} WHERE k <= n * {want})"""


def cp_negatives(spark, sf, store=durable) -> DataFrame:
    """set_id, n_items, negative (sorted items joined by commas), complete (all slots filled, no positive, no other's negative); stored by `store`, durable() or that of a scratch()."""
    with scratch(spark) as keep:
        return _negatives(keep(_sets(spark, sf)), keep(_pool(spark, sf)), "", keep, store)


def negatives_of(x: DataFrame, pool: DataFrame, seed="", store=durable) -> DataFrame:
    """cp_negatives() of sets x (set_id, item_id, cat) over a pool (cat, place, candidate, size); stored by `store`."""
    with scratch(x.sparkSession) as keep:
        s = x.groupBy("set_id").agg(F.collect_set(F.struct("item_id", "cat")).alias("items"))
        return _negatives(keep(s), pool, seed, keep, store)


def _negatives(s: DataFrame, pool: DataFrame, seed, keep, store=durable) -> DataFrame:
    """cp_negatives() of sets s (set_id, items) that are kept; stored."""
    longest = s.agg(F.max(F.size("items"))).first()[0] or 0
    known = keep(s.select(*_hashes(F.array_sort(_of("items", "item_id")))).distinct())  # positives, then what is taken as well
    todo, held = s, []
    for nth in range(ROUNDS):
        got = []
        for part in slices(todo, longest, ["set_id"]):
            got.append(keep(_drawn(part, pool, f"start{seed}{nth or ''}", False)))
            short = got[-1].where("not full").select("set_id")
            if not short.isEmpty():  # own items stood in the way
                got.append(keep(_drawn(part.join(short, "set_id", "left_semi"), pool, f"start{seed}{nth or ''}", True)))
                got[-2] = got[-2].where("full")
        if not got:
            break
        got = _union(got)
        keys = got.where("full").select("set_id", "h1", "h2")
        first = keys.groupBy("h1", "h2").agg(F.min("set_id").alias("first"), F.count("*").alias("n")).select("h1", "h2", F.when(F.col("n") > 1, F.col("first")).alias("first"))
        hit = first.join(known.withColumn("hit", F.lit(True)), ["h1", "h2"], "left").where("hit or first is not null")  # few
        again = keep(keys.join(hit, ["h1", "h2"]).where("hit or set_id <> first").select("set_id"))
        last = got.join(again, "set_id", "left_anti")
        held.append(last.withColumn("complete", F.col("full")))
        known = known.unionByName(last.where("full").select("h1", "h2"))
        todo = keep(s.join(again, "set_id", "left_semi"))
    else:
        held.append(got.join(again, "set_id", "left_semi").withColumn("complete", F.lit(False)))
    empty = s.select("set_id", F.lit(0).cast("long").alias("n_items"), F.lit("").alias("negative"), F.lit(False).alias("complete")).limit(0)
    out = [h.select("set_id", "n_items", F.when(F.size("v") > 0, F.array_join("v", ",")).alias("negative"), "complete") for h in held]
    return store(_union(out) if out else empty)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _drawn(s: DataFrame, pool: DataFrame, start: str, more: bool) -> DataFrame:
    """set_id, n_items, v (sorted candidates, as many of each category as the set has), full, h1, h2; looks at as many places as there are slots, or at twice as many."""
    of = lambda k: F.size(F.filter(_of("items", "cat"), lambda c: c == k)).cast("long")
    e = s.select("set_id", F.explode(F.transform(F.array_distinct(_of("items", "cat")), lambda k: F.struct(k.alias("cat"), of(k).alias("n")))).alias("k")).select("set_id", "k.cat", "k.n")
    e = e.join(F.broadcast(pool.groupBy("cat").agg(F.max("size").alias("size"))), "cat")  # a row a category
    e = e.select("set_id", "cat", "size", draw(start, F.col("set_id"), F.col("cat")).alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n") * (2 if more else 1), F.col("size")) - 1)).alias("t"))
    e = e.select("set_id", "cat", "t", ((F.col("start") + F.col("t")) % F.col("size")).alias("place"))
    c = e.join(pool.select("cat", "place", "candidate"), ["cat", "place"]).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("t", "candidate", "cat"))).alias("c"))
    j = s.join(c, "set_id", "left").withColumn("own", _of("items", "item_id"))
    free = lambda k: F.filter("c", lambda x: (x["cat"] == k) & ~F.array_contains("own", x["candidate"]))
    v = F.flatten(F.transform(F.array_distinct(_of("items", "cat")), lambda k: F.slice(_of(free(k), "candidate"), F.lit(1), of(k).cast("int"))))
    j = j.select("set_id", F.size("items").cast("long").alias("n_items"), F.when(F.col("c").isNotNull(), F.array_sort(v)).alias("v"))
    return j.withColumn("full", F.coalesce(F.size("v") == F.col("n_items"), F.lit(False))).select("*", *_hashes(F.col("v")))


def _round_sql(nth: int) -> str:
    todo = "SELECT set_id FROM n" if nth == 0 else f"SELECT set_id FROM a{nth - 1} WHERE full_ AND NOT complete"
    taken = " UNION ALL ".join(["SELECT array_to_string(v, ',') AS negative FROM pos", *(f"SELECT negative FROM a{k} WHERE complete" for k in range(nth))])
    return f"""todo{nth} AS ({todo}), slots{nth} AS (SELECT set_id, cat, count(*) AS n, count(*) AS skip FROM x WHERE set_id IN (SELECT set_id FROM todo{nth}) GROUP BY ALL),
{_fill_sql(f"slots{nth}", "own", 1, f"start{nth or ''}", str(nth))}, v{nth} AS (SELECT set_id, list_sort(list(candidate)) AS v FROM got{nth} GROUP BY set_id),
b{nth} AS (SELECT set_id, array_to_string(v{nth}.v, ',') AS negative, coalesce(len(v{nth}.v) = len(pos.v), FALSE) AS full_ FROM todo{nth} JOIN pos USING (set_id) LEFT JOIN v{nth} USING (set_id)),
a{nth} AS (SELECT set_id, negative, full_, coalesce(full_ AND negative NOT IN ({taken}) AND set_id = min(CASE WHEN full_ THEN set_id END) OVER (PARTITION BY negative), FALSE) AS complete FROM b{nth})"""


NEGATIVES_SQL = f"""WITH {_pool_sql()}, own AS (SELECT set_id, item_id AS candidate FROM x), {", ".join(map(_round_sql, range(SQL_ROUNDS)))},
held AS ({" UNION ALL ".join(f"SELECT set_id, negative, complete FROM a{k}" + (" WHERE complete OR NOT full_" if k < SQL_ROUNDS - 1 else "") for k in range(SQL_ROUNDS))})
SELECT set_id, len(v) AS n_items, negative, complete FROM pos JOIN held USING (set_id)"""


def fitb_questions(spark, sf, *seeds, store=durable) -> DataFrame:
    """set_id, question (the other items), blank, candidates (4, the right one at correct_index), correct_index = set_id mod 4; under several seeds, one after another, with seed; stored by `store`."""
    slot, parts = F.pmod("set_id", F.lit(4)).cast("int"), table(spark, sf, "part")
    with scratch(spark) as keep:
        s, out = keep(_sets(spark, sf)), []
        for seed in seeds or ("",):
            items = parts.select(F.lit(str(seed)).alias("seed"), F.col("p_brand").alias("cat"), F.col("p_partkey").alias("candidate"), F.col("p_partkey").alias("cls"))
            out.append(_asked(s.withColumn("seed", F.lit(str(seed))), keep(pool_of(items)), slot, store))
        return _union(out) if len(out) > 1 else out[0].drop("seed")


def fitb_each(spark, sf, seeds, told: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`told` of the questions under each seed (as fitb_questions(), with seed), a few rows each; a seed's questions go before those of the next are made."""
    slot, parts = F.pmod("set_id", F.lit(4)).cast("int"), table(spark, sf, "part")
    with scratch(spark) as keep:
        s, out = keep(_sets(spark, sf)), []
        for seed in seeds:
            items = parts.select(F.lit(str(seed)).alias("seed"), F.col("p_brand").alias("cat"), F.col("p_partkey").alias("candidate"), F.col("p_partkey").alias("cls"))
            with scratch(spark) as own:
                out.append(durable(told(_asked(s.withColumn("seed", F.lit(str(seed))), own(pool_of(items)), slot, own))))
        return _union(out)


def questions_of(x: DataFrame, pool: DataFrame, slot=None, store=durable) -> DataFrame:
    """seed, set_id, question, blank, candidates, correct_index of sets x (seed, set_id, item_id, cat, cls) over a pool (seed, cat, place, candidate, cls, size).

    correct_index is `slot`, or the question's number in md5 order mod 4. Items of one class stand for the same thing.
    """
    with scratch(x.sparkSession) as keep:
        return _asked(keep(x.groupBy("seed", "set_id").agg(F.array_sort(F.collect_set(F.struct("item_id", "cat", "cls"))).alias("items"))), pool, slot, store)


def _asked(s: DataFrame, pool: DataFrame, slot=None, store=durable) -> DataFrame:
    """questions_of() of sets s (seed, set_id, items) that are kept; stored.

    The first places of a category are looked at, then four times as many for the questions that lack distractors.
    """
    key, of = ["seed", "set_id"], lambda name: F.concat(F.lit(name), F.col("seed"))
    with scratch(s.sparkSession) as keep:
        order = lambda i: F.struct(draw(of("blank"), F.col("set_id"), i["item_id"]).alias("at"), i["item_id"].alias("item_id"), i.alias("item"))
        two = s.where(F.size(F.array_distinct("items")) > 1)  # asked of `rest`, Spark would draw every item's number once an item
        q = two.withColumn("b", F.array_min(F.transform("items", order))["item"]).withColumn("rest", F.filter("items", lambda i: i != F.col("b")))
        # what would complete a positive set makes its classes one
        whole = keep(s.select("seed", *_hashes(F.array_sort(_of("items", "cls")))).distinct())
        size = F.broadcast(pool.groupBy("seed", "cat").agg(F.max("size").alias("size")))  # a row a category
        q = q.select(*key, F.col("b.item_id").alias("blank"), F.col("b.cat").alias("cat"), F.array_join(F.array_sort(_of("rest", "item_id")), ",").alias("question"), _of("items", "cls").alias("own"), _of("rest", "cls").alias("rest"))
        q = keep(q.join(size, ["seed", "cat"]).withColumn("start", draw(of("start"), F.col("set_id"), F.col("cat"))))
        done, todo, window = [], q, DISTRACTORS + 1
        while True:
            parts, again = slices(todo, 2 * window, key), []
            if not parts:
                break
            look, places = (_near, keep(_stretches(pool, window))) if window <= NEAR else (_distractors, pool)
            for part in parts:
                with scratch(s.sparkSession) as own:
                    got = look(part, places, whole, window, own)
                    done.append(keep(got.where(F.size("d") == DISTRACTORS).select(*key, "blank", "question", "d")))
                    again.append(keep(got.where((F.size("d") < DISTRACTORS) & (F.col("size") > window)).select(*q.columns)))
            todo = _union(again)
            window *= 4
        if not done:
            return store(s.select(*key, F.lit("").alias("question"), F.col("items")[0]["item_id"].alias("blank"), F.lit("").alias("candidates"), F.lit(0).alias("correct_index")).limit(0))
        q = _union(done)
        if slot is None:
            at = [draw(of("order"), F.col("set_id")), F.col("set_id")]
            nth = before(ranges(s.select(*key), ["seed"], *at), ["seed"], at, {"nth": ("sum", F.lit(1).cast("long"))})
            q = q.join(nth.select(*key, F.pmod("nth", F.lit(4)).cast("int").alias("correct_index")), key)
        else:
            q = q.withColumn("correct_index", slot)
        c = F.concat(F.slice("d", F.lit(1), F.col("correct_index")), F.array("blank"), F.slice("d", F.col("correct_index") + 1, F.lit(DISTRACTORS) - F.col("correct_index")))
        return store(q.select(*key, "question", "blank", F.array_join(c, ",").alias("candidates"), "correct_index"))


def _stretches(pool: DataFrame, window: int) -> DataFrame:
    """seed, cat, stretch, places: a pool in stretches of STRETCH places, each with the window - 1 places after it (the first follow the last), as (candidate, cls) in order."""
    reach, size = STRETCH + window - 2, F.col("size")  # a question looks at fewer places if its category has fewer
    turns = pool.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((reach + size - 1) / size).cast("long"))))
    s = turns.withColumn("at", F.col("place") + F.col("turn") * size)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("at") - reach) / STRETCH)).cast("long"), F.least(F.ceil(size / STRETCH) - 1, F.floor(F.col("at") / STRETCH)).cast("long")
    s = s.withColumns({"first": first, "last": last}).where("first <= last").withColumn("stretch", F.explode(F.sequence("first", "last")))
    at = (F.col("at") - F.col("stretch") * STRETCH).alias("at")
    s = s.groupBy("seed", "cat", "stretch").agg(F.array_sort(F.collect_list(F.struct(at, "candidate", "cls"))).alias("places"))  # of bounded size
    return s.select("seed", "cat", "stretch", F.transform("places", lambda p: F.struct(p["candidate"].alias("candidate"), p["cls"].alias("cls"))).alias("places"))


def _near(q: DataFrame, stretches: DataFrame, whole: DataFrame, window: int, keep) -> DataFrame:
    """_distractors() in few places: a question meets its stretch of the category at once, and its candidates leave it only to be held against positive sets."""
    key, at = ["seed", "set_id"], F.col("start") % F.col("size")
    s = q.withColumn("stretch", F.floor(at / STRETCH).cast("long")).join(stretches, ["seed", "cat", "stretch"])
    s = s.withColumn("places", F.slice("places", (at % STRETCH + 1).cast("int"), F.least(F.lit(window).cast("long"), F.col("size")).cast("int")))
    s = keep(s.select(*q.columns, F.filter("places", lambda p: ~F.array_contains("own", p["cls"])).alias("free")))
    one = s.select(*key, "rest", F.explode(F.array_distinct(_of("free", "cls"))).alias("cls"))
    one = one.select(*key, "cls", *_hashes(F.array_sort(F.array_append("rest", F.col("cls")))))
    hit = keep(one.join(whole, ["seed", "h1", "h2"], "left_semi").groupBy(*key).agg(F.collect_set("cls").alias("hit")))  # few
    free = F.filter("free", lambda p: ~F.coalesce(F.array_contains("hit", p["cls"]), F.lit(False)))
    s = s.join(hit, key, "left").withColumn("free", free)
    first = F.filter("free", lambda p, k: F.array_position(_of("free", "cls"), p["cls"]) == k + 1)  # the first of a class
    return s.select(*q.columns, _of(F.slice(first, 1, DISTRACTORS), "candidate").alias("d"))


def _distractors(q: DataFrame, pool: DataFrame, whole: DataFrame, window: int, keep) -> DataFrame:
    """Questions q with d, their first distractors in so many places; whole: hashes of positive sets."""
    key = ["seed", "set_id"]
    s = q.select(*key, "cat", "start", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(window).cast("long"), F.col("size")) - 1)).alias("t"))
    s = s.select(*key, "cat", "t", ((F.col("start") + F.col("t")) % F.col("size")).alias("place"))
    s = s.join(pool.select("seed", "cat", "place", "candidate", "cls"), ["seed", "cat", "place"]).select(*key, "t", "candidate", "cls")
    s = s.join(q.select(*key, "own", "rest"), key).where(~F.array_contains("own", F.col("cls")))
    s = s.select(*key, "t", "candidate", "cls", *_hashes(F.array_sort(F.array_append("rest", F.col("cls"))))).join(whole, ["seed", "h1", "h2"], "left_anti")
    s = s.repartition(*key).groupBy(*key, "cls").agg(F.min(F.struct("t", "candidate")).alias("c"))  # the first of a class
    got = keep(s.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list("c")), 1, DISTRACTORS).alias("d")).select(*key, _of("d", "candidate").alias("d")))
    return q.join(got, key, "left").withColumn("d", F.coalesce("d", F.array().cast(dict(got.dtypes)["d"])))


def fitb_sql(seed="") -> str:
    return f"""WITH {_pool_sql(seed)}, r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {draw_sql(f"blank{seed}", "set_id", "item_id")}, item_id) AS rn FROM x),
blank AS (SELECT set_id, item_id AS blank, cat FROM r WHERE rn = 1), rest AS (SELECT set_id, array_to_string(list_sort(list(item_id)), ',') AS question FROM r WHERE rn > 1 GROUP BY set_id),
less0 AS (SELECT v, unnest(v) AS candidate FROM pos), less1 AS (SELECT DISTINCT array_to_string(list_filter(v, lambda i: i <> candidate), ',') AS question, candidate FROM less0),
own AS (SELECT set_id, item_id AS candidate FROM x UNION SELECT set_id, candidate FROM rest JOIN less1 USING (question)),
slots AS (SELECT blank.set_id, blank.cat, 1 AS n, count(*) AS skip FROM blank JOIN own USING (set_id) JOIN pool ON pool.candidate = own.candidate AND pool.cat = blank.cat GROUP BY ALL),
{_fill_sql("slots", "own", DISTRACTORS, f"start{seed}")}, v AS (SELECT set_id, list(candidate ORDER BY k) AS d FROM got GROUP BY set_id HAVING count(*) = {DISTRACTORS})
SELECT set_id, question, blank, array_to_string(list_concat(list_concat(d[1:CAST(set_id % 4 AS BIGINT)], [blank]), d[CAST(set_id % 4 AS BIGINT) + 1:]), ',') AS candidates, CAST(set_id % 4 AS INTEGER) AS correct_index
FROM blank JOIN rest USING (set_id) JOIN v USING (set_id)"""


FITB_SQL = fitb_sql()


def item_classes(spark, sf) -> DataFrame:
    """(item_id, cls): parts that share a vector are one class."""
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")).crossJoin(F.broadcast(n)).select("item_id", (F.col("item_id") % F.col("n")).alias("cls"))  # n is one row


def class_questions(spark, sf, seed="class", store=durable) -> DataFrame:
    """set_id, question, blank, candidates, correct_index, as fitb_questions but by class; correct_index is the question's number mod 4; stored by `store`."""
    with scratch(spark) as keep:
        parts = keep(item_classes(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("cat")), "item_id"))
        pool = keep(pool_of(parts.select(F.lit(seed).alias("seed"), "cat", F.col("item_id").alias("candidate"), "cls")))
        return _asked(keep(_sets(spark, sf, parts)).withColumn("seed", F.lit(seed)), pool, store=store).drop("seed")


CLASS_SQL = f"""WITH {_pool_sql("class")}, k AS (SELECT p_partkey AS item_id, p_partkey % (SELECT count(*) FROM embeddings) AS cls FROM part), xc AS (SELECT x.*, cls FROM x JOIN k USING (item_id)),
pc AS (SELECT pool.*, cls FROM pool JOIN k ON candidate = item_id), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {draw_sql("blankclass", "set_id", "item_id")}, item_id) AS rn FROM xc),
blank AS (SELECT set_id, item_id AS blank, cat, CAST((row_number() OVER (ORDER BY {draw_sql("orderclass", "set_id")}, set_id) - 1) % 4 AS INTEGER) AS slot FROM r WHERE rn = 1),
rest AS (SELECT set_id, array_to_string(list_sort(list(item_id)), ',') AS question, list_sort(list(cls)) AS rest FROM r WHERE rn > 1 GROUP BY set_id),
v AS (SELECT set_id, list_sort(list(cls)) AS v FROM xc GROUP BY set_id), less AS (SELECT DISTINCT list_concat(v[1:CAST(i - 1 AS BIGINT)], v[CAST(i + 1 AS BIGINT):]) AS rest, v[i] AS cls FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM v)),
o AS (SELECT set_id, cls FROM xc UNION SELECT set_id, less.cls FROM rest JOIN less USING (rest)), h AS (SELECT cat, cls, count(*) AS m FROM pc GROUP BY ALL), z AS (SELECT cat, sum(m) AS size, max(m) AS most FROM h GROUP BY cat),
s AS (SELECT blank.set_id, blank.cat, sum(m) AS skip FROM blank JOIN o USING (set_id) JOIN h ON h.cat = blank.cat AND h.cls = o.cls GROUP BY ALL),
e AS (SELECT set_id, cat, t, ({draw_sql("startclass", "set_id", "cat")} + t) % CAST(size AS BIGINT) AS place FROM s JOIN z USING (cat), LATERAL (SELECT unnest(range(CAST(least({DISTRACTORS} * most + skip, size) AS BIGINT))) AS t)),
f AS (SELECT e.set_id, cls, min(t) AS t, arg_min(candidate, t) AS candidate FROM e JOIN pc USING (cat, place) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.set_id = e.set_id AND o.cls = pc.cls) GROUP BY ALL),
g AS (SELECT set_id, (list(candidate ORDER BY t))[1:{DISTRACTORS}] AS d FROM f GROUP BY set_id HAVING count(*) >= {DISTRACTORS})
SELECT set_id, question, blank, array_to_string(list_concat(list_concat(d[1:slot], [blank]), d[slot + 1:]), ',') AS candidates, slot AS correct_index FROM blank JOIN rest USING (set_id) JOIN g USING (set_id)"""
