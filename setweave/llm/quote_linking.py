"""Operator 6, chat formatting by quotation linking.

A line's quote level is its number of leading ">" (spaces between allowed). Lines of level 0 are
a message's own text. A passage is a run of lines of one level; its key is the hash of its words
in lower case; one without letters and digits has none. Own texts are indexed by the key of every
line, every paragraph and the whole; quoted passages of every level, their paragraphs and lines,
joined to the index within the conversation, name the original message: the earliest one before
the quoting message that holds them. A message replies to the original of most matching passages
and lines of the lowest level that has a match, the latest on ties; without a match it has no
parent. A conversation's messages are put in reply order: a message is followed by its replies, in
the order of their turns, each followed by its own; messages without a parent are in the order of
turns. `place` numbers them from 0, and text_own is their text without quotes.

The index has one row a (conversation, key), so a line that many messages share joins once. Turns
and siblings are numbered over ranges, and places are ranks in a linked list (the walk around the
reply trees) by pointer doubling, in rounds of the logarithm of the longest conversation, so that
no task needs a whole conversation or all replies to a message.

Defined results: null text is empty; null conv_id is a conversation of its own, null turn is
first; messages of equal (conv_id, turn) are ordered by role, then text, share parents, and the
first of them has the replies; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, numbered

QUOTE = "^[ \\t]*(?:>[ \\t]*)+"
PARAGRAPH = "\\n\\s*\\n"


def level(line):
    head = F.regexp_extract(line, QUOTE, 0)
    return F.length(head) - F.length(F.translate(head, ">", ""))


def normal(text):
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def parsed(chat: DataFrame) -> DataFrame:
    """conv_id, turn, role, row, own (text without quotes), max_level, keys of own parts, (level, key) of quoted parts."""
    c = chat.select("conv_id", "turn", "role", "row", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\\r?\\n"), lambda x: F.struct(level(x).alias("lv"), F.regexp_replace(x, QUOTE, "").alias("s")))
    c = c.withColumn("lines", lines)
    own = F.filter("lines", lambda x: x["lv"] == 0)
    c = c.withColumn("own", F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["s"]), "\n"), "\\n{3,}", "\n\n")))
    quoted = F.filter("lines", lambda x: x["lv"] == 1)
    parts = F.concat(F.array("own"), F.split("own", PARAGRAPH), F.split("own", "\\n"))

    def keys(texts):
        good = F.filter(F.transform(texts, normal), lambda t: t != "")
        return F.array_distinct(F.transform(good, lambda t: F.sha2(t, 256)))

    def passages(lv):
        """Runs of lines of this level (anything else ends a run), their paragraphs and lines."""
        run = F.array_join(F.transform("lines", lambda x: F.when(x["lv"] == lv, x["s"]).otherwise(F.lit("\u0000"))), "\n")
        runs = F.split(run, "\u0000")
        lines = F.transform(F.filter("lines", lambda x: x["lv"] == lv), lambda x: x["s"])
        return F.concat(runs, F.flatten(F.transform(runs, lambda p: F.split(p, PARAGRAPH))), lines)

    levels = F.array_distinct(F.filter(F.transform("lines", lambda x: x["lv"]), lambda v: v > 0))
    quote_keys = F.flatten(F.transform(levels, lambda lv: F.transform(keys(passages(lv)), lambda k: F.struct(lv.alias("lv"), k.alias("key")))))
    return c.select("conv_id", "turn", "role", "row", "own", F.coalesce(F.array_max(F.transform("lines", lambda x: x["lv"])), F.lit(0)).alias("max_level"),
                    F.size(quoted).alias("n_quoted"), keys(parts).alias("own_keys"), quote_keys.alias("quote_keys"))


def reply_places(tree: DataFrame) -> DataFrame:
    """(row, place) from (row, first: its conversation's first row, parent: a row or null): places in reply order."""
    group = F.coalesce("parent", -1 - F.col("first"))  # messages without a parent are siblings
    kin = numbered(tree.select("row", "first", "parent", group.alias("of")), "nth", F.col("of"), F.col("row"))
    after = kin.select((F.col("nth") - 1).alias("nth"), F.col("of").alias("of"), F.col("row").alias("sibling"))
    child = kin.where("parent is not null").groupBy(F.col("parent").alias("row")).agg(F.min("row").alias("child"))
    kin = kin.join(after, ["nth", "of"], "left").join(child, "row", "left")
    # the walk enters a message (2 row) and leaves it (2 row + 1)
    enter, leave = 2 * F.col("row"), 2 * F.col("row") + 1
    steps = F.array(
        F.struct(enter.alias("at"), F.coalesce(2 * F.col("child"), leave).alias("to"), F.lit(1).cast("long").alias("n")),
        F.struct(leave.alias("at"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("to"), F.lit(0).cast("long").alias("n")))
    walk = durable(kin.select(F.inline(steps)))
    done = walk.where("to is null")
    walk = walk.where("to is not null")
    while not walk.isEmpty():  # n: messages entered from `at` up to, not including, `to`; each round doubles the stretch
        ahead = walk.unionByName(done).select(F.col("at").alias("to"), F.col("to").alias("next"), F.col("n").alias("more"))
        new = durable(walk.join(ahead, "to").select("at", F.col("next").alias("to"), (F.col("n") + F.col("more")).alias("n")))
        done, walk = durable(done.unionByName(new.where("to is null"))), new.where("to is not null")
    size = tree.groupBy("first").agg(F.count("*").alias("size"))
    left = done.where("at % 2 = 0").select((F.col("at") / 2).cast("long").alias("row"), "n")
    return tree.select("row", "first").join(left, "row").join(size, "first").select("row", (F.col("size") - F.col("n")).alias("place"))


def link_quotes(chat: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, n_links, max_level, place, text_own of every message of chat."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = durable(parsed(numbered(chat.select("conv_id", "turn", "role", "text"), "row", *order)))
    quotes = rows.where(F.size("quote_keys") > 0).select("conv_id", "turn", "row", F.inline("quote_keys"))
    wanted = quotes.select("conv_id", "key").distinct()
    index = rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.explode("own_keys").alias("k")).where(F.col("t").isNotNull())
    index = index.join(wanted, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("k") == F.col("key")), "left_semi").groupBy("c", "k").agg(F.min("t").alias("t"))
    met = quotes.join(index, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where(F.col("t") < F.col("turn"))
    votes = met.groupBy("row", "conv_id", "lv", "t").agg(F.count("*").alias("n"))
    best = votes.groupBy("row", "conv_id").agg(F.max(F.struct((-F.col("lv")).alias("nearest"), "n", "t")).alias("b")).select("row", "conv_id", F.col("b.t").alias("parent_turn"), F.col("b.n").alias("n_links"))
    best = durable(best)
    slim = rows.select("row", "conv_id", "turn", "role", "max_level", F.col("own").alias("text_own"))
    first = slim.groupBy(F.col("conv_id").alias("c")).agg(F.min("row").alias("first"))
    out = slim.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").join(best.drop("conv_id"), "row", "left")
    place = F.col("row") - F.col("first")
    if not best.isEmpty():
        held = best.select(F.col("conv_id").alias("c")).distinct()
        one = rows.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("row").alias("parent"))
        links = best.join(one, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_turn") == F.col("t"))).select("row", "parent")
        tree = out.select("row", "conv_id", "first").join(held, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").drop("conv_id").join(links, "row", "left")
        out = out.join(reply_places(durable(tree)), "row", "left")
        place = F.coalesce("place", place)
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("n_links", F.lit(0)).alias("n_links"), "max_level", place.alias("place"), "text_own")


def op6_quote_linking(spark, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
