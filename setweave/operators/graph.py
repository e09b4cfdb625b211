"""Connected components of the set-item graph, and the sequential packers (driver steps over component sizes)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import draw
from ..storage import durable


def set_components(items: DataFrame, set_id: str = "set_id", item_id: str = "item_id", max_rounds: int = 60, classes: DataFrame | None = None) -> DataFrame:
    """set_id, component (its least set_id): sets that share items, also through others; with classes (item_id, cls), items of one class are one item.

    Min-label over set -> item -> set with a pointer jump each round; both steps aggregate
    before they join, so an item of very many sets costs one row a set. Rounds are durable.
    """
    if classes is not None:
        own = classes.select(F.col("item_id").alias("_i"), F.col("cls").cast("string").alias("_c"))
        one = F.coalesce(F.concat(F.lit("c:"), "_c"), F.concat(F.lit("i:"), F.col(item_id).cast("string")))
        items = items.join(own, F.col(item_id) == F.col("_i"), "left").withColumn("_one", one)
        item_id = "_one"
    edges = durable(items.select(F.col(set_id).alias("s"), F.col(item_id).alias("i")).distinct())
    lab = edges.select("s").distinct().withColumn("c", F.col("s"))
    for _ in range(max_rounds):
        low = edges.join(lab, "s").groupBy("i").agg(F.min("c").alias("m"))
        near = edges.join(low, "i").groupBy("s").agg(F.min("m").alias("m"))
        step = lab.join(near, "s").select("s", F.col("c").alias("old"), "m")
        up = lab.select(F.col("s").alias("m"), F.col("c").alias("top"))
        new = durable(step.join(up, "m").select("s", "old", F.least("m", "top").alias("c")))
        done = new.where("old <> c").limit(1).count() == 0
        lab = new.select("s", "c")
        if done:
            return lab.select(F.col("s").alias(set_id), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: The order of splits, which settles ties.
SPLITS = ("train", "valid", "test")


def best_fit(sizes: list[tuple[str, int]], targets: dict[str, int], giant: str = "train") -> dict[str, str]:
    """component -> split by best fit: the largest to `giant`, then by falling size to the split that it leaves the least
    room in, ties by SPLITS. Targets must be filled exactly, else ValueError, as for no component. Sizes only are on the driver."""
    if not sizes:
        raise ValueError("no components")
    room, out = dict(targets), {}
    for k, (name, n) in enumerate(sorted(sizes, key=lambda x: (-x[1], x[0]))):
        fits = [s for s in SPLITS if s in room and room[s] >= n and (k or s == giant)]
        if not fits:
            raise ValueError(f"component {name} of {n} fits nowhere")
        out[name] = min(fits, key=lambda s: room[s])
        room[out[name]] -= n
    if any(room.values()):
        raise ValueError(f"targets not met: {room}")
    return out


class Packer:
    """Deals sets in the order they come: to the one split that owns any of a set's groups, if it has room; without an
    owner to the split that lacks the largest share, ties by SPLITS; sets of two owners or a full one are skipped."""

    def __init__(self, capacity: dict[str, int]):
        self.capacity, self.owner, self.used = capacity, {}, dict.fromkeys(capacity, 0)

    def deal(self, groups: list[str]) -> str | None:
        owners = {self.owner[g] for g in groups if g in self.owner}
        if len(owners) > 1:
            return None
        room = [s for s in SPLITS if self.used.get(s, 0) < self.capacity.get(s, 0) and (not owners or s in owners)]
        if not room:
            return None
        split = max(room, key=lambda s: (self.capacity[s] - self.used[s]) / self.capacity[s])  # the first of equals
        self.used[split] += 1
        self.owner.update(dict.fromkeys(groups, split))
        return split

    def close(self) -> None:
        if self.used != self.capacity:
            raise ValueError(f"capacities not met: {self.used}")


def pack_sets(items: DataFrame, capacity: dict[str, int], seed: int = 42) -> DataFrame:
    """set_id, split of the sets of items (set_id, item_id) that a Packer deals, in md5 order of set_id.

    Each step depends on all before, so one task deals a stream of slim rows, sorted by the cluster; it holds
    the groups' owners. Sets come whole (of bounded size). Raises unless all capacities are filled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity)
        for b in batches:
            splits = [packer.deal([str(g) for g in groups]) for groups in b["groups"]]
            yield pd.DataFrame({"set_id": b["set_id"], "split": splits}).dropna(subset=["split"])
        packer.close()

    sets = items.groupBy("set_id").agg(F.collect_set("item_id").alias("groups"))
    rows = sets.orderBy(draw(f"pack{seed}", F.col("set_id")), "set_id").coalesce(1)
    return rows.mapInPandas(run, f"set_id {dict(items.dtypes)['set_id']}, split string")


def assign_users(users: list[tuple[str, int]], shares: dict[str, float]) -> dict[str, str]:
    """user -> split: by falling size (ties by name) to the split it overfills least, then fills least, both by share; ties by SPLITS."""
    total, got, out = sum(n for _, n in users), dict.fromkeys(shares, 0), {}
    for name, n in sorted(users, key=lambda x: (-x[1], x[0])):
        filled = {s: (got[s] + n) / (shares[s] * total) for s in SPLITS if s in shares}
        out[name] = min(filled, key=lambda s: (max(0.0, filled[s] - 1), filled[s]))
        got[out[name]] += n
    return out


def owned_items(items: DataFrame, split_of_set: DataFrame, shares: dict[str, float], power: float = 0.5) -> DataFrame:
    """item_id, owner: the split whose sets hold an item most, counts over share ** power; ties by SPLITS."""
    n = items.join(split_of_set, "set_id").groupBy("item_id", "split").agg(F.count("*").alias("n"))
    rank, weight = (F.create_map(*[F.lit(x) for s in SPLITS for x in (s, f(s))]) for f in (SPLITS.index, lambda s: shares[s] ** power))
    best = F.min_by("split", F.struct((-F.col("n") / weight[F.col("split")]).alias("w"), rank[F.col("split")].alias("r")))
    return n.groupBy("item_id").agg(best.alias("owner"))


def pure_sets(items: DataFrame, split_of_set: DataFrame, owners: DataFrame) -> DataFrame:
    """set_id, split, pure: whether the set's split owns all of its items."""
    j = items.join(split_of_set, "set_id").join(owners, "item_id", "left")
    return j.groupBy("set_id", "split").agg(F.bool_and(F.coalesce(F.col("owner") == F.col("split"), F.lit(False))).alias("pure"))
