"""Operator 7, SimHash near-dedup by anchor-point covering.

Anchors are the words of the binary Golay code [23, 12], which covers all 23-bit words within
radius 3. Every 23-bit word has one home anchor; `probes` are all anchors within radius plus
threshold. If x and y differ in at most T bits, y probes the home of x, whatever the texts.

fingerprint_components() is the contract's operator: 64-bit fingerprints, anchors on bits 0-22
and 23-45 together (2^24 anchors, about 61 probes a fingerprint), compared per anchor by an
equi-join whose output is linear: a fingerprint has at most 64 + 2016 others within 2 bits.

near_dedup() is the pipeline's: texts are near copies at a Jaccard similarity of 0.8 or more on
sets of five-word shingles. 2 bits of 64 cannot tell that (at 0.8 some 15 % of the bits differ),
so it takes 256 bits, anchors within radius plus 1 of eight blocks of 23 bits (5.3 a block), and
compares all rows of an anchor. Two texts of similarity 0.8 share an anchor with a probability of
0.999 and differ in at most NEAR_BITS bits with one of 0.999 (0.99 for sets of five shingles);
pairs that pass are candidates, and a link is an exact intersection of two whole sets.
Comparisons within anchors are of packed bits in memory and grow with the square of the rows over
4,096; the rows that are moved, and the pairs that are tested exactly, do not.

Defined results: null and empty texts have fingerprint 0 and are linked like any other (in
near_dedup texts without words are one class of copies); repeated rows share a fingerprint, and
near_dedup keeps one of them; component_id is null only if no row of the component has a doc_id;
an empty table gives no rows; other columns are not read by the first operator and are returned
unchanged by near_dedup, whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, columns_of, components, durable, fresh, tidied
from .token_binary import pieces, split_words

# The Golay code's generator x^11+x^10+x^6+x^5+x^4+x^2+1, its length and covering radius.
GENERATOR, BITS, RADIUS = 0b110001110101, 23, 3
THRESHOLD = 2
SHINGLE = 3
#: Shingles, seed, most differing bits of 256 and excess over the radius of the pipeline's near copies.
NEAR_SHINGLE, NEAR_SEED, NEAR_BITS, NEAR_THRESHOLD = 5, 42, 64, 1
#: Rows of an anchor from which it is split; pairs compared at a time; hashes unpacked at a time.
CHUNK_ROWS, CELLS, CHUNK = 100_000, 1 << 20, 1 << 16
#: Parities kept of a candidate's set, in bits.
PARITIES = 2048
#: Stands for a null doc_id in joins.
NULL_ID = -(2**63)


def remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes of 23-bit words: remainders of the polynomials modulo GENERATOR."""
    out = words.astype(np.int64)
    for bit in range(BITS - 1, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@lru_cache(maxsize=4)
def error_patterns(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By excess 0..threshold over RADIUS: (start of each syndrome's patterns, patterns)."""
    out = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
        pats = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BITS), w)], dtype=np.int64)
        syn = remainder(pats)
        order = np.argsort(syn, kind="stable")
        out.append((np.searchsorted(syn[order], np.arange(2049)), pats[order]))
    return out


def anchors(words: np.ndarray, excess: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, anchor) for all anchors of 23-bit words at exactly this excess."""
    start, pats = error_patterns(threshold)[excess]
    syn = remainder(words)
    n = start[syn + 1] - start[syn]
    at = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, words[at] ^ pats[start[syn[at]] + nth]


def probe_rows(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor of 46 bits) for all anchors whose two excesses sum to at most the threshold."""
    lo, hi = fp & (2**BITS - 1), fp >> BITS & (2**BITS - 1)
    ats, keys = [], []
    for e in range(threshold + 1):
        at, a = anchors(lo, e, threshold)
        for f in range(threshold + 1 - e):
            at2, b = anchors(hi[at], f, threshold)
            ats.append(at[at2])
            keys.append(a[at2] | b << BITS)
    return np.concatenate(ats), np.concatenate(keys)


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; a text of fewer words is one shingle, one of none has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    k = min(size, len(words))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s : e - 1], seed) for s, e in zip(starts, ends[k - 1 :])), dtype=np.uint64, count=len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number (signed) whose bits are set in over half of the hashes; 0 for none."""
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """(doc_id, fp long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [majority(shingle_hashes(t, shingle, seed)) for t in b["text"]]}).astype({"fp": "int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidied(run), "doc_id long, fp long")


def covering_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of all distinct fingerprints (fp) with a < b that differ in 1 to `threshold` bits."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                fp = batch["fp"].to_numpy(np.int64)[i : i + 4096]
                at, anchor = probe_rows(fp, threshold)
                yield pd.DataFrame({"anchor": anchor, "b": fp[at]})

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            yield pd.DataFrame({"anchor": probe_rows(fp, 0)[1], "a": fp})

    homes, probes = fps.mapInPandas(home, "anchor long, a long"), fps.mapInPandas(probe, "anchor long, b long")
    met = homes.join(probes, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
    return met.select("a", "b")


def fingerprint_components(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs (doc_id, text)."""
    fps = durable(fingerprints(docs, shingle))
    classes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(covering_links(classes.select("fp"), threshold))
    held = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    held = durable(held)
    ids = held.join(held.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    return fingerprint_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

# ---- near copies: similarity of 0.8 or more on sets of five-word shingles


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of words; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w, NEAR_SEED) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(own) else own


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes."""
    x = h * np.uint64(2 * seed + 1) + np.uint64(seed)
    for shift, factor in ((31, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, size: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """Of each text (no nulls) the sorted distinct hashes of its shingles; a text of fewer words is one shingle, one of none has none."""
    words, n = split_words(pc.ascii_lower(texts))
    h = word_hashes(words)
    ends = np.cumsum(n)
    run = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for k in range(size):
        run += mixed(h[k : k + len(run)], NEAR_SEED + k)
    run, out = mixed(run, size), []
    for e, k in zip(ends.tolist(), n.tolist()):
        if 0 < k < size:
            few = np.zeros(1, dtype=np.uint64)
            for j, x in enumerate(h[e - k : e]):
                few += mixed(np.array([x]), NEAR_SEED + j)
            out.append(mixed(few, k))
        else:
            out.append(np.unique(run[e - k : e - size + 1]) if k else run[:0])
    return out


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 4) uint64: SimHashes of 256 bits, a bit set if it is in over half of the set's hashes."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), np.repeat(np.arange(len(sets)), n) << 8
    bits = np.zeros((len(sets), 256), dtype=bool)
    for w in range(4):
        at = (flat if w == 0 else mixed(flat, NEAR_SEED + 16 + w)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            count = np.bincount(owner + at[:, k], minlength=len(sets) << 8).reshape(-1, 256) @ _BYTE_BITS
            bits[:, 64 * w + 8 * k : 64 * w + 8 * k + 8] = 2 * count > n[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1, 4)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
FPS = ["f0", "f1", "f2", "f3"]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most 512 rows and some PIECE_BYTES of text."""
    for i in range(0, batch.num_rows, 512):
        yield from pieces(batch.slice(i, 512))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text), node (of the set), n (its size), f0..f3 of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch):
                sets = shingle_sets(b.column("text"))
                fp = set_fingerprints(sets).view(np.int64)
                node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                cols = [b.column("doc_id"), b.column("sha"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(fp[:, k]) for k in range(4))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sha", "node", "n", *FPS])

    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sha"))
    return keyed.mapInArrow(tidied(run), "doc_id long, sha long, node long, n long, f0 long, f1 long, f2 long, f3 long")


def block_words(fps: np.ndarray) -> list[np.ndarray]:
    """The eight 23-bit blocks of rows of four 64-bit fingerprints."""
    return [(fps[:, w] >> np.uint64(shift)).astype(np.int64) & (2**BITS - 1) for w in range(4) for shift in (0, BITS)]


def anchor_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor with its block) for all anchors within RADIUS + NEAR_THRESHOLD of a block of a row."""
    ats, keys = [], []
    for k, words in enumerate(block_words(fps)):
        for excess in range(NEAR_THRESHOLD + 1):
            at, anchor = anchors(words, excess, NEAR_THRESHOLD)
            ats.append(at)
            keys.append(anchor << 3 | k)
    return np.concatenate(ats), np.concatenate(keys)


def as_fps(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in FPS], axis=1).view(np.uint64)


def replicated(classes: DataFrame, chunk: int) -> DataFrame:
    """The rows of classes (node, n, f0..f3, more) at each of their anchors, as `cell`, sorted by it.

    An anchor of more than `chunk` rows is dealt by node into k chunks and into a cell for every pair of
    chunks, so that no task holds more than some two chunks of it, and all its pairs still meet.
    """
    names = classes.columns
    tasks = max(1, classes.rdd.getNumPartitions())
    least = max(1, chunk // (2 * tasks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            keys, n = np.unique(anchor_rows(as_fps(batch))[1], return_counts=True)
            for key, m in zip(keys.tolist(), n.tolist()):
                seen[key] = seen.get(key, 0) + m
        told = [(k, m) for k, m in seen.items() if m >= least]
        yield pa.RecordBatch.from_pydict({"anchor": pa.array([k for k, _ in told], pa.int64()), "rows": pa.array([m for _, m in told], pa.int64())})

    # a task tells counts of `least` or more, so a sum falls short by half a chunk at most;
    # anchors are 4,096 a block: 32,768 rows at most, whatever the input
    sizes = classes.select(*FPS).mapInArrow(tidied(count), "anchor long, rows long").groupBy("anchor").agg(F.sum("rows").alias("rows")).where(F.col("rows") + least * tasks > chunk).collect()
    split = {r["anchor"]: -(-(r["rows"] + least * tasks) // chunk) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(split), dtype=np.int64)
        ways = np.array([split[k] for k in hot.tolist()], dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                at, anchor = anchor_rows(as_fps(b))
                cell = anchor << 24
                if len(hot):
                    nth = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                    k = np.where(hot[nth] == anchor, ways[nth], 1)
                    mine = (mixed(b.column("node").to_numpy().view(np.uint64)[at], 7) % k.astype(np.uint64)).astype(np.int64)
                    rep = np.repeat(np.arange(len(at)), k)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
                    lo, hi = np.minimum(mine[rep], other), np.maximum(mine[rep], other)
                    at, cell = at[rep], (anchor[rep] << 24) | lo * k[rep] + hi
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *rows.columns], ["cell", *names])

    schema = "cell long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(tidied(deal), schema).repartition("cell").sortWithinPartitions("cell")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each cell of two rows or more; rows come sorted by cell."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[dict[str, np.ndarray]]:
        t = pa.Table.from_batches(held).combine_chunks()
        cols = {c: t.column(c).to_numpy() if t.schema.field(c).type == pa.int64() else np.array(t.column(c).to_pylist(), dtype=object) for c in t.column_names}
        key = cols["cell"]
        at = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for s, e in zip(at, at[1:] if last else at[1:-1]):
            if e - s > 1:
                yield {c: v[s:e] for c, v in cols.items()}
        held[:] = [] if last else [pa.RecordBatch.from_arrays([pa.array(v[at[-2] :]) for v in cols.values()], list(cols))]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if held[0].column("cell")[0] != batch.column("cell")[batch.num_rows - 1]:
                yield from cut(False)
    if held:
        yield from cut(True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits (at most 255 are told apart) of all rows of a and b."""
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def near_pairs(n: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i0, j0, distances, whether a pair i < j is near) of blocks of rows sorted by n, all pairs of like sizes."""
    i = 0
    while i < len(n):
        e = min(len(n), i + max(1, min(128, CELLS // (len(n) - i))))
        hi = int(np.searchsorted(n, n[e - 1] * 5 // 4, side="right"))
        for j in range(i, hi, CELLS // 128):
            f = min(hi, j + CELLS // 128)
            d = distances(fps[i:e], fps[j:f])
            ok = (d <= most) & (n[i:e, None] * 5 >= n[None, j:f] * 4) & (np.arange(i, e)[:, None] < np.arange(j, f)[None])
            yield i, j, d, ok
        i = e


def hubs(classes: DataFrame, most: int, chunk: int) -> DataFrame:
    """(node, hub, d): at each anchor, every row that has a near one there is told one hub, the most central row near it, or itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in by_cell(batches):
            order = np.lexsort((c["node"], c["n"]))
            n, node, fps = c["n"][order], c["node"][order], np.stack([c[f][order] for f in FPS], axis=1).view(np.uint64)
            score = np.zeros(len(n), dtype=np.int64)
            for i, j, d, ok in near_pairs(n, fps, most):
                if ok.any():
                    w = np.where(ok, most + 1 - d.astype(np.int64), 0)
                    score[i : i + len(w)] += w.sum(1)
                    score[j : j + w.shape[1]] += w.sum(0)
            left = np.flatnonzero(score)
            if not len(left):
                continue
            left = left[np.lexsort((node[left], -score[left]))]
            out_node, out_hub, out_d = [], [], []
            while len(left):
                h, left = left[0], left[1:]
                d = distances(fps[h : h + 1], fps[left])[0]
                ok = (d <= most) & (np.minimum(n[h], n[left]) * 5 >= np.maximum(n[h], n[left]) * 4)
                out_node.append(np.append(node[left[ok]], node[h]))
                out_hub.append(np.full(int(ok.sum()) + 1, node[h]))
                out_d.append(np.append(d[ok], 0).astype(np.int64))
                left = left[~ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_hub, out_d)], ["node", "hub", "d"])

    return replicated(classes, chunk).mapInArrow(tidied(run), "node long, hub long, d long")


def first_meeting(one: np.ndarray, two: np.ndarray, cell: int) -> np.ndarray:
    """Whether the anchor of this cell is the first that two fingerprints (row by row) share."""
    block, here = cell >> 24 & 7, cell >> 27
    out = np.ones(len(one), dtype=bool)
    for k, (x, y) in enumerate(zip(block_words(one)[: block + 1], block_words(two))):
        for excess in range(NEAR_THRESHOLD + 1):
            at, anchor = anchors(x, excess, NEAR_THRESHOLD)
            both = np.bitwise_count(anchor ^ y[at]) <= RADIUS + NEAR_THRESHOLD
            out[at[both & (anchor < here) if k == block else both]] = False
    return out


def open_pairs(classes: DataFrame, most: int, chunk: int, one: bool = False) -> DataFrame:
    """(a, b): all near pairs of classes (node, n, f0..f3, root, size, odd) of different roots that can have a similarity of 0.8 or more, given odd.

    odd holds parities of a set's shingles by hash. Two sets that differ in s shingles differ in at most
    s parities, so pairs that differ in more than a ninth of both sizes are no links. If `one`, each
    class is told only one such pair, that with a class of the largest component (size).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in by_cell(batches):
            if (c["root"] == c["root"][0]).all():
                continue
            order = np.lexsort((c["node"], c["n"]))
            n, node, root, size = (c[k][order] for k in ("n", "node", "root", "size"))
            odd = np.frombuffer(b"".join(c["odd"][order]), dtype=np.uint64).reshape(len(n), -1)
            fps = np.stack([c[f][order] for f in FPS], axis=1).view(np.uint64)
            by_size = np.lexsort((node, -size))
            rank, best = np.argsort(by_size), np.full(len(n), len(n))
            for i, j, _, ok in near_pairs(n, fps, most):
                us, vs = np.nonzero(ok & (root[i : i + ok.shape[0], None] != root[None, j : j + ok.shape[1]]))
                for at in range(0, len(us), 1 << 14):
                    u, v = i + us[at : at + (1 << 14)], j + vs[at : at + (1 << 14)]
                    can = 9 * np.bitwise_count(odd[u] ^ odd[v]).sum(1, dtype=np.int64) <= n[u] + n[v]
                    u, v = u[can], v[can]
                    if one:
                        np.minimum.at(best, u, rank[v])
                        np.minimum.at(best, v, rank[u])
                        continue
                    new = first_meeting(fps[u], fps[v], int(c["cell"][0]))
                    u, v = node[u[new]], node[v[new]]
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(np.zeros(len(u), dtype=np.int64))], ["a", "b", "size"])
            told = np.flatnonzero(best < len(n))
            if len(told):
                to = by_size[best[told]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[told], node[to], size[to])], ["a", "b", "size"])

    out = replicated(classes, chunk).mapInArrow(tidied(run), "a long, b long, size long")
    if one:
        out = out.groupBy("a").agg(F.min(F.struct((-F.col("size")).alias("s"), "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
    return out.select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have a Jaccard similarity of 0.8 or more."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    met = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(one, "a").join(two, "b").where(9 * met >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes, odd) of the classes in wanted (node, id, sha), from the texts of their first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch):
                sets = [s.view(np.int64) for s in shingle_sets(b.column("text"))]
                odd = [np.packbits(np.bincount((mixed(s.view(np.uint64), 9) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1 > 0).tobytes() for s in sets]
                ends = np.cumsum([0, *map(len, sets)])
                hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([b.column("node"), hashes, pa.array(odd, pa.binary())], ["node", "hashes", "odd"])

    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("sha"), text.alias("text"))
    rows = given.join(checked_broadcast(wanted), ["id", "sha"]).select("node", "text")
    return rows.mapInArrow(tidied(run), "node long, hashes array<long>, odd binary").dropDuplicates(["node"])


def near_groups(docs: DataFrame, classes: DataFrame, most: int = NEAR_BITS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(node, root) of every class in a group of two or more; classes: node, n, f0..f3, id and sha of a row of it.

    A class is tested first against one hub, the least distant that any anchor gives, then against one
    class of the largest component so far that it can be linked to, so a group of near copies takes
    few more pairs than it has classes. Then all near pairs that are still in different components are
    tested, but those that parities of their shingles rule out.
    """
    told = durable(hubs(classes.select("node", "n", *FPS), most, chunk).groupBy("node").agg(F.min(F.when(F.col("hub") != F.col("node"), F.struct("d", "hub"))).alias("h")))
    stars = told.where("h is not null").select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b")).distinct()
    near = durable(classes.join(told.select("node"), "node", "left_semi"))
    sets = durable(sets_of(docs, near.select("node", "id", "sha")))
    links = durable(verified(stars, sets))
    for one in (True, False):
        root = components(links)
        size = root.groupBy("root").agg(F.count("*").alias("size"))
        left = near.join(root.join(size, "root"), "node", "left").join(sets.select("node", "odd"), "node")
        left = left.select("node", "n", *FPS, F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), "odd")
        pairs = durable(open_pairs(durable(left), most, chunk, one))
        links = durable(links.unionByName(verified(pairs, sets)))
    return components(links)


def near_dedup(docs: DataFrame, most: int = NEAR_BITS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """The rows of docs (doc_id, text, ...) but those that a near copy of less doc_id stands for.

    Of each group the row with the least doc_id stays (null last, then the least digest of the text), once.
    """
    rows = durable(fingerprint_rows(docs))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("sha").alias("sha"))
    same = [F.first(c).alias(c) for c in ("n", *FPS)]
    classes = durable(rows.groupBy("node").agg(F.min(order).alias("w"), *same))
    groups = near_groups(docs, classes.where("n > 0").select("node", "n", *FPS, "w.id", "w.sha"), most, chunk)
    best = classes.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("w").alias("w"))
    held = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "sha").groupBy("id", "sha").agg(F.count("*").alias("copies"))
    held = held.join(best.select("w.id", "w.sha", F.lit(True).alias("stays")), ["id", "sha"], "left")
    # most rows stay: the keys of those that go, and of those told more than once, are few beside the texts
    out = checked_broadcast(held.where("stays is null or copies > 1").select("id", "sha", "stays"))
    key, sha, stays = fresh(docs, "id", "sha", "stays")
    out = out.select(F.col("id").alias(key), F.col("sha").alias(sha), F.coalesce("stays", F.lit(False)).alias(stays))
    given = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), sha: F.xxhash64(F.coalesce("text", F.lit("")))})
    once = given.join(out, [key, sha], "left")
    again = once.where(F.col(stays)).dropDuplicates([key, sha])
    return once.where(F.col(stays).isNull()).select(*columns_of(docs)).unionByName(again.select(*columns_of(docs)))
