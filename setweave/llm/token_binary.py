"""Operator 4, token ids in Re-Pair compressed shards.

Documents are dealt by ranges of doc_id and encoded in ascending order. A shard is a run of
documents of at most SHARD_WORDS words (one document at least). Within a shard, frequent pairs
of ids are replaced by nonterminals, round by round until no pair of a document's neighbours is
told LEAST times: first inside the shard's distinct words, weighted by their counts (the same
pairs as in the text, counted once a word), then in the whole sequence, also across words. A
round replaces all frequent pairs, the left one where two overlap. No rule crosses the end of a
document.

File format: Parquet, one row a shard: part, nth (place of the shard), n_tokens, and `shard`,
bytes in little-endian order: magic RPR1, counts of documents, rules and symbols (uint32);
doc_id (int64) and its null flag (uint8) by document; the first symbol (uint32) and the first
token (uint64) of each document, and the totals; left and right symbol (uint32) of each rule;
expansion length (uint32) of each rule; symbols (uint32). A document is decoded from its own
symbols and the rules alone; lengths locate it, and any token of it, without other documents.

Words between ASCII white space are encoded by the tokenizers library one by one and kept in
a bounded cache: this tokenizer drops white space, and no piece spans it. Words of letters below
U+0130 are lower-cased first and a final run of punctuation is split off and encoded by itself, as the
tokenizer's own normaliser and pattern do; all else goes to the library as it is.

Defined results: null text is empty (the end id alone); rows are ordered by doc_id, null first,
then by text; repeated rows are each encoded; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, give_back, shared_path, tidied

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARD_WORDS = 1_000_000
#: Least count of a pair that becomes a rule.
LEAST = 6
#: Pairs from which on their buckets are counted first, and the bits of a bucket.
MANY, BUCKET_BITS = 1 << 16, 21
#: Places whose buckets are counted at a time.
RUN = 1 << 18
#: Most words that are kept with their ids, and their most characters.
CACHE_WORDS, CACHE_CHARS = 600_000, 8 << 20
#: Most bytes of text split into words at a time.
PIECE_BYTES = 8 << 20
#: Letters below U+0130, a normaliser that only lower-cases them, and a pattern that keeps a run of them whole.
LETTERS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+"
#: Characters of which a run behind letters is a piece of its own by the pattern, and no part of an added token.
MARKS = "!\"#$%&()*+,-./:;=?@"
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SCHEMA = "part int, nth int, n_tokens long, shard binary"


def tokenizer_path(name: str) -> str:
    """A file's path: itself if it is one, else that of the installed public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of words, by the tokenizers library, with a cache of at most CACHE_WORDS words and CACHE_CHARS characters, or of the words of one call.

    A full cache keeps the words of the call that fills it, so that frequent words are not encoded again.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.size = self.tok.get_vocab_size()
        self.ends = np.zeros(self.size, dtype=bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        #: The same model without the normaliser and the pattern, which leave lower-case letters as they are; None for another tokenizer.
        self.bare = None
        steps = json.loads(self.tok.to_str())
        if (steps["normalizer"], steps["pre_tokenizer"]) == (NORMALISER, PATTERN) and all(set(x["content"]) & set("<|>") for x in steps["added_tokens"]):
            split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, PATTERN["pretokenizers"][1]]}
            self.bare = Tokenizer.from_str(json.dumps(steps | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
        #: The cached words; the ids of the one at a place are ids[at[place] : at[place + 1]].
        self.words = pa.array([], pa.string())
        self.ids, self.at = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids, and how many each word has."""
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return [i for x in ids for i in x], list(map(len, ids))

    def _letters(self, words: list[str]) -> tuple[list[int], np.ndarray | list[int]]:
        """As _encode, of lower-case words of letters: each is one pre-token, whose last piece alone ends in </w>."""
        ids = self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        cut = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(cut, prepend=-1)) if len(cut) == len(words) and cut[-1] == len(ids) - 1 else self._encode(words)

    def _keep(self, places: np.ndarray) -> None:
        """Keeps the words at these places alone, in this order."""
        n = np.diff(self.at)[places]
        self.ids = self.ids[spread(self.at[places], n)]
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.words = self.words.take(pa.array(places))

    def _learn(self, words: pa.StringArray, how) -> None:
        ids, n = [self.ids], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(words), 512):
            got = how(words.slice(i, 512).to_pylist())
            ids.append(np.array(got[0], dtype=np.int32))
            n.append(np.asarray(got[1], dtype=np.int64))
        self.ids = np.concatenate(ids)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(n))])
        self.words = pa.concat_arrays([self.words, words])

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Where these words, all different, are kept; those that are not yet are encoded."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        missing = words.take(pa.array(new))
        chars = lambda x: pc.sum(pc.utf8_length(x)).as_py() or 0
        if len(self.words) + len(missing) > CACHE_WORDS or chars(self.words) + chars(missing) > CACHE_CHARS:
            held = np.unique(place[place >= 0])
            self._keep(held)
            place[place >= 0] = np.searchsorted(held, place[place >= 0])
        plain = pc.match_substring_regex(missing, f"^{LETTERS}$").to_numpy(zero_copy_only=False) & (self.bare is not None)
        for how, own in ((self._letters, plain), (self._encode, ~plain)):
            place[new[own]] = len(self.words) + np.arange(own.sum())
            self._learn(missing.filter(pa.array(own)), how)
        return place

    def __call__(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one word after another, and how many each word has."""
        keys, has = words, np.zeros(0, dtype=np.int64)
        if self.bare:
            core = pc.ascii_rtrim(words, MARKS)
            plain = pc.match_substring_regex(core, f"^{LETTERS}$")
            has = np.flatnonzero(pc.and_(plain, pc.not_equal(pc.binary_length(core), pc.binary_length(words))).to_numpy(zero_copy_only=False))
            keys = pc.if_else(plain, pc.utf8_lower(core), words)
            keys = pa.concat_arrays([keys, pc.replace_substring_regex(words.take(pa.array(has)), f"^{LETTERS}", "")])
        coded = keys.dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        size = np.diff(self.at)[place]
        n = size[: len(words)].copy()
        n[has] += size[len(words) :]
        start = np.cumsum(n) - n
        start = np.concatenate([start, start[has] + size[has]])
        out = np.empty(int(n.sum()), dtype=np.int32)
        out[spread(start, size)] = self.ids[spread(self.at[place], size)]
        return out, n


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """One encoder a Python worker."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 for all i, in order."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def keys_at(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pairs at these places, a number each."""
    key = seq[at].astype(np.int64)
    key <<= 32
    key |= seq[at + 1]
    return key


def perhaps_frequent(seq: np.ndarray, at: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """The places whose pair falls into a bucket that is told LEAST times: rare pairs mostly don't, and need no count of their own. Some places at a time."""

    def buckets(own: np.ndarray) -> np.ndarray:
        bucket = keys_at(seq, own).view(np.uint64)
        bucket *= np.uint64(0x9E3779B97F4A7C15)
        bucket >>= np.uint64(64 - BUCKET_BITS)
        return bucket.view(np.int64)

    runs = [at[i : i + RUN] for i in range(0, len(at), RUN)]
    told = np.zeros(1 << BUCKET_BITS)
    for own in runs:
        np.add.at(told, buckets(own), 1.0 if weight is None else weight[own])
    frequent = told >= LEAST
    return np.concatenate([own[frequent[buckets(own)]] for own in runs])


def repair_round(seq: np.ndarray, joined: np.ndarray, alive: np.ndarray, weight: np.ndarray | None, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One batch of replacements. joined[i]: seq[i] and seq[i + 1] may pair. (rules, new seq, kept positions, new alive).

    alive[i]: the pair at i can still be frequent. A count of old symbols never grows, so a pair found
    rare stays so, and only pairs that were frequent or hold a new symbol are counted in the next round.
    """
    at = np.flatnonzero(joined & alive)
    if len(at) >= MANY:
        at = perhaps_frequent(seq, at, weight)
    key = keys_at(seq, at)
    inverse, pairs = pd.factorize(key)
    count = np.bincount(inverse, weights=None if weight is None else weight[at], minlength=len(pairs))
    hit = (count >= LEAST)[inverse]
    if not hit.any():
        return np.zeros((0, 2), dtype=np.int64), seq, np.arange(len(seq)), alive
    alive = np.zeros(len(seq), dtype=bool)
    at, inverse = at[hit], inverse[hit]
    alive[at] = True
    # of overlapping occurrences, every other one from the left
    start = np.concatenate([[True], np.diff(at) > 1])
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    at, inverse = at[nth % 2 == 0], inverse[nth % 2 == 0]
    used = np.zeros(len(pairs), dtype=bool)
    used[inverse] = True
    new = (first - 1 + np.cumsum(used))[inverse]
    chosen = np.flatnonzero(used)
    seq = seq.copy()
    seq[at] = new
    keep = np.ones(len(seq), dtype=bool)
    keep[at + 1] = False
    kept = np.flatnonzero(keep)
    seq = seq[kept]
    fresh = seq >= first
    alive = alive[kept] | fresh
    alive[:-1] |= fresh[1:]
    return np.stack([pairs[chosen] >> 32, pairs[chosen] & 0xFFFFFFFF], axis=1), seq, kept, alive


def repair(seq: np.ndarray, n: np.ndarray, codes: np.ndarray, doc_words: np.ndarray, base: int, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, symbols of each document) of documents given as codes of word types; type i has n[i] of the ids in seq."""
    types = len(n)
    seq = np.asarray(seq, dtype=np.int32)
    owner = np.repeat(np.arange(types, dtype=np.int32), n)
    weight = np.bincount(codes, minlength=types).astype(np.float64)
    rules: list[np.ndarray] = []
    size = base
    alive = np.ones(len(seq), dtype=bool)
    while True:
        joined = np.append(owner[1:] == owner[:-1], False)[: len(seq)]
        new, seq, kept, alive = repair_round(seq, joined, alive, weight[owner], size)
        owner = owner[kept]
        if not len(new):
            break
        rules.append(new)
        size += len(new)
    n = np.bincount(owner, minlength=types)
    start = np.cumsum(n) - n
    per_word = n[codes]
    before = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(doc_words)])]
    per_doc = np.diff(before) + 1
    ends = np.cumsum(per_doc) - 1
    out = np.full(int(per_doc.sum()), end_id, dtype=np.int32)
    body = np.ones(len(out), dtype=bool)
    body[ends] = False
    out[body] = seq[spread(start[codes], per_word)]
    alive = np.ones(len(out), dtype=bool)  # across words, all pairs count anew
    while True:
        joined = np.append(body[1:] & body[:-1], False)
        new, out, kept, alive = repair_round(out, joined, alive, None, size)
        body = body[kept]
        if not len(new):
            break
        rules.append(new)
        size += len(new)
    ends = np.flatnonzero(~body)
    return np.concatenate([np.zeros((0, 2), dtype=np.int64), *rules]), out, np.diff(ends, prepend=-1)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(base + len(rules), dtype=np.int64)
    left, right = rules[:, 0].tolist(), rules[:, 1].tolist()
    for i, (a, b) in enumerate(zip(left, right)):
        out[base + i] = out[a] + out[b]
    return out


def pack(doc_ids: list[int | None], rules: np.ndarray, symbols: np.ndarray, doc_symbols: np.ndarray, base: int) -> tuple[bytes, int]:
    length = expansion_lengths(rules, base)
    first = np.concatenate([[0], np.cumsum(doc_symbols)])
    tokens = np.concatenate([[0], np.cumsum(length[symbols])])[first]
    parts = [
        np.array([len(doc_ids), len(rules), len(symbols), base], dtype="<u4"),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8"),
        np.array([d is None for d in doc_ids], dtype="u1"),
        first.astype("<u4"), tokens.astype("<u8"), rules.astype("<u4"), length[base:].astype("<u4"), symbols.astype("<u4"),
    ]
    return b"RPR1" + b"".join(p.tobytes() for p in parts), int(tokens[-1])


class Shard:
    """Reads a packed shard; ids(i) decodes document i alone."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPR1":
            raise ValueError("not a shard")
        self.at, self.data = 4, data
        docs, rules, symbols, self.base = self._take("<u4", 4).tolist()
        ids, null = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.first, self.tokens = self._take("<u4", docs + 1).astype(np.int64), self._take("<u8", docs + 1).astype(np.int64)
        self.rules, self.length = self._take("<u4", 2 * rules).reshape(-1, 2), self._take("<u4", rules).astype(np.int64)
        self.symbols = self._take("<u4", symbols)
        self.start = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.length) - self.length]).astype(np.int64)
        self.span = np.concatenate([np.ones(self.base, dtype=np.int64), self.length])
        told = [i.to_bytes(4, "little") for i in range(self.base)]
        for a, b in self.rules.tolist():
            told.append(told[a] + told[b])
        self.flat = np.frombuffer(b"".join(told), dtype="<u4")

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, dtype=kind, count=n, offset=self.at)
        self.at += out.nbytes
        return out

    def ids(self, i: int) -> np.ndarray:
        s = self.symbols[self.first[i] : self.first[i + 1]]
        return self.flat[spread(self.start[s], self.span[s])]


def split_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of these texts, one text after another, and how many each text has."""
    parts = pc.ascii_split_whitespace(texts)
    words, n = parts.flatten(), parts.value_lengths().to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text gives an empty word
    owner = np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)]
    return words.filter(full), np.bincount(owner, minlength=len(n))


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most PIECE_BYTES of this column's text (or of one row)."""
    size, at = pc.binary_length(batch.column(column)).to_pylist(), 0
    while at < len(size):
        end, total = at + 1, size[at]
        while end < len(size) and total + size[end] <= PIECE_BYTES:
            total += size[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def encode_shards(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Shards of one partition's rows (part, doc_id, missing, text), which come in order."""
    enc = encoder(tokenizer)
    nth = part = 0
    doc_ids: list[int | None] = []
    counts: list[int] = []
    held: list[pa.StringArray] = []
    total = 0

    def flush() -> pa.RecordBatch:
        nonlocal nth, total
        words = pa.concat_arrays(held).dictionary_encode()
        held.clear()
        ids, n = enc(words.dictionary)
        codes = words.indices.to_numpy()
        del words
        give_back()
        got = repair(ids, n, codes, np.array(counts, dtype=np.int64), enc.size, end_id)
        give_back()
        data, n = pack(doc_ids, *got, enc.size)
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "nth", "n_tokens", "shard"])
        nth, total = nth + 1, 0
        doc_ids.clear()
        counts.clear()
        give_back()
        return out

    for batch in batches:
        for piece in pieces(batch):
            words, n = split_words(piece.column("text"))
            at = here = 0  # words of this piece in shards or held; words before this document
            for part, doc_id, missing, k in zip(*(piece.column(c).to_pylist() for c in ("part", "doc_id", "missing")), n.tolist()):
                if doc_ids and total + k > shard_words:
                    held.append(words.slice(at, here - at))
                    at = here
                    yield flush()
                doc_ids.append(None if missing else doc_id)
                counts.append(k)
                here += k
                total += k
            held.append(words.slice(at))
    if doc_ids:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_words: int = SHARD_WORDS) -> None:
    """Writes docs (doc_id, text) to a new folder, in the format above."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = rows.select(F.spark_partition_id().alias("part"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(tidied(lambda it: encode_shards(it, tokenizer, end_id, shard_words)), SCHEMA).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, nth of every document in a folder of shards."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("part", "nth", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("at")).join(sizes, "part")
    starts = starts.select("part", "nth", (F.col("at") + F.col("part_start")).alias("shard_start"))
    starts = checked_broadcast(starts)  # a row a shard: the shards themselves need not be shuffled

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, nth, at, data in zip(batch["part"], batch["nth"], batch["shard_start"], batch["shard"]):
                s = Shard(bytes(data))
                crc = [zlib.crc32(s.ids(i).tobytes()) for i in range(len(s.doc_ids))]
                yield pd.DataFrame({"doc_id": pd.array(s.doc_ids, dtype="Int64"), "start": at + s.tokens[:-1], "n_tokens": np.diff(s.tokens), "ids_crc32": np.array(crc, dtype=np.int64), "part": part, "nth": nth})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, nth int"
    return shards.select("part", "nth", "shard").join(starts, ["part", "nth"]).mapInPandas(tidied(decode), schema)


def token_binary(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes shards to the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)


def op4_repair_tokens(spark, sf_dir: str) -> DataFrame:
    return token_binary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
