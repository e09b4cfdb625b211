"""Operator 11, fill-in-middle transformation on ropes.

A text is a rope: a balanced tree whose leaves hold runs of whole lines (units, `[^\\n]*\\n|[^\\n]+`)
and cache their counts of units and of code points; a tree's counts are its leaves' sums. A document
is split at two unit ranks, and prefix, middle and suffix, which are subtrees, are joined again in
another order with sentinels between them. No text is copied but that of the leaves at the cuts. The
inverse finds the sentinels, which the text itself cannot hold, and splits the tree by code points.

Draws come from SHA-256 of "seed:doc_id": its first four groups of eight hex digits are h1 to h4.
The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the
larger. A document is transformed if h3 % 100 < fim_percent, and is in the order suffix, prefix,
middle (spm) if h4 % 100 < spm_percent, else prefix, suffix, middle (psm).

Defined results: null text is empty; empty texts and those that contain a sentinel stay plain, with
null prefix_chars and middle_chars; the decimal doc_id of a null is empty; rows are transformed one
by one, so repeated rows agree; a line of any length is one unit (a leaf of its own, however long);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_binary import pieces

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a leaf, unless one line is longer.
LEAF_CHARS = 2048


class Rope:
    """A leaf (text) or a node (left, right), with the units and code points below it."""

    __slots__ = ("left", "right", "text", "units", "chars", "height")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.units, self.chars, self.height = text.count("\n") + (text[-1:] not in ("", "\n")), len(text), 0
        else:
            self.units, self.chars, self.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)

    @staticmethod
    def of(text: str, leaf_chars: int = LEAF_CHARS) -> Rope:
        """A balanced rope of a text; leaves end where lines end."""
        leaves, at = [], 0
        while at < len(text):
            end = text.rfind("\n", at, at + leaf_chars) + 1 if at + leaf_chars < len(text) else len(text)
            if end <= at:  # one line is longer than a leaf
                end = text.find("\n", at) + 1 or len(text)
            leaves.append(Rope(text[at:end]))
            at = end
        while len(leaves) > 1:
            leaves = [Rope("", *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else Rope()

    def __add__(self, other: Rope) -> Rope:
        """Both in a row: the lower tree is hung where the higher one is as high, and a node is turned if its sides differ by two."""
        if not self.chars or not other.chars:
            return self if self.chars else other
        if abs(self.height - other.height) <= 1:
            return Rope("", self, other)
        if self.height > other.height:
            return Rope._level(self.left, self.right + other)
        return Rope._level(self + other.left, other.right)

    @staticmethod
    def _level(a: Rope, b: Rope) -> Rope:
        if a.height > b.height + 1:
            if a.left.height >= a.right.height:
                return Rope("", a.left, Rope("", a.right, b))
            return Rope("", Rope("", a.left, a.right.left), Rope("", a.right.right, b))
        if b.height > a.height + 1:
            if b.right.height >= b.left.height:
                return Rope("", Rope("", a, b.left), b.right)
            return Rope("", Rope("", a, b.left.left), Rope("", b.left.right, b.right))
        return Rope("", a, b)

    def split(self, rank: int, by: str) -> tuple[Rope, Rope]:
        """The first `rank` units or chars (by: which), and the rest."""
        if rank <= 0:
            return Rope(), self
        if rank >= getattr(self, by):
            return self, Rope()
        if self.left is None:
            cut = rank
            if by == "units":
                cut = 0
                for _ in range(rank):
                    cut = self.text.index("\n", cut) + 1
            return Rope(self.text[:cut]), Rope(self.text[cut:])
        if rank <= (n := getattr(self.left, by)):
            a, b = self.left.split(rank, by)
            return a, b + self.right
        a, b = self.right.split(rank - n, by)
        return self.left + a, b

    def leaves(self) -> Iterator[str]:
        below = [self]
        while below:
            x = below.pop()
            if x.left is None:
                yield x.text
            else:
                below += (x.right, x.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def rearranged(text: str, h: tuple[int, int, int, int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of a text under the draws h."""
    rope = Rope.of(text)
    n = rope.units
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    rest, suffix = rope.split(high, "units")
    prefix, middle = rest.split(low, "units")
    p, s, m = Rope(PREFIX), Rope(SUFFIX), Rope(MIDDLE)
    if h[3] % 100 < spm_percent:
        form, out = "spm", s + suffix + p + prefix + m + middle
    else:
        form, out = "psm", p + prefix + s + suffix + m + middle
    return n, form, prefix.chars, middle.chars, str(out)


def restored_text(output: str, form: str) -> str:
    """The text that rearranged() was given."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(one):
        raise ValueError(f"not of form {form}")
    first, second = output.index(two), output.index(MIDDLE)
    rest, middle = Rope.of(output).split(second, "chars")
    a, b = rest.split(first, "chars")
    a, b, middle = (x.split(len(s), "chars")[1] for x, s in ((a, one), (b, two), (middle, MIDDLE)))
    return str(a + middle + b if form == "psm" else b + middle + a)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def to_fim(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text for training) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                hs = zip(*(b.column(f"h{k}").to_pylist() for k in range(1, 5)))
                rows = [rearranged(t, h, fim_percent, spm_percent) for t, h in zip(b.column("text").to_pylist(), hs)]
                n, form, prefix, middle, out = zip(*rows) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in ((n, pa.int64()), (form, pa.string()), (prefix, pa.int64()), (middle, pa.int64()), (out, pa.string())))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def from_fim(rows: DataFrame) -> DataFrame:
    """rows of to_fim() with one more column, restored: the text, rebuilt from output and form alone."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "output"):
                back = [restored_text(o, f) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*names, "restored"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", restored string")


def op11_rope_fim(spark, sf_dir: str) -> DataFrame:
    out = from_fim(to_fim(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same by lists of lines.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
  sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * CAST(i AS INTEGER) + 1, 8) AS BIGINT) FOR i IN range(4)] AS g FROM d),
f AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR g[3] % 100 >= {FIM_PERCENT} THEN 'plain'
    WHEN g[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
