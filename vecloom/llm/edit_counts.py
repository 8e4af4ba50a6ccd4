"""Edit-aware token counts: a tree of pre-token segments for each document.

A document's leaves hold runs of pre-tokens, each with its length and number of tokens; the tree above holds
the sums. build_trees() makes a table of them, which is stored; apply_edits() takes it with each row's edits and
gives the counts after them, and the trees as they are then. An edit re-encodes from two pre-tokens before it (a run of white space looks at what follows) to
where a pre-token ends, after the edit, at a place where one ended before: from there on nothing changes, for
a pre-token depends only on the text from its beginning on. Then the leaves' sums go up the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import NULL_ID, keyed, row_key, settle

LEAF, KEPT, LONGEST, BATCH = 64, 400_000, 64, 1 << 16


class Counter:
    """Pre-tokens of a text and how many tokens each has; pieces are remembered, KEPT of them at most."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > KEPT:
                known.clear()
            for i, (n, p) in enumerate(zip(out, pieces, strict=True)):
                if n is None:
                    n = known.get(p)
                    if n is None:
                        n = len(self.encoding.encode_ordinary(p))
                        if len(p) <= LONGEST:
                            known[p] = n
                    out[i] = n
        return out


COUNTERS: dict[str, Counter] = {}


def counter(ranks: str, pattern: str) -> Counter:
    """One for each Python worker."""
    if ranks not in COUNTERS:
        COUNTERS[ranks] = Counter(ranks, pattern)
    return COUNTERS[ranks]


def small(values: np.ndarray) -> bytes:
    """In one byte each if they fit, else in four."""
    return values.astype("u1" if not len(values) or values.max() < 256 else "<u4").tobytes()


def unsmall(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "u1" if len(data) == n else "<u4").astype("<u4")


Leaf = tuple[list[int] | np.ndarray, list[int] | np.ndarray]


@dataclass
class Tree:
    """A text, its leaves (lengths and numbers of tokens of pre-tokens) and the sums of characters and tokens over them."""

    counter: Counter
    text: str
    leaves: list[Leaf] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    encoded: int = 0

    @classmethod
    def of(cls, counter: Counter, text: str) -> Tree:
        """Encode a text, BATCH pre-tokens at a time."""
        sizes, tokens = [], []
        found = counter.pattern.finditer(text)
        while pieces := [m.group() for m in islice(found, BATCH)]:
            sizes.append(np.fromiter(map(len, pieces), "<u4", len(pieces)))
            tokens.append(np.array(counter.counts(pieces), "<u4"))
        none = np.zeros(0, "<u4")
        tree = cls(counter, text)
        tree.leaves = tree.cut(np.concatenate([none, *sizes]), np.concatenate([none, *tokens]))
        tree.build()
        return tree

    @classmethod
    def load(cls, counter: Counter, text: str, sizes: bytes, tokens: bytes, leaves: bytes, sums: bytes) -> Tree:
        """A stored tree; nothing is encoded or summed."""
        ends = np.cumsum(np.frombuffer(leaves, "<u4"), dtype=np.int64)
        size, n = (unsmall(x, int(ends[-1])) for x in (sizes, tokens))
        chars, total = np.frombuffer(sums, "<i8").reshape(2, -1).tolist()
        return cls(counter, text, [(size[i:j], n[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())], chars, total)

    def store(self) -> tuple[str, bytes, bytes, bytes, bytes]:
        """text, sizes, tokens, leaves and sums, as load() takes them."""
        sizes, tokens = (np.concatenate([np.asarray(x[k], "<u4") for x in self.leaves]) for k in (0, 1))
        return self.text, small(sizes), small(tokens), np.array([len(x) for x, _ in self.leaves], "<u4").tobytes(), np.array([self.chars, self.tokens], "<i8").tobytes()

    @staticmethod
    def cut(size, n) -> list[Leaf]:
        return [(size[i : i + LEAF], n[i : i + LEAF]) for i in range(0, max(1, len(size)), LEAF)]

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    @property
    def pieces(self) -> int:
        return sum(len(x) for x, _ in self.leaves)

    def lists(self, leaf: int) -> tuple[list[int], list[int]]:
        """A leaf as lists."""
        size, n = self.leaves[leaf]
        return (size, n) if isinstance(size, list) else (size.tolist(), n.tolist())

    def build(self) -> None:
        width = 1 << (len(self.leaves) - 1).bit_length()
        chars, tokens = [0] * (2 * width), [0] * (2 * width)
        for i, (size, n) in enumerate(self.leaves):
            chars[width + i], tokens[width + i] = int(sum(size)), int(sum(n))
        for i in range(width - 1, 0, -1):
            chars[i], tokens[i] = chars[2 * i] + chars[2 * i + 1], tokens[2 * i] + tokens[2 * i + 1]
        self.chars, self.tokens = chars, tokens

    @property
    def total(self) -> int:
        return self.tokens[1]

    def update(self, leaf: int) -> None:
        i = self.width + leaf
        self.chars[i], self.tokens[i] = map(sum, self.lists(leaf))
        while i > 1:
            i >>= 1
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins. Past the end: the last leaf."""
        i, before = 1, 0
        if place >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - self.chars[self.width + last]
        while i < self.width:
            i *= 2
            if place - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def edit(self, place: int, drop: int, put: str) -> None:
        """Replace `drop` characters from `place` by `put`; both are cut to what the text has."""
        place = min(max(place, 0), len(self.text))
        drop = min(max(drop, 0), len(self.text) - place)
        self.text = self.text[:place] + put + self.text[place + drop :]
        leaf, at = self.find(max(0, place - 1))
        ends: list[tuple[int, int, int]] = []  # in this leaf: where pre-tokens begin, up to the edit
        while True:
            size = self.lists(leaf)[0]
            begins, x = [], at
            for k, s in enumerate(size):
                if x >= place:
                    break
                begins.append((x, leaf, k))
                x += s
            ends = begins + ends
            if len(ends) > 2 or not leaf:
                break
            leaf -= 1
            at -= self.chars[self.width + leaf]
        start, first, k = ends[max(0, len(ends) - 3)] if ends else (0, 0, 0)
        shift, old_end = len(put) - drop, place + drop
        new: list[str] = []
        x, old, last, j = start, start, first, k  # x in the new text; old, (last, j): the next old pre-token
        after = self.lists(last)[0]
        for found in self.counter.pattern.finditer(self.text, start):
            new.append(found.group())
            x = found.end()
            while old < x - shift or old < old_end:
                if j >= len(after):
                    if last + 1 >= len(self.leaves):
                        break
                    last, j = last + 1, 0
                    after = self.lists(last)[0]
                    continue
                old += after[j]
                j += 1
            if old == x - shift and old >= old_end and x >= place + len(put):
                break
        else:
            last, j = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += len(new)
        head, tail = self.lists(first), self.lists(last)
        size = head[0][:k] + list(map(len, new)) + tail[0][j:]
        n = head[1][:k] + self.counter.counts(new) + tail[1][j:]
        if first == last and len(size) <= 2 * LEAF:
            self.leaves[first] = (size, n)
            self.update(first)
        else:
            self.leaves[first : last + 1] = self.cut(size, n)
            self.build()


TREES = "doc_id long, key long, text string, sizes binary, tokens binary, leaves binary, sums binary"
COUNTS = "doc_id long, key long, n_chars long, n_pieces long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long"
EDITS = "array<struct<place: bigint, drop: bigint, put: string>>"


def names(shape: str) -> list[str]:
    return [x.split()[0] for x in shape.split(", ")]


def build_trees(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The tree of each row, to be stored. Null text is empty: one leaf without pre-tokens. Null doc_id: the largest id. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks, pattern)
        for b in batches:
            rows = list(zip(*[Tree.of(own, text.as_py()).store() for text in b.column(2)])) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(rows, [pa.string(), *[pa.binary()] * 4], strict=True))], names(TREES))

    return keyed(docs).select("doc_id", row_key(), "text").mapInArrow(run, TREES)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with the column `edits`, from a table of doc_id, seq, place, drop, put: those of its id, by seq (ties: by place, drop, put).

    Rows that share an id all get its edits; a null id has those of null ids. A document's edits are together in
    a task, as its text is. Documents without edits have an empty list; edits of no document are left out.
    """
    own = edits.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.struct(F.col("seq").cast("long").alias("seq"), F.col("place").cast("long").alias("place"), F.col("drop").cast("long").alias("drop"), F.coalesce(F.col("put").cast("string"), F.lit("")).alias("put")).alias("e"),
    )
    listed = own.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["place"].alias("place"), e["drop"].alias("drop"), e["put"].alias("put"))).alias("edits"))
    return trees.join(listed, "doc_id", "left").withColumn("edits", F.coalesce(F.col("edits").cast(EDITS), F.array().cast(EDITS)))


def apply_edits(trees: DataFrame, ranks: str, pattern: str, keep: bool = False) -> DataFrame:
    """Of each row of build_trees() with `edits` the number of tokens before and after, and how many pre-tokens were re-encoded.

    edits: place, dropped characters, text put in, applied in turn, each to the text as the ones before left it; a
    place and a length are cut to what the text has, null counts as 0 or as empty. keep: the trees as they are
    then come too, to be stored for later edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks, pattern)
        for b in batches:
            rows, new = [], []
            for doc_id, key, *stored, edits in zip(*(b.column(k).to_pylist() for k in range(2)), *(b.column(k) for k in range(2, 8))):
                tree, edits = Tree.load(own, *(x.as_py() for x in stored)), edits.as_py() or []
                n, before, pieces = len(tree.text), tree.total, tree.pieces
                for e in edits:
                    tree.edit(e["place"] or 0, e["drop"] or 0, e["put"] or "")
                rows.append((doc_id, key, n, pieces, before, len(edits), tree.total, tree.encoded))
                if keep:
                    new.append(tree.store())
            columns = [pa.array(x) for x in np.array(rows, np.int64).reshape(-1, 8).T]
            if keep:
                columns += [pa.array(x, t) for x, t in zip(list(zip(*new)) or [()] * 5, [pa.string(), *[pa.binary()] * 4], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names(shape))

    shape = COUNTS + (", " + TREES.split(", ", 2)[2] if keep else "")
    return trees.select(*names(TREES), F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, shape)


def standing_edits() -> Column:
    """Three edits for a tree, by its id and length: words put in, characters taken out, a word replaced."""
    n = F.char_length("text")
    edit = lambda place, drop, put: F.struct(F.floor(place).cast("long").alias("place"), F.lit(drop).cast("long").alias("drop"), put.alias("put"))
    return F.array(edit(n / 4, 0, F.concat(F.lit(" edit "), F.col("doc_id").cast("string"), F.lit(" here"))), edit(n / 2, 8, F.lit("")), edit(n * 3 / 4, 5, F.lit("Changed")))


def edited_counts(docs: DataFrame, ranks: str, pattern: str, edits: DataFrame | None = None) -> DataFrame:
    """Store the documents' trees, then apply_edits(): those of a table (with_edits), or standing_edits()."""
    trees = settle(build_trees(docs, ranks, pattern))
    return apply_edits(trees.withColumn("edits", standing_edits()) if edits is None else with_edits(trees, edits), ranks, pattern)
