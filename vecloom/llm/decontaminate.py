"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of words. A block is the last two words under the search window; a table says
for each block how far the window may shift without missing a test string. Where it says zero, the buckets
of that block's (suffix) hash, told apart by the first words' (prefix) hash, hold the strings that may stand
there, and direct comparison confirms them. Many stretches of text are searched in step, each with a place
of its own. Windows of one length make one set of tables; a shorter item adds a set for its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import NULL_ID, keyed, public_id, settle, slabs, strings

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] in UTF-8 bytes, after A-Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SLAB, LANE, TABLE = 1 << 20, 256, 20
#: Bytes of test strings that one set of tables may hold; more are searched for in several passes.
PATTERN_BYTES = 4 << 20
#: So many words of an item in a row are enough to drop a document, however long it is.
SURE = 8


class Words:
    """The words of some texts, one after another: where each begins and how long it is."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        text = LOWER[data[at[0] : at[-1]]]
        edge = at - at[0]
        inside = np.concatenate([[False], WORD[text], [False]])
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        inner = edge[1:-1]  # words end where texts do
        inner = inner[(inner > 0) & (inner < len(text))]
        first[inner] |= inside[inner + 1]
        last[inner - 1] |= inside[inner]
        self.start = np.flatnonzero(first)
        self.size = np.flatnonzero(last) + 1 - self.start
        self.text = np.concatenate([text, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(text) + 1, "<u8", self.text, strides=(1,))
        self.edge = np.searchsorted(self.start, edge)

    def hash(self, k: np.ndarray) -> np.ndarray:
        """Of words: their length, first and last eight bytes."""
        s, n = self.start[k], self.size[k]
        a = self.eight[s] & MASK[np.minimum(n, 8)]
        b = self.eight[s + np.maximum(n - 8, 0)]
        b = np.where(n > 8, b, a)
        h = (a * K1) ^ ((b * K2) >> np.uint64(7)) ^ (n.astype(np.uint64) * K3)
        return (h ^ (h >> np.uint64(29))) * K2

    def block(self, k: np.ndarray, width: int) -> np.ndarray:
        """Of `width` words from k."""
        h = self.hash(k)
        if width == 2:
            h = (h ^ (h >> np.uint64(31))) * K1 + self.hash(k + 1)
        return (h ^ (h >> np.uint64(33))) * K3

    def whole(self, k: np.ndarray, n: int) -> np.ndarray:
        """Of n words from k, each with its place."""
        h = np.zeros(len(k), np.uint64)
        for j in range(n):
            h = (h ^ self.hash(k + j)) * K1
            h ^= h >> np.uint64(31)
        return h

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "eight"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.eight = np.ndarray(len(self.text) - 7, "<u8", self.text, strides=(1,))

    def joined(self, k: int, n: int) -> bytes:
        text, start, size = self.text, self.start, self.size
        return b" ".join([text[start[i] : start[i] + size[i]].tobytes() for i in range(k, k + n)])


class Tables:
    """Shift tables and suffix buckets for windows of m words each of the patterns, which stay where they are."""

    def __init__(self, patterns: Words, begin: np.ndarray, owner: np.ndarray, m: int):
        """begin: each window's first word; owner: its item. Equal windows share an entry."""
        self.m, self.width, self.patterns = m, min(2, m), patterns
        self.shift = np.full(1 << TABLE, m - self.width + 1, np.uint8 if m < 255 else np.int64)
        for j in range(m - self.width + 1):
            np.minimum.at(self.shift, self.slot(patterns.block(begin + j, self.width)), m - self.width - j)
        suffix, prefix = patterns.block(begin + m - self.width, self.width), patterns.block(begin, self.width)
        self.pair = np.zeros(1 << TABLE, bool)
        self.pair[self.slot(suffix * K1 ^ prefix)] = True
        whole = patterns.whole(begin, m)
        by = np.lexsort((begin, whole, suffix))
        begin, suffix, whole, owner = begin[by], suffix[by], whole[by], owner[by]
        new = np.ones(len(begin), bool)
        new[1:] = (suffix[1:] != suffix[:-1]) | (whole[1:] != whole[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        for i in np.flatnonzero(~new).tolist():  # equal hashes: equal windows, or else an entry of its own
            if patterns.joined(int(begin[i]), m) != patterns.joined(int(begin[first[i]]), m):
                new[i] = True
        head = np.flatnonzero(new)
        self.suffix, self.whole, self.begin = suffix[head], whole[head], begin[head]
        self.owner, self.owners = owner.astype(np.int32), np.append(head, len(begin))

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE)).astype(np.int64)

    def items(self, i: int) -> list[int]:
        return self.owner[self.owners[i] : self.owners[i + 1]].tolist()

    def search(self, words: Words) -> list[tuple[int, int]]:
        """Every occurrence: the first word's place, and which entry."""
        m, w = self.m, self.width
        begin, end = words.edge[:-1], words.edge[1:] - m + 1  # first places of a window, by text
        some = end > begin
        begin, end = begin[some], end[some]
        lanes = -(-(end - begin) // LANE)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        place = np.repeat(begin, lanes) + nth * LANE
        stop = np.minimum(place + LANE, np.repeat(end, lanes))
        likely = []
        while len(place):
            suffix = words.block(place + m - w, w)
            move = self.shift[self.slot(suffix)].astype(np.int64)
            here = np.flatnonzero(move == 0)
            if len(here):
                k, s = place[here], suffix[here]
                some = self.pair[self.slot(s * K1 ^ words.block(k, w))]
                likely.append((k[some], s[some]))
            place = place + np.maximum(move, 1)
            on = place < stop
            place, stop = place[on], stop[on]
        return self.confirm(words, *map(np.concatenate, zip(*likely))) if likely else []

    def confirm(self, words: Words, k: np.ndarray, suffix: np.ndarray) -> list[tuple[int, int]]:
        """Of the places where a window may begin those where one does, by the buckets of their suffixes and direct comparison."""
        bucket, after = np.searchsorted(self.suffix, suffix), np.searchsorted(self.suffix, suffix, "right")
        some = bucket < after
        k, found = k[some], []
        for x, h, i, j in zip(k.tolist(), words.whole(k, self.m), bucket[some].tolist(), after[some].tolist(), strict=True):
            i += int(np.searchsorted(self.whole[i:j], h))
            while i < j and self.whole[i] == h:
                if words.joined(x, self.m) == self.patterns.joined(int(self.begin[i]), self.m):
                    found.append((x, i))
                    break
                i += 1
        return found


class Searcher:
    """Tables for all lengths. The test strings aren't copied: a window is a place in the items' words.

    Memory: about 12 bytes for each byte of the items (pattern_blocks bounds them), and 2 MB for each length.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names, self.window = [i for i, _ in items], window
        texts = [(t or "").encode() for _, t in items]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        words = Words(np.frombuffer(b"".join(texts), np.uint8), at)
        n = np.diff(words.edge)
        length, self.sets = np.minimum(n, window), []
        for m in np.unique(length[length > 0]).tolist():
            which = np.flatnonzero(length == m)
            many = n[which] - m + 1
            begin = np.repeat(words.edge[:-1][which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            self.sets.append(Tables(words, begin, np.repeat(which, many), m))

    def run(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[list[str]]]:
        """For each text: its number of words, how many are hit, the longest window that occurs, which words are hit (bits, empty if none), the items found."""
        if len(at) == 2 and at[1] - at[0] > 2 * SLAB:
            return self.long(data[at[0] : at[1]])
        words = Words(data, at)
        n = len(at) - 1
        hit, longest, items = self.hits(words, n)
        bits = [b""] * n
        for d in items:
            bits[d] = np.packbits(hit[words.edge[d] : words.edge[d + 1]]).tobytes()
        total = np.concatenate([[0], np.cumsum(hit)])
        return np.diff(words.edge), np.diff(total[words.edge]), longest, bits, [sorted(items.get(d, ())) for d in range(n)]

    def hits(self, words: Words, n: int) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Which words are hit; of each text the longest window and the items that occur in it."""
        cover, longest, items = np.zeros(len(words.start) + 1, np.int32), np.zeros(n, np.int64), {}
        for tables in self.sets:
            for k, i in tables.search(words):
                cover[k] += 1
                cover[k + tables.m] -= 1
                d = int(np.searchsorted(words.edge, k, "right")) - 1
                longest[d] = max(longest[d], tables.m)
                items.setdefault(d, set()).update(self.names[x] for x in tables.items(i))
        return np.cumsum(cover[:-1]) > 0, longest, items

    def long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[list[str]]]:
        """run() for one long text, in pieces of about SLAB bytes that share window - 1 words."""
        hit, longest, items = [np.zeros(0, bool)], 0, set()
        begin, shared, size = 0, 0, SLAB  # the piece's first byte; words that it shares with the piece before it
        while begin < len(data):
            end = min(len(data), begin + size)
            while end < len(data) and len(gap := ~WORD[LOWER[data[end : end + SLAB]]]):  # to the end of a word
                if gap.any():
                    end += int(gap.argmax())
                    break
                end += len(gap)
            words = Words(data, np.array([begin, end]))
            n = len(words.start)
            if end < len(data) and 0 < n <= 2 * self.window:  # long words, or few
                size *= 2
                continue
            own, m, found = self.hits(words, 1)
            if shared:
                hit[-1][len(hit[-1]) - shared :] |= own[:shared]
            hit.append(own[shared:].copy())
            longest, items, size = max(longest, int(m[0])), items | found.get(0, set()), SLAB
            if end == len(data):
                break
            shared = min(self.window - 1, n)
            begin = begin + int(words.start[n - shared]) if n else end
        hit = np.concatenate(hit)
        bits = np.packbits(hit).tobytes() if items else b""
        return np.array([len(hit)]), np.array([int(hit.sum())]), np.array([longest]), [bits], [sorted(items)]


def pieces(text: str | None, most: int, window: int) -> Iterator[str | None]:
    """A long item as parts that share window - 1 words, so that each of its windows is in one of them."""
    data = (text or "").encode()
    if len(data) <= most:
        yield text
        return
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    n, i, ends = len(words.start), 0, words.start + words.size
    while i < n:
        j = int(np.searchsorted(ends, words.start[i] + most, "right"))
        j = min(n, max(j, i + window))
        yield data[words.start[i] : ends[j - 1]].decode()
        if j == n:
            return
        i = j - window + 1


def pattern_blocks(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, in blocks of at most `most` bytes of text; a longer item comes in pieces."""
    block, size = [], 0
    for item, whole in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).toLocalIterator():
        for text in pieces(whole, most, window):
            more = len((text or "").encode())
            if block and size + more > most:
                yield block
                block, size = [], 0
            block.append((item, text))
            size += more
    if block:
        yield block


FOUND = "doc_id long, key long, n_words long, n_hit long, hit binary, items array<string>, longest long"


def occurrences(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """One pass over all texts with one set of tables."""
    tables = docs.sparkSession.sparkContext.broadcast(Searcher(items, window))  # at most PATTERN_BYTES of test strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = strings(b.column(2))
            for i, j in slabs(at, SLAB):
                n, n_hit, longest, bits, found = tables.value.run(data, at[i : j + 1])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(n), pa.array(n_hit), pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array(longest)], ["doc_id", "key", "n_words", "n_hit", "hit", "items", "longest"])

    return docs.mapInArrow(run, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """doc_id, key, n_words, n_hit, longest (the most words of a window that occurs, or 0), items (ids whose windows occur, sorted as strings) and contaminated of each row.

    Windows are `window` consecutive words of an item; an item with fewer is one window, with none it has none.
    contaminated: some word is hit and at least `percent` of a hundred are. Null or empty text: no words. A null
    item_id is an empty string, items with one id are one. Empty benchmark: nothing is hit. Larger benchmarks
    than pattern_bytes are searched for in several passes, whose hits are joined.
    """
    rows = keyed(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    blocks = pattern_blocks(benchmark, pattern_bytes, window)
    found = occurrences(rows, next(blocks, []), window)
    more = next(blocks, None)
    if more is not None:  # several passes: each is written, then a row's hits are joined
        passes = [settle(found)]
        while more is not None:
            passes.append(settle(occurrences(rows, more, window)))
            more = next(blocks, None)
        found = passes[0]
        for p in passes[1:]:
            found = found.unionByName(p)
        found = found.groupBy("doc_id", "key").agg(
            F.first("n_words").alias("n_words"), F.collect_list(F.when(F.length("hit") > 0, F.col("hit"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"), (F.count("*") / len(passes)).cast("int").alias("copies"),
        ).withColumn("nth", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "key", "n_words", "hits", "items", "longest").mapInArrow(either, FOUND)
    return found.select("doc_id", "key", "n_words", "n_hit", "longest", "items", "hit", ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))


def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the hits of several passes."""
    for b in batches:
        some = [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in row]).tobytes() if row else b"" for row in b.column(3).to_pylist()]
        hit = pa.array([int.from_bytes(x, "big").bit_count() for x in some], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), hit, pa.array(some, pa.binary()), b.column(4), b.column(5)], ["doc_id", "key", "n_words", "n_hit", "hit", "items", "longest"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, sure: int = SURE, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The rows of docs, all columns, that neither have an occurrence of a window of `sure` words or more nor are contaminated.

    A passage of the benchmark is one in a long document as in a short one, so the share of words hit decides
    only about items of fewer words than `sure`. Where one set of tables will do, one pass and no shuffle.
    """
    blocks = pattern_blocks(benchmark, pattern_bytes, window)
    items = next(blocks, [])
    if next(blocks, None) is not None:
        found = contamination(docs, benchmark, window, percent, pattern_bytes)
        bad = found.where((F.col("longest") >= sure) | F.col("contaminated")).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key"))
        id_, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), F.coalesce(docs["text"].cast("string"), F.lit(""))
        return docs.join(bad, (id_ == bad["bad_id"]) & (F.xxhash64(text) == bad["bad_key"]), "left_anti")
    tables = docs.sparkSession.sparkContext.broadcast(Searcher(items, window))  # at most PATTERN_BYTES of test strings
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = strings(b.column(text))
            for i, j in slabs(at, SLAB):
                n, n_hit, longest, _, _ = tables.value.run(data, at[i : j + 1])
                yield b.slice(i, j - i).filter(pa.array((longest < sure) & ((n_hit == 0) | (100 * n_hit < percent * n))))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """contamination() with the number and hash of the items in their stead."""
    return found.select(
        public_id(), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
