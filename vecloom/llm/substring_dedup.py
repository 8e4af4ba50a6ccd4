"""Suffix-array dedup: bytes that a long string of a smaller document covers go.

Suffixes can't be sorted by themselves for all documents at once, so equal strings are brought together in
shards first. Every window of LENGTH bytes has an anchor, the K-byte string in it with the smallest hash;
equal windows have equal anchors. Blocks of documents send the hashes of their anchors; those that occur once
only are of no use. For the others a block sends the stretch of text whose windows have that anchor, once
for each different stretch however often it has it, with its first and last document, to the anchor's shard. A
shard sorts the suffixes of its stretches by induced sorting, takes from the permuted common prefixes which
windows are equal, and so the smallest document that has each, and tells the blocks; each goes over its texts
again and drops the windows that a smaller document has.

An anchor with more than HOT occurrences doesn't stay in one shard: its windows go to shards of their own, by
their content, each one once for every block that has it. Texts are gone over in slices of SLAB bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from vecloom.llm.common import BLOCK_BYTES, again, ends, in_blocks, keyed, parts_of, plan, slabs, strings
from vecloom.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, K = 50, 20
HOT, PIECE, SLAB, CHUNK, SHARD_BYTES, MERGED, HELD = 1 << 14, 64, 1 << 16, 1 << 19, 4 << 20, 1 << 20, 1 << 19
LEAST_PARTS, LARGER_BLOCKS, LARGER_SHARDS = 64, 4, 2
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
U32, U64 = np.uint32, np.uint64

ANCHORS = "bucket int, block int, hashes binary, counts binary"
SHARED = "block int, bucket int, hashes binary, hot binary"
STRETCHES = "shard int, block int, text binary, sizes binary, keys binary, hot binary, low binary, high binary"
REPLY = np.dtype([("key", "<u8"), ("name", "<u8"), ("first", "<u4"), ("last", "<u4"), ("least", "<i8"), ("hot", "?")])
STRETCH = np.dtype([("key", "<u8"), ("name", "<u8"), ("begin", "<i8"), ("low", "<i8"), ("high", "<i8"), ("size", "<u4"), ("hot", "?")])
MARKS = "block int, reply binary"
KEPT = "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * MIX
    return h ^ (h >> U64(29))


def power(n: int) -> np.uint64:
    return U64(pow(BASE, n, 1 << 64))


def runs(data: np.ndarray, edge: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that have one anchor: first and last window, and the anchor's hash. None crosses an edge."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(U64)
    h = {1: data.astype(U64) + U64(1)}
    size = 1
    while size * 2 <= k:
        h[size * 2] = h[size][:-size] * power(size) + h[size][size:]
        size *= 2
    g, have = h[size], size
    for s in sorted(h, reverse=True)[1:]:
        if have + s <= k:
            g, have = g[: n - have - s + 1] * power(s) + h[s][have : have + len(g)][: n - have - s + 1], have + s
    low, size, wide = mix(g), 1, length - k + 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :]) if wide > size else low
    step = np.zeros(len(low) + 1, np.int32)
    begin, stop = edge[:-1], edge[1:] - length + 1
    some = stop > begin
    np.add.at(step, begin[some], 1)
    np.add.at(step, stop[some], -1)
    valid = np.cumsum(step[:-1]) > 0
    starts = np.zeros(len(low), bool)
    starts[1:] = low[1:] != low[:-1]
    starts[1:] |= valid[1:] & ~valid[:-1]
    starts[begin[some]] = True
    first = np.flatnonzero(starts & valid)
    if not len(first):
        return none, none, none.view(U64)
    ends = np.zeros(len(low), bool)
    ends[:-1] = (starts[1:] & valid[1:]) | (valid[:-1] & ~valid[1:])
    ends[-1] = True
    last = np.flatnonzero(ends & valid)
    pieces = (last - first) // PIECE + 1
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = np.repeat(first, pieces) + nth * PIECE
    return a, np.minimum(a + PIECE - 1, np.repeat(last, pieces)), mix(low[a] ^ MIX)


def slices(data: np.ndarray, edge: np.ndarray, length: int, k: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """runs() of some texts: where each slice begins, its bytes and its runs. A long text comes in slices that share what a window needs."""
    for i, j in slabs(edge, SLAB):
        begin, end = int(edge[i]), int(edge[j])
        if j - i > 1 or end - begin <= 2 * SLAB:
            yield begin, data[begin:end], runs(data[begin:end], edge[i : j + 1] - begin, length, k)
            continue
        for a in range(begin, end - length + 1, SLAB):
            part = data[a : min(a + SLAB + length - 1, end)]
            yield a, part, runs(part, np.array([0, len(part)]), length, k)


def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows by id, then the key of their text: ids, keys, bytes and edges. The same for any order of its rows."""
    doc, key = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "key"))
    by = np.lexsort((key, doc))
    text = table.column("text").combine_chunks()
    data, at = strings(text if len(by) == 1 else text.take(pa.array(by)))
    return doc[by], key[by], data[at[0] : at[-1]], at - at[0]


def pack(**columns) -> pa.Table:
    return pa.table({n: x if isinstance(x, pa.Array) else pa.array(x) for n, x in columns.items()})


def join(chunks: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(chunks), dtype)


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def cut(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    return binary([values[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)])


def packed(column: pa.Array) -> pa.Array:
    """Values compressed, for the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    return binary([z.compress(x.as_py()) for x in column])


def unpacked(column: pa.ChunkedArray) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x.as_py()) for x in column]


def pieces(part: np.ndarray, first: np.ndarray, last: np.ndarray, warm: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """What is looked up of these runs, whole ones or each window of a hot one: the run's place, begin, end, name."""
    n = np.where(warm, last - first + 1, 1)
    of = np.repeat(np.arange(len(n)), n)
    begin = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    end = np.where(warm[of], begin, last[of]) + length
    text, digest = part.tobytes(), xxhash.xxh64_intdigest
    return of, begin, end, np.fromiter((digest(text[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)), U64, len(of))


def distinct(found: np.ndarray) -> np.ndarray:
    """Each different stretch once (its text decides its key), with the first and last document of those that are equal."""
    by = np.argsort(found["name"], kind="stable")
    name, key = found["name"][by], found["key"][by]
    head = np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])])[: len(by)]
    e = np.flatnonzero(head)
    out = found[by[e]]
    out["high"] = found["high"][by[np.append(e[1:], len(by)) - 1]] if len(e) else out["high"]
    return out


def edges(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1, [len(sorted_)]]) if len(sorted_) else np.zeros(1, np.int64)


class Dedup:
    """What the steps share; `buckets` and `shards` follow the size of the input."""

    def __init__(self, shards: int, length: int, k: int, hot: int):
        self.shards, self.length, self.k, self.hot = shards, length, k, hot

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket and the hash's upper half in one number."""
        return ((hashes % U64(self.shards)) << U64(32)) | (hashes >> U64(32))

    def anchors(self, table: pa.Table) -> pa.Table:
        """How often a block has each of its anchors, by bucket."""
        _, _, data, edge = ordered(table)
        key, count = np.zeros(0, U64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        for last, found in ends(slices(data, edge, self.length, self.k)):
            held += [] if found is None else [self.keys(found[2][2])]
            if held and (last or sum(map(len, held)) > MERGED):
                new, n = np.unique(np.concatenate(held), return_counts=True)
                both, where = np.unique(np.concatenate([key, new]), return_inverse=True)
                key, count, held = both, np.bincount(where, np.concatenate([count, n]), len(both)).astype(np.int64), []
        bucket = (key >> U64(32)).astype(np.int32)
        e = edges(bucket)
        return pack(
            bucket=bucket[e[:-1]], block=np.full(len(e) - 1, table.column("block")[0].as_py(), np.int32),
            hashes=cut(key.astype(U32), e), counts=cut(np.minimum(count, 65535).astype(np.uint16), e),
        )

    def shared(self, table: pa.Table) -> pa.Table:
        """Of a bucket's anchors those that occur more than once, for each block that has them."""
        hashes, counts = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
        block = np.repeat(np.asarray(table.column("block").combine_chunks()), [len(x) // 4 for x in hashes])
        h, n = join(hashes, U32), join(counts, np.uint16)
        by = np.argsort(h, kind="stable")
        e = edges(h[by])
        total = np.repeat(np.add.reduceat(n[by], e[:-1], dtype=np.int64), np.diff(e)) if len(h) else n.astype(np.int64)
        some = total > 1
        h, block, hot = h[by][some], block[by][some], total[some] > self.hot
        by = np.argsort(block, kind="stable")
        e = edges(block[by])
        return pack(
            block=block[by][e[:-1]].astype(np.int32), bucket=np.full(len(e) - 1, table.column("bucket")[0].as_py(), np.int32),
            hashes=cut(h[by], e), hot=cut(hot[by], e),
        )

    def stretches(self, table: pa.Table, shared: pa.Table) -> pa.Table:
        """A block's stretches that have a shared anchor, each different one once, with the first and last document that has it; by shard."""
        n_of = [len(x) // 4 for x in shared.column("hashes").to_pylist()]
        key = (np.repeat(np.asarray(shared.column("bucket").combine_chunks()), n_of).astype(U64) << U64(32)) | join(shared.column("hashes").to_pylist(), U32)
        hot = join(shared.column("hot").to_pylist(), bool)
        by = np.argsort(key)
        key, hot = key[by], hot[by]
        doc, _, data, edge = ordered(table)
        block = table.column("block")[0].as_py()
        kept, held, sent = np.zeros(0, STRETCH), [], []  # documents come in ascending order
        for over, found in ends(slices(data, edge, self.length, self.k) if len(key) else iter(())):
            if not over:
                base, part, (first, last, h) = found
                own = self.keys(h)
                where = np.minimum(np.searchsorted(key, own), len(key) - 1)
                hit = np.flatnonzero(key[where] == own)
                warm = hot[where[hit]]
                of, begin, end, names = pieces(part, first[hit], last[hit], warm, self.length)
                new = np.zeros(len(of), STRETCH)
                new["key"], new["name"], new["hot"] = own[hit][of], names, warm[of]
                new["begin"], new["size"] = base + begin, end - begin
                new["low"] = new["high"] = doc[np.searchsorted(edge, base + first[hit], "right") - 1][of]
                held.append(new)
            if held and (over or sum(map(len, held)) > HELD):
                kept, held = distinct(np.concatenate([kept, *held])), []
            if over or len(kept) > HELD:
                sent.append(self.by_shard(data, kept, block))
                kept = kept[:0]
        return pa.concat_tables(sent)

    def by_shard(self, data: np.ndarray, found: np.ndarray, block: int) -> pa.Table:
        """A row for each shard with the stretches that go there."""
        shard = (mix(np.where(found["hot"], found["name"], found["key"])) % U64(self.shards)).astype(np.int32)
        by = np.lexsort((found["begin"], shard))
        found, e = found[by], edges(shard[by])
        raw = memoryview(data)
        texts = [raw[i:j] for i, j in zip(found["begin"].tolist(), (found["begin"] + found["size"]).tolist(), strict=True)]
        return pack(
            shard=shard[by][e[:-1]], block=np.full(len(e) - 1, block, np.int32),
            text=packed(binary([b"".join(texts[i:j]) for i, j in zip(e[:-1], e[1:], strict=True)])),
            sizes=packed(cut(found["size"], e)), keys=packed(cut(found["key"], e)), hot=packed(cut(found["hot"], e)), low=packed(cut(found["low"], e)), high=packed(cut(found["high"], e)),
        )

    def smallest(self, texts: list[bytes], docs: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        """For each window of these stretches the smallest document that has it, into `out` from `at`."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.frombuffer(b"\xff".join(texts) + b"\xff\xfe", np.uint8) + np.uint8(2)  # \xff becomes 1 and the end 0
        start = np.cumsum(size + 1) - size - 1
        of = np.repeat(np.arange(len(texts)), size + 1)
        sa = suffix_array(text)
        plcp = permuted_prefixes(text, sa, self.length)
        sa = sa[sa < len(of)]
        window = sa - start[of[sa]] + self.length <= size[of[sa]]
        sa = sa[window]  # windows that are equal stay next to each other
        head = plcp[sa] < self.length
        e = np.flatnonzero(head)
        least = np.repeat(np.minimum.reduceat(docs[of[sa]], e), np.diff(np.append(e, len(sa))))
        out[at[of[sa]] + sa - start[of[sa]]] = least

    def marks(self, table: pa.Table) -> pa.Table:
        """For each block the windows of its stretches that a document smaller than its last one with them has, and the smallest that has them."""
        column = {c: unpacked(table.column(c)) for c in ("text", "sizes", "keys", "hot", "low", "high")}
        index: dict[tuple[int, bytes], int] = {}
        which = []
        for text, sizes, keys in zip(*(column[c] for c in ("text", "sizes", "keys")), strict=True):
            stop = np.cumsum(np.frombuffer(sizes, U32), dtype=np.int64).tolist()
            which.append(np.array([index.setdefault((k, text[i:j]), len(index)) for k, i, j in zip(np.frombuffer(keys, U64).tolist(), [0, *stop], stop)], np.int64))
        block = np.repeat(np.asarray(table.column("block").combine_chunks()), list(map(len, which)))
        which, hot, low, high = np.concatenate(which), join(column["hot"], bool), join(column["low"], np.int64), join(column["high"], np.int64)
        texts, keys = [x for _, x in index], np.fromiter((k for k, _ in index), U64, len(index))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        windows = size - self.length + 1
        at = np.cumsum(windows) - windows
        own, warm = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), bool)
        np.minimum.at(own, which, low)
        warm[which] = hot
        least = np.repeat(own, windows)  # right for an anchor with one stretch
        names, named = np.zeros(len(texts), U64), np.zeros(len(texts), bool)

        def name(some: np.ndarray) -> None:
            some = np.unique(some[~named[some]])
            names[some] = [xxhash.xxh64_intdigest(texts[i]) for i in some.tolist()]
            named[some] = True

        name(np.flatnonzero(warm))
        group = np.where(warm, names, keys)
        by = np.argsort(group, kind="stable")
        e = edges(group[by])
        many = np.flatnonzero(np.diff(e) > 1)
        chunk: list[int] = []
        held = 0
        for g in many.tolist():
            some = by[e[g] : e[g + 1]].tolist()
            more = sum(len(texts[k]) for k in some)
            if chunk and held + more > CHUNK:
                self.smallest([texts[k] for k in chunk], own[chunk], least, at[chunk])
                chunk, held = [], 0
            chunk += some
            held += more
        if chunk:
            self.smallest([texts[k] for k in chunk], own[chunk], least, at[chunk])
        out, of = [], []
        for i in range(0, len(which), 1 << 16):
            w = which[i : i + (1 << 16)]
            n = windows[w]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            here = least[np.repeat(at[w], n) + nth]
            gone = here < np.repeat(high[i : i + (1 << 16)], n)
            begins = gone & np.concatenate([[True], ~gone[:-1] | (nth[1:] == 0) | (here[1:] != here[:-1])])
            stops = gone & np.concatenate([begins[1:] | ~gone[1:] | (nth[1:] == 0), [True]])
            b, s = np.flatnonzero(begins), np.flatnonzero(stops)
            occ = np.repeat(np.arange(len(w)), n)[b]
            name(w[occ])
            rows = np.zeros(len(b), REPLY)
            rows["key"], rows["name"], rows["hot"] = keys[w[occ]], names[w[occ]], warm[w[occ]]
            rows["first"], rows["last"], rows["least"] = nth[b], nth[s], here[b]
            out.append(rows)
            of.append(block[i + occ])
        rows, of = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out, REPLY), (of, np.int32)))
        by = np.argsort(of, kind="stable")
        e = edges(of[by])
        return pack(block=of[by][e[:-1]].astype(np.int32), reply=packed(cut(rows[by], e)))

    def remove(self, table: pa.Table, marks: pa.Table) -> pa.Table:
        """What is left of a block's documents."""
        doc, row_key, data, edge = ordered(table)
        replies = np.concatenate([np.frombuffer(x, REPLY) for x in unpacked(marks.column("reply"))] or [np.zeros(0, REPLY)])
        some, where = np.unique(replies["key"], return_index=True)
        hot = replies["hot"][where]
        replies = replies[np.lexsort((replies["first"], replies["name"]))]
        spans: list[list[int]] = [[] for _ in doc]
        for base, part, (first, last, h) in slices(data, edge, self.length, self.k) if len(some) else ():
            own = self.keys(h)
            where = np.minimum(np.searchsorted(some, own), len(some) - 1)
            hit = np.flatnonzero(some[where] == own)
            back, at, _, names = pieces(part, first[hit], last[hit], hot[where[hit]], self.length)
            keys = own[hit][back]
            lo, hi = np.searchsorted(replies["name"], names), np.searchsorted(replies["name"], names, "right")
            n = hi - lo
            of = np.repeat(np.arange(len(n)), n)
            found = replies[lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
            row = np.searchsorted(edge, base + at[of], "right") - 1
            gone = (found["key"] == keys[of]) & (found["least"] < doc[row])
            begin = base + at[of] - edge[row] + found["first"]
            end = begin + (found["last"].astype(np.int64) - found["first"]) + self.length
            for r, i, j in zip(row[gone].tolist(), begin[gone].tolist(), end[gone].tolist(), strict=True):  # beginnings ascend
                mine = spans[r]
                if mine and i <= mine[-1]:
                    mine[-1] = max(mine[-1], j)
                else:
                    mine += (i, j)
        digests, removed = [], []
        for i, j, mine in zip(edge[:-1].tolist(), edge[1:].tolist(), spans, strict=True):
            sha, at = hashlib.sha256(), i
            for a, b in zip(mine[::2], mine[1::2]):
                sha.update(data[at : i + a])
                at = i + b
            sha.update(data[at:j])
            digests.append(sha.hexdigest())
            removed.append(sum(mine[1::2]) - sum(mine[::2]))
        return pack(
            doc_id=doc, key=row_key, n_bytes=np.diff(edge), n_removed=np.array(removed, np.int64), n_spans=np.array([len(x) // 2 for x in spans], np.int64), kept_sha256=digests,
            spans=pa.array(spans, pa.list_(pa.int64())),
        )


def part_bytes(total: int, least: int, larger: int) -> int:
    """The size of a part: `least`, in large tables up to `larger` times that. Every block has a row for every shard in
    four exchanges, so parts of one size make these rows grow with the square of the table."""
    return min(max(least, total // LEAST_PARTS), least * larger)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, key, n_bytes, n_removed, n_spans, kept_sha256 and spans (where the removed runs begin and end) of each row.

    A byte goes if a `length`-byte string that covers it also starts in a document with a smaller doc_id; rows
    with one doc_id are one document to each other. Null doc_id: the largest id. Null or empty text: nothing to
    remove. Rows that are the same throughout are worked on once. Empty table: no rows.
    """
    total, rows, several = plan(keyed(docs))
    blocks = in_blocks(rows, parts_of(total, part_bytes(total, BLOCK_BYTES, LARGER_BLOCKS)))
    job = Dedup(parts_of(total, part_bytes(total, SHARD_BYTES, LARGER_SHARDS)), length, k, hot)
    by_block = blocks.groupBy("block")
    shared = by_block.applyInArrow(lambda t: job.anchors(t), ANCHORS).groupBy("bucket").applyInArrow(lambda t: job.shared(t), SHARED)
    marks = by_block.cogroup(shared.groupBy("block")).applyInArrow(lambda t, r: job.stretches(t, r), STRETCHES).groupBy("shard").applyInArrow(lambda t: job.marks(t), MARKS)
    return again(by_block.cogroup(marks.groupBy("block")).applyInArrow(lambda t, r: job.remove(t, r), KEPT), several)
