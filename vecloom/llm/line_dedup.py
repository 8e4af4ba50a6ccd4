"""Line dedup: hashes in ranges, a secondary sort by document and position, first occurrences streamed, keep bitmaps returned.

Documents are in blocks. A block sends each line key's 128-bit hash once, with the first place there that
holds it (document and line), so a line that a third of all rows hold is one row for each block. The hashes are
cut in ranges of equal width, sorted by hash, document and line; a stream over a range meets a hash's first
occurrence first and tells its document to the other blocks that hold it, without keeping any. Each block then
marks the lines that go. Texts are split in pieces, so a long one's lines aren't all held.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLOCK_BYTES, again, in_blocks, keyed, parts_of, plan, shuffle_partitions, strings

SPACE = b" \t\n\r\x0b\x0c"
PIECE = 1 << 20
ENTRY = "h1 long, h2 long, doc_id long, line long, block int"
REPLY = "block int, h1 long, h2 long, first long"
KEPT = "doc_id long, key long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string"


def line_hash(line: bytes, least: int) -> bytes | None:
    """Of a line's key: the line stripped, A-Z lower-cased; None if it has fewer than `least` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def pieces(text: np.ndarray) -> Iterator[list[bytes]]:
    """A text's lines, those of about PIECE bytes at a time."""
    i, n = 0, len(text)
    while n - i > PIECE:
        j = i + PIECE
        while j < n and not (found := text[j : j + PIECE] == 10).any():
            j += PIECE
        if j >= n:
            break
        j += int(found.argmax())
        yield text[i:j].tobytes().split(b"\n")
        i = j + 1
    yield text[i:].tobytes().split(b"\n")


def texts(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each row's id, key and text, in ascending order of ids."""
    data, at = strings(table.column("text"))
    doc, key = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "key"))
    for k in np.argsort(doc, kind="stable").tolist():
        yield int(doc[k]), int(key[k]), data[at[k] : at[k + 1]]


def firsts(table: pa.Table, least: int) -> dict[bytes, tuple[int, int]]:
    """For each hash in a block the smallest document that holds it, and its line there."""
    first: dict[bytes, tuple[int, int]] = {}
    for doc, _, text in texts(table):
        n = 0
        for lines in pieces(text):
            for i, line in enumerate(lines, n):
                h = line_hash(line, least)
                if h is not None and h not in first:
                    first[h] = (doc, i)
            n += len(lines)
    return first


def in_ranges(entries: DataFrame, n: int) -> DataFrame:
    """Entries in n ranges of h1 of equal width; the hashes are uniform, so no sample of them is needed."""
    nth = F.floor((F.shiftright("h1", 32) + F.lit(1 << 31)) * F.lit(n) / F.lit(1 << 32)).cast("int")
    return entries.repartitionById(n, F.least(nth, F.lit(n - 1))).sortWithinPartitions("h1", "h2", "doc_id", "line")


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by hash and document: for all but a hash's first entry, its first document."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, _, block = (np.asarray(c) for c in b.columns)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        known = before is not None and before[:2] == (h1[0], h2[0])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
        first = doc[begin]
        if known:
            new[0] = False
            first[begin == 0] = before[2]
        before = (h1[-1], h2[-1], first[-1])
        later = ~new
        yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (block, h1, h2, first)], ["block", "h1", "h2", "first"])


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, key, n_lines, n_dropped, keep_bitmap and kept_sha256 of each row.

    Keys of at least `least` code points that two documents hold lose their lines but in the smallest of
    them; rows with one doc_id are one document. Null doc_id: the largest id. Null or empty text: one empty line,
    kept. Rows that are the same throughout are worked on once. Empty table: no rows. keep_bitmap: a bit for each
    line, the first highest, compressed by zlib; kept_sha256: of the kept lines joined by a line feed.
    """
    total, rows, several = plan(keyed(docs))
    blocks = in_blocks(rows, parts_of(total, BLOCK_BYTES))

    def entries(table: pa.Table) -> pa.Table:
        first = firsts(table, least)
        h = np.frombuffer(b"".join(first), ">i8").astype(np.int64).reshape(-1, 2)
        place = np.array(list(first.values()), np.int64).reshape(-1, 2)
        block = np.full(len(h), table.column("block")[0].as_py(), np.int32)
        return pa.table({"h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "doc_id": place[:, 0].copy(), "line": place[:, 1].copy(), "block": block})

    def mark(table: pa.Table, reply: pa.Table) -> pa.Table:
        first: dict[bytes, int] = {}
        h = np.stack([np.asarray(reply.column(c)) for c in ("h1", "h2")], 1).astype(">i8").tobytes()
        for k, doc in enumerate(reply.column("first").to_pylist()):
            first[h[16 * k : 16 * k + 16]] = doc
        out: list[tuple] = []
        for doc, key, text in texts(table):
            sha, keep, some = hashlib.sha256(), [], False
            for lines in pieces(text):
                stay = [(x := line_hash(line, least)) is None or first.setdefault(x, doc) >= doc for line in lines]
                keep.append(np.array(stay))
                kept = lines if all(stay) else [line for line, k in zip(lines, stay, strict=True) if k]
                if kept:
                    sha.update(b"\n" * some + b"\n".join(kept))
                    some = True
            keep_ = np.concatenate(keep)
            out.append((doc, key, len(keep_), len(keep_) - int(keep_.sum()), zlib.compress(np.packbits(keep_).tobytes()), sha.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in KEPT.split(", ")]
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    found = in_ranges(blocks.groupBy("block").applyInArrow(entries, ENTRY), shuffle_partitions(docs.sparkSession)).mapInArrow(stream, REPLY)
    return again(blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(mark, KEPT), several)


def kept_lines(text: str | None, bitmap: bytes) -> str:
    """A text without the lines that its bitmap drops."""
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return "\n".join(line for line, k in zip(lines, keep, strict=False) if k)
