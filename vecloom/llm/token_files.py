"""Token-ID output: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a run of zstandard frames followed by a skippable frame that holds the seek table of the public
seekable format: for each frame its compressed size, its size and the low 32 bits of its XXH64; then the
number of frames, a descriptor byte and a magic number. A document has frames of its own (one for each
FRAME_IDS ids), so a reader decompresses only what it asks for. The last frame is the index: for each
document its id, first frame, number of frames and number of ids.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import keyed, open_folder, public_id, shared_dir, shuffle_partitions, slabs, strings

SEEK_HEAD, SEEK_FOOT, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 20
LEVEL = 1
WORDS_KEPT, SLAB, PART = 600_000, 1 << 20, 1 << 20


#: Where a letter is followed by these, the tokenizer always begins a new piece.
STOPS = ".,!?;:|%#$&*"


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[10] = 32
LETTER, STOP = (np.isin(np.arange(256), list(x)) for x in (range(97, 123), STOPS.encode()))


def ends_in_letter(core: str) -> bool:
    """Whether letters still end in a letter once they are composed and lower-cased (\u0130 doesn't). Other scripts than
    Latin, Greek and Cyrillic aren't judged: the tokenizer's tables may be older or newer than Python's."""
    last = core[-1]
    return last.isascii() or (last < "\u0530" and unicodedata.normalize("NFC", core).lower()[-1].isalpha())


def parts(text: str) -> Iterator[str]:
    """A text cut at spaces, into parts of up to PART characters (more only where there is no space)."""
    i = 0
    while i < len(text):
        j = len(text) if len(text) - i <= PART else text.rfind(" ", i + 1, i + PART)
        if j < 0:
            j = text.find(" ", i + PART)
            j = len(text) if j < 0 else j
        yield text[i:j]
        i = j


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, lower-cases and marks the ends of pieces.

    Such a tokenizer encodes a text as it encodes what stands between its spaces, one after another; a-z and what
    is in STOPS after it may be told apart, and A-Z lower-cased, before. Each distinct such word goes through the
    library once while it is remembered; at most WORDS_KEPT are. New words of letters go in one call, and the ids
    that end a piece tell them apart again. A text with `<|` is encoded as it is, for it may hold special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def letters(self, words: list[str]) -> None:
        """Learn words all of whose characters are letters."""
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = self.encode(" ".join(some))
            end = np.flatnonzero(self.ends[ids]) + 1
            data = ids.tobytes()
            if len(end) != len(some):
                self.known.update((w, self.encode(w).tobytes()) for w in some)
            else:
                at = (4 * np.concatenate([[0], end])).tolist()
                self.known.update((w, data[a:b]) for w, a, b in zip(some, at, at[1:]))

    def learn(self, words: list[str]) -> None:
        known = self.known
        self.letters([w for w in words if w.isalpha()])
        for w in words:
            if w not in known:
                c = w.rstrip(STOPS)
                if c.isalpha() and ends_in_letter(c):
                    known[w] = self.encode(c).tobytes() + self.encode(w[len(c) :]).tobytes()
                else:
                    known[w] = self.encode(w).tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. A long text goes in parts."""
        text = texts[0].as_py() if len(texts) == 1 else ""
        if len(text) > PART and "<|" not in text:
            found = [self.some(pa.array([x], pa.large_string()))[0] for x in parts(text)]
            return np.concatenate(found), np.array([sum(map(len, found))])
        special = np.asarray(pc.match_substring(texts, "<|"))
        if not special.any():
            return self.some(texts)
        each = [self.encode(t.as_py()) if s else self.some(texts.slice(k, 1))[0] for k, (t, s) in enumerate(zip(texts, special.tolist(), strict=True))]
        return np.concatenate(each), np.array([len(x) for x in each])

    def some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids() for texts without special tokens: words by Arrow's dictionary, ids gathered by word."""
        data, at = strings(texts)
        low = LOWER[data[at[0] : at[-1]]]
        gap = LETTER[low[:-1]] & STOP[low[1:]]
        edge = (at - at[0])[1:-1]
        gap[edge[(edge > 0) & (edge < len(low))] - 1] = False
        where = np.flatnonzero(gap) + 1
        spaced = np.insert(low, where, 32)
        at = at - at[0] + np.searchsorted(where, at - at[0])
        words = pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(spaced)), " ")
        coded = words.flatten().dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = distinct
        self.learn(new)
        found = [known[w] for w in distinct]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        word = coded.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[word] - end[:-1], n) + np.arange(end[-1])]
        return ids, np.diff(end[np.asarray(words.offsets)])


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


class FrameWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.table, self.index = out, width, [], []
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)

    def frame(self, data: bytes) -> None:
        packed = self.zip.compress(data)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)

    def document(self, doc_id: int, ids: np.ndarray) -> None:
        first = len(self.table)
        for i in range(0, len(ids), FRAME_IDS):
            self.frame(ids[i : i + FRAME_IDS].astype(f"<u{self.width}").tobytes())
        self.index.append((doc_id, first, len(self.table) - first, len(ids)))

    def close(self) -> None:
        self.frame(struct.pack("<QQ", len(self.index), self.width) + np.array(self.index, "<i8").tobytes())
        body = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_FOOT)
        self.out.write(struct.pack("<II", SEEK_HEAD, len(body)) + body)


class FrameReader:
    """Random access to one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, _, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_FOOT:
            raise ValueError("no seek table")
        head = size - 17 - 12 * frames
        if struct.unpack("<II", self.at(head, 8)) != (SEEK_HEAD, 12 * frames + 9):
            raise ValueError("a broken seek table")
        self.table = np.frombuffer(self.at(head + 8, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.unzip = zstandard.ZstdDecompressor()
        index = self.frame(frames - 1)
        n, self.width = struct.unpack("<QQ", index[:16])
        self.documents = np.frombuffer(index, "<i8", offset=16).reshape(n, 4)

    def at(self, where: int, n: int) -> bytes:
        self.source.seek(where)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.table[k].tolist()
        data = self.unzip.decompress(self.at(int(self.begin[k]), packed), max_output_size=size) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in that row of the index."""
        _, first, count, _ = self.documents[row].tolist()
        return np.frombuffer(b"".join(self.frame(k) for k in range(first, first + count)), f"<u{self.width}").astype("<u4")


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write all documents' ids, each followed by end_id, as files in ascending doc_id order; the folder and its manifest.

    Null or empty text: the end id alone. Rows that share a doc_id stay next to each other, ordered by a
    hash of the text. Null doc_id: last. Empty table: no files. The files are in the order of `part`. A task
    that runs again writes a file of another name; only what the manifest names counts.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    place, root = open_folder(folder)
    place.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words = TaskContext.get(), encoder(tokenizer)
        where, base = open_folder(folder)
        path, out, files, total = "", None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
                out = where.open_output_stream(path, compression=None)
                files = FrameWriter(out, words.width)
            _, at = strings(batch.column(1))
            for i, j in slabs(at, SLAB):
                part = batch.slice(i, j - i)
                ids, n = words.ids(part.column(1))
                end = np.cumsum(n)
                ids = np.insert(ids, end, end_id)
                for doc_id, a, b in zip(part.column(0).to_pylist(), (end - n + np.arange(len(n))).tolist(), (end + np.arange(1, len(n) + 1)).tolist(), strict=True):
                    files.document(doc_id, ids[a:b])
                total += len(ids)
        if out is not None:
            files.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path], "n_docs": [len(files.index)], "n_tokens": [total]})

    ordered = (
        keyed(docs)
        .repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text"))  # rows of one id may go to several files
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    parts = ordered.mapInArrow(write, MANIFEST).collect()  # a row for each file
    return folder, spark.createDataFrame(sorted(parts), MANIFEST)


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 and file of every document."""
    spark, start, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect()):
        rows.append((r.path, start))
        start += r.n_tokens
    files = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = open_folder(folder)
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with where.open_input_file(path) as source:
                    f = FrameReader(source)
                    n = f.documents[:, 3]
                    crc = [zlib.crc32(f.ids(i)) for i in range(len(n))]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(f.documents[:, 0]), "start": pa.array(at + np.cumsum(n) - n), "n_tokens": pa.array(n),
                        "ids_crc32": pa.array(crc, pa.int64()), "file": [path.rpartition("/")[2]] * len(n),
                    })

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def tokens_of(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs' token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder, manifest = write_token_files(docs, tokenizer, end_id)
    return read_token_files(folder, manifest).select(public_id(), "start", "n_tokens", "ids_crc32")
