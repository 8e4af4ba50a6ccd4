"""Files of vectors: records of a little-endian 32-bit length and so many values, as a Spark data source.

spark.dataSource.register(VecsSource), then format("vecs") with option dtype: f32, i32, u8 or u64 (u64 comes as
signed). Rows are ordinal and vec. Where all records have the first one's length, a file is read in splits of
whole records; with option ragged=true it is read by one task. A record cut short is an error, or with option
tolerant=true the end. With options first and count only so many records from that ordinal are read: of records of
one length no others' bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

DTYPES = {"f32": ("<f4", "float"), "i32": ("<i4", "int"), "u8": ("u1", "int"), "u64": ("<i8", "bigint")}
SPLIT = 16 << 20


def dimension(path: str) -> int:
    """The first record's length."""
    with open(path, "rb") as f:
        head = f.read(4)
    if len(head) < 4:
        raise ValueError(f"{path} is empty")
    return struct.unpack("<I", head)[0]


def decode(data: bytes, dtype: str, tolerant: bool = False) -> Iterator[np.ndarray]:
    """Records of any lengths."""
    kind, at = np.dtype(DTYPES[dtype][0]), 0
    while at + 4 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        if at + 4 + n * kind.itemsize > len(data):
            if tolerant:
                return
            raise ValueError("a record is cut short")
        yield np.frombuffer(data, kind, n, at + 4)
        at += 4 + n * kind.itemsize
    if at != len(data) and not tolerant:
        raise ValueError("a record's length is cut short")


def encode(vectors: Iterator, dtype: str) -> bytes:
    kind = np.dtype(DTYPES[dtype][0])
    rows = [np.asarray(v).astype(kind) for v in vectors]
    return b"".join(struct.pack("<I", len(v)) + v.tobytes() for v in rows)


class Split(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int):
        self.path, self.begin, self.end, self.first = path, begin, end, first


def files(path: str) -> list[str]:
    return sorted(os.path.join(path, x) for x in os.listdir(path) if x[0] not in "._") if os.path.isdir(path) else [path]


class VecsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.dtype, self.paths = options.get("dtype", "f32"), files(options["path"])
        self.ragged, self.tolerant = (options.get(x, "false").lower() == "true" for x in ("ragged", "tolerant"))
        self.first = max(0, int(options.get("first", 0)))
        self.last = self.first + max(0, int(options["count"])) if "count" in options else 1 << 62

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for path in self.paths:
            size = os.path.getsize(path)
            if not size:
                continue
            record = 4 + dimension(path) * np.dtype(DTYPES[self.dtype][0]).itemsize
            if self.ragged or size % record:
                if not self.ragged and not self.tolerant:
                    raise ValueError(f"{path}: {size} bytes aren't records of {record}")
                out.append(Split(path, 0, size, first))
                first += size // record
                continue
            n = size // record
            begin, end = (min(max(x - first, 0), n) * record for x in (self.first, self.last))
            step = max(1, SPLIT // record) * record
            out += [Split(path, i, min(end, i + step), first + i // record) for i in range(begin, end, step)]
            first += n
        return out or [Split(self.paths[0] if self.paths else "", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        data = b""
        if split.end > split.begin:
            with open(split.path, "rb") as f:
                f.seek(split.begin)
                data = f.read(split.end - split.begin)
        rows = list(decode(data, self.dtype, self.tolerant))
        begin = min(max(self.first - split.first, 0), len(rows))  # of ragged files; others' splits are cut
        rows, split.first = rows[begin : max(begin, self.last - split.first)], split.first + begin
        if not self.ragged and not self.tolerant and any(len(r) != len(rows[0]) for r in rows):
            raise ValueError(f"{split.path}: records of several lengths; set ragged")
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0)
        kind = {"float": pa.float32(), "int": pa.int32(), "bigint": pa.int64()}[DTYPES[self.dtype][1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(split.first, split.first + len(rows))), pa.ListArray.from_arrays(pa.array(at), pa.array(flat).cast(kind))], ["ordinal", "vec"])


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class VecsWriter(DataSourceWriter):
    """A file for each task, named by the task; a task that fails removes its own, an aborted job those of tasks that had ended."""

    def __init__(self, options: dict, schema):
        self.dtype, self.root = options.get("dtype", "f32"), options["path"]
        self.column = schema.names.index("vec")

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, path, out = TaskContext.get(), None, None
        try:
            for r in rows:
                if out is None:
                    os.makedirs(self.root, exist_ok=True)
                    path = os.path.join(self.root, f".part-{task.partitionId():06d}-{task.taskAttemptId()}.vecs")
                    out = open(path, "wb")  # noqa: SIM115
                out.write(encode([r[self.column]], self.dtype))
        except BaseException:  # this attempt's file has no message that would name it
            if out is not None:
                out.close()
                os.remove(path)
            raise
        if out is not None:
            out.close()
        return Written(path)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None and m.path:
                os.replace(m.path, os.path.join(os.path.dirname(m.path), os.path.basename(m.path)[1:]))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return f"ordinal bigint, vec array<{DTYPES[self.options.get('dtype', 'f32')][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return VecsReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VecsWriter(self.options, schema)


def read_vecs(spark: SparkSession, path: str, dtype: str = "f32", **options: str) -> DataFrame:
    spark.dataSource.register(VecsSource)
    return spark.read.format("vecs").options(path=path, dtype=dtype, **options).load()


def write_vecs(df: DataFrame, path: str, column: str, dtype: str = "f32", order: str | None = None) -> None:
    """The column's vectors as files under path, one for each task; by `order`, the files' names and their rows follow it."""
    df.sparkSession.dataSource.register(VecsSource)
    if order:
        df = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    df.selectExpr("0L as ordinal", f"{column} as vec").write.format("vecs").mode("append").options(path=path, dtype=dtype).save()
