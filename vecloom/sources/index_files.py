"""An index as six files of vectors, read and written in ranges of rows by many tasks.

base.fvecs: the padded vectors in index order. orthogonal.fvecs: the rotation's rows. centroids.fvecs: the
rotated centroids, one record for each dimension. offsets_ids.ivecs: where each cluster begins, and the end;
then the row numbers in index order. factors.fvecs: one record, four values for each row. x_binary_vec.u64vecs:
one record, the words of all codes. All records have known lengths, so a task reads or writes its rows at
their place; a task that runs again writes the same bytes there. The folder must be one that all tasks share.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.kernels import lists, matrix
from vecloom.operators import cluster
from vecloom.operators.index import Index
from vecloom.sources.vecs import decode, encode

FACTORS = ("factor_ip", "factor_ppc", "error_bound", "center_distance_square")
BASE, TURN, CENTRES, IDS, VALUES, CODES = "base.fvecs", "orthogonal.fvecs", "centroids.fvecs", "offsets_ids.ivecs", "factors.fvecs", "x_binary_vec.u64vecs"
ROWS = 1 << 16


def small(path: str, name: str) -> np.ndarray:
    with open(os.path.join(path, name), "rb") as f:
        return np.array(list(decode(f.read(), "f32")), np.float64)


def values(path: str, name: str, at: int, n: int, dtype: str) -> np.ndarray:
    """n values from a place in a file."""
    return np.fromfile(os.path.join(path, name), dtype, n, offset=at)


def download(uri: str, path: str, names: tuple[str, ...] = (TURN, CENTRES, IDS, VALUES, CODES)) -> list[str]:
    """Copy the index's files, but the vectors, from any file system that pyarrow knows; those that are here already stay.

    A file has its name once it is whole. Gives the names that were copied.
    """
    place, root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    os.makedirs(path, exist_ok=True)
    copied = []
    for name in names:
        to = os.path.join(path, name)
        if os.path.exists(to):
            continue
        part = f"{to}.{uuid.uuid4().hex}"
        with place.open_input_stream(f"{root.rstrip('/')}/{name}", compression=None) as source, open(part, "wb") as f:
            shutil.copyfileobj(source, f, 16 << 20)
        os.replace(part, to)
        copied.append(name)
    return copied


def load_index_files(spark: SparkSession, path: str) -> Index:
    """codes (with pos, the place in index order) and base as tables; vec_id is the row number of the original file.

    Only a use of base reads the vectors' file.
    """
    turn, centres = small(path, TURN), small(path, CENTRES).T
    dim = len(turn)
    if dim % 64:
        raise ValueError(f"{dim} dimensions aren't a multiple of 64")
    with open(os.path.join(path, IDS), "rb") as f:
        k = struct.unpack("<I", f.read(4))[0]
        offsets = np.frombuffer(f.read(4 * k), "<u4").astype(np.int64)
    n, words, after = int(offsets[-1]), dim // 64, 4 + 4 * k + 4

    def own(i: int, m: int) -> list[pa.Array]:
        place = np.arange(i, i + m)
        return [pa.array((np.searchsorted(offsets, place, "right") - 1).astype(np.int32)), pa.array(values(path, IDS, after + 4 * i, m, "<u4").astype(np.int64))]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                m = min(ROWS, n - i)
                factors = values(path, VALUES, 4 + 16 * i, 4 * m, "<f4").reshape(m, 4).astype(np.float64)
                code = lists(values(path, CODES, 4 + 8 * words * i, words * m, "<i8").reshape(m, words))
                yield pa.RecordBatch.from_arrays([*own(i, m), code, *[pa.array(factors[:, j]) for j in range(4)], pa.array(np.arange(i, i + m))], ["cluster_id", "vec_id", "code", *FACTORS, "pos"])

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                m = min(ROWS, n - i)
                rows = values(path, BASE, i * (4 + 4 * dim), m * (dim + 1), "<f4").reshape(m, dim + 1)[:, 1:].astype(np.float64)
                yield pa.RecordBatch.from_arrays([*own(i, m), lists(rows)], ["cluster_id", "vec_id", "embedding"])

    starts = spark.range(0, n, ROWS).repartition(max(1, -(-n // ROWS)))
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster_id int, centroid array<double>")
    shape = "cluster_id int, vec_id bigint, code array<bigint>, " + ", ".join(f"{f} double" for f in FACTORS) + ", pos bigint"
    return Index(starts.mapInArrow(codes, shape), starts.mapInArrow(base, "cluster_id int, vec_id bigint, embedding array<double>"), centroids, turn)


def dump_index_files(index: Index, path: str) -> None:
    """vec_id must be the row numbers 0, 1, ... as the files have no other ids."""
    os.makedirs(path, exist_ok=True)
    dim, words = index.dim, index.dim // 64
    offsets = [r.offset for r in cluster.offsets(index.codes, index.centroids).orderBy("cluster_id").collect()]  # a number for each cluster
    n = index.codes.count()
    centres = np.array([r.centroid for r in index.centroids.orderBy("cluster_id").collect()])  # bounded as in a search
    k = len(offsets) + 1
    for name, data in ((TURN, encode(index.rotation, "f32")), (CENTRES, encode(centres.T, "f32"))):
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
    heads = {BASE: (b"", n * (4 + 4 * dim)), IDS: (struct.pack("<I", k) + np.array([*offsets, n], "<u4").tobytes() + struct.pack("<I", n), 8 + 4 * k + 4 * n), VALUES: (struct.pack("<I", 4 * n), 4 + 16 * n), CODES: (struct.pack("<I", words * n), 4 + 8 * words * n)}
    for name, (head, size) in heads.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(head)
            f.truncate(size)
    after = 8 + 4 * k

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {name: os.open(os.path.join(path, name), os.O_WRONLY) for name in heads}
        done = 0
        for b in batches:
            column = {x: b.column(b.schema.get_field_index(x)) for x in b.schema.names}
            factors = np.stack([column[f].to_numpy() for f in FACTORS], 1).astype("<f4")
            code, base, ids = matrix_of_words(column["code"], words), matrix(column["embedding"], dim).astype("<f4"), column["vec_id"].to_numpy().astype("<u4")
            for j, i in enumerate(column["pos"].to_pylist()):
                os.pwrite(files[BASE], struct.pack("<I", dim) + base[j].tobytes(), i * (4 + 4 * dim))
                os.pwrite(files[IDS], ids[j].tobytes(), after + 4 * i)
                os.pwrite(files[VALUES], factors[j].tobytes(), 4 + 16 * i)
                os.pwrite(files[CODES], code[j].tobytes(), 4 + 8 * words * i)
            done += b.num_rows
        for f in files.values():
            os.close(f)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([done], pa.int64())})

    placed: DataFrame = cluster.layout(index.codes)
    rows = placed.join(index.base.select("vec_id", "embedding"), "vec_id").select("pos", "vec_id", "code", *FACTORS, F.col("embedding").cast("array<double>").alias("embedding"))
    written = rows.mapInArrow(write, "rows bigint").agg(F.sum("rows")).first()[0] or 0
    if written != n:
        raise ValueError(f"{written} of {n} rows")


def matrix_of_words(column: pa.Array, words: int) -> np.ndarray:
    return column.flatten().to_numpy().astype("<i8").reshape(-1, words)
