"""Dense linear algebra over Arrow batches. What goes to the executors is bounded and checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.sources import folders
from vecloom.functions.vectors import DEFAULT_COSINE, EPSILON, FINE, QUERY_BITS, padded_size

#: Bytes of vectors in one block.
BLOCK_BYTES = 32 << 20
ROWS = 4096


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors as rows, filled up with zeros to dim."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(size):
        return np.zeros((0, dim))
    if size.max() > dim:
        raise ValueError(f"a vector of {size.max()} values where {dim} are the most")
    if (size == size[0]).all():
        out = flat.reshape(len(size), size[0])
        return out if size[0] == dim else np.concatenate([out, np.zeros((len(size), dim - size[0]))], axis=1)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1]), pa.array(np.ascontiguousarray(x).ravel()))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, never below zero."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1))


class Blocks:
    """Rows of ids and vectors that tasks go through, at most block_bytes of vectors at a time.

    What fits in one block is sent with the plan. More is written to the shared folder in the order of the ids, and
    tasks read it from there; the driver and a task hold one block.
    """

    def __init__(self, df: DataFrame, id_: str, vector: str, dim: int, block_bytes: int = BLOCK_BYTES):
        self.dim, self.most, self.path = dim, max(1, block_bytes // (8 * dim)), None
        rows = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        few = rows.limit(self.most + 1).collect()  # a block
        if len(few) > self.most:
            self.path = folders.shared_folder(df.sparkSession)
            n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            rows.repartitionByRange(n, "id").sortWithinPartitions("id").write.option("parquet.block.size", block_bytes).parquet(self.path)
            return
        few = sorted(few)
        self.few = np.array([r[0] for r in few], np.int64), np.array([r[1] + [0.0] * (dim - len(r[1])) for r in few]).reshape(len(few), dim)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.path is None:
            yield self.few
            return
        place, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), folders.mounted(self.path))
        for info in sorted(place.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
            if info.path.endswith(".parquet"):
                with place.open_input_file(info.path) as f:
                    for b in pq.ParquetFile(f).iter_batches(self.most):
                        yield b.column(0).to_numpy(), matrix(b.column(1), self.dim)


def with_columns(df: DataFrame, new: str, run) -> DataFrame:
    """df and the columns that run(batch) gives for each batch, as a list of arrays."""
    more = T._parse_datatype_string(new)
    names = [f.name for f in more]
    shape = T.StructType([f for f in df.schema if f.name not in names] + list(more))
    keep = [f.name for f in df.schema if f.name not in names]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in keep] + run(part), keep + names)

    return df.mapInArrow(batches, shape)


def rotate(df: DataFrame, column: str, rotation: np.ndarray) -> DataFrame:
    """The column's vectors, filled up with zeros, times the rotation."""
    dim = len(rotation)
    return with_columns(df, f"{column} array<double>", lambda b: [lists(matrix(b.column(b.schema.get_field_index(column)), dim) @ rotation)])


def nearest(df: DataFrame, column: str, centroids: DataFrame, dim: int, block_bytes: int = BLOCK_BYTES, within: str | None = None, of: int = 1) -> DataFrame:
    """cluster_id and center_distance_square of each row's nearest centroid; the least id wins ties. No rows are multiplied.

    within: a column that names a group of the centroids, those whose id divided by `of` is that; a row is compared with them only.
    """
    blocks = Blocks(centroids, "cluster_id", "centroid", dim, block_bytes)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        x = matrix(b.column(b.schema.get_field_index(column)), dim)
        best, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        group = None if within is None else b.column(b.schema.get_field_index(within)).to_numpy()
        for ids, c in blocks:  # in the order of the ids
            for rows, some in [(slice(None), slice(None))] if group is None else [(group == g, ids // of == g) for g in np.intersect1d(group, ids // of)]:
                own = c[some]
                if not len(own):
                    continue
                k = np.argmin(distances(x[rows], own), axis=1)
                d2 = ((x[rows] - own[k]) ** 2).sum(axis=1)
                best[rows], least[rows] = np.where(d2 < least[rows], ids[some][k], best[rows]), np.minimum(d2, least[rows])
        return [pa.array(best.astype(np.int32)), pa.array(least)]

    return with_columns(df, "cluster_id int, center_distance_square double", run)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as signed words of 64, the first bit lowest."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


CODE = "code array<bigint>, center_distance_square double, factor_ip double, factor_ppc double, error_bound double"


def encode(df: DataFrame, column: str, centroids: DataFrame, dim: int) -> DataFrame:
    """Codes and factors of rotated vectors whose cluster_id is known. The centroids needed come with the rows, by a join."""
    joined = df.join(centroids.select("cluster_id", "centroid"), "cluster_id")

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        at = b.schema.get_field_index
        r = matrix(b.column(at(column)), dim) - matrix(b.column(at("centroid")), dim)
        d2 = (r * r).sum(axis=1)
        d = np.sqrt(d2)
        cosine = np.where(d > 0, np.abs(r).sum(axis=1) / (np.where(d > 0, d, 1) * dim**0.5), DEFAULT_COSINE)
        w = d / cosine
        ip = -2 / dim**0.5 * w
        bound = 2 * EPSILON / (dim - 1) ** 0.5 * np.sqrt(np.maximum(0, w * w - d2))
        return [lists(pack(r > 0)), *map(pa.array, (d2, ip, ip * np.where(r > 0, 1, -1).sum(axis=1), bound))]

    return with_columns(joined, CODE, run).drop("centroid")


PROBE = "q_id long, cluster_id int, probe_rank int, g2 double, low double, delta double, q_sum long, planes array<array<bigint>>"


def probes(queries: DataFrame, centroids: DataFrame, dim: int, probe: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each query (q_id, qv, rotated) its `probe` nearest clusters, in order, and its residual there, quantized.

    A pass over blocks of centroids keeps each query's best so far, with those centroids' vectors.
    """
    if probe < 1:
        raise ValueError("probe at least one cluster")
    blocks = Blocks(centroids, "cluster_id", "centroid", dim, block_bytes)

    def best(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest clusters' ids and vectors for each query."""
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim)))] * len(x)
        for ids, c in blocks:
            new = distances(x, c)
            for i, (k, d, v) in enumerate(kept):
                some = np.flatnonzero(new[i] <= np.partition(new[i], probe - 1)[probe - 1] * (1 + 1e-9) + 1e-9) if probe < len(c) else np.arange(len(c))
                k, d, v = np.concatenate([k, ids[some]]), np.concatenate([d, ((x[i] - c[some]) ** 2).sum(axis=1)]), np.concatenate([v, c[some]])
                by = np.lexsort((k, d))[:probe]
                kept[i] = k[by], d[by], v[by]
        return [(k, v) for k, _, v in kept]

    def quantized(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column(1), dim)
            for i, (q, (k, near)) in enumerate(zip(b.column(0).to_pylist(), best(x), strict=True)):
                t = x[i] - near
                low, delta = t.min(axis=1), (t.max(axis=1) - t.min(axis=1)) / ((1 << QUERY_BITS) - 1)
                n = np.where(delta[:, None] == 0, 0, np.rint(np.rint((t - low[:, None]) / np.where(delta == 0, 1, delta)[:, None] / FINE) * FINE)).astype(np.int64)
                planes = [[pack((n[r : r + 1] >> j) & 1 == 1)[0].tolist() for j in range(QUERY_BITS)] for r in range(len(t))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(t), pa.int64()), pa.array(k, pa.int32()), pa.array(np.arange(1, len(t) + 1, dtype=np.int32)), pa.array((t * t).sum(axis=1)), pa.array(low), pa.array(delta), pa.array(n.sum(axis=1)), pa.array(planes, pa.list_(pa.list_(pa.int64())))],
                    ["q_id", "cluster_id", "probe_rank", "g2", "low", "delta", "q_sum", "planes"],
                )

    return queries.select("q_id", "qv").mapInArrow(quantized, PROBE)


def dimension(df: DataFrame, column: str) -> int:
    """The padded dimension of the first row; a vector that is longer fails where it is used."""
    first = df.select(F.size(column)).first()
    if not first or not first[0] or first[0] < 0:
        raise ValueError("no vectors")
    return padded_size(first[0])


