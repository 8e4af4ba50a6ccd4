"""Search: exact, by clusters, and by codes with exact re-ranking, for a table of queries at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.functions.kernels import ROWS, Blocks, distances, matrix, probes
from vecloom.operators import blockwise
from vecloom.operators.index import Index, turned_queries
from vecloom.sources.blocks import BLOCK_BYTES

WINDOW = 12
QUERY_BYTES, QUERIES, PAIRS = 16 << 20, 1024, 1 << 16
FOUND = "q_id long, vec_id long, dist double, rank int"


def top_k(df: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k rows of each query, with their rank; Spark limits groups before the shuffle."""
    if k < 1:
        raise ValueError("k is at least 1")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*by))).where(F.col("rank") <= k)


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """q_id, vec_id, dist, rank by brute force: each batch of vectors gives its best k for each query, then the best of those.

    Ties go to the least vec_id, however many vectors share a distance.
    """
    blocks = Blocks(queries, "q_id", "qv", dim, QUERY_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for ids, q in blocks:
                for i in range(0, whole.num_rows, ROWS):
                    b = whole.slice(i, ROWS)
                    x, name = matrix(b.column(1), dim), b.column(0).to_numpy()
                    for j in range(0, len(q), QUERIES):
                        row, at, dist = best_of(x, name, q[j : j + QUERIES], k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[j + row]), pa.array(name[at]), pa.array(dist)], ["q_id", "vec_id", "dist"])

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "q_id long, vec_id long, dist double")
    return top_k(found, k, "dist", "vec_id")


def best_of(x: np.ndarray, name: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of x for each query, by exact distance, then name: which query, which row, the distance."""
    near = distances(q, x)
    if k < len(x):  # all that may be among them but for rounding
        slack = 1e-9 * ((q * q).sum(axis=1) + (x * x).sum(axis=1).max(initial=0))
        row, at = np.nonzero(near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None])
    else:
        row, at = (y.ravel() for y in np.indices(near.shape))
    dist = np.concatenate([((x[at[i : i + PAIRS]] - q[row[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(row), PAIRS)] or [np.zeros(0)])
    by = np.lexsort((name[at], dist, row))
    row, at, dist = row[by], at[by], dist[by]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], at[keep], dist[keep]


def candidates(index: Index, probed: DataFrame) -> DataFrame:
    """q_id, vec_id, cluster_id, probe_rank, center_distance_square and rough of each member of a probed cluster."""
    words = index.dim // V.WORD
    return index.codes.join(probed, "cluster_id").select(
        "q_id", "vec_id", "cluster_id", "probe_rank", "center_distance_square", V.rough(F.col("code"), F.col("planes"), words).alias("rough"),
    )


def exact(some: DataFrame, base: DataFrame, queries: DataFrame, dim: int | None = None) -> DataFrame:
    """Candidates with dist, from the vectors as they were."""
    named = queries.select("q_id", V.vector(F.col("qv")).alias("_y"))
    v = base.select("cluster_id", "vec_id", F.col("embedding").alias("_x"))
    return some.join(v, ["cluster_id", "vec_id"]).join(named, "q_id").withColumn("dist", V.l2(V.vector(F.col("_x")), F.col("_y"), dim)).drop("_x", "_y")


class Heap:
    """Keeps the k nearest; its limit is the worst of them once there are k."""

    def __init__(self, k: int):
        self.k, self.limit, self.kept = k, float("inf"), []

    def accept(self, dist: float, vec_id: int) -> None:
        heapq.heappush(self.kept, (-dist, -vec_id))
        if len(self.kept) > self.k:
            heapq.heappop(self.kept)
        if len(self.kept) == self.k:
            self.limit = -self.kept[0][0]

    def result(self) -> list[tuple[float, int]]:
        return sorted((-d, -v) for d, v in self.kept)


class Windowed(Heap):
    """Keeps the k nearest of what is accepted; its limit is the worst of the last WINDOW accepted, set anew after each WINDOW."""

    def __init__(self, k: int):
        super().__init__(k)
        self.n, self.worst = 0, float("-inf")

    def accept(self, dist: float, vec_id: int) -> None:
        self.kept.append((dist, vec_id))
        if len(self.kept) > 2 * self.k + 1024:
            self.kept = self.result()
        self.n, self.worst = self.n + 1, max(self.worst, dist)
        if self.n >= WINDOW:
            self.limit, self.n, self.worst = self.worst, 0, float("-inf")

    def result(self) -> list[tuple[float, int]]:
        return sorted(self.kept)[: self.k]


def replay(scored: DataFrame, base: DataFrame, queries: DataFrame, k: int, heuristic: bool = False, dim: int | None = None) -> DataFrame:
    """q_id, vec_id, dist, rank, n_rough, n_precise as a scan finds them that looks at candidates in turn.

    The order is that of the probes, then of distance from the centre. A query's candidates are streamed, so
    only what the re-ranker keeps is in memory.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    ordered = exact(scored, base, queries, dim).repartition("q_id").sortWithinPartitions("q_id", "probe_rank", "center_distance_square", "vec_id")

    def rows(q: int, r: Heap, n: int, precise: int) -> pa.RecordBatch:
        best = r.result()
        return pa.RecordBatch.from_arrays(
            [pa.array([q] * len(best), pa.int64()), pa.array([v for _, v in best], pa.int64()), pa.array([d for d, _ in best], pa.float64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([n] * len(best), pa.int64()), pa.array([precise] * len(best), pa.int64())],
            ["q_id", "vec_id", "dist", "rank", "n_rough", "n_precise"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, r, n, precise = None, None, 0, 0
        for b in batches:
            for new, vec_id, rough, dist in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if new != q:
                    if r is not None:
                        yield rows(q, r, n, precise)
                    q, r, n, precise = new, (Windowed if heuristic else Heap)(k), 0, 0
                n += 1
                if rough < r.limit:
                    precise += 1
                    if dist < r.limit:
                        r.accept(dist, vec_id)
        if r is not None:
            yield rows(q, r, n, precise)

    return ordered.select("q_id", "vec_id", "rough", "dist").mapInArrow(run, "q_id long, vec_id long, dist double, rank int, n_rough long, n_precise long")


def near_clusters(index: Index, queries: DataFrame, probe: int) -> DataFrame:
    return probes(turned_queries(queries, index.rotation), index.centroids, index.dim, probe)


def search(index: Index, queries: DataFrame, probe: int, k: int, rerank: str = "two_stage") -> DataFrame:
    """q_id, vec_id, dist, rank for queries q_id, qv. rerank: two_stage, heap or heuristic (see scans)."""
    if rerank == "two_stage":
        return blockwise.run(index, near_clusters(index, queries, probe), queries, blockwise.two_stage, FOUND, k)
    if rerank not in ("heap", "heuristic"):
        raise ValueError(f"no re-ranker {rerank}")
    return scans(index, queries, probe, k, rerank == "heuristic").select("q_id", "vec_id", "dist", "rank")


def scans(index: Index, queries: DataFrame, probe: int, k: int, heuristic: bool = False) -> DataFrame:
    """replay() of many queries: its columns and rows. A query's scan is in one task, beside those of its group."""
    keeper = Windowed if heuristic else Heap
    return blockwise.run(index, near_clusters(index, queries, probe), queries, blockwise.scan, f"{FOUND}, n_rough long, n_precise long", k, keeper=keeper)


def ivf_flat(index: Index, queries: DataFrame, probe: int, k: int) -> DataFrame:
    """The k nearest of the probed clusters, all of them by exact distance."""
    return blockwise.run(index, near_clusters(index, queries, probe), queries, blockwise.flat, FOUND, k)


def least_bounds(index: Index, queries: DataFrame, probe: int, k: int) -> DataFrame:
    """q_id and vec_id of the candidates with the k least bounds: the first stage of a search."""
    return blockwise.run(index, near_clusters(index, queries, probe), queries, blockwise.least_bounds, "q_id long, vec_id long", k)


def violations(index: Index, queries: DataFrame, probe: int) -> DataFrame:
    """q_id, n and above: a query's candidates, and those whose bound is above their distance."""
    return blockwise.run(index, near_clusters(index, queries, probe), queries, blockwise.violations, "q_id long, n long, above long")


def scan(rows: Iterator[tuple[float, int, int]], query: np.ndarray, vector_at, k: int, heuristic: bool = False) -> tuple[list[tuple[float, int]], int, int]:
    """replay() of one query on the driver: rows of bound, vec_id and place in scan order; vectors come one by one.

    A vector is asked for only where its bound is below the limit. The results, how many rows, how many vectors.
    """
    r, n, precise = (Windowed if heuristic else Heap)(k), 0, 0
    for rough, vec_id, pos in rows:
        n += 1
        if rough < r.limit:
            precise += 1
            v = vector_at(pos).astype(np.float64)
            dist = float(((v - query[: len(v)]) ** 2).sum() + (query[len(v) :] ** 2).sum())
            if dist < r.limit:
                r.accept(dist, vec_id)
    return r.result(), n, precise


def blocks_of(places: DataFrame, dim: int) -> DataFrame:
    """Which block of a file of vectors, in index order, holds each place: whole records of 4 (dim + 1) bytes."""
    return places.withColumn("block", F.floor(F.col("pos") / F.lit(max(1, BLOCK_BYTES // (4 * (dim + 1))))))
