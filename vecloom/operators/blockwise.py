"""Searches of a table of queries: members of the probed clusters in tiles of rows, against the queries of a group side by side.

A pair of a query and a row is a place in a matrix of one tile. It never is a row of a table, so nothing grows with
the number of pairs but the arithmetic; a task holds a tile, and for each query of its group what it keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.kernels import distances, matrix
from vecloom.functions.vectors import QUERY_BITS
from vecloom.operators.index import Index
from vecloom.sources import folders

#: Queries of a group, and results that a group may keep; rows of a tile; queries of a matrix; bytes of rows that are read at once.
GROUP, KEPT, TILE, SIDE, READ_BYTES = 1024, 1 << 20, 4096, 256, 4 << 20
PAIRS = 1 << 16
#: Of a tile's rows, those that are looked at first by a scan that has no limit yet.
FIRST = (64, 512)


class Members:
    """The rows of the probed clusters in the order of a scan (cluster, distance from its centre, id), written to the shared folder for the tasks."""

    def __init__(self, index: Index, asked: DataFrame):
        spark, self.dim, self.path = asked.sparkSession, index.dim, folders.shared_folder(asked.sparkSession)
        order = ["cluster_id", "center_distance_square", "vec_id"]
        rows = index.rows().select(*order, "code", "factor_ip", "factor_ppc", "error_bound", "embedding")
        rows = rows.join(F.broadcast(asked.select("cluster_id").distinct()), "cluster_id", "left_semi").select(rows.columns)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("parquet.block.size", READ_BYTES).parquet(self.path)

    def groups(self) -> tuple[fs.FileSystem, list[tuple[str, int, int, int]]]:
        """The files' row groups in order, with the first and last cluster of each."""
        place, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), folders.mounted(self.path))
        found = []
        for info in sorted(place.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
            if info.path.endswith(".parquet"):
                with place.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                    for g in range(meta.num_row_groups):
                        s = meta.row_group(g).column(0).statistics
                        found.append((info.path, g, s.min, s.max))
        return place, found

    def tiles(self, groups: tuple[fs.FileSystem, list], clusters: np.ndarray) -> Iterator[tuple[int, Tile]]:
        """The tiles of some clusters (ascending), in order."""
        place, found = groups
        for path, g, low, high in found:
            some = clusters[np.searchsorted(clusters, low) : np.searchsorted(clusters, high, "right")]
            if not len(some):
                continue
            with place.open_input_file(path) as f:
                rows = pq.ParquetFile(f).read_row_group(g).combine_chunks()
            of = rows.column("cluster_id").to_numpy()
            for c in some.tolist():
                for i in range(np.searchsorted(of, c), end := np.searchsorted(of, c, "right"), TILE):
                    yield c, Tile(rows.slice(i, min(TILE, end - i)), self.dim)


class Tile:
    def __init__(self, rows: pa.Table, dim: int):
        column = lambda name: rows.column(name).combine_chunks()
        self.ids, self.x = column("vec_id").to_numpy(), matrix(column("embedding"), dim)
        self.d2, self.ip, self.ppc, self.bound = (column(c).to_numpy() for c in ("center_distance_square", "factor_ip", "factor_ppc", "error_bound"))
        words = np.ascontiguousarray(column("code").flatten().to_numpy().reshape(len(self.ids), -1), "<i8")
        self.bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float64)
        self.size = (self.x * self.x).sum(axis=1).max(initial=0)


class Group:
    """Queries, and their probes: rows q_id, qv, cluster_id, probe_rank, g2, low, delta, q_sum, planes in the order of q_id and probe_rank."""

    def __init__(self, rows: pa.Table, dim: int):
        column = lambda name: rows.column(name).combine_chunks()
        self.ids, first, self.of = np.unique(column("q_id").to_numpy(), return_index=True, return_inverse=True)
        self.y = matrix(column("qv").take(pa.array(first)), dim)
        self.yy = (self.y * self.y).sum(axis=1)
        self.cluster, self.rank = column("cluster_id").to_numpy(), column("probe_rank").to_numpy()
        self.g2, self.low, self.delta, self.q_sum = (column(c).to_numpy()[:, None] for c in ("g2", "low", "delta", "q_sum"))
        words = np.ascontiguousarray(column("planes").flatten().flatten().to_numpy().reshape(len(self.of), QUERY_BITS, -1), "<i8")
        planes = np.unpackbits(words.view(np.uint8), axis=2, bitorder="little")
        self.n = sum(planes[:, j].astype(np.float64) * (1 << j) for j in range(QUERY_BITS))

    def met(self, members: Members, groups, rank: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, Tile]]:
        """Probes (those of one rank, or all), their queries, and a tile of their cluster: all such, tiles in order."""
        mine = np.arange(len(self.of)) if rank is None else np.flatnonzero(self.rank == rank)
        mine = mine[np.argsort(self.cluster[mine], kind="stable")]
        of = self.cluster[mine]
        for c, tile in members.tiles(groups, np.unique(of)):
            probes = mine[np.searchsorted(of, c) : np.searchsorted(of, c, "right")]
            for i in range(0, len(probes), SIDE):
                yield (some := probes[i : i + SIDE]), self.of[some], tile

    def rough(self, p: np.ndarray, t: Tile) -> np.ndarray:
        """The bounds, by the same steps as vectors.rough; the dot product is of whole numbers, so it is exact in any order."""
        m = self.n[p] @ t.bits.T
        m *= 2.0
        m -= self.q_sum[p]
        m *= t.ip
        m *= self.delta[p]
        out = t.d2 + self.g2[p]
        out += self.low[p] * t.ppc
        out += m
        out -= t.bound * np.sqrt(self.g2[p])
        return out

    def near(self, q: np.ndarray, t: Tile) -> tuple[np.ndarray, np.ndarray]:
        """The distances but for rounding, and by how much those may be off."""
        return distances(self.y[q], t.x), (1e-9 * (self.yy[q] + t.size))[:, None]

    def exact(self, q: np.ndarray, at: np.ndarray, t: Tile) -> np.ndarray:
        return np.concatenate([((t.x[at[i : i + PAIRS]] - self.y[q[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(at), PAIRS)] or [np.zeros(0)])


class Best:
    """For each query the k least by key, then id, with one more number each."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.key, self.id, self.more = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf)

    def limit(self, q: np.ndarray) -> np.ndarray:
        return self.key[q, self.k - 1][:, None]

    def among(self, q: np.ndarray, key: np.ndarray, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Which places of a matrix of keys (inf where a row is out) may be among the best: rows, columns."""
        most = self.limit(q)
        hit = key <= most + slack
        if self.k < key.shape[1] and np.count_nonzero(hit) > 2 * self.k * len(q):
            hit = key <= np.minimum(most, np.partition(key, self.k - 1, axis=1)[:, self.k - 1 : self.k]) + slack
        hit &= key < np.inf
        return np.nonzero(hit)

    def add(self, q: np.ndarray, key: np.ndarray, id_: np.ndarray, more: np.ndarray) -> None:
        some = np.unique(q)
        rows = np.concatenate([np.repeat(some, self.k), q])
        key, id_, more = (np.concatenate([old[some].ravel(), new]) for old, new in ((self.key, key), (self.id, id_), (self.more, more)))
        by = np.lexsort((id_, key, rows))
        rows = rows[by]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        by, rows, nth = by[nth < self.k], rows[nth < self.k], nth[nth < self.k]
        self.key[rows, nth], self.id[rows, nth], self.more[rows, nth] = key[by], id_[by], more[by]

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """q_id, id, key and place (from 1) of what was found."""
        q, nth = np.nonzero(self.key < np.inf)
        return ids[q], self.id[q, nth], self.key[q, nth], (nth + 1).astype(np.int32)


def first_stage(g: Group, members: Members, groups, k: int) -> Best:
    """The k least bounds of each query, with their distances."""
    best = Best(len(g.ids), k)
    for p, q, t in g.met(members, groups):
        rough = g.rough(p, t)
        row, at = best.among(q, rough)
        if len(row):
            best.add(q[row], rough[row, at], t.ids[at], g.exact(q[row], at, t))
    return best


def least_bounds(g: Group, members: Members, groups, k: int) -> tuple[np.ndarray, ...]:
    return first_stage(g, members, groups, k).rows(g.ids)[:2]


def two_stage(g: Group, members: Members, groups, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of those whose bound isn't above the worst of the k with the least bounds; all, where there are fewer than k."""
    limit = first_stage(g, members, groups, k).more.max(axis=1)[:, None]
    best = Best(len(g.ids), k)
    for p, q, t in g.met(members, groups):
        near, slack = g.near(q, t)
        near[g.rough(p, t) > limit[q]] = np.inf
        row, at = best.among(q, near, slack)
        if len(row):
            best.add(q[row], dist := g.exact(q[row], at, t), t.ids[at], dist)
    return best.rows(g.ids)


def flat(g: Group, members: Members, groups, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of the probed clusters."""
    best = Best(len(g.ids), k)
    for _, q, t in g.met(members, groups):
        near, slack = g.near(q, t)
        row, at = best.among(q, near, slack)
        if len(row):
            best.add(q[row], dist := g.exact(q[row], at, t), t.ids[at], dist)
    return best.rows(g.ids)


def violations(g: Group, members: Members, groups) -> tuple[np.ndarray, ...]:
    """How many candidates a query has, and how many of them have a bound above their distance."""
    n, above = np.zeros(len(g.ids), np.int64), np.zeros(len(g.ids), np.int64)
    for p, q, t in g.met(members, groups):
        rough, (near, slack) = g.rough(p, t), g.near(q, t)
        np.add.at(n, q, len(t.ids))
        np.add.at(above, q, np.count_nonzero(rough > near + slack, axis=1))
        row, at = np.nonzero(np.abs(rough - near) <= slack)
        np.add.at(above, q[row], rough[row, at] > g.exact(q[row], at, t))
    return g.ids, n, above


def scan(g: Group, members: Members, groups, k: int, keeper: Callable) -> tuple[np.ndarray, ...]:
    """Each query's candidates in turn: by probe, then in the order of the cluster. keeper(k) has limit, accept() and result().

    Only what is under the limit at a window's begin can be accepted in it, as limits only fall; such rows are gone
    through one by one.
    """
    kept, limit = [keeper(k) for _ in g.ids], np.full(len(g.ids), np.inf)
    n, precise = np.zeros(len(g.ids), np.int64), np.zeros(len(g.ids), np.int64)
    for rank in range(1, int(g.rank.max(initial=0)) + 1):
        for p, q, t in g.met(members, groups, rank):
            rough, (near, slack) = g.rough(p, t), g.near(q, t)
            n[q] += len(t.ids)
            cuts = sorted({0, len(t.ids), *(c for c in FIRST if c < len(t.ids) and np.isinf(limit[q]).any())})
            for a, b in zip(cuts, cuts[1:]):
                r, least = rough[:, a:b], limit[q][:, None]
                under = r < least
                row, at = np.nonzero(under & (near[:, a:b] < least + slack))
                count = np.count_nonzero(under, axis=1)
                dist = g.exact(q[row], at + a, t)
                ends = np.searchsorted(row, np.arange(len(q) + 1))
                for i in np.unique(row).tolist():
                    mine = slice(ends[i], ends[i + 1])
                    count[i] = go_through(kept[q[i]], r[i], at[mine], dist[mine], t.ids[a:b])
                    limit[q[i]] = kept[q[i]].limit
                precise[q] += count
    out = [(g.ids[i], v, d, nth, n[i], precise[i]) for i, r in enumerate(kept) for nth, (d, v) in enumerate(r.result(), 1)]
    return tuple(np.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 6, "qqdiqq"))


def go_through(r, rough: np.ndarray, at: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> int:
    """Offer a query's keeper the rows `at` of a window; how many of the window's bounds were under the limit of their turn."""
    precise = begin = 0
    for place, bound, d, v in zip(at.tolist(), rough[at].tolist(), dist.tolist(), ids[at].tolist()):
        before = r.limit
        if bound < before and d < before:
            r.accept(d, v)
            if r.limit != before:
                precise += np.count_nonzero(rough[begin : place + 1] < before)
                begin = place + 1
    return precise + np.count_nonzero(rough[begin:] < r.limit)


def by_groups(members: Members, work: Callable, most: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups, rest = members.groups(), None

    def done(rows: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in work(Group(rows, members.dim), members, groups)], names)

    for b in batches:
        rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        q = rest.column("q_id").to_numpy()
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        while len(begins) > most:  # a query's probes may go on in the next batch
            yield done(rest.slice(0, begins[most]))
            rest, begins = rest.slice(begins[most]), begins[most:] - begins[most]
    if rest is not None and rest.num_rows:
        yield done(rest)


def run(index: Index, probed: DataFrame, queries: DataFrame, work: Callable, columns: str, k: int | None = None, **more) -> DataFrame:
    """work(group, members, groups of rows, ...) for groups of the queries, each in one task; the rows it gives.

    probed: of rotated queries, as probes() gives it; queries: q_id and qv as they were.
    """
    if k is not None:
        if k < 1:
            raise ValueError("k is at least 1")
        more["k"] = k
    asked = folders.stored(probed.join(queries.select("q_id", F.col("qv").cast("array<double>").alias("qv")), "q_id"))
    members, most = Members(index, asked), max(1, min(GROUP, KEPT // (k or 1)))
    n, cores = asked.where("probe_rank = 1").count(), asked.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(cores, -(-n // most))))
    names = [c.split()[0] for c in columns.split(", ")]
    return asked.repartition(tasks, "q_id").sortWithinPartitions("q_id", "probe_rank").mapInArrow(partial(by_groups, members, partial(work, **more), most, names), columns)
