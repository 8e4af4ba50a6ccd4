"""Clusters: means, assignment, sizes and layout, sampling, k-means and its hierarchy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.kernels import BLOCK_BYTES, nearest, rotate
from vecloom.sources.folders import stored

__all__ = ["assign", "centroid_means", "hash_sample", "hierarchical_kmeans", "kmeans", "layout", "lloyd_step", "nested_lloyd", "offsets", "rotate"]


def centroid_means(df: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """cluster_id, n and centroid: each group's mean. One aggregate of sums for each dimension, combined before the shuffle."""
    v = F.col(column)
    means = df.groupBy(F.col(key).cast("int").alias("cluster_id")).agg(F.count("*").alias("n"), *[F.avg(v[i].cast("double")).alias(f"_{i}") for i in range(dim)])
    return means.select("cluster_id", "n", F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("centroid"))


def assign(df: DataFrame, centroids: DataFrame, column: str, dim: int) -> DataFrame:
    """df with cluster_id and center_distance_square of the nearest centroid; ties to the least id."""
    return nearest(df, column, centroids, dim)


def lloyd_step(df: DataFrame, centroids: DataFrame, column: str, dim: int) -> DataFrame:
    """One step of k-means: assign, then average. A cluster without rows keeps its centroid."""
    new = centroid_means(assign(df.select(column), centroids, column, dim), "cluster_id", column, dim)
    old = centroids.select("cluster_id", F.col("centroid").alias("old"))
    return old.join(new, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("centroid", "old").alias("centroid"))


def offsets(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster_id, n and offset (rows in clusters before it), clusters without rows included. The window is over clusters, not rows."""
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    every = centroids.select("cluster_id").join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("cluster_id", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df and each row's place (from 0) in an order. The rows are sorted in ranges; the driver gets a number for each range."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranges = stored(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, rows = 0, []
    for part, n in sorted(map(tuple, ranges.groupBy("_part").count().collect())):
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "_part int, _before long")
    return ranges.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def layout(assigned: DataFrame) -> DataFrame:
    """Each row's place in the index: by cluster, distance to its centre, id. A large cluster is in several tasks."""
    return numbered(assigned, ["cluster_id", "center_distance_square", "vec_id"], "pos")


def hash_sample(df: DataFrame, n: int, id_: str = "vec_id", by: str | None = None) -> DataFrame:
    """n rows, or n of each group, in the order of a hash of their id: a sample that reruns and other engines agree on."""
    h = F.md5(F.col(id_).cast("string"))
    if by is None:
        return df.orderBy(h, id_).limit(n)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(h, id_))
    return df.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def held(centroids: DataFrame, n: int, dim: int) -> DataFrame:
    """Centroids computed once: up to a block of them on the driver, more in the shared folder."""
    if n * dim * 8 > BLOCK_BYTES:
        return stored(centroids)
    return centroids.sparkSession.createDataFrame(sorted(map(tuple, centroids.collect())), centroids.schema)


def kmeans(df: DataFrame, column: str, k: int, dim: int, steps: int = 10, seed: Column | None = None, id_: str = "vec_id") -> DataFrame:
    """Lloyd's k-means from the first k rows of hash_sample: cluster_id and centroid. A cluster that loses all its rows keeps its centre."""
    first = hash_sample(df if seed is None else df.where(seed), k, id_).select(F.md5(F.col(id_).cast("string")).alias("_h"), F.col(id_).alias("_id"), F.col(column).cast("array<double>").alias("_v"))
    filled = F.concat("_v", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(dim) - F.size("_v"))))
    centroids = held(numbered(first, ["_h", "_id"], "_n").select(F.col("_n").cast("int").alias("cluster_id"), filled.alias("centroid")), k, dim)
    for _ in range(steps):
        centroids = held(lloyd_step(df, centroids, column, dim).select("cluster_id", "centroid"), k, dim)
    return centroids


def lloyd(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    """k-means of a few rows in memory, from the first k."""
    c = x[:k].copy()
    for _ in range(steps):
        near = np.argmin((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), axis=1)
        for i in np.unique(near):
            c[i] = x[near == i].mean(axis=0)
    return c


def hierarchical_kmeans(df: DataFrame, column: str, top: int, down: int, dim: int, points: int | None = 256, steps: int = 10, id_: str = "vec_id") -> DataFrame:
    """top times down centroids: top clusters, all rows assigned to them, then each cluster's rows in down clusters.

    points: rows sampled for each centroid, at both levels; None: all rows train both. A cluster with fewer rows
    than centroids gives one for each row. Of samples the second level trains all clusters at once, each in a task of
    its own, from top x down x points rows at most; of all rows, in steps over the whole table (nested_lloyd).
    """
    tops = kmeans(df if points is None else hash_sample(df, top * points, id_), column, top, dim, steps, id_=id_)
    placed = assign(df.select(id_, column), tops, column, dim).select(id_, column, "cluster_id")
    if points is None:
        return nested_lloyd(stored(placed), column, down, dim, steps, id_)
    rows = hash_sample(placed, down * points, id_, "cluster_id")

    def train(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        from vecloom.functions.kernels import lists, matrix

        by = pc.sort_indices(table.column("h"))
        c = lloyd(matrix(table.column(column).combine_chunks().take(by), dim), down, steps)
        return pa.table({"cluster_id": pa.array([table.column("cluster_id")[0].as_py() * down + j for j in range(len(c))], pa.int32()), "centroid": lists(c)})

    return rows.withColumn("h", F.concat(F.md5(F.col(id_).cast("string")), F.lpad(F.col(id_).cast("string"), 20, "0"))).select("cluster_id", column, "h").groupBy("cluster_id").applyInArrow(train, "cluster_id int, centroid array<double>")


def nested_lloyd(placed: DataFrame, column: str, down: int, dim: int, steps: int, id_: str = "vec_id") -> DataFrame:
    """k-means within each cluster of placed rows (id, vector, cluster_id), all rows and all clusters in each step.

    The first centroids are the first `down` rows of a cluster by the hash of their id. A row is compared with its
    own cluster's centroids only; a centroid that loses all its rows stays.
    """
    first = hash_sample(placed, down, id_, "cluster_id")
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.md5(F.col(id_).cast("string")), id_)) - 1
    centroids = stored(first.select((F.col("cluster_id") * down + nth).cast("int").alias("cluster_id"), F.col(column).cast("array<double>").alias("centroid")))
    for _ in range(steps):
        near = nearest(placed.withColumnRenamed("cluster_id", "_within"), column, centroids, dim, within="_within", of=down).select("cluster_id", column)
        new = centroid_means(near, "cluster_id", column, dim)
        old = centroids.select("cluster_id", F.col("centroid").alias("old"))
        centroids = stored(old.join(new, "cluster_id", "left").select("cluster_id", F.coalesce("centroid", "old").alias("centroid")))
    return centroids
