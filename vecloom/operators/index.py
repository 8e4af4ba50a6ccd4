"""The index: codes by cluster, beside the vectors they came from, as Parquet tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.kernels import encode, lists, matrix, nearest, rotate, with_columns

TABLES = ("codes", "base", "centroids", "rotation")


@dataclass
class Index:
    """codes: cluster_id, vec_id, code and factors. base: cluster_id, vec_id, embedding. centroids: rotated. rotation: dim by dim.

    Codes and vectors are apart, so that what asks for one of them doesn't read the other. whole: both in one, if there is such.
    """

    codes: DataFrame
    base: DataFrame
    centroids: DataFrame
    rotation: np.ndarray
    metrics: dict = field(default_factory=dict)
    whole: DataFrame | None = None

    @property
    def dim(self) -> int:
        return len(self.rotation)

    def rows(self) -> DataFrame:
        """Codes with their vectors."""
        if self.whole is not None:
            return self.whole
        return self.codes.join(self.base.select("cluster_id", "vec_id", "embedding"), ["cluster_id", "vec_id"])

    def save(self, path: str) -> None:
        """Parquet tables under path; codes and base are partitioned by cluster, so that a probe reads its clusters only.

        Rows are in ranges of cluster and order, so a large cluster is written by several tasks.
        """
        spark = self.codes.sparkSession
        for name in ("codes", "base"):
            df = getattr(self, name)
            order = ["center_distance_square", "vec_id"] if name == "codes" else ["vec_id"]
            df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cluster_id", *order).sortWithinPartitions("cluster_id", *order).write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/{name}")
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        rows = [(j, self.rotation[:, j].tolist()) for j in range(self.dim)]
        spark.createDataFrame(rows, "j int, col array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/rotation")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        codes, base, centroids = (spark.read.parquet(f"{path}/{t}") for t in TABLES[:3])
        columns = spark.read.parquet(f"{path}/rotation").orderBy("j").collect()  # dim rows
        return cls(codes, base, centroids, np.array([r.col for r in columns]).T)

    def save_json(self, path: str) -> None:
        """The same tables as JSON lines."""
        for name in TABLES[:3]:
            getattr(self, name).write.mode("overwrite").json(f"{path}/{name}")
        spark = self.codes.sparkSession
        spark.createDataFrame([(json.dumps(self.rotation.tolist()),)], "rotation string").coalesce(1).write.mode("overwrite").json(f"{path}/rotation")

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> Index:
        factors = "center_distance_square double, factor_ip double, factor_ppc double, error_bound double"
        shapes = {
            "codes": f"cluster_id int, vec_id bigint, code array<bigint>, {factors}", "base": "cluster_id int, vec_id bigint, embedding array<double>", "centroids": "cluster_id int, centroid array<double>",
        }
        tables = [spark.read.schema(shapes[t]).json(f"{path}/{t}") for t in TABLES[:3]]
        return cls(*tables, np.array(json.loads(spark.read.schema("rotation string").json(f"{path}/rotation").first()[0])))


def build_index(vectors: DataFrame, centroids: DataFrame, rotation: np.ndarray) -> Index:
    """From vec_id and embedding, and centroids (cluster_id, centroid) as they were before the rotation.

    Vectors are filled up with zeros to the rotation's dimension. Vectors and centroids must have one length.
    """
    dim = len(rotation)
    turned = rotate(centroids.select("cluster_id", F.col("centroid").cast("array<double>").alias("centroid")), "centroid", rotation)
    rows = vectors.select("vec_id", "embedding", F.col("embedding").cast("array<double>").alias("turned"))
    placed = nearest(rotate(rows, "turned", rotation), "turned", turned, dim)
    codes = encode(placed.select("vec_id", "cluster_id", "turned"), "turned", turned, dim).drop("turned")
    whole = encode(placed.select("vec_id", "cluster_id", "embedding", "turned"), "turned", turned, dim).drop("turned")
    return Index(codes, placed.select("cluster_id", "vec_id", "embedding"), turned, rotation, whole=whole)


def turned_queries(queries: DataFrame, rotation: np.ndarray) -> DataFrame:
    """q_id and qv of queries, rotated; a query may be shorter than the index's dimension."""
    dim = len(rotation)
    q = queries.select("q_id", F.col("qv").cast("array<double>").alias("qv"))
    return with_columns(q, "qv array<double>", lambda b: [lists(matrix(b.column(b.schema.get_field_index("qv")), dim) @ rotation)])
