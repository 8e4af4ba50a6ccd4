"""What the operators of this subpackage share: reading texts, the shared folder, blocks of documents.

A null doc_id stands for the largest id (it sorts last) and comes back as null, as does a real id of 2**63 - 1; a null
text is an empty one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = 2**63 - 1
BLOCK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text without nulls, and the named columns; any other column is left behind, so its name can't clash."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def public_id(name: str = "doc_id") -> Column:
    """The id as it was, null for NULL_ID."""
    return F.nullif(F.col(name), F.lit(NULL_ID).cast("long")).alias(name)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir. Where that is unset, in local mode only, a temporary folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/vecloom-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A shared folder for pyarrow: the file system, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends and nothing is computed twice."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values and where each begins (one more offset than values). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slabs(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values with about `most` bytes each; a longer value is alone."""
    n, i = len(starts) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ends(items: Iterator) -> Iterator[tuple[bool, object]]:
    """Each item with False, then True and None."""
    for x in items:
        yield False, x
    yield True, None


def row_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text").alias("key")


def plan(rows: DataFrame) -> tuple[int, DataFrame, DataFrame | None]:
    """Of keyed() rows: the bytes of all texts, the rows with their key, each different one once, and which are there several times (None: none).

    Rows that are the same throughout can't be told apart, so no hash spreads them over blocks; an operator works
    on one of them, and again() makes its result as many.
    """
    rows = rows.select("doc_id", "text", row_key())
    each = settle(rows.groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.first(F.octet_length("text")).cast("long").alias("size")))
    total, most = each.agg(F.sum(F.col("copies") * F.col("size")), F.max("copies")).first()
    if (most or 1) == 1:
        return total or 0, rows, None
    several = each.where("copies > 1").select("doc_id", "key", "copies")
    one = rows.join(several, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.first("text").alias("text")).select("doc_id", "text", "key")
    return total, rows.join(several, ["doc_id", "key"], "left_anti").select("doc_id", "text", "key").unionByName(one), several


def again(found: DataFrame, several: DataFrame | None) -> DataFrame:
    """A result with doc_id and key, each row as often as it was there."""
    if several is None:
        return found
    copies = F.coalesce("copies", F.lit(1)).cast("int")
    return found.join(several, ["doc_id", "key"], "left").withColumn("nth", F.explode(F.sequence(F.lit(1), copies))).drop("nth", "copies")


def parts_of(total: int, part_bytes: int) -> int:
    """How many parts of about part_bytes."""
    return max(1, -(-total // part_bytes))


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows with the block that each belongs to, by a hash of id and text: rows of one id, or without one, are spread."""
    return rows.select("doc_id", "text", "key", F.pmod(F.xxhash64("doc_id", "key"), F.lit(blocks)).cast("int").alias("block"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
