"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same number of copies in expectation, its target over its size. The whole
part is taken at once. The rest is a probability; two documents at a time meet, and word mass moves from
one to the other, the way drawn so that neither's expectation changes, until one's probability is 0 or 1.
The other goes on to the next meeting. Buckets of documents do this on their own; the one that each leaves
over goes up a reduction tree until one is left for each source, which a last draw rounds. So a source's
words differ from its target by less than the size of one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import keyed, settle, shuffle_partitions, slabs, strings

#: [\x20\x09-\x0D] in UTF-8 bytes.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
BUCKET, FAN, SEED, PIECE = 4096, 256, 42, 4 << 20


def row_key() -> Column:
    """Tells rows with one doc_id apart; rows that are the same throughout are one unit."""
    return F.xxhash64("doc_id", "text", "source")


def count_words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> np.ndarray:
    """Runs of other bytes in each value. A long value goes in pieces."""
    if len(at) == 2 and at[1] - at[0] > PIECE:
        n, before = 0, True
        for i in range(int(at[0]), int(at[1]), PIECE):
            gap = np.concatenate([[before], space[data[i : min(i + PIECE, int(at[1]))]]])
            n, before = n + int((gap[:-1] & ~gap[1:]).sum()), gap[-1]
        return np.array([n])
    gap = np.concatenate([[True], space[data[at[0] : at[-1]]]])
    first = gap[:-1] & ~gap[1:]
    inner = (at[:-1] - at[0])[at[:-1] < at[1:]]
    first[inner] = ~gap[inner + 1]
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return np.diff(total[at - at[0]])


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            data, at = strings(b.column(1))
            n = np.concatenate([count_words(data, at[i : j + 1]) for i, j in slabs(at, 1 << 20)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n)], ["doc_id", "source", "key", "size"])


def ranked(df: DataFrame, by: str) -> DataFrame:
    """df and each row's place (from 0) in the order of a column, null last; the driver gets a number for each partition."""
    spark = df.sparkSession
    parts = settle(
        df.withColumn("no", F.col(by).isNull())
        .repartitionByRange(shuffle_partitions(spark), "no", by).sortWithinPartitions("no", by).drop("no")
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before, rows = 0, []
    for part, n in sorted(parts.groupBy("part").count().collect()):
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "part int, before long")
    return parts.join(starts, "part").withColumn("place", F.col("at") + F.col("before")).drop("part", "at", "before")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: `share` of all words by weight; what is above `most` times a source's size goes to the others by weight."""
    weighed = settle(
        ranked(sources, "source").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    )
    whole = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("source_size") * most if level else F.lit(False)
        n, used, open_ = weighed.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if n == capped or not open_:
            break
        level, capped = (whole - used) / open_, n
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(most)).alias("target"))


def pivot(size: list[float], p: list[float], draw: list[float]) -> tuple[list[float], int]:
    """Probabilities after all meetings, and which one is not yet 0 or 1 (-1: none)."""
    p, left = list(p), -1
    for i in range(len(p)):
        if not size[i] or p[i] <= 0 or p[i] >= 1:
            p[i] = float(p[i] >= 1)
            continue
        if left < 0:
            left = i
            continue
        a, b = left, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        if draw[i] * (up + down) < down:
            whole_a, whole_b = (1 - p[a]) * size[a] <= up, p[b] * size[b] <= up
            p[a], p[b] = 1.0 if whole_a else p[a] + up / size[a], 0.0 if whole_b else p[b] - up / size[b]
        else:
            whole_a, whole_b = p[a] * size[a] <= down, (1 - p[b]) * size[b] <= down
            p[a], p[b] = 0.0 if whole_a else p[a] - down / size[a], 1.0 if whole_b else p[b] + down / size[b]
        left = -1 if whole_a and whole_b else b if whole_a else a
        if left >= 0 and not 1e-12 < p[left] < 1 - 1e-12:
            p[left], left = float(round(p[left])), -1
    return p, left


UNIT = "doc_id long, key long, source string, bucket long, mass double, p double, draw double"


def meet(last: bool):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mass", "draw", "doc_id", "key"], ascending=[False, True, True, True], ignore_index=True)  # what is left over tends to be small
        p, left = pivot(rows["mass"].tolist(), rows["p"].tolist(), rows["draw"].tolist())
        if last and left >= 0:
            p[left], left = float(1 - rows["draw"][left] < p[left]), -1
        rows["p"], rows["settled"] = p, True
        if left >= 0:
            rows.loc[left, "settled"] = False
        return rows

    return group


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For each row its size, its source's size and target, how many copies the mix takes, and their words.

    Sources weigh `weights` in turn, in the order of their code points, null last. A null or empty text has no
    words and no copies. Rows that are the same throughout are rounded as one. Empty table: no rows. The
    draws are hashes of the rows, so reruns agree, however the rows are partitioned.
    """
    with_source = docs.withColumn("source", F.col("source").cast("string"))
    sized = settle(
        keyed(with_source, "source").select("doc_id", "text", "source", row_key().alias("key")).mapInArrow(sizes, "doc_id long, source string, key long, size long")
    )
    plan = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    units = sized.groupBy("doc_id", "key", "source").agg(F.sum("size").cast("double").alias("mass"))
    buckets = max(1, math.ceil(sized.count() / BUCKET))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    this = plan.withColumns({"ratio": ratio, "of": F.col("source")}).drop("source")
    level = units.join(this, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "key", "source", F.pmod(F.xxhash64("key", "doc_id", F.lit(SEED)), F.lit(buckets)).alias("bucket"), "mass",
        (F.col("ratio") - F.floor("ratio")).alias("p"), (F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(SEED + 1)), 11) / F.lit(float(1 << 53))).alias("draw"),
    )
    done = None
    while True:
        met = settle(level.groupBy("source", "bucket").applyInPandas(meet(buckets == 1), UNIT + ", settled boolean"))
        some = met.where("settled").select("doc_id", "key", "p")
        done = some if done is None else done.unionByName(some)
        if buckets == 1:
            break
        buckets = math.ceil(buckets / FAN)
        level = met.where("not settled").drop("settled").withColumn("bucket", F.pmod(F.xxhash64("bucket"), F.lit(buckets)))
    copies = F.floor("ratio").cast("long") + F.col("p").cast("long")
    return (
        sized.join(done, ["doc_id", "key"]).join(this, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")))
        .select("doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    columns = docs.columns
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    own = docs.select(F.struct(*columns).alias("row"), id_.alias("mix_id"), F.xxhash64(id_, text, source).alias("mix_key"))
    taken = mix(docs, **how).where("copies > 0").groupBy("doc_id", "key").agg(F.first("copies").cast("int").alias("mix_copies"))
    return own.join(taken, (F.col("mix_id") == taken["doc_id"]) & (F.col("mix_key") == taken["key"])).select("row", F.explode(F.sequence(F.lit(1), "mix_copies")).alias("nth")).select("row.*")
