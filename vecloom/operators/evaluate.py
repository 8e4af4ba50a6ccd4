"""Recall and the counters of a search."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """q_id, hits and recall: how many of the first k true ids are among a query's results, over k."""
    true = truth.select("q_id", F.posexplode("ids").alias("at", "vec_id")).where(F.col("at") < k)
    hit = true.join(results.select("q_id", "vec_id", F.lit(1).alias("hit")), ["q_id", "vec_id"], "left")
    return hit.groupBy("q_id").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).withColumn("recall", F.col("hits") / F.lit(float(k)))


def recall_of_lists(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """The same over the shorter of k and the truth, of which as many results are looked at, in the order given."""
    both = results.select("q_id", F.col("ids").alias("found")).join(truth.select("q_id", "ids"), "q_id")
    n = F.least(F.lit(k), F.size("ids"))
    return both.select("q_id", (F.size(F.array_intersect(F.slice("ids", F.lit(1), n), F.slice("found", F.lit(1), n))) / n).alias("recall"))


def truth_lists(nearest: DataFrame) -> DataFrame:
    """q_id and ids in rank order, from rows q_id, vec_id, rank."""
    return nearest.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))


def search_metrics(replayed: DataFrame) -> DataFrame:
    """query, rough, precise and their ratio, of replay()'s rows."""
    each = replayed.groupBy("q_id").agg(F.first("n_rough").alias("rough"), F.first("n_precise").alias("precise"))
    return each.agg(F.count("*").alias("query"), F.sum("rough").alias("rough"), F.sum("precise").alias("precise")).withColumn("ratio", F.round(F.col("rough") / F.col("precise"), 2))


def responses(found: DataFrame) -> DataFrame:
    """q_id and response: JSON with parallel arrays ids and scores, nearest first."""
    rows = found.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("r"))
    return rows.select("q_id", F.to_json(F.struct(F.transform("r", lambda x: x["vec_id"]).alias("ids"), F.transform("r", lambda x: x["dist"]).alias("scores"))).alias("response"))


def timed(found: DataFrame, n_queries: int) -> tuple[list, float]:
    """The rows, and queries per second."""
    began = time.perf_counter()
    rows = found.collect()
    return rows, n_queries / max(1e-9, time.perf_counter() - began)


def load(url: str, queries: Iterable, truths: Iterable, k: int, probe: int, limit: int = 1000, threads: int = 1) -> dict:
    """Ask a service for the first `limit` queries, one after another or by several threads.

    How many were answered and how many failed; of the answered the mean recall (as recall_of_lists: over the shorter
    of k and the truth) and the mean latency, and answers per second. Failed requests count in neither mean.
    """

    def ask(pair) -> tuple[float, float] | None:
        query, truth = pair
        body = json.dumps({"query": [float(x) for x in query], "top_k": k, "probe": probe}).encode()
        began = time.perf_counter()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=3000) as r:
                ids = json.loads(r.read())["ids"]
        except (urllib.error.URLError, ValueError, KeyError):
            return None
        took = time.perf_counter() - began
        n = min(k, len(truth))
        return len(set(ids[:n]) & {int(x) for x in truth[:n]}) / max(1, n), took

    pairs = [p for p, _ in zip(zip(queries, truths), range(limit))]
    began = time.perf_counter()
    if threads > 1:
        with ThreadPoolExecutor(threads) as pool:
            got = list(pool.map(ask, pairs))
    else:
        got = list(map(ask, pairs))
    took, good = time.perf_counter() - began, [x for x in got if x is not None]
    mean = lambda i: sum(x[i] for x in good) / len(good) if good else float("nan")
    return {"queries": len(good), "failed": len(got) - len(good), "recall": mean(0), "latency": mean(1), "qps": len(good) / max(took, 1e-9)}
