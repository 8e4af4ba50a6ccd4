"""Search as a stream: micro-batches of requests, and an HTTP service over a saved index."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators import search as S
from vecloom.operators.evaluate import responses
from vecloom.operators.index import Index
from vecloom.sources.blocks import BlockCache

REQUEST = "query array<float>, top_k int, probe int"


def fault(dim: int) -> Column:
    """What is wrong with a request, null if nothing is."""
    return (
        F.when(F.col("query").isNull(), "no query").when(F.size("query") == 0, "an empty query").when(F.size("query") > dim, f"a query of more than {dim} values")
        .when(F.exists("query", lambda x: x.isNull() | F.isnan(x)), "a query with values that are no numbers")
        .when(F.col("top_k").isNull() | (F.col("top_k") < 1), "top_k isn't 1 or more").when(F.col("probe").isNull() | (F.col("probe") < 1), "probe isn't 1 or more")
    )


def answer(index: Index, requests: DataFrame) -> DataFrame:
    """q_id and response for requests q_id, query, top_k, probe. Requests of one top_k and probe are searched together.

    A request that can't be answered gets {"error": what is wrong}; one that finds nothing, empty lists.
    """
    checked = requests.withColumn("fault", fault(index.dim))
    out = checked.where("fault is not null").select("q_id", F.to_json(F.struct(F.col("fault").alias("error"))).alias("response"))
    good = checked.where("fault is null")
    for k, probe in map(tuple, good.select("top_k", "probe").distinct().collect()):  # few: what clients ask for
        some = good.where((F.col("top_k") == k) & (F.col("probe") == probe)).select("q_id", F.col("query").alias("qv"))
        found = some.select("q_id").join(responses(S.search(index, some, probe, k)), "q_id", "left")
        out = out.unionByName(found.select("q_id", F.coalesce("response", F.lit('{"ids":[],"scores":[]}')).alias("response")))
    return out


def answer_stream(index: Index, requests: DataFrame, sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each micro-batch of a stream of JSON requests (q_id, value) is searched at once; sink(responses, batch id) stores it.

    What isn't a request is answered with what is wrong with it, so it doesn't hold up the others.
    A batch that runs again has the same id, so a sink that writes by id has each answer once. once: what is there
    is answered, then the stream ends.
    """
    parsed = requests.select("q_id", F.from_json("value", REQUEST).alias("r")).select("q_id", "r.*")

    def batch(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            if not df.isEmpty():
                sink(answer(index, df), batch_id)
        finally:
            df.unpersist()

    stream = parsed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


class Counters:
    """What /metrics tells: queries, candidates scored, exact distances, blocks read."""

    def __init__(self):
        self.lock, self.query, self.rough, self.precise, self.miss = threading.Lock(), 0, 0, 0, 0

    def add(self, query: int = 0, rough: int = 0, precise: int = 0, miss: int = 0) -> None:
        with self.lock:
            self.query, self.rough, self.precise, self.miss = self.query + query, self.rough + rough, self.precise + precise, self.miss + miss

    def text(self) -> str:
        ratio = self.rough / self.precise if self.precise else float("nan")
        return f"query: {self.query}, rough: {self.rough}, precise: {self.precise}, ratio: {ratio:.2f}, cache miss: {self.miss}"


def one(index: Index, spark: SparkSession, request: dict, counters: Counters, blocks: BlockCache | None = None) -> dict:
    """Answer a request. blocks: exact distances come from a file of vectors in index order, through its cache (codes then need `pos`)."""
    k = int(request["top_k"])
    if k < 1:
        raise ValueError("top_k isn't 1 or more")
    query = [float(x) for x in request["query"]]
    asked = spark.createDataFrame([(0, query)], "q_id long, qv array<double>")
    probed = S.probes(S.turned_queries(asked, index.rotation), index.centroids, index.dim, int(request["probe"]))
    if blocks is not None:
        order = S.candidates(index, probed).join(index.codes.select("vec_id", "pos"), "vec_id").orderBy("probe_rank", "center_distance_square", "vec_id")
        before = blocks.misses
        padded = np.array(query + [0.0] * (index.dim - len(query)))
        best, rough, precise = S.scan(map(tuple, order.select("rough", "vec_id", "pos").toLocalIterator()), padded, blocks.get, k)
        counters.add(1, rough, precise, blocks.misses - before)
        return {"ids": [v for _, v in best], "scores": [d for d, _ in best]}
    rows = S.replay(S.candidates(index, probed), index.base, asked, k).collect()  # top_k rows
    counters.add(1, rows[0].n_rough if rows else 0, rows[0].n_precise if rows else 0)
    return {"ids": [r.vec_id for r in rows], "scores": [r.dist for r in rows]}


def service(index: Index, spark: SparkSession, port: int = 9000, host: str = "0.0.0.0", blocks: BlockCache | None = None) -> ThreadingHTTPServer:
    """GET / and /health, GET /metrics, POST /query. Call serve_forever(), and shutdown() to end. blocks: see one()."""
    counters = Counters()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: str, kind: str = "text/plain") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            if self.path in ("/", "/health"):
                self.reply(200, "Ok")
            elif self.path == "/metrics":
                self.reply(200, counters.text())
            else:
                self.reply(404, "no such page")

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/query":
                return self.reply(404, "no such page")
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                body = json.dumps(one(index, spark, request, counters, blocks))
            except (KeyError, TypeError, ValueError) as e:
                return self.reply(422, str(e))
            self.reply(200, body, "application/json")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
