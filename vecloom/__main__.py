"""python -m vecloom search | train | serve | load: vector files in, recall and queries per second, centroids or a service out, or a service asked."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecloom.functions import rotation
from vecloom.functions.vectors import padded_size
from vecloom.operators import cluster, evaluate, search
from vecloom.operators.index import Index, build_index
from vecloom.sources import index_files, vecs
from vecloom.sources.blocks import BlockCache


def opened(spark: SparkSession, path: str) -> Index:
    return index_files.load_index_files(spark, path) if os.path.exists(os.path.join(path, index_files.CODES)) else Index.load(spark, path)


def built(spark: SparkSession, a: argparse.Namespace) -> Index:
    """Load the saved index, or build and save it."""
    if os.path.isdir(a.saved):
        return opened(spark, a.saved)
    dim = padded_size(vecs.dimension(vecs.files(a.base)[0]))
    if dim != padded_size(vecs.dimension(vecs.files(a.centroids)[0])):
        raise SystemExit("base and centroids have different dimensions")
    base = vecs.read_vecs(spark, a.base).select(F.col("ordinal").alias("vec_id"), F.col("vec").alias("embedding"))
    centres = vecs.read_vecs(spark, a.centroids).select(F.col("ordinal").cast("int").alias("cluster_id"), F.col("vec").alias("centroid"))
    build_index(base, centres, rotation.random_orthogonal(dim, a.seed)).save(a.saved)
    return Index.load(spark, a.saved)


def run_search(spark: SparkSession, a: argparse.Namespace) -> dict:
    index = built(spark, a)
    queries = vecs.read_vecs(spark, a.query).select(F.col("ordinal").alias("q_id"), F.col("vec").alias("qv"))
    truth = vecs.read_vecs(spark, a.truth, "i32").select(F.col("ordinal").alias("q_id"), F.col("vec").alias("ids"))
    n = queries.count()
    rows, qps = evaluate.timed(search.search(index, queries, a.probe, a.topk, "heuristic" if a.heuristic_rank else a.rerank), n)
    found = spark.createDataFrame(rows, "q_id long, vec_id long, dist double, rank int")
    mean = evaluate.recall(found, truth, a.topk).agg(F.avg("recall")).first()[0]
    print(f"QPS: {qps:.3f}, recall: {mean:.6f}")
    return {"qps": qps, "recall": mean, "queries": n}


def run_train(spark: SparkSession, a: argparse.Namespace) -> None:
    dim = vecs.dimension(vecs.files(a.base)[0])
    base = vecs.read_vecs(spark, a.base).select(F.col("ordinal").alias("vec_id"), F.col("vec").alias("embedding"))
    found = cluster.hierarchical_kmeans(base, "embedding", a.top, a.down, dim, a.points or None)
    vecs.write_vecs(found, a.out or f"centroids_{a.top}_{a.down}.fvecs", "centroid", order="cluster_id")


def run_serve(spark: SparkSession, a: argparse.Namespace) -> None:
    from vecloom.streaming.serve import service

    blocks = BlockCache(f"{a.dir.rstrip('/')}/{index_files.BASE}", a.cache) if a.cache else None
    if a.local:
        index_files.download(a.dir, a.local)
    server = service(opened(spark, a.local or a.dir), spark, a.port, blocks=blocks)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()


def run_load(a: argparse.Namespace) -> dict:
    read = lambda path, dtype: (v for f in vecs.files(path) for v in vecs.decode(open(f, "rb").read(), dtype))  # noqa: E731, SIM115
    got = evaluate.load(f"{a.url.rstrip('/')}/query", read(a.query, "f32"), read(a.truth, "i32"), a.topk, a.probe, a.limit, a.threads if a.concurrent else 1)
    print(f"recall: {got['recall']:.6f}, mean latency: {got['latency']:.6f}, QPS: {got['qps']:.3f}, failed: {got['failed']} [top_k {a.topk}, probe {a.probe}]")
    return got


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecloom")
    kinds = p.add_subparsers(dest="what", required=True)
    s = kinds.add_parser("search", add_help=False)
    for short, name in (("-b", "base"), ("-c", "centroids"), ("-q", "query"), ("-t", "truth"), ("-s", "saved")):
        s.add_argument(short, f"--{name}", required=True)
    s.add_argument("-p", "--probe", type=int, default=100)
    s.add_argument("-k", "--topk", type=int, default=10)
    s.add_argument("-h", "--heuristic-rank", action="store_true")
    s.add_argument("--rerank", default="two_stage", choices=("two_stage", "heap", "heuristic"))
    s.add_argument("--seed", type=int, default=42)
    t = kinds.add_parser("train")
    t.add_argument("base")
    t.add_argument("top", type=int)
    t.add_argument("down", type=int)
    t.add_argument("--points", type=int, default=256, help="rows sampled for each centroid; 0: all")
    t.add_argument("--out")
    v = kinds.add_parser("serve")
    v.add_argument("-d", "--dir", required=True)
    v.add_argument("-p", "--port", type=int, default=9000)
    v.add_argument("--cache", help="a local file: vectors are read in blocks from the six-file index and kept there")
    v.add_argument("--local", help="a folder that the index's other files are first copied to, those that aren't there yet")
    w = kinds.add_parser("load")
    w.add_argument("-u", "--url", default="http://127.0.0.1:9000")
    w.add_argument("-q", "--query", required=True)
    w.add_argument("-t", "--truth", required=True)
    w.add_argument("-k", "--topk", type=int, default=100)
    w.add_argument("-p", "--probe", type=int, default=300)
    w.add_argument("-l", "--limit", type=int, default=1000)
    w.add_argument("-c", "--concurrent", action="store_true")
    w.add_argument("--threads", type=int, default=8)
    return p


def main(argv: list[str] | None = None) -> object:
    a = parser().parse_args(argv)
    if a.what == "load":
        return run_load(a)
    spark = SparkSession.builder.appName("vecloom").getOrCreate()
    return {"search": run_search, "train": run_train, "serve": run_serve}[a.what](spark, a)


if __name__ == "__main__":
    main()
