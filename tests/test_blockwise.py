"""Searches by blocks against plans over pairs of a query and a row, with copies of vectors, small tiles and groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import rotation
from vecloom.operators import blockwise
from vecloom.operators import search as S
from vecloom.operators.index import build_index

RNG = np.random.default_rng(11)
K, PROBE, DIM = 7, 3, 64


@pytest.fixture(scope="module")
def case(spark):
    x = RNG.normal(size=(1500, 50))
    x[700:1000] = x[:300]  # ties
    x = x.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    centres = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x[:9] + 0.125)], "cluster_id int, centroid array<double>")
    index = build_index(rows, centres, rotation.random_orthogonal(DIM))
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 37)], "q_id long, qv array<float>")
    pairs = S.candidates(index, S.near_clusters(index, asked, PROBE)).cache()
    return index, asked, pairs, S.exact(pairs, index.base, asked).cache()


@pytest.fixture(params=["one tile", "many tiles"])
def sizes(request, monkeypatch):
    """Small tiles and matrices; partial() carries none of them, so the work is done here."""
    if request.param == "many tiles":
        for name, size in (("GROUP", 4), ("TILE", 100), ("SIDE", 3), ("READ_BYTES", 1 << 14)):
            monkeypatch.setattr(blockwise, name, size)


def groups(index, asked, work, names, **more):
    """What run() gives, by its steps in this process, where the sizes are patched."""
    probed = blockwise.folders.stored(S.near_clusters(index, asked, PROBE).join(asked, "q_id"))
    members = blockwise.Members(index, probed)
    batches = probed.orderBy("q_id", "probe_rank").toArrow().to_batches(10)
    return [tuple(r.values()) for b in blockwise.by_groups(members, lambda *a: work(*a, **more), blockwise.GROUP, names, batches) for r in b.to_pylist()]


def close(a, b):
    a, b = sorted(a), sorted(b)
    return [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2:] for x in a], [x[2:] for x in b])


def test_bounds_and_flat(case, sizes):
    index, asked, pairs, both = case
    want = [tuple(r) for r in S.top_k(pairs, K, "rough", "vec_id").select("q_id", "vec_id").collect()]
    assert sorted(groups(index, asked, blockwise.least_bounds, ["q_id", "vec_id"], k=K)) == sorted(want)
    want = [tuple(r) for r in S.top_k(both, K, "dist", "vec_id").select("q_id", "vec_id", "dist", "rank").collect()]
    assert close(groups(index, asked, blockwise.flat, ["q_id", "vec_id", "dist", "rank"], k=K), want)


def test_two_stage(case, sizes):
    index, asked, _, both = case
    limit = S.top_k(both, K, "rough", "vec_id").groupBy("q_id").agg(F.max("dist").alias("most"))
    want = [tuple(r) for r in S.top_k(both.join(limit, "q_id").where("rough <= most"), K, "dist", "vec_id").select("q_id", "vec_id", "dist", "rank").collect()]
    assert close(groups(index, asked, blockwise.two_stage, ["q_id", "vec_id", "dist", "rank"], k=K), want)


@pytest.mark.parametrize("heuristic", [False, True])
def test_scans_are_those_of_one_row_after_another(case, sizes, heuristic):
    index, asked, pairs, _ = case
    want = [tuple(r) for r in S.replay(pairs, index.base, asked, K, heuristic).collect()]
    names = ["q_id", "vec_id", "dist", "rank", "n_rough", "n_precise"]
    assert close(groups(index, asked, blockwise.scan, names, k=K, keeper=S.Windowed if heuristic else S.Heap), want)


def test_violations(case, sizes):
    index, asked, _, both = case
    want = [tuple(r) for r in both.groupBy("q_id").agg(F.count("*"), F.count_if(F.col("rough") > F.col("dist"))).collect()]
    assert sorted(groups(index, asked, blockwise.violations, ["q_id", "n", "above"])) == sorted(want)


def test_no_pair_of_query_and_row_is_a_row(case):
    """Plans have no join of the members with the queries."""
    index, asked, _, _ = case
    for df in (S.search(index, asked, PROBE, K), S.search(index, asked, PROBE, K, "heap"), S.ivf_flat(index, asked, PROBE, K), S.violations(index, asked, PROBE)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert S.search(index, asked.where("q_id < 0"), PROBE, K).count() == 0
