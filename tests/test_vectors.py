"""Expressions and kernels against numpy, on hand-made edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import rotation
from vecloom.functions import vectors as V
from vecloom.functions.kernels import distances, encode, nearest, probes, rotate
from vecloom.operators import cluster
from vecloom.operators import search as S
from vecloom.operators.index import Index, build_index, turned_queries

RNG = np.random.default_rng(5)


def frame(spark, rows, dim=64):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")


def centroids(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "cluster_id int, centroid array<double>")


def test_padding(spark):
    df = spark.createDataFrame([([1.0] * 50,), ([1.0] * 64,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(F.size(V.pad(F.col("v")))).collect()] == [64, 64, 0]


@pytest.mark.parametrize("n", [3, 64, 200])
def test_dot_l2_norm(spark, n):
    a, b = RNG.normal(size=(2, n))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    for dim in (None, n):
        r = df.select(V.dot(F.col("a"), F.col("b"), dim), V.l2(F.col("a"), F.col("b"), dim), V.norm(F.col("a"))).first()
        assert np.allclose(r, [a @ b, ((a - b) ** 2).sum(), np.linalg.norm(a)])


def test_codes_and_planes(spark):
    v = RNG.normal(size=128)
    v[[0, 63, 64, 127]] = [1, 1, 0, 2]  # the sign bit of a word, and a zero
    q = RNG.integers(0, 16, 128)
    df = spark.createDataFrame([(v.tolist(), q.tolist())], "v array<double>, q array<int>")
    r = df.select(V.sign_code(F.col("v"), 128).alias("c"), V.bit_planes(F.col("q"), 128).alias("p"), "v").select(
        "c", V.asymmetric_dot(F.col("c"), F.col("p"), 2).alias("a"), V.total(V.signs(F.col("v"))).alias("s"), V.binary_dot(F.col("c"), F.col("c"), 2).alias("b")
    ).first()
    bits = np.unpackbits(np.array(r.c, "<i8").view(np.uint8), bitorder="little")
    assert (bits == (v > 0)).all() and not bits[64]
    assert r.a == q[v > 0].sum() and r.s == np.where(v > 0, 1, -1).sum() and r.b == (v > 0).sum()


def test_quantize_rounds_halves_to_even_and_takes_constant_vectors(spark):
    df = spark.createDataFrame([([0.0, 2.5, 3.5, 15.0], 0.0, 1.0), ([2.0, 2.0], 2.0, 0.0)], "v array<double>, low double, delta double")
    got = [r[0] for r in df.select(V.quantize(F.col("v"), F.col("low"), F.col("delta"))).collect()]
    assert got == [[0, 2, 4, 15], [0, 0]]


def test_rotations_keep_distances(spark):
    for turn in (rotation.identity(64), rotation.hadamard(64), rotation.random_orthogonal(64)):
        assert np.allclose(turn @ turn.T, np.eye(64))
    with pytest.raises(ValueError):
        rotation.hadamard(48)
    x = RNG.normal(size=(5, 50))
    turned = np.array([r.v for r in rotate(frame(spark, x).withColumnRenamed("embedding", "v"), "v", rotation.random_orthogonal(64)).orderBy("vec_id").collect()])
    assert np.allclose(distances(turned, turned), distances(x, x))
    assert (rotation.random_bias(64) == rotation.random_bias(64)).all() and rotation.fixed_bias(3).tolist() == [0.5] * 3


def test_nearest_in_blocks_and_ties(spark):
    x, c = RNG.normal(size=(40, 64)), RNG.normal(size=(9, 64))
    c[7] = c[2]
    x[0] = c[7]  # a tie goes to the least id, and a row may equal its centroid
    df, cent = frame(spark, x), centroids(spark, c)
    for block in (1 << 20, 64 * 8 * 2):
        got = [(r.cluster_id, r.center_distance_square) for r in nearest(df, "embedding", cent, 64, block).orderBy("vec_id").collect()]
        exact = ((x[:, None] - c) ** 2).sum(-1)
        assert [g[0] for g in got] == exact.argmin(1).tolist() and np.allclose([g[1] for g in got], exact.min(1))
    assert got[0][0] == 2


def test_factors_of_a_row_at_its_centre(spark):
    x, c = RNG.normal(size=(6, 64)), RNG.normal(size=(2, 64))
    x[0] = c[0]
    placed = nearest(frame(spark, x), "embedding", centroids(spark, c), 64)
    a = encode(placed, "embedding", centroids(spark, c), 64).orderBy("vec_id").collect()
    b = placed.join(centroids(spark, c), "cluster_id").withColumn("r", V.residual(F.col("embedding"), F.col("centroid"))).select("vec_id", V.sign_code(F.col("r"), 64).alias("code"), *[v.alias(k) for k, v in V.factors(F.col("r"), 64).items()]).orderBy("vec_id").collect()
    for p, q in zip(a, b, strict=True):
        assert p.code == q.code and all(abs(p[k] - q[k]) < 1e-9 for k in ("center_distance_square", "factor_ip", "factor_ppc", "error_bound"))
    assert a[0].code == [0] and a[0].error_bound == 0


def test_probes_in_blocks(spark):
    x, c = RNG.normal(size=(4, 50)), RNG.normal(size=(7, 64))
    asked = turned_queries(frame(spark, x).withColumnRenamed("vec_id", "q_id").withColumnRenamed("embedding", "qv"), rotation.identity(64))
    padded = np.concatenate([x, np.zeros((4, 14))], axis=1)
    exact = ((padded[:, None] - c) ** 2).sum(-1)
    for probe, block in ((3, 1 << 20), (3, 64 * 8 * 2), (20, 64 * 8 * 3)):
        rows = probes(asked, centroids(spark, c), 64, probe, block).orderBy("q_id", "probe_rank").collect()
        assert len(rows) == 4 * min(probe, 7)
        for q in range(4):
            mine = [r for r in rows if r.q_id == q]
            assert [r.cluster_id for r in mine] == exact[q].argsort()[: len(mine)].tolist()
            assert all(r.q_sum == sum((p & 0xFFFFFFFFFFFFFFFF).bit_count() << j for j, plane in enumerate(r.planes) for p in plane) for r in mine)
    with pytest.raises(ValueError):
        probes(asked, centroids(spark, c), 64, 0)


def test_equal_distances_go_to_the_least_ids(spark):
    x = np.concatenate([np.tile(RNG.normal(size=64), (1000, 1)), RNG.normal(size=(50, 64)) + 9])
    order = RNG.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, x[0].tolist()), (1, (x[0] + 1).tolist())], "q_id long, qv array<double>")
    got = S.knn_exact(df, asked, 10, 64).collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.q_id == q] for q in (0, 1)} == {0: list(range(10)), 1: list(range(10))}


def test_blocks_of_queries_are_read_by_the_tasks(spark, monkeypatch):
    x, q = RNG.normal(size=(70, 64)), RNG.normal(size=(9, 64))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q_id long, qv array<double>")
    monkeypatch.setattr(S, "QUERY_BYTES", 64 * 8 * 4)
    exact = ((q[:, None] - x) ** 2).sum(-1).argsort(1)[:, :5]
    got = S.knn_exact(frame(spark, x), asked, 5, 64).collect()
    assert all([r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.q_id == i] == exact[i].tolist() for i in range(9))
    none = asked.where("q_id < 0")
    assert S.knn_exact(frame(spark, x), none, 5, 64).count() == 0


def test_all_rows_train_both_levels(spark):
    x = RNG.normal(size=(200, 8))
    got = {r.cluster_id: np.array(r.centroid) for r in cluster.hierarchical_kmeans(frame(spark, x), "embedding", 2, 3, 8, None, 4).collect()}
    tops = {r.cluster_id: np.array(r.centroid) for r in cluster.kmeans(frame(spark, x), "embedding", 2, 8, 4).collect()}
    of = np.argmin(((x[:, None] - np.array([tops[0], tops[1]])) ** 2).sum(-1), axis=1)
    h = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    for t in (0, 1):
        rows = sorted(np.flatnonzero(of == t).tolist(), key=lambda i: (h(i), i))
        want = cluster.lloyd(x[rows], 3, 4)
        assert all(np.allclose(got[3 * t + j], want[j]) for j in range(3))


def search_case(spark, n=300, dim=64):
    x = RNG.normal(size=(n, dim))
    c = x[:5]
    index = build_index(frame(spark, x), centroids(spark, c), rotation.random_orthogonal(64))
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "q_id long, qv array<double>")
    return x, index, asked


def test_search_of_all_clusters_finds_nearly_all(spark):
    x, index, asked = search_case(spark)
    exact = ((x[:6, None] - x) ** 2).sum(-1)
    truth = {q: set(exact[q].argsort()[:10].tolist()) for q in range(6)}
    flat = S.ivf_flat(index, asked, 99, 10).collect()
    assert {q: {r.vec_id for r in flat if r.q_id == q} for q in range(6)} == truth
    brute = S.knn_exact(frame(spark, x), asked, 10, 64).collect()
    assert {q: {r.vec_id for r in brute if r.q_id == q} for q in range(6)} == truth
    for how in ("two_stage", "heap", "heuristic"):
        found = S.search(index, asked, 99, 10, how).collect()
        hits = sum(r.vec_id in truth[r.q_id] for r in found)
        assert len(found) == 60 and hits >= 54, how
    with pytest.raises(ValueError):
        S.search(index, asked, 3, 10, "other")
    with pytest.raises(ValueError):
        S.search(index, asked, 3, 0)


def test_k_above_candidates_and_short_vectors(spark):
    x, index, asked = search_case(spark, 12, 50)
    assert S.search(index, asked, 99, 50).count() == 6 * 12
    assert S.search(index, asked, 99, 50, "heuristic").count() <= 6 * 12


def test_index_tables_round_trip(spark, tmp_path):
    _, index, asked = search_case(spark, 60)
    want = sorted(S.search(index, asked, 3, 5).select("q_id", "vec_id").collect())
    index.save(str(tmp_path / "a"))
    assert sorted(S.search(Index.load(spark, str(tmp_path / "a")), asked, 3, 5).select("q_id", "vec_id").collect()) == want
    index.save_json(str(tmp_path / "b"))
    assert sorted(S.search(Index.load_json(spark, str(tmp_path / "b")), asked, 3, 5).select("q_id", "vec_id").collect()) == want


def test_offsets_have_empty_clusters(spark):
    placed = spark.createDataFrame([(0, 0, 1.0), (1, 2, 2.0), (2, 2, 1.0)], "vec_id long, cluster_id int, center_distance_square double")
    cent = centroids(spark, np.zeros((4, 2)))
    assert [tuple(r) for r in cluster.offsets(placed, cent).orderBy("cluster_id").collect()] == [(0, 1, 0), (1, 0, 1), (2, 2, 1), (3, 0, 3)]
    assert [r.vec_id for r in cluster.layout(placed).orderBy("pos").collect()] == [0, 2, 1]


def test_hierarchy_with_few_rows(spark):
    x = np.concatenate([RNG.normal(size=(30, 8)), RNG.normal(size=(2, 8)) + 50])
    got = cluster.hierarchical_kmeans(frame(spark, x), "embedding", 2, 4, 8, 8, 2).collect()
    assert len({r.cluster_id for r in got}) == len(got) <= 8
