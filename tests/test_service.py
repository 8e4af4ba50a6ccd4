import json
import sqlite3
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.__main__ import main
from vecloom.functions import rotation
from vecloom.operators import evaluate
from vecloom.operators import search as S
from vecloom.operators.index import build_index
from vecloom.sources import index_files, vecs
from vecloom.sources.blocks import BlockCache
from vecloom.streaming.serve import answer, answer_stream, service

RNG = np.random.default_rng(11)


def case(spark, n=120, dim=50):
    x = RNG.normal(size=(n, dim)).astype(np.float32)
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    cent = spark.createDataFrame([(i, r.astype(float).tolist()) for i, r in enumerate(x[:4])], "cluster_id int, centroid array<double>")
    return x, build_index(base, cent, rotation.random_orthogonal(64))


def test_six_files_round_trip(spark, tmp_path, monkeypatch):
    x, index = case(spark)
    index_files.dump_index_files(index, str(tmp_path / "i"))
    monkeypatch.setattr(index_files, "ROWS", 50)
    again = index_files.load_index_files(spark, str(tmp_path / "i"))
    a, b = ({r.vec_id: r for r in i.codes.collect()} for i in (index, again))
    assert set(a) == set(b)
    for k in a:
        assert a[k].code == b[k].code and a[k].cluster_id == b[k].cluster_id
        assert all(abs(a[k][f] - b[k][f]) < 1e-5 * max(1, abs(a[k][f])) for f in index_files.FACTORS)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "q_id long, qv array<float>")
    assert S.search(again, asked, 4, 3).where("rank = 1 and q_id = vec_id").count() == 4
    first = list(vecs.decode((tmp_path / "i" / index_files.IDS).read_bytes(), "i32"))
    assert len(first) == 2 and first[0].tolist()[0] == 0 and first[0].tolist()[-1] == 120 and sorted(first[1].tolist()) == list(range(120))


def test_answers_and_stream(spark, tmp_path):
    x, index = case(spark)
    asked = spark.createDataFrame([(i, x[i].tolist(), 3 + i % 2, 4) for i in range(4)], "q_id long, query array<float>, top_k int, probe int")
    got = {r.q_id: json.loads(r.response) for r in answer(index, asked).collect()}
    assert all(got[i]["ids"][0] == i and len(got[i]["scores"]) == 3 + i % 2 for i in range(4))
    source = str(tmp_path / "in")
    asked.select("q_id", F.to_json(F.struct("query", "top_k", "probe")).alias("value")).unionByName(spark.createDataFrame([(9, "broken")], "q_id long, value string")).coalesce(1).write.parquet(source)
    out = {}
    stream = spark.readStream.schema("q_id long, value string").parquet(source)
    q = answer_stream(index, stream, lambda df, _: out.update((r.q_id, json.loads(r.response)) for r in df.collect()), str(tmp_path / "at"))
    q.processAllAvailable()
    q.stop()
    assert "error" in out.pop(9) and out == got
    bad = [(1, None, 3, 4), (2, [], 3, 4), (3, [1.0], None, 4), (4, [1.0], 0, 4), (5, [1.0], 3, None), (6, [1.0], 3, -1), (7, [1.0] * 65, 3, 4), (8, [float("nan")], 3, 4), (9, [None, 1.0], 3, 4), (0, [1.0, 2.0], 3, 4)]
    got = {r.q_id: json.loads(r.response) for r in answer(index, spark.createDataFrame(bad, "q_id long, query array<float>, top_k int, probe int")).collect()}
    assert set(got) == set(range(10)) and all(("error" in got[k]) == (k > 0) for k in got) and len(got[0]["ids"]) == 3


def test_http(spark):
    x, index = case(spark)
    server = service(index, spark, 0, "127.0.0.1")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert urllib.request.urlopen(at + "/health").read() == b"Ok" == urllib.request.urlopen(at + "/").read()
        body = json.dumps({"query": x[5].tolist(), "top_k": 4, "probe": 2}).encode()
        found = json.loads(urllib.request.urlopen(at + "/query", body).read())
        assert found["ids"][0] == 5 and len(found["scores"]) == 4
        assert urllib.request.urlopen(at + "/metrics").read().startswith(b"query: 1, rough: ")
        for path, data, status in (("/query", b"{}", 422), ("/query", json.dumps({"query": [1.0], "top_k": 0, "probe": 1}).encode(), 422), ("/query", json.dumps({"query": [1.0], "top_k": None, "probe": 1}).encode(), 422), ("/query", b"nonsense", 422), ("/other", None, 404), ("/other", b"", 404)):
            try:
                urllib.request.urlopen(at + path, data)
                raise AssertionError(path)
            except urllib.error.HTTPError as e:
                assert e.code == status
    finally:
        server.shutdown()
        server.server_close()


def test_blocks_and_their_cache(spark, tmp_path):
    x, index = case(spark)
    index_files.dump_index_files(index, str(tmp_path / "i"))
    disk = index_files.load_index_files(spark, str(tmp_path / "i"))
    base, cache = str(tmp_path / "i" / index_files.BASE), str(tmp_path / "cache")
    own = BlockCache(base, cache, 7 * 4 * 65)
    assert (own.rows, own.dim, own.per) == (120, 64, 7)
    want = {r.pos: r.embedding for r in disk.codes.select("vec_id", "pos").join(disk.base, "vec_id").collect()}
    assert all(np.allclose(own.get(k), want[k]) for k in (0, 6, 7, 119, 3)) and own.misses == 3
    with sqlite3.connect(cache) as t:
        assert t.execute("select count(*) from matrix").fetchone()[0] == 7 + 7 + 1
        t.execute("update matrix set vec = zeroblob(256) where id = 7")
    own.fetch(1)  # a second writer changes nothing
    assert not own.get(7).any()
    again = BlockCache(base, cache, 7 * 4 * 65)
    again.get(119)
    assert again.misses == 0
    for bad in (-1, 120):
        with pytest.raises(IndexError):
            own.get(bad)
    uri, local = (tmp_path / "i").as_uri(), str(tmp_path / "local")
    assert len(index_files.download(uri, local)) == 5 and index_files.download(uri, local) == []
    (tmp_path / "local" / index_files.IDS).unlink()
    assert index_files.download(uri, local) == [index_files.IDS]
    disk = index_files.load_index_files(spark, local)  # without the vectors, which come by blocks
    fresh = BlockCache(f"{uri}/{index_files.BASE}", str(tmp_path / "fresh"), 7 * 4 * 65)
    server = service(disk, spark, 0, "127.0.0.1", fresh)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        exact = ((x[:6, None] - x) ** 2).sum(-1).argsort(1)[:, :5]
        got = evaluate.load(at + "/query", x[:6], exact, 5, 4)
        assert got["queries"] == 6 and got["failed"] == 0 and got["recall"] > 0.8 and got["latency"] > 0
        assert 0 < fresh.misses <= 18 and f"cache miss: {fresh.misses}" in urllib.request.urlopen(at + "/metrics").read().decode()
        (tmp_path / "q").write_bytes(vecs.encode(x[:4], "f32"))
        (tmp_path / "t").write_bytes(vecs.encode(exact[:4], "i32"))
        more = main(["load", "-u", at, "-q", str(tmp_path / "q"), "-t", str(tmp_path / "t"), "-k", "5", "-p", "4", "-l", "3", "-c", "--threads", "2"])
        assert more["queries"] == 3 and more["recall"] > 0.8
        failed = evaluate.load(at + "/other", x[:2], exact, 5, 4)
        assert failed["failed"] == 2 and failed["queries"] == 0
    finally:
        server.shutdown()
        server.server_close()


def test_command_line(spark, tmp_path):
    x = RNG.normal(size=(150, 20)).astype(np.float32)
    exact = ((x[:5, None] - x) ** 2).sum(-1).argsort(1)[:, :10]
    for name, rows, dtype in (("base", x, "f32"), ("query", x[:5], "f32"), ("truth", exact, "i32")):
        (tmp_path / name).write_bytes(vecs.encode(rows, dtype))
    p = lambda n: str(tmp_path / n)
    main(["train", p("base"), "2", "3", "--out", p("cent")])
    args = ["search", "-b", p("base"), "-c", p("cent"), "-q", p("query"), "-t", p("truth"), "-s", p("saved"), "-p", "100"]
    for more in ([], ["-h"], ["--rerank", "heap"]):
        assert main(args + more)["recall"] > 0.9


def test_recalls(spark):
    found = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 9, 3)], "q_id long, vec_id long, rank int")
    truth = spark.createDataFrame([(0, [2, 1, 3, 4]), (1, [5])], "q_id long, ids array<long>")
    assert {r.q_id: r.recall for r in evaluate.recall(found, truth, 3).collect()} == {0: 2 / 3, 1: 0.0}
    lists = evaluate.truth_lists(found)
    assert evaluate.recall_of_lists(lists, truth, 2).first().recall == 1.0
