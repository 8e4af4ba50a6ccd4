import struct

import numpy as np
import pytest

from vecloom.sources import vecs


def test_round_trip_of_every_type(spark, tmp_path):
    for dtype, rows in (("f32", [[1.5, -2.0], [0.0, 3.25]]), ("i32", [[1, -2], [3, 4]]), ("u8", [[0, 255], [7, 8]]), ("u64", [[-1, 5], [1 << 62, 0]])):
        path = tmp_path / dtype
        path.write_bytes(vecs.encode(rows, dtype))
        got = vecs.read_vecs(spark, str(path), dtype).orderBy("ordinal").collect()
        assert [r.vec for r in got] == rows and [r.ordinal for r in got] == [0, 1]


def test_splits_keep_ordinals(spark, tmp_path, monkeypatch):
    x = np.arange(3000, dtype=np.float32).reshape(1000, 3)
    path = tmp_path / "x.fvecs"
    path.write_bytes(vecs.encode(x, "f32"))
    reader = vecs.VecsReader({"path": str(path)})
    monkeypatch.setattr(vecs, "SPLIT", 160)
    parts = reader.partitions()
    assert len(parts) == 100 and [p.first for p in parts] == list(range(0, 1000, 10))
    rows = [v for p in parts for b in reader.read(p) for v in b.column(1).to_pylist()]
    assert rows == x.tolist()
    assert vecs.dimension(str(path)) == 3


def test_cut_short_ragged_and_empty(spark, tmp_path):
    good = vecs.encode([[1, 2], [3, 4]], "f32")
    cut = tmp_path / "cut"
    cut.write_bytes(good[:-2])
    with pytest.raises(Exception, match="aren't records"):
        vecs.read_vecs(spark, str(cut)).collect()
    assert vecs.read_vecs(spark, str(cut), tolerant="true").count() == 1
    with pytest.raises(ValueError, match="cut short"):
        list(vecs.decode(good + b"\x01", "f32"))
    ragged = tmp_path / "ragged"
    ragged.write_bytes(vecs.encode([[1], [2, 3, 4], []], "f32"))
    assert [r.vec for r in vecs.read_vecs(spark, str(ragged), ragged="true").orderBy("ordinal").collect()] == [[1.0], [2.0, 3.0, 4.0], []]
    empty = tmp_path / "empty"
    empty.write_bytes(b"")
    assert vecs.read_vecs(spark, str(empty)).count() == 0
    with pytest.raises(ValueError):
        vecs.dimension(str(empty))


def test_written_files_follow_an_order(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in (5, 3, 9, 1)], "vec_id long, v array<double>")
    vecs.write_vecs(df, str(tmp_path / "out"), "v", order="vec_id")
    assert [r.vec[0] for r in vecs.read_vecs(spark, str(tmp_path / "out")).orderBy("ordinal").collect()] == [1.0, 3.0, 5.0, 9.0]
    assert struct.unpack("<I", vecs.encode([[1.0] * 7], "f32")[:4]) == (7,)


def test_some_records(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"p{k}.vecs").write_bytes(vecs.encode([[k, i, 7] for i in range(10)], "i32"))
    want = [[k, i, 7] for k in range(2) for i in range(10)]
    for first, count in ((0, 3), (8, 5), (19, 9), (25, 2), (3, 0)):
        for more in ({}, {"tolerant": "true"}):
            got = vecs.read_vecs(spark, str(tmp_path), "i32", first=str(first), count=str(count), **more).orderBy("ordinal").collect()
            assert [(r.ordinal, r.vec) for r in got] == [(n, want[n]) for n in range(first, min(20, first + count))]
    (tmp_path / "ragged").mkdir()
    (tmp_path / "ragged" / "r.vecs").write_bytes(vecs.encode([[1] * n for n in range(1, 8)], "i32"))
    got = vecs.read_vecs(spark, str(tmp_path / "ragged"), "i32", ragged="true", first="2", count="3").orderBy("ordinal").collect()
    assert [(r.ordinal, len(r.vec)) for r in got] == [(2, 3), (3, 4), (4, 5)]
