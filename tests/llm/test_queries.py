"""The registered queries: against their SQL, and the pipeline stage by stage."""

import zlib

import duckdb
import numpy as np
import pytest
from llm.helpers import SHAPE, awkward, frame, prose
from llm.test_dedup import brute_similar
from llm.test_output import brute_contamination, plain

import __spark_entry__ as entry
import corpus_pipeline
from vecloom.llm import mixing, quality
from vecloom.llm.common import NULL_ID
from vecloom.llm.decontaminate import SURE
from vecloom.llm.oracle import ORACLE_SQL

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_line_dedup", "op10_decontaminate", "op1_suffix_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = entry.queries()[name](spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and all((a[c].values == b[c].values).all() for c in columns)


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())


def rows_of(df):
    return sorted(((NULL_ID if r.doc_id is None else r.doc_id, r.text or "", r.source) for r in df.collect()), key=repr)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Nulls, copies, rows that share an id, passages of the benchmark; each stage's rows by plain means."""
    texts = awkward() + [(800, "one more text of its own"), (None, "another without an id, and with words of its own")]
    stock = [t for _, t in texts if t and len(t) > 250 and len(set(t.split())) > 30][:4]
    items = [(k, t[30:150]) for k, t in enumerate(stock)] + [(50, "é é"), (None, None)]
    texts += [(900 + k, " ".join(prose(300 + k, 12)) + " " + stock[k][20:190]) for k in range(3)]
    docs = frame(spark, texts)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(d, int(k % 3 > 0), 0) for k, (d, _) in enumerate(texts) if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, here = dict(corpus_pipeline.STAGES), str(tmp_path)

    net = quality.fit(docs, spark.read.parquet(f"{here}/labels.parquet"))
    good = {(r.doc_id, r.key) for r in quality.score(docs, net).where("score >= 0.5").collect()}
    key = {r.text: r.k for r in spark.createDataFrame([(t or "",) for _, t in texts], "text string").selectExpr("text", "xxhash64(text) k").collect()}
    assert rows_of(stages["quality classifier"](spark, docs, here)) == [r for r in rows_of(docs) if (r[0], key[r[1]]) in good]

    kept = rows_of(stages["SimHash near-dedup"](spark, docs, here))
    own = [(NULL_ID if d is None else d, t or "") for d, t in texts]
    first = {min((own[i][0], key[own[i][1]]) for i in group) for group in brute_similar(texts)}
    assert sorted((d, key[t]) for d, t, _ in kept) == sorted(first)

    found = brute_contamination(texts, items, longest=True)
    bad = {NULL_ID if x[0] is None else x[0] for x in found if x[5] or x[6] >= SURE}
    clean = rows_of(stages["benchmark decontamination"](spark, docs, here))
    shared = {d for d, _ in own if sum(x == d for x, _ in own) > 1}
    assert [r for r in clean if r[0] not in shared] == [r for r in rows_of(docs) if r[0] not in shared | bad] and {900, 901, 902} <= bad

    mixed = rows_of(stages["mixing sources"](spark, docs, here))
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    got = {}
    for d, _, source in mixed:
        got[d, source] = got.get((d, source), 0) + 1
    assert got == {k: n for k, n in want.items() if n}

    ids = sorted((NULL_ID if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in stages["token-ID output"](spark, docs, here).collect())
    assert ids == sorted((d, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for (d, _), x in zip(own, plain([t for _, t in own])))


def test_pipeline_of_nothing(spark, tmp_path):
    for name, shape in (("documents", SHAPE), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, before, DIR)
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        assert kept.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= ids and kept.count() > 0, name
        before = kept
    last = corpus_pipeline.STAGES[-1][1](spark, before, DIR)
    assert last.count() == before.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(r.doc_id for r in before.collect())
