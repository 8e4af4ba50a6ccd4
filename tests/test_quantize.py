"""The quantized sums of query_quantize against those of the kernel, which come from unrounded numbers."""

from vecloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_sums_come_from_unrounded_numbers(spark):
    want = {(r.q_id, r.cluster_id): r.q_sum for r in catalogue.probed(spark, DIR).collect()}
    assert {(r.q_id, r.cluster_id): r.q_sum for r in catalogue.query_quantize(spark, DIR).collect()} == want
