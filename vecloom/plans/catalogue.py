"""Named queries over the table `embeddings`, one or more for each operator, and the same in DuckDB's SQL.

Centroids are the labels' means and, but where a name says otherwise, the rotation is the identity, so that both
engines compute the same numbers. Distances are rounded to six places.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import rotation
from vecloom.functions import vectors as V
from vecloom.functions.kernels import probes
from vecloom.operators import cluster, evaluate
from vecloom.operators import search as S
from vecloom.operators.index import Index, build_index
from vecloom.sources import index_files, vecs
from vecloom.sources.folders import mounted, shared_folder
from vecloom.streaming.serve import answer_stream

DIM, PROBE, K, EVERY, MOST_LABELS = 64, 3, 10, 50, 4096


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", V.vector(F.col("embedding")).alias("v"), "label")


def the_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every row whose id is divisible by EVERY."""
    return embeddings(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv"))


def the_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = cluster.centroid_means(embeddings(spark, sf_dir), "label", "embedding", DIM)
    rows = means.limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        return means
    return spark.createDataFrame(rows, means.schema).coalesce(1)  # few labels: they are read many times below


def the_index(spark: SparkSession, sf_dir: str, turn: np.ndarray | None = None) -> Index:
    return build_index(embeddings(spark, sf_dir), the_centroids(spark, sf_dir), rotation.identity(DIM) if turn is None else turn)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = the_index(spark, sf_dir)
    return S.candidates(index, probed(spark, sf_dir))


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes(the_queries(spark, sf_dir), the_centroids(spark, sf_dir), DIM, PROBE)


def six(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, without a negative zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c)


def with_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = the_centroids(spark, sf_dir).select("cluster_id", "centroid")
    df = doubles(spark, sf_dir)
    return df.join(means, df["label"] == means["cluster_id"])


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(embeddings(spark, sf_dir).select("vec_id", "embedding"), the_centroids(spark, sf_dir), "embedding", DIM)


def found(df: DataFrame) -> DataFrame:
    return df.select("q_id", "vec_id", six("dist"), F.col("rank").cast("int").alias("rank"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EMB = "e as (select vec_id, label, embedding::double[] v from embeddings)"
CEN = "cen as (select cluster_id, list(m order by i) c from (select label cluster_id, i, avg(v[i]) m from e, range(1, 65) t(i) group by all) group by cluster_id)"
QUE = f"q as (select vec_id q_id, v y from e where vec_id % {EVERY} = 0)"
L2 = "list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
ASG = f"asg as (select vec_id, v, cluster_id, c, d2 from (select vec_id, v, cluster_id, c, {L2.format(a='v', b='c')} d2 from e, cen) qualify row_number() over (partition by vec_id order by d2, cluster_id) = 1)"
IDX = """res as (select *, list_transform(range(1, 65), lambda i: v[i] - c[i]) r from asg),
fac as (select *, case when d2 > 0 then list_sum(list_transform(r, lambda x: abs(x))) / (sqrt(d2) * 8.0) else 0.8 end cosine, list_sum(list_transform(r, lambda x: case when x > 0 then 1.0 else -1.0 end))::double signs from res),
idx as (select *, -2.0 / 8.0 * (sqrt(d2) / cosine) factor_ip, -2.0 / 8.0 * (sqrt(d2) / cosine) * signs factor_ppc,
  2 * 1.9 / sqrt(63.0) * sqrt(greatest(0.0, (sqrt(d2) / cosine) * (sqrt(d2) / cosine) - d2)) error_bound from fac)"""
PRO = f"""pro as (select q_id, y, cluster_id, g2, list_transform(range(1, 65), lambda i: y[i] - c[i]) t, row_number() over (partition by q_id order by g2, cluster_id) probe_rank
  from (select *, {L2.format(a='y', b='c')} g2 from q, cen) qualify probe_rank <= {PROBE}),
qua as (select *, list_min(t) low, (list_max(t) - list_min(t)) / 15.0 delta from pro),
qnt as (select *, list_transform(t, lambda x: case when delta = 0 then 0 else round_even(round_even((x - low) / delta * 1073741824, 0) / 1073741824, 0)::int end) n from qua)"""
CAN = """can as (select q_id, y, vec_id, v, cluster_id, probe_rank, d2, d2 + g2 + low * factor_ppc
  + (2.0 * list_sum(list_transform(range(1, 65), lambda i: case when r[i] > 0 then n[i] else 0 end)) - list_sum(n)) * factor_ip * delta - error_bound * sqrt(g2) rough
  from idx join qnt using (cluster_id))"""
EXA = f"exa as (select *, {L2.format(a='v', b='y')} dist from can)"
ALL = ", ".join([EMB, CEN, QUE, ASG, IDX, PRO, CAN, EXA])
TWO = f"""near as (select * from exa qualify row_number() over (partition by q_id order by rough, vec_id) <= {K}),
lim as (select q_id, case when count(*) = {K} then max(dist) else 'infinity'::double end limit_ from near group by q_id),
two as (select q_id, vec_id, dist, row_number() over (partition by q_id order by dist, vec_id) rank from exa join lim using (q_id) where rough <= limit_ qualify rank <= {K})"""
#: The scan that looks at candidates in turn: a step for each place in the order.
SCAN = """ord as (select q_id, vec_id, rough, dist, row_number() over (partition by q_id order by probe_rank, d2, vec_id) i from exa),
fold as (select q_id, 0::bigint i, []::struct(d double, v bigint)[] kept, 'infinity'::double lim, 0 n, '-infinity'::double worst, 0::bigint precise from q
  union all select f.q_id, o.i, case when hit then new else kept end, case when hit then {limit} else lim end, case when hit then {count} else n end, case when hit then {worst_} else worst end, precise + (rough < lim)::bigint
  from fold f join (select * from ord) o on o.q_id = f.q_id and o.i = f.i + 1,
  lateral (select o.rough < f.lim and o.dist < f.lim hit, {new} new, greatest(f.worst, o.dist) w) s),
last as (select * from fold qualify row_number() over (partition by q_id order by i desc) = 1),
sca as (select q_id, x.v vec_id, x.d dist, row_number() over (partition by q_id order by x.d, x.v) rank, precise, i n_rough from (select q_id, unnest(kept) x, precise, i from last) qualify rank <= """ + str(K) + ")"
ADD = "list_append(f.kept, {{'d': o.dist, 'v': o.vec_id}})"
HEAP = SCAN.format(new=f"list_sort({ADD.replace('{{', '{').replace('}}', '}')})[1:{K}]", limit=f"case when len(new) = {K} then new[{K}].d else lim end", count="0", worst_="worst")
WINDOWED = SCAN.format(new=ADD.replace("{{", "{").replace("}}", "}"), limit=f"case when n + 1 >= {S.WINDOW} then w else lim end", count=f"case when n + 1 >= {S.WINDOW} then 0 else n + 1 end", worst_=f"case when n + 1 >= {S.WINDOW} then '-infinity'::double else w end")
BITS = "list_sum(list_transform(range(0, 64), lambda i: case when {x}[i + 1]{cond} then (case when i = 63 then -9223372036854775807 - 1 else 1::bigint << i end) else 0 end))::bigint"
TRUE_ = f"tru as (select q_id, vec_id, dist, row_number() over (partition by q_id order by dist, vec_id) rank from (select q_id, vec_id, {L2.format(a='v', b='y')} dist from e, q) qualify rank <= {K})"


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("knn_exact_topk", f"with {EMB}, {QUE}, {TRUE_} select q_id, vec_id, round(dist, 6) + 0.0 dist, rank::int rank from tru")
def knn_exact_topk(spark, d):
    return found(S.knn_exact(embeddings(spark, d), the_queries(spark, d), K, DIM))


@query("vec_dot", f"with {EMB}, {CEN} select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * c[i])), 6) + 0.0 as dot from e join cen on label = cluster_id")
def vec_dot(spark, d):
    return with_centroid(spark, d).select("vec_id", six(V.dot(F.col("v"), F.col("centroid"), DIM), "dot"))


@query("vec_l2", f"with {EMB}, {CEN} select vec_id, round({L2.format(a='v', b='c')}, 6) + 0.0 as l2 from e join cen on label = cluster_id")
def vec_l2(spark, d):
    return with_centroid(spark, d).select("vec_id", six(V.l2(F.col("v"), F.col("centroid"), DIM), "l2"))


@query("vec_norm", f"with {EMB}, {CEN} select vec_id, round(sqrt({L2.format(a='v', b='c')}), 6) + 0.0 as norm from e join cen on label = cluster_id")
def vec_norm(spark, d):
    return with_centroid(spark, d).select("vec_id", six(V.norm(V.residual(F.col("v"), F.col("centroid"))), "norm"))


@query("vec_pad", "select vec_id, 64 as size, round(list_sum(embedding[1:50]::double[]), 6) + 0.0 as total, round(embedding[50]::double, 6) + 0.0 as value_50, 0.0::double as value_51 from embeddings")
def vec_pad(spark, d):
    v = V.pad(F.slice("v", 1, 50))
    return doubles(spark, d).select("vec_id", F.size(v).alias("size"), six(V.total(v), "total"), six(v[49], "value_50"), six(v[50], "value_51"))


@query("vec_residual_minmax", f"with {EMB}, {CEN} select vec_id, round(list_min(r), 6) + 0.0 as low, round(list_max(r), 6) + 0.0 as high from (select vec_id, list_transform(range(1, 65), lambda i: v[i] - c[i]) r from e join cen on label = cluster_id)")
def vec_residual_minmax(spark, d):
    df = with_centroid(spark, d).select("vec_id", V.residual(F.col("v"), F.col("centroid")).alias("r"))
    return df.select("vec_id", six(F.array_min("r"), "low"), six(F.array_max("r"), "high"))


@query("vec_binarize_code", f"with {EMB} select vec_id, {BITS.format(x='v', cond=' > 0')} as code from e")
def vec_binarize_code(spark, d):
    return doubles(spark, d).select("vec_id", V.sign_code(F.col("v"), DIM)[0].alias("code"))


@query("vec_sign_sum", f"with {EMB} select vec_id, list_sum(list_transform(v, lambda x: case when x > 0 then 1.0 else -1.0 end))::double as sign_sum from e")
def vec_sign_sum(spark, d):
    return doubles(spark, d).select("vec_id", V.total(V.signs(F.col("v"))).alias("sign_sum"))


def probed_residuals(spark, d) -> DataFrame:
    """q_id, cluster_id, t (the query less the centroid), low and delta for each query's nearest clusters, by expressions."""
    near = probed(spark, d).select("q_id", "cluster_id")
    t = near.join(the_queries(spark, d), "q_id").join(the_centroids(spark, d), "cluster_id").select("q_id", "cluster_id", V.residual(V.vector(F.col("qv")), F.col("centroid")).alias("t"))
    return t.withColumn("low", F.array_min("t")).withColumn("delta", V.step_size(F.col("low"), F.array_max("t")))


def summed(n: Column) -> Column:
    return F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x)


@query("query_quantize", f"with {EMB}, {CEN}, {QUE}, {PRO} select q_id, cluster_id, round(low, 6) + 0.0 as low, round(delta, 6) + 0.0 as delta, list_sum(n)::bigint as q_sum from qnt")
def query_quantize(spark, d):
    n = V.quantize(F.col("t"), F.col("low"), F.col("delta"))
    df = probed_residuals(spark, d).withColumn("q_sum", summed(n))  # beside the rounded columns, a lambda would take low and delta from those
    return df.select("q_id", "cluster_id", six("low"), six("delta"), "q_sum")


BIASED = "list_sum(list_transform(range(1, 65), lambda i: case when delta = 0 then 0 else floor((t[i] - low) / delta + {bias})::int end))::bigint as q_sum"


@query("query_quantize_biased", f"with {EMB}, {CEN}, {QUE}, {PRO} select q_id, cluster_id, {BIASED.format(bias='0.5')} from qua")
def query_quantize_biased(spark, d):
    bias = F.array(*map(F.lit, rotation.fixed_bias(DIM).tolist()))
    return probed_residuals(spark, d).select("q_id", "cluster_id", summed(V.quantize_biased(F.col("t"), F.col("low"), F.col("delta"), bias)).alias("q_sum"))


@query("query_quantize_random_bias", f"with {EMB}, {CEN}, {QUE}, {PRO} select q_id, cluster_id, {BIASED.format(bias=f'({rotation.random_bias(DIM).tolist()})[i]')} from qua")
def query_quantize_random_bias(spark, d):
    """Seeded biases, which the SQL holds as numbers."""
    bias = F.array(*map(F.lit, rotation.random_bias(DIM).tolist()))
    return probed_residuals(spark, d).select("q_id", "cluster_id", summed(V.quantize_biased(F.col("t"), F.col("low"), F.col("delta"), bias)).alias("q_sum"))


PLANES = ", ".join(BITS.format(x="n", cond=f" >> {j} & 1 = 1").replace("n[i + 1] >>", "(n[i + 1] >>").replace("& 1 =", "& 1) =") + f" as plane_{j}" for j in range(4))


@query("query_bitplanes", f"with {EMB}, {CEN}, {QUE}, {PRO} select q_id, cluster_id, {PLANES} from qnt")
def query_bitplanes(spark, d):
    return probed(spark, d).select("q_id", "cluster_id", *[F.col("planes")[j][0].alias(f"plane_{j}") for j in range(4)])


@query("query_bitplanes_expression", f"with {EMB}, qnt as (select vec_id, list_transform(v, lambda x: abs(round_even(x * 15, 0))::int) n from e) select vec_id, {PLANES} from qnt")
def query_bitplanes_expression(spark, d):
    n = F.transform("v", lambda x: F.abs(F.rint(x * 15)).cast("int"))
    planes = doubles(spark, d).select("vec_id", V.bit_planes(n, DIM).alias("p"))
    return planes.select("vec_id", *[F.col("p")[j][0].alias(f"plane_{j}") for j in range(4)])


@query("binary_dot", f"with {EMB}, {CEN} select vec_id, list_sum(list_transform(range(1, 65), lambda i: (v[i] > 0 and c[i] > 0)::int))::int as bits from e join cen on label = cluster_id")
def binary_dot(spark, d):
    return with_centroid(spark, d).select("vec_id", V.binary_dot(V.sign_code(F.col("v"), DIM), V.sign_code(F.col("centroid"), DIM), 1).cast("int").alias("bits"))


@query("asym_binary_dot", f"with {EMB}, {CEN}, {QUE}, {ASG}, {IDX}, {PRO} select q_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: case when r[i] > 0 then n[i] else 0 end))::int as asym from idx join qnt using (cluster_id)")
def asym_binary_dot(spark, d):
    return the_index(spark, d).codes.join(probed(spark, d), "cluster_id").select("q_id", "vec_id", V.asymmetric_dot(F.col("code"), F.col("planes"), 1).cast("int").alias("asym"))


HAD = "list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * (case when bit_count(i & {j}) % 2 = 1 then -1.0 else 1.0 end))) / 8.0"


@query("rotate_hadamard", f"with {EMB} select vec_id, {', '.join(f'round({HAD.format(j=j)}, 6) + 0.0 as y_{j}' for j in (0, 1, 37, 63))} from e")
def rotate_hadamard(spark, d):
    turned = cluster.rotate(doubles(spark, d), "v", rotation.hadamard(DIM))
    return turned.select("vec_id", *[six(F.col("v")[j], f"y_{j}") for j in (0, 1, 37, 63)])


@query("centroid_mean", f"with {EMB} select label::int cluster_id, (i - 1)::int as at, count(*)::bigint as n, round(avg(v[i]), 6) + 0.0 as value from e, range(1, 65) t(i) group by label, i")
def centroid_mean(spark, d):
    return the_centroids(spark, d).select("cluster_id", "n", F.posexplode("centroid").alias("at", "value")).select("cluster_id", "at", "n", six("value"))


@query("lloyd_step", f"with {EMB}, {CEN}, {ASG} select cluster_id::int cluster_id, (i - 1)::int as at, count(*)::bigint as n, round(avg(v[i]), 6) + 0.0 as value from asg, range(1, 65) t(i) group by cluster_id, i")
def lloyd_step(spark, d):
    step = cluster.lloyd_step(embeddings(spark, d), the_centroids(spark, d), "embedding", DIM)
    return step.select("cluster_id", "n", F.posexplode("centroid").alias("at", "value")).select("cluster_id", "at", "n", six("value"))


@query("cluster_assign", f"with {EMB}, {CEN}, {ASG} select vec_id, cluster_id::int as cluster_id, round(d2, 6) + 0.0 as dist from asg")
def cluster_assign(spark, d):
    return assigned(spark, d).select("vec_id", "cluster_id", six("center_distance_square", "dist"))


@query("cluster_sizes_offsets", f"with {EMB}, {CEN}, {ASG}, s as (select cen.cluster_id, count(vec_id) n from cen left join asg using (cluster_id) group by all) select cluster_id::int as cluster_id, n::bigint as n, coalesce(sum(n) over (order by cluster_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from s")
def cluster_sizes_offsets(spark, d):
    return cluster.offsets(assigned(spark, d), the_centroids(spark, d))


@query("cluster_layout", f"with {EMB}, {CEN}, {ASG} select vec_id, cluster_id::int as cluster_id, (row_number() over (order by cluster_id, d2, vec_id) - 1)::bigint as pos from asg")
def cluster_layout(spark, d):
    return cluster.layout(assigned(spark, d)).select("vec_id", "cluster_id", "pos")


FACTORS = ("center_distance_square", "factor_ip", "factor_ppc", "error_bound")
FACTOR_SQL = f"with {EMB}, {CEN}, {ASG}, {IDX} select vec_id, cluster_id::int as cluster_id, {BITS.format(x='r', cond=' > 0')} as code, round(d2, 6) + 0.0 as center_distance_square, round(factor_ip, 6) + 0.0 as factor_ip, round(factor_ppc, 6) + 0.0 as factor_ppc, round(error_bound, 6) + 0.0 as error_bound from idx"


@query("index_factors", FACTOR_SQL)
def index_factors(spark, d):
    return the_index(spark, d).codes.select("vec_id", "cluster_id", F.col("code")[0].alias("code"), *map(six, FACTORS))


@query("index_factors_expression", FACTOR_SQL)
def index_factors_expression(spark, d):
    """The same by expressions alone."""
    rows = assigned(spark, d).join(the_centroids(spark, d).select("cluster_id", "centroid"), "cluster_id").withColumn("r", V.residual(V.vector(F.col("embedding")), F.col("centroid")))
    return rows.select("vec_id", "cluster_id", V.sign_code(F.col("r"), DIM)[0].alias("code"), *[six(c, n) for n, c in V.factors(F.col("r"), DIM).items()])


@query("probe_select", f"with {EMB}, {CEN}, {QUE}, {PRO} select q_id, cluster_id::int as cluster_id, probe_rank::int as probe_rank, round(g2, 6) + 0.0 as g2 from pro")
def probe_select(spark, d):
    return probed(spark, d).select("q_id", "cluster_id", "probe_rank", six("g2"))


@query("rough_distance", f"with {ALL} select q_id, vec_id, round(rough, 6) + 0.0 as rough from can")
def rough_distance(spark, d):
    return scored(spark, d).select("q_id", "vec_id", six("rough"))


@query("bound_violation_rate", f"with {ALL} select count(*)::bigint as n, count_if(rough > dist)::bigint as above, round(count_if(rough > dist) / count(*)::double, 6) as rate from exa")
def bound_violation_rate(spark, d):
    each = S.violations(the_index(spark, d), the_queries(spark, d), PROBE)
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("above"), F.lit(0)).alias("above")).withColumn("rate", F.round(F.col("above") / F.col("n"), 6))


@query("ivf_flat_topk", f"with {ALL} select q_id, vec_id, round(dist, 6) + 0.0 as dist, (row_number() over (partition by q_id order by exa.dist, vec_id))::int as rank from exa qualify rank <= {K}")
def ivf_flat_topk(spark, d):
    return found(S.ivf_flat(the_index(spark, d), the_queries(spark, d), PROBE, K))


@query("ann_search_heap", f"with {ALL}, {TWO} select q_id, vec_id, round(dist, 6) + 0.0 as dist, rank::int as rank from two")
def ann_search_heap(spark, d):
    return found(S.search(the_index(spark, d), the_queries(spark, d), PROBE, K))


@query("ann_search_heap_sequential", f"with recursive {ALL}, {HEAP} select q_id, vec_id, round(dist, 6) + 0.0 as dist, rank::int as rank from sca")
def ann_search_heap_sequential(spark, d):
    return found(S.search(the_index(spark, d), the_queries(spark, d), PROBE, K, "heap"))


@query("ann_search_heuristic", f"with recursive {ALL}, {WINDOWED} select q_id, vec_id, round(dist, 6) + 0.0 as dist, rank::int as rank from sca")
def ann_search_heuristic(spark, d):
    return found(S.search(the_index(spark, d), the_queries(spark, d), PROBE, K, "heuristic"))


@query("ann_search_disk", f"with {ALL}, {TWO} select q_id, vec_id, round(dist, 6) + 0.0 as dist, rank::int as rank from two")
def ann_search_disk(spark, d):
    """Through a saved index: a search reads the codes of the probed clusters, then the vectors of what is left."""
    path = shared_folder(spark)
    the_index(spark, d).save(path)
    return found(S.search(Index.load(spark, path), the_queries(spark, d), PROBE, K))


@query("block_misses", f"with {ALL}, pla as (select vec_id, row_number() over (order by cluster_id, d2, vec_id) - 1 pos from asg), near as (select * from exa qualify row_number() over (partition by q_id order by rough, vec_id) <= {K}) select (pos // (524288 // 260))::bigint as block, count(*)::bigint as reads from near join pla using (vec_id) group by all")
def block_misses(spark, d):
    """Blocks of a vector file that the first stage of a search reads, and how often; each is missed once by a cache."""
    near = S.least_bounds(the_index(spark, d), the_queries(spark, d), PROBE, K)
    places = cluster.layout(assigned(spark, d)).select("vec_id", "pos")
    return S.blocks_of(near.join(places, "vec_id"), DIM).groupBy("block").agg(F.count("*").alias("reads"))


@query("recall_at_k", f"with {ALL}, {TRUE_}, {TWO} select q_id, count(two.vec_id)::bigint as hits, count(two.vec_id) / {K}.0::double as recall from tru left join two using (q_id, vec_id) group by q_id")
def recall_at_k(spark, d):
    truth = evaluate.truth_lists(S.knn_exact(embeddings(spark, d), the_queries(spark, d), K, DIM))
    return evaluate.recall(S.search(the_index(spark, d), the_queries(spark, d), PROBE, K), truth, K)


@query("recall_client", f"with {ALL}, {TRUE_}, {TWO} select q_id, round(count(two.vec_id) / 5.0, 6)::double as recall from (select * from tru where rank <= 5) tru left join (select * from two where rank <= 5) two using (q_id, vec_id) group by q_id")
def recall_client(spark, d):
    truth = evaluate.truth_lists(S.knn_exact(embeddings(spark, d), the_queries(spark, d), K, DIM))
    lists = evaluate.truth_lists(S.search(the_index(spark, d), the_queries(spark, d), PROBE, K))
    return evaluate.recall_of_lists(lists, truth, 5).select("q_id", F.round("recall", 6).alias("recall"))


@query("recall_mean", f"with {ALL}, {TRUE_}, {TWO} select count(*)::bigint as queries, round(avg(recall), 6) as recall from (select q_id, count(two.vec_id) / {K}.0::double recall from tru left join two using (q_id, vec_id) group by q_id)")
def recall_mean(spark, d):
    return recall_at_k(spark, d).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"))


@query("search_metrics", f"with recursive {ALL}, {HEAP} select count(*)::bigint as query, sum(i)::bigint as rough, sum(precise)::bigint as precise, round(sum(i) / sum(precise)::double, 2) as ratio from last")
def search_metrics(spark, d):
    return evaluate.search_metrics(S.scans(the_index(spark, d), the_queries(spark, d), PROBE, K))


@query("hash_sample_global", "select vec_id, label from embeddings order by md5(vec_id::varchar), vec_id limit 100")
def hash_sample_global(spark, d):
    return cluster.hash_sample(embeddings(spark, d), 100).select("vec_id", "label")


@query("hash_sample_per_cluster", "select vec_id, label from embeddings qualify row_number() over (partition by label order by md5(vec_id::varchar), vec_id) <= 5")
def hash_sample_per_cluster(spark, d):
    return cluster.hash_sample(embeddings(spark, d), 5, by="label").select("vec_id", "label")


def lloyd_sql(points: str, k: int, steps: int, tag: str, by: str = "") -> str:
    """CTEs for k-means of the rows (vec_id, v, h) of `points`, from the first k by h; `by` names a column of groups."""
    g = f"{by}, " if by else ""
    on = f"using ({by})" if by else "on true"
    out = [f"{tag}0 as (select {g}(row_number() over ({f'partition by {by} ' if by else ''}order by h, vec_id) - 1)::int k, v c from {points} qualify k < {k})"]
    for s in range(steps):
        out.append(f"{tag}a{s} as (select {g}vec_id, v, k from (select {g}vec_id, v, k, {L2.format(a='v', b='c')} d from {points} join {tag}{s} {on}) qualify row_number() over (partition by vec_id order by d, k) = 1)")
        out.append(f"{tag}m{s} as (select {g}k, list(m order by i) c from (select {g}k, i, avg(v[i]) m from {tag}a{s}, range(1, 65) t(i) group by all) group by all)")
        out.append(f"{tag}{s + 1} as (select o.{f'{by}, o.' if by else ''}k, coalesce(n.c, o.c) c from {tag}{s} o left join {tag}m{s} n using ({g}k))")
    return ",\n".join(out)


PTS = "pts as (select vec_id, embedding::double[] v, md5(vec_id::varchar) h from embeddings)"
VALUES = "(i - 1)::int as at, round(c[i], 6) + 0.0 as value"


@query("kmeans", f"with {PTS}, {lloyd_sql('pts', 8, 3, 'w')} select k::int as cluster_id, {VALUES} from w3, range(1, 65) t(i)")
def kmeans(spark, d):
    found_ = cluster.kmeans(embeddings(spark, d), "embedding", 8, DIM, 3)
    return found_.select("cluster_id", F.posexplode("centroid").alias("at", "value")).select("cluster_id", "at", six("value"))


@query(
    "hierarchical_centroids",
    f"""with {PTS}, sam as (select * from pts order by h, vec_id limit 160), {lloyd_sql('sam', 4, 3, 'w')},
    sor as (select vec_id, v, h, k top from (select vec_id, v, h, k, {L2.format(a='v', b='c')} d from pts, w3) qualify row_number() over (partition by vec_id order by d, k) = 1),
    low as (select * from sor qualify row_number() over (partition by top order by h, vec_id) <= 120), {lloyd_sql('low', 3, 3, 'x', 'top')}
    select (top * 3 + k)::int as cluster_id, {VALUES} from x3, range(1, 65) t(i)""",
)
def hierarchical_centroids(spark, d):
    found_ = cluster.hierarchical_kmeans(embeddings(spark, d), "embedding", 4, 3, DIM, 40, 3)
    return found_.select("cluster_id", F.posexplode("centroid").alias("at", "value")).select("cluster_id", "at", six("value"))


@query("query_response_json", f"with {ALL}, {TWO} select q_id, rank::int as rank, vec_id, round(dist, 6) + 0.0 as score from two")
def query_response_json(spark, d):
    """Responses, read back: ids and scores in rank order."""
    asked = evaluate.responses(S.search(the_index(spark, d), the_queries(spark, d), PROBE, K))
    read = asked.select("q_id", F.from_json("response", "ids array<bigint>, scores array<double>").alias("r"))
    return read.select("q_id", F.posexplode(F.arrays_zip("r.ids", "r.scores")).alias("at", "x")).select("q_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), six("x.scores", "score"))


@query("stream_answers", f"with {ALL}, {TWO} select q_id, rank::int as rank, vec_id, round(dist, 6) + 0.0 as score from two")
def stream_answers(spark, d):
    """JSON requests as a stream of files, answered in micro-batches, stored by batch."""
    root = shared_folder(spark)
    asked = the_queries(spark, d).select("q_id", F.to_json(F.struct(F.col("qv").alias("query"), F.lit(K).alias("top_k"), F.lit(PROBE).alias("probe"))).alias("value"))
    asked.write.parquet(f"{root}/requests")
    the_index(spark, d).save(f"{root}/index")
    requests = spark.readStream.schema(asked.schema).parquet(f"{root}/requests")
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/answers/batch={batch}")
    answer_stream(Index.load(spark, f"{root}/index"), requests, sink, f"{root}/at", once=True).awaitTermination()
    read = spark.read.schema("q_id long, response string").parquet(f"{root}/answers/*").select("q_id", F.from_json("response", "ids array<bigint>, scores array<double>").alias("r"))
    return read.select("q_id", F.posexplode(F.arrays_zip("r.ids", "r.scores")).alias("at", "x")).select("q_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), six("x.scores", "score"))


ROUND_TRIP = "select (row_number() over (order by vec_id) - 1)::bigint as ordinal, round(list_sum(embedding::double[]), 6) + 0.0 as total, len(embedding)::int as size, embedding[64] as last from embeddings"


@query("fvecs_roundtrip", ROUND_TRIP)
def fvecs_roundtrip(spark, d):
    path = os.path.join(mounted(shared_folder(spark)), "base")
    vecs.write_vecs(embeddings(spark, d), path, "embedding", order="vec_id")
    v = V.vector(F.col("vec"))
    return vecs.read_vecs(spark, path).select("ordinal", six(V.total(v), "total"), F.size("vec").alias("size"), F.col("vec")[63].alias("last"))


@query("ivecs_roundtrip", f"with {EMB}, {QUE}, {TRUE_} select (row_number() over (order by q_id) - 1)::bigint as ordinal, string_agg(vec_id::varchar, ',' order by rank) as ids from tru group by q_id")
def ivecs_roundtrip(spark, d):
    path = os.path.join(mounted(shared_folder(spark)), "truth")
    truth = evaluate.truth_lists(S.knn_exact(embeddings(spark, d), the_queries(spark, d), K, DIM))
    vecs.write_vecs(truth.withColumn("ids", F.col("ids").cast("array<int>")), path, "ids", "i32", "q_id")
    return vecs.read_vecs(spark, path, "i32").select("ordinal", F.array_join("vec", ",").alias("ids"))


@query("bvecs_roundtrip", f"with {EMB} select (row_number() over (order by vec_id) - 1)::bigint as ordinal, list_sum(list_transform(v, lambda x: abs(round_even(x * 255, 0))::int))::bigint as total, abs(round_even(v[64] * 255, 0))::int as last from e")
def bvecs_roundtrip(spark, d):
    """Files of bytes."""
    path = os.path.join(mounted(shared_folder(spark)), "bytes")
    vecs.write_vecs(doubles(spark, d).select("vec_id", F.transform("v", lambda x: F.abs(F.rint(x * 255)).cast("int")).alias("b")), path, "b", "u8", "vec_id")
    return vecs.read_vecs(spark, path, "u8").select("ordinal", F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.col("vec")[63].alias("last"))


@query("fvecs_range", f"select * from ({ROUND_TRIP}) where ordinal >= 100 and ordinal < 350")
def fvecs_range(spark, d):
    """A range of records; the reader reads no others."""
    path = os.path.join(mounted(shared_folder(spark)), "base")
    vecs.write_vecs(embeddings(spark, d), path, "embedding", order="vec_id")
    return vecs.read_vecs(spark, path, first="100", count="250").select("ordinal", six(V.total(V.vector(F.col("vec"))), "total"), F.size("vec").alias("size"), F.col("vec")[63].alias("last"))


@query("u64vecs_roundtrip", f"with {EMB} select (row_number() over (order by vec_id) - 1)::bigint as ordinal, {BITS.format(x='v', cond=' > 0')} as code from e")
def u64vecs_roundtrip(spark, d):
    path = os.path.join(mounted(shared_folder(spark)), "codes")
    vecs.write_vecs(doubles(spark, d).select("vec_id", V.sign_code(F.col("v"), DIM).alias("code")), path, "code", "u64", "vec_id")
    return vecs.read_vecs(spark, path, "u64").select("ordinal", F.col("vec")[0].alias("code"))


@query("index_json_roundtrip", FACTOR_SQL)
def index_json_roundtrip(spark, d):
    path = shared_folder(spark)
    the_index(spark, d).save_json(path)
    return Index.load_json(spark, path).codes.select("vec_id", "cluster_id", F.col("code")[0].alias("code"), *map(six, FACTORS))


@query("rotated_distance", f"with {EMB}, {CEN} select vec_id, round({L2.format(a='v', b='c')}, 6) + 0.0 as dist from e join cen on label = cluster_id")
def rotated_distance(spark, d):
    """A random rotation leaves distances as they are."""
    turn = rotation.random_orthogonal(DIM)
    both = cluster.rotate(cluster.rotate(with_centroid(spark, d).select("vec_id", "v", "centroid"), "v", turn), "centroid", turn)
    return both.select("vec_id", six(V.l2(F.col("v"), F.col("centroid"), DIM), "dist"))


#: The same with the rotation's columns in the SQL: codes, queries and centroids are turned, exact distances are not.
TURN = rotation.random_orthogonal(DIM)
TURNED = "list_transform(range(1, 65), lambda j: list_sum(list_transform(range(1, 65), lambda i: {x}[i] * (rot[j])[i])))"
ROT = f"rot as materialized (select {[[float(x) for x in TURN[:, j]] for j in range(DIM)]}::double[][] rot)"
TURNED_ALL = (
    f"{ROT}, raw as (select vec_id, label, embedding::double[] v from embeddings), e as materialized (select vec_id, label, {TURNED.format(x='v')} v from raw, rot), "
    + ", ".join([CEN, f"q as (select vec_id q_id, v y from e where vec_id % {EVERY} = 0)", ASG, IDX, PRO, CAN, EXA])
)


@query("qr_rotation_search", f"with {TURNED_ALL}, {TWO} select q_id, vec_id, round(dist, 6) + 0.0 as dist, rank::int as rank from two")
def qr_rotation_search(spark, d):
    return found(S.search(the_index(spark, d, TURN), the_queries(spark, d), PROBE, K))


@query(
    "hierarchical_full",
    f"""with {PTS}, {lloyd_sql('pts', 4, 3, 'w')},
    low as (select vec_id, v, h, k top from (select vec_id, v, h, k, {L2.format(a='v', b='c')} d from pts, w3) qualify row_number() over (partition by vec_id order by d, k) = 1), {lloyd_sql('low', 3, 3, 'x', 'top')}
    select (top * 3 + k)::int as cluster_id, {VALUES} from x3, range(1, 65) t(i)""",
)
def hierarchical_full(spark, d):
    """All rows train both levels."""
    found_ = cluster.hierarchical_kmeans(embeddings(spark, d), "embedding", 4, 3, DIM, None, 3)
    return found_.select("cluster_id", F.posexplode("centroid").alias("at", "value")).select("cluster_id", "at", six("value"))


@query("index_files_roundtrip", f"with {EMB}, {CEN}, {ASG}, {IDX} select vec_id, cluster_id::int as cluster_id, {BITS.format(x='r', cond=' > 0')} as code, {', '.join(f'round({c}::float::double, 4) + 0.0 as {n}' for n, c in zip(('center_distance_square', 'factor_ip', 'factor_ppc', 'error_bound'), ('d2', 'factor_ip', 'factor_ppc', 'error_bound')))} from idx")
def index_files_roundtrip(spark, d):
    """The six files, written and read: codes as they were, factors in 32 bits."""
    path = mounted(shared_folder(spark))
    index_files.dump_index_files(the_index(spark, d), path)
    factors = [(F.round(n, 4) + F.lit(0.0)).alias(n) for n in FACTORS]
    return index_files.load_index_files(spark, path).codes.select("vec_id", "cluster_id", F.col("code")[0].alias("code"), *factors)
