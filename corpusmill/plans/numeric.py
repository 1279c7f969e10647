"""Queries for scalar formulas, vectors, and partition semantics of distributed primitives."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import nearest
from ..registry import query
from ..session import table


@query("SELECT event_id, round(exp(least(20.0, value / 10)), 4) AS perplexity FROM events")
def perplexity(spark, sf_dir):
    """N1."""
    return table(spark, sf_dir, "events").select("event_id", F.round(F.exp(F.least(F.lit(20.0), F.col("value") / 10)), 4).alias("perplexity"))


@query("SELECT range AS step, round(CASE WHEN range < 100 THEN (range + 1) / 100.0 ELSE 0.1 + 0.45 * (1 + cos(pi() * (range - 100) / 900.0)) END, 6) AS cosine, 1.0 AS constant, round(CASE WHEN range < 100 THEN (range + 1) / 100.0 WHEN range < 800 THEN 1.0 ELSE greatest(0.0, 1 - (range - 800) / 200.0) END, 6) AS wsd FROM range(1000)")
def lr_schedules(spark, sf_dir):
    """Warm-up and cosine with a floor, constant, warm-up-stable-decay."""
    s = F.col("id")
    warm = (s + 1) / 100.0
    return spark.range(1000).select(
        s.alias("step"), F.round(F.when(s < 100, warm).otherwise(0.1 + 0.45 * (1 + F.cos(math.pi * (s - 100) / 900.0))), 6).alias("cosine"), F.lit(1.0).alias("constant"),
        F.round(F.when(s < 100, warm).when(s < 800, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (s - 800) / 200.0)), 6).alias("wsd"),
    )


@query("SELECT range + 1 AS t, round(sqrt(1 - pow(0.999, range + 1)) / (1 - pow(0.9, range + 1)), 6) AS ratio FROM range(200)")
def adam_bias_correction(spark, sf_dir):
    """N3."""
    t = F.col("id") + 1
    return spark.range(200).select(t.alias("t"), F.round(F.sqrt(1 - F.pow(F.lit(0.999), t)) / (1 - F.pow(F.lit(0.9), t)), 6).alias("ratio"))


SUMS = "count(*) AS n, sum(x) AS sx, sum(x*x) AS sx2, sum(x*x*x) AS sx3, sum(x*x*x*x) AS sx4, sum(y) AS sy, sum(x*y) AS sxy, sum(x*x*y) AS sx2y"
VERTEX = "-((n*sxy - sx*sy) * (n*sx4 - sx2*sx2) - (n*sx2y - sx2*sy) * (n*sx3 - sx*sx2)) / (2 * ((n*sx2y - sx2*sy) * (n*sx2 - sx*sx) - (n*sxy - sx*sy) * (n*sx3 - sx*sx2)))"


@query(f"WITH p AS (SELECT user_id, CAST(event_id % 11 AS DOUBLE) / 5 - 1 AS x, pow(CAST(event_id % 11 AS DOUBLE) / 5 - 1 - (user_id % 5) * 0.1, 2) AS y FROM events), s AS (SELECT user_id, {SUMS} FROM p GROUP BY user_id HAVING count(DISTINCT x) > 4) SELECT user_id, round({VERTEX}, 4) AS vertex FROM s")
def parabola_vertex(spark, sf_dir):
    """Least-squares parabolas in closed form, and where they are lowest."""
    x = F.col("event_id") % 11 / 5 - 1
    p = table(spark, sf_dir, "events").select("user_id", x.alias("x")).withColumn("y", F.pow(F.col("x") - F.col("user_id") % 5 * 0.1, F.lit(2.0)))
    s = p.groupBy("user_id").agg(*(F.expr(c) for c in SUMS.split(", ")), F.count_distinct("x").alias("k")).where("k > 4")
    return s.select("user_id", F.round(F.expr(VERTEX), 4).alias("vertex"))


@query("SELECT layers, heads, seq, CAST(2 * layers * heads * 128 * seq * 2 AS BIGINT) AS cache_bytes, CAST(layers // 4 AS BIGINT) AS full_layers, CAST((layers - layers // 4) * 2 * heads * 128 * least(seq, 4096) * 2 + layers // 4 * 2 * heads * 128 * seq * 2 AS BIGINT) AS hybrid_bytes FROM (SELECT unnest(CAST([32, 64] AS BIGINT[])) AS layers), (SELECT unnest(CAST([8, 32] AS BIGINT[])) AS heads), (SELECT unnest(CAST([2048, 8192, 131072] AS BIGINT[])) AS seq)")
def kv_cache_costs(spark, sf_dir):
    """Cache bytes of full and of mostly windowed attention."""
    g = spark.createDataFrame([(a, b, c) for a in (32, 64) for b in (8, 32) for c in (2048, 8192, 131072)], "layers bigint, heads bigint, seq bigint")
    return g.selectExpr("layers", "heads", "seq", "2 * layers * heads * 128 * seq * 2 AS cache_bytes", "layers div 4 AS full_layers", "(layers - layers div 4) * 2 * heads * 128 * least(seq, 4096) * 2 + layers div 4 * 2 * heads * 128 * seq * 2 AS hybrid_bytes")


@query("SELECT n, w, CAST(factor * n * (w - 1) / w AS DOUBLE) AS bytes, round(factor * n * (w - 1) / w / 5e10, 9) AS seconds, op FROM (VALUES ('all_reduce', 2), ('reduce_scatter', 1), ('all_gather', 1)) AS o(op, factor), (SELECT unnest([1000000.0, 64000000.0]) AS n), (SELECT unnest(CAST([2, 4, 8] AS BIGINT[])) AS w)")
def ring_costs(spark, sf_dir):
    """N6."""
    g = spark.createDataFrame([(o, f, n, w) for o, f in (("all_reduce", 2), ("reduce_scatter", 1), ("all_gather", 1)) for n in (1e6, 64e6) for w in (2, 4, 8)], "op string, factor bigint, n double, w bigint")
    b = F.col("factor") * F.col("n") * (F.col("w") - 1) / F.col("w")
    return g.select("n", "w", b.alias("bytes"), F.round(b / 5e10, 9).alias("seconds"), "op")


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(v) AS m, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS z FROM e) SELECT vec_id, round(exp(0) / z, 6) AS top_probability, CAST(list_position(v, m) - 1 AS BIGINT) AS top_index, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm FROM s")
def vector_softmax(spark, sf_dir):
    """Softmax at the largest entry, its place, and the norm."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("m", F.array_max("v"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return e.select("vec_id", F.round(1 / add(F.transform("v", lambda x: F.exp(x - F.col("m")))), 6).alias("top_probability"), (F.array_position("v", F.col("m")) - 1).alias("top_index"), F.round(F.sqrt(add(F.transform("v", lambda x: x * x))), 4).alias("norm"))


@query()
def pca_two(spark, sf_dir):
    """The first two principal components of the embeddings."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e)
    return out.select("vec_id", vector_to_array("p").alias("p")).select("vec_id", F.round(F.abs(F.col("p")[0]), 6).alias("pc1"), F.round(F.abs(F.col("p")[1]), 6).alias("pc2"))


NEIGHBOURS = "n AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6), b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


@query(f"WITH {NEIGHBOURS} SELECT label, CAST(count(*) AS BIGINT) AS vectors, round(avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END), 6) AS same FROM n WHERE rn = 1 GROUP BY label")
def nn_same_label_rate(spark, sf_dir):
    """How often the nearest vector has the same label, for every hundredth vector against all rows."""
    e = table(spark, sf_dir, "embeddings")
    out = nearest.nearest(e, e.where("vec_id % 100 = 0"))
    return out.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg(F.when(F.col("label") == F.col("other"), 1.0).otherwise(0.0)), 6).alias("same"))


@query("SELECT event_id, CASE WHEN value < 0 THEN 1 ELSE 0 END AS sign, CASE WHEN value = 0 THEN 0 ELSE CAST(floor(log2(abs(value))) AS BIGINT) END AS exponent, floor(CASE WHEN value = 0 THEN 0 ELSE abs(value) / pow(2, floor(log2(abs(value)))) END * 10000) AS mantissa FROM events")
def float_parts(spark, sf_dir):
    """Sign, exponent and mantissa of numbers."""
    x = F.abs("value")
    e = F.floor(F.log2(x))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 0, 1).otherwise(0).alias("sign"), F.when(x == 0, 0).otherwise(e).cast("long").alias("exponent"), F.floor(F.when(x == 0, 0.0).otherwise(x / F.pow(F.lit(2.0), e)) * 10000).cast("double").alias("mantissa"))


@query("SELECT params, CAST(6 * params AS DOUBLE) AS flops_per_token, round(6.0 * params * 10000 / 1e13, 6) AS mfu FROM (SELECT unnest(CAST([17000000, 125000000, 1300000000] AS BIGINT[])) AS params)")
def flops_and_mfu(spark, sf_dir):
    """N11."""
    p = spark.createDataFrame([(17000000,), (125000000,), (1300000000,)], "params bigint")
    return p.select("params", (6 * F.col("params")).cast("double").alias("flops_per_token"), F.round(F.lit(6.0) * F.col("params") * 10000 / 1e13, 6).alias("mfu"))


@query("SELECT event_id, CAST(event_id // 25 % 8 AS BIGINT) AS rank FROM events")
def rank_slices(spark, sf_dir):
    """O1: a global batch of 200 cut into eight ranks."""
    return table(spark, sf_dir, "events").select("event_id", (F.floor(F.col("event_id") / 25) % 8).alias("rank"))


@query("WITH r AS (SELECT event_id // 25 % 8 AS rank, event_id // 200 AS step FROM events), p AS (SELECT rank, step, count(*) AS n FROM r GROUP BY ALL) SELECT CAST(count(DISTINCT rank) AS BIGINT) AS ranks, CAST(count(*) AS BIGINT) AS slices, CAST(sum(n) AS BIGINT) AS rows FROM p")
def rank_separateness(spark, sf_dir):
    """O1, Q19: slices are disjoint and their union is the whole."""
    r = table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 25) % 8).alias("rank"), F.floor(F.col("event_id") / 200).alias("step"))
    return r.groupBy("rank", "step").agg(F.count("*").alias("n")).agg(F.count_distinct("rank").alias("ranks"), F.count("*").alias("slices"), F.sum("n").alias("rows"))


@query("WITH v AS (SELECT label AS rank, generate_subscripts(embedding, 1) - 1 AS idx, unnest(embedding) AS x FROM embeddings), p AS (SELECT rank, idx, sum(CAST(x AS DOUBLE)) AS x FROM v GROUP BY ALL) SELECT CAST(idx AS BIGINT) AS idx, round(sum(x), 3) AS total, CAST(idx * 10 // 64 AS BIGINT) AS owner FROM p GROUP BY idx")
def all_reduce(spark, sf_dir):
    """O2: partial sums of each rank, added by index; a reduce-scatter leaves each index to its owner."""
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("idx", "x"))
    return v.groupBy("idx").agg(F.round(F.sum(F.col("x").cast("double")), 3).alias("total")).select(F.col("idx").cast("long").alias("idx"), "total", F.floor(F.col("idx") * 10 / 64).alias("owner"))


@query("SELECT event_type AS op, CAST(user_id % 8 AS BIGINT) AS rank, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS bytes FROM events GROUP BY ALL")
def communication_ledger(spark, sf_dir):
    """O3."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("op"), (F.col("user_id") % 8).alias("rank")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("bytes"))


def _overlap(g: pd.DataFrame) -> pd.DataFrame:
    """A clock over buckets: each is computed in turn, then sent on one link when it is free."""
    out = []
    for r in g.itertuples():
        compute = link = 0.0
        ready: list[float] = []
        for _ in range(int(r.buckets)):
            compute += r.work / r.buckets
            heapq.heappush(ready, compute)
        while ready:
            link = max(link, heapq.heappop(ready)) + r.latency + r.traffic / r.buckets
        out.append((r.buckets, r.latency, max(link, compute), r.work + r.latency * r.buckets + r.traffic))
    return pd.DataFrame(out, columns=["buckets", "latency", "overlapped", "serial"])


@query()
def overlap_simulation(spark, sf_dir):
    """Time with and without overlap over a grid, and the best number of buckets."""
    grid = [(b, lat, 10.0, 8.0) for b in (1, 2, 4, 8, 16, 32) for lat in (0.01, 0.1, 0.5)]
    g = spark.createDataFrame(grid, "buckets bigint, latency double, work double, traffic double")
    t = g.groupBy("latency").applyInPandas(_overlap, "buckets bigint, latency double, overlapped double, serial double")
    return t.withColumn("best", F.col("overlapped") == F.min("overlapped").over(W.partitionBy("latency")))


@query("SELECT CAST(user_id % 8 AS BIGINT) AS world, round(sum(value), 4) AS measured, round(sum(value) * 30e9 / 21e6, 2) AS projected FROM events GROUP BY 1")
def run_rollup(spark, sf_dir):
    """Results rolled up and scaled by parameters."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("world")).agg(F.round(F.sum("value"), 4).alias("measured"), F.round(F.sum("value") * 30e9 / 21e6, 2).alias("projected"))


ROUTE = "e AS (SELECT vec_id, list_transform(range(8), lambda k: list_sum(list_transform(range(k * 8 + 1, k * 8 + 9), lambda i: CAST(embedding[i] AS DOUBLE)))) AS l FROM embeddings), x AS (SELECT vec_id, unnest(range(8)) AS expert, unnest(l) AS logit FROM e), p AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY round(logit, 6) DESC, expert) AS rn FROM x)"


@query(f"WITH {ROUTE}, s AS (SELECT expert, count(*) FILTER (rn <= 2) AS load, avg(prob) AS p, count(*) AS n FROM p GROUP BY expert) SELECT CAST(expert AS BIGINT) AS expert, CAST(load AS BIGINT) AS load, round(p, 5) AS mean_probability, round(8 * CAST(load AS DOUBLE) / (2 * n) * p, 5) AS balance FROM s")
def moe_topk_load(spark, sf_dir):
    """Top-2 routing over eight experts, their loads and terms of the balance loss."""
    from functools import reduce

    logits = F.array(*(reduce(lambda a, b: a + b, [F.col("embedding")[i].cast("double") for i in range(8 * k, 8 * k + 8)]) for k in range(8)))
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(logits).alias("expert", "logit"))
    w = W.partitionBy("vec_id")
    p = x.withColumn("prob", F.exp("logit") / F.sum(F.exp("logit")).over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc(F.round("logit", 6)), "expert")))
    s = p.groupBy("expert").agg(F.count_if(F.col("rn") <= 2).alias("load"), F.avg("prob").alias("p"), F.count("*").alias("n"))
    return s.select(F.col("expert").cast("long").alias("expert"), "load", F.round("p", 5).alias("mean_probability"), F.round(8 * F.col("load") / (2 * F.col("n")) * F.col("p"), 5).alias("balance"))


def largest_that_fits(fits, start: int = 1, most: int = 1 << 20) -> int:
    """The largest batch that fits: doubling, then bisection; 0 if none does."""
    lo, hi = 0, start
    while hi <= most and fits(hi):
        lo, hi = hi, hi * 2
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


@query("WITH m AS (SELECT label, count(*) AS n, sum(CAST(embedding[1] AS DOUBLE)) AS s FROM embeddings GROUP BY label) SELECT round(sum(w * s / n), 5) AS mixed, round(exp(sum(w * s / n)), 5) AS perplexity FROM (SELECT label, n, s, (label + 1) / 55.0 AS w FROM m)")
def fixed_weight_mixture(spark, sf_dir):
    """Q9: means by lane mixed with fixed weights; labels stand for lanes."""
    m = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("m"))
    x = F.sum((F.col("label") + 1) / 55.0 * F.col("m"))
    return m.agg(F.round(x, 5).alias("mixed"), F.round(F.exp(x), 5).alias("perplexity"))


@query("WITH v AS (SELECT vec_id, embedding AS a, list_transform(embedding, lambda x: x + CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 0 END) AS b FROM embeddings) SELECT vec_id, round(CAST(list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS DOUBLE), 4) AS spread FROM v")
def vector_divergence(spark, sf_dir):
    """Q20: the largest difference between two keyed sets of vectors."""
    e = table(spark, sf_dir, "embeddings")
    other = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.when(F.col("vec_id") % 3 == 0, 0.5).otherwise(0.0)).alias("b"))
    d = F.array_max(F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") - y)))
    return e.join(other, "vec_id").select("vec_id", F.round(d, 4).alias("spread"))


@query("SELECT stage, w, CAST(CASE stage WHEN 0 THEN 16 * n WHEN 1 THEN 4 * n + 12 * n / w WHEN 2 THEN 2 * n + 14 * n / w ELSE 16 * n / w END AS DOUBLE) AS memory, CAST(CASE stage WHEN 3 THEN 3 ELSE 2 END * n * (w - 1) / w AS DOUBLE) AS wire FROM (SELECT unnest(CAST([0, 1, 2, 3] AS BIGINT[])) AS stage), (SELECT unnest(CAST([2, 8] AS BIGINT[])) AS w), (SELECT 1000000.0 AS n)")
def zero_stage_costs(spark, sf_dir):
    """Q21: memory and traffic by stage of sharding."""
    g = spark.createDataFrame([(s, w, 1e6) for s in range(4) for w in (2, 8)], "stage bigint, w bigint, n double")
    return g.selectExpr("stage", "w", "CASE stage WHEN 0 THEN 16 * n WHEN 1 THEN 4 * n + 12 * n / w WHEN 2 THEN 2 * n + 14 * n / w ELSE 16 * n / w END AS memory", "CASE stage WHEN 3 THEN 3 ELSE 2 END * n * (w - 1) / w AS wire")


@query("SELECT event_id, CASE WHEN v >= 1e9 THEN printf('%.1fB', floor(v / 1e9 * 10) / 10) WHEN v >= 1e6 THEN printf('%.1fM', floor(v / 1e6 * 10) / 10) WHEN v >= 1e3 THEN printf('%.1fK', floor(v / 1e3 * 10) / 10) ELSE printf('%.0f', v) END AS shown FROM (SELECT event_id, CAST(event_id * event_id AS DOUBLE) AS v FROM events)")
def human_magnitudes(spark, sf_dir):
    """Q29: magnitudes cut, not rounded, to one decimal."""
    v = (F.col("event_id") * F.col("event_id")).cast("double")
    show = F.when(v >= 1e9, F.format_string("%.1fB", F.floor(v / 1e9 * 10) / 10)).when(v >= 1e6, F.format_string("%.1fM", F.floor(v / 1e6 * 10) / 10)).when(v >= 1e3, F.format_string("%.1fK", F.floor(v / 1e3 * 10) / 10)).otherwise(F.format_string("%.0f", v))
    return table(spark, sf_dir, "events").select("event_id", show.alias("shown"))


@query(f"WITH u AS (SELECT range AS i, {S.keyed_unit('angle', 'range')} AS a, {S.keyed_unit('noise', 'range')} AS n, range % 2 AS y FROM range(400)) SELECT i, round(CASE y WHEN 0 THEN cos(2 * pi() * a) ELSE 2 * cos(2 * pi() * a) END, 6) AS x1, round(CASE y WHEN 0 THEN sin(2 * pi() * a) ELSE 2 * sin(2 * pi() * a) END, 6) AS x2, CAST(CASE WHEN n < 0.05 THEN 1 - y ELSE y END AS BIGINT) AS y FROM u")
def synthetic_rings(spark, sf_dir):
    """Q30: two rings with keyed angles and label noise."""
    i = F.col("id")
    a = 2 * math.pi * T.keyed_unit("angle", i)
    y = i % 2
    radius = F.when(y == 0, 1.0).otherwise(2.0)
    return spark.range(400).select(i.alias("i"), F.round(radius * F.cos(a), 6).alias("x1"), F.round(radius * F.sin(a), 6).alias("x2"), F.when(T.keyed_unit("noise", i) < 0.05, 1 - y).otherwise(y).alias("y"))


