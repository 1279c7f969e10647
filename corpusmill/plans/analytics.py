"""Queries for audits, report cards, rates and series over ledgers and run logs; events stand for log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import series
from ..registry import query
from ..session import table

LOG = "log AS (SELECT event_id AS step, user_id AS shard, 'lane' || (user_id % 4) AS lane, event_type AS phase, value, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events)"


def log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("user_id").alias("shard"), F.concat(F.lit("lane"), F.col("user_id") % 4).alias("lane"), F.col("event_type").alias("phase"), "value", F.floor(F.col("value") * 10).cast("long").alias("tokens")
    )


@query(f"WITH {LOG} SELECT shard, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS spans, CAST(count(DISTINCT step) AS BIGINT) AS steps, min(step) AS first_step, max(step) AS last_step FROM log WHERE step >= 1000 AND step < 6000 GROUP BY shard")
def shards_between(spark, sf_dir):
    """L1: what each shard gave to steps [1000, 6000)."""
    r = log(spark, sf_dir).where("step >= 1000 AND step < 6000")
    return r.groupBy("shard").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("spans"), F.count_distinct("step").alias("steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query(f"WITH {LOG} SELECT lane, phase, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) FILTER (value > 50) AS BIGINT) AS loss_tokens FROM log WHERE step >= 1000 AND step < 6000 GROUP BY GROUPING SETS ((lane), (phase))")
def shards_between_rollup(spark, sf_dir):
    """L1: by lane and by stage; content and loss tokens under their own names."""
    r = log(spark, sf_dir).where("step >= 1000 AND step < 6000")
    return r.groupingSets([["lane"], ["phase"]], "lane", "phase").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("value") > 50, F.col("tokens"))).alias("loss_tokens"))


@query(f"WITH {LOG}, t AS (SELECT shard, sum(tokens) AS tokens FROM log GROUP BY shard) SELECT shard, CAST(tokens AS BIGINT) AS tokens FROM t ORDER BY tokens DESC, shard LIMIT 15")
def top_shards(spark, sf_dir):
    """L1: the fifteen largest (a top-k report)."""
    return log(spark, sf_dir).groupBy("shard").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "shard").limit(15)


@query("WITH w AS (SELECT user_id, event_id, value, avg(value) OVER b AS mu, stddev_pop(value) OVER b AS sd, count(*) OVER b AS n, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id, round((value - mu) / sd, 4) AS z, round(before[1], 4) AS three_back FROM w WHERE n = 8 AND sd > 0 AND value > mu + 2 * sd")
def loss_spikes(spark, sf_dir):
    """L2: values over the trailing mean by two population deviations."""
    s = series.spikes(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return s.select("user_id", "event_id", F.round("z", 4).alias("z"), F.round(F.col("before")[0], 4).alias("three_back"))


@query("WITH f AS (SELECT coalesce(min(event_id) FILTER (value > 400), max(event_id)) AS focus FROM events) SELECT CASE WHEN value > 100 THEN 'rejected' WHEN value > 20 THEN 'accepted' ELSE 'deferred' END AS status, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS mean_score FROM events, f WHERE event_id >= focus - 2000 AND event_id < focus GROUP BY 1")
def selector_before(spark, sf_dir):
    """L3, Q25: decisions of the steps before a focus: the first spike, else the last step."""
    e = table(spark, sf_dir, "events")
    focus = e.agg(F.coalesce(F.min(F.when(F.col("value") > 400, F.col("event_id"))), F.max("event_id")).alias("focus"))
    status = F.when(F.col("value") > 100, "rejected").when(F.col("value") > 20, "accepted").otherwise("deferred")
    r = e.join(F.broadcast(focus)).where("event_id >= focus - 2000 AND event_id < focus")
    return r.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_score"))


@query(f"WITH {LOG} SELECT lane, CAST(count(*) AS BIGINT) AS steps, CAST(sum(tokens) AS BIGINT) AS tokens, round(arg_min(value, step), 6) AS first_value, round(arg_max(value, step), 6) AS last_value FROM log WHERE step < 5000 GROUP BY lane")
def checkpoint_provenance(spark, sf_dir):
    """L4: all that went into a checkpoint at step 5000."""
    r = log(spark, sf_dir).where("step < 5000")
    return r.groupBy("lane").agg(F.count("*").alias("steps"), F.sum("tokens").alias("tokens"), F.round(F.min_by("value", "step"), 6).alias("first_value"), F.round(F.max_by("value", "step"), 6).alias("last_value"))


VERDICT = "CASE WHEN most > 4 * med THEN 'needs_warmup' WHEN delta > 0.15 THEN 'useful' WHEN delta < -0.05 THEN 'harmful' ELSE 'neutral' END"
CARDS = f"{LOG}, k AS (SELECT shard, any_value(lane) AS lane, arg_min(value, step) - arg_max(value, step) AS delta, median(value) AS med, max(value) AS most, avg(value) FILTER (phase = 'click') AS click_mean, avg(value) FILTER (phase = 'purchase') AS purchase_mean FROM log GROUP BY shard), cards AS (SELECT *, {VERDICT} AS verdict FROM k)"


def cards(spark, sf_dir) -> DataFrame:
    of = lambda p: F.avg(F.when(F.col("phase") == p, F.col("value")))
    k = log(spark, sf_dir).groupBy("shard").agg(
        F.first("lane").alias("lane"), (F.min_by("value", "step") - F.max_by("value", "step")).alias("delta"), F.percentile("value", 0.5).alias("med"), F.max("value").alias("most"), of("click").alias("click_mean"), of("purchase").alias("purchase_mean")
    )
    return k.withColumn("verdict", F.expr(VERDICT))


@query(f"WITH {CARDS} SELECT shard, lane, round(delta, 6) AS delta, round(med, 6) AS med, round(most, 6) AS most, round(click_mean, 6) AS click_mean, round(purchase_mean, 6) AS purchase_mean, verdict FROM cards")
def report_cards(spark, sf_dir):
    """A verdict on each shard."""
    return cards(spark, sf_dir).select("shard", "lane", *(F.round(c, 6).alias(c) for c in ("delta", "med", "most", "click_mean", "purchase_mean")), "verdict")


VERDICTS = ("useful", "harmful", "neutral", "needs_warmup")


@query(f"WITH {CARDS} SELECT lane, {', '.join(f'CAST(count(*) FILTER (verdict = {chr(39)}{v}{chr(39)}) AS BIGINT) AS {v}' for v in VERDICTS)}, CASE WHEN count(*) FILTER (verdict = 'harmful') * 2 > count(*) THEN 'lower' ELSE 'keep' END AS feedback FROM cards GROUP BY lane")
def lane_feedback(spark, sf_dir):
    """Verdicts by lane, and what follows for its share."""
    c = cards(spark, sf_dir)
    n = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return c.groupBy("lane").agg(*n, F.when(F.count_if(F.col("verdict") == "harmful") * 2 > F.count("*"), "lower").otherwise("keep").alias("feedback"))


@query("WITH b AS (SELECT l_orderkey AS bin, l_linenumber AS seg, sum(l_quantity) OVER w - l_quantity AS lo, sum(l_quantity) OVER w AS hi, l_suppkey AS shard FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)), p AS (SELECT o_orderkey AS bin, unnest(range(0, 40, 7)) AS pos FROM orders) SELECT shard, CAST(count(*) AS BIGINT) AS positions, CAST(sum(pos) AS BIGINT) AS loss_sum FROM p JOIN b USING (bin) WHERE pos >= lo AND pos < hi GROUP BY shard")
def loss_attribution(spark, sf_dir):
    """Losses of positions to the shards whose span [lo, hi) holds them; orders are bins, line items their spans."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    hi = F.sum("l_quantity").over(w)
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bin"), F.col("l_suppkey").alias("shard"), (hi - F.col("l_quantity")).alias("lo"), hi.alias("hi"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(7))).alias("pos"))
    return p.join(b, "bin").where("pos >= lo AND pos < hi").groupBy("shard").agg(F.count("*").alias("positions"), F.sum("pos").cast("long").alias("loss_sum"))


@query(f"WITH {LOG} SELECT CAST(count(*) AS BIGINT) AS bins, CAST(sum(tokens) AS BIGINT) AS content, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM log")
def packing_efficiency(spark, sf_dir):
    """L8."""
    p = lambda q: F.round(F.percentile("value", q), 6)
    return log(spark, sf_dir).agg(F.count("*").alias("bins"), F.sum("tokens").alias("content"), p(0.05).alias("p05"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query(f"WITH {LOG} SELECT lane, CAST(count(*) AS BIGINT) AS candidates, round(CAST(count(*) FILTER (value > 20) AS DOUBLE) / count(*), 6) AS accept_rate, round(CAST(count(*) FILTER (value <= 20) AS DOUBLE) / count(*), 6) AS reject_rate FROM log GROUP BY lane")
def selector_throughput(spark, sf_dir):
    """L9."""
    n = F.count("*")
    return log(spark, sf_dir).groupBy("lane").agg(n.alias("candidates"), F.round(F.count_if(F.col("value") > 20) / n, 6).alias("accept_rate"), F.round(F.count_if(F.col("value") <= 20) / n, 6).alias("reject_rate"))


@query(f"WITH {LOG}, s AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS secs FROM events), a AS (SELECT sum(tokens) AS raw, sum(tokens) FILTER (value > 20) AS accepted, sum(tokens) FILTER (value > 50) AS useful FROM log) SELECT round(raw / secs, 6) AS raw_per_s, round(accepted / secs, 6) AS accepted_per_s, round(useful / secs, 6) AS useful_per_s, round(1 - CAST(useful AS DOUBLE) / raw, 6) AS waste FROM a, s")
def throughput_rates(spark, sf_dir):
    """Raw, accepted and useful tokens a second."""
    secs = table(spark, sf_dir, "events").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))).alias("us")).select((F.col("us") / 1e6).alias("secs"))
    of = lambda t: F.sum(F.when(F.col("value") > t, F.col("tokens")))
    a = log(spark, sf_dir).agg(F.sum("tokens").alias("raw"), of(20).alias("accepted"), of(50).alias("useful")).join(F.broadcast(secs))
    return a.select(*(F.round(F.col(c) / F.col("secs"), 6).alias(f"{c}_per_s") for c in ("raw", "accepted", "useful")), F.round(1 - F.col("useful") / F.col("raw"), 6).alias("waste"))


@query("WITH m AS (SELECT max(event_id) + 1 AS n FROM events) SELECT CASE WHEN event_id < n / 3.0 THEN 'early' WHEN event_id < 2 * n / 3.0 THEN 'middle' ELSE 'late' END AS phase, CAST(count(*) AS BIGINT) AS steps FROM events, m GROUP BY 1")
def phase_labels(spark, sf_dir):
    """Thirds of the run."""
    e = table(spark, sf_dir, "events")
    r = e.join(F.broadcast(e.agg((F.max("event_id") + 1).alias("n"))))
    phase = F.when(F.col("event_id") < F.col("n") / 3, "early").when(F.col("event_id") < 2 * F.col("n") / 3, "middle").otherwise("late")
    return r.groupBy(phase.alias("phase")).agg(F.count("*").alias("steps"))


@query("SELECT event_id, round(value, 6) AS loss FROM events ORDER BY value DESC, event_id LIMIT 20")
def hardest_tokens(spark, sf_dir):
    """L13 (a top-k report)."""
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", F.round("value", 6).alias("loss"))


@query(f"WITH {LOG}, m AS (SELECT shard, sum(value) AS s, sum(tokens) AS n FROM log GROUP BY shard) SELECT round(sum(s) / sum(n), 6) AS token_weighted, round(avg(s / n), 6) AS mean_of_means FROM m WHERE n > 0")
def weighted_means(spark, sf_dir):
    """By tokens, and the mean of means that differs from it."""
    m = log(spark, sf_dir).groupBy("shard").agg(F.sum("value").alias("s"), F.sum("tokens").alias("n")).where("n > 0")
    return m.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("token_weighted"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("mean_of_means"))


@query("SELECT round(sum(s) / sum(n), 6) AS token_weighted, round(avg(s / n), 6) AS mean_of_means FROM (VALUES (4, 8.0), (4, 8.0), (2, 10.0)) AS t(n, s)")
def weighted_means_toy(spark, sf_dir):
    """Q14: three micro-batches, 2.6 against 3.0 when each mean is taken first."""
    t = spark.createDataFrame([(4, 8.0), (4, 8.0), (2, 10.0)], "n bigint, s double")
    return t.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("token_weighted"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("mean_of_means"))


RZ = """w AS (SELECT user_id, event_id, value, list(value) OVER b AS x, stddev_pop(value) OVER b AS s FROM events WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT *, list_median(x) AS med FROM w), d AS (SELECT *, 1.4826 * list_median(list_transform(x, lambda v: abs(v - med))) AS mad FROM m), z AS (SELECT user_id, event_id, CASE WHEN len(x) = 25 AND CASE WHEN mad > 0 THEN mad ELSE s END > 0 THEN (value - med) / CASE WHEN mad > 0 THEN mad ELSE s END ELSE 0 END AS z FROM d)"""


@query(f"WITH {RZ} SELECT user_id, event_id, round(z, 5) AS z FROM z")
def robust_z(spark, sf_dir):
    """L15."""
    return series.robust_z(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.round("z", 5).alias("z"))


CROSS = "t AS (SELECT user_id, min(event_id) FILTER (value > 100) AS first_crossing FROM events GROUP BY 1), n AS (SELECT a.user_id, a.event_id, (SELECT min(event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_id >= a.event_id AND b.value > 100) AS nxt FROM events a WHERE event_type = 'click')"


@query(f"WITH {CROSS} SELECT n.user_id, first_crossing, CAST(count(nxt) AS BIGINT) AS with_later, CAST(sum(nxt - event_id) AS BIGINT) AS lead_steps FROM n JOIN t USING (user_id) GROUP BY ALL")
def threshold_crossings(spark, sf_dir):
    """First crossing, and the steps from each event to the next crossing."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min(F.when(F.col("value") > 100, F.col("event_id"))).alias("first_crossing"))
    nxt = series.next_at_or_after(e.where("event_type = 'click'").select("user_id", "event_id"), e.where("value > 100").select("user_id", "event_id"), "user_id", "event_id")
    return nxt.join(first, "user_id").groupBy("user_id", "first_crossing").agg(F.count("next").alias("with_later"), F.sum(F.col("next") - F.col("event_id")).alias("lead_steps"))


@query()
def refractory_events(spark, sf_dir):
    """Events at least 800 steps apart within each user."""
    return series.refractory(table(spark, sf_dir, "events").where("value > 50"), "user_id", "event_id", 800)


@query("WITH w AS (SELECT user_id, event_id, value, row_number() OVER o AS rn, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round((s + greatest(0, 5 - rn) * f + greatest(0, rn + 4 - n) * l) / 9, 6) AS smooth FROM w")
def centred_smoothing(spark, sf_dir):
    """L17."""
    return series.centred_mean(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("WITH b AS (SELECT user_id, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1), g AS (SELECT e.user_id, event_id, min(CASE WHEN value <= hi THEN 1 ELSE 0 END) OVER (PARTITION BY e.user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok, hi FROM events e JOIN b USING (user_id)) SELECT user_id, min(event_id) AS settled, round(any_value(hi), 6) AS band FROM g WHERE ok = 1 GROUP BY user_id")
def settle_steps(spark, sf_dir):
    """Where a series stays within its 95th-percentile band for good."""
    e = table(spark, sf_dir, "events")
    band = e.groupBy("user_id").agg(F.percentile("value", 0.95).alias("hi"))
    s = series.settled(e.join(band, "user_id"), "user_id", "event_id", F.col("value") <= F.col("hi"))
    return s.join(band, "user_id").select("user_id", F.col("step").alias("settled"), F.round("hi", 6).alias("band"))


@query("WITH n AS (SELECT user_id % 3 AS layer, event_type AS expert, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY layer) AS share FROM n) SELECT layer, round(max(share), 6) AS max_load, CAST(count(*) FILTER (share < 0.05) AS BIGINT) AS dead FROM s GROUP BY layer")
def expert_load(spark, sf_dir):
    """Load shares of experts by layer; event types stand for experts."""
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("layer"), "event_type").agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("layer")))
    return s.groupBy("layer").agg(F.round(F.max("share"), 6).alias("max_load"), F.count_if(F.col("share") < 0.05).alias("dead"))


@query("SELECT event_type, (min({'v': value, 'e': event_id})).e AS best FROM events WHERE isfinite(value) AND value > 1 GROUP BY 1")
def best_variant(spark, sf_dir):
    """The smallest finite value that passes a test; of equal ones the first."""
    ok = ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") > 1)
    return table(spark, sf_dir, "events").where(ok).groupBy("event_type").agg(F.min(F.struct("value", "event_id")).alias("x")).select("event_type", F.col("x.event_id").alias("best"))


@query(f"WITH {LOG} SELECT lane, round(sum(value * tokens) / sum(tokens) / ln(2) / 4.2, 6) AS bits_per_byte FROM log GROUP BY lane")
def bits_per_byte(spark, sf_dir):
    """L21."""
    return log(spark, sf_dir).groupBy("lane").agg(F.round(F.sum(F.col("value") * F.col("tokens")) / F.sum("tokens") / F.log(F.lit(2.0)) / 4.2, 6).alias("bits_per_byte"))


@query("SELECT CAST(count(*) AS BIGINT) AS docs, CAST(count(DISTINCT sha256(text)) AS BIGINT) AS distinct_texts, sha256(string_agg(sha256(text), '' ORDER BY sha256(text), doc_id)) AS corpus_hash FROM documents")
def corpus_manifest(spark, sf_dir):
    """Survival and a hash of the sorted content hashes. One SHA-256 over one list is sequential by definition: 64 bytes
    for each document come to one task."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"))
    return d.agg(F.count("*").alias("docs"), F.count_distinct("h").alias("distinct_texts"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("corpus_hash"))


@query(f"WITH {LOG} SELECT lane, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM log GROUP BY lane")
def lane_shares(spark, sf_dir):
    """Shares of consumption."""
    n = log(spark, sf_dir).groupBy("lane").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("lane", F.round(F.col("n") / F.col("t"), 6).alias("share"))


CHECKS = """SELECT 'documents' AS requirement, 'ids_unique' AS check_, count(*) = count(DISTINCT doc_id) AS passed FROM documents UNION ALL SELECT 'documents', 'chars_agree', bool_and(n_chars = length(text)) FROM documents
    UNION ALL SELECT 'labels', 'documents_exist', count(*) FILTER (d.doc_id IS NULL) = 0 FROM labels l LEFT JOIN documents d USING (doc_id) UNION ALL SELECT 'labels', 'binary', bool_and(quality IN (0, 1) AND toxic IN (0, 1)) FROM labels
    UNION ALL SELECT 'events', 'ids_dense', count(*) = max(event_id) - min(event_id) + 1 FROM events UNION ALL SELECT 'orders', 'customers_exist', count(*) FILTER (c_custkey IS NULL) = 0 FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


@query(f"WITH c AS ({CHECKS}) SELECT requirement, CAST(count(*) AS BIGINT) AS checks, bool_and(passed) AS passed FROM c GROUP BY requirement")
def evidence_bundle(spark, sf_dir):
    """Checks grouped by requirement."""
    t = lambda n: table(spark, sf_dir, n)
    d, lab, e, o = t("documents"), t("labels"), t("events"), t("orders")

    def check(df, req, name, passed):
        return df.agg(passed.alias("passed")).select(F.lit(req).alias("requirement"), F.lit(name).alias("check_"), "passed")

    out = check(d, "documents", "ids_unique", F.count("*") == F.count_distinct("doc_id"))
    for one in (
        check(d, "documents", "chars_agree", F.bool_and(F.col("n_chars") == F.length("text"))),
        check(lab.join(d.select("doc_id"), "doc_id", "left_anti"), "labels", "documents_exist", F.count("*") == 0),
        check(lab, "labels", "binary", F.bool_and(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))),
        check(e, "events", "ids_dense", F.count("*") == F.max("event_id") - F.min("event_id") + 1),
        check(o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "orders", "customers_exist", F.count("*") == 0),
    ):
        out = out.union(one)
    return out.groupBy("requirement").agg(F.count("*").alias("checks"), F.bool_and("passed").alias("passed"))


@query("SELECT CAST(count(*) FILTER (o_custkey IS NULL OR o_orderdate IS NULL) AS BIGINT) AS incomplete, CAST((SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS BIGINT) AS uncovered FROM orders")
def required_fields(spark, sf_dir):
    """Required fields present; what is consumed is covered (anti-join emptiness)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bad = o.agg(F.count_if(F.col("o_custkey").isNull() | F.col("o_orderdate").isNull()).alias("incomplete"))
    return bad.join(o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("uncovered")))


@query("WITH v AS (SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT user_id, event_id, round(m, 6) AS m FROM v WHERE rn >= 25")
def trailing_mean_valid(spark, sf_dir):
    """Q12: trailing means of 25, where the window is full."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("m", F.avg("value").over(w.rowsBetween(-24, 0))).withColumn("rn", F.row_number().over(w))
    return e.where("rn >= 25").select("user_id", "event_id", F.round("m", 6).alias("m"))


@query("WITH p AS (SELECT event_id, value AS a, CASE WHEN event_id % 3 = 0 THEN value ELSE value + 0.001 END AS b FROM events) SELECT event_id, CASE WHEN a = b THEN CAST('inf' AS DOUBLE) ELSE round(-log10(abs(a - b)), 4) END AS digits FROM p")
def agreement_digits(spark, sf_dir):
    """Q13: agreement of two numbers in decimals."""
    b = F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(F.col("value") + 0.001)
    p = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("a"), b.alias("b"))
    return p.select("event_id", F.when(F.col("a") == F.col("b"), F.lit(float("inf"))).otherwise(F.round(-F.log10(F.abs(F.col("a") - F.col("b"))), 4)).alias("digits"))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(avg(value) FILTER (rn <= 10), 6) AS last_ten, round(avg(value) FILTER (rn <= greatest(1, floor(n * 0.05))), 6) AS last_share FROM r GROUP BY user_id")
def tail_means(spark, sf_dir):
    """Q16: means of the last ten and of the last twentieth."""
    e = table(spark, sf_dir, "events")
    r = e.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))).withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    tail = lambda t: F.round(F.avg(F.when(t, F.col("value"))), 6)
    return r.groupBy("user_id").agg(tail(F.col("rn") <= 10).alias("last_ten"), tail(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))).alias("last_share"))


@query("WITH g AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS gap FROM events) SELECT user_id, round(median(gap), 6) AS noise FROM g WHERE gap IS NOT NULL GROUP BY user_id")
def noise_floor(spark, sf_dir):
    """Q17: the median gap."""
    g = table(spark, sf_dir, "events").withColumn("gap", F.abs(F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id")))).where("gap IS NOT NULL")
    return g.groupBy("user_id").agg(F.round(F.percentile("gap", 0.5), 6).alias("noise"))


@query("WITH a AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN value ELSE -value END AS d FROM events), r AS (SELECT user_id, event_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS held FROM a) SELECT user_id, round(max(held), 4) AS peak, round(arg_max(held, event_id), 4) AS current FROM r GROUP BY user_id")
def allocation_meter(spark, sf_dir):
    """Q22, Q23: held amounts from signed events: peak and current."""
    d = F.when(F.col("event_type").isin("click", "view"), F.col("value")).otherwise(-F.col("value"))
    r = table(spark, sf_dir, "events").withColumn("held", F.sum(d).over(W.partitionBy("user_id").orderBy("event_id")))
    return r.groupBy("user_id").agg(F.round(F.max("held"), 4).alias("peak"), F.round(F.max_by("held", "event_id"), 4).alias("current"))


@query("SELECT event_type, round(sum(secs), 3) AS total FROM (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0 AS secs FROM events) WHERE secs IS NOT NULL GROUP BY 1")
def phase_timer(spark, sf_dir):
    """Q28: time spent in each phase until the next begins."""
    nxt = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("secs", (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).where("secs IS NOT NULL")
    return e.groupBy("event_type").agg(F.round(F.sum("secs"), 3).alias("total"))


@query("WITH p AS (SELECT CASE WHEN value > 50 THEN 1 ELSE 0 END AS y, CASE WHEN event_id % 10 = 0 THEN 0.2 WHEN value > 50 THEN 0.9 ELSE 0.0 END AS p FROM events) SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))), 6) AS log_loss FROM p")
def binary_metrics(spark, sf_dir):
    """Q31: accuracy at one half and clipped log loss; predictions are data."""
    y = (F.col("value") > 50).cast("int")
    pred = F.when(F.col("event_id") % 10 == 0, 0.2).when(F.col("value") > 50, 0.9).otherwise(0.0)
    d = table(spark, sf_dir, "events").select(y.alias("y"), pred.alias("p")).withColumn("c", F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7)))
    loss = -(F.col("y") * F.log("c") + (1 - F.col("y")) * F.log(1 - F.col("c")))
    return d.agg(F.round(F.avg(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg(loss), 6).alias("log_loss"))
