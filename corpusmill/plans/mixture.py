"""Queries for mixtures, curricula, supply and the selector, over small specifications and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import mixture as M
from ..registry import query
from ..session import table
from .cleaning import docs

BATCH, STEPS, SEQ = 8, 60, 128
STAGES = [("warm", 0, 20), ("mid", 20, 50), ("cool", 50, 60)]
SHARES = [
    ("warm", "de", 0.10, 0.125), ("warm", "en", 0.70, 0.0), ("warm", "es", 0.05, 0.125), ("warm", "fr", 0.15, 0.0),
    ("mid", "de", 0.20, 0.125), ("mid", "en", 0.45, 0.0), ("mid", "es", 0.15, 0.125), ("mid", "fr", 0.20, 0.0),
    ("cool", "de", 0.30, 0.125), ("cool", "en", 0.20, 0.0), ("cool", "es", 0.30, 0.25), ("cool", "fr", 0.20, 0.0),
]
#: ord, stage, tokens, band into it, and weights by lane.
CURRICULUM = [(0, "s0", 50.0, 0.0, (0.1, 0.7, 0.1, 0.1)), (1, "s1", 200.0, 20.0, (0.2, 0.5, 0.1, 0.2)), (2, "s2", 150.0, 40.0, (0.25, 0.3, 0.2, 0.25)), (3, "anneal", 40.0, 10.0, (0.3, 0.1, 0.4, 0.2))]
LANES = ("de", "en", "es", "fr")
#: lane, dataset, tokens, samples (millions), license, tier, overlap, keep, planned.
INVENTORY = [
    ("en", "web-a", 400.0, None, "odc-by", "B", 0.0, 1.0, False), ("en", "web-b", 150.0, 90.0, "cc-by-sa", "A", 0.4, 0.9, False), ("en", "web-view", 60.0, None, "odc-by", "B", 1.0, 1.0, False),
    ("de", "news", 40.0, 12.0, "cc-by", "A", 0.1, 0.8, False), ("de", "synth-de", 30.0, None, "own", "C", 0.0, 1.0, True), ("es", "books", 25.0, 3.5, "CC-BY-NC", "B", 0.2, 0.7, False),
    ("es", "synth-es", 35.0, None, "own", "C", 0.0, 1.0, True), ("fr", "law", 55.0, 20.0, "non-commercial", "A", 0.0, 0.6, False), ("fr", "forum", 70.0, 45.0, "cc-by", "B", 0.3, 0.5, False),
]
CAPS = [("A", 4.0), ("B", 2.0), ("C", 1.5)]
HARD_CAP = 3.0
VIEWS = [("es", "en", 0.5), ("es", "fr", 0.25)]
RESERVE = [("de", 15.0), ("en", 5.0), ("es", 12.0), ("fr", 8.0)]

V = S.values
stages_v, shares_v = V(STAGES, ["stage", "step_start", "step_end"]), V(SHARES, ["stage", "lane", "share", "floor"])
curr_rows = [(o, s, t, b, ln, w) for o, s, t, b, ws in CURRICULUM for ln, w in zip(LANES, ws)]
curr_v = V(curr_rows, ["ord", "stage", "tokens", "band", "lane", "weight"])
inv_names = ["lane", "dataset", "tokens_b", "samples_m", "license", "tier", "overlap", "keep", "planned"]
inv_v = V(INVENTORY, inv_names)
LOOKUP = f"st AS (SELECT * FROM {stages_v}), steps AS (SELECT CAST(range AS BIGINT) AS step FROM range(65)), at_stage AS (SELECT step, coalesce(stage, (SELECT max_by(stage, step_end) FROM st)) AS stage FROM steps LEFT JOIN st ON step >= step_start AND step < step_end)"
QUOTA = f"""sh AS (SELECT * FROM {shares_v}), e AS (SELECT *, share * {BATCH} AS exact, CAST(floor(share * {BATCH}) AS BIGINT) AS low FROM sh),
    r AS (SELECT *, {BATCH} - sum(low) OVER (PARTITION BY stage) AS rest, row_number() OVER (PARTITION BY stage ORDER BY -(exact - low), lane) AS rank FROM e), quota AS (SELECT stage, lane, share, floor, CAST(low + CASE WHEN rank <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r)"""


def stages(spark) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage string, step_start bigint, step_end bigint")


def shares(spark) -> DataFrame:
    return spark.createDataFrame(SHARES, "stage string, lane string, share double, floor double")


def inventory(spark) -> DataFrame:
    rows = spark.createDataFrame(INVENTORY, "lane string, dataset string, tokens_b double, samples_m double, license string, tier string, overlap double, keep double, planned boolean")
    return rows.withColumn("net", F.col("tokens_b") * (1 - F.col("overlap")) * F.col("keep"))


INV = f"inv AS (SELECT *, tokens_b * (1 - overlap) * keep AS net FROM {inv_v})"


def curriculum(spark) -> DataFrame:
    """(ord, stage, tokens, band, lane, weight, lo, hi): bounds are running sums of stage tokens."""
    c = spark.createDataFrame(curr_rows, "ord bigint, stage string, tokens double, band double, lane string, weight double")
    hi = F.sum("tokens").over(W.partitionBy("lane").orderBy("ord"))
    return c.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("tokens"))


CURR = f"cur AS (SELECT *, sum(tokens) OVER (PARTITION BY lane ORDER BY ord) - tokens AS lo, sum(tokens) OVER (PARTITION BY lane ORDER BY ord) AS hi FROM {curr_v})"


@query(f"WITH {LOOKUP} SELECT * FROM at_stage")
def stage_lookup(spark, sf_dir):
    """the stage of each step, the last one beyond all."""
    return M.at_stage(spark.range(65).select(F.col("id").alias("step")), stages(spark))


@query(f"WITH {QUOTA} SELECT stage, lane, quota, CAST(ceil(floor * {BATCH}) AS BIGINT) AS floor_bins FROM quota")
def mixture_quota(spark, sf_dir):
    """largest-remainder quotas and integer floors."""
    return M.quotas(shares(spark), BATCH).select("stage", "lane", "quota", F.ceil(F.col("floor") * BATCH).cast("long").alias("floor_bins"))


@query()
def mixture_floors(spark, sf_dir):
    """quotas after the floors, with bins rescued."""
    return M.with_floors(M.quotas(shares(spark), BATCH), BATCH)


@query(f"SELECT stage, CAST({BATCH} AS BIGINT) AS bins, true AS floors_met FROM {stages_v}")
def mixture_floor_invariants(spark, sf_dir):
    """quotas still sum to the batch and meet the floors."""
    return mixture_floors(spark, sf_dir).groupBy("stage").agg(F.sum("quota").alias("bins"), F.bool_and(F.col("quota") >= F.col("floor_bins")).alias("floors_met"))


@query(f"WITH {LOOKUP}, {QUOTA} SELECT lane, CAST(sum(quota) AS BIGINT) AS bins, round(CAST(sum(quota) AS DOUBLE) / ({BATCH} * {STEPS}), 6) AS share FROM at_stage JOIN quota USING (stage) WHERE step < {STEPS} GROUP BY lane")
def mixture_plan(spark, sf_dir):
    """bins by lane over the whole plan."""
    steps = M.at_stage(spark.range(STEPS).select(F.col("id").alias("step")), stages(spark))
    return steps.join(M.quotas(shares(spark), BATCH), "stage").groupBy("lane").agg(F.sum("quota").alias("bins")).withColumn("share", F.round(F.col("bins") / (BATCH * STEPS), 6))


ACTUAL = f"act AS (SELECT CAST(event_id % {STEPS} AS BIGINT) AS step, CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS lane FROM events)"


@query(f"WITH {LOOKUP}, {ACTUAL}, n AS (SELECT stage, lane, count(*) AS n FROM act JOIN at_stage USING (step) GROUP BY ALL), p AS (SELECT stage, lane, share AS planned, floor, CAST(coalesce(n, 0) AS DOUBLE) / sum(coalesce(n, 0)) OVER (PARTITION BY stage) AS actual FROM {shares_v} LEFT JOIN n USING (stage, lane)) SELECT stage, lane, planned, round(actual, 6) AS actual, round(actual - planned, 6) AS deviation, abs(actual - planned) <= 0.1 AS within, actual >= floor AS floor_ok FROM p")
def mixture_compliance(spark, sf_dir):
    """planned against actual shares; events stand for consumed bins."""
    lane = F.element_at(F.array(*map(F.lit, LANES)), (F.col("user_id") % 4 + 1).cast("int"))
    act = table(spark, sf_dir, "events").select((F.col("event_id") % STEPS).alias("step"), lane.alias("lane"))
    n = act.join(M.at_stage(spark.range(65).select(F.col("id").alias("step")), stages(spark)), "step").groupBy("stage", "lane").agg(F.count("*").alias("n"))
    p = shares(spark).join(n, ["stage", "lane"], "left").na.fill(0, ["n"]).withColumn("actual", F.col("n") / F.sum("n").over(W.partitionBy("stage")))
    off = F.col("actual") - F.col("share")
    return p.select("stage", "lane", F.col("share").alias("planned"), F.round("actual", 6).alias("actual"), F.round(off, 6).alias("deviation"), (F.abs(off) <= 0.1).alias("within"), (F.col("actual") >= F.col("floor")).alias("floor_ok"))


@query(f"WITH {LOOKUP}, {QUOTA}, d AS (SELECT lane, sum(quota) * {SEQ} AS demand FROM at_stage JOIN quota USING (stage) WHERE step < {STEPS} GROUP BY lane), s AS (SELECT lang AS lane, sum({S.n_words()}) AS available FROM documents GROUP BY 1) SELECT lane, CAST(demand AS BIGINT) AS demand, CAST(available AS BIGINT) AS available, round(greatest(1.0, CAST(demand AS DOUBLE) / available), 6) AS repetition, demand <= available AS satisfied FROM d JOIN s USING (lane)")
def mixture_supply(spark, sf_dir):
    """demand of the plan against the words of each language."""
    have = docs(spark, sf_dir).groupBy(F.col("lang").alias("lane")).agg(F.sum(T.n_words("text")).alias("available"))
    d = mixture_plan(spark, sf_dir).select("lane", (F.col("bins") * SEQ).alias("demand"))
    return d.join(have, "lane").select("lane", "demand", "available", F.round(F.greatest(F.lit(1.0), F.col("demand") / F.col("available")), 6).alias("repetition"), (F.col("demand") <= F.col("available")).alias("satisfied"))


@query(f"WITH {LOOKUP} SELECT step, lane, share FROM at_stage JOIN {shares_v} USING (stage)")
def planned_shares(spark, sf_dir):
    """F8."""
    return M.at_stage(spark.range(65).select(F.col("id").alias("step")), stages(spark)).join(shares(spark), "stage").select("step", "lane", "share")


@query(f"WITH {INV} SELECT lane, dataset, round(net, 6) AS net FROM inv")
def inventory_net(spark, sf_dir):
    """G1."""
    return inventory(spark).select("lane", "dataset", F.round("net", 6).alias("net"))


@query(f"WITH {CURR} SELECT DISTINCT stage, lo, hi FROM cur")
def stage_bounds(spark, sf_dir):
    """G2."""
    return curriculum(spark).select("stage", "lo", "hi").distinct()


POS = "pos AS (SELECT CAST(range * 5 AS DOUBLE) AS pos FROM range(88))"


def positions(spark) -> DataFrame:
    return spark.range(88).select((F.col("id") * 5).cast("double").alias("pos"))


@query(f"WITH {CURR}, {POS} SELECT DISTINCT pos, stage FROM pos JOIN cur ON pos >= lo AND pos < hi")
def stage_at_token(spark, sf_dir):
    """Range join of positions to stages."""
    b = curriculum(spark).select("stage", "lo", "hi").distinct()
    return positions(spark).join(F.broadcast(b), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).select("pos", "stage")


BANDS = [("s0", "s1", 20.0), ("s2", "anneal", 10.0)]


@query(f"WITH {CURR}, s AS (SELECT DISTINCT ord, stage FROM cur), tr AS (SELECT a.stage AS a, b.stage AS b FROM s a JOIN s b ON b.ord = a.ord + 1) SELECT tr.a AS stage_from, tr.b AS stage_to, coalesce(band, 15.0) AS band FROM tr LEFT JOIN {V(BANDS, ['a', 'b', 'band'])} USING (a, b)")
def transition_bands(spark, sf_dir):
    """Listed bands, else the default."""
    s = curriculum(spark).select("ord", "stage").distinct()
    pairs = s.select((F.col("ord") + 1).alias("ord"), F.col("stage").alias("stage_from")).join(s.withColumnRenamed("stage", "stage_to"), "ord")
    known = spark.createDataFrame(BANDS, "stage_from string, stage_to string, band double")
    return pairs.join(known, ["stage_from", "stage_to"], "left").select("stage_from", "stage_to", F.coalesce("band", F.lit(15.0)).alias("band"))


@query(f"""WITH {CURR}, {POS}, c AS (SELECT pos.pos, cur.*, lag(weight) OVER w AS wb, lead(weight) OVER w AS wa, lead(band) OVER w AS ba FROM cur JOIN pos ON true WINDOW w AS (PARTITION BY pos.pos, lane ORDER BY ord)), k AS (SELECT * FROM c WHERE pos >= lo AND pos < hi)
    SELECT pos, lane, round(CASE WHEN ord > 0 AND band > 0 AND pos < lo + band / 2 THEN wb * (0.5 - 0.5 * least(greatest((pos - (lo - band / 2)) / band, 0), 1)) + weight * (0.5 + 0.5 * least(greatest((pos - (lo - band / 2)) / band, 0), 1))
    WHEN ord > 0 AND band > 0 AND ba > 0 AND pos > hi - ba / 2 THEN weight * (1 - 0.5 * least(greatest((pos - (hi - ba / 2)) / ba, 0), 1)) + wa * 0.5 * least(greatest((pos - (hi - ba / 2)) / ba, 0), 1) ELSE weight END, 6) AS weight FROM k""")
def curriculum_weights(spark, sf_dir):
    """Piecewise-linear blends across stage borders."""
    return M.blended_weights(positions(spark), curriculum(spark)).select("pos", "lane", F.round("weight", 6).alias("weight"))


@query(f"WITH {CURR} SELECT lane, round(sum(weight * tokens) FILTER (stage <> 'anneal') / sum(tokens) FILTER (stage <> 'anneal'), 6) AS run_average, round(sum(weight * tokens), 6) AS demand_b FROM cur GROUP BY lane")
def run_average(spark, sf_dir):
    """G6."""
    main = F.col("stage") != "anneal"
    wt = F.col("weight") * F.col("tokens")
    return curriculum(spark).groupBy("lane").agg(F.round(F.sum(F.when(main, wt)) / F.sum(F.when(main, F.col("tokens"))), 6).alias("run_average"), F.round(F.sum(wt), 6).alias("demand_b"))


FLOORS = [("de", 0.15), ("es", 0.20)]


@query(f"WITH {CURR}, f AS (SELECT cur.*, floor FROM cur LEFT JOIN {V(FLOORS, ['lane', 'floor'])} USING (lane)), d AS (SELECT *, sum(greatest(coalesce(floor, 0) - weight, 0)) OVER (PARTITION BY stage) AS lack, sum(CASE WHEN floor IS NULL AND weight > 0 THEN weight ELSE 0 END) OVER (PARTITION BY stage) AS mass FROM f) SELECT stage, lane, round(CASE WHEN floor IS NOT NULL THEN greatest(weight, floor) WHEN weight > 0 THEN weight - lack * weight / mass ELSE weight END, 6) AS weight FROM d")
def floors_proportional(spark, sf_dir):
    """G7."""
    f = spark.createDataFrame(FLOORS, "lane string, floor double")
    w = curriculum(spark).select(F.col("stage").alias("key"), "lane", "weight").join(f, "lane", "left")
    return M.proportional_floors(w).select(F.col("key").alias("stage"), "lane", F.round("weight", 6).alias("weight"))


@query("WITH s AS (SELECT event_type, avg(value) AS mu, sqrt(greatest(coalesce(var_samp(value), 0), 1e-9)) AS sd FROM events GROUP BY 1), z AS (SELECT event_id, event_type, (value - mu) / sd AS z FROM events JOIN s USING (event_type)), r AS (SELECT *, row_number() OVER (ORDER BY round(z, 9) DESC, event_id) AS rn FROM z) SELECT event_type AS lane, CAST(count(*) AS BIGINT) AS kept FROM r WHERE rn <= (SELECT round_even(count(*) * 0.4, 0) FROM events) GROUP BY 1")
def selector_zscore(spark, sf_dir):
    """The best four in ten by score within their lane; event types stand for lanes."""
    c = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("lane"), F.col("value").alias("score"))
    return M.zscore_select(c, 0.4).groupBy("lane").agg(F.count("*").alias("kept"))


@query(f"""WITH {CURR}, {INV} SELECT 'weights_sum' AS rule, stage AS subject FROM cur GROUP BY stage HAVING abs(sum(weight) - 1) > 1e-6
    UNION ALL SELECT 'below_floor', stage || '/' || lane FROM cur JOIN {V(FLOORS, ['lane', 'floor'])} USING (lane) WHERE weight + 1e-9 < floor
    UNION ALL SELECT 'unknown_lane', lane FROM inv WHERE lane NOT IN (SELECT lane FROM cur)
    UNION ALL SELECT 'reserve', lane FROM cur JOIN {V(RESERVE, ['lane', 'have'])} USING (lane) WHERE stage = 'anneal' AND have + 1e-9 < weight * tokens
    UNION ALL SELECT 'stage_tokens', 'total' FROM (SELECT sum(tokens) AS t FROM (SELECT DISTINCT stage, tokens FROM cur)) WHERE abs(t - 450) > 1e-6""")
def spec_problems(spark, sf_dir):
    """Rules of consistency, one row for each breach."""
    c, inv = curriculum(spark), inventory(spark)
    name = lambda r: F.lit(r).alias("rule")
    out = c.groupBy("stage").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-6").select(name("weights_sum"), F.col("stage").alias("subject"))
    floors = spark.createDataFrame(FLOORS, "lane string, floor double")
    out = out.union(c.join(floors, "lane").where("weight + 1e-9 < floor").select(name("below_floor"), F.concat("stage", F.lit("/"), "lane")))
    out = out.union(inv.join(c.select("lane").distinct(), "lane", "left_anti").select(name("unknown_lane"), "lane"))
    have = spark.createDataFrame(RESERVE, "lane string, have double")
    out = out.union(c.where("stage = 'anneal'").join(have, "lane").where("have + 1e-9 < weight * tokens").select(name("reserve"), "lane"))
    total = c.select("stage", "tokens").distinct().agg(F.sum("tokens").alias("t")).where("abs(t - 450) > 1e-6")
    return out.union(total.select(name("stage_tokens"), F.lit("total")))


DEMAND = f"{CURR}, dem AS (SELECT lane, sum(weight * tokens) AS demand FROM cur GROUP BY lane), vw AS (SELECT * FROM {V(VIEWS, ['view_lane', 'lane', 'frac'])}), chg AS (SELECT vw.lane, sum(demand * frac) AS extra FROM vw JOIN dem ON dem.lane = view_lane GROUP BY vw.lane), charged AS (SELECT lane, demand, demand + coalesce(extra, 0) AS charged FROM dem LEFT JOIN chg USING (lane))"


def charged(spark) -> DataFrame:
    dem = curriculum(spark).groupBy("lane").agg(F.sum(F.col("weight") * F.col("tokens")).alias("demand"))
    vw = spark.createDataFrame(VIEWS, "view_lane string, lane string, frac double")
    extra = vw.join(dem.withColumnRenamed("lane", "view_lane"), "view_lane").groupBy("lane").agg(F.sum(F.col("demand") * F.col("frac")).alias("extra"))
    return dem.join(extra, "lane", "left").select("lane", "demand", (F.col("demand") + F.coalesce("extra", F.lit(0.0))).alias("charged"))


@query(f"WITH {DEMAND} SELECT lane, round(demand, 6) AS demand, round(charged, 6) AS charged FROM charged")
def view_lane_charges(spark, sf_dir):
    """Demand of view lanes charged to their parents."""
    return charged(spark).select("lane", F.round("demand", 6).alias("demand"), F.round("charged", 6).alias("charged"))


SUPPLY = f"{INV}, sup AS (SELECT lane, coalesce(sum(tokens_b) FILTER (planned), 0) AS planned, coalesce(sum(tokens_b) FILTER (NOT planned AND overlap >= 1), 0) AS views, coalesce(sum(net) FILTER (NOT planned AND overlap < 1), 0) AS existing, coalesce(sum(net) FILTER (NOT planned AND overlap < 1 AND tier LIKE 'A%'), 0) AS tier_a, count(*) FILTER (NOT planned AND overlap < 1 AND (contains(license, 'NC') OR contains(lower(license), 'non-commercial'))) AS nc FROM inv GROUP BY lane)"


def supply(spark) -> DataFrame:
    own = ~F.col("planned") & (F.col("overlap") < 1)
    of = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0.0))
    return inventory(spark).groupBy("lane").agg(
        of(F.col("planned"), "tokens_b").alias("planned"), of(~F.col("planned") & (F.col("overlap") >= 1), "tokens_b").alias("views"), of(own, "net").alias("existing"),
        of(own & F.col("tier").startswith("A"), "net").alias("tier_a"), F.count_if(own & (F.col("license").contains("NC") | F.lower("license").contains("non-commercial"))).alias("nc"),
    )


@query(f"WITH {SUPPLY} SELECT lane, round(planned, 6) AS planned, round(views, 6) AS views, round(existing, 6) AS existing, round(tier_a, 6) AS tier_a, CAST(nc AS BIGINT) AS nc FROM sup")
def supply_pivot(spark, sf_dir):
    """G11."""
    return supply(spark).select("lane", *(F.round(c, 6).alias(c) for c in ("planned", "views", "existing", "tier_a")), "nc")


CAPSQL = f"lc AS (SELECT lane, least(coalesce(sum(cap * CASE WHEN planned THEN tokens_b ELSE net END) / nullif(sum(CASE WHEN planned THEN tokens_b ELSE net END), 0), {HARD_CAP}), {HARD_CAP}) AS cap FROM inv JOIN {V(CAPS, ['tier', 'cap'])} USING (tier) WHERE overlap < 1 GROUP BY lane)"


def lane_caps(spark) -> DataFrame:
    caps = spark.createDataFrame(CAPS, "tier string, cap double")
    w = F.when(F.col("planned"), F.col("tokens_b")).otherwise(F.col("net"))
    avg = F.sum(F.col("cap") * w) / F.nullif(F.sum(w), F.lit(0.0))
    return inventory(spark).where("overlap < 1").join(caps, "tier").groupBy("lane").agg(F.least(F.coalesce(avg, F.lit(HARD_CAP)), F.lit(HARD_CAP)).alias("cap"))


@query(f"WITH {INV}, {CAPSQL} SELECT lane, round(cap, 6) AS cap FROM lc")
def epoch_caps(spark, sf_dir):
    """Supply-weighted caps by lane."""
    return lane_caps(spark).select("lane", F.round("cap", 6).alias("cap"))


@query(f"WITH {DEMAND}, {SUPPLY}, {CAPSQL}, e AS (SELECT lane, charged, existing, planned, cap, CASE WHEN existing + planned > 0 THEN charged / (existing + planned) ELSE CAST('inf' AS DOUBLE) END AS epochs FROM charged JOIN sup USING (lane) JOIN lc USING (lane)) SELECT lane, round(epochs, 6) AS epochs, CASE WHEN epochs <= 1 THEN 'OK' WHEN epochs <= cap THEN 'REPEAT' ELSE 'OVER CAP' END AS status FROM e")
def supply_status(spark, sf_dir):
    """Epochs over all supply and their status."""
    total = F.col("existing") + F.col("planned")
    e = charged(spark).join(supply(spark), "lane").join(lane_caps(spark), "lane").withColumn("epochs", F.when(total > 0, F.col("charged") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(float("inf"))))
    return e.select("lane", F.round("epochs", 6).alias("epochs"), F.when(F.col("epochs") <= 1, "OK").when(F.col("epochs") <= F.col("cap"), "REPEAT").otherwise("OVER CAP").alias("status"))


TIERS = [("A", "news", 0.5), ("B", "web-a", 0.3), ("C", "synth-de", 0.2)]


@query(f"WITH {INV}, t AS (SELECT * FROM {V(TIERS, ['tier_name', 'prefix', 'frac'])}), a AS (SELECT tier_name, frac, sum(CASE WHEN planned THEN tokens_b ELSE net END) AS have FROM t JOIN inv ON starts_with(dataset, prefix) GROUP BY ALL) SELECT tier_name, round(frac * 80, 6) AS need, round(CASE WHEN tier_name = 'A' THEN greatest(have - 15.0, 0) ELSE have END, 6) AS available FROM a")
def tier_accounting(spark, sf_dir):
    """Need and supply by tier, the reserve fenced off the first."""
    t = spark.createDataFrame(TIERS, "tier_name string, prefix string, frac double")
    have = F.sum(F.when(F.col("planned"), F.col("tokens_b")).otherwise(F.col("net")))
    a = F.broadcast(t).join(inventory(spark), F.expr("startswith(dataset, prefix)")).groupBy("tier_name", "frac").agg(have.alias("have"))
    return a.select("tier_name", F.round(F.col("frac") * 80, 6).alias("need"), F.round(F.when(F.col("tier_name") == "A", F.greatest(F.col("have") - 15.0, F.lit(0.0))).otherwise(F.col("have")), 6).alias("available"))


@query(f"WITH {INV}, i AS (SELECT * FROM inv WHERE samples_m IS NOT NULL), s AS (SELECT row_number() OVER (ORDER BY samples_m DESC, dataset) AS rank, dataset AS by_samples FROM i), t AS (SELECT row_number() OVER (ORDER BY tokens_b DESC, dataset) AS rank, dataset AS by_tokens FROM i) SELECT CAST(rank AS BIGINT) AS rank, by_samples, by_tokens FROM s FULL JOIN t USING (rank) WHERE rank <= 5")
def top_by_samples_and_tokens(spark, sf_dir):
    """Two rankings side by side."""
    i = inventory(spark).where("samples_m IS NOT NULL")
    rank = lambda c: F.row_number().over(W.orderBy(F.desc(c), "dataset")).cast("long")
    return i.select(rank("samples_m").alias("rank"), F.col("dataset").alias("by_samples")).join(i.select(rank("tokens_b").alias("rank"), F.col("dataset").alias("by_tokens")), "rank", "full").where("rank <= 5")


PARAMS_B, MFU, PEAK = 30.0, 0.35, 989.0


@query(f"WITH {INV} SELECT dataset, round(2.0 * {PARAMS_B} * tokens_b * 1e18 / ({PEAK} * 1e12 * {MFU}) / 3600, 3) AS gpu_hours FROM inv WHERE planned")
def generation_cost(spark, sf_dir):
    """2 x parameters x tokens over the useful rate of a device."""
    return inventory(spark).where("planned").select("dataset", F.round(F.lit(2.0 * PARAMS_B) * F.col("tokens_b") * 1e18 / (PEAK * 1e12 * MFU) / 3600, 3).alias("gpu_hours"))


@query(f"WITH {CURR}, {SUPPLY}, a AS (SELECT lane, weight * tokens AS need, tier_a, existing FROM cur JOIN sup USING (lane) WHERE stage = 'anneal') SELECT lane, round(need, 6) AS need, CASE WHEN tier_a >= need THEN 'tier_a' WHEN existing >= need THEN 'mixed' ELSE 'short' END AS verdict FROM a")
def anneal_fundability(spark, sf_dir):
    """G17."""
    a = curriculum(spark).where("stage = 'anneal'").withColumn("need", F.col("weight") * F.col("tokens")).join(supply(spark), "lane")
    return a.select("lane", F.round("need", 6).alias("need"), F.when(F.col("tier_a") >= F.col("need"), "tier_a").when(F.col("existing") >= F.col("need"), "mixed").otherwise("short").alias("verdict"))


SIM = [("de", 0.15), ("en", 0.6), ("es", 0.1), ("fr", 0.15)]
BIAS = {"de": -0.6, "es": -1.2}
SIM_STEPS, SIM_N = 50, 60


def sim_sql(per_lane: bool) -> str:
    z = "(s - avg(s) OVER (PARTITION BY step, lane)) / sqrt(greatest(coalesce(var_samp(s) OVER (PARTITION BY step, lane), 0), 1e-9))" if per_lane else "s"
    return f"""SELECT step, lane, count(*) AS drawn, count(*) FILTER (rank <= 24) AS kept FROM (SELECT step, cand, lane, row_number() OVER (PARTITION BY step ORDER BY round(z, 9) DESC, cand) AS rank FROM (SELECT step, cand, lane, {z} AS z FROM
    (SELECT step, cand, lane, sqrt(-2 * ln(1 - {S.keyed_unit('g1', 'step', 'cand')})) * cos(2 * pi() * {S.keyed_unit('g2', 'step', 'cand')}) + CASE lane WHEN 'de' THEN -0.6 WHEN 'es' THEN -1.2 ELSE 0 END AS s
    FROM (SELECT step, cand, {S.keyed_unit('lane', 'step', 'cand')} AS u FROM (SELECT range AS step FROM range({SIM_STEPS})), (SELECT range AS cand FROM range({SIM_N})))
    JOIN (SELECT lane, round(sum(weight) OVER (ORDER BY lane) - weight, 9) AS lo, round(sum(weight) OVER (ORDER BY lane), 9) AS hi FROM {V(SIM, ['lane', 'weight'])}) ON u >= lo AND u < hi))) GROUP BY step, lane"""


@query(f"SELECT CAST(step AS BIGINT) AS step, lane, CAST(drawn AS BIGINT) AS drawn, CAST(kept AS BIGINT) AS kept FROM ({sim_sql(True)})")
def run_simulation(spark, sf_dir):
    """Candidates drawn, scored and selected at each step."""
    return M.simulate(spark, SIM_STEPS, SIM_N, spark.createDataFrame(SIM, "lane string, weight double"), BIAS, 0.4)


@query(f"WITH a AS (SELECT 'zscore' AS arm, * FROM ({sim_sql(True)}) UNION ALL SELECT 'global', * FROM ({sim_sql(False)})), s AS (SELECT arm, lane, sum(kept) AS kept, sum(drawn) AS drawn FROM a GROUP BY ALL) SELECT lane, CAST(sum(kept) FILTER (arm = 'zscore') AS BIGINT) AS zscore, CAST(sum(kept) FILTER (arm = 'global') AS BIGINT) AS global_, round(1 - CAST(sum(kept) FILTER (arm = 'global') AS DOUBLE) / sum(kept) FILTER (arm = 'zscore'), 6) AS collapse FROM s GROUP BY lane")
def arm_comparison(spark, sf_dir):
    """Kept by lane under two selectors, and the share that the biased one loses."""
    w = spark.createDataFrame(SIM, "lane string, weight double")
    arms = [M.simulate(spark, SIM_STEPS, SIM_N, w, BIAS, 0.4, per).withColumn("arm", F.lit(a)) for a, per in (("zscore", True), ("global_", False))]
    p = arms[0].union(arms[1]).groupBy("lane").pivot("arm", ["zscore", "global_"]).agg(F.sum("kept"))
    return p.withColumn("collapse", F.round(1 - F.col("global_") / F.col("zscore"), 6))


@query(f"WITH {CURR}, d AS (SELECT b.ord, b.stage, b.lane, b.weight - a.weight AS move FROM cur a JOIN cur b ON b.lane = a.lane AND b.ord = a.ord + 1), s AS (SELECT stage, sum(abs(move)) AS l1, max_by(lane, abs(move) * 1000000 - ascii(lane)) AS lane FROM d GROUP BY stage) SELECT stage, round(l1, 6) AS l1, lane AS largest, round(1 + 2.5 * l1, 6) AS spike, round(greatest(5.0, 50 * l1), 6) AS band FROM s")
def transition_table(spark, sf_dir):
    """How far each transition moves, and the band it asks for."""
    c = curriculum(spark)
    d = c.join(c.select((F.col("ord") + 1).alias("ord"), "lane", F.col("weight").alias("was")), ["ord", "lane"]).withColumn("move", F.abs(F.col("weight") - F.col("was")))
    s = d.groupBy("stage").agg(F.sum("move").alias("l1"), F.max_by("lane", F.col("move") * 1000000 - F.ascii("lane")).alias("largest"))
    return s.select("stage", F.round("l1", 6).alias("l1"), "largest", F.round(1 + 2.5 * F.col("l1"), 6).alias("spike"), F.round(F.greatest(F.lit(5.0), 50 * F.col("l1")), 6).alias("band"))


@query(f"WITH r AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY {S.keyed_hex('reservoir', 'doc_id')}) AS rn FROM documents) SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({S.n_words()}) AS BIGINT) AS words, round(CAST(sum(length(text)) AS DOUBLE) / sum({S.n_words()}), 6) AS chars_per_word FROM r WHERE rn <= 50 GROUP BY lang")
def fertility_by_lang(spark, sf_dir):
    """A keyed sample of 50 documents for each language (the feature), and its ratio of sums."""
    r = docs(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(T.keyed_hex("reservoir", F.col("doc_id"))))).where("rn <= 50")
    w = T.n_words("text")
    return r.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(w).alias("words"), F.round(F.sum(F.length("text")) / F.sum(w), 6).alias("chars_per_word"))


@query(f"WITH {CURR}, a AS (SELECT stage, lane, CASE WHEN lane = 'es' THEN 0.25 ELSE weight END AS weight FROM cur WHERE lane IN (SELECT DISTINCT lang FROM documents WHERE lang <> 'fr')) SELECT stage, lane, round(CASE WHEN lane = 'es' THEN 0.25 ELSE weight / sum(weight) FILTER (lane <> 'es') OVER (PARTITION BY stage) * 0.75 END, 6) AS weight FROM a")
def proxy_weights(spark, sf_dir):
    """Weights of the lanes at hand, one pinned, the others scaled to the rest."""
    there = docs(spark, sf_dir).where("lang <> 'fr'").select(F.col("lang").alias("lane")).distinct()
    a = curriculum(spark).join(there, "lane", "left_semi")
    free = F.sum(F.when(F.col("lane") != "es", F.col("weight"))).over(W.partitionBy("stage"))
    return a.select("stage", "lane", F.round(F.when(F.col("lane") == "es", 0.25).otherwise(F.col("weight") / free * 0.75), 6).alias("weight"))


@query()
def forced_lane_choice(spark, sf_dir):
    """Drawn lanes, overruled where a protected lane's share is below its floor; users stand for branches."""
    e = table(spark, sf_dir, "events")
    draws = e.select(F.col("user_id").alias("branch"), F.col("event_id").alias("step"), F.element_at(F.array(*map(F.lit, LANES)), (F.pmod(F.hash("event_id"), F.lit(4)) + 1)).alias("lane"))
    return M.forced_lanes(draws, {"de": 0.3, "es": 0.3})


@query("WITH m AS (SELECT user_id, event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND 1 PRECEDING) AS med FROM events) SELECT user_id, event_id, CASE WHEN value >= 4 * med THEN 'halt' WHEN value >= 2 * med THEN 'warn' ELSE 'ok' END AS alarm FROM m WHERE med IS NOT NULL")
def grad_norm_alarm(spark, sf_dir):
    """Values against the rolling median of those before, within each user's series."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-199, -1)
    m = table(spark, sf_dir, "events").withColumn("med", F.percentile("value", 0.5).over(w)).where("med IS NOT NULL")
    return m.select("user_id", "event_id", F.when(F.col("value") >= 4 * F.col("med"), "halt").when(F.col("value") >= 2 * F.col("med"), "warn").otherwise("ok").alias("alarm"))


@query("WITH f AS (SELECT event_type AS arm, user_id % 4 AS lane, max_by(value, event_id) AS final FROM events GROUP BY ALL), b AS (SELECT lane, final AS base FROM f WHERE arm = 'click') SELECT arm, CAST(lane AS BIGINT) AS lane, round(final, 6) AS final, round(final - base, 6) AS delta FROM f JOIN b USING (lane)")
def arm_report(spark, sf_dir):
    """Final metric by arm and lane, and its difference from the baseline arm."""
    f = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 4).alias("lane")).agg(F.max_by("value", "event_id").alias("final"))
    return f.join(f.where("arm = 'click'").select("lane", F.col("final").alias("base")), "lane").select("arm", "lane", F.round("final", 6).alias("final"), F.round(F.col("final") - F.col("base"), 6).alias("delta"))


@query(f"WITH t AS (SELECT conv_id, role, {S.n_words()} AS n FROM conversations) SELECT conv_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS trained FROM t GROUP BY conv_id")
def role_token_mask(spark, sf_dir):
    """Loss-bearing tokens: only the assistant's."""
    n = T.n_words("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).alias("tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("trained"))


FLOOR_SPEC = [("de", "0.15"), ("es", "0.2"), ("enforce", "true"), ("note", "per batch")]


@query(f"SELECT key, CAST(try_cast(value AS DOUBLE) AS DOUBLE) AS floor FROM {V(FLOOR_SPEC, ['key', 'value'])} WHERE try_cast(value AS DOUBLE) IS NOT NULL")
def numeric_floors(spark, sf_dir):
    """Q27: numeric floors of a block that holds switches and notes too."""
    f = spark.createDataFrame(FLOOR_SPEC, "key string, value string")
    return f.select("key", F.col("value").try_cast("double").alias("floor")).where("floor IS NOT NULL")
