"""Mixture schedules and supply: quotas with protected floors, curricula with blended transitions, epoch caps."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def at_stage(steps: DataFrame, stages: DataFrame) -> DataFrame:
    """Adds the stage whose [step_start, step_end) holds the step; beyond all, the last one. stages: a handful of rows."""
    last = stages.agg(F.max_by("stage", "step_end").alias("last"))
    out = steps.join(F.broadcast(stages), (F.col("step") >= F.col("step_start")) & (F.col("step") < F.col("step_end")), "left")
    return out.join(F.broadcast(last)).select("step", F.coalesce("stage", "last").alias("stage"))


def quotas(shares: DataFrame, batch: int) -> DataFrame:
    """(stage, lane, share, quota): floors of share x batch, the rest to the largest fractions, ties by lane."""
    out = shares.withColumn("exact", F.col("share") * batch).withColumn("low", F.floor("exact").cast("long"))
    per = W.partitionBy("stage")
    out = out.withColumn("rest", batch - F.sum("low").over(per)).withColumn("rank", F.row_number().over(per.orderBy((-(F.col("exact") - F.col("low"))), "lane")))
    return out.withColumn("quota", F.col("low") + (F.col("rank") <= F.col("rest")).cast("long")).drop("exact", "low", "rest", "rank")


def raise_to_floors(quota: dict[str, int], floors: dict[str, int]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Lanes below their floor take bins, one at a time, from the largest lane above its own (ties: the larger name)."""
    quota, rescues = dict(quota), []
    for lane in sorted(floors):
        while quota.get(lane, 0) < floors[lane]:
            donors = [x for x in quota if x != lane and quota[x] > floors.get(x, 0)]
            if not donors:
                break
            donor = max(donors, key=lambda x: (quota[x], x))
            quota[donor] -= 1
            quota[lane] = quota.get(lane, 0) + 1
            rescues.append((lane, donor))
    return quota, rescues


def with_floors(quota: DataFrame, batch: int) -> DataFrame:
    """quotas() with column floor (a share): (stage, lane, share, floor_bins, quota, rescued). A stage has a few lanes."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        floors = {ln: math.ceil(f * batch) for ln, f in zip(g.lane, g.floor) if f > 0}
        new, rescues = raise_to_floors(dict(zip(g.lane, g.quota)), floors)
        return g.assign(floor_bins=[floors.get(x, 0) for x in g.lane], quota=[new[x] for x in g.lane], rescued=[sum(r[0] == x for r in rescues) for x in g.lane])[["stage", "lane", "share", "floor_bins", "quota", "rescued"]]

    return quota.groupBy("stage").applyInPandas(one, "stage string, lane string, share double, floor_bins bigint, quota bigint, rescued bigint")


def proportional_floors(weights: DataFrame) -> DataFrame:
    """(key, lane, weight) with floor (null if none): lanes below their floor rise to it, paid pro rata by lanes without
    one. Raises where no such lane is left to pay."""
    per = W.partitionBy("key")
    lift = F.greatest(F.coalesce("floor", F.lit(0.0)) - F.col("weight"), F.lit(0.0))
    out = weights.withColumn("lack", F.sum(lift).over(per)).withColumn("mass", F.sum(F.when(F.col("floor").isNull() & (F.col("weight") > 0), F.col("weight")).otherwise(0.0)).over(per))
    paid = F.when(F.col("floor").isNotNull(), F.greatest("weight", "floor")).when(F.col("weight") > 0, F.col("weight") - F.col("lack") * F.col("weight") / F.col("mass")).otherwise(F.col("weight"))
    poor = (F.col("lack") > 0) & (F.col("mass") <= 0)
    return out.withColumn("weight", F.when(poor, F.raise_error(F.lit("no unprotected mass left to fund the floors")).cast("double")).otherwise(paid)).drop("lack", "mass")


def zscore_select(candidates: DataFrame, keep: float, by: str = "lane", per_lane: bool = True) -> DataFrame:
    """The best round(keep x n) of candidates (id, lane, score), by score within its lane's mean and sample deviation."""
    n = candidates.count()
    k = max(1, round(keep * n))
    if per_lane:
        stats = candidates.groupBy(by).agg(F.avg("score").alias("mu"), F.sqrt(F.greatest(F.coalesce(F.var_samp("score"), F.lit(0.0)), F.lit(1e-9))).alias("sd"))
        candidates = candidates.join(stats, by).withColumn("z", (F.col("score") - F.col("mu")) / F.col("sd")).drop("mu", "sd")
    else:
        candidates = candidates.withColumn("z", F.col("score"))
    return candidates.orderBy(F.desc(F.round("z", 9)), "id").limit(k)


def blended_weights(positions: DataFrame, stages: DataFrame) -> DataFrame:
    """(pos, lane, weight): target weights at a token position; around each border between stages the two are mixed over
    the band of the stage after it, half before and half behind. stages: (ord, lane, weight, lo, hi, band) in full."""
    s = stages
    cur = positions.join(F.broadcast(s), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    before = s.select((F.col("ord") + 1).alias("ord"), "lane", F.col("weight").alias("w_before"))
    after = s.select((F.col("ord") - 1).alias("ord"), "lane", F.col("weight").alias("w_after"), F.col("band").alias("band_after"))
    cur = cur.join(F.broadcast(before), ["ord", "lane"], "left").join(F.broadcast(after), ["ord", "lane"], "left")
    head = (F.col("pos") - (F.col("lo") - F.col("band") / 2)) / F.col("band")
    tail = (F.col("pos") - (F.col("hi") - F.col("band_after") / 2)) / F.col("band_after")
    a, b = 0.5 + 0.5 * F.least(F.greatest(head, F.lit(0.0)), F.lit(1.0)), 0.5 * F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))
    w = (
        F.when((F.col("ord") > 0) & (F.col("band") > 0) & (F.col("pos") < F.col("lo") + F.col("band") / 2), F.col("w_before") * (1 - a) + F.col("weight") * a)
        .when((F.col("ord") > 0) & (F.col("band") > 0) & (F.col("band_after") > 0) & (F.col("pos") > F.col("hi") - F.col("band_after") / 2), F.col("weight") * (1 - b) + F.col("w_after") * b)
        .otherwise(F.col("weight"))
    )
    return cur.select("pos", "lane", w.alias("weight"))


def forced_lanes(draws: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(branch, step, lane): the drawn lane, unless a protected lane's share so far is below its floor; sequential within
    a branch."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        done: dict[str, int] = {}
        out = []
        for k, lane in enumerate(g.sort_values("step").lane):
            poor = [x for x in sorted(floors) if k and done.get(x, 0) / k < floors[x]]
            pick = min(poor, key=lambda x: (done.get(x, 0) / k - floors[x], x)) if poor else lane
            done[pick] = done.get(pick, 0) + 1
            out.append(pick)
        return g.sort_values("step").assign(lane=out)[["branch", "step", "lane"]]

    return draws.groupBy("branch").applyInPandas(one, "branch bigint, step bigint, lane string")


def simulate(spark, steps: int, per_step: int, weights: DataFrame, bias: dict[str, float], keep: float, per_lane: bool = True) -> DataFrame:
    """(step, lane, drawn, kept): candidates drawn by weight with keyed numbers, scored by a keyed Gaussian with a bias
    for each lane, the best of each step kept. weights: (lane, weight), a few rows."""
    cum = weights.withColumn("hi", F.sum("weight").over(W.orderBy("lane"))).withColumn("lo", F.col("hi") - F.col("weight"))
    c = spark.range(steps).select(F.col("id").alias("step")).select("step", F.explode(F.sequence(F.lit(0), F.lit(per_step - 1))).alias("cand"))
    c = c.withColumn("u", T.keyed_unit("lane", F.col("step"), F.col("cand")))
    c = c.join(F.broadcast(cum), (F.col("u") >= F.round("lo", 9)) & (F.col("u") < F.round("hi", 9)))
    gauss = F.sqrt(-2 * F.log(1 - T.keyed_unit("g1", F.col("step"), F.col("cand")))) * F.cos(2 * math.pi * T.keyed_unit("g2", F.col("step"), F.col("cand")))
    shift = F.coalesce(F.create_map(*(x for k, v in bias.items() for x in (F.lit(k), F.lit(v))))[F.col("lane")], F.lit(0.0))
    c = c.withColumn("score", gauss + shift)
    if per_lane:
        w = W.partitionBy("step", "lane")
        c = c.withColumn("score", (F.col("score") - F.avg("score").over(w)) / F.sqrt(F.greatest(F.coalesce(F.var_samp("score").over(w), F.lit(0.0)), F.lit(1e-9))))
    k = max(1, round(keep * per_step))
    c = c.withColumn("rank", F.row_number().over(W.partitionBy("step").orderBy(F.desc(F.round("score", 9)), "cand")))
    return c.groupBy("step", "lane").agg(F.count("*").alias("drawn"), F.count_if(F.col("rank") <= k).alias("kept"))
