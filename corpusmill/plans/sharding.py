"""Queries for shards, spans, packing, bins and the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import planner, shards, windows
from ..operators.order import ranked
from ..registry import query
from ..session import materialize, table
from .cleaning import docs
from .mixture import BATCH, LANES, SHARES, STAGES

SEQ = 128
ASSIGN = "a AS (SELECT *, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 60 AS BIGINT) AS shard FROM documents)"
SPANS = f"""{ASSIGN}, n AS (SELECT lang, shard, doc_id, {S.n_words()} AS n FROM a), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang, shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doc_start FROM n),
    s AS (SELECT lang, shard, doc_id, doc_start + n AS doc_end, unnest(range(CAST(doc_start AS BIGINT), CAST(doc_start + n AS BIGINT), 127)) AS token_start FROM o WHERE n > 0),
    spans AS (SELECT lang, shard, doc_id, token_start, CAST(least(token_start + 127, doc_end) AS BIGINT) AS token_end, CAST(least(token_start + 127, doc_end) - token_start AS BIGINT) AS n_tokens,
    lang || '-' || shard || ':' || token_start || '-' || CAST(least(token_start + 127, doc_end) AS BIGINT) AS sample_id FROM s WHERE least(token_start + 127, doc_end) - token_start >= 8)"""


def samples(spark, sf_dir) -> DataFrame:
    """Spans of the documents' words, languages as lanes."""
    return shards.spans(shards.assign(docs(spark, sf_dir), 60, "lang"), SEQ, "lang")


def lane_samples(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).select(F.col("lang").alias("lane"), "sample_id", "doc_id", "n_tokens")


@query(f"WITH {ASSIGN} SELECT doc_id, lang, shard FROM a")
def shard_assign(spark, sf_dir):
    """H2."""
    return shards.assign(docs(spark, sf_dir), 60, "lang").select("doc_id", "lang", "shard")


@query(f"WITH {SPANS} SELECT * FROM spans")
def sample_spans(spark, sf_dir):
    """H1: packable spans."""
    return samples(spark, sf_dir)


@query(f"WITH {ASSIGN} SELECT lang, shard, CAST(count(*) AS BIGINT) AS num_docs, CAST(sum({S.n_words()}) AS BIGINT) AS num_tokens, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS content_hash FROM a GROUP BY lang, shard")
def shard_manifests(spark, sf_dir):
    """H3: a manifest for each shard, its hash over the documents' hashes; wall-clock fields are no part of it."""
    a = shards.assign(docs(spark, sf_dir), 60, "lang")
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ",")
    return a.groupBy("lang", "shard").agg(F.count("*").alias("num_docs"), F.sum(T.n_words("text")).alias("num_tokens"), F.sha2(hashes, 256).alias("content_hash"))


@query(f"WITH {ASSIGN} SELECT lang, shard, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS content_hash, shard % 5 <> 3 AS verified, CASE shard % 15 WHEN 3 THEN 'content_hash' WHEN 8 THEN 'num_tokens' WHEN 13 THEN 'content_hash' END AS mismatch FROM a GROUP BY lang, shard")
def manifest_verification(spark, sf_dir):
    """H4: stored manifests against ones recomputed from the documents; every fifth is tampered with before, in its hash or its
    size, and is found."""
    m = shard_manifests(spark, sf_dir)
    stored = materialize(m, "manifests")
    stored = stored.withColumn("content_hash", F.when(F.col("shard") % 15 == 8, F.col("content_hash")).when(F.col("shard") % 5 == 3, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    stored = stored.withColumn("num_tokens", F.when(F.col("shard") % 15 == 8, F.col("num_tokens") + 1).otherwise(F.col("num_tokens")))
    both = m.alias("a").join(stored.alias("b"), ["lang", "shard"], "full")
    what = F.when(~F.expr("a.content_hash <=> b.content_hash"), "content_hash").when(~F.expr("a.num_tokens <=> b.num_tokens"), "num_tokens")
    return both.select("lang", "shard", "a.content_hash", what.isNull().alias("verified"), what.alias("mismatch"))


@query(f"WITH {ASSIGN}, m AS (SELECT lang, shard, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS h, sum({S.n_words()}) AS t FROM a GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS shards, CAST(sum(t) AS BIGINT) AS tokens, sha256(string_agg(h, '|' ORDER BY lang, shard)) AS index_hash FROM m")
def shard_index(spark, sf_dir):
    """H5: the index over all shards and its hash; one short row for each shard."""
    m = shard_manifests(spark, sf_dir)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "shard", "content_hash"))), lambda x: x["content_hash"]), "|")
    return m.agg(F.count("*").alias("shards"), F.sum("num_tokens").alias("tokens"), F.sha2(ordered, 256).alias("index_hash"))


def _packed(name: str):
    def run(spark, sf_dir):
        return shards.pack(lane_samples(spark, sf_dir), name, SEQ)

    run.__doc__ = f"H6 to H8: samples placed by {name}."
    return run


for _name in shards.POLICIES:
    query(name=f"pack_{_name}")(_packed(_name))


@query(f"WITH {SPANS} SELECT lang AS lane, sample_id, n_tokens, CAST(row_number() OVER (PARTITION BY lang ORDER BY sample_id) - 1 AS BIGINT) AS bin FROM spans")
def pack_pad_only(spark, sf_dir):
    """H9: a bin for each sample."""
    return shards.pad_only(lane_samples(spark, sf_dir)).select("lane", "sample_id", "n_tokens", "bin")


@query(f"WITH {SPANS} SELECT p AS policy, CAST(count(*) AS BIGINT) AS placed, CAST(count(DISTINCT sample_id) AS BIGINT) AS samples, true AS fits FROM spans, (SELECT unnest([{', '.join(repr(n) for n in shards.POLICIES)}]) AS p) GROUP BY p")
def packing_invariants(spark, sf_dir):
    """H6 to H8: every sample placed once, no bin over its room."""
    own = materialize(lane_samples(spark, sf_dir), "samples")
    out = None
    for name in shards.POLICIES:
        p = shards.pack(own, name, SEQ)
        room = p.groupBy("lane", "chunk", "bin").agg(F.sum(F.col("n_tokens") + 1).alias("used"), F.count("*").alias("n"), F.collect_list("sample_id").alias("ids"))
        one = room.agg(F.lit(name).alias("policy"), F.sum("n").alias("placed"), F.count_distinct("ids").alias("bins"), F.bool_and(F.col("used") <= SEQ).alias("fits"))
        one = one.select("policy", "placed", "fits").join(p.agg(F.count_distinct("sample_id").alias("samples")))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def packing_policies(spark, sf_dir):
    """Bins, padding and utilisation by policy."""
    own = materialize(lane_samples(spark, sf_dir), "samples")
    out = shards.utilisation(shards.pad_only(own), SEQ).withColumn("policy", F.lit("pad_only"))
    for name in shards.POLICIES:
        out = out.union(shards.utilisation(shards.pack(own, name, SEQ), SEQ).withColumn("policy", F.lit(name)))
    return out.withColumn("streamable", F.col("policy").isin("pad_only", "best_fit_decreasing"))


def span_tokens(spark, sf_dir) -> DataFrame:
    """(sample_id, ids) of all spans."""
    own = samples(spark, sf_dir)
    ids = docs(spark, sf_dir).select("doc_id", shards.token_ids().alias("all"))
    first = W.partitionBy("doc_id").orderBy("token_start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = own.withColumn("from", F.col("token_start") - F.min("token_start").over(first))
    return at.join(ids, "doc_id").select("sample_id", F.slice("all", (F.col("from") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("ids"))


def binned(spark, sf_dir) -> DataFrame:
    """Materialised best-fit-decreasing bins of all samples."""
    return shards.bins(shards.pack(lane_samples(spark, sf_dir), "best_fit_decreasing", SEQ), span_tokens(spark, sf_dir), SEQ)


def hashed(b: DataFrame) -> DataFrame:
    return b.withColumn("content_hash", shards.array_hash("input_ids", "loss_mask", "segment_ids", "position_ids"))


@query()
def packed_bins(spark, sf_dir):
    """Bins as aligned arrays, with the hash over them."""
    return hashed(binned(spark, sf_dir))


@query(f"WITH {SPANS} SELECT lang AS lane, CAST(count(*) AS BIGINT) AS samples, CAST(sum(n_tokens + 1) AS BIGINT) AS content_tokens, true AS aligned, true AS padding_bears_no_loss, true AS no_loss_across_segments, true AS positions_restart FROM spans GROUP BY lang")
def bin_invariants(spark, sf_dir):
    """What holds for every bin, by lane, with the samples and tokens that the bins hold."""
    b = binned(spark, sf_dir)
    z = F.arrays_zip("input_ids", "loss_mask", "segment_ids", "position_ids")
    pair = F.transform(F.sequence(F.lit(1), F.lit(SEQ - 1)), lambda i: F.struct(F.get("loss_mask", i).alias("m"), F.get("segment_ids", i).alias("s"), F.get("segment_ids", i - 1).alias("t"), F.get("position_ids", i).alias("p"), F.get("position_ids", i - 1).alias("q")))
    b = b.withColumn("z", z).withColumn("pair", pair)
    return b.groupBy("lane").agg(
        F.sum("n_samples").alias("samples"),
        F.sum("content_tokens").alias("content_tokens"),
        F.bool_and((F.size("input_ids") == SEQ) & (F.size("loss_mask") == SEQ) & (F.size("segment_ids") == SEQ) & (F.size("position_ids") == SEQ)).alias("aligned"),
        F.bool_and(F.forall("z", lambda x: (x["segment_ids"] != -1) | (x["loss_mask"] == 0))).alias("padding_bears_no_loss"),
        F.bool_and(F.forall("pair", lambda x: (x["m"] == 0) | (x["s"] == x["t"]))).alias("no_loss_across_segments"),
        F.bool_and(F.forall("pair", lambda x: (x["s"] == -1) | F.when(x["s"] == x["t"], x["p"] == x["q"] + 1).otherwise(x["p"] == 0))).alias("positions_restart"),
    )


@query(f"WITH {SPANS} SELECT true AS causal, true AS within_segment, true AS every_position_attends_itself, CAST(count(*) AS BIGINT) AS samples FROM spans")
def attention_invariants(spark, sf_dir):
    """The attention relation of every bin, and how many samples the bins hold."""
    b = materialize(binned(spark, sf_dir), "bins")
    c = shards.attention_checks(b)
    return c.agg(*(F.bool_and(x).alias(x) for x in c.columns)).crossJoin(b.agg(F.sum(F.array_max("segment_ids").cast("long") + 1).alias("samples")))


CACHE = 8


@query(f"""WITH a AS (SELECT user_id, event_id * 7 % 25 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), p AS (SELECT *, lag(i) OVER (PARTITION BY user_id, k ORDER BY i) AS last FROM a),
    d AS (SELECT p.user_id, p.i, p.last, count(DISTINCT b.k) AS others FROM p LEFT JOIN a b ON b.user_id = p.user_id AND b.i > p.last AND b.i < p.i GROUP BY ALL) SELECT user_id, CAST(count(*) FILTER (last IS NOT NULL AND others < {CACHE}) AS BIGINT) AS hits, CAST(count(*) FILTER (last IS NULL OR others >= {CACHE}) AS BIGINT) AS misses FROM d GROUP BY user_id""")
def shard_cache(spark, sf_dir):
    """Hits and misses of each reader's cache of the shards used last; an access hits if fewer than its capacity of others
    came between."""
    reads = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 25).alias("shard"))
    return shards.cache_hits(reads, "user_id", "event_id", "shard", CACHE)


@query(f"WITH {SPANS} SELECT lang AS lane, CAST(count(*) AS BIGINT) AS samples, round(avg(n_tokens), 6) AS mean_len, CAST(trunc(quantile_cont(n_tokens, 0.5)) AS BIGINT) AS p50, CAST(trunc(quantile_cont(n_tokens, 0.95)) AS BIGINT) AS p95, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM spans GROUP BY lang")
def sample_index(spark, sf_dir):
    """Samples by lane."""
    return samples(spark, sf_dir).groupBy(F.col("lang").alias("lane")).agg(
        F.count("*").alias("samples"), F.round(F.avg("n_tokens"), 6).alias("mean_len"), F.percentile("n_tokens", 0.5).cast("long").alias("p50"), F.percentile("n_tokens", 0.95).cast("long").alias("p95"), F.sum("n_tokens").alias("tokens")
    )


@query(f"WITH {SPANS} SELECT lang AS lane, sample_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY {S.keyed_hex('epoch0', 'sample_id')}) AS BIGINT) AS place FROM spans")
def lane_order(spark, sf_dir):
    """Keyed order of a lane in an epoch."""
    keyed = samples(spark, sf_dir).select(F.col("lang").alias("lane"), "sample_id", T.keyed_hex("epoch0", F.col("sample_id")).alias("k"))
    return ranked(keyed, ["lane"], ["k"]).select("lane", "sample_id", (F.col("place") + 1).alias("place"))


@query(f"WITH {SPANS}, lo AS (SELECT lang AS lane, sample_id, row_number() OVER (PARTITION BY lang ORDER BY {S.keyed_hex('epoch0', 'sample_id')}) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM spans), d AS (SELECT range AS draw FROM range(3000)) SELECT lane, CAST(draw AS BIGINT) AS draw, CAST(draw // n AS BIGINT) AS epoch, sample_id FROM d JOIN lo ON draw % n = place")
def candidate_cursor(spark, sf_dir):
    """Draws wrap around a lane into a repeated pass."""
    o = lane_order(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("lane")))
    d = spark.range(3000).select(F.col("id").alias("draw"))
    per = o.select("lane", "n").distinct()
    at = d.join(F.broadcast(per)).select("lane", "draw", F.expr("draw div n").alias("epoch"), (F.col("draw") % F.col("n") + 1).alias("place"))
    return at.join(o.select("lane", "place", "sample_id"), ["lane", "place"]).select("lane", "draw", "epoch", "sample_id")


AFFINITY = {"de": 0.10, "en": 0.70, "es": 0.05, "fr": 0.15}
FEATURES = f"""f AS (SELECT s.sample_id, s.lang AS lane, s.n_tokens, round(least(1.0, s.n_tokens / 127.0), 6) AS utilisation, round(least(1.0, s.n_tokens / 64.0), 6) AS length_fit, CASE s.lang WHEN 'de' THEN 0.10 WHEN 'en' THEN 0.70 WHEN 'es' THEN 0.05 ELSE 0.15 END AS lane_affinity,
    {S.symbol_ratio(kind='selector')} AS symbols, row_number() OVER (PARTITION BY sha256(text || token_start - first_start) ORDER BY sample_id) > 1 AS duplicate FROM (SELECT *, min(token_start) OVER (PARTITION BY doc_id) AS first_start FROM spans) s JOIN documents USING (doc_id)),
    sc AS (SELECT *, CAST(round(CAST(utilisation AS DECIMAL(12, 6)) * 0.35 + 0.30 + CAST(length_fit AS DECIMAL(12, 6)) * 0.20 + CAST(lane_affinity AS DECIMAL(12, 6)) * 0.15, 6) AS DOUBLE) AS score FROM f),
    dec AS (SELECT *, CASE WHEN symbols > 0.03 THEN 'rejected' WHEN duplicate THEN 'deferred' WHEN score < 0.60 THEN 'rejected' WHEN score < 0.68 THEN 'deferred' ELSE 'accepted' END AS status,
    CASE WHEN symbols > 0.03 THEN 'symbol_heavy_content' WHEN duplicate THEN 'duplicate_token_span' WHEN score < 0.60 THEN 'low_' || list_sort([{{'v': 0.35 * utilisation, 'n': 'utilisation'}}, {{'v': 0.30, 'n': 'novelty'}}, {{'v': 0.20 * length_fit, 'n': 'length_fit'}}, {{'v': 0.15 * lane_affinity, 'n': 'lane_affinity'}}])[1].n
    WHEN score < 0.68 THEN 'borderline_proxy_score' ELSE 'score_above_threshold' END AS reason FROM sc)"""


def scored(spark, sf_dir) -> DataFrame:
    """H17 to H19 without state: novelty is 1, duplicates are the later ones of equal spans by sample_id."""
    d = docs(spark, sf_dir)
    s = samples(spark, sf_dir).withColumn("first_start", F.min("token_start").over(W.partitionBy("doc_id"))).join(d.select("doc_id", "text"), "doc_id")
    aff = F.create_map(*(x for k, v in AFFINITY.items() for x in (F.lit(k), F.lit(v))))[F.col("lang")]
    dup = F.row_number().over(W.partitionBy(F.sha2(F.concat("text", (F.col("token_start") - F.col("first_start")).cast("string")), 256)).orderBy("sample_id")) > 1
    f = s.select("sample_id", F.col("lang").alias("lane"), "n_tokens", F.round(F.least(F.lit(1.0), F.col("n_tokens") / 127.0), 6).alias("utilisation"), F.round(F.least(F.lit(1.0), F.col("n_tokens") / 64.0), 6).alias("length_fit"), aff.alias("lane_affinity"), T.symbol_ratio("text", "selector").alias("symbols"), dup.alias("duplicate"))
    w = planner.WEIGHTS
    exact = " + ".join(f"cast({c} as decimal(12, 6)) * {w[c]!r}BD" for c in ("utilisation", "length_fit", "lane_affinity"))
    f = f.withColumn("score", F.expr(f"cast(round({exact} + {w['novelty']!r}BD, 6) as double)"))
    parts = {"utilisation": w["utilisation"] * F.col("utilisation"), "novelty": F.lit(w["novelty"]), "length_fit": w["length_fit"] * F.col("length_fit"), "lane_affinity": w["lane_affinity"] * F.col("lane_affinity")}
    weakest = F.array_min(F.array(*(F.struct(v.alias("v"), F.lit(k).alias("n")) for k, v in parts.items())))["n"]
    heavy, dup, low, edge = F.col("symbols") > planner.MAX_SYMBOLS, F.col("duplicate"), F.col("score") < planner.DEFER, F.col("score") < planner.ACCEPT
    f = f.withColumn("status", F.when(heavy, "rejected").when(dup, "deferred").when(low, "rejected").when(edge, "deferred").otherwise("accepted"))
    return f.withColumn("reason", F.when(heavy, "symbol_heavy_content").when(dup, "duplicate_token_span").when(low, F.concat(F.lit("low_"), weakest)).when(edge, "borderline_proxy_score").otherwise("score_above_threshold"))


@query(f"WITH {SPANS}, {FEATURES} SELECT sample_id, lane, utilisation, length_fit, score, status, reason FROM dec")
def selector_decisions(spark, sf_dir):
    """H17 to H19."""
    return scored(spark, sf_dir).select("sample_id", "lane", "utilisation", "length_fit", "score", "status", "reason")


@query(f"WITH {SPANS}, {FEATURES} SELECT coalesce(lane, 'all') AS lane, coalesce(status, 'all') AS status, coalesce(reason, 'all') AS reason, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score FROM dec GROUP BY GROUPING SETS ((), (status), (lane, status), (reason))")
def selector_summary(spark, sf_dir):
    """Counts by status, lane and reason in one pass."""
    s = scored(spark, sf_dir)
    g = s.groupingSets([[], ["status"], ["lane", "status"], ["reason"]], "lane", "status", "reason").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    return g.select(*(F.coalesce(c, F.lit("all")).alias(c) for c in ("lane", "status", "reason")), "n", "mean_score")


@query(f"WITH {SPANS}, {FEATURES}, rj AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY score DESC, sample_id) AS rn FROM dec WHERE status = 'rejected') SELECT lane, sample_id, 'protected_floor_override(was:' || reason || ')' AS reason FROM rj WHERE rn <= 2")
def floor_overrides(spark, sf_dir):
    """The two best rejected samples of each lane, for two bins missing."""
    rj = scored(spark, sf_dir).where("status = 'rejected'").withColumn("rn", F.row_number().over(W.partitionBy("lane").orderBy(F.desc("score"), "sample_id"))).where("rn <= 2")
    return rj.select("lane", "sample_id", F.concat(F.lit("protected_floor_override(was:"), "reason", F.lit(")")).alias("reason"))


def planned(spark, sf_dir, stop: int | None = None) -> DataFrame:
    """Plans of four branches (documents dealt by id), 12 steps each; with stop, states are dumped and restored there."""
    d = docs(spark, sf_dir)
    s = samples(spark, sf_dir).join(d.select("doc_id", "text"), "doc_id").join(windows.sketches(d), "doc_id")
    s = s.select((F.col("doc_id") % 4).alias("branch"), "sample_id", F.col("lang").alias("lane"), "n_tokens", F.sha2(F.concat_ws("|", "text", "token_start"), 256).alias("token_hash"), T.symbol_ratio("text", "selector").alias("symbol_ratio"), "sketch")
    sh = {n: {ln: x for st, ln, x, _ in SHARES if st == n} for n, _, _ in STAGES}
    quotas = {n: {ln: int(x * BATCH) for ln, x in v.items()} for n, v in sh.items()}
    for q in quotas.values():
        q["en"] += BATCH - sum(q.values())
    floors = {n: {ln: 1 for st, ln, _, f in SHARES if st == n and f > 0} for n, _, _ in STAGES}
    stages = [(n, a // 5, b // 5) for n, a, b in STAGES]
    return planner.plan_branches(s, stages, quotas, floors, sh, 12, SEQ, stop)


@query()
def batch_plan(spark, sf_dir):
    """Bins and decisions of a stateful planner, with batch hashes and state fingerprints."""
    return planned(spark, sf_dir).drop("sample_ids").withColumn("score", F.round("score", 6))


@query(f"WITH {SPANS} SELECT CAST(count(DISTINCT lang) AS BIGINT) AS lanes, true AS within_quota FROM spans")
def batch_plan_invariants(spark, sf_dir):
    """No step plans more bins than its batch, and all lanes appear."""
    p = materialize(planned(spark, sf_dir), "plan").where("kind = 'bin'")
    per = p.groupBy("branch", "step").agg(F.count("*").alias("n")).agg(F.bool_and(F.col("n") <= BATCH).alias("within_quota"))
    return p.agg(F.count_distinct("lane").alias("lanes")).join(per)


@query()
def validation_batch(spark, sf_dir):
    """A fixed batch, the first eight bins of held-out samples by best fit decreasing."""
    held = lane_samples(spark, sf_dir).where("doc_id % 10 = 0").withColumn("lane", F.lit("validation"))
    return shards.pack_first(held, SEQ, 8)


@query(f"WITH {SPANS} SELECT sample_id, CAST(n_tokens + 1 AS BIGINT) AS cost, lang = 'en' AS is_en FROM spans WHERE n_tokens BETWEEN 64 AND 127")
def long_samples(spark, sf_dir):
    """C10's sample predicate over spans."""
    return samples(spark, sf_dir).where("n_tokens BETWEEN 64 AND 127").select("sample_id", (F.col("n_tokens") + 1).alias("cost"), (F.col("lang") == "en").alias("is_en"))


assert tuple(sorted(AFFINITY)) == LANES
