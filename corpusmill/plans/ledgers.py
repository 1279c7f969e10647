"""Queries for ledgers, recovery, replay and forks; events stand for ledger rows, users for branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..registry import query
from ..session import table

BODY = "event_type || '|' || CAST(event_id AS VARCHAR)"
LEDGER = f"l AS (SELECT user_id AS branch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {BODY} AS body, event_id, event_type, value FROM events)"
CHAIN = f"""{LEDGER}, g AS (SELECT branch, list(body ORDER BY seq) AS bs FROM l GROUP BY branch),
    f AS (SELECT branch, list_reduce(bs, lambda a, b: list_append(a, sha256(a[-1] || b[1])), ['{L.GENESIS}']) AS hs FROM (SELECT branch, list_transform(bs, lambda b: [b]) AS bs FROM g)),
    c AS (SELECT l.*, hs[CAST(seq AS BIGINT) + 1] AS prev_hash, hs[CAST(seq AS BIGINT) + 2] AS event_hash FROM l JOIN f USING (branch))"""


def ledger(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seq = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("branch"), seq.alias("seq"), F.concat_ws("|", "event_type", "event_id").alias("body"), "event_id", "event_type", "value")


def chained(spark, sf_dir) -> DataFrame:
    return L.chain(ledger(spark, sf_dir), "branch", "seq", "body")


@query(f"WITH {CHAIN} SELECT branch, CAST(seq AS BIGINT) AS seq, prev_hash, event_hash FROM c")
def ledger_chain(spark, sf_dir):
    """Hash chains by branch."""
    return chained(spark, sf_dir).select("branch", "seq", "prev_hash", "event_hash")


@query(f"WITH {CHAIN} SELECT branch, CAST(count(*) AS BIGINT) AS count, max_by(event_hash, seq) AS tail_hash FROM c GROUP BY branch")
def ledger_offsets(spark, sf_dir):
    """Tails of all ledgers."""
    return L.offsets(chained(spark, sf_dir), "branch", "seq")


@query(f"WITH {CHAIN} SELECT branch, CAST(count(*) FILTER (seq < 10) AS BIGINT) AS kept, CAST(count(*) FILTER (seq >= 10) AS BIGINT) AS discarded FROM c GROUP BY branch HAVING count(*) >= 10")
def ledger_truncate(spark, sf_dir):
    """Ledgers cut back to an offset, checked against its tail hash."""
    c = chained(spark, sf_dir)
    marks = c.where("seq < 10").groupBy("branch").agg(F.count("*").alias("count"), F.max_by("event_hash", "seq").alias("tail_hash")).where("count = 10")
    kept = L.truncate(c, marks, "branch", "seq").groupBy("branch").agg(F.count("*").alias("kept"))
    return kept.join(c.groupBy("branch").agg(F.count("*").alias("n")), "branch").select("branch", "kept", (F.col("n") - F.col("kept")).alias("discarded"))


TAMPER = "CASE WHEN branch % 4 = 1 AND seq = 3 THEN body || 'x' ELSE body END"


@query(f"WITH {LEDGER}, n AS (SELECT branch, count(*) AS n FROM l GROUP BY branch) SELECT branch, CAST(CASE branch % 4 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 5 END AS BIGINT) AS seq, CASE branch % 4 WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'seq_gap' ELSE 'prev_mismatch' END AS violation FROM n WHERE branch % 4 IN (1, 2, 3) AND n > 6")
def ledger_chain_verify(spark, sf_dir):
    """One edited body, one deleted row, one forged link: each found at its first place."""
    c = chained(spark, sf_dir)
    kind = F.col("branch") % 4
    big = c.groupBy("branch").agg(F.count("*").alias("n")).where("n > 6").select("branch")
    bad = c.join(big, "branch").where(~((kind == 2) & (F.col("seq") == 5)))
    bad = bad.withColumn("body", F.when((kind == 1) & (F.col("seq") == 3), F.concat("body", F.lit("x"))).otherwise(F.col("body")))
    bad = bad.withColumn("prev_hash", F.when((kind == 3) & (F.col("seq") == 5), F.lit(L.GENESIS)).otherwise(F.col("prev_hash")))
    return L.verify(bad, "branch", "seq", "body")


@query(f"WITH {LEDGER} SELECT branch, CAST(count(*) AS BIGINT) AS microbatches, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS accepted, round(max(value), 6) AS hardest FROM l GROUP BY branch")
def consumption_writer(spark, sf_dir):
    """Microbatches with their decisions joined on, and the hardest token of each branch's trace."""
    l = ledger(spark, sf_dir)  # noqa: E741
    dec = l.where("event_type = 'purchase'").select("event_id", F.lit("accepted").alias("status"))
    j = l.join(dec, "event_id", "left")
    return j.groupBy("branch").agg(F.count("*").alias("microbatches"), F.count("status").alias("accepted"), F.round(F.max("value"), 6).alias("hardest"))


STEPS = "s AS (SELECT user_id AS branch, event_id AS seq, event_id % 97 AS step, value FROM events)"


def steps(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("branch"), F.col("event_id").alias("seq"), (F.col("event_id") % 97).alias("step"), "value")


@query(f"WITH {STEPS}, u AS (SELECT *, coalesce(step > lag(step) OVER (PARTITION BY branch ORDER BY seq), true) AS up FROM s) SELECT branch, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT step) AS BIGINT) AS \"distinct\", CAST(count(*) - count(DISTINCT step) AS BIGINT) AS duplicates, CAST(max(step) + 1 - count(DISTINCT step) AS BIGINT) AS missing, count(*) = count(DISTINCT step) AND max(step) + 1 = count(DISTINCT step) AS exactly_once, bool_and(up) AS monotonic FROM u GROUP BY branch")
def step_coverage(spark, sf_dir):
    """M1: duplicates, gaps and order of the steps each branch has seen."""
    return L.coverage(steps(spark, sf_dir), "branch", "step").select("branch", "rows", "distinct", "duplicates", "missing", "exactly_once", "monotonic")


def _replay_sql() -> str:
    from . import sharding

    return f"WITH {sharding.SPANS} SELECT lang AS lane, CAST(count(*) AS BIGINT) AS samples, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS differing FROM spans GROUP BY lang"


@query(_replay_sql())
def replay_from_ledger(spark, sf_dir):
    """M2: a run's ledger of bins, as JSON lines with each bin's hash and the spans it took; the bins are rebuilt from these
    spans and the documents alone, without packing, and hashed again."""
    from ..operators import shards
    from ..session import scratch
    from ..sources import tables as src
    from . import sharding

    packed = shards.pack(sharding.lane_samples(spark, sf_dir), "best_fit_decreasing", sharding.SEQ)
    run = sharding.hashed(shards.bins(packed, sharding.span_tokens(spark, sf_dir), sharding.SEQ)).select("lane", "chunk", "bin", "content_hash")
    spans = packed.groupBy("lane", "chunk", "bin").agg(F.array_sort(F.collect_list(F.struct("segment", "sample_id", "doc_id", "n_tokens"))).alias("spans"))
    path = scratch(spark, "bin-ledger")
    src.write_jsonl(run.join(spans, ["lane", "chunk", "bin"]), path)
    read = src.read_jsonl(spark, path, "lane string, chunk bigint, bin bigint, content_hash string, spans array<struct<segment:bigint,sample_id:string,doc_id:bigint,n_tokens:bigint>>")
    each = read.select("lane", "chunk", "bin", F.explode("spans").alias("s")).select("lane", "chunk", "bin", "s.*")
    again = sharding.hashed(shards.bins(each, sharding.span_tokens(spark, sf_dir), sharding.SEQ)).select("lane", "chunk", "bin", F.col("content_hash").alias("rebuilt"))
    both = read.select("lane", "chunk", "bin", "content_hash", F.size("spans").alias("n"), F.expr("aggregate(spans, 0L, (a, s) -> a + s.n_tokens)").alias("t")).join(again, ["lane", "chunk", "bin"], "left")
    return both.groupBy("lane").agg(F.sum("n").alias("samples"), F.sum("t").alias("tokens"), F.count_if(~F.col("content_hash").eqNullSafe(F.col("rebuilt"))).alias("differing"))


@query("SELECT CAST(4 AS BIGINT) AS branches, CAST(0 AS BIGINT) AS differing")
def replay_by_replanning(spark, sf_dir):
    """Planners stopped after half their steps, dumped and restored plan the same batches as ones that ran
    through."""
    from ..session import materialize
    from . import sharding

    whole = sharding.planned(spark, sf_dir)
    halves = sharding.planned(spark, sf_dir, stop=6)
    hashes = lambda p: materialize(p.where("kind = 'bin'").select("branch", "step", "batch_hash", "fingerprint").distinct(), "plan")
    both = hashes(whole).alias("a").join(hashes(halves).alias("b"), ["branch", "step"], "full")
    same = F.col("a.batch_hash").eqNullSafe(F.col("b.batch_hash")) & F.col("a.fingerprint").eqNullSafe(F.col("b.fingerprint"))
    return both.agg(F.count_distinct("branch").alias("branches"), F.count_if(~same).alias("differing"))


@query(f"WITH {STEPS} SELECT branch, step, max_by(value, seq) AS value FROM s GROUP BY ALL")
def batches_by_step(spark, sf_dir):
    """M4: the last batch of each step wins."""
    return steps(spark, sf_dir).groupBy("branch", "step").agg(F.max_by("value", "seq").alias("value"))


@query(f"WITH {STEPS}, f AS (SELECT step, min_by(value, seq) AS old, max_by(value, seq) AS new FROM s GROUP BY step HAVING count(*) > 1) SELECT CAST(count(*) AS BIGINT) AS redone, CAST(count(*) FILTER (old = new) AS BIGINT) AS same FROM f")
def redone_steps(spark, sf_dir):
    """M5: steps done again, and whether they came out the same."""
    f = steps(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n"), F.min_by("value", "seq").alias("old"), F.max_by("value", "seq").alias("new")).where("n > 1")
    return f.agg(F.count("*").alias("redone"), F.count_if(F.col("old") == F.col("new")).alias("same"))


FORK = "a AS (SELECT event_id % 200 AS step, max_by(event_type, event_id) AS h FROM events GROUP BY 1), b AS (SELECT event_id % 200 AS step, max_by(CASE WHEN event_id % 200 >= 120 THEN reverse(event_type) ELSE event_type END, event_id) AS h FROM events GROUP BY 1)"


@query(f"WITH {FORK} SELECT CAST(min(step) FILTER (a.h <> b.h) AS BIGINT) AS first_difference, CAST(count(*) FILTER (a.h = b.h) AS BIGINT) AS identical FROM a JOIN b USING (step)")
def fork_divergence(spark, sf_dir):
    """Where a fork leaves its parent."""
    e = table(spark, sf_dir, "events").withColumn("step", F.col("event_id") % 200)
    a = e.groupBy("step").agg(F.max_by("event_type", "event_id").alias("a"))
    b = e.groupBy("step").agg(F.max_by(F.when(F.col("step") >= 120, F.reverse("event_type")).otherwise(F.col("event_type")), "event_id").alias("b"))
    return a.join(b, "step").agg(F.min(F.when(F.col("a") != F.col("b"), F.col("step"))).alias("first_difference"), F.count_if(F.col("a") == F.col("b")).alias("identical"))


@query("WITH c AS (SELECT user_id, event_id AS ck FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, event_id FROM events WHERE event_type = 'click') SELECT q.user_id, q.event_id, (SELECT max(ck) FROM c WHERE c.user_id = q.user_id AND ck <= q.event_id) AS checkpoint FROM q")
def as_of_checkpoint(spark, sf_dir):
    """M7: the latest checkpoint at or before each place: a running maximum over the sorted union, not a range join."""
    e = table(spark, sf_dir, "events")
    back = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(back)
    return e.where("event_type IN ('purchase', 'click')").withColumn("checkpoint", at).where("event_type = 'click'").select("user_id", "event_id", "checkpoint")


@query(f"WITH {CHAIN} SELECT sha256(string_agg(branch || ':' || h, '|' ORDER BY branch)) AS fingerprint FROM (SELECT branch, max_by(event_hash, seq) AS h FROM c GROUP BY branch)")
def stream_fingerprint(spark, sf_dir):
    """One hash over the tails of all branches; a short row for each."""
    o = L.offsets(chained(spark, sf_dir), "branch", "seq")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch", "tail_hash"))), lambda x: F.concat_ws(":", x["branch"], x["tail_hash"])), "|")
    return o.agg(F.sha2(ordered, 256).alias("fingerprint"))
