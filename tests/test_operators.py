"""Operators on small rows made by hand: invariants, planted defects and edge cases."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.functions import text as T
from corpusmill.operators import clean, contamination, dedup, ledger, mixture, nearest, pairs, planner, series, shards, tokens
from corpusmill.plans import numeric, sharding
from corpusmill.plans.numeric import largest_that_fits
from corpusmill.session import scratch
from corpusmill.sources import tables
from corpusmill.streaming import windows


def docs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")


def one(df, c):
    return [r[0] for r in df.orderBy("doc_id").select(c).collect()]


def test_normalize_keeps_joiners_and_drops_noise(spark):
    d = docs(spark, ["a &amp; b﻿​  c‍\n\n\n\nd", None, ""])
    got = clean.normalize(d).orderBy("doc_id").collect()
    assert got[0].text == "a & b c‍\n\nd" and (got[0].n_entities, got[0].n_removed, got[0].n_joiners) == (1, 2, 1)
    assert got[1].text is None and got[2].text == ""


def test_normalize_v1_fuses_lines(spark):
    assert one(clean.normalize_v1(docs(spark, ["a\nb  c"])), "text") == ["ab c"]


def test_markers(spark):
    d = docs(spark, ["[User]: hi\n<bot>: yo", "### Response: x", "Human: hi", "plain", "<|im_start|>user [INST] x"])
    assert one(d, clean.marker_kinds()) == [["bracket_user", "angle_human"], ["alpaca_header"], ["openai_role"], [], ["chatml_literal", "llama_inst"]]
    assert one(d, clean.remove_markers())[0] == "hi\n yo"


def test_unify_format(spark):
    d = docs(spark, ["[User]: q\n[Assistant]: a"])
    r = d.select(clean.unify_format(F.col("text"), F.lit("")).alias("r")).select("r.*").first()
    assert (r.instruction, r.output) == ("q", "a\n") and r.text.startswith("<|im_start|>user\nq<|im_end|>")


def test_drop_reasons(spark):
    good = "the small cat and old dog sat on a mat with joy " * 6
    d = docs(spark, ["short one", "*** " * 60, "a i " * 40, ("same line of words the\n" * 12), good, "xyz abc " * 40, "తెలుగు ఒక " * 30])
    assert one(d, clean.drop_reason()) == ["too_short", "symbol_ratio", "mean_word_length", "duplicate_lines", None, "no_stopwords", None]


def test_identifiers_in_order(spark):
    d = docs(spark, ["mail me@x.org, call +1-555-019-0042 or 9876543210, 10.0.0.1, 1234 5678 9012, http://u:p@localhost/"])
    r = clean.redact(d).first()
    assert r.text == "mail [EMAIL], call [PHONE] or [PHONE], [IP], [GOVT_ID], [URL_CRED]localhost/" and r.n_email == r.n_ipv4 == r.n_govt_id == r.n_url_credentials == 1


def test_script_of(spark):
    d = docs(spark, ["", "abc", "नमस्ते abc", "été", "→→", "తెలుగు", "тест"])
    assert one(d, T.script_of("text")) == ["Empty", "ASCII", "Devanagari", "Latin-ext", "Other", "Telugu", "Cyrillic"]


def test_keep_first_is_not_components(spark):
    # 0-1, 1-2: 1 is like 0, 2 only like the dropped 1, so 2 stays
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "lo bigint, hi bigint")
    assert {r.doc_id: r.kept for r in dedup.keep_first(e).collect()} == {0: True, 1: False, 2: True, 3: False}


def test_lsh_finds_planted_copies(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(20)]
    d = docs(spark, base + [b + " and one more line" for b in base[:5]] + base[:2] + ["", None])
    got = {r.doc_id: r for r in dedup.lsh_keep(d).collect()}
    assert all(got[k].kept for k in range(20)) and all(not got[20 + k].kept and got[20 + k].duplicate_of == k for k in range(5))
    assert got[25].duplicate_of == 0 and got[26].duplicate_of == 1


def test_exact_pairs_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    line = " ".join(f"l{k}" for k in range(25))
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(70, 120))) + "\n" + line for _ in range(300)]
    for k in range(120):  # likeness around the bound
        w = texts[k % 40].split()
        for at in rng.sample(range(len(w)), k % 6):
            w[at] = "new"
        texts.append("\t".join(w))
    long = "x" * 70
    texts += texts[:3] * 4 + ["", None, "one", "one", " one two ", "one\rtwo", "one\x0btwo", f"{long} a", f"{long} a", f"{long}y a"]

    def shingles(t):
        w = [x for x in re.split("[ \t\n\r\f]+", t or "") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [shingles(t) for t in texts]
    like = lambda a, b: len(a & b) / max(1, len(a | b))
    want = {(i, j, round(like(sets[i], sets[j]), 9)) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like(sets[i], sets[j]) >= 0.7}
    rows = {}

    def counted(df, name, write=pairs.materialize):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(pairs, "materialize", counted)
    got = [(r.lo, r.hi, round(r.jaccard, 9)) for r in dedup.exact_pairs(docs(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert rows["found"] < 3000  # the line, which most texts share, makes no pairs


def test_versions_next_to_other_letters(spark, tmp_path):
    texts = ["g\u00e4ver. 22.144.239.132", "av 1.2.3", "v1.2.3\u00e9", "v1.2.3x", "ver\u017fion 1.2.3", "x_v1.2.3", "(V\n1.2.3)", "v 1.2", "v1.2.3.4.5", "CANARY-1", "\u0301v1.2.3\u0301", "VERSION 1.22.333_", None]
    for k, t in enumerate(texts):  # a folder for each, as the query counts
        (tmp_path / str(k)).mkdir()
        spark.createDataFrame([(1, t, "en", "web")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        same_as_sql(spark, "canary_scan", tmp_path / str(k))


@pytest.mark.parametrize("at_once", [8_000_000, 200])
def test_nearest_of_all_rows(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", at_once)
    rng = np.random.default_rng(3)
    v = [[float(x) for x in r] for r in rng.normal(size=(1500, 8)).astype(np.float32)]
    for k in range(0, 1500, 50):  # copies, and what differs beyond the sixth place
        v[(k * 7 + 13) % 1500] = v[(k * 11 + 29) % 1500] = v[k]
        v[(k * 3 + 7) % 1500] = [x + 1e-8 for x in v[k]]
    v[700], v[701], v[702] = None, [float("nan")] * 8, [float("inf")] * 8
    rows = [(k, x, None if k % 97 == 5 else k % 4) for k, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"WITH {numeric.NEIGHBOURS} SELECT vec_id, label, other FROM n WHERE rn = 1").fetchall()
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    got = nearest.nearest(e, e.where("vec_id % 100 = 0"))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    same_as_sql(spark, "nn_same_label_rate", tmp_path)


def test_contamination_runs_and_gate(spark):
    item = " ".join(f"q{k}" for k in range(80))
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    d = docs(spark, ["x " * 30 + item + " y" * 30, "x " * 100])
    r = {x.doc_id: x for x in contamination.verdicts(contamination.runs(d, b)).collect()}
    assert r[0].run == 69 and r[0].reason == "verbatim_run" and r[1].reason is None
    m = spark.createDataFrame([("a", "t", "train", "trainable", False, "cc", "exact_dedup_pass", "clean", "h"), ("b", "t", "eval", None, True, None, None, None, None)], "shard_id string, tokenizer_hash string, split string, permission string, never_train boolean, license string, dedup_status string, contamination_status string, cleaning_pipeline_hash string")
    g = {x.shard_id: x for x in contamination.admit(m, "t").collect()}
    assert g["a"].admitted and g["b"].reasons == ["split_not_trainable:eval", "permission:None", "never_train_flag", "license_not_admissible", "dedup_status_missing", "contamination:None", "unknown_cleaning_lineage"]


def same_as_sql(spark, name, sf_dir):
    """A query's rows over a folder, held against its SQL; returns them."""
    con = duckdb.connect()
    for f in sf_dir.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}/*.parquet')")
    df = registry.queries()[name](spark, str(sf_dir))
    got = Counter(map(tuple, df.collect()))
    assert got == Counter(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    return got


@pytest.mark.parametrize("name", ["admission_gate", "forgery_twins"])
def test_shards_beyond_four_digits(spark, tmp_path, name):
    rows = [(k, f"text {k % 1000}") for start in (0, 300, 500_000, 500_300, 505_200) for k in range(start, start + 120)] + [(k, None) for k in (1000, 13_350, 13_700)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    got = same_as_sql(spark, name, tmp_path)
    assert any("shard-1000" in r[0] for r in got)


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 9), min_size=1), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 4)))
def test_floors_keep_the_sum(quota, floors):
    new, rescues = mixture.raise_to_floors(quota, floors)
    assert sum(new.values()) == sum(quota.values()) and all(v >= 0 for v in new.values())
    if sum(quota.values()) >= sum(floors.values()):
        assert all(new.get(x, 0) >= f for x, f in floors.items())


def test_quota_is_largest_remainder(spark):
    s = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.25), ("s", "c", 0.25)], "stage string, lane string, share double")
    assert {r.lane: r.quota for r in mixture.quotas(s, 7).collect()} == {"a": 3, "b": 2, "c": 2}


def test_floors_without_mass_raise(spark):
    w = spark.createDataFrame([("k", "a", 0.1, 0.5), ("k", "b", 0.2, 0.5)], "key string, lane string, weight double, floor double")
    with pytest.raises(Exception, match="no unprotected mass"):
        mixture.proportional_floors(w).collect()


@given(st.lists(st.integers(1, 50), max_size=60), st.booleans(), st.one_of(st.none(), st.integers(1, 4)))
def test_packing_never_overflows(costs, best, most):
    used: dict[int, int] = {}
    for c, b in zip(costs, shards.fit(costs, 50, best, most), strict=True):
        used[b] = used.get(b, 0) + c
    assert all(v <= 50 for v in used.values())


def test_bins(spark):
    p = spark.createDataFrame([("en", 0, "s1", 1, 3, 0, 0, 0), ("en", 0, "s2", 2, 2, 0, 4, 1)], shards.PACKED)
    t = spark.createDataFrame([("s1", [7, 8, 9]), ("s2", [5, 6])], "sample_id string, ids array<int>")
    r = shards.bins(p, t, 10).first()
    assert r.input_ids == [7, 8, 9, 1, 5, 6, 1, 0, 0, 0] and r.segment_ids == [0, 0, 0, 0, 1, 1, 1, -1, -1, -1]
    assert r.position_ids == [0, 1, 2, 3, 0, 1, 2, 0, 0, 0] and r.loss_mask == [0, 1, 1, 1, 0, 1, 1, 0, 0, 0] and r.loss_tokens == 5


def test_attention_of_every_bin(spark, sf_dir, monkeypatch):
    segs = [[0] * 4, [0] * 4, [0, 0, 1, -1]]
    b = spark.createDataFrame([("en", 0, k, s) for k, s in enumerate(segs)], "lane string, chunk bigint, bin bigint, segment_ids array<int>")
    got = {k: {(r.i, r.j) for r in shards.attention(b).where(f"bin = {k}").collect()} for k in (0, 2)}
    assert got == {0: {(i, j) for i in range(4) for j in range(i + 1)}, 2: {(0, 0), (1, 0), (1, 1), (2, 2), (3, 3)}}
    leaky = lambda s: np.repeat(np.tri(s.shape[1], dtype=bool)[None], len(s), 0)
    assert [tuple(r) for r in shards.attention_checks(b, leaky).collect()] == [(True, True, True)] * 2 + [(True, False, True)]
    # the query sees a bin of any number
    seen = []
    checks = shards.attention_checks
    monkeypatch.setattr(shards, "attention_checks", lambda x: seen.append(x.count()) or checks(x))
    monkeypatch.setattr(sharding, "binned", lambda *_: b)
    assert sharding.attention_invariants(spark, sf_dir).first() == (True, True, True, 4) and seen == [3]


def test_first_bins_are_those_of_all_samples():
    rng = random.Random(8)
    for n in (0, 1, 9, 40, 400):
        for lo, hi in ((9, 128), (9, 64), (30, 33), (64, 65), (9, 10), (40, 90)):
            costs = sorted((rng.randint(lo, hi) for _ in range(n)), reverse=True)
            want, used, size = [], Counter(), Counter()
            for k, (c, b) in enumerate(zip(costs, shards.fit(costs, 128, True, 8))):
                if b < 8:
                    want.append((c, k - costs.index(c), b, used[b], size[b]))
                used[b] += c
                size[b] += 1
            assert shards.first_bins(dict(Counter(costs)), 128, 8, 8) == want
    assert len(shards.first_bins({65: 1, 64: 10**12, 63: 5}, 128, 8, 8)) == 16


def test_validation_batch_takes_from_all_samples(spark, tmp_path):
    n = 20_500
    d = spark.range(n).selectExpr("id * 10 AS doc_id", "'en' AS lang", "repeat('w ', int(8 + id % 120)) AS text")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.validation_batch(spark, str(tmp_path)).toPandas()
    held = sharding.lane_samples(spark, str(tmp_path)).withColumn("lane", F.lit("validation"))
    want = shards.pack(held, "best_fit_decreasing", sharding.SEQ, 10**9).where("bin < 8").toPandas()
    key = lambda x: sorted(x[["sample_id", "doc_id", "n_tokens", "bin", "bin_offset", "segment"]].itertuples(index=False, name=None))
    assert key(got) == key(want) and got.bin.nunique() == 8


def test_planner_restores(spark):
    rows = [(f"s{k}", "ab"[k % 2], 20 + k % 100, f"h{k}", 0.0, [k, k + 1]) for k in range(200)]
    g = pd.DataFrame(rows, columns=["sample_id", "lane", "n_tokens", "token_hash", "symbol_ratio", "sketch"])
    make = lambda state=None: planner.Planner(g, lambda s: "x", lambda s: {"a": 2, "b": 2}, lambda s: {"b": 1}, lambda s: {"a": 0.5, "b": 0.5}, 128, 0, state)
    whole, first = make(), make()
    plans = [whole.plan() for _ in range(6)]
    assert [first.plan() for _ in range(3)] == plans[:3]
    second = make(planner.State.load(first.state.dump()))
    assert [second.plan() for _ in range(3)] == plans[3:] and second.state.fingerprint() == whole.state.fingerprint()


def test_chain_tampering(spark):
    rows = spark.createDataFrame([(b, k, f"e{k}") for b in range(5) for k in range(6)], "branch bigint, seq bigint, body string")
    c = ledger.chain(rows, "branch", "seq", "body").cache()
    assert not ledger.verify(c, "branch", "seq", "body").collect()
    bad = c.withColumn("body", F.when((F.col("branch") == 1) & (F.col("seq") == 2), "forged").otherwise(F.col("body"))).where("NOT (branch = 2 AND seq = 4)")
    assert {(r.branch, r.seq, r.violation) for r in ledger.verify(bad, "branch", "seq", "body").collect()} == {(1, 2, "hash_mismatch"), (2, 5, "seq_gap")}
    marks = ledger.offsets(c.where("seq < 4"), "branch", "seq")
    assert ledger.truncate(c, marks, "branch", "seq").count() == 20
    with pytest.raises(Exception, match="doesn't reach"):
        ledger.truncate(c.where("seq < 3"), marks, "branch", "seq").collect()


def test_coverage(spark):
    s = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 2), (1, 2, 2)], "branch bigint, seq bigint, step bigint")
    r = {x.branch: x for x in ledger.coverage(s, "branch", "step").collect()}
    assert r[0].exactly_once and r[0].monotonic and not r[1].exactly_once and r[1].missing == 1 and r[1].duplicates == 1


def test_series(spark):
    d = spark.createDataFrame([(0, k, 10.0 if k == 30 else 1.0 + 0.01 * (k % 3)) for k in range(40)], "user_id bigint, step bigint, value double")
    assert [r.step for r in series.spikes(d, "user_id", "step", "value").collect()] == [30]
    z = {r.step: r.z for r in series.robust_z(d, "user_id", "step", "value").collect()}
    assert z[30] > 50 and z[10] == 0
    assert [r.step for r in series.refractory(d.where("step IN (1, 2, 9, 10, 20)"), "user_id", "step", 8).orderBy("step").collect()] == [1, 9, 20]
    n = series.next_at_or_after(d.where("step IN (5, 31)").select("user_id", "step"), d.where("step = 30").select("user_id", "step"), "user_id", "step")
    assert {r.step: r.next for r in n.collect()} == {5: 30, 31: None}


@settings(max_examples=50)
@given(st.lists(st.sampled_from(["aaab", "ab ab", " b", "é", "aaaa"]), min_size=1, max_size=6))
def test_bpe_word_roundtrip(parts):
    merges = [(97, 97), (97, 98), (256, 257)]
    ranks = {p: k for k, p in enumerate(merges)}
    known = tokens.token_bytes(merges)
    for w in parts:
        assert b"".join(known[i] for i in tokens.encode_word(w, ranks)) == w.encode()


def test_bpe_training_and_models(spark):
    d = docs(spark, ["low low low lower lowest", "new newer", "", None, "  ఒక తో  "])
    merges = tokens.train(tokens.word_counts(d), 12)
    assert tokens.token_bytes(merges)[256] in (b"lo", b"ow")
    back = tokens.decode(tokens.encode(d.na.fill(""), merges), merges)
    assert one(back, "text") == ["low low low lower lowest", "new newer", "", "", "  ఒక తో  "]
    assert tokens.load_model(tokens.save_model(merges)) == merges
    assert tokens.combine([merges, merges]) == merges
    assert tokens.smallest_budget(lambda n: 100 - n, 40, 200) == 60
    assert tokens.water_fill(lambda given: min("ab", key=lambda x: (given.get(x, 0), x)), 60) == {"a": 35, "b": 25}


def brute_bpe(texts, merges):
    words = Counter(w for t in texts for w in re.findall(tokens.PRE_TOKEN, t or ""))
    seqs, known, out = [(list(w.encode()), n) for w, n in words.items()], tokens.token_bytes([]), []
    for new in range(256, 256 + merges):
        counts = Counter()
        for s, n in seqs:
            for p in zip(s, s[1:]):
                counts[p] += n
        if not counts:
            break
        out.append(max(counts, key=lambda p: (counts[p], known[p[0]] + known[p[1]], -p[0], -p[1])))
        known.append(known[out[-1][0]] + known[out[-1][1]])
        seqs = [(tokens.merge_step(s, out[-1], new), n) for s, n in seqs]
    return out


def test_bpe_training_uses_all_words(spark):
    # 50,000 words that stand twice and hold no q; 40,000 that stand once, all with qj
    rare = spark.range(40_000).selectExpr("concat('qjqj', id) AS word", "1L AS n")
    often = spark.range(50_000).selectExpr("concat('z', id) AS word", "2L AS n")
    merges = tokens.train(often.union(rare), 1)
    assert tokens.token_bytes(merges)[256] == b"qj"
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aab") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(30)] + ["aaaaaaa é  aa", "", None]
    assert tokens.train(tokens.word_counts(docs(spark, texts)), 25) == brute_bpe(texts, 25)
    assert tokens.train(tokens.word_counts(docs(spark, ["a", ""])), 3) == []


def test_sources(spark):
    d = spark.createDataFrame([(1, "é", None), (2, "b", 2.5)], "k bigint, s string, x double")
    path = scratch(spark, "lines")
    tables.write_jsonl(d, path, gzip=True)
    assert tables.read_jsonl(spark, path, d.schema).orderBy("k").collect() == d.orderBy("k").collect()
    spec, sha = tables.load_config('{"a": 1}')
    assert spec == {"a": 1} and len(sha) == 64
    b = spark.createDataFrame([("s", k, 10) for k in range(5)], "shard string, k bigint, n bigint")
    assert tables.budgeted(b, "shard", "k", "n", 25).count() == 3


def test_streams(spark):
    d = spark.createDataFrame([(k % 3, f"2024-01-01 0{k // 20}:{k % 20 * 3:02d}:00", float(k)) for k in range(100)], "user_id bigint, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark, "events")
    d.repartition(4).write.parquet(path)
    s = windows.read_ledger(spark, path, d.schema, 1)
    batch = {r["window"].start: r.n for r in windows.tumbling(d, "1 hour").collect()}
    stream = {r["window"].start: r.n for r in windows.drain(windows.tumbling(s, "1 hour", "1 day"), "hours", "complete").collect()}
    assert stream == batch and sum(batch.values()) == 100
    sink = scratch(spark, "sink")
    q = s.writeStream.foreachBatch(windows.once_per_batch(sink)).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == 100
    last = windows.drain(windows.drift(s), "drift", "update").groupBy("key").agg(F.max("n").alias("n")).collect()
    assert sum(r.n for r in last) == 100


def test_bisection():
    assert largest_that_fits(lambda n: n <= 37) == 37 and largest_that_fits(lambda n: False) == 0


def test_text_functions(spark):
    d = docs(spark, ["", "a  b\tc", None])
    assert one(d, T.n_words("text")) == [0, 3, -1] or one(d, T.n_words("text")) == [0, 3, None]
    assert one(d, T.symbol_ratio("text", "selector"))[0] == 1.0
    assert math.isclose(one(d, T.mean_word_length("text"))[1], 1.0)


def test_windows_broadcast_and_join_agree(spark, monkeypatch):
    from corpusmill.operators import windows

    words = [f"w{k}" for k in range(60)]
    b = spark.createDataFrame([(1, " ".join(words[:30])), (2, None), (3, "")], "item_id bigint, text string")
    texts = ["x y " + " ".join(words[3:25]) + " z", " ".join(words[40:]), None, "", " ".join(words[:11]), " ".join(words[:12]), "\t" + "  ".join(words[5:20]) + "\n" + " ".join(words[5:19])]
    d = docs(spark, texts)
    brute = {}
    known = {tuple(words[k : k + 12]) for k in range(19)}
    for i, t in enumerate(texts):
        w = (t or "").split()
        flags = [tuple(w[k : k + 12]) in known for k in range(len(w) - 11)]
        if flags:
            brute[i] = (len(flags), sum(flags), max(map(len, "".join("x" if f else " " for f in flags).split()), default=0))
    got = lambda: {r.doc_id: (r.windows, r.hits, r.run) for r in windows.overlaps(d, b, 12).collect()}
    ids = [r.doc_id for r in d.collect()]
    want = {ids[i]: v for i, v in brute.items()}
    assert got() == want
    monkeypatch.setattr(windows, "BROADCAST_BYTES", 0)
    assert got() == want


def test_ranked_places(spark):
    from corpusmill.operators.order import ranked

    rows = [("a" if k % 3 else None, f"{(k * 7919) % 1000:03d}") for k in range(500)]
    got = {(r.g, r.v): r.place for r in ranked(spark.createDataFrame(rows, "g string, v string").repartition(7), ["g"], ["v"]).collect()}
    for g in ("a", None):
        own = sorted(v for x, v in rows if x == g)
        assert [got[g, v] for v in own] == list(range(len(own)))
    assert sorted(r.place for r in ranked(spark.createDataFrame(rows, "g string, v string"), [], ["v"]).collect()) == list(range(500))
    assert ranked(spark.createDataFrame([], "g string, v string"), ["g"], ["v"]).count() == 0


def test_fits_with_all_bins_open():
    rng = random.Random(5)
    for best in (True, False):
        for _ in range(30):
            costs = [rng.randint(1, 40) for _ in range(rng.randint(0, 120))]
            used, want = [], []
            for c in costs:
                open_ = [b for b, u in enumerate(used) if u + c <= 40]
                pick = (max(open_, key=lambda b: (used[b], -b)) if best else open_[0]) if open_ else len(used)
                if pick == len(used):
                    used.append(0)
                used[pick] += c
                want.append(pick)
            assert shards.fit(costs, 40, best) == want


def test_lru_and_frozen_files(spark, tmp_path):
    from corpusmill.sources import tables as src

    assert shards.lru([1, 2, 1, 3, 2, 1], 2) == [False, False, True, False, False, False]
    d = spark.createDataFrame([(1, "a"), (2, "b\nc")], "k bigint, t string")
    one = src.file_hashes(spark, src.write_files(d, "k", "t", str(tmp_path / "x")))
    two = src.file_hashes(spark, src.write_files(d.where("k = 1"), "k", "t", str(tmp_path / "y")))
    src.frozen_or_raise(one, one)
    with pytest.raises(ValueError, match="2"):
        src.frozen_or_raise(one, two)
