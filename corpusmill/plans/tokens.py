"""Queries for sources and sinks, token streams, tokenizers, and batch shaping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import shards
from ..operators import tokens as K
from ..operators.order import ranked
from ..registry import query
from ..session import scratch, table
from ..sources import tables as src
from .cleaning import DIRTY, dirty, docs

N = S.n_words()


@query(f"WITH d AS (SELECT doc_id, source, {N} AS words FROM documents), b AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d), k AS (SELECT * FROM b WHERE before < 5000), t AS (SELECT source, coalesce(sum(sum(words)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM k GROUP BY source) SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(words) AS BIGINT) AS words FROM k JOIN t USING (source) WHERE base + before < 60000 GROUP BY source")
def corpus_budget_scan(spark, sf_dir):
    """A1: words by source within budgets of each source and of all; the crossing row is kept."""
    d = docs(spark, sf_dir).select("doc_id", "source", T.n_words("text").alias("words"))
    return src.budgeted(d, "source", "doc_id", "words", 5000, 60000).groupBy("source").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def jsonl_roundtrip(spark, sf_dir):
    """A3: JSON lines written and read again."""
    path = scratch(spark, "jsonl")
    src.write_jsonl(docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), path)
    return src.read_jsonl(spark, path, "doc_id bigint, lang string, source string, n_chars bigint")


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}' AS json FROM documents")
def canonical_json(spark, sf_dir):
    """A4: sorted keys, no spaces."""
    d = docs(spark, sf_dir).select("source", "n_chars", "lang", "doc_id")
    return d.select("doc_id", src.canonical_json(d).alias("json"))


@query("SELECT lane, dataset, tokens_b, samples_m, overlap_frac, keep_frac FROM (VALUES ('en', 'a', 10.5, 2.0, 0.1, 1.0), ('de', 'b, c', 3.0, NULL, 0.0, 0.5)) AS t(lane, dataset, tokens_b, samples_m, overlap_frac, keep_frac)")
def inventory_scan(spark, sf_dir):
    """A5: a CSV inventory written and scanned; blanks become null or defaults."""
    path = scratch(spark, "inventory")
    rows = [("en", "a", "10.5", "2.0", "cc-by", "A", "0.1", "", "high", ""), ("de", "b, c", "3", "", "odc", "B", "", "0.5", "low", "two, kinds")]
    names = [f.split()[0] for f in src.INVENTORY.split(", ")]
    spark.createDataFrame(rows, names).write.csv(path, header=True, emptyValue="")
    return src.read_inventory(spark, path).select("lane", "dataset", "tokens_b", "samples_m", "overlap_frac", "keep_frac")


@query(f"WITH w AS (SELECT doc_id, list_transform({S.words()}, lambda x: length(x) + 2) AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t[3:6], ',') AS span FROM w")
def token_blob_spans(spark, sf_dir):
    """Tokens as arrays, and random access to [2, 6) of each."""
    t = docs(spark, sf_dir).select("doc_id", shards.token_ids().alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(src.read_span(F.col("t"), F.lit(2), F.lit(6)).cast("array<string>"), ",").alias("span"))


@query("SELECT source AS shard_id, CAST(count(*) AS BIGINT) AS docs FROM documents GROUP BY source")
def manifest_scan(spark, sf_dir):
    """Manifests written as JSON and scanned from their folder."""
    path = scratch(spark, "manifests")
    docs(spark, sf_dir).groupBy(F.col("source").alias("shard_id")).agg(F.count("*").alias("docs")).write.json(path)
    return spark.read.schema("shard_id string, docs bigint").json(path)


@query("WITH d AS (SELECT * FROM documents WHERE length(text) >= 200), b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS digest FROM b WHERE before < 20000 GROUP BY lang")
def slice_char_budget(spark, sf_dir):
    """A10: a slice of at least 200-character texts within a budget of characters by language, with its digest."""
    d = docs(spark, sf_dir).where(F.length("text") >= 200).withColumn("chars", F.length("text"))
    k = src.budgeted(d, "lang", "doc_id", "chars", 20000)
    digest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ",")
    return k.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sha2(digest, 256).alias("digest"))


@query("SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '\\n{2,}', chr(10), 'g')) AS BIGINT) AS removed FROM documents")
def blank_line_collapse(spark, sf_dir):
    """A11's text step."""
    return docs(spark, sf_dir).select("doc_id", (F.length("text") - F.length(F.regexp_replace("text", "\\n{2,}", "\n"))).cast("long").alias("removed"))


STREAM = f"""s AS (SELECT doc_id, doc_id % 10 = 0 AS val, {N} + 1 AS n FROM documents), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY val ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)"""


@query(f"WITH {STREAM} SELECT doc_id, val, CAST(least(n, 50000 - before) AS BIGINT) AS tokens FROM c WHERE before < 50000")
def token_stream_split(spark, sf_dir):
    """Train and validation streams with an end token after each document, stopped and cut at a target."""
    s = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 10 == 0).alias("val"), (T.n_words("text") + 1).alias("n"))
    w = W.partitionBy("val").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    return s.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("before < 50000").select("doc_id", "val", F.least(F.col("n"), 50000 - F.col("before")).alias("tokens"))


TAIL = f"""t AS (SELECT lang, doc_id, {N} AS n FROM documents), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY lang) AS total FROM t), h AS (SELECT *, CAST(greatest(floor(total * 0.02), 64) AS BIGINT) AS hold FROM o)"""


def tails(spark, sf_dir) -> DataFrame:
    t = docs(spark, sf_dir).select("lang", "doc_id", "text", T.n_words("text").alias("n"))
    w = W.partitionBy("lang").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(t.groupBy("lang").agg(F.sum("n").alias("total")), "lang")
    return t.withColumn("hold", F.greatest(F.floor(F.col("total") * 0.02), F.lit(64)).cast("long"))


@query(f"WITH {TAIL} SELECT lang, CAST(max(total) AS BIGINT) AS total, max(hold) AS hold, CAST(sum(least(n, greatest(0, before + n - (total - hold)))) AS BIGINT) AS held FROM h GROUP BY lang")
def lane_tail_holdout(spark, sf_dir):
    """The last 2 % of a lane's tokens, 64 at least, are held out; documents may be cut."""
    cut = F.least(F.col("n"), F.greatest(F.lit(0), F.col("before") + F.col("n") - (F.col("total") - F.col("hold"))))
    return tails(spark, sf_dir).groupBy("lang").agg(F.max("total").alias("total"), F.max("hold").alias("hold"), F.sum(cut).alias("held"))


@query(f"WITH w AS (SELECT lang, doc_id, unnest({S.words()}) AS word, generate_subscripts({S.words()}, 1) AS pos FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS rn FROM w) SELECT lang, round(avg(octet_length(encode(word))), 6) AS bytes_per_token FROM r WHERE rn <= 20000 GROUP BY lang")
def mean_bytes_per_token(spark, sf_dir):
    """Mean bytes of a lane's first 20,000 tokens."""
    t = tails(spark, sf_dir).where("before < 20000").select("lang", "before", F.posexplode(T.words("text")).alias("pos", "word"))
    return t.where("before + pos < 20000").groupBy("lang").agg(F.round(F.avg(F.octet_length("word")), 6).alias("bytes_per_token"))


@query("SELECT CASE WHEN value > 100 THEN 'FAIL' WHEN value > 10 THEN 'PASS' ELSE 'INFO' END AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def event_log_counts(spark, sf_dir):
    """An event log's counts by status."""
    status = F.when(F.col("value") > 100, "FAIL").when(F.col("value") > 10, "PASS").otherwise("INFO")
    return table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def run_log_by_type(spark, sf_dir):
    """A run log's records of one type."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "value")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents")
def split_loader(spark, sf_dir):
    """Q24: splits united."""
    d = docs(spark, sf_dir).select("doc_id", "lang")
    e = F.col("doc_id") % 10 == 0
    return d.where(~e).withColumn("split", F.lit("train")).unionByName(d.where(e).withColumn("split", F.lit("eval")))


PRE = K.PRE_TOKEN.replace("'", "''")
WORDS = f"wc AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{PRE}')) AS word FROM documents) GROUP BY word)"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{PRE}')) AS BIGINT) AS n, array_to_string(regexp_extract_all(text, '{PRE}'), '') = text AS lossless FROM documents")
def pre_tokens(spark, sf_dir):
    """K1: pieces that join to the text again."""
    return docs(spark, sf_dir).select("doc_id", F.size(K.pre_tokens()).cast("long").alias("n"), (F.array_join(K.pre_tokens(), "") == F.col("text")).alias("lossless"))


@query(f"WITH {WORDS} SELECT word, CAST(n AS BIGINT) AS n FROM wc")
def word_frequencies(spark, sf_dir):
    """K2."""
    return K.word_counts(docs(spark, sf_dir))


@query(f"WITH {WORDS}, h AS (SELECT hex(encode(word)) AS h, n FROM wc), p AS (SELECT unnest(list_transform(range(0, length(h) // 2 - 1), lambda i: substr(h, 2 * i + 1, 4))) AS p, n FROM h WHERE length(h) >= 4) SELECT substr(p, 1, 2) AS a, substr(p, 3, 2) AS b, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL")
def byte_pair_counts(spark, sf_dir):
    """K3."""
    return K.pair_counts(K.word_counts(docs(spark, sf_dir)))


@query()
def bpe_merges(spark, sf_dir):
    """K4: the first merges learned from the word table."""
    merges = K.train(K.word_counts(docs(spark, sf_dir)), 40)
    known = K.token_bytes(merges)
    return spark.createDataFrame([(k, a, b, known[256 + k].hex()) for k, (a, b) in enumerate(merges)], "rank bigint, a bigint, b bigint, bytes string")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def bpe_roundtrip(spark, sf_dir):
    """K6, K7: decode(encode(text)) is the text, for a tokenizer trained here."""
    d = docs(spark, sf_dir)
    merges = K.train(K.word_counts(d), 40)
    return K.decode(K.encode(d, merges), merges).select("doc_id", F.sha2("text", 256).alias("sha"))


@query()
def bpe_fertility(spark, sf_dir):
    """K8: tokens per word by language, and the spread over languages."""
    d = docs(spark, sf_dir)
    coded = K.encode(d, K.train(K.word_counts(d), 40)).join(d, "doc_id")
    f = coded.groupBy("lang").agg((F.sum(F.size("ids")) / F.sum(T.n_words("text"))).alias("fertility"))
    all_ = F.max("fertility").over(W.partitionBy()) - F.min("fertility").over(W.partitionBy())
    return f.select("lang", F.round("fertility", 6).alias("fertility"), F.round(1000 / F.greatest(all_, F.lit(1e-9)), 3).alias("score"))


CODE = 6
CODES = f"v AS (SELECT DISTINCT unnest({S.words()}) AS word FROM dirty), c AS (SELECT word, substr(hex(encode(word)), 1, {2 * CODE}) AS code, octet_length(encode(word)) AS bytes, CASE WHEN length(regexp_replace(word, '[\\x00-\\x7F]', '', 'g')) = 0 THEN 'ASCII' ELSE 'wide' END AS script FROM v)"


def codes(spark, sf_dir) -> DataFrame:
    v = dirty(spark, sf_dir).select(F.explode(T.words("text")).alias("word")).distinct()
    wide = F.length(F.regexp_replace("word", "[\\x00-\\x7F]", "")) > 0
    return v.select("word", F.substring(F.hex(F.encode("word", "utf-8")), 1, 2 * CODE).alias("code"), F.octet_length("word").alias("bytes"), F.when(wide, "wide").otherwise("ASCII").alias("script"))


@query(f"WITH {DIRTY}, {CODES} SELECT word, code, CAST(bytes AS BIGINT) AS bytes, length(code) < 2 * bytes AS truncated FROM c")
def byte_codes(spark, sf_dir):
    """Byte prefixes of words as codes; a code decodes to the word unless it is cut."""
    return codes(spark, sf_dir).select("word", "code", F.col("bytes").cast("long").alias("bytes"), (F.length("code") < 2 * F.col("bytes")).alias("truncated"))


@query(f"WITH {DIRTY}, {CODES}, g AS (SELECT code, count(*) AS k FROM c GROUP BY code) SELECT script, CAST(count(*) AS BIGINT) AS tokens, CAST(count(*) FILTER (k > 1) AS BIGINT) AS colliding, round(avg(bytes), 6) AS mean_bytes, round(quantile_cont(bytes, 0.99), 6) AS p99_bytes FROM c JOIN g USING (code) GROUP BY script")
def injectivity_audit(spark, sf_dir):
    """Colliding codes by script at the vocabulary's scale."""
    c = codes(spark, sf_dir)
    g = c.groupBy("code").agg(F.count("*").alias("k"))
    return c.join(g, "code").groupBy("script").agg(F.count("*").alias("tokens"), F.count_if(F.col("k") > 1).alias("colliding"), F.round(F.avg("bytes"), 6).alias("mean_bytes"), F.round(F.percentile("bytes", 0.99), 6).alias("p99_bytes"))


@query(f"WITH v AS (SELECT DISTINCT unnest({S.words()}) AS word FROM documents) SELECT word FROM v ORDER BY {S.keyed_hex('harvest', 'word')} LIMIT 500")
def word_harvest(spark, sf_dir):
    """500 distinct words in keyed order (a sampling operator)."""
    v = docs(spark, sf_dir).select(F.explode(T.words("text")).alias("word")).distinct()
    return v.orderBy(T.keyed_hex("harvest", F.col("word"))).limit(500)


@query("SELECT arm, v AS vocab, CAST(CASE arm WHEN 'dense' THEN v * 256 * 2 WHEN 'tied' THEN v * 256 ELSE 256 * 256 + v * 8 END AS BIGINT) AS params FROM (VALUES ('dense'), ('tied'), ('coded')) AS a(arm), (SELECT unnest([8192, 32768, 131072]) AS v)")
def vocab_sweep(spark, sf_dir):
    """Parameters by arm and vocabulary size."""
    a = spark.createDataFrame([("dense",), ("tied",), ("coded",)], "arm string").select("arm", F.explode(F.array(*map(F.lit, (8192, 32768, 131072)))).alias("vocab"))
    v = F.col("vocab").cast("long")
    return a.select("arm", "vocab", F.when(F.col("arm") == "dense", v * 512).when(F.col("arm") == "tied", v * 256).otherwise(256 * 256 + v * 8).alias("params"))


BATCH = f"""w AS (SELECT doc_id, unnest({S.words()}) AS word, generate_subscripts({S.words()}, 1) AS p FROM documents), g AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY w.doc_id, p) - 1 AS ord, w.doc_id, length(word) AS token FROM w JOIN documents USING (doc_id)),
    b AS (SELECT source || '/' || CAST(ord // 32 AS BIGINT) AS row, ord % 32 AS pos, token, true AS valid, doc_id FROM g)"""


def batch(spark, sf_dir) -> DataFrame:
    """(row, pos, token, valid, doc_id): rows of 32 tokens from each source's documents end to end."""
    w = docs(spark, sf_dir).select("source", "doc_id", F.posexplode(T.words("text")).alias("p", "word"))
    at = F.row_number().over(W.partitionBy("source").orderBy("doc_id", "p")) - 1
    g = w.withColumn("at", at)
    return g.select(F.concat_ws("/", "source", F.floor(F.col("at") / 32)).alias("row"), (F.col("at") % 32).cast("long").alias("pos"), F.length("word").cast("long").alias("token"), F.lit(True).alias("valid"), "doc_id")


@query(f"WITH {BATCH}, s AS (SELECT o, row, pos, token, CASE o WHEN 1 THEN lead(token, 1) OVER r WHEN 2 THEN lead(token, 2) OVER r WHEN 0 THEN token ELSE lag(token, 1) OVER r END AS target FROM b, (SELECT unnest([1, 2, 0, -1]) AS o) WINDOW r AS (PARTITION BY o, row ORDER BY pos)) SELECT CAST(o AS BIGINT) AS offset_, CAST(count(target) AS BIGINT) AS pairs, CAST(sum(CASE WHEN token = target THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM s GROUP BY o")
def shift_alignment(spark, sf_dir):
    """Targets at four offsets, and how often they repeat the input."""
    b = batch(spark, sf_dir)
    out = None
    for o in (1, 2, 0, -1):
        one = K.shifted(b, o).agg(F.lit(o).cast("long").alias("offset_"), F.count("target").alias("pairs"), F.count_if(F.col("token") == F.col("target")).alias("copies"))
        out = one if out is None else out.union(one)
    return out


MASKED = f"{BATCH}, m AS (SELECT row, pos, token, doc_id, lead(token) OVER r AS target, lead(doc_id) OVER r AS tdoc FROM b WINDOW r AS (PARTITION BY row ORDER BY pos))"


@query(f"WITH {MASKED} SELECT row, CAST(count(*) AS BIGINT) AS length, CAST(count(target) AS BIGINT) AS pairs, CAST(count(*) FILTER (target IS NOT NULL AND tdoc = doc_id) AS BIGINT) AS within, CAST(count(*) FILTER (target IS NOT NULL AND tdoc <> doc_id) AS BIGINT) AS crossing FROM m GROUP BY row")
def loss_masks(spark, sf_dir):
    """Pairs that count, and those that cross a border of documents, by row."""
    m = K.shifted(batch(spark, sf_dir), 1)
    pair = F.col("target").isNotNull()
    return m.groupBy("row").agg(F.count("*").alias("length"), F.count("target").alias("pairs"), F.count_if(pair & K.loss_mask()).alias("within"), F.count_if(pair & ~K.loss_mask()).alias("crossing"))


@query(f"WITH {MASKED}, x AS (SELECT target * 0.25 AS loss, tdoc = doc_id AS ok FROM m WHERE target IS NOT NULL) SELECT round(sum(loss) FILTER (ok) / count(*) FILTER (ok), 6) AS masked_mean, round(sum(loss) FILTER (ok) / count(*), 6) AS wrong_denominator FROM x")
def masked_means(spark, sf_dir):
    """Sums divided once at the end, by the right and the wrong count."""
    m = K.shifted(batch(spark, sf_dir), 1).where("target IS NOT NULL").withColumn("loss", F.col("target") * 0.25).withColumn("ok", K.loss_mask())
    top = F.sum(F.when(F.col("ok"), F.col("loss")))
    return m.agg(F.round(top / F.count_if("ok"), 6).alias("masked_mean"), F.round(top / F.count("*"), 6).alias("wrong_denominator"))


@query()
def batch_shapes(spark, sf_dir):
    """Keyed lengths, log-uniform between 4 and 32, of padded and bucketed rows."""
    rows = batch(spark, sf_dir).groupBy("row").agg(F.count("*").alias("have"))
    n = F.least("have", F.floor(4 * F.pow(F.lit(8.0), T.keyed_unit("len", F.col("row")))))
    rows = rows.withColumn("n", n.cast("long")).withColumn("bucket", F.floor(F.log2("n")).cast("long"))
    widest = F.max("n").over(W.partitionBy("bucket"))
    return rows.select("row", "n", "bucket", (F.lit(32) - F.col("n")).alias("pad_fixed"), (widest - F.col("n")).alias("pad_bucketed"))


ROWS = f"r AS (SELECT DISTINCT row FROM b), o AS (SELECT row, row_number() OVER (ORDER BY {S.keyed_hex('order', 'row')}) - 1 AS ord FROM r)"


@query(f"WITH {BATCH}, {ROWS} SELECT row, CAST(ord // 8 AS BIGINT) AS step, CAST(ord % 8 // 2 AS BIGINT) AS rank, ord // 8 >= 10 AS continued FROM o")
def row_order(spark, sf_dir):
    """Fixed rows in one keyed order, eight a step, two for each of four ranks, and where a continuation begins.

    The order is over row names only, which range partitioning sorts; numbers come from each partition's offset."""
    names = batch(spark, sf_dir).select("row").distinct().withColumn("k", T.keyed_hex("order", F.col("row")))
    o = ranked(names, [], ["k"], "at")
    return o.select("row", F.floor(F.col("at") / 8).alias("step"), F.floor(F.col("at") % 8 / 2).alias("rank"), (F.floor(F.col("at") / 8) >= 10).alias("continued"))


@query(f"WITH u AS (SELECT range AS draw, {S.keyed_unit('mix', 'range')} AS u FROM range(2000)) SELECT CASE WHEN u < 0.15 THEN 'de' WHEN u < 0.75 THEN 'en' WHEN u < 0.85 THEN 'es' ELSE 'fr' END AS lane, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1")
def multinomial_batch(spark, sf_dir):
    """Lanes drawn by keyed numbers and cumulative weights."""
    u = spark.range(2000).withColumn("u", T.keyed_unit("mix", F.col("id")))
    lane = F.when(F.col("u") < 0.15, "de").when(F.col("u") < 0.75, "en").when(F.col("u") < 0.85, "es").otherwise("fr")
    return u.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))


@query()
def window_batches(spark, sf_dir):
    """Q4: keyed windows of eight tokens and the targets one further, of documents with ten words or more."""
    d = docs(spark, sf_dir).select("doc_id", shards.token_ids().alias("t")).where("size(t) >= 10")
    start = F.floor(T.keyed_unit("start", F.col("doc_id")) * (F.size("t") - 8)).cast("int") + 1
    return d.withColumn("s", start).select("doc_id", F.slice("t", F.col("s"), F.lit(8)).alias("x"), F.slice("t", F.col("s") + 1, F.lit(8)).alias("y"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST((doc_id * 7) % octet_length(encode(text)) AS BIGINT) AS start FROM documents WHERE octet_length(encode(text)) > 0")
def byte_corpus(spark, sf_dir):
    """Q18: texts as byte streams with a cyclic cursor."""
    n = F.octet_length("text")
    return docs(spark, sf_dir).where(n > 0).select("doc_id", n.cast("long").alias("n_bytes"), F.pmod(F.col("doc_id") * 7, n).alias("start"))


@query()
def merge_steps(spark, sf_dir):
    """Q2: one merge over lists of ids, from the left, never overlapping."""
    t = docs(spark, sf_dir).select("doc_id", shards.token_ids().alias("ids"))

    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: K.merge_step(list(x), (5, 6), 999))

    merged = F.pandas_udf(run, "array<int>")("ids")
    return t.select("doc_id", F.size("ids").cast("long").alias("before"), F.size(merged).cast("long").alias("after"))


VOCAB = [(0, "Ġthe"), (1, "▁la"), (2, "ing"), (3, "Ċ"), (4, "<s>")]


@query(f"SELECT id, replace(replace(replace(token, 'Ġ', ' '), '▁', ' '), 'Ċ', chr(10)) AS text FROM {S.values(VOCAB, ['id', 'token'])} WHERE token NOT LIKE '<%'")
def vocab_recovery(spark, sf_dir):
    """Q5: token strings of two families back to text, special ones left out, in order of id."""
    v = spark.createDataFrame(VOCAB, "id bigint, token string").where("token NOT LIKE '<%'")
    return v.select("id", F.translate("token", "Ġ▁Ċ", "  \n").alias("text"))


@query(f"WITH {DIRTY}, {CODES} SELECT word, CAST(length(code) // 2 AS BIGINT) AS active, round(sqrt(CAST(length(code) // 2 AS DOUBLE) / {CODE}), 6) AS rms, round(CAST(length(code) // 2 AS DOUBLE) / {CODE}, 6) AS mean FROM c")
def code_moments(spark, sf_dir):
    """Q6: moments of a one-hot code, which depend on the number of active columns only."""
    n = F.length("code") / 2
    return codes(spark, sf_dir).select("word", n.cast("long").alias("active"), F.round(F.sqrt(n / CODE), 6).alias("rms"), F.round(n / CODE, 6).alias("mean"))


@query("WITH c AS (SELECT event_id, hex(encode(event_type)) AS truth, hex(encode(CASE WHEN event_id % 10 = 0 THEN 'x' || substr(event_type, 2) ELSE event_type END)) AS pred FROM events) SELECT round(avg(CASE WHEN substr(truth, 1, 2) = substr(pred, 1, 2) THEN 1.0 ELSE 0.0 END), 6) AS first_column, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS all_columns FROM c")
def recovery_accuracy(spark, sf_dir):
    """Q8: columns recovered, one by one and all together; predictions are data."""
    pred = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), F.expr("substring(event_type, 2)"))).otherwise(F.col("event_type"))
    c = table(spark, sf_dir, "events").select(F.hex(F.encode("event_type", "utf-8")).alias("truth"), F.hex(F.encode(pred, "utf-8")).alias("pred"))
    share = lambda t: F.round(F.avg(F.when(t, 1.0).otherwise(0.0)), 6)
    return c.agg(share(F.substring("truth", 1, 2) == F.substring("pred", 1, 2)).alias("first_column"), share(F.col("truth") == F.col("pred")).alias("all_columns"))


@query("SELECT item_id, sha256(text || chr(10)) AS sha, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS bytes, CASE WHEN item_id % 7 = 0 THEN 'refused' ELSE 'ok' END AS verdict FROM benchmark")
def artifact_hashes(spark, sf_dir):
    """Files with their SHA-256 and size, frozen, and checked again after some were changed: those are refused."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    frozen = src.file_hashes(spark, src.write_files(items, "item_id", "text", scratch(spark, "artifacts")))
    changed = items.withColumn("text", F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    live = src.file_hashes(spark, src.write_files(changed, "item_id", "text", scratch(spark, "artifacts")))
    return src.check_frozen(frozen, live).select(F.col("name").cast("long").alias("item_id"), "sha", "bytes", "verdict")


@query(f"WITH {WORDS}, h AS (SELECT hex(encode(word)) AS h, n FROM wc), p AS (SELECT unnest(list_transform(range(0, length(h) // 2 - 1), lambda i: substr(h, 2 * i + 1, 4))) AS p, n FROM h WHERE length(h) >= 4), t AS (SELECT p, sum(n) AS n FROM p GROUP BY p ORDER BY n DESC, p DESC LIMIT 1) SELECT CAST('0x' || substr(p, 1, 2) AS BIGINT) AS a, CAST('0x' || substr(p, 3, 2) AS BIGINT) AS b FROM t")
def bpe_first_merge(spark, sf_dir):
    """K4: the first merge is the commonest pair of all words, of equal ones that of the larger bytes."""
    return spark.createDataFrame(K.train(K.word_counts(docs(spark, sf_dir)), 1), "a bigint, b bigint")
