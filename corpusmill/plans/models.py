"""Queries for merge lists of several languages, model files, budgets, specifications, previews and reports."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import tokens as K
from ..registry import query
from ..session import materialize, scratch
from ..sources import tables as src
from .cleaning import docs
from .numeric import largest_that_fits
from .tokens import MASKED, WORDS, batch

PAIRS = "h AS (SELECT {0}hex(encode(word)) AS h, n FROM wc), p AS (SELECT {0}unnest(list_transform(range(0, length(h) // 2 - 1), lambda i: substr(h, 2 * i + 1, 4))) AS p, n FROM h WHERE length(h) >= 4), t AS (SELECT {0}p, sum(n) AS n FROM p GROUP BY ALL)"
BY_LANG = WORDS.replace("SELECT word, count(*)", "SELECT lang, word, count(*)").replace("SELECT unnest", "SELECT lang, unnest").replace("GROUP BY word", "GROUP BY lang, word")


@query(f"WITH {BY_LANG}, {PAIRS.format('lang, ')}, top AS (SELECT lang, p FROM t QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, p DESC) = 1), f AS (SELECT p, min(lang) AS lang FROM top GROUP BY p) SELECT row_number() OVER (ORDER BY lang) - 1 AS rank, lower(p) AS bytes FROM f")
def combined_merges(spark, sf_dir):
    """K5: the first merge of every language, one after the other by language; merged bytes that are there already are skipped."""
    d = docs(spark, sf_dir)
    langs = [r.lang for r in d.select("lang").distinct().orderBy("lang").collect()]
    merges = K.combine([K.train(K.word_counts(d.where(F.col("lang") == x)), 1) for x in langs])
    known = K.token_bytes(merges)
    return spark.createDataFrame([(k, known[256 + k].hex()) for k in range(len(merges))], "rank bigint, bytes string")


@query(f"WITH {WORDS}, r AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS k, sum(n) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING) AS covered, sum(n) OVER () AS total FROM wc) SELECT CAST(coalesce(min(k) FILTER (10 * (total - covered) <= 3 * total), 0) AS BIGINT) AS words FROM r")
def vocab_budget(spark, sf_dir):
    """K9: the fewest of the commonest words that leave at most three tenths of the tokens uncovered, by bisection over a
    monotone cost. A prefix's cost depends on how many words have each count, a table of few rows, so words aren't ranked."""
    h = K.word_counts(docs(spark, sf_dir)).groupBy("n").agg(F.count("*").alias("words"))
    before = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(x).over(before), F.lit(0)).alias(y) for x, y in ((F.col("words"), "words_before"), (F.col("n") * F.col("words"), "tokens_before"))]
    steps = materialize(h.select("n", "words", *sums), "budget-steps")
    all_ = steps.agg(F.sum("words").alias("words"), F.sum(F.col("n") * F.col("words")).alias("tokens")).first()

    def uncovered(k: int) -> int:
        own = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(k) - F.col("words_before")))
        return 10 * (all_.tokens - steps.agg(F.sum(own * F.col("n"))).first()[0])

    best = K.smallest_budget(uncovered, 3 * all_.tokens, all_.words) if all_.words else 0
    return spark.createDataFrame([(best,)], "words bigint")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT lang, j FROM (SELECT lang, n, unnest(range(0, 24)) AS j FROM c) ORDER BY n + 25 * j, lang LIMIT 24) SELECT lang, CAST(25 * count(*) AS BIGINT) AS given FROM s GROUP BY lang")
def budget_water_fill(spark, sf_dir):
    """600 documents dealt out in steps of 25, each to the language that has the fewest by then."""
    have = {r.lang: r.n for r in docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    given = K.water_fill(lambda g: min(have, key=lambda x: (have[x] + g.get(x, 0), x)), 600) if have else {}
    return spark.createDataFrame(list(given.items()), "lang string, given bigint")


@query(f"WITH {WORDS}, {PAIRS.format('')} SELECT range AS id, lower(printf('%02x', range)) AS bytes FROM range(256) UNION ALL (SELECT 256, lower(p) FROM t ORDER BY n DESC, p DESC LIMIT 1)")
def bpe_model_file(spark, sf_dir):
    """A model of one merge saved as a text file, loaded from it, and the listing of its vocabulary."""
    path = scratch(spark, "bpe-model")
    merges = K.train(K.word_counts(docs(spark, sf_dir)), 1)
    spark.createDataFrame([(K.save_model(merges),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="part-*").first().value
    listing = K.token_bytes(K.load_model(raw.rstrip("\n") + "\n"))
    return spark.createDataFrame([(k, b.hex()) for k, b in enumerate(listing)], "id bigint, bytes string")


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), s AS (SELECT '{' || string_agg('\"' || source || '\":' || n, ',' ORDER BY source) || '}' AS raw FROM c) SELECT source, CAST(n AS BIGINT) AS docs, sha256(raw) AS spec FROM c, s")
def spec_rows(spark, sf_dir):
    """A specification as a canonical file, read back with the hash of its bytes, as rows."""
    counts = {r.source: r.n for r in docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).collect()}
    path = scratch(spark, "spec")
    spark.createDataFrame([(json.dumps(counts, sort_keys=True, separators=(",", ":"), ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    spec, sha = src.load_config(spark.read.text(path).first().value)
    return spark.createDataFrame([(k, n, sha) for k, n in spec.items()], "source string, docs bigint, spec string")


@query("SELECT lang, CAST(1000000 // max(n_chars) AS BIGINT) AS batch FROM documents GROUP BY lang HAVING max(n_chars) > 0")
def largest_batches(spark, sf_dir):
    """By language, the largest batch of padded documents within a million characters: doubling, then bisection."""
    widest = docs(spark, sf_dir).groupBy("lang").agg(F.max("n_chars").alias("m")).where("m > 0").collect()
    return spark.createDataFrame([(r.lang, largest_that_fits(lambda k, m=r.m: k * m <= 1_000_000)) for r in widest], "lang string, batch bigint")


@query(f"WITH {MASKED} SELECT CAST(pos AS BIGINT) AS pos, round(sum(target * 0.25) FILTER (tdoc = doc_id) / count(*) FILTER (tdoc = doc_id), 6) AS loss FROM m GROUP BY pos HAVING count(*) FILTER (tdoc = doc_id) > 0")
def position_losses(spark, sf_dir):
    """Masked means of given losses by position in the row."""
    m = K.shifted(batch(spark, sf_dir), 1).withColumn("loss", F.when(K.loss_mask(), F.col("target") * 0.25))
    return m.groupBy("pos").agg(F.round(F.avg("loss"), 6).alias("loss")).where("loss IS NOT NULL")


@query(r"SELECT doc_id, left(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(9), '\t'), 40) AS preview FROM documents")
def previews(spark, sf_dir):
    """The first 40 characters of texts with escapes for display; bytes are decoded with replacement."""
    shown = F.expr(r"make_valid_utf8(cast(encode(text, 'utf-8') as string))")
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t")):
        shown = F.replace(shown, F.lit(a), F.lit(b))
    return docs(spark, sf_dir).select("doc_id", F.substring(shown, 1, 40).alias("preview"))


@query("WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents) (SELECT 'validation' AS asked, split, doc_id FROM s WHERE split = 'validation' ORDER BY doc_id LIMIT 50) UNION ALL (SELECT 'test', split, doc_id FROM s WHERE split = 'train' ORDER BY doc_id LIMIT 50 OFFSET 100)")
def split_fallback(spark, sf_dir):
    """A2: fifty rows of a split; for one that is missing, those from row 100 on of the training split."""
    s = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    out = None
    for asked in ("validation", "test"):
        own = s.where(F.col("split") == asked)
        rows = own.orderBy("doc_id").limit(50) if own.take(1) else s.where("split = 'train'").orderBy("doc_id").offset(100).limit(50)
        rows = rows.select(F.lit(asked).alias("asked"), "split", "doc_id")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT '| source | documents |' AS line UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || source || ' | ' || count(*) || ' |' FROM documents GROUP BY source")
def report_lines(spark, sf_dir):
    """A report table written as Markdown, and its lines read back."""
    path = scratch(spark, "report")
    rows = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).select(F.format_string("| %s | %d |", "source", "n").alias("line"))
    head = spark.createDataFrame([("| source | documents |",), ("|-|-|",)], "line string")
    head.union(rows.orderBy("line")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH u AS (SELECT range AS step, {S.keyed_unit('stream', 'range')} AS u FROM range(500)) SELECT CAST(step AS BIGINT) AS step, CASE step % 3 WHEN 0 THEN 'padded' WHEN 1 THEN 'bucketed' ELSE 'packed' END AS maker, CAST(floor(u * 1000) AS BIGINT) AS start FROM u")
def seeded_batches(spark, sf_dir):
    """Q11: the first 500 steps of an endless keyed stream: each step's batch maker by its place in the registry, and its start."""
    makers = F.array(*map(F.lit, ("padded", "bucketed", "packed")))
    u = spark.range(500).withColumn("u", T.keyed_unit("stream", F.col("id")))
    return u.select(F.col("id").alias("step"), makers[(F.col("id") % 3).cast("int")].alias("maker"), F.floor(F.col("u") * 1000).cast("long").alias("start"))
