"""Queries over documents, pages and conversations: normalisation, markers, quality, language, identifiers, builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as T
from ..operators import clean
from ..registry import query
from ..session import table

q = S.quote
DOCS = "documents"

#: The dirty view in SQL, step by step as inject_dirt().
DIRTY = f"""
d0 AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN d.doc_id % 30 = 0 AND p.text IS NOT NULL THEN p.text || ' (Please double-check).' ELSE d.text END AS text
       FROM documents d LEFT JOIN documents p ON p.doc_id + 1 = d.doc_id),
d1 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 15 = 0 THEN text || ' &amp; check if it is &lt; 100 &gt; &quot;true&quot;' ELSE text END AS text FROM d0),
d2 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 20 = 0 THEN chr(65279) || chr(8203) || text || ' ' || chr(8238) || ' reverse text' ELSE text END AS text FROM d1),
d3 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 25 = 0 THEN text || {q(clean.TELUGU_NOTE)} ELSE text END AS text FROM d2),
d4 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 54 = 0 THEN '[User]: ' || text || chr(10) || '[Assistant]: ok' WHEN doc_id % 54 = 18 THEN '<human>: ' || text || chr(10) || '<bot>: ok'
       WHEN doc_id % 18 = 0 THEN '### Instruction:' || chr(10) || text || chr(10) || '### Response:' || chr(10) || 'ok' ELSE text END AS text FROM d3),
d5 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 22 = 0 THEN text || ' Contact contact' || doc_id || '@ai-school.edu or call +1-555-019-0042.' ELSE text END AS text FROM d4),
d6 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 40 = 0 THEN {q(clean.TELUGU_LEAD)} || text ELSE text END AS text FROM d5),
dirty AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 50 = 0 THEN 'What is the capital of France? ' || text ELSE text END AS text FROM d6)"""

ASIDE = "replace(replace({}, chr(8204), chr(8232)), chr(8205), chr(8233))"
BACK = "replace(replace({}, chr(8232), chr(8204)), chr(8233), chr(8205))"
TRIM = "regexp_replace({}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
PLAIN = "nfc_normalize(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'))"
NORMAL = f"""
n1 AS (SELECT doc_id, {S.count('text', T.ENTITY)} AS n_entities, {PLAIN} AS plain FROM dirty),
n2 AS (SELECT *, regexp_replace({ASIDE.format('plain')}, '{T.UNWANTED}', '', 'g') AS kept FROM n1),
normal AS (SELECT doc_id, n_entities, CAST(length(plain) - length(kept) AS BIGINT) AS n_removed, CAST(len(regexp_extract_all(plain, '[\\x{{200C}}\\x{{200D}}]')) AS BIGINT) AS n_joiners,
       {TRIM.format("regexp_replace(regexp_replace(" + BACK.format('kept') + ", '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM n2)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, DOCS)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.inject_dirt(docs(spark, sf_dir))


@query(f"WITH {DIRTY} SELECT doc_id, text FROM dirty")
def dirty_view(spark, sf_dir):
    """The dirty view itself."""
    return dirty(spark, sf_dir).select("doc_id", "text")


@query(f"WITH {DIRTY}, {NORMAL} SELECT doc_id, n_entities, n_removed, n_joiners, text FROM normal")
def normalized_docs(spark, sf_dir):
    """B1: normal form with its counts, over the dirty view."""
    return clean.normalize(dirty(spark, sf_dir)).select("doc_id", "n_entities", "n_removed", "n_joiners", "text")


@query(
    f"""WITH {DIRTY}, {NORMAL} SELECT CAST(count(*) AS BIGINT) AS docs, CAST(count(*) FILTER (n_entities > 0) AS BIGINT) AS docs_with_entities, CAST(count(*) FILTER (n_removed > 0) AS BIGINT) AS docs_with_ctrl,
    CAST(count(*) FILTER (n_joiners > 0) AS BIGINT) AS docs_with_joiners, CAST(sum(n_entities) AS BIGINT) AS entities, CAST(sum(n_removed) AS BIGINT) AS removed, CAST(sum(n_joiners) AS BIGINT) AS joiners FROM normal"""
)
def normalization_metrics(spark, sf_dir):
    """B2."""
    return clean.normalize(dirty(spark, sf_dir)).agg(
        F.count("*").alias("docs"), F.count_if(F.col("n_entities") > 0).alias("docs_with_entities"), F.count_if(F.col("n_removed") > 0).alias("docs_with_ctrl"),
        F.count_if(F.col("n_joiners") > 0).alias("docs_with_joiners"), F.sum("n_entities").alias("entities"), F.sum("n_removed").alias("removed"), F.sum("n_joiners").alias("joiners"),
    )


@query(f"WITH {DIRTY} SELECT doc_id, regexp_matches(text, '&amp;|&lt;|&gt;|&quot;') AS had_entity, trim(regexp_replace(" + BACK.format("regexp_replace(" + ASIDE.format(PLAIN) + ", '[\\p{Cc}\\x{FEFF}\\x{202E}\\x{200B}]', '', 'g')") + f", '{S.SPACE}', ' ', 'g')) AS text FROM dirty")
def normalized_docs_v1(spark, sf_dir):
    """The first version, newlines removed."""
    return clean.normalize_v1(dirty(spark, sf_dir)).select("doc_id", "had_entity", "text")


@query(f"SELECT page_id, {S.count('html', T.ENTITY)} AS n_entities, {S.count('html', '[\\x00-\\x08\\x0B-\\x1F]')} AS n_control FROM pages")
def html_entity_counts(spark, sf_dir):
    """B1's counts over raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.count("html", T.ENTITY).alias("n_entities"), T.count("html", "[\\x00-\\x08\\x0B-\\x1F]").alias("n_control"))


def marker_sql(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {q(p)}) THEN '{k}' END" for k, p in T.MARKERS.items()) + "], lambda x: x IS NOT NULL)"


def rewrite_sql(c: str) -> str:
    out = c
    for p in T.MARKERS.values():
        out = f"regexp_replace({out}, {q(p)}, ' ', 'g')"
    return f"CASE WHEN len({marker_sql(c)}) > 0 THEN {TRIM.format(f'regexp_replace({out}, {chr(39)}[ \\t]+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} ELSE {c} END"


@query(f"WITH {DIRTY}, k AS (SELECT unnest({marker_sql('text')}) AS kind FROM dirty) SELECT kind, CAST(count(*) AS BIGINT) AS docs FROM k GROUP BY kind")
def ghost_tag_scan(spark, sf_dir):
    """Documents by kind of chat marker."""
    return dirty(spark, sf_dir).select(F.explode(clean.marker_kinds()).alias("kind")).groupBy("kind").agg(F.count("*").alias("docs"))


@query(f"WITH {DIRTY} SELECT doc_id, array_to_string({marker_sql('text')}, ',') AS kinds, {rewrite_sql('text')} AS text FROM dirty")
def ghost_tag_rewrite(spark, sf_dir):
    """Kinds found and the text without them."""
    return dirty(spark, sf_dir).select("doc_id", F.array_join(clean.marker_kinds(), ",").alias("kinds"), clean.remove_markers().alias("text"))


def split_sql(before: str, pattern: str) -> str:
    """One step of the chat split over (doc_id, i, o): the first marker cuts the instruction, the rest goes to the output."""
    trim = lambda x: f"regexp_replace({x}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
    return f"(SELECT doc_id, CASE WHEN m = '' THEN i ELSE {trim('left(i, strpos(i, m) - 1)')} END AS i, CASE WHEN m = '' THEN o ELSE {trim('substr(i, strpos(i, m) + length(m))')} || chr(10) || o END AS o FROM (SELECT doc_id, i, regexp_replace(o, '{pattern}', '', 'g') AS o, regexp_extract(i, '{pattern}') AS m FROM {before}))"


CHAT = f"(SELECT doc_id, {'regexp_replace(' * 3}text, '(?i)^\\[User\\]:[ \\t\\n\\r\\f]*', ''), '(?i)^<human>:[ \\t\\n\\r\\f]*', ''), '(?i)^### Instruction:[ \\t\\n\\r\\f]*', '') AS i, '' AS o FROM dirty)"
for _p in ("(?i)\\[Assistant\\]:[ \\t\\n\\r\\f]*", "(?i)<bot>:[ \\t\\n\\r\\f]*", "(?i)### Response:[ \\t\\n\\r\\f]*"):
    CHAT = split_sql(CHAT, _p)


@query(f"WITH {DIRTY} SELECT doc_id, i AS instruction, o AS output, '<|im_start|>user' || chr(10) || i || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || o || '<|im_end|>' AS text FROM {CHAT}")
def chat_records(spark, sf_dir):
    """Dirty documents as instructions, with markers stripped and assistant parts split out, as canonical chat text."""
    return dirty(spark, sf_dir).select("doc_id", clean.unify_format(F.col("text"), F.lit("")).alias("r")).select("doc_id", "r.*")


@query(
    f"""WITH {DIRTY}, x AS (SELECT doc_id, text AS before, {rewrite_sql('text')} AS after FROM dirty), c AS (SELECT * FROM x WHERE before <> after),
    f AS (SELECT * FROM c ORDER BY doc_id LIMIT 1) SELECT doc_id, CAST(len(list_filter(range(1, least(length(before), length(after)) + 1), lambda i: left(before, i) = left(after, i))) AS BIGINT) AS at,
    substr(before, 1 + CAST(greatest(len(list_filter(range(1, least(length(before), length(after)) + 1), lambda i: left(before, i) = left(after, i))) - 130, 0) AS BIGINT), 390) AS before FROM f"""
)
def before_after_sample(spark, sf_dir):
    """The first changed document, around the first character that differs (130 before, 260 after)."""
    both = dirty(spark, sf_dir).select("doc_id", F.col("text").alias("before"), clean.remove_markers().alias("after")).where("before <> after")
    first = both.orderBy("doc_id").limit(1)
    same = F.filter(F.sequence(F.lit(1), F.least(F.length("before"), F.length("after"))), lambda i: F.substring(F.col("before"), F.lit(1), i) == F.substring(F.col("after"), F.lit(1), i))
    at = F.size(same)
    return first.select("doc_id", at.cast("long").alias("at"), F.substring(F.col("before"), F.greatest(at - 130, F.lit(0)) + 1, F.lit(390)).alias("before"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    h AS (SELECT *, CASE WHEN length(line) < 60 THEN 1 ELSE 0 END AS head FROM l), g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos) AS article FROM h)
    SELECT doc_id, CAST(article AS BIGINT) AS article, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, sha256(string_agg(line, chr(10) ORDER BY pos)) AS sha FROM g GROUP BY doc_id, article"""
)
def article_groups(spark, sf_dir):
    """Lines grouped into articles; a short line begins one."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    article = F.sum((F.length("line") < 60).cast("long")).over(W.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("article", article).groupBy("doc_id", "article").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"), 256).alias("sha")
    )


@query()
def paragraph_chunks(spark, sf_dir):
    """Paragraphs packed greedily into chunks of 200 to 1200 characters, in order, by a fold."""
    fold = F.expr("""
        aggregate(split(text, '\n'), named_struct('done', cast(array() as array<string>), 'open', ''),
            (a, p) -> if(length(a.open) > 0 and length(a.open) + 1 + length(p) > 1200,
                named_struct('done', array_append(a.done, a.open), 'open', p),
                named_struct('done', a.done, 'open', if(a.open = '', p, concat(a.open, '\n', p)))),
            a -> filter(array_append(a.done, a.open), c -> length(c) >= 200))""")
    return docs(spark, sf_dir).select("doc_id", F.posexplode(fold).alias("chunk", "text")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("text").cast("long").alias("n_chars"), "text")


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    g AS (SELECT conv_id, string_agg(CASE WHEN rn % 2 = 1 THEN 'A: ' ELSE 'B: ' END || text, chr(10) ORDER BY turn) AS doc, count(*) AS turns FROM t GROUP BY conv_id)
    SELECT conv_id, CAST(turns AS BIGINT) AS turns, substr(doc, 1, 2000) AS doc FROM g WHERE length(doc) >= 50"""
)
def dialog_docs(spark, sf_dir):
    """Utterances by conversation, speakers in turn, at least 50 characters, cut at 2000."""
    t = table(spark, sf_dir, "conversations")
    who = F.when(F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) % 2 == 1, "A: ").otherwise("B: ")
    said = t.withColumn("said", F.concat(who, "text")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("x"))
    doc = F.array_join(F.transform("x", lambda s: s["said"]), "\n")
    return said.where(F.length(doc) >= 50).select("conv_id", "turns", F.substring(doc, 1, 2000).alias("doc"))


@query("SELECT doc_id, substr('# source: ' || source || chr(10) || '# lang: ' || lang || chr(10) || text, 1, 4000) AS doc FROM documents WHERE length(text) >= 200")
def code_docs(spark, sf_dir):
    """Header lines before the source text, within bounds of length."""
    head = F.concat(F.lit("# source: "), "source", F.lit("\n# lang: "), "lang", F.lit("\n"), "text")
    return docs(spark, sf_dir).where(F.length("text") >= 200).select("doc_id", F.substring(head, 1, 4000).alias("doc"))


@query(
    """SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc_key, CASE WHEN doc_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split, CAST(length(text) AS BIGINT) AS char_len, sha256(text) AS content_hash,
    CASE WHEN doc_id % 10 = 0 THEN 'CANARY-' || upper(substr(sha256('doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0')), 1, 16)) END AS canary, doc_id % 10 = 0 AS never_train FROM documents"""
)
def made_docs(spark, sf_dir):
    """Padded ids, content hashes, and canaries for the evaluation split."""
    key, is_eval = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), F.col("doc_id") % 10 == 0
    return docs(spark, sf_dir).select(
        key.alias("doc_key"), F.when(is_eval, "eval").otherwise("train").alias("split"), F.length("text").cast("long").alias("char_len"), F.sha2("text", 256).alias("content_hash"),
        F.when(is_eval, F.concat(F.lit("CANARY-"), F.upper(F.substring(F.sha2(key, 256), 1, 16)))).alias("canary"), is_eval.alias("never_train"),
    )


@query(f"SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS by_spaces, CAST({S.n_words()} AS BIGINT) AS by_split, substr(text, 1, 500) AS head FROM documents WHERE length(text) >= 100")
def word_counters(spark, sf_dir):
    """Both definitions of a word count, and texts of at least 100 characters cut at 500."""
    return docs(spark, sf_dir).where(F.length("text") >= 100).select("doc_id", T.n_spaces_plus_one("text").alias("by_spaces"), T.n_words("text").alias("by_split"), F.substring("text", 1, 500).alias("head"))


@query(f"WITH {DIRTY} SELECT doc_id, {S.count('text', '[\\x{0C00}-\\x{0C7F}]')} AS telugu, {S.count('text', '[A-Za-z]')} AS latin FROM dirty")
def script_profile(spark, sf_dir):
    """B14."""
    return dirty(spark, sf_dir).select("doc_id", T.telugu("text").alias("telugu"), T.ascii_letters("text").alias("latin"))


@query(
    f"""WITH {DIRTY}, w AS (SELECT DISTINCT unnest({S.words()}) AS word FROM dirty), c AS (SELECT word, {", ".join(f"len(regexp_extract_all(word, '[\\x{{{r[:4]}}}-\\x{{{r[5:]}}}]')) AS n{k}" for k, (_, r) in enumerate(T.SCRIPTS))},
    len(regexp_extract_all(word, '[^\\x00-\\x7F]')) AS wide, len(regexp_extract_all(regexp_replace(word, '[\\x00-\\x7F{"".join(f"\\x{{{r[:4]}}}-\\x{{{r[5:]}}}" for _, r in T.SCRIPTS)}]', '', 'g'), '\\p{{L}}')) AS ext FROM w),
    s AS (SELECT word, CASE WHEN wide = 0 THEN 'ASCII' ELSE list_sort([{", ".join(f"{{'n': -n{k}, 'k': {k}, 's': '{n}'}}" for k, (n, _) in enumerate(T.SCRIPTS))}, {{'n': -ext, 'k': 17, 's': 'Latin-ext'}},
    {{'n': -(wide - ext - {" - ".join(f"n{k}" for k in range(17))}), 'k': 18, 's': 'Other'}}])[1].s END AS script FROM c) SELECT script, CAST(count(*) AS BIGINT) AS words FROM s GROUP BY script"""
)
def script_of_words(spark, sf_dir):
    """Distinct words by dominant script."""
    w = dirty(spark, sf_dir).select(F.explode(T.words("text")).alias("word")).distinct()
    return w.groupBy(T.script_of("word").alias("script")).agg(F.count("*").alias("words"))


@query(f"SELECT doc_id, {', '.join(f'round({S.symbol_ratio(kind=k)}, 6) AS {k}' for k in ('script_aware', 'alnum', 'selector'))} FROM documents")
def symbol_ratio_stats(spark, sf_dir):
    """The variants of a symbol ratio."""
    return docs(spark, sf_dir).select("doc_id", *(F.round(T.symbol_ratio("text", k), 6).alias(k) for k in ("script_aware", "alnum", "selector")))


@query(f"SELECT doc_id, round({S.mean_word_length()}, 6) AS mean_word_length, round({S.dup_line_ratio()}, 6) AS dup_line_ratio, {S.has_any('text', T.STOP_EN)} AS has_stop FROM documents")
def line_word_stats(spark, sf_dir):
    """B17."""
    return docs(spark, sf_dir).select("doc_id", F.round(T.mean_word_length("text"), 6).alias("mean_word_length"), F.round(T.dup_line_ratio("text"), 6).alias("dup_line_ratio"), T.has_any("text", T.STOP_EN).alias("has_stop"))


@query(f"SELECT doc_id, 'doc_' || substr(sha256(text), 1, 16) AS content_id, sha256(lang || '|' || source) AS object_hash, sha256(array_to_string(list_transform({S.words()}, lambda w: CAST(length(w) AS VARCHAR)), ' ')) AS token_hash FROM documents")
def content_ids(spark, sf_dir):
    """Identity from content; hashes of text, fields and tokens."""
    tokens = F.array_join(F.transform(T.words("text"), lambda w: F.length(w).cast("string")), " ")
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha2("text", 256), 1, 16)).alias("content_id"), F.sha2(F.concat_ws("|", "lang", "source"), 256).alias("object_hash"), F.sha2(tokens, 256).alias("token_hash"))


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY {S.keyed_hex('perm', 'doc_id')}) AS BIGINT) AS place, round({S.keyed_unit('unit', 'doc_id')}, 9) AS unit FROM documents")
def keyed_order(spark, sf_dir):
    """Keyed permutation within a source and keyed numbers in [0, 1)."""
    return docs(spark, sf_dir).select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(T.keyed_hex("perm", F.col("doc_id")))).cast("long").alias("place"), F.round(T.keyed_unit("unit", F.col("doc_id")), 9).alias("unit"))


@query(f"WITH {DIRTY} SELECT CAST(count(*) FILTER (contains(text, 'CANARY-')) AS BIGINT) AS canary_docs, CAST(count(*) FILTER (regexp_matches(text, {q(T.VERSION)})) AS BIGINT) AS version_like FROM dirty")
def canary_scan(spark, sf_dir):
    """B21."""
    return dirty(spark, sf_dir).agg(F.count_if(F.col("text").contains("CANARY-")).alias("canary_docs"), F.count_if(F.col("text").rlike(T.VERSION_JAVA)).alias("version_like"))


STOP = sorted({w for ws in T.STOP_BY_LANG.values() for w in ws} | set(T.STOP_EN))


def reason_sql(c: str = "text", aware: bool = True) -> str:
    telugu, latin = S.count(c, "[\\x{0C00}-\\x{0C7F}]"), S.count(c, "[A-Za-z]")
    indic = f"({telugu} > {latin})" if aware else "false"
    mean = S.mean_word_length(c)
    return f"""CASE WHEN {S.n_words(c)} < 50 THEN 'too_short' WHEN {S.symbol_ratio(c, 'script_aware' if aware else 'alnum')} > 0.30 THEN 'symbol_ratio'
    WHEN {mean} < 3.0 OR {mean} > CASE WHEN {indic} THEN 14.0 ELSE 10.0 END THEN 'mean_word_length' WHEN {S.dup_line_ratio(c)} > 0.30 THEN 'duplicate_lines'
    WHEN CASE WHEN {indic} THEN NOT {S.has_any(c, T.STOP_TE)} ELSE NOT {S.has_any(c, STOP)} END THEN 'no_stopwords' END"""


@query(f"SELECT doc_id, coalesce({reason_sql()}, 'keep') AS reason FROM documents")
def quality_reasons(spark, sf_dir):
    """The first failing test of each document."""
    return docs(spark, sf_dir).select("doc_id", F.coalesce(clean.drop_reason(), F.lit("keep")).alias("reason"))


@query(f"SELECT coalesce({reason_sql()}, 'keep') AS reason, CAST(count(*) AS BIGINT) AS docs FROM documents GROUP BY 1")
def quality_drop_reasons(spark, sf_dir):
    """C2."""
    return quality_reasons(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("docs"))


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(count(*) FILTER ({reason_sql()} IS NOT NULL) AS BIGINT) AS dropped_aware, CAST(count(*) FILTER ({reason_sql(aware=False)} IS NOT NULL) AS BIGINT) AS dropped_plain FROM documents GROUP BY lang")
def filter_bias_probe(spark, sf_dir):
    """The same documents through both filters, by language."""
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(clean.drop_reason().isNotNull()).alias("dropped_aware"), F.count_if(clean.drop_reason(script_aware=False).isNotNull()).alias("dropped_plain"))


@query(f"SELECT coalesce({reason_sql()}, 'keep') AS reason, quality, toxic, CAST(count(*) AS BIGINT) AS docs FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_quality_by_reason(spark, sf_dir):
    """C1 against the labels."""
    return quality_reasons(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("reason", "quality", "toxic").agg(F.count("*").alias("docs"))


@query(f"""WITH {DIRTY} SELECT coalesce(CASE WHEN {S.n_words()} < 5 THEN 'too_short' WHEN {S.symbol_ratio(kind='alnum')} > 0.35 THEN 'symbol_ratio'
    WHEN NOT {S.has_any('text', T.STOP_BASIC)} AND {S.count('text', '[\\x{0C00}-\\x{0C7F}]')} = 0 THEN 'no_stopwords' END, 'keep') AS reason, CAST(count(*) AS BIGINT) AS docs FROM dirty GROUP BY 1""")
def quality_filter_v1(spark, sf_dir):
    """C4."""
    return dirty(spark, sf_dir).groupBy(F.coalesce(clean.drop_reason_v1(), F.lit("keep")).alias("reason")).agg(F.count("*").alias("docs"))


VOTES = "list_sort([" + ", ".join(f"{{'n': -len(list_filter({S.words('lower(text)')}, lambda x: list_contains([{', '.join(map(q, s))}], x))), 'k': {k}, 'l': '{lang}'}}" for k, (lang, s) in enumerate(sorted(T.STOP_BY_LANG.items()))) + "])[1]"


@query(f"""WITH v AS (SELECT doc_id, lang, {VOTES} AS b FROM documents), d AS (SELECT lang, CASE WHEN b.n < 0 THEN b.l ELSE 'unknown' END AS detected FROM v)
    SELECT lang AS claimed, detected, CAST(count(*) AS BIGINT) AS docs, detected <> lang AND detected <> 'unknown' AS mismatch, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'spa' END <> detected AS naive_mismatch FROM d GROUP BY ALL""")
def lang_validation(spark, sf_dir):
    """Claimed against detected language; the naive comparison with three-letter codes always differs."""
    three = F.create_map(*map(F.lit, "en eng fr fra de deu es spa".split()))
    d = docs(spark, sf_dir).select("lang", clean.language_votes().alias("detected"))
    return d.groupBy(F.col("lang").alias("claimed"), "detected").agg(F.count("*").alias("docs")).select(
        "claimed", "detected", "docs", ((F.col("detected") != F.col("claimed")) & (F.col("detected") != "unknown")).alias("mismatch"), (three[F.col("claimed")] != F.col("detected")).alias("naive_mismatch")
    )


@query(f"WITH {DIRTY} SELECT CASE WHEN {S.count('text', '[\\x{0C00}-\\x{0C7F}]')} > 5 AND CAST({S.count('text', '[\\x00-\\x7F]')} AS DOUBLE) / greatest(length(text), 1) < 0.5 THEN 'te' ELSE 'en' END AS routed, CAST(count(*) AS BIGINT) AS docs FROM dirty GROUP BY 1")
def script_routing(spark, sf_dir):
    """C6."""
    share = T.count("text", "[\\x00-\\x7F]") / F.greatest(F.length("text"), F.lit(1))
    return dirty(spark, sf_dir).groupBy(F.when((T.telugu("text") > 5) & (share < 0.5), "te").otherwise("en").alias("routed")).agg(F.count("*").alias("docs"))


def redact_sql(source: str, kinds: tuple) -> str:
    """CTEs r0..rn, each one kind further."""
    out = [f"r0 AS (SELECT doc_id, text FROM {source})"]
    names: list[str] = []
    for k, (name, pattern, mark) in enumerate(kinds):
        out.append(f"r{k + 1} AS (SELECT doc_id, {''.join(n + ', ' for n in names)}{S.count('text', pattern)} AS n_{name}, regexp_replace(text, {q(pattern)}, '{mark}', 'g') AS text FROM r{k})")
        names.append(f"n_{name}")
    return ", ".join(out)


@query(f"WITH {DIRTY}, {redact_sql('dirty', T.IDENTIFIERS)} SELECT * FROM r{len(T.IDENTIFIERS)}")
def pii_redacted_docs(spark, sf_dir):
    """Ordered redaction with counts."""
    return clean.redact(dirty(spark, sf_dir).select("doc_id", "text"))


@query(f"WITH {redact_sql('documents', T.IDENTIFIERS)} SELECT " + ", ".join(f"CAST(sum(n_{n}) AS BIGINT) AS {n}" for n, _, _ in T.IDENTIFIERS) + f" FROM r{len(T.IDENTIFIERS)}")
def pii_redaction_counts(spark, sf_dir):
    """C7's totals over the documents as they are."""
    return clean.redact(docs(spark, sf_dir).select("doc_id", "text")).agg(*(F.sum(f"n_{n}").alias(n) for n, _, _ in T.IDENTIFIERS))


@query(f"WITH {DIRTY}, {redact_sql('dirty', T.IDENTIFIERS_V1)} SELECT * FROM r2")
def pii_redacted_v1(spark, sf_dir):
    """C8."""
    return clean.redact(dirty(spark, sf_dir).select("doc_id", "text"), kinds=T.IDENTIFIERS_V1)


@query(f"WITH n AS (SELECT greatest(200, CAST(floor(count(*) * 0.005) AS BIGINT)) AS k FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {S.keyed_hex('heldout', 'doc_id')}, doc_id) AS rn FROM documents) SELECT doc_id, rn <= k AS held_out FROM r, n")
def heldout_carve(spark, sf_dir):
    """C9."""
    return clean.held_out(docs(spark, sf_dir)).select("doc_id", "held_out")


@query(f"SELECT doc_id, {S.n_words()} >= 8 AS span_ok, {S.n_words()} >= 64 AS doc_ok, length(text) BETWEEN 200 AND 60000 AS file_ok FROM documents")
def row_predicates(spark, sf_dir):
    """C10."""
    n = T.n_words("text")
    return docs(spark, sf_dir).select("doc_id", (n >= 8).alias("span_ok"), (n >= 64).alias("doc_ok"), F.length("text").between(200, 60000).alias("file_ok"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id = 7")
def ledger_where(spark, sf_dir):
    """C11: rows that equal a dictionary of values."""
    wanted = {"event_type": "click", "user_id": 7}
    out = table(spark, sf_dir, "events")
    for k, v in wanted.items():
        out = out.where(F.col(k) == v)
    return out.select("event_id", "user_id")


GUESS = (("hi", "\\x{0900}-\\x{097F}"), ("te", "\\x{0C00}-\\x{0C7F}"), ("kn", "\\x{0C80}-\\x{0CFF}"), ("en", "A-Za-z"))


@query(f"WITH {DIRTY}, c AS (SELECT doc_id, {', '.join(f'{S.count(chr(116) + chr(101) + chr(120) + chr(116), f"[{r}]")} AS n_{n}' for n, r in GUESS)} FROM dirty) SELECT doc_id, CASE WHEN greatest(n_hi, n_te, n_kn, n_en) = 0 THEN 'en' WHEN n_hi = greatest(n_hi, n_te, n_kn, n_en) THEN 'hi' WHEN n_te = greatest(n_te, n_kn, n_en) THEN 'te' WHEN n_kn >= n_en THEN 'kn' ELSE 'en' END AS guess FROM c")
def script_guess(spark, sf_dir):
    """Q1: the majority script of four; ties hi, te, kn, en; en without letters."""
    n = {k: T.count("text", f"[{r}]") for k, r in GUESS}
    most = F.greatest(*n.values())
    out = F.when(most == 0, "en")
    for k, c in n.items():
        out = out.when(c == most, k)
    return dirty(spark, sf_dir).select("doc_id", out.alias("guess"))
