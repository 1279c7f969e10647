"""Normalisation, marker removal, quality filter, language vote and identifier redaction over documents."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: (reason, test) in the order in which the first that holds names the drop.
MIN_WORDS, MAX_SYMBOLS, MAX_DUP_LINES = 50, 0.30, 0.30
TELUGU_NOTE = " (లక్ష్మి \u200d and నిశ్శబ్ద \u200c)"
TELUGU_LEAD = "తెలుగు భాషలో సమాధానం ఇవ్వండి: "
#: Joiners are legitimate in Brahmic scripts; the line and paragraph separators stand in for them meanwhile.
JOINERS, SET_ASIDE = "\u200c\u200d", "\u2028\u2029"


def _unescape_nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def unescape_nfc(c: Column | str) -> Column:
    """Character references decoded, then NFC: the two steps without a Spark built-in."""
    return F.pandas_udf(_unescape_nfc, "string")(c)


def strip_unwanted(c: Column, keep_newlines: bool = True) -> Column:
    """Without control, format and private characters; joiners stay. Otherwise newlines and tabs go too."""
    aside = F.translate(c, JOINERS, SET_ASIDE)
    out = F.regexp_replace(aside, T.UNWANTED if keep_newlines else "[\\p{Cc}\\x{FEFF}\\x{202E}\\x{200B}]", "")
    return F.translate(out, SET_ASIDE, JOINERS)


def squeeze(c: Column) -> Column:
    """Blanks to one, three and more newlines to two, trimmed."""
    out = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(out, "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")


def normalize(df: DataFrame, c: str = "text") -> DataFrame:
    """Adds n_entities, n_removed, n_joiners and replaces the text by its normal form."""
    raw = df.withColumn("n_entities", T.count(c, T.ENTITY)).withColumn("_plain", unescape_nfc(c))
    raw = raw.withColumn("n_joiners", T.count("_plain", "[\\x{200C}\\x{200D}]"))
    raw = raw.withColumn("_kept", strip_unwanted(F.col("_plain"))).withColumn("n_removed", (F.length("_plain") - F.length("_kept")).cast("long"))
    return raw.withColumn(c, squeeze(F.col("_kept"))).drop("_plain", "_kept")


def normalize_v1(df: DataFrame, c: str = "text") -> DataFrame:
    """The first version: all control characters go, newlines too (so words may fuse), and white space becomes a space."""
    named = F.col(c).rlike("&amp;|&lt;|&gt;|&quot;")
    raw = df.withColumn("had_entity", named).withColumn("_plain", unescape_nfc(c))
    return raw.withColumn(c, F.trim(F.regexp_replace(strip_unwanted(F.col("_plain"), False), T.SPACE, " "))).drop("_plain")


def marker_kinds(c: str = "text") -> Column:
    """The kinds of chat markers that a text holds, in order."""
    return F.array_compact(F.array(*(F.when(F.col(c).rlike(p), F.lit(k)) for k, p in T.MARKERS.items())))


def remove_markers(c: str = "text") -> Column:
    """Each kind in turn replaced by a space, blanks squeezed, trimmed; unchanged without markers."""
    out = F.col(c)
    for p in T.MARKERS.values():
        out = F.regexp_replace(out, p, " ")
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    return F.when(F.size(marker_kinds(c)) > 0, out).otherwise(F.col(c))


def drop_reason(c: str = "text", script_aware: bool = True, stop: list[str] | None = None) -> Column:
    """The first failing test, else null: too_short, symbol_ratio, mean_word_length, duplicate_lines, no_stopwords."""
    stop = stop or sorted({w for ws in T.STOP_BY_LANG.values() for w in ws} | set(T.STOP_EN))
    indic = (T.telugu(c) > T.ascii_letters(c)) & F.lit(script_aware)
    lower = lambda w: F.transform(w, F.lower)
    among = lambda w, some: F.arrays_overlap(lower(w), F.array(*map(F.lit, some)))

    def of_words(w: Column) -> Column:
        mean = T.let(T.mean_length(w), lambda m: (m < 3.0) | (m > F.when(indic, 14.0).otherwise(10.0)))
        return (
            F.when(F.size(w) < MIN_WORDS, "too_short")
            .when(T.symbol_ratio(c, "script_aware" if script_aware else "alnum") > MAX_SYMBOLS, "symbol_ratio")
            .when(mean, "mean_word_length")
            .when(T.dup_line_ratio(c) > MAX_DUP_LINES, "duplicate_lines")
            .when(F.when(indic, ~among(w, T.STOP_TE)).otherwise(~among(w, stop)), "no_stopwords")
        )

    return T.let(T.words(c), of_words)


def drop_reason_v1(c: str = "text") -> Column:
    """The first version: under 5 words, over 0.35 symbols, neither stop word nor Telugu."""
    return (
        F.when(T.n_words(c) < 5, "too_short")
        .when(T.symbol_ratio(c, "alnum") > 0.35, "symbol_ratio")
        .when(~T.has_any(c, T.STOP_BASIC) & (T.telugu(c) == 0), "no_stopwords")
    )


def language_votes(c: str = "text") -> Column:
    """The language with most stop words among a text's words (ties: by name); unknown without any."""
    w = T.words(F.lower(F.col(c)))
    among = lambda stop: F.size(F.filter(w, lambda x: x.isin(stop)))
    votes = F.array(*(F.struct(among(s).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, s) in enumerate(sorted(T.STOP_BY_LANG.items()))))
    best = F.array_max(votes)
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")


def redact(df: DataFrame, c: str = "text", kinds: tuple = T.IDENTIFIERS) -> DataFrame:
    """Replaces identifiers kind by kind, each counted on the text that the kinds before it left: adds n_<kind>."""
    for name, pattern, mark in kinds:
        df = df.withColumn(f"n_{name}", T.count(c, pattern)).withColumn(c, F.regexp_replace(c, pattern, mark.replace("$", "\\$")))
    return df


def inject_dirt(df: DataFrame) -> DataFrame:
    """A deterministic dirty view, for tests of the cleaners: edits by doc_id modulo 15, 20, 25, 18, 22, 40 and 50, and
    a near copy of the document before for every thirtieth."""
    before = df.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("_before"))
    t = F.col("text")
    every = lambda k: F.col("doc_id") % k == 0
    out = df.join(before, "doc_id", "left")
    out = out.withColumn("text", F.when(every(30) & F.col("_before").isNotNull(), F.concat("_before", F.lit(" (Please double-check)."))).otherwise(t)).drop("_before")
    out = out.withColumn("text", F.when(every(15), F.concat(t, F.lit(' &amp; check if it is &lt; 100 &gt; &quot;true&quot;'))).otherwise(t))
    out = out.withColumn("text", F.when(every(20), F.concat(F.lit("\ufeff\u200b"), t, F.lit(" \u202e reverse text"))).otherwise(t))
    out = out.withColumn("text", F.when(every(25), F.concat(t, F.lit(TELUGU_NOTE))).otherwise(t))
    chat = F.when(F.col("doc_id") % 54 == 0, F.concat(F.lit("[User]: "), t, F.lit("\n[Assistant]: ok"))).when(F.col("doc_id") % 54 == 18, F.concat(F.lit("<human>: "), t, F.lit("\n<bot>: ok"))).otherwise(F.concat(F.lit("### Instruction:\n"), t, F.lit("\n### Response:\nok")))
    out = out.withColumn("text", F.when(every(18), chat).otherwise(t))
    out = out.withColumn("text", F.when(every(22), F.concat(t, F.lit(" Contact contact"), F.col("doc_id").cast("string"), F.lit("@ai-school.edu or call +1-555-019-0042."))).otherwise(t))
    out = out.withColumn("text", F.when(every(40), F.concat(F.lit(TELUGU_LEAD), t)).otherwise(t))
    return out.withColumn("text", F.when(every(50), F.concat(F.lit("What is the capital of France? "), t)).otherwise(t))


def unify_format(instruction: Column, output: Column) -> Column:
    """struct(instruction, output, text): user markers stripped from the front, assistant markers split out, and the
    canonical chat text."""
    user = (r"(?i)^\[User\]:[ \t\n\r\f]*", r"(?i)^<human>:[ \t\n\r\f]*", r"(?i)^### Instruction:[ \t\n\r\f]*")
    assistant = (r"(?i)\[Assistant\]:[ \t\n\r\f]*", r"(?i)<bot>:[ \t\n\r\f]*", r"(?i)### Response:[ \t\n\r\f]*")
    for p in user:
        instruction = F.regexp_replace(instruction, p, "")
    trim = lambda c: F.regexp_replace(c, "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    for p in assistant:
        output = F.regexp_replace(output, p, "")
        parts = F.split(instruction, p, 2)
        output = F.when(F.size(parts) > 1, F.concat(trim(parts[1]), F.lit("\n"), output)).otherwise(output)
        instruction = F.when(F.size(parts) > 1, trim(parts[0])).otherwise(instruction)
    text = F.concat(F.lit("<|im_start|>user\n"), instruction, F.lit("<|im_end|>\n<|im_start|>assistant\n"), output, F.lit("<|im_end|>"))
    return F.struct(instruction.alias("instruction"), output.alias("output"), text.alias("text"))


def held_out(df: DataFrame, at_least: int = 200, share: float = 0.005, key: str = "heldout") -> DataFrame:
    """Adds held_out: the first max(at_least, share of all) rows in a keyed order of doc_id.

    The bound is found on a sorted table of hashes, of which only the first rows are kept, so no task orders all rows.
    """
    n = df.count()
    k = max(at_least, int(n * share))
    order = T.keyed_hex(key, F.col("doc_id"))
    chosen = df.select("doc_id", order.alias("_h")).orderBy("_h", "doc_id").limit(k).select("doc_id").withColumn("held_out", F.lit(True))
    return df.join(chosen, "doc_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))
