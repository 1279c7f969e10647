"""Text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, the class that splits words in every dialect used here.
SPACE = "[ \\t\\n\\r\\f]+"

# Stop words, marker patterns and identifier patterns that decide the cleaning results.
STOP_EN = "the and to of a in is that for it on with as at by an be this are was from".split()
STOP_TE = "ఈ మరియు ఒక కూడా నుండి అని ఉంది వారు కోసం అయితే ఆ ఇది చేసిన వంటి తో".split()
STOP_BASIC = "the and to of a in is that for it on with as at by an be this are ఈ మరియు".split()
#: Own choice for the languages of the test data.
STOP_BY_LANG = {
    "en": "the and of to is that with was for this from".split(),
    "fr": "le la les des et est une dans pour que qui".split(),
    "de": "der die und ist das mit von den zu für auch".split(),
    "es": "el los las que del por una con para su se".split(),
}
MARKERS = {
    "bracket_user": r"(?i)\[(?:User|Assistant|USER|ASSISTANT)\][ \t\n\r\f]*:",
    "angle_human": r"(?i)<(?:human|bot|assistant|user)>[ \t\n\r\f]*:?",
    "alpaca_header": r"(?i)###[ \t\n\r\f]*(?:Instruction|Response|Input)[ \t\n\r\f]*:",
    "chatml_literal": r"<\|im_(?:start|end)\|>",
    "llama_inst": r"\[/?INST\]|<<SYS>>",
    "openai_role": r"(?m)^[ \t\n\r\f]*(?:Human|AI|Assistant)[ \t\n\r\f]*:[ \t\n\r\f]",
}
IDENTIFIERS = (
    ("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]{2,}", "[EMAIL]"),
    ("url_credentials", r"https?://[^ \t\n\r\f:@/]+:[^ \t\n\r\f:@/]+@", "[URL_CRED]"),
    ("govt_id", r"\b[0-9]{4}[ \t\n\r\f][0-9]{4}[ \t\n\r\f][0-9]{4}\b", "[GOVT_ID]"),
    ("phone_in", r"(?:\+91[ \t\n\r\f-]?)?[6-9][0-9]{9}\b", "[PHONE]"),
    ("phone_intl", r"\+[0-9]{1,3}[-. \t\n\r\f]?[0-9]{3}[-. \t\n\r\f]?[0-9]{3}[-. \t\n\r\f]?[0-9]{3,4}\b", "[PHONE]"),
    ("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP]"),
)
IDENTIFIERS_V1 = (
    ("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[EMAIL]"),
    ("phone", r"\+?[0-9]{1,4}[-. \t\n\r\f]?[0-9]{3}[-. \t\n\r\f]?[0-9]{3}[-. \t\n\r\f]?[0-9]{4}", "[PHONE]"),
)
ENTITY = r"&(?:[a-zA-Z]{2,10}|#[0-9]{2,5}|#x[0-9a-fA-F]{2,5});"
#: Control, format, private and unassigned-replacement characters but newline and tab; joiners are set aside before.
UNWANTED = "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\p{Cf}\\p{Co}\\x{FFFC}\\x{FFFD}]"
VERSION = r"(?i)\b(?:v|version|ver\.?)[ \t\n\r\f]*[0-9]{1,3}(?:\.[0-9]{1,3}){2,3}\b"
#: The same for Java, whose \b counts letters beyond ASCII as word characters and whose (?i) leaves out the long s.
VERSION_JAVA = VERSION.replace(r"(?i)\b", "(?i)(?<![0-9A-Za-z_])").replace("version", "ver[s\u017f]ion").removesuffix(r"\b") + "(?![0-9A-Za-z_])"
SCRIPTS = (
    ("Devanagari", "0900-097F"), ("Bengali", "0980-09FF"), ("Gurmukhi", "0A00-0A7F"), ("Gujarati", "0A80-0AFF"), ("Odia", "0B00-0B7F"),
    ("Tamil", "0B80-0BFF"), ("Telugu", "0C00-0C7F"), ("Kannada", "0C80-0CFF"), ("Malayalam", "0D00-0D7F"), ("Sinhala", "0D80-0DFF"),
    ("Arabic", "0600-06FF"), ("Cyrillic", "0400-04FF"), ("Greek", "0370-03FF"), ("Hebrew", "0590-05FF"), ("Kana", "3040-30FF"),
    ("Han", "4E00-9FFF"), ("Hangul", "AC00-D7AF"),
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Words between ASCII white space; no empty ones."""
    return F.filter(F.split(col(c), SPACE), lambda w: w != "")


def n_words(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def n_spaces_plus_one(c: Column | str) -> Column:
    """The loader's word count: spaces and one."""
    return (F.length(col(c)) - F.length(F.replace(col(c), F.lit(" "), F.lit(""))) + 1).cast("long")


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("long")


def count_chars(c: Column | str, letters: str) -> Column:
    """How many characters are of a class: what is gone once its runs are removed, which matches runs, not characters."""
    return (F.length(col(c)) - F.length(F.regexp_replace(col(c), letters + "+", ""))).cast("long")


def lines(c: Column | str) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(col(c), "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")


def dup_line_ratio(c: Column | str) -> Column:
    """1 - distinct / all non-blank lines; 0 without lines."""
    return let(lines(c), lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(x)) / F.size(x)))


def mean_length(w: Column) -> Column:
    """Characters of words by words; null without words."""
    return F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.size(w))


def mean_word_length(c: Column | str) -> Column:
    return let(words(c), mean_length)


def symbol_ratio(c: Column | str, kind: str = "script_aware") -> Column:
    """Share of characters that count as symbols.

    script_aware: not letter, mark, number or space. alnum: not letter, number or space (marks are symbols). selector:
    as alnum, without common punctuation; 1 for an empty text.
    """
    text = {"script_aware": "[\\p{L}\\p{M}\\p{N} \\t\\n\\r\\f]", "alnum": "[\\p{L}\\p{N} \\t\\n\\r\\f]", "selector": "[\\p{L}\\p{N} \\t\\n\\r\\f.,'\"\\-?!:;()]"}[kind]
    ratio = 1 - F.length(F.regexp_replace(col(c), f"[^{text[1:-1]}]+", "")) / F.greatest(F.length(col(c)), F.lit(1))
    return F.when(F.length(col(c)) == 0, F.lit(1.0)).otherwise(ratio) if kind == "selector" else ratio


def telugu(c: Column | str) -> Column:
    return count_chars(c, "[\\x{0C00}-\\x{0C7F}]")


def ascii_letters(c: Column | str) -> Column:
    return count_chars(c, "[A-Za-z]")


def has_any(c: Column | str, stop: list[str]) -> Column:
    """Whether any lower-case word is one of these."""
    return F.arrays_overlap(words(F.lower(col(c))), F.array(*map(F.lit, stop)))


def script_of(c: Column | str) -> Column:
    """The commonest non-ASCII script of a text (ties: the order of SCRIPTS, then Latin-ext, Other); ASCII or Empty."""
    c = col(c)
    named = "".join(f"\\x{{{r[:4]}}}-\\x{{{r[5:]}}}" for _, r in SCRIPTS)
    counts = [(n, count(c, f"[\\x{{{r[:4]}}}-\\x{{{r[5:]}}}]")) for n, r in SCRIPTS]
    latin = count(c, f"[\\p{{L}}&&[^\\x00-\\x7F{named}]]")
    counts += [("Latin-ext", latin), ("Other", count(c, f"[^\\x00-\\x7F{named}\\p{{L}}]"))]
    best = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, n) in enumerate(counts))))
    return F.when(F.length(c) == 0, "Empty").when(best["n"] > 0, best["name"]).otherwise("ASCII")


def keyed_hex(key: str, *cols: Column) -> Column:
    """Hex of a keyed SHA-256: the engine's deterministic order."""
    return F.sha2(F.concat_ws("|", F.lit(key), *(c.cast("string") for c in cols)), 256)


def keyed_unit(key: str, *cols: Column) -> Column:
    """A keyed number in [0, 1) from the first 13 hex digits, exact in a double."""
    return F.conv(F.substring(keyed_hex(key, *cols), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
