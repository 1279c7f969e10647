"""URL filter: rules first, then a character language-model ratio (operator 9), in DataFrame operations only.

Two variable-order Markov models over the characters of host and path, for URLs that the rules accept and reject, with
contexts of up to two characters and Witten-Bell smoothing: each order is mixed with the one below it, down to the even
distribution. A URL without a rule is judged by its log-likelihood difference per character against a threshold calibrated to
keep all but a twentieth of the accepted set, where each URL is scored by models of other hosts' URLs only. The alphabet has 43 characters, so a model has at most 43^3 = 79,507 entries of each
order: the table that is broadcast is bounded, however many URLs there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789./-_"
#: Any other character, the start and the end.
OTHER, START, END = "~", "^", "$"
ALPHABET = len(LETTERS) + 3
CONTEXT = 2
#: The share of the accepted set that the threshold may lose.
LOST = 0.05


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def first_fit(rules: tuple[Rule, ...], value) -> Column:
    """value(rule) of the longest rule that fits columns host and path, else null; of equally long ones, block first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def letters(host: Column, path: Column) -> Column:
    """Host and path in the models' alphabet, with start and end."""
    plain = F.regexp_replace(F.lower(F.concat(host, path)), "[^a-z0-9./\\-_]", OTHER)
    return F.concat(F.lit(START * CONTEXT), plain, F.lit(END))


def grams(text: Column) -> Column:
    """A gram for each character after the start: its context and itself."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - CONTEXT), lambda i: F.substring(text, i, F.lit(CONTEXT + 1)))


def models(seen: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, delta): the log10 probability ratio, accepted to rejected, of each asked gram's last character.

    seen: (gram, a, r), counts in both sets; asked: (gram), distinct, of full length.
    """
    out = asked.select("gram", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))
    for n in range(CONTEXT + 1):
        tail = lambda c, size: F.substring(c, -size, size) if size else F.lit("")
        counts = seen.groupBy(tail(F.col("gram"), n + 1).alias("key")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        contexts = counts.groupBy(F.substring("key", 1, n).alias("context")).agg(
            F.sum("ca").alias("na"), F.sum("cr").alias("nr"), F.count_if(F.col("ca") > 0).alias("ta"), F.count_if(F.col("cr") > 0).alias("tr")
        )
        key = tail(F.col("gram"), n + 1)
        out = out.withColumn("key", key).withColumn("context", F.substring(key, 1, n))
        out = out.join(counts, "key", "left").join(contexts, "context", "left").na.fill(0, ["ca", "cr", "na", "nr", "ta", "tr"])
        mixed = lambda p, c, n_, t: F.when(F.col(n_) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n_) + F.col(t))).otherwise(F.col(p))
        out = out.select("gram", mixed("pa", "ca", "na", "ta").alias("pa"), mixed("pr", "cr", "nr", "tr").alias("pr"))
    return out.select("gram", (F.log10("pa") - F.log10("pr")).alias("delta"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns of every row, host, path, rule, verdict, ratio.

    ratio is null for rows with a rule. Rows that repeat stay separate. Where the rules leave a set without URLs, all that
    is left is allowed; the same holds for an empty host and path, which have no characters to judge. Null URLs have both
    empty; null ids are rows like others; long URLs count whole; an empty table gives no rows. Columns not named are left
    out; kept columns mustn't have the names of those added.
    """
    host, path = split(F.col("url").cast("string"))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", first_fit(rules, lambda r: r.text)).withColumn("by_rule", first_fit(rules, lambda r: r.verdict))
    text = letters(F.col("host"), F.col("path"))
    half = F.pmod(F.xxhash64("host"), F.lit(2))
    tally = [F.count_if((F.col("by_rule") == v) & (F.col("half") == k)).alias(f"{v}{k}") for v in ("allow", "block") for k in (0, 1)]
    each = materialize(rows.select("by_rule", half.alias("half"), F.explode(grams(text)).alias("gram")).groupBy("gram").agg(*tally), "url-grams")

    def ratio_of(a: str, r: str) -> DataFrame:
        seen = each.select("gram", F.expr(a).alias("a"), F.expr(r).alias("r")).where("a + r > 0")
        return models(seen, each.select("gram"))

    def ratios(some: DataFrame, by: list[str], delta: DataFrame, on: list[str]) -> DataFrame:
        """delta has at most 2 x 43^3 rows."""
        return some.withColumn("gram", F.explode(grams(text))).join(F.broadcast(delta), on).groupBy(by).agg(F.avg("delta").alias("ratio"))

    known = rows.where("by_rule IS NOT NULL").withColumn("row", F.monotonically_increasing_id()).withColumn("half", half)
    crossed = ratio_of("allow1", "block1").withColumn("half", F.lit(0)).union(ratio_of("allow0", "block0").withColumn("half", F.lit(1)))
    held = ratios(known, ["row", "by_rule"], crossed, ["gram", "half"])
    sets = {r.by_rule: r.low for r in held.groupBy("by_rule").agg(F.percentile_approx("ratio", LOST, 10_000).alias("low")).collect()}
    threshold = sets["allow"] if {"allow", "block"} <= sets.keys() else None
    out = [*keep, "host", "path", "rule", "verdict", "ratio"]
    ruled = rows.where("by_rule IS NOT NULL").withColumn("verdict", F.col("by_rule")).withColumn("ratio", F.lit(None).cast("double")).select(out)
    open_ = rows.where("by_rule IS NULL").withColumn("row", F.monotonically_increasing_id())
    open_ = ratios(open_, ["row", *keep, "host", "path", "rule"], ratio_of("allow0 + allow1", "block0 + block1"), ["gram"])
    fine = F.lit(True) if threshold is None else (F.col("ratio") >= threshold) | ((F.col("host") == "") & (F.col("path") == ""))
    return ruled.union(open_.withColumn("verdict", F.when(fine, "allow").otherwise("block")).select(out))
