"""URL filters: allow and block rules found by hashes of host suffixes and path prefixes.

Every URL is spelled out into expressions, a suffix of its host with a prefix of its path,
for each number of host labels with the path lengths that rules of that number have. Expressions
and rules meet in an equi-join on the first digits of a digest; the full digest confirms, and the
longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.llm.common import in_files

#: Hexadecimal digits of the digest that the join compares.
PREFIX_DIGITS = 8
#: Rules up to this number are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: F.Column) -> F.Column:
    """What follows the first ``://`` up to a slash, question mark or hash; empty without it."""
    return F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: F.Column) -> F.Column:
    """What follows the host up to a question mark or hash; empty without ``://``."""
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, path), 256)  # hosts hold no slash and paths begin with one


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per input row: the id, host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains where the path starts with the rule's; an empty path fits every path. The
    longest rule that fits wins, host and path together; of equally long ones the one with
    the longer host, and of the same rule given twice ``block``. Without one the verdict is
    ``default`` and the rule null. Rules with a null host, path or verdict fit nothing.

    Null URLs and those without ``://`` have an empty host and path, and so the default.
    Ids may be null or repeated, rows too; an empty table gives no rows, and empty rules give the
    default; other columns are not read. Each host and path is judged
    once, however many pages share it; what a URL is spelled out into is bounded by the
    rules' own lengths, not by the URL's. The distinct lengths of rules are the driver's, not the
    rules. Verdicts are joined back by a shuffle, as their number grows with the URLs.
    """
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).dropna()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    shapes = rules.groupBy(F.size(F.split("rule_host", r"\.")).alias("labels")).agg(
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.count("*").alias("n")
    ).orderBy("labels").collect()
    n_rules = sum(x["n"] for x in shapes)

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    named = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    if not shapes:
        return named.select(
            F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    hashed = rules.select(
        _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"), "verdict",
        F.length("rule_host").alias("host_length"),
        F.concat("rule_host", "rule_path").alias("rule"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    if n_rules <= BROADCAST_RULES:
        hashed = F.broadcast(hashed)

    dots = F.size(F.split("host", r"\."))
    suffixes = F.array(*[
        F.when(dots >= x["labels"], F.struct(
            F.substring_index("host", ".", -x["labels"]).alias("suffix"), F.lit(x["lengths"]).alias("lengths")))
        for x in shapes])
    spelled = (
        named.select("host", "path").distinct()
        .select("host", "path", F.explode(F.array_compact(suffixes)).alias("at"))
        .withColumn("digest", F.explode(F.transform(
            F.filter("at.lengths", lambda n: F.length("path") >= n),
            lambda n: _digest(F.col("at.suffix"), F.substr("path", F.lit(1), n)))))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    best = (
        spelled.join(hashed, "prefix")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("best"))
    )
    # read from files it is dealt out for the join, so Spark can split a URL that many pages share
    return named.join(in_files(best, "url-verdicts").hint("merge"), ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
