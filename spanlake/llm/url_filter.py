"""URL verdicts: host and path rules, then pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]{3,}"


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the lower-cased URL, and the literal tokens that every URL it matches holds whole."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str


def _named(word: str) -> str:
    """A host that holds the word between dots or hyphens."""
    return rf"://([^/?#]*[.@-])?{word}([.:/?#-]|$)"


#: Kinds of hosts that crawl filters commonly refuse, by one word for each pattern, so that each is indexed.
KINDS = (
    ("adult", ("adult", "xxx", "porn", "porno")),
    ("gambling", ("casino", "casinos", "bets", "betting", "gambling", "poker")),
    ("pills", ("pills", "viagra", "cialis")),
    ("trackers", ("ads", "adserver", "track", "tracker", "trackers", "tracking")),
)
PATTERNS = (
    *(Pattern(f"{kind}: {word}", _named(word), (word,), "block") for kind, words in KINDS for word in words),
    # A host of that name alone is none of the kind, a compound with it is.
    Pattern("spam", r"://([^/?#]*[.@-])?spam-|://[^/?#]*-spam([.:/?#-]|$)", ("spam",), "block"),
    Pattern("session id: phpsessid", r"[?&]phpsessid=", ("phpsessid",), "block"),
    Pattern("session id: jsessionid", r"[?&]jsessionid=", ("jsessionid",), "block"),
    Pattern("login: admin", r"/wp-admin[./?#]", ("admin",), "block"),
    Pattern("login: login", r"/wp-login[./?#]", ("login",), "block"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """The longest of `(host, path prefix, verdict)` rules that fits: its host or a subdomain of it, and the path's start.
    A struct of rule and verdict, or null. The list is an argument of the query, so it is part of the plan."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(longest):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def index_patterns(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """`patterns(name, regex, tokens, verdict)` with `token`: of its tokens the one that fewest distinct URLs hold, ties to the smaller;
    null for a pattern without tokens. Only tokens that some pattern names are counted, over all URLs."""
    asked = patterns.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit(TOKEN), 0))).alias("token"))
    counts = asked.join(held.join(F.broadcast(asked), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")), "token", "left").na.fill(0, ["n"])
    rarest = (
        patterns.select("name", F.explode("tokens").alias("token")).join(counts, "token").groupBy("name").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    )
    return patterns.join(rarest, "name", "left")


def pattern_verdicts(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """`(url, pattern, pattern_verdict)` for every distinct lower-cased URL that a pattern matches: the smallest name of those that match.

    A URL's distinct tokens fetch the patterns indexed under them; only those run their regular expression. Patterns
    without a literal token run on every URL: they join on a token that every URL is given. What is broadcast is the list of
    patterns, an argument that the driver already holds in full; it does not grow with the URLs.
    """
    indexed = index_patterns(urls, patterns).select("name", "regex", "verdict", F.coalesce("token", F.lit("")).alias("token"))
    tokens = F.array_append(F.array_distinct(F.regexp_extract_all("url", F.lit(TOKEN), 0)), F.lit(""))
    fetched = urls.select("url", F.explode(tokens).alias("token")).join(F.broadcast(indexed), "token")
    matched = fetched.where(F.expr("url RLIKE regex"))
    return matched.groupBy("url").agg(F.min(F.struct("name", "verdict")).alias("m")).select("url", F.col("m.name").alias("pattern"), F.col("m.verdict").alias("pattern_verdict"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], patterns: Iterable[Pattern] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`(page_id, host, path, rule, pattern, verdict)` per row: a site rule's verdict, else a pattern's, else allow.

    A null URL, or one without `://`, has an empty host and path and fits no rule; a pattern may still match it. Equal URLs are judged
    once; repeated rows keep their own row. Null ids stay; other columns are not read. A token missing from a
    pattern's list only makes its candidates more; one listed that a matching URL lacks would lose matches, so `Pattern` asks
    for tokens that every match holds whole (`check_pattern`).
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(p.name, p.regex, list(p.tokens), p.verdict) for p in patterns], "name string, regex string, tokens array<string>, verdict string")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("raw"), F.lower(F.col(url_col).cast("string")).alias("url"))
    found = pattern_verdicts(rows.select("url").where("url IS NOT NULL").distinct(), table)
    host, path = host_of(F.col("raw")), path_of(F.col("raw"))
    judged = rows.withColumn("host", host).withColumn("path", path).withColumn("site", site_rule(F.col("host"), F.col("path"), rules))
    return judged.join(found, "url", "left").select(
        "page_id", "host", "path", F.col("site.rule").alias("rule"), "pattern", F.coalesce("site.verdict", "pattern_verdict", F.lit("allow")).alias("verdict")
    )


def check_pattern(pattern: Pattern, url: str) -> bool:
    """Whether the pattern's tokens are all among those of a URL that it matches (for tests of new patterns)."""
    return not re.search(pattern.regex, url.lower()) or set(pattern.tokens) <= set(re.findall(TOKEN, url.lower()))
