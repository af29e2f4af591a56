"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A pattern is literal text with ``*`` for any run, ``^`` for a separator or the end, ``|`` for the start
or end of the url and a leading ``||`` for the start of any label of the host. Tokens are runs of
letters and digits; those of a pattern that must appear whole in every url it fits are its literal
tokens. A url's tokens fetch the rules stored under them, and only those rules' regular expressions run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"^[\s\S]*?://"

# Host and path rules that come first.
PLACE_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

# Default patterns for urls that no place rule fits.
URL_PATTERNS = (
    ("||ads.*^", "block"),
    ("||tracker.*^", "block"),
    ("/banner/*/img^", "block"),
    ("^sessionid=", "block"),
    ("^utm_source=feed^", "block"),
    ("/cgi-bin/", "block"),
    (".exe|", "block"),
    ("/robots.txt|", "allow"),
)


@dataclass(frozen=True)
class Pattern:
    """A rule as its regular expression over the url and the literal tokens it may be stored under."""

    rule: str
    action: str
    place: bool
    regex: str
    tokens: tuple[str, ...]


def compiled(rule: str, action: str, place: bool = False) -> Pattern:
    """A place rule (host and path prefix) reads ``||rule`` on host and path alone."""
    body, head, tail = rule, "", ""
    if place or body.startswith("||"):
        body, head = body if place else body[2:], r"^(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if not place and body.endswith("|"):
        body, tail = body[:-1], r"\z"
    parts = [body] if place else body.split("*")
    separators = r"(?:[^A-Za-z0-9_.%-]|\z)"
    regex = "[\\s\\S]*".join("".join(separators if c == "^" and not place else re.escape(c) for c in p) for p in parts)
    tokens = []
    for n, part in enumerate(parts):
        for m in re.finditer("[A-Za-z0-9]+", part):
            left = m.start() > 0 or n == 0 and head != ""
            right = m.end() < len(part) or n == len(parts) - 1 and tail != ""
            if left and right:
                tokens.append(m.group().lower())
    return Pattern(rule, action, place, head + regex + tail, tuple(dict.fromkeys(tokens)))


def rule_table(spark: SparkSession, places=PLACE_RULES, patterns=URL_PATTERNS) -> DataFrame:
    """(rule, action, place, regex, tokens), one row a rule; repeated rules count once."""
    rows = [compiled(r, a, True) for r, a in places] + [compiled(r, a) for r, a in patterns]
    rows = [(p.rule, p.action, p.place, p.regex, list(p.tokens)) for p in dict.fromkeys(rows)]
    return spark.createDataFrame(rows, "rule string, action string, place boolean, regex string, tokens array<string>")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, _AFTER + r"([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, _AFTER + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z0-9]+)"), 1))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule under its rarest token among all urls (ties to the smaller token); '' if it has none."""
    wanted = rules.select("rule", "place", "action", F.explode("tokens").alias("token"))
    used = urls.select("n", F.explode("tokens").alias("token"))
    counts = (used.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.sum("n").alias("times")))
    rarest = (wanted.join(counts, "token", "left").groupBy("rule", "place", "action")
              .agg(F.min(F.struct(F.coalesce("times", F.lit(0).cast("long")).alias("times"), "token"))["token"].alias("token")))
    return (rules.join(rarest, ["rule", "place", "action"], "left")
            .select("rule", "action", "place", "regex", F.coalesce("token", F.lit("")).alias("token")))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    The longest place rule that fits decides (ties to the smaller text) and is named; otherwise an allow
    pattern, then a block pattern, then allow, with no rule named. A null url or one without ``://`` has
    an empty host and path, which no place rule fits; patterns see what there is. Rows may repeat or have
    null ids: each comes out. Only ``page_id`` and ``url`` are read.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    urls = (pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("host", host_of(url)).withColumn("path", path_of(url))
            .withColumn("whole", F.when(url.contains("://"), F.concat(
                "host", F.regexp_extract(url, _AFTER + r"[^/?#]*([\s\S]*)", 1))).otherwise(url))
            .withColumn("tokens", F.concat(_tokens(F.col("whole")), F.array(F.lit("")))))
    index = indexed(rules, urls)
    fetched = urls.withColumn("token", F.explode("tokens")).join(index, "token", "left")
    target = F.when(F.col("place"), F.concat("host", "path")).otherwise(F.col("whole"))
    fits = F.coalesce(F.regexp_like(target, F.col("regex")), F.lit(False))
    place, pattern = fits & F.col("place"), fits & ~F.col("place")
    longest = F.min(F.when(place, F.struct((-F.length("rule")).alias("size"), F.col("rule"), F.col("action"))))
    found = (fetched.groupBy("page_id", "url", "n", "host", "path")
             .agg(longest.alias("top"), F.max(F.when(pattern, F.col("action") == "allow")).alias("allowed"),
                  F.max(F.when(pattern, F.col("action") == "block")).alias("blocked")))
    verdict = (F.when(F.col("top").isNotNull(), F.col("top.action"))
               .when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), F.lit("block"))
               .otherwise(F.lit("allow")))
    return (found.select("page_id", "host", "path", F.col("top.rule").alias("rule"), verdict.alias("verdict"),
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).drop("copy"))
