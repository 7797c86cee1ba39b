"""URL filters: pattern rules fetched by their rarest literal token (operator 9).

Each rule is a regular expression over host and path, filed under that of its literal tokens that
fewest URLs hold.  A URL's tokens fetch the rules filed under them, and only those are run.  A rule
without a literal token is filed under the empty token, which every URL has.

Defined results: a null URL, or one without ``://``, has an empty host and path and meets no rule;
equal URLs are judged once and repeated rows, or rows without an id, get equal rows each; rules of
equal length are told apart by their text; a URL is read whole, however long; an empty table gives an
empty result; without rules everything is allowed; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, small, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_TOKEN = r"[^a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host and path; ``literals`` are tokens that every URL it fits has."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    listed: bool

    @staticmethod
    def place(verdict: str, host: str, path: str) -> UrlRule:
        """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
        whole = path[: path.rfind("/") + 1]
        literals = tuple(t for t in re.split(NO_TOKEN, f"{host}{whole}".lower()) if t)
        return UrlRule(host + path, verdict, f"(?s)^([^/]*\\.)?{re.escape(host)}{re.escape(path)}", literals, True)

    @staticmethod
    def words(verdict: str, *words: str) -> UrlRule:
        """Fits URLs that have these words in a row, as whole tokens."""
        return UrlRule("-".join(words), verdict, "(?si)(^|[^a-z0-9])" + "[^a-z0-9/]+".join(map(re.escape, words)) + "([^a-z0-9]|$)", words, False)


LISTED = (
    UrlRule.place("allow", "com", "/"),
    UrlRule.place("block", "example.com", "/en/"),
    UrlRule.place("allow", "www.example.com", "/en/"),
    UrlRule.place("block", "net", "/es/"),
    UrlRule.place("block", "net", "/fr/"),
)
PATTERNS = (
    UrlRule.words("block", "spam", "farm"),
    UrlRule.words("block", "cheap", "pills"),
    UrlRule.words("block", "casino"),
    UrlRule.words("block", "free", "download"),
    UrlRule.words("block", "adult"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(target, UPPER, LOWER), NO_TOKEN, -1), lambda t: t != ""))


FIELDS = "name string, verdict string, pattern string, listed boolean, literals array<string>"


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, r.listed, list(r.literals)) for r in rules], FIELDS)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from text files, a line each: verdict, ``place`` or ``pattern``, the place or regular expression, and a pattern's tokens, between tabs.

    A place is a host and the beginning of a path, as in ``example.com/en/``.  Tokens, with commas, are those that every URL
    has that the pattern fits; without any the pattern is run on all.  Empty lines and those that begin with # are left out.
    """
    raw = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split("value", "\t", -1).alias("f"))
    verdict, kind, what, tokens = (F.btrim(F.get("f", F.lit(i))) for i in range(4))
    raw = raw.select(verdict.alias("verdict"), kind.alias("kind"), what.alias("what"), F.coalesce(tokens, F.lit("")).alias("tokens"))
    good = F.col("verdict").isin("allow", "block") & F.col("kind").isin("place", "pattern") & (F.col("what") != "")
    place = F.col("kind") == "place"
    host, path_ = F.lower(F.substring_index("what", "/", 1)), F.expr("if(instr(what, '/') > 0, substr(what, instr(what, '/')), '')")
    escaped = F.regexp_replace(F.concat(host, path_), "([^A-Za-z0-9/])", r"\\$1")
    # The last part of a path may go on in a URL, so it is no whole token.
    whole = F.concat(host, F.regexp_replace(path_, "[^/]*$", ""))
    literals = F.when(place, tokens_of(whole)).otherwise(tokens_of(F.col("tokens")))
    bad = F.raise_error(F.concat(F.lit("not a rule: "), "verdict", F.lit(" "), F.coalesce("kind", F.lit(""))))
    return raw.select(
        F.when(place, F.concat(host, path_)).otherwise(F.col("what")).alias("name"), F.when(F.coalesce(good, F.lit(False)), F.col("verdict")).otherwise(bad).alias("verdict"),
        F.when(place, F.concat(F.lit(r"(?s)^([^/]*\.)?"), escaped)).otherwise(F.concat(F.lit("(?s)"), "what")).alias("pattern"), place.alias("listed"), literals.alias("literals"),
    )


def filed(targets: DataFrame, index: DataFrame) -> DataFrame:
    """The rules, each under its rarest token among ``targets`` (by count, then alphabet), or under the empty one if it has none."""
    key = ["name", "verdict", "pattern", "listed"]
    literals = index.select(*key, F.explode("literals").alias("token"))
    used = targets.select(F.explode("tokens").alias("token")).join(small(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # Rules by their literals first, so that a token that many have is looked up once.
    counts = literals.select("token").distinct().join(used, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = literals.join(small(counts), "token").groupBy(*key).agg(F.min(F.struct("n", "token")).alias("least"))
    bare = index.filter(F.size("literals") == 0).select(*key, F.lit("").alias("token")).distinct()
    return rarest.select(*key, F.col("least.token").alias("token")).unionByName(bare)


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = LISTED + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern_rule``: the longest listed rule decides, else any pattern that blocks.

    ``rules`` may also be a table like that of ``read_rules``, of any size.
    """
    rules = rule_table(pages.sparkSession, rules) if isinstance(rules, tuple) else rules
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    targets = parts.filter("host <> '' or path <> ''").select(F.concat("host", "path").alias("target"), F.concat_ws(" ", "host", "path").alias("spaced")).distinct()
    targets = targets.select("target", tokens_of(F.col("spaced")).alias("tokens"))
    index = cut(filed(targets, rules), "rules")
    fetched = F.col("tokens") if index.filter("token = ''").isEmpty() else F.concat("tokens", F.array(F.lit("")))
    fits = targets.select("target", F.explode(fetched).alias("token")).join(small(index, wide="pattern"), "token").filter(F.expr("target rlike pattern"))
    rank = F.struct(F.length("name"), "name", "verdict")
    found = fits.groupBy("target").agg(F.max(F.when(F.col("listed"), rank)).alias("best"), F.min(F.when(~F.col("listed") & (F.col("verdict") == "block"), F.col("name"))).alias("pattern_rule"))
    out = parts.withColumn("target", F.concat("host", "path")).join(found, "target", "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), "pattern_rule")


def op9_rarest_token_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
q as (
  select *, case
      when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
      when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
      when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
      when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
      when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule,
    case
      when regexp_matches(lower(host || path), '(^|[^a-z0-9])adult([^a-z0-9]|$)') then 'adult'
      when regexp_matches(lower(host || path), '(^|[^a-z0-9])casino([^a-z0-9]|$)') then 'casino'
      when regexp_matches(lower(host || path), '(^|[^a-z0-9])cheap[^a-z0-9/]+pills([^a-z0-9]|$)') then 'cheap-pills'
      when regexp_matches(lower(host || path), '(^|[^a-z0-9])free[^a-z0-9/]+download([^a-z0-9]|$)') then 'free-download'
      when regexp_matches(lower(host || path), '(^|[^a-z0-9])spam[^a-z0-9/]+farm([^a-z0-9]|$)') then 'spam-farm' end as pattern_rule
  from p)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when pattern_rule is not null then 'block' else 'allow' end as verdict,
  pattern_rule
from q
"""
