"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal
tokens that any matching URL must hold. Token counts over all URLs give each rule
its rarest token; a URL's own tokens fetch the rules filed under them (an
equi-join), and only those rules' expressions run. Host/path rules (``com/``,
``example.com/en/``) are compiled to such patterns, so they take the same way.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
the default verdict; repeated rows are judged one by one; an empty table gives no
rows; other columns of the input are ignored. A rule without any literal token is
filed under the empty token that every URL has. Of several fitting host/path rules
the longest wins (ties: the larger text); they go before the pattern rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import LOWER, UPPER, with_row_id
from tankline.operators.joins import checked_broadcast


@dataclass(frozen=True)
class UrlRule:
    """``label`` names the rule, ``pattern`` is matched against host + path, every match
    holds all of ``tokens``; ``exact`` rules (host/path) outrank pattern rules."""
    label: str
    pattern: str
    tokens: tuple[str, ...]
    action: str
    exact: bool = False


def quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def prefix_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule for ``host`` and its subdomains, whose paths start with ``path``."""
    whole = path[: path.rfind("/") + 1]  # the last segment counts as a token only if it is closed
    lit = re.findall(r"[a-z0-9]+", f"{host}{whole}".lower())
    return UrlRule(host + path, rf"^(?:[^/]*\.)?{quote(host)}{quote(path)}", tuple(dict.fromkeys(lit)), action, True)


def host_word_rule(action: str, word: str) -> UrlRule:
    """A rule for hosts that hold ``word`` between non-alphanumerics."""
    return UrlRule(f"word:{word}", rf"^(?:[^/]*[^a-z0-9/])?{quote(word)}(?:[^a-z0-9]|$)", (word,), action)


#: The host/path rules of the contract.
BASE_RULES = (
    prefix_rule("allow", "com", "/"),
    prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"),
    prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
)
#: Host words of unwanted sites, for URLs without a fitting host/path rule.
BLOCK_WORDS = ("adult", "casino", "gambling", "malware", "phishing", "porn", "spam", "torrent", "viagra", "warez", "xxx")
DEFAULT_RULES = BASE_RULES + tuple(host_word_rule("block", w) for w in BLOCK_WORDS)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(hp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(hp, UPPER, LOWER), F.lit(r"[a-z0-9]+"), F.lit(0)))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: tuple[UrlRule, ...] = DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, ``rule`` (winning host/path rule or null),
    ``patterns`` (sorted labels of the pattern rules that matched), ``verdict``."""
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("hp", F.concat("host", "path"))
    table = spark.createDataFrame(
        [(i, r.label, r.pattern, r.action, r.exact, list(r.tokens)) for i, r in enumerate(rules)],
        "rule_id int, label string, pattern string, action string, exact boolean, tokens array<string>")
    # rarity of the rules' tokens over all URLs
    lit = checked_broadcast(table.select(F.explode("tokens").alias("token")).distinct())
    freq = (urls.select(F.explode(url_tokens(F.col("hp"))).alias("token")).join(lit, "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    # a rule is filed under its rarest token; one that no URL holds counts as rarest of all
    index = (table.withColumn("token", F.explode_outer("tokens")).join(freq, "token", "left")
             .groupBy("rule_id", "label", "pattern", "action", "exact")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).getField("token").alias("key"))
             .withColumn("key", F.coalesce("key", F.lit(""))))
    urls = with_row_id(urls).withColumn("key", F.explode(F.concat(F.array(F.lit("")), url_tokens(F.col("hp")))))
    hit = urls.join(checked_broadcast(index), "key", "left")
    hit = hit.withColumn("fits", F.col("pattern").isNotNull() & F.expr("hp rlike pattern"))
    hit = hit.where(F.col("fits") | (F.col("key") == ""))
    base = F.when(F.col("fits") & F.col("exact"), F.struct(F.length("label").alias("n"), "label", "action"))
    other = F.col("fits") & ~F.col("exact")
    out = hit.groupBy("_rid").agg(
        F.first("id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(base).alias("base"),
        F.array_sort(F.collect_set(F.when(other, F.col("label")))).alias("patterns"),
        F.max(F.when(other, F.struct("rule_id", "action"))).alias("method"))
    return out.select(id_col, "host", "path", F.col("base.label").alias("rule"), "patterns",
                      F.coalesce("base.action", "method.action", F.lit(default)).alias("verdict"))
