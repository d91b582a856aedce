"""URL rules, indexed by their rarest literal token; DataFrame functions only.

A rule is a regular expression over host and path with the literal tokens that every match
holds. Token counts over all URLs name each rule's rarest token, the rule is filed under it,
and a URL's tokens fetch only the rules filed under them; only those run their expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Written

#: Keys among which the URLs are spread that try the rules without a token.
SALT = 64
RULE_SCHEMA = "rule string, action string, pattern string, tokens array<string>, weight long"


#: The token under which rules without one are filed; no URL has it.
_ANY = ""


def _salted(n: Column) -> Column:
    return F.concat(F.lit("?"), n.cast("string"))


def _lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(text: str, action: str) -> tuple:
    """A rule like ``example.com/de/``: its host and subdomains, if the path starts with its path; longer ones win."""
    host, _, path = text.partition("/")
    escaped = re.escape(host.lower()), re.escape("/" + path)
    tokens = sorted(set(re.findall("[a-z0-9]+", host.lower())) | set(re.findall(r"(?<=/)[a-z0-9]+(?=/)", "/" + path)))
    return text, action, rf"^(?:[^/?#]*\.)?{escaped[0]}{escaped[1]}", tokens, len(text) + (1 << 20)


def pattern_rule(name: str, action: str, pattern: str, tokens: list[str]) -> tuple:
    """A rule by expression; ``tokens`` are lower-case literals that every match holds as whole tokens. Host rules outrank it."""
    return name, action, pattern, tokens, len(pattern)


#: The method's own rules, for URLs that no host rule fits.
PATTERNS = [
    pattern_rule("free-bets", "block", r"^(?:[^/]*[.-])?free-bets(?:[.-]|/|$)", ["free", "bets"]),
    pattern_rule("casino", "block", r"(?:^|[./-])casino(?:[./-]|$)", ["casino"]),
    pattern_rule("adult", "block", r"(?:^|[./-])(?i:xxx)(?:[./-]|$)", ["xxx"]),
    pattern_rule("ad-server", "block", r"^(?:[^/]*\.)?ads(?:-[a-z]+)?\.", ["ads"]),
    pattern_rule("tracker", "block", r"^(?:[^/]*\.)?tracker\.", ["tracker"]),
]


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r[:3], list(r[3]), r[4]) for r in rules], RULE_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of text files, one a line with tabs between its fields; a list of any length stays on the executors.

    ``action, host/path`` is a host rule, ``action, name, tokens (comma-joined), expression`` a rule by
    expression. Empty lines and lines that start with ``#`` are skipped; any other line is an error.
    """
    line = F.trim(F.regexp_replace("value", r"\s+$", ""))
    fields = F.split(line, "\t")
    lines = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(fields.alias("f"), line.alias("line"))
    f = F.col("f")
    known = F.size(f).isin(2, 4) & f[0].isin("allow", "block")
    lines = lines.select(F.when(known, f).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), "line"))).alias("f"))
    spec = f[1]
    slash = F.locate("/", spec)
    host = _lower(F.when(slash > 0, F.expr("substring_index(f[1], '/', 1)")).otherwise(spec))
    tail = F.concat(F.lit("/"), F.when(slash > 0, F.expr("substring(f[1], locate('/', f[1]) + 1)")).otherwise(F.lit("")))
    quoted = F.regexp_replace(F.concat(host, tail), r"([^A-Za-z0-9/])", r"\\$1")
    pieces = F.array_union(F.split(host, "[^a-z0-9]+"), F.regexp_extract_all(tail, F.lit(r"(?<=/)([a-z0-9]+)(?=/)")))
    is_host = F.size(f) == 2
    pattern = F.when(is_host, F.concat(F.lit(r"^(?:[^/?#]*\.)?"), quoted)).otherwise(F.try_element_at(f, F.lit(4)))
    tokens = F.when(is_host, pieces).otherwise(F.split(F.lower(F.try_element_at(f, F.lit(3))), ","))
    weight = F.when(is_host, F.length(spec) + F.lit(1 << 20)).otherwise(F.length(F.try_element_at(f, F.lit(4)))).cast("long")
    named = F.array_distinct(F.filter(tokens, lambda t: t != ""))
    return lines.select(spec.alias("rule"), f[0].alias("action"), pattern.alias("pattern"), named.alias("tokens"), weight.alias("weight"))


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with ``token``, the rarest of their tokens in ``urls`` (its column ``tokens``), for ``tokens``; ties go to the first in order."""
    by = [c for c in rules.columns if c != "tokens"]
    of = rules.select(*by, F.explode(F.array_distinct("tokens")).alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).join(of.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    least = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")
    return of.join(seen, "token", "left").groupBy(*by).agg(least)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, the heaviest rule that fits (else null), its weight and the verdict; a row per row.

    A null URL or one without ``://`` has an empty host and path, which only a rule that matches
    the empty text fits. Equal weights: the first rule in order. Repeated rows each get a row.
    Rules without a token are tried on every URL: they are copied to SALT keys and each URL looks
    under one of them, so no key is that of all URLs. Without such rules no URL looks for them.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    text = F.concat("host", "path")
    parsed = parsed.withColumn("tokens", F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")))
    tokens = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(_ANY)))
    # ids that follow a sort are in its order, so the least one that fits is the winning rule's
    ranked = rules.withColumn("tokens", tokens).orderBy(F.desc("weight"), "rule", "action", "pattern")
    rules = Written(ranked.withColumn("order", F.monotonically_increasing_id())).df
    filed = Written(index(rules.select("order", "pattern", "tokens"), parsed)).df
    asked = F.col("tokens")
    if not filed.where(F.col("token") == _ANY).isEmpty():
        copies = F.when(F.col("token") == _ANY, F.transform(F.sequence(F.lit(0), F.lit(SALT - 1)), _salted)).otherwise(F.array("token"))
        filed = filed.withColumn("token", F.explode(copies))
        asked = F.array_append(asked, _salted(F.pmod(F.xxhash64("row"), F.lit(SALT))))
    fetched = parsed.withColumn("token", F.explode_outer(asked)).join(filed, "token", "left")
    fits = F.col("pattern").isNotNull() & F.expr("concat(host, path) rlike pattern")
    best = fetched.groupBy("row", "id", "host", "path").agg(F.min(F.when(fits, F.col("order"))).alias("best"))
    named = rules.select(F.col("order").alias("best"), "rule", "action", "weight")
    return best.join(named, "best", "left").select(F.col("id").alias(id_col), "host", "path", "rule", "weight", F.coalesce("action", F.lit(default)).alias("verdict"))
