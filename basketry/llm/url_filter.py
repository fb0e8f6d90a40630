"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in the common filter-list notation: ``||`` anchors at the start of a host or of one of its parent
domains, ``^`` is a separator (no letter, digit, ``_``, ``-``, ``.`` or ``%``) or the end, ``*`` is any run of characters;
everything else is literal.  A rule's literal tokens are its runs of letters and digits that stand whole in every URL it
fits.  The rarest of them, by the number of the corpus's distinct URLs that hold it, is the rule's only key.  A URL's own
tokens fetch candidate rules in an equi-join, and only those run their regular expression.  Rules without a whole literal
token are keyed by the empty token, which every URL has: they are tried on all URLs.

Of the rules that fit, the longest pattern of the highest rank decides (ties: the smaller pattern); without any, a URL is
allowed.  Matching runs over distinct URLs, so repeated pages cost one match.

Null URLs and URLs without ``://`` have empty host and path and are allowed; repeated rows are each returned; empty tables
give an empty result (no rules: everything is allowed); ``html`` and other columns are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import LOWER, UPPER, ascii_lower, materialise

#: The contract's rules (host, path, verdict).
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The method's own rules: hosts and paths of advertising, tracking, bulk mail, betting and adult sites.
PATTERN_RULES = [
    ("spam-farm.", "block"), ("cheap-pills.", "block"), ("ads-track.", "block"), ("||doubleclick^", "block"),
    ("||adserver.", "block"), ("||ads.", "block"), ("||tracker.", "block"), ("/banner/", "block"), ("/adclick^", "block"),
    ("/popup/", "block"), ("casino^", "block"), ("/phishing/", "block"), ("*.exe^", "block"),
    # ``^`` is no ``-`` and no ``.``: hosts need the separator written out
    ("||doubleclick.", "block"), ("||casino-", "block"), ("||casino.", "block"), ("||free-bet", "block"), ("||bets.", "block"),
    ("||betting.", "block"), ("||betting-", "block"), ("||adult-x", "block"), ("||xxx.", "block"),
]


def regex_of(pattern: str) -> str:
    """Java regular expression of a rule, for ``host + rest of the URL``."""
    head, body = ("^(?:[^/?#]*\\.)?", pattern[2:]) if pattern.startswith("||") else ("", pattern)
    special = {"*": ".*", "^": "(?:[^\\p{L}\\p{N}_.%-]|$)"}
    return head + "".join(special.get(c) or re.sub(r"([^\w])", r"\\\1", c) for c in body)


def literal_tokens(pattern: str) -> list[str]:
    """The runs of letters and digits that must be whole tokens of any URL that the rule fits."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    out = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else ("|" if anchored else "*")
        after = body[m.end()] if m.end() < len(body) else "*"
        if before != "*" and after != "*":
            out.append(m.group().lower())
    return sorted(set(out))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """(rule, action, regex, rank, literals) of (shown name, pattern, action, rank)."""
    rows = [(name, action, regex_of(p), rank, len(p), literal_tokens(p)) for name, p, action, rank in rules]
    return spark.createDataFrame(rows, "rule string, action string, regex string, rank int, width int, literals array<string>")


def default_rules(spark: SparkSession) -> DataFrame:
    hosts = [(f"{h}{p}", f"||{h}{p}", action, 1) for h, p, action in HOST_RULES]
    return rule_table(spark, hosts + [(p, p, action, 0) for p, action in PATTERN_RULES])


def split_url(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased), path, and ``rest``: all that follows the host."""
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(tail, r"^([^/?#]*)", 1)
    rest = F.expr("substring(__tail, length(regexp_extract(__tail, '^([^/?#]*)', 1)) + 1)")
    return {"tail": tail, "host": ascii_lower(host), "path": F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), "rest": rest}


def url_tokens(target: Column) -> Column:
    return F.array_union(F.split(F.lower(target), "[^a-z0-9]+"), F.array(F.lit("")))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with ``token``: the literal that the fewest of ``urls`` (column ``tokens``) hold."""
    literals = rules.select("rule", F.explode_outer("literals").alias("token"))
    # counted in each task before the shuffle, so a token that most URLs hold is no hot key
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").count()
    ranked = literals.join(counts, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    key = ranked.groupBy("rule").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    return rules.drop("literals").join(key, "rule").withColumn("token", F.coalesce("token", F.lit("")))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (of rank 1, else null), verdict, matched (the rule that decided, if any)."""
    parts = split_url(F.col("url"))
    urls = pages.select("url").filter("url is not null").distinct().withColumn("__tail", parts["tail"])
    urls = urls.withColumn("target", F.concat(parts["host"], parts["rest"])).filter("target != ''")
    urls = materialise(urls.select("url", "target", url_tokens(F.col("target")).alias("tokens")), "url_tokens")
    index = materialise(index_rules(rules, urls), "url_rules")
    fits = (
        urls.select("url", "target", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.expr("target rlike regex"))
        .groupBy("url")
        .agg(F.min(F.struct(-F.col("rank"), -F.col("width"), "rule", "action", "rank")).alias("best"))
    )
    best = F.col("best.rule")
    return (
        pages.select("page_id", "url")
        .join(fits, "url", "left")
        .select(
            "page_id",
            parts["host"].alias("host"),
            parts["path"].alias("path"),
            F.when(F.col("best.rank") == 1, best).alias("rule"),
            F.coalesce("best.action", F.lit("allow")).alias("verdict"),
            best.alias("matched"),
        )
    )


def oracle_sql() -> str:
    """The same judgement in DuckDB, with every rule tried on every URL."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    rules = [(f"{h}{p}", f"||{h}{p}", action, 1) for h, p, action in HOST_RULES] + [(p, p, a, 0) for p, a in PATTERN_RULES]
    rows = ", ".join(f"({quote(n)}, {quote(regex_of(p))}, {quote(a)}, {k}, {len(p)})" for n, p, a, k in rules)
    return f"""
with rules(rule, regex, action, rank, width) as (values {rows}),
tails as (select *, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') as tail from pages),
parts as (
  select *, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path,
         substr(tail, length(regexp_extract(tail, '^([^/?#]*)', 1)) + 1) as rest
  from tails),
targets as (select distinct url, host || rest as target from parts where url is not null and host || rest <> ''),
ranked as (
  select url, rule, action, rank, row_number() over (partition by url order by rank desc, width desc, rule) as n
  from targets join rules on regexp_matches(target, regex))
select page_id, host, path, case when rank = 1 then rule end as rule, coalesce(action, 'allow') as verdict, rule as matched
from parts left join (select * from ranked where n = 1) as best using (url)"""
