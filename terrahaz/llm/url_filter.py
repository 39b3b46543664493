"""URL filter: rules indexed by their rarest literal token.

Host rules (a host with a path prefix) and pattern rules (regular expressions
with at least one literal token) are turned into an index ``token -> rules``.
The token chosen for a rule is the one among its literals that the fewest URLs
hold.  A URL's tokens fetch its candidate rules; only those are evaluated.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the contract: (verdict, host, path)
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# fixed values: words that, whole between dots and hyphens of a host, tell what it serves
JUNK_WORDS = (
    "ads", "adult", "adware", "bet", "bets", "betting", "bingo", "casino", "clickbait", "dating", "escort", "escorts",
    "gambling", "jackpot", "loans", "lottery", "malware", "payday", "phishing", "pills", "poker", "popunder", "porn",
    "roulette", "sex", "slots", "spam", "spyware", "torrents", "track", "tracker", "tracking", "viagra", "warez", "xxx",
)
# (verdict, regular expression, its literal tokens); tried on host and path together
PATTERN_RULES = (
    *[("block", rf"^([^/]*[.-])?{word}[.-]", (word,)) for word in JUNK_WORDS],
    ("block", r"^[^/]*/(wp-login|xmlrpc)\.php", ("php",)),
    ("block", r"^[^/]*/.*\badult\b", ("adult",)),
)
TOKEN = r"[a-z0-9]+"
MAX_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, path)), F.lit(TOKEN), F.lit(0)))


def token_counts(urls: DataFrame, host_rules, pattern_rules) -> dict[str, int]:
    """How many URLs hold each literal of the rules (one number per rule token reaches the driver)."""
    literals = sorted({t for _, host, path in host_rules for t in re.findall(TOKEN, host + path.lower())}
                      | {t for *_, ts in pattern_rules for t in ts})
    if len(literals) > MAX_RULES:
        raise ValueError(f"{len(literals)} rule tokens; at most {MAX_RULES} are supported")
    held = urls.select(F.explode("tokens").alias("token")).where(F.col("token").isin(literals))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES,
                default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every row: id, host, path, rule, verdict, pattern.

    A host rule fits its host and every subdomain when the path starts with the
    rule's path (case counts); the longest fitting rule (by its text, host and
    path; ties: the first in order of text) decides.  Without one, the first
    fitting pattern rule decides, else ``default``.  Null urls and urls without
    ``://`` have empty host and path, and get ``default``.  Repeated rows are
    judged one by one; an empty table gives an empty result; other columns of
    the input are not looked at.
    """
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counts = token_counts(urls.select(tokens_of(F.col("host"), F.col("path")).alias("tokens")), host_rules, pattern_rules)

    def rarest(literals):
        return min(literals, key=lambda t: (counts.get(t, 0), t))

    index: dict[str, list[tuple]] = {}
    for verdict, host, path in host_rules:
        index.setdefault(rarest(re.findall(TOKEN, host + path.lower())), []).append(("host", verdict, host, path))
    for n, (verdict, pattern, literals) in enumerate(pattern_rules):
        index.setdefault(rarest(literals), []).append(("pattern", verdict, n, pattern))
    compiled = {p: re.compile(p) for _, p, _ in pattern_rules}
    splitter = re.compile(TOKEN)

    def judge(host: str, path: str) -> tuple:
        best, pattern = None, None
        for token in set(splitter.findall((host + path).lower())):
            for kind, verdict, a, b in index.get(token, ()):
                if kind == "host":
                    if path.startswith(b) and (host == a or host.endswith("." + a)):
                        key = (-len(a + b), a + b, verdict)
                        best = key if best is None or key < best else best
                elif (pattern is None or a < pattern[0]) and compiled[b].search(host + path):
                    pattern = (a, b, verdict)
        if best:
            return best[1], best[2], None
        return (None, pattern[2], pattern[1]) if pattern else (None, default, None)

    @F.pandas_udf("rule string, verdict string, pattern string")
    def verdicts(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(h, p) for h, p in zip(host, path, strict=True)],
                            columns=["rule", "verdict", "pattern"], dtype=object)

    return urls.withColumn("_v", verdicts("host", "path")).select(id_col, "host", "path", "_v.*")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
with u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), j as (
  select *,
    case when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
    coalesce('^([^/]*[.-])?' || list_filter(
        ['ads', 'adult', 'adware', 'bet', 'bets', 'betting', 'bingo', 'casino', 'clickbait', 'dating', 'escort', 'escorts',
         'gambling', 'jackpot', 'loans', 'lottery', 'malware', 'payday', 'phishing', 'pills', 'poker', 'popunder', 'porn',
         'roulette', 'sex', 'slots', 'spam', 'spyware', 'torrents', 'track', 'tracker', 'tracking', 'viagra', 'warez', 'xxx'],
        lambda word: list_contains(regexp_split_to_array(host, '[.-]')[:-2], word))[1] || '[.-]',
        case when regexp_matches(host || path, '^[^/]*/(wp-login|xmlrpc)\.php') then '^[^/]*/(wp-login|xmlrpc)\.php'
             when regexp_matches(host || path, '^[^/]*/.*\badult\b') then '^[^/]*/.*\badult\b' end) as pattern
  from u
)
select page_id, host, path, rule,
       case rule when 'net/' then 'block' when 'example.com/de/' then 'block'
                 when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
                 else case when pattern is null then 'allow' else 'block' end end as verdict,
       case when rule is null then pattern end as pattern
from j
"""
