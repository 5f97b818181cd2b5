"""URL filters: rules indexed by their rarest literal token.

Every rule has literal tokens (host labels, path words) and a regular expression. The
index holds each rule under the one of its tokens that the URLs at hand hold least
often. A URL is cut into its distinct tokens, each token fetches the rules filed under
it, and only those rules run their regular expressions. Of the host-and-path rules
that fit, the longest decides; where none fits, pattern rules decide (block where one
fits), else the verdict is allow.

A rule list of up to ``INDEX_ROWS`` rows is carried as one literal map, so the whole
lookup is a projection over the scan, without a shuffle. A longer list is a table:
each distinct URL is judged once by a join on the token and joined back.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed; repeated rows are judged alike; an empty table gives no rows; only
the id and URL columns are read, whatever else the table holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

INDEX_ROWS = 2_000
#: Host-and-path rules: the host with its subdomains, then the start of the path.
PATH_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words that block a URL to which no host-and-path rule fits, as whole tokens.
BLOCK_WORDS = ("adult", "casino", "porn", "warez", "xxx")
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """A rule over ``host`` + ``path``; of those that fit, the highest rank, then the first text, decides."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    named: bool


def path_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    host = host.lower()
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # the path's last word may go on in the URL, so only words that end inside the rule are literal tokens
    words = re.findall(TOKEN + r"(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", path.lower())
    return Rule(text, verdict, regex, tuple(re.findall(TOKEN, host)) + tuple(words), len(text), True)


def word_rule(word: str) -> Rule:
    edge = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return Rule(word, "block", rf"(?i)(?:^|{edge}){re.escape(word)}(?:{edge}|$)", (word,), -1, False)


def default_rules() -> list[Rule]:
    return [path_rule(*r) for r in PATH_RULES] + [word_rule(w) for w in BLOCK_WORDS]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, F.lit(" "), path)), F.lit(TOKEN), F.lit(0)))


def rarest(rules: list[Rule], urls: DataFrame) -> dict[str, list[Rule]]:
    """Rules by the token of theirs that the fewest rows of urls(host, path) hold. Collects one count for each token of the rules."""
    held = sorted({t for r in rules for t in r.tokens})
    seen = urls.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token")).filter(F.col("token").isin(held))
    counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"the rule {rule.text!r} has no literal token")
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index


def _literal(rule: Rule) -> Column:
    fields = {"rank": rule.rank, "text": rule.text, "verdict": rule.verdict, "regex": rule.regex, "named": rule.named}
    return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])


def _first(fits: Column) -> Column:
    """Highest rank first; equal ranks by the rule's text."""
    return F.get(F.array_sort(fits, lambda a, b: F.when(a["rank"] != b["rank"], F.when(a["rank"] > b["rank"], -1).otherwise(1)).otherwise(
        F.when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))), F.lit(0))


def judge(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", index_rows: int = INDEX_ROWS) -> DataFrame:
    """pages' columns but those named as the results, with host, path, rule and verdict."""
    rules = default_rules() if rules is None else rules
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    (best_,) = work.free_names(pages, "best")
    split = pages.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not rules:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    index = rarest(rules, split)
    if len(rules) <= index_rows:
        entries = F.map_from_arrays(
            F.array(*[F.lit(t) for t in index]), F.array(*[F.array(*[_literal(r) for r in rs]) for rs in index.values()])
        )
        wanted = F.array(*[F.lit(t) for t in index])
        hits = F.array_intersect(tokens_of(F.col("host"), F.col("path")), wanted)
        candidates = F.flatten(F.transform(hits, lambda t: entries[t]))
        address = F.concat("host", "path")
        judged = split.withColumn(best_, _first(F.filter(candidates, lambda r: F.rlike(address, r["regex"]))))
    else:
        table = pages.sparkSession.createDataFrame(
            [(t, r.rank, r.text, r.verdict, r.regex, r.named) for t, rs in index.items() for r in rs],
            "token string, rank int, text string, verdict string, regex string, named boolean",
        )
        each = split.select("host", "path").distinct()
        pairs = each.withColumn("token", F.explode(tokens_of(F.col("host"), F.col("path")))).join(table, "token")
        fits = pairs.filter(F.expr("concat(host, path) rlike regex"))
        best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rank", "text", "verdict", "regex", "named"), F.struct(-F.col("rank"), "text")).alias(best_))
        judged = split.join(work.written(best, "url-verdicts"), ["host", "path"], "left")
    best = F.col(best_)
    return judged.select(
        *rest, "host", "path",
        F.when(best["named"], best["text"]).alias("rule"),
        F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rule, rhost, rpath) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fitting AS (
  SELECT p.*, r.verdict, r.rule FROM parts p LEFT JOIN rules r
    ON ('.' || p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule) AS place FROM fitting
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN list_has_any(regexp_extract_all(lower(host || ' ' || path), '[a-z0-9\\x80-\\x{10FFFF}]+'),
         ['adult', 'casino', 'porn', 'warez', 'xxx']) THEN 'block' ELSE 'allow' END) AS verdict
FROM best WHERE place = 1
"""
