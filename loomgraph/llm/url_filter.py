"""URL filter: wildcard rules, indexed by their rarest literal token.

A rule is `||host/path` (host and its subdomains, path prefix) or a plain pattern that may occur
anywhere; `*` stands for any run and `^` for a separator or the end. A rule's literal tokens are
those alphanumeric runs of its text that must be whole tokens in every url it fits. The rule is
filed under the one that fewest urls hold (ties: the alphabetically first), or under the empty
token, which every url holds, if it has none. A url's tokens fetch the candidate rules by an
equality join; the regular expression runs for those alone.

Among host rules the longest wins and beats every pattern; among patterns an allow rule beats a
block rule, then the longest, then the alphabetically last wins; with none the url is allowed.
Null urls, or those without `://`, have empty host and path and are allowed. Letters of other
alphabets, such as the Kelvin sign, aren't folded to A-Z. Repeated rows stay repeated, and an empty
table gives no rows. Each url is judged whole: a very long one has many tokens, a row each while
candidates are fetched. No input column but id and url is read, so clashing extra columns don't matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower

#: (verdict, rule): host rules, written as host and path.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: (verdict, pattern): used where no host rule fits.
PATTERN_RULES = (
    ("block", "||m.*/es/"),
    ("block", "^casino^"),
    ("block", "^poker^"),
    ("block", "^porn^"),
    ("block", "^xxx^"),
    ("block", "^login^"),
    ("block", "^signup^"),
    ("block", "^cart^"),
    ("block", "^wp-admin^"),
    ("block", "^calendar^*^day^"),
    ("block", "^search^*^q="),
    ("block", "^sessionid="),
    ("block", "^page=*^ref="),
    ("block", "^print^"),
    ("block", ".zip^"),
    ("block", ".exe^"),
    ("allow", "^page=1^"),
    ("allow", "||docs.*^"),
)
RULE_SCHEMA = "kind string, verdict string, rule string, regex string, tokens array<string>"
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"


def compile_rule(kind: str, rule: str) -> tuple[str, list[str]]:
    """The rule's regular expression over host + rest of url, and its literal tokens."""
    text, anchored = (rule, True) if kind == "host" else (rule[2:], True) if rule.startswith("||") else (rule, False)
    body = "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in text)
    tokens = []
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        before = text[m.start() - 1] if m.start() else ("^" if anchored else "*")
        after = text[m.end()] if m.end() < len(text) else "*"
        if "*" not in (before, after):
            tokens.append(m.group().lower())
    if anchored:
        return r"^(?:[^/?#]*\.)?" + body, tokens
    return body, tokens


def rules_frame(spark, host_rules: Iterable[tuple[str, str]] = HOST_RULES, patterns: Iterable[tuple[str, str]] = PATTERN_RULES) -> DataFrame:
    names = [x.split()[0] for x in RULE_SCHEMA.split(", ")]
    rows = [dict(zip(names, (kind, verdict, rule, *compile_rule(kind, rule)))) for kind, rules in (("host", host_rules), ("pattern", patterns)) for verdict, rule in rules]
    return spark.sql(f"SELECT inline(from_json(:rules, 'array<struct<{RULE_SCHEMA.replace(' string', ': string').replace(' array', ': array')}>>'))", args={"rules": json.dumps(rows)})


def url_parts(url: Column) -> dict[str, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    return {"host": ascii_lower(host), "path": F.regexp_extract(tail, r"(?s)^[^?#]*", 0), "subject": F.concat(ascii_lower(host), tail)}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """Rows (id, host, path, rule, verdict, matched): one per input row."""
    spark = pages.sparkSession
    rules = rules_frame(spark) if rules is None else rules
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    # The verdict is a function of the url alone, so candidates are looked up once per distinct url.
    distinct = urls.select("_url").where(F.col("_url").isNotNull()).distinct()
    subject = distinct.select("_url", url_parts(F.col("_url"))["subject"].alias("subject"))
    tokens = F.array_distinct(F.concat(F.split(ascii_lower(F.col("subject")), "[^a-z0-9]+"), F.array(F.lit(""))))
    held = subject.select("_url", "subject", F.explode(tokens).alias("token"))
    listed = rules.select("kind", "verdict", "rule", "regex", F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit("")))).alias("token"))
    # Document frequency of the rules' own tokens, over every url.
    frequency = held.join(listed.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (
        listed.join(frequency, "token", "left")
        .groupBy("kind", "verdict", "rule", "regex")
        # the empty token is in every url: only a rule without any other is filed there
        .agg(F.min(F.struct(F.col("token") == "", F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    )
    hits = held.join(index, "token").where(F.expr("subject rlike regex"))
    rank = F.struct(F.col("kind") == "host", F.when(F.col("kind") == "host", F.lit(0)).otherwise((F.col("verdict") == "allow").cast("int")), F.length("rule"), F.col("rule"))
    best = hits.groupBy("_url").agg(F.max_by(F.struct("kind", "verdict", "rule"), rank).alias("best"), F.count("*").alias("n_fitting"))
    parts = url_parts(F.col("_url"))
    joined = urls.join(best, "_url", "left")
    return joined.select(
        F.col("_id").alias(id_col),
        parts["host"].alias("host"),
        parts["path"].alias("path"),
        F.when(F.col("best.kind") == "host", F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("best.kind") == "pattern", F.col("best.rule")).alias("pattern"),
    )


def oracle(view: str = "pages") -> str:
    """The same judgement as DuckDB SQL: every rule against every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = [(kind, verdict, rule, compile_rule(kind, rule)[0]) for kind, rules in (("host", HOST_RULES), ("pattern", PATTERN_RULES)) for verdict, rule in rules]
    values = ", ".join(f"({', '.join(map(quote, r))})" for r in rules)
    return f"""
WITH rules(kind, verdict, rule, regex) AS (VALUES {values}),
rest AS (SELECT page_id, url, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {view}),
host AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, url, translate(h, '{LOWER_FROM}', '{LOWER_TO}') AS host, substr(rest, length(h) + 1) AS tail FROM host),
urls AS (SELECT DISTINCT url, host || tail AS subject FROM parts),
best AS (
  SELECT url, kind, verdict, rule FROM urls, rules WHERE regexp_matches(subject, regex)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY kind = 'host' DESC, CASE WHEN kind = 'host' THEN 0 ELSE (verdict = 'allow')::INT END DESC, length(rule) DESC, rule DESC) = 1)
SELECT p.page_id, p.host, regexp_extract(p.tail, '^[^?#]*') AS path,
  CASE WHEN b.kind = 'host' THEN b.rule END AS rule, coalesce(b.verdict, 'allow') AS verdict,
  CASE WHEN b.kind = 'pattern' THEN b.rule END AS pattern
FROM parts p LEFT JOIN best b ON p.url = b.url"""


LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
