"""URL filters: rules indexed by their rarest literal token.

A rule is either a host and path prefix with its own verdict, or a glob over host and path that blocks. Each rule becomes
a regular expression plus the literal tokens every fitting URL must hold. The token that is rarest among the URLs at hand
keys the rule; a URL's tokens fetch the candidate rules, and only those run their expression. Rules without a literal
token sit under the empty token, which every URL has. Rules are a table of any size. DataFrame functions only.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.llm.common import ascii_lower, cut

#: Up to this many rules, counted, the index is broadcast; beyond it it is joined by shuffle.
BROADCAST_RULES = 200_000

# The rules that the query is asked to judge by, (host, path, verdict).
PREFIX_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Globs over host and path for URLs that no prefix rule fits.
BLOCK_GLOBS = ("*spam-farm.*", "*cheap-pills.*", "*/casino/*", "*/porn/*", "*.xxx/*", "*/wp-login.php*", "*free-download.*", "*click-bait.*")


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    tokens: tuple[str, ...]
    prefix: bool
    verdict: str


def whole_tokens(literal: str, open_start: bool, open_end: bool) -> tuple[str, ...]:
    """Alphanumeric runs that a URL holds as whole tokens; a run at an open end may be part of a longer one."""
    runs = [m for m in re.finditer("[a-z0-9]+", literal.lower())]
    return tuple(m[0] for m in runs if not (open_start and m.start() == 0) and not (open_end and m.end() == len(literal)))


def quoted(literal: str) -> str:
    """As a Java expression that fits the literal alone."""
    return re.sub(r"[^A-Za-z0-9\s]", lambda m: f"\\{m[0]}", literal) if literal.isascii() else "".join(f"\\x{{{ord(c):x}}}" for c in literal)


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    regex = f"^(?:[^/]*\\.)?{quoted(host)}{quoted(path)}"
    return Rule(host + path, regex, whole_tokens(host + path, False, True), True, verdict)


def glob_rule(glob: str) -> Rule:
    parts = glob.split("*")
    regex = "(?s)^" + ".*".join(map(quoted, parts)) + "\\z"
    tokens = tuple(t for i, p in enumerate(parts) for t in whole_tokens(p, i > 0, i < len(parts) - 1))
    return Rule(glob, regex, tokens, False, "block")


DEFAULT_RULES = tuple(prefix_rule(*r) for r in PREFIX_RULES) + tuple(map(glob_rule, BLOCK_GLOBS))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first :// and the next /, ? or #, lower-cased; path from there to ? or #. Both empty without ://."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


RULE = "array<struct<name:string,regex:string,tokens:array<string>,prefix:boolean,verdict:string>>"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(name, regex, tokens, prefix, verdict) of rules given as Python objects."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), RULE)))


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, regex, prefix, size, name, verdict) of rules; key is the rule's token that is rarest among tokens (token), or the empty one."""
    each = rules.select(F.struct("regex", "prefix", F.length("name").alias("size"), "name", "verdict").alias("rule"), F.explode_outer("tokens").alias("wanted"))
    wanted = cut(each.where("wanted is not null").select("wanted").distinct())
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_RULES else wanted
    counts = tokens.join(small, F.col("token") == F.col("wanted"), "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    met = each.join(counts, F.col("wanted") == F.col("token"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.groupBy("rule").agg(F.coalesce(F.min_by("wanted", F.struct("n", "wanted")), F.lit("")).alias("key")).select("key", "rule.*")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = DEFAULT_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of pages (page_id, url).

    rules are Rule objects or a table (name, regex, tokens, prefix, verdict); repeated rules count once. The longest fitting
    prefix rule decides; without one the longest fitting glob blocks; else the verdict is allow. A null url has an empty host
    and path, so only globs that fit the empty string reach it. Repeated rows are judged each, very long urls whole. An
    empty rule list allows everything. rule is null unless a prefix rule decided, pattern unless a glob did. Other columns
    are ignored.
    """
    host, path = host_and_path(F.col("url"))
    site = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("address", F.concat("host", "path"))
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("address"), "[^a-z0-9]+")))
    site = site.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode(tokens))
    index = cut(indexed(rules, site.select("token").where(F.col("token") != ""))).withColumnRenamed("verdict", "its_verdict")
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    fits = F.when(F.col("key").isNotNull() & F.rlike(F.col("address"), F.col("regex")), F.struct("prefix", "size", "name", "its_verdict"))
    best = site.join(index, F.col("token") == F.col("key"), "left").groupBy("row").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), F.max(fits).alias("best"))
    return best.select(
        "page_id", "host", "path", F.when(F.col("best.prefix"), F.col("best.name")).alias("rule"),
        F.coalesce("best.its_verdict", F.lit("allow")).alias("verdict"), F.when(~F.col("best.prefix"), F.col("best.name")).alias("pattern"),
    )


def glob_sql(glob: str) -> str:
    return glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def oracle() -> str:
    """DuckDB SQL that tries every rule on every url."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in PREFIX_RULES)
    globs = ", ".join(f"('{g}', '{glob_sql(g)}')" for g in BLOCK_GLOBS)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {rules}) AS t(rh, rp, rv)), g AS (SELECT * FROM (VALUES {globs}) AS t(pattern, pat)),
m AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n),
b AS (SELECT n, arg_max(pattern, (length(pattern), pattern)) AS pattern FROM s JOIN g ON (host || path) LIKE pat ESCAPE '\\' GROUP BY n)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM s LEFT JOIN m USING (n) LEFT JOIN b USING (n)"""
