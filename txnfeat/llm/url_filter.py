"""URL filters: allow and block rules of a host and a path prefix.

Each url is expanded into the host-suffix and path-prefix expressions that a rule of the list could have; these meet
the rules in an equi-join on the first 32 bits of their SHA-256, are confirmed by the whole digest, and the longest
rule wins. Equal (host, path) pairs are judged once, so a hot host or url costs no more than a rare one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join uses.
PREFIX = 8
#: A rule list up to this many rows (under 20 MB) is broadcast; a longer one is joined by a salted shuffle.
BROADCAST_RULES = 100_000
SALTS = 16

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? #, with A-Z lower-cased; empty for null and where :// is missing."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url; other columns are left out).

    rules: verdict, host, path; null hosts or paths never fit. A rule fits its host and all its subdomains where the
    url's path starts with the rule's path; of several, the longest wins, of equal ones block. Where none fits, rule
    is null and the verdict is `default`. A null url has an empty host and path; repeated rows stay."""
    rules = (
        rules.where("host is not null and path is not null")
        .select(F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), "verdict")
        .groupBy("rule", "labels", "chars").agg(F.max_by("verdict", F.col("verdict") == "block").alias("verdict"))
        .withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    )
    # As many shapes as host depths times path lengths in the rules: at most 127 times the longest path, whatever the number of rules.
    shapes = [tuple(r) for r in rules.select("labels", "chars").distinct().collect()]
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # One expression over an array of the shapes, of which each url takes those that its path is long enough for.
    listed = ", ".join(f"named_struct('labels', {labels}, 'chars', {chars})" for labels, chars in sorted(shapes))
    expressions = F.expr(f"transform(filter(array({listed}), s -> s.chars <= length(path)), s -> concat(substring_index(host, '.', -s.labels), substring(path, 1, s.chars)))")
    asked = (
        judged.select("host", "path").distinct()
        .select("host", "path", F.explode(F.array_distinct(expressions)).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("asked"))
    )
    on = F.substring("asked", 1, PREFIX) == F.col("prefix")
    if rules.count() <= broadcast_rules:
        found = asked.join(F.broadcast(rules), on)
    else:
        salted = rules.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        found = asked.withColumn("salt_", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("salt_") == F.col("salt")))
    best = (
        found.where("asked = digest").groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = """
with parts as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), judged as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(verdict, h, p) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best as (
  select page_id, host, path, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from judged join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by page_id, host, path
)
select j.page_id, j.host, j.path, b.rule, coalesce(b.verdict, 'allow') as verdict
from judged j left join best b on j.page_id = b.page_id and j.host = b.host and j.path = b.path
"""
