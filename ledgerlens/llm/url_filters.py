"""URL filters: host-suffix and path-prefix expressions, equi-joined to rules on short hash prefixes.

Each distinct URL is expanded into (host suffix, path cut after a slash)
expressions, as deep as the rules go. The join key is the first eight hex
digits of an expression's SHA-256; the full digest confirms, then the rule's
whole path. The longest fitting rule wins; of equally long ones ``block``
wins, then the smaller text.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and gets the default verdict; repeated URLs are judged once and keep all their
rows; a rule with a null or empty host is ignored and a null path is empty;
an empty rule or page table is allowed; other page columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, table

DEFAULT_VERDICT = "allow"
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the digest of their host and of their path up to its last slash."""
    r = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).filter("rule_host <> ''").distinct()
    folder = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0)
    return r.withColumn("digest", _expression(F.col("rule_host"), folder)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)).withColumn("depth", F.length(F.regexp_replace("rule_path", "[^/]+", ""))).withColumn("labels", F.size(F.split("rule_host", r"\.")))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule (host and path of the rule that decides, else null), verdict."""
    r = rule_table(rules)
    deepest = r.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.coalesce(F.max("labels"), F.lit(0)).alias("labels")).first()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    urls = rows.select("url").filter("url IS NOT NULL").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, deepest["labels"])))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    # path pieces, each with its slash: the prefixes are '' and what comes after each slash
    pieces = F.regexp_extract_all("path", F.lit("([^/]*/)"), F.lit(1))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(pieces), F.lit(deepest["depth"]))), lambda k: F.array_join(F.slice(pieces, 1, k), ""))
    wide = urls.select("url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("url", "path", "suffix", F.explode("prefixes").alias("prefix"))
    keyed = wide.withColumn("full", _expression(F.col("suffix"), F.col("prefix"))).select("url", "path", "full", F.substring("full", 1, PREFIX_DIGITS).alias("short"))
    hit = keyed.join(r, "short").filter(F.col("full") == F.col("digest")).filter(F.startswith("path", F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(name).alias("n"), (F.col("rule_verdict") == "block").alias("b"), F.reverse(name).alias("t"))
    best = hit.groupBy("url").agg(F.max_by(F.struct(name.alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("best"))
    return rows.join(best, "url", "left").select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules that the query op8 is asked to apply.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).drop("url")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p), r
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
