"""URL filters by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could be written as, the expressions meet the rules in an equi-join on a
short prefix of their SHA-256 digest, and the full digest, the rest of the rule's path and the precedence of rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Host, path and action of the production rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The verdict on a URL that no rule fits.
DEFAULT_VERDICT = "allow"
#: Hexadecimal digits of a short hash prefix: 32 bits.
SHORT = 8


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])
    return spark.range(1).select(F.inline(rows))


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null and for a url without ://."""
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """From the end of the host up to ? or #."""
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def anchored(host: Column, path: Column) -> Column:
    """The expression of a rule: its host, and its path up to the last slash."""
    return F.concat(host, F.regexp_extract(path, "^(?s:.*)/", 0))


def expand(urls: DataFrame, max_labels: int, max_depth: int) -> DataFrame:
    """Add a row for each host suffix of up to max_labels labels and path prefix of up to max_depth slashes (column expr).

    The bounds are those of the rule table, so no expression that a rule could have is left out, while the expansion of a
    URL with thousands of labels or slashes stays as small as the rules are.
    """
    urls = urls.withColumn("labels", F.split("host", "\\."))
    labels, n = F.col("labels"), F.size("labels")
    suffix = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_labels))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    depth = F.size(F.split("path", "/")) - 1
    prefix = F.transform(F.sequence(F.lit(0), F.least(depth, F.lit(max_depth))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), i), F.lit("/"))))
    return urls.withColumn("suffix", F.explode(suffix)).withColumn("prefix", F.explode(prefix)).withColumn("expr", F.concat("suffix", "prefix")).drop("suffix", "prefix", "labels")


def judge_urls(pages: DataFrame, rules: DataFrame, broadcast_rules: int = 500_000, salts: int = 64) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages; repeated rows stay repeated.

    A rule fits its host and all subdomains when the path starts with the rule's path. The longest rule (host and path
    together) wins, then the longer host, then block. A null url, or one without ://, has an empty host and path, and no rule
    fits it. Rules with a null field are ignored. Up to broadcast_rules rules (counted first) are broadcast; above that the
    join shuffles, with the expressions salted and the rules repeated for each salt, as every URL of a top-level domain
    shares an expression.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "action").dropna().distinct()
    n_rules, max_labels, max_depth = rules.agg(F.count("*"), F.max(F.size(F.split("host", "\\."))), F.max(F.size(F.split("path", "/")) - 1)).first()
    urls = pages.select("page_id", "url").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    keyed = rules.select(
        F.sha2(anchored(F.col("host"), F.col("path")), 256).alias("rule_digest"),
        F.col("path").alias("rule_path"),
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("action") == "block").alias("is_block"),
            F.concat("host", "path").alias("rule"),
            F.col("action").alias("verdict"),
        ).alias("found"),
    ).withColumn("short", F.substring("rule_digest", 1, SHORT))
    parts = expand(urls, max_labels or 1, max_depth or 0).withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, SHORT)).drop("expr")
    on = ["short"]
    if n_rules <= broadcast_rules:
        keyed = F.broadcast(keyed)
    else:
        keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        on = ["short", "salt"]
    hits = parts.join(keyed, on).where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", F.col("rule_path")))
    best = hits.groupBy("page_id", "url").agg(F.max("found").alias("found"))
    rows = urls.groupBy("page_id", "url", "host", "path").agg(F.count("*").alias("n"))
    joined = rows.alias("r").join(best.alias("b"), F.col("r.page_id").eqNullSafe(F.col("b.page_id")) & F.col("r.url").eqNullSafe(F.col("b.url")), "left")
    return joined.select(
        F.col("r.page_id").alias("page_id"),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"),
    ).drop("copy")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rhost, rpath, action)),
m AS (
  SELECT s.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM s LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""

QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": ORACLE}
