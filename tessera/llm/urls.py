"""URL filters: host and path rules, and a blocked Bloom filter before an exact join with a list of canonical URLs.

The list's canonical URLs are hashed into blocks of 256 bits (four longs); each sets one bit in every long of its block,
so a probe reads one row of the filter. Rows that pass are possible hits, and an exact join on the canonical URL removes
false positives.

Scale. DataFrame functions only. The filter has as many blocks as the list needs, up to ``most_blocks``; it is broadcast
under that bound, and a longer list costs more false positives, never a wrong verdict. Only possible hits are shuffled.
The join's list side has one row for each URL; Spark splits the other side where one URL is very frequent.

Canonical form: scheme dropped, host lower-cased without port, ``www.`` and ``m.``, path without a last slash and
``index.html``, tracking parameters and fragment dropped, other parameters in their order. Null or malformed URLs (no
``://``) have an empty host and path, no rule, and are not in any list. Rules are (host, path, verdict): a rule fits its
host and subdomains and paths that start with its own; the longest host + path wins. Ties between rules of one length
go to the first in alphabetical order. Repeated rows are judged alike, extra columns ignored, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: The registered query's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Canonical form of a URL; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":\d*$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    asked = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    return F.when(host != "", F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")))


def rule_of(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=False):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w3 of the column ``canonical`` of ``listed``."""
    masks = [m.alias(f"m{i}") for i, m in enumerate(_bits(F.col("canonical")))]
    return listed.select(_block(F.col("canonical"), blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])


def listed_pages(pages: DataFrame, listed: DataFrame, most_blocks: int = 1 << 16) -> DataFrame:
    """``pages`` (with ``canonical``) and a boolean ``listed``; ``listed`` has one row for each canonical URL."""
    n = listed.count()
    blocks = min(most_blocks, 1 << max(4, (n // 16).bit_length()))
    x = pages.withColumn("_block", _block(F.col("canonical"), blocks))
    filt = blocked_bloom(listed, blocks).withColumnRenamed("block", "_block")
    x = x.join(F.broadcast(filt), "_block", "left")
    hit = F.lit(True)
    for i, m in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    x = x.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_block", "w0", "w1", "w2", "w3")
    sure = listed.select("canonical", F.lit(True).alias("listed"))
    exact = x.where("_hit").join(F.broadcast(sure) if n <= most_blocks else sure, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return x.where("not _hit").withColumn("listed", F.lit(False)).unionByName(exact).drop("_hit")


def url_verdicts(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed."""
    url = F.col("url")
    x = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    x = listed_pages(x, listed.select("canonical").where("canonical is not null").distinct()).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return x.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")


#: Families of junk hosts; a host is of a family if one of its labels starts with the name.
JUNK_FAMILIES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam")


def junk_list(pages: DataFrame, families: tuple[str, ...] = JUNK_FAMILIES) -> DataFrame:
    """canonical, family: a list for those who have none, of the canonical URLs of pages on hosts of the families."""
    family = F.coalesce(*[F.when(host_of(F.col("url")).rlike(rf"(^|\.){name}"), name) for name in families])
    found = pages.select(canonical(F.col("url")).alias("canonical"), family.alias("family")).where("canonical is not null and family is not null")
    return stage(found.groupBy("canonical").agg(F.min("family").alias("family")), "listed")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """canonical: a list from a text file of URLs, one a line; empty lines and lines that start with # are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and url not like '#%'")
    whole = F.when(F.contains("url", F.lit("://")), F.col("url")).otherwise(F.concat(F.lit("http://"), F.col("url")))
    return lines.select(canonical(whole).alias("canonical")).where("canonical is not null").distinct()


def op7_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, junk_list(pages))


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, strpos(url, '://') AS p FROM pages
), r AS (
  SELECT page_id, url, CASE WHEN p > 0 THEN substr(url, p + 3) END AS rest FROM u
), h AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') AS query
  FROM r
), q AS (
  SELECT page_id, host, path,
         regexp_replace(regexp_replace(host, ':\d*$', ''), '^(www|m)\.', '') AS bare,
         regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') AS short,
         list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')) AS asked
  FROM h
), c AS (
  SELECT page_id, host, path, CASE WHEN bare <> '' THEN bare || short || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM q
), l AS (
  SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam)') AND canonical IS NOT NULL
), m AS (
  SELECT c.*, l.canonical IS NOT NULL AS listed,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.canonical
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       canonical, listed
FROM m
"""
