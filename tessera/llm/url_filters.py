"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, local_rows, pages, quoted

#: Hexadecimal digits of the short prefix that the equi-join uses.
PREFIX_DIGITS = 8
#: Bytes of the rules' expressions up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Parts over which the expressions of a frequent short digest are dealt where rules aren't broadcast.
SALTS = 16
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased, with any user and port) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return local_rows(spark, list(rules), "verdict string, rule_host string, rule_path string")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows of ``urls`` with host, path, rule and verdict.

    A url becomes one expression for each of its host suffixes (no more labels than any rule has) and each prefix of
    its path whose length some rule's path has. Expressions meet the rules on a short prefix of their SHA-256; equal
    full digests confirm. The longest rule wins, then the one with the longer host, then block. Matching is done once
    for each different url that has an expression, so a frequent url costs no more than a rare one. Rules of more than
    BROADCAST_BYTES are joined by shuffling, each repeated for SALTS parts, as a suffix like ``com`` is in most urls.

    Null or malformed urls have an empty host and path and get the default; urls of any length are judged whole;
    repeated rows are judged alike; an empty table, or no rules, gives no matches; columns of the input named host,
    path, rule or verdict are replaced, and other names of columns don't matter.
    """
    keep = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    own = fresh(keep, "host", "path", "k_host", "k_path", "won")
    host, path = host_and_path(quoted(url)[0])
    frame = urls.select(*quoted(*keep), host.alias(own["host"]), path.alias(own["path"]))
    labels = F.size(F.split("rule_host", "\\."))
    weight = F.octet_length("rule_host") + F.octet_length("rule_path") + 128
    shape = rules.agg(F.max(labels).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths"), F.sum(weight).alias("bytes")).first()
    lengths = F.array(*[F.lit(x) for x in sorted(shape["lengths"])]) if shape["lengths"] else F.array().cast("array<int>")
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\0"), p), 256)
    known = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL").select(
        F.col("verdict").alias("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_length"),
        digest(F.col("rule_host"), F.col("rule_path")).alias("full"),
    ).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(shape["labels"] or 1))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        frame.where(F.col(own["host"]) != "").select(F.col(own["host"]).alias("host"), F.col(own["path"]).alias("path")).distinct()
        .withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    if (shape["bytes"] or 0) <= BROADCAST_BYTES:
        found = expressions.join(F.broadcast(known), "short")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(known.withColumn("salt", salts), ["short", "salt"])
    best = F.max_by(F.struct("rule", F.col("rule_verdict")), F.struct(F.length("rule"), "host_length", F.col("rule_verdict")))
    won = found.where("digest = full").groupBy(F.col("host").alias(own["k_host"]), F.col("path").alias(own["k_path"])).agg(best.alias(own["won"]))
    same = (F.col(own["host"]) == F.col(own["k_host"])) & (F.col(own["path"]) == F.col(own["k_path"]))
    return frame.join(won, same, "left").select(
        *quoted(*keep), F.col(own["host"]).alias("host"), F.col(own["path"]).alias("path"), F.col(f"{own['won']}.rule").alias("rule"), F.coalesce(f"{own['won']}.rule_verdict", F.lit(default)).alias("verdict")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(pages(spark, sf_dir).select("page_id", "url"), rules_frame(spark)).drop("url")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r(verdict, h, f) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT q.page_id, q.host, q.path, r.h || r.f AS rule, r.verdict,
         row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.h || r.f) DESC NULLS LAST, length(r.h) DESC, r.verdict DESC) AS n
  FROM q LEFT JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.f)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
