"""Operator 6: URL filters by host-suffix and path-prefix expressions, DataFrame functions only.

Each distinct (host, path) is expanded into every host suffix joined with every path prefix whose length some rule has. Expressions
meet rules in an equi-join on a short hash prefix (four bytes of SHA-256); full digests confirm the match, and of the confirmed rules
the longest wins. Suffixes have no more labels than the longest host of a rule, so a host of any length has few. Rules are broadcast only when they are measured
to hold at most ``BROADCAST_BYTES``; beyond that the join shuffles, on expressions that are first made distinct, so a suffix shared by many URLs is
one row. Verdicts come back to the rows in a join on the URL; those of the ``FREQUENT`` most frequent URLs, found by a Misra-Gries summary, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import materialise, only_columns

#: Rules are broadcast up to so many bytes of hosts and paths (100 are added for each rule's digest and verdict); more are joined by a shuffle.
BROADCAST_BYTES = 100_000_000
#: URLs whose verdicts are broadcast to their rows (their hosts and paths are cut to hashes there).
FREQUENT = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``urls`` (host, path) -> distinct ``host, path, rule, verdict``.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains when the path starts with the rule's path. The
    longest rule (host and path together) wins; of equally long ones the longer host, then ``block`` before ``allow``. URLs
    without a rule get ``default`` and a null rule. Rules with a null field are left out; an empty rules table gives defaults only.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna().distinct()
    rules = rules.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", _short(F.col("rule_digest")))
    held = F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 100)
    said = rules.agg(F.coalesce(held, F.lit(0)), F.array_sort(F.collect_set(F.length("rule_path"))), F.max(F.size(F.split("rule_host", r"\.")))).head()  # a length occurs once: at most the longest path's length of them
    n_bytes, lengths, most_labels = said[0], said[1] or [0], said[2] or 1

    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    fitting = F.filter(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        places.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", _short(F.col("digest")))
    )
    if n_bytes <= broadcast_bytes:
        met = expressions.join(F.broadcast(rules), "short").where(F.col("digest") == F.col("rule_digest"))
    else:
        hit = expressions.select("short", "digest", "suffix", "prefix").distinct().join(rules, "short").where(F.col("digest") == F.col("rule_digest"))
        met = expressions.join(hit.select("digest", "rule_host", "rule_path", "rule_verdict"), "digest")
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule), F.length("rule_host"), F.col("rule_verdict"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("best"))
    return places.join(best, ["host", "path"], "left").select("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` appended (columns of these names are replaced).

    The verdict depends on the URL alone, so repeated rows and repeated or null ids don't matter. A null URL has an empty host and path.
    """
    added = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in added]
    names = only_columns(kept)
    split = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    key = F.xxhash64("host", "path")
    often = split.agg(F.expr(f"approx_top_k(xxhash64(host, path), {FREQUENT}, {2 * FREQUENT})").alias("top")).select(F.explode("top.item").alias("_often"))
    often = F.broadcast(materialise(often.distinct(), "often"))
    judged = materialise(judge_urls(split, rules, default).withColumn("_key", key), "judged")
    ruled = judged.join(often, F.col("_key") == F.col("_often")).select("_key", F.col("host").alias("_host"), F.sha2(F.col("path"), 256).alias("_path"), "rule", "verdict")  # at most FREQUENT, but for equal hashes
    marked = split.withColumn("_key", key).join(often, F.col("_key") == F.col("_often"), "left")
    frequent = marked.where("_often is not null").join(F.broadcast(ruled), "_key").where((F.col("host") == F.col("_host")) & (F.sha2(F.col("path"), 256) == F.col("_path")))
    rest = marked.where("_often is null").join(judged.drop("_key"), ["host", "path"])
    columns = [*names, *added]
    return frequent.select(*columns).unionByName(rest.select(*columns)).select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], *added)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS r(host, path, verdict)")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT host, path, max_by(h || s, length(h || s)) AS rule, max_by(v, length(h || s)) AS v
  FROM (SELECT DISTINCT host, path FROM p) AS d JOIN r
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (host, path)
"""
