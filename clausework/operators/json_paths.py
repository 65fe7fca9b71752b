"""Leaf paths of JSON documents and masking by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECRET = "(?i)(secret|token|password|api_?key)"


def flatten_json(rows: DataFrame, key: list[str], body: str, depth: int = 4) -> DataFrame:
    """``key, path, value`` of every leaf down to ``depth`` objects; deeper objects and arrays stay JSON text. Malformed text gives no rows."""
    level = rows.select(*key, F.lit("").alias("path"), F.col(body).alias("value"))
    leaves = None
    for k in range(depth):
        object_ = F.col("value").rlike(r"(?s)^\s*\{")
        fields = F.json_object_keys("value")
        inner = level.where(object_).select(*key, "path", "value", F.explode(fields).alias("k"))
        text = F.try_element_at(F.from_json("value", "map<string,string>"), F.col("k"))
        nxt = inner.select(*key, F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), F.col("k")).alias("path"), text.alias("value"))
        done = nxt if k == depth - 1 else nxt.where(~F.coalesce(F.col("value").rlike(r"(?s)^\s*\{"), F.lit(False)))
        leaves = done if leaves is None else leaves.unionByName(done)
        level = nxt
    return leaves


def redacted(leaves: DataFrame, path: str, value: str, mask: str = "***") -> DataFrame:
    """Values whose last path part looks secret are masked."""
    return leaves.withColumn(value, F.when(F.element_at(F.split(path, r"\."), -1).rlike(SECRET), mask).otherwise(F.col(value)))
