"""Operator 1: exact dedup by a heavy-hitter split, DataFrame functions only.

Frequent digests are found by a Misra-Gries summary (``approx_top_k``: DataSketches' frequent-items sketch, whose
counter table decrements as Misra and Gries do), of ``TRACKED`` counters in each task. Its candidates are counted exactly; those
that hold at least one ``SHARE``-th of the rows are the verified winners, at most ``TRACKED`` rows, which are broadcast, so that
their rows are resolved map-side. The rows of all other digests go through an ordinary shuffle by digest, where a group is
smaller than a ``SHARE``-th of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.util import WHITE, materialise, only_columns

TRACKED = 1024
SHARE = 1000


def normalised(text: Column) -> Column:
    """``text`` without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _rank() -> Column:
    """The row that stays has the least value: most code points, smallest id (null last), first in the written table."""
    return F.struct(-F.col("n"), F.col("id").isNull(), F.col("id"), F.col("row"))


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting white space. Nulls: a null text counts as empty; a null id ranks after
    all others and may be the ``keep_id``. Ties and repeated rows: of rows with equal length and id one, the first in the
    written table, is kept, so each group keeps one row. Empty tables give no rows. Other columns are not read, so they can't clash.
    """
    digests = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(normalised(F.col(text)), 256).alias("digest"),
        F.coalesce(F.length(text), F.lit(0)).alias("n"),
    ).withColumn("row", F.monotonically_increasing_id())
    digests = materialise(digests, "digests")

    found = digests.agg(F.expr(f"approx_top_k(xxhash64(digest), {TRACKED // 2}, {TRACKED})").alias("top"), F.count("*").alias("rows"))
    candidates = found.select(F.explode("top.item").alias("h"), "rows")
    heavy = (
        digests.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "h")
        .groupBy("digest")
        .agg(F.min(_rank()).alias("best"), F.count("*").alias("size"), F.first("rows").alias("rows"))
        .where(F.col("size") > F.greatest(F.lit(1), F.col("rows") / share))
        .select(F.col("digest"), F.struct("best", "size").alias("won"))
    )
    heavy = materialise(heavy, "heavy")

    marked = digests.join(F.broadcast(heavy), "digest", "left")
    of = Window.partitionBy("digest")
    here = (
        marked.where(F.col("won").isNull())
        .select("id", "digest", "n", "row")
        .select("id", "digest", "row", F.struct(F.min(_rank()).over(of).alias("best"), F.count("*").over(of).alias("size")).alias("won"))
    )
    every = marked.where(F.col("won").isNotNull()).select("id", "digest", "row", "won").unionByName(here)
    return every.select(
        F.col("id").alias("doc_id"),
        F.col("won.best.id").alias("keep_id"),
        F.col("won.size").alias("group_size"),
        (F.col("row") == F.col("won.best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged, whatever their names.

    The kept rows are found on digests alone; the documents are then read once more and reduced by an anti-join with the
    dropped (id, digest, length) keys. Rows that equal the kept one in all three are told apart by a row number over
    just those rows.
    """
    names = only_columns(docs.columns)
    numbered = docs.toDF(*names)
    text, id_col = (names[docs.columns.index(c)] for c in (text, id_col))
    groups = materialise(exact_groups(numbered, text, id_col), "groups")
    multiple = groups.where("group_size > 1")
    keys = multiple.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("same"), F.max("kept").alias("kept"))
    keys = keys.where("not kept or same > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"), "kept")
    keyed = numbered.withColumn("_digest_of_row", F.sha2(normalised(F.col(text)), 256))
    joined = keyed.join(keys.withColumnRenamed("kept", "_kept"), (F.col(id_col).eqNullSafe(F.col("_id"))) & (F.col("_digest_of_row") == F.col("_digest")), "left")
    plain = joined.where(F.col("_kept").isNull()).select(*names)
    order = Window.partitionBy("_digest_of_row").orderBy(F.length(text).desc(), F.col(text))
    tied = joined.where("_kept").withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*names)
    return plain.unionByName(tied).toDF(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
