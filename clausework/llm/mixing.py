"""Operator 9: mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, linear in training time 0..1: it runs from ``1 + tilt`` to ``1 - tilt`` times its rate (its integral
over the run is the source's target, so the schedule moves words in time and never changes how many are taken). A source's
documents stand in hash order; pass after pass over them fills the demand. The schedule is integrated to the cumulative demand
D(t) = target * (t + tilt * t * (1 - t)); inverting it at the place of each copy of a document gives the copy's training position, and the words it has
before the run ends are those that the mix takes; documents are range-sorted by position. Prefix sums run in two levels, over hash buckets of bounded
size and over bucket totals, so no source is gathered in one task; more than ``ROWS_PER_BUCKET`` rows of one id and size are one entry there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.util import materialise, only_columns, ranked

#: Fixed values of the query: weights by rank of the source, share of all words, most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
ROWS_PER_BUCKET = 2_000
#: Repeated (source, id, size) up to this many are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
TILTS = (0.5, 0.0, -0.5)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``sizes``: source, source_size -> adds ``place, weight, target``.

    Targets are ``share`` of all words split by weight; those above ``passes`` times their source stop there and the excess is shared
    out again by weight. Sources sorted by cap over weight fill up in that order, so one pass of prefix sums finds who stops. The
    windows run over one row per source: the number of sources, not of documents.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("place", F.row_number().over(place) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("place") % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.lit(passes) * F.col("source_size"))
    ranked = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every)).alias("_all"),
        F.sum("weight").over(every).alias("_weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_gone"),
    )
    level = (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_gone"))
    ranked = ranked.withColumn("_full", F.col("weight") * level > F.col("cap")).withColumn("_level", level)
    # the first source that doesn't stop sets the level for itself and all after it
    ranked = ranked.withColumn("_at", F.min(F.when(~F.col("_full"), F.struct(F.col("_gone"), F.col("_level")))).over(every))
    stops = F.col("_at").isNull() | (F.col("_gone") < F.col("_at._gone"))
    target = F.when(stops, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("_at._level"))
    return ranked.select("source", "source_size", "place", "weight", target.alias("target"))


def _order(id_col: Column, text: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), text, F.lit("")))


def _starts(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """``entries`` (source, h, size, n: how many rows) with the facts of their source and ``start``, the words of the source before them."""
    rank = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    placed = entries.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("_bucket", F.floor(rank * F.ceil(F.col("_rows") / ROWS_PER_BUCKET) / F.lit(1 << 32)))
    totals = placed.groupBy("source", "_bucket").agg(F.sum(F.col("size") * F.col("n")).alias("_total"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_in", F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    return ranked.withColumn("start", F.col("_offset") + F.col("_in"))


def position(demand: Column, target: Column, tilt: Column) -> Column:
    """Training time 0..1 at which the cumulative demand ``target * (t + tilt * t * (1 - t))`` reaches ``demand``."""
    share = F.least(F.lit(1.0), demand / target)
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * share))
    return F.when(target > 0, F.when(tilt == 0, share).otherwise(2 * share / ((1 + tilt) + root)))


def training_plan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", tilts=TILTS, **how) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, h, source, size, source_size, target, tilt, start, copies, taken`` (``h``: its place in the order of its source).

    ``start``: words of the source before the document, in the order of md5 of its id (of its text, if the id is null), then size. ``copies``: array of struct(``pass``,
    ``position``, ``words``) of the passes that reach it: the training position of its first word, and the words it has before the run ends, which is
    where the source's demand ends (rounded to words). ``taken`` is their sum. Null texts have size 0 and no copies; sources of size 0 have
    target 0; a null source is a source, ranked last. Repeated rows are rows of their own. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _order(F.col(id_col), F.col(text)).alias("h"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sizes = materialise(sizes, "sources")
    targets = source_targets(sizes.select("source", "source_size"), **how)
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), F.col("place") % len(tilts) + 1)
    targets = targets.withColumn("tilt", tilt).withColumn("_words", F.round("target").cast("long"))
    known = materialise(targets.join(sizes.select(F.col("source").alias("_source"), "_rows"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "targets")
    facts = known.select(F.col("source").alias("_s"), "source_size", "target", "tilt", "_words", "_rows")

    often = materialise(sized.groupBy("source", "h", "size").agg(F.count("*").alias("n")).where(F.col("n") > ROWS_PER_BUCKET), "often")
    kept = ["doc_id", "h", "source", "size", "source_size", "target", "tilt", "_words", "start"]
    n_often = often.count()
    if not n_often:
        placed = _starts(sized.withColumn("n", F.lit(1)), facts).select(*kept)
    else:
        key = F.col("source").eqNullSafe(F.col("_os")) & (F.col("h") == F.col("_oh")) & (F.col("size") == F.col("_on"))
        met = often.select(F.col("source").alias("_os"), F.col("h").alias("_oh"), F.col("size").alias("_on"))
        met = F.broadcast(met) if n_often <= BROADCAST_GROUPS else met
        entries = sized.join(met, key, "left_anti").select("doc_id", "source", "h", "size", F.lit(1).cast("long").alias("n"))
        entries = materialise(_starts(entries.unionByName(often, allowMissingColumns=True), facts), "starts")
        # rows of one entry follow each other by the task that wrote them: counts of each task before, then the place in the task
        same = sized.join(met, key, "left_semi").withColumn("task", F.shiftright("row", 33))
        tasks = same.groupBy("source", "h", "size", "task").agg(F.count("*").alias("c"))
        before = Window.partitionBy("source", "h", "size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        tasks = tasks.select(F.col("source").alias("_os"), F.col("h").alias("_oh"), F.col("size").alias("_on"), F.col("task").alias("_ot"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_before"))
        inside = F.row_number().over(Window.partitionBy("source", "h", "size", "task").orderBy("row")) - 1
        each = same.withColumn("_in", inside).join(tasks, key & (F.col("task") == F.col("_ot"))).drop("_os", "_oh", "_on", "_ot")
        heads = entries.where("n > 1").select(F.col("source").alias("_os"), F.col("h").alias("_oh"), F.col("size").alias("_on"), "source_size", "target", "tilt", "_words", "start")
        each = each.join(F.broadcast(heads) if n_often <= BROADCAST_GROUPS else heads, key).withColumn("start", F.col("start") + (F.col("_before") + F.col("_in")) * F.col("size"))
        placed = entries.where("n = 1").select(*kept).unionByName(each.select(*kept))

    begin = lambda p: F.col("start") + p * F.col("source_size")
    words = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - begin(p))).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.sequence(F.lit(0).cast("long"), F.floor(F.col("_words") / F.col("source_size")))).otherwise(F.array().cast("array<bigint>"))
    copy = lambda p: F.struct(p.alias("pass"), position(begin(p), F.col("target"), F.col("tilt")).alias("position"), words(p).alias("words"))
    placed = placed.withColumn("copies", F.filter(F.transform(rounds, copy), lambda c: c.words > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c.words)
    return placed.select("doc_id", "h", "source", "size", "source_size", "target", "tilt", "start", "copies", taken.alias("taken"))


def training_order(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mixed corpus: ``docs`` repeated as often as taken, range-sorted by training position; columns as they came, whatever their names.

    A copy that the target cuts is kept whole when at least half of its words are taken and left out otherwise, so that every
    document stays whole. Each row gets its own copies, also where ids repeat or are null: rows of one id, source and size (of one text, where the id is null) are
    numbered and meet the places that the plan gave them in turn. Null texts have no words and are never taken. An empty table gives no rows.
    """
    names = only_columns(docs.columns)
    numbered = docs.toDF(*names)
    text, id_col, source = (names[docs.columns.index(c)] for c in (text, id_col, source))
    plan = materialise(training_plan(numbered, text, id_col, source, **how).select("h", "source", "size", "start", F.filter("copies", lambda c: 2 * c.words >= F.col("size")).alias("copies")), "plan")
    key = ["h", "source", "size"]
    often = materialise(plan.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key]), "repeated")
    keyed = numbered.withColumns({"_h_of_row": _order(F.col(id_col), F.col(text)), "_words_of_row": word_count(F.col(text))})
    mine = {"h": "_h_of_row", "source": source, "size": "_words_of_row"}

    def met(row: dict, other: dict) -> Column:
        return (F.col(row["h"]) == F.col(other["h"])) & F.col(row["source"]).eqNullSafe(F.col(other["source"])) & (F.col(row["size"]) == F.col(other["size"]))

    repeated, plain = {c: f"_{c}" for c in key}, {c: c for c in key}
    if often.isEmpty():
        taken = keyed.join(plan.where(F.size("copies") > 0), met(mine, plain)).select(*names, "copies")
    else:
        once = plan.join(often, met(plain, repeated), "left_anti").where(F.size("copies") > 0)
        taken = keyed.join(once, met(mine, plain)).select(*names, "copies")
        places = ranked(plan.join(often, met(plain, repeated), "left_semi"), key, ["start"]).where(F.size("copies") > 0).select(*key, F.col("pos").alias("_place"), "copies")
        rows = ranked(keyed.join(often, met(mine, repeated), "left_semi"), list(mine.values()), [id_col])
        taken = taken.unionByName(rows.join(places, met(mine, plain) & (F.col("pos") == F.col("_place"))).select(*names, "copies"))
    taken = taken.withColumn("_position", F.explode("copies.position"))
    return taken.repartitionByRange(F.col("_position"), F.col(id_col)).sortWithinPartitions("_position", id_col).select(*names).toDF(*docs.columns)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The plan in training order: rows are range-sorted by the position of the document's first copy; those of which nothing is taken stand last."""
    plan = training_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = plan.withColumn("first_position", F.array_min("copies.position")).withColumn("last_position", F.array_max("copies.position"))
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id").asc()]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(place % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS weights,
         coalesce(sum(cap) OVER b, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER b, 0)::DOUBLE AS gone
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - capped) / (weights - gone) AS level FROM f),
a AS (SELECT min(gone) AS first_gone, arg_min(level, gone) AS set_level FROM g WHERE NOT weight * level > cap),
t AS (SELECT source, source_size, [0.5, 0.0, -0.5][(place % 3 + 1)::INT]::DOUBLE AS tilt,
             CASE WHEN first_gone IS NULL OR gone < first_gone THEN cap::DOUBLE ELSE weight * set_level END AS target FROM g, a),
o AS (
  SELECT row_number() OVER () AS row, doc_id, size, source_size, target, tilt, round(target)::BIGINT AS words,
         (sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT row, doc_id, size, source_size, target, tilt, pass, greatest(0, least(size, words - (start + pass * source_size))) AS taken,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, (start + pass * source_size)::DOUBLE / target) END AS share
  FROM o, (VALUES (0), (1), (2)) AS p(pass)),
x AS (
  SELECT *, CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN share
         ELSE 2 * share / ((1 + tilt) + sqrt(greatest(0.0::DOUBLE, (1 + tilt) * (1 + tilt) - 4 * tilt * share))) END END AS position
  FROM c)
SELECT doc_id, size, source_size, target, sum(taken)::BIGINT AS taken, min(position) AS first_position, max(position) AS last_position
FROM x GROUP BY row, doc_id, size, source_size, target
"""
