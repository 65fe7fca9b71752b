"""Interval joins over grids as wide as the intervals.

An interval of whole numbers belongs to the class of the least power of four that is not below its length, and lies in one or two cells of a grid of that width; a point lies in one cell of
each class that occurs. Both meet by an equi-join on (keys, class, cell), so every pair meets once, a long interval covers no more cells than a short one, and what meets in vain lies within a few lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(start: Column, end: Column, levels: int) -> Column:
    """``array<struct<level, segment>>`` that covers [start, end] once; null or reversed bounds give an empty array."""
    begin = F.struct(start.cast("long").alias("lo"), (end.cast("long") + 1).alias("hi"), F.array().cast("array<struct<level:int,segment:long>>").alias("out"))

    def step(a, level):
        left = (a.lo < a.hi) & (a.lo % 2 != 0)
        lo = a.lo + left.cast("long")
        right = (lo < a.hi) & (a.hi % 2 != 0)
        hi = a.hi - right.cast("long")
        piece = lambda at: F.struct(level.alias("level"), at.alias("segment"))
        found = F.array_compact(F.array(F.when(left, piece(a.lo)), F.when(right, piece(hi))))
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), F.concat(a.out, found).alias("out"))

    every = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), begin, step, lambda a: a.out)
    return F.when(start <= end, every).otherwise(F.array().cast("array<struct<level:int,segment:long>>"))


def _class() -> Column:
    """Half the bits of ``_s`` to ``_e``, rounded up: the least k with 4 ** k >= their length."""
    return F.ceil(F.length(F.bin(F.col("_e") - F.col("_s"))) / 2 * F.signum(F.col("_e") - F.col("_s"))).cast("int")


def _stabbed(intervals: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of an interval (columns ``l``, from ``_s`` to ``_e``) and a point (``r``, at ``_p``) within it, of equal keys.

    Both sides grow by exploding, which Spark's size estimates don't see, so the join must not be planned as a broadcast."""
    classed = intervals.where("_s <= _e").withColumn("_class", _class())
    classes = classed.agg(F.sort_array(F.collect_set("_class"))).first()[0] or [0]  # 32 at most
    cell = lambda p, k: F.call_function("shiftright", p, k * 2)
    cells = F.sequence(cell(F.col("_s"), F.col("_class")), cell(F.col("_e"), F.col("_class")))
    a = classed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "l", "_s", "_e", "_class", F.explode(cells).alias("_cell"))
    b = points.select(*keys, "r", F.col("_p"), F.explode(F.array(*map(F.lit, classes))).alias("_of")).withColumn("_in", cell(F.col("_p"), F.col("_of")))
    same = (F.col("_class") == F.col("_of")) & (F.col("_cell") == F.col("_in")) & F.col("_p").between(F.col("_s"), F.col("_e"))
    for i, k in enumerate(keys):
        same = same & (F.col(f"_k{i}") == F.col(k))
    return a.hint("merge").join(b.hint("merge"), same).select(*keys, "l", "r")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[Column, Column], right_bounds: tuple[Column, Column]) -> DataFrame:
    """``keys, l, r``: rows of both sides (as structs) of equal keys whose closed intervals of whole numbers share a point, each pair once.

    Of two such intervals the later start lies in the other one: starts of the right stab the left, and starts of the left stab the right where they are later. Null
    keys, null and reversed bounds meet nothing.
    """
    a = left.select(*keys, F.struct("*").alias("l"), left_bounds[0].cast("long").alias("_s"), left_bounds[1].cast("long").alias("_e")).where("_s <= _e")
    b = right.select(*keys, F.struct("*").alias("r"), right_bounds[0].cast("long").alias("_s"), right_bounds[1].cast("long").alias("_e")).where("_s <= _e")
    inner = _stabbed(a, b.withColumn("_p", F.col("_s")), keys)
    later = b.select(*keys, F.col("r").alias("l"), (F.col("_s") + 1).alias("_s"), "_e")  # a later start than the right's own
    outer = _stabbed(later, a.select(*keys, F.col("l").alias("r"), F.col("_s").alias("_p")), keys).select(*keys, F.col("r").alias("l"), F.col("l").alias("r"))
    return inner.unionByName(outer)


def overlapping_pairs(rows: DataFrame, keys: list[str], identity: str, start: Column, end: Column) -> DataFrame:
    """``keys, l, r``: pairs of rows (as structs) of equal keys whose closed intervals share a point, each once, the earlier (start, then ``identity``) as ``l``."""
    a = rows.select(*keys, F.struct("*").alias("l"), start.cast("long").alias("_s"), end.cast("long").alias("_e")).where("_s <= _e").withColumn("l", F.struct(F.col("_s").alias("_s"), F.col(f"l.{identity}").alias("_id"), F.col("l").alias("row")))
    points = a.select(*keys, F.col("l").alias("r"), F.col("_s").alias("_p"))
    met = _stabbed(a, points, keys)
    first = (F.col("l._s") < F.col("r._s")) | ((F.col("l._s") == F.col("r._s")) & (F.col("l._id") < F.col("r._id")))
    return met.where(first).select(*keys, F.col("l.row").alias("l"), F.col("r.row").alias("r"))
