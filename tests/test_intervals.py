import datetime
import random

from pyspark.sql import functions as F

from clausework.operators import blocks as B
from clausework.operators import joins as J
from clausework.operators.intervals import overlapping, overlapping_pairs, segments


def test_segments_cover_once(spark):
    """Every point of an interval lies in one of its segments; negative numbers, single points, reversed and null bounds."""
    spans = [(0, 0), (-7, 9), (5, 5), (-64, 63), (3, 1000), (9, 3), (None, 4)]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", segments(F.col("a"), F.col("b"), 12).alias("s")).collect()
    for r in got:
        points = sorted(p for s in r.s for p in range(s.segment << s.level, (s.segment + 1) << s.level))
        assert points == (list(range(r.a, r.b + 1)) if r.a is not None and r.a <= r.b else [])
        assert len(r.s) <= 24


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice("xy"), i, (s := rng.randint(-50, 50)), s + rng.choice([0, 1, 5, 60, -1])) for i in range(n)]
    a, b = [*make(80), ("x", 900, -1000, 1000), ("x", 901, None, 3), (None, 902, 0, 9)], make(80)
    df = lambda rows: spark.createDataFrame(rows, "k string, id int, s int, e int")
    meets = lambda p, q: p[0] == q[0] and p[0] and None not in (p[2], q[2]) and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]
    bounds = (F.col("s"), F.col("e"))
    got = [(r.l.id, r.r.id) for r in overlapping(df(a), df(b), ["k"], bounds, bounds).collect()]
    assert sorted(got) == sorted((p[1], q[1]) for p in a for q in b if meets(p, q))
    pairs = [(r.l.id, r.r.id) for r in overlapping_pairs(df(a), ["k"], "id", *bounds).collect()]
    assert sorted(pairs) == sorted((p[1], q[1]) for p in a for q in a if meets(p, q) and (p[2], p[1]) < (q[2], q[1]))
    assert overlapping_pairs(df([]), ["k"], "id", *bounds).count() == 0


def test_periods_behind_nested_ones(spark):
    day = lambda d: datetime.date(2024, 1, d)
    rows = [("c", 1, day(1), day(31)), ("c", 2, day(2), day(3)), ("c", 3, day(10), day(12)), ("c", 4, day(12), day(13)), ("d", 5, day(1), day(2))]
    got = {(r.a, r.b): r.kind for r in J.touching_periods(spark.createDataFrame(rows, "k string, id int, start date, end date"), "k").collect()}
    assert got == {(1, 2): "conflict", (1, 3): "conflict", (1, 4): "conflict", (3, 4): "touching"}


CELL = "t string, id string, row int, rowspan int, left int, right int, header boolean, width int, repeats boolean"


def bound(spark, rows, **more):
    return {r.id: r for r in B.header_bindings(spark.createDataFrame(rows, CELL), ["t"], **more).collect()}


def test_merged_headers_of_two_levels(spark):
    """A header over two columns binds to all below it, one over two rows to its own column; row labels and an orphan column."""
    rows = [("t", "op", 1, 2, 0, 1, True, 4, False), ("t", "time", 1, 1, 1, 3, True, 4, False), ("t", "usual", 2, 1, 1, 2, True, 4, False), ("t", "peak", 2, 1, 2, 3, True, 4, False)]
    rows += [("t", "a", 3, 2, 0, 1, False, 4, False), ("t", "b", 3, 1, 1, 2, False, 4, False), ("t", "c", 3, 1, 2, 3, False, 4, False), ("t", "orphan", 3, 1, 3, 4, False, 4, False), ("t", "d", 4, 1, 1, 2, False, 4, False)]
    got = bound(spark, rows)
    assert {i: r.headers for i, r in got.items()} == {"op": [], "time": [], "usual": ["time"], "peak": ["time"], "a": ["op"], "b": ["time", "usual"], "c": ["time", "peak"], "orphan": [], "d": ["time", "usual"]}
    assert got["c"].labels == ["a", "b"] and got["d"].labels == ["a"] and got["a"].labels == []


def test_shifted_headers_slivers_groups_and_repeats(spark):
    """Less than 15 % of a cell's width is a sliver; the nearest full-width row is its group; with repeated headers only the last one counts."""
    rows = [("t", "h1", 1, 1, 0, 51, True, 100, True), ("t", "h2", 1, 1, 51, 100, True, 100, True), ("t", "g", 2, 1, 0, 100, False, 100, True), ("t", "x", 3, 1, 0, 60, False, 100, True), ("t", "y", 3, 1, 44, 54, False, 100, True)]
    rows += [("t", "h3", 4, 1, 0, 100, True, 100, True), ("t", "z", 5, 1, 10, 20, False, 100, True), ("u", "lost", 5, 1, None, 20, False, 100, True)]
    got = bound(spark, rows, repeated="repeats")
    assert (got["x"].headers, got["x"].slivers, got["x"].group) == (["h1", "h2"], [], "g")  # 9 of 60 are 15 %
    assert got["y"].headers == ["h1", "h2"] and got["z"].headers == ["h3"] and got["z"].group == "g"
    assert got["lost"].headers == [] and got["lost"].group is None
    assert bound(spark, rows, repeated="repeats", least=0.2)["x"].slivers == ["h2"]
    assert bound(spark, rows)["z"].headers == ["h1", "h3"]


def test_exploded_sides_are_not_broadcast(spark):
    """the estimate of an exploded side is that of the table, so a join planned by it gathered ten rows a period in the driver."""
    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), "id", (F.col("id") * 7 % 900).alias("s"), (F.col("id") * 7 % 900 + F.col("id") % 300).alias("e"))
    met = overlapping_pairs(rows, ["k"], "id", F.col("s"), F.col("e"))
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    a, b = rows.alias("a"), rows.alias("b")
    first = "a.k = b.k and a.s <= b.e and b.s <= a.e and (a.s < b.s or a.s = b.s and a.id < b.id)"
    assert met.count() == a.join(b, F.expr(first)).count() > 0


def test_bindings_take_one_shuffle_and_equal_plain_ones(spark):
    """cells were joined with headers, rows and labels by six shuffles; random tables with spans, repeats, nulls and empty edges against a plain version."""
    rng = random.Random(5)
    rows = []
    for t, n in (("a", 40), ("b", 40), ("c", 1), (None, 6)):
        for i in range(n):
            row, left = rng.choice([None, *range(1, 9)]), rng.choice([None, *range(9)])
            rows.append((t, f"{t}{i:02}", row, rng.choice([0, 1, 2, 3]), left, None if left is None else rng.choice([left, left + 1, left + 4, 10]), row in (1, 2, 5), 10, t == "b"))
    rows += [("a", "fa", 4, 1, 0, 10, False, 10, False), ("b", "fb", 6, 1, 0, 10, False, 10, True)]
    df = B.header_bindings(spark.createDataFrame(rows, CELL), ["t"], repeated="repeats")
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(rows)
    real = [r for r in rows if r[0] is not None and r[2] is not None]
    order = lambda found: [r[1] for r in sorted(found, key=lambda r: (r[2], r[4], r[1]))]
    for c in rows:
        t, i, row, _, left, right, *_ = c
        up = [h for h in real if row is not None and h[0] == t and h[2] < row]
        heads = [h for h in up if h[6]]
        if t == "b" and heads:
            heads = [h for h in heads if h[2] == max(x[2] for x in heads)]
        met = [h for h in heads if None not in (left, h[4]) and left < right and h[4] < h[5] and h[4] < right and left < h[5]]
        wide = [(min(right, h[5]) - max(left, h[4])) / (right - left) >= 0.15 for h in met]
        full = [(g[2], g[1]) for g in up if not g[6] and g[4] == 0 and g[5] == 10]
        labels = [k for k in real if k[0] == t and row is not None and not k[6] and None not in (left, k[4]) and k[2] <= row < k[2] + k[3] and k[4] < left]
        assert (got[i].headers, got[i].slivers) == (order([h for h, w in zip(met, wide) if w]), order([h for h, w in zip(met, wide) if not w])), c
        assert got[i].group == (max(full)[1] if full else None) and got[i].labels == order(labels), c
