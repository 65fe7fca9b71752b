"""What belongs to a hit, against plain Python."""

import random

from pyspark.sql import functions as F

from clausework.operators import retrieval as R


def test_row_context_equals_pairs(spark):
    """peers without pairs of cells: hits that come twice or are no cells, null places, more peers than the most."""
    rng = random.Random(4)
    cells = [("t", r, c) for r in range(1, 5) for c in range(1, 6) if rng.random() < 0.7] + [("t", 2, 1), ("u", 1, 1), ("u", 2, 1), ("u", 2, None), ("u", None, 1)] + [("w", 1, c) for c in range(1, 31)]
    hits = [*cells, ("t", 9, 2), ("t", 2, 1), ("x", 1, 1), ("t", None, 2), (None, 1, 1), ("u", 1, None)]
    held = {c for c in cells if None not in c}

    def peers(t, r, c):
        return 0 if None in (t, r, c) else sum(x[0] == t and (x[1] == r or x[1] == 1 and x[2] == c) and (x[1], x[2]) != (r, c) for x in held)

    df = lambda rows: spark.createDataFrame(rows, "t string, row int, column int")
    got = R.row_context(df(hits), df(cells), "t")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*h, min(24, peers(*h)), peers(*h) <= 24) for h in hits), key=key)
    assert " OR " not in got._jdf.queryExecution().optimizedPlan().toString()  # cells of a table once met each other under such a condition


def test_bundles_shuffle_lines_once(spark):
    """the 32 places around a hit are no rows of a shuffle; gaps stop a list, a long list is cut, a long text truncates."""
    texts = {1: "These apply:", 2: "- a late", 3: "- b", 4: "If c", 6: "- d", 7: "plain supplier", 8: "- " + "y" * 12_000, 9: "- e"}
    lines = spark.createDataFrame([("x", o, 1, t, t.lower().split()) for o, t in texts.items()] + [("z", o, o, "- i", ["i"]) for o in range(1, 40)], "d string, o int, heading int, text string, terms array<string>")
    hits = lines.select("d", F.col("o").alias("hit"), F.array(F.lit("late"), F.lit("supplier")).alias("roots"))
    out = R.context_bundle(hits, lines, "d", "o", "^- ", "^If ")
    got = {(r.d, r.hit): (r.items, r.chars, r.truncated, r.complete, r.lines) for r in out.collect()}
    assert got["x", 1] == (3, 15, False, True, "2,3,4")
    assert got["x", 3] == (3, 24, False, True, "1,2,4")
    assert got["x", 6] == (2, 18, False, True, "4,7")
    assert got["x", 9] == (1, 14, True, False, "7")
    assert got["z", 20] == (16, 48, True, False, ",".join(str(o) for o in [*range(7, 20), 21, 22, 23]))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
