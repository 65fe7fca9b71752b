"""Batches are worked off in slices of bounded size."""

import numpy as np
import pyarrow as pa

from clausework.functions import encoder
from clausework.functions.arrow import bounded_slices, part_bounds, text_slices
from clausework.operators import extract as X


def test_bounds_hold_every_row_once():
    for sizes in ([], [0, 0], [5], [9, 1, 1, 9, 0, 3], [1] * 10):
        got = list(part_bounds(np.array(sizes, np.int64), 4))
        assert [i for at, n in got for i in range(at, at + n)] == list(range(len(sizes)))
        assert all(n == 1 or sum(sizes[at : at + n]) <= 4 for at, n in got)
    batch = pa.RecordBatch.from_pydict({"w": pa.array([["a", "b"], None, [], ["c"] * 7], pa.list_(pa.string()))})
    assert [b.column("w").to_pylist() for b in bounded_slices(batch, "w", 3)] == [[["a", "b"], None, []], [["c"] * 7]]
    assert [t.to_pylist() for t in text_slices(pa.array(["aé", None, "bbbb"]), 3)] == [["aé", None], ["bbbb"]]


def test_quotes_are_found_in_every_slice(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} one two three four five end {'x ' * i}") for i in range(20)] + [(20, None), (21, "")], "doc int, text string").coalesce(1)
    quotes = spark.createDataFrame([(1, "one two three four five"), (2, "w7 one two three four")], "item int, quote string")
    monkeypatch.setattr(X, "SLICE_WORDS", 8)
    got = {tuple(r) for r in X.recover_quotes(quotes, docs, "item", "doc").collect()}
    assert got == {(1, i, "exact") for i in range(20)} | {(2, 7, "exact")}


def test_encoders_see_slices(spark, monkeypatch):
    monkeypatch.setattr(encoder, "SLICE_BYTES", 8)
    rows = spark.createDataFrame([(i, "abc") for i in range(9)] + [(9, None), (10, "a long text")], "i int, t string").coalesce(1)
    got = rows.select("i", encoder.checked_encoder(lambda texts: [[len(texts), len(t or "")] for t in texts], 2)("t").alias("v")).orderBy("i").collect()
    assert [int(r.v[1]) for r in got] == [3] * 9 + [0, 11]
    assert max(r.v[0] for r in got) <= 3


def test_python_values_equal_to_pylist():
    """the rows of folds were made value by value, blocks as a dictionary each; plain columns come by way of numpy with equal values and types."""
    import pyarrow as pa

    from clausework.functions.arrow import python_values

    lists = pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))
    for c in (pa.array([3, 1], pa.int32()), pa.array([1.5, 2.0]), pa.array([True, False]), lists, lists.slice(1), pa.array([[1], None, [2, None]]), pa.array([1, None]), pa.array(["a", None]), pa.array([[["x"]], []]), pa.array([], pa.int64()), pa.array([{"id": 1}])):
        got = python_values(c)
        assert got == c.to_pylist() and [type(x) for x in got] == [type(x) for x in c.to_pylist()]


def test_postings_see_small_batches(spark, monkeypatch):
    from clausework.functions.arrow import ROWS_OF_BATCH
    from clausework.operators import retrieval as R

    before, seen, written = spark.conf.get(ROWS_OF_BATCH), [], R.written
    monkeypatch.setattr(R, "written", lambda df, tag: seen.append(int(spark.conf.get(ROWS_OF_BATCH))) or written(df, tag))
    docs = spark.range(1200).selectExpr("id", "if(id % 2 = 0, array('a', 'b'), array('c')) AS terms")
    queries = spark.createDataFrame([(1, ["a", "b"])], "q int, terms array<string>")
    assert [(r.query, r.doc, r["rank"]) for r in R.bm25_top(queries, docs, "q", "id", 3).orderBy("rank").collect()] == [(1, 0, 1), (1, 2, 2), (1, 4, 3)]
    assert seen == [R.DOCS] and spark.conf.get(ROWS_OF_BATCH) == before
    try:
        spark.conf.set(ROWS_OF_BATCH, "100")
        R.bm25_top(queries, docs, "q", "id", 3).collect()
        assert seen == [R.DOCS, 100] and spark.conf.get(ROWS_OF_BATCH) == "100"
    finally:
        spark.conf.set(ROWS_OF_BATCH, before)
