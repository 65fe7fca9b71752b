import duckdb
import pytest
from pyspark.sql import functions as F

from clausework.llm import mixing as M


@pytest.mark.parametrize("rows", [2000, 3])
def test_whole_table(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(M.OP9_SQL).fetchall()
    got = M.op9_mix_sources(spark, sf).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    total = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.doc_id is not None
        total.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - k[1]) <= 1 for k, v in total.items())


def test_edges(spark):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (None, "x " * 5000, "s", 2), (2, None, None, 3), (3, "", None, 3), (4, "w w", None, 3), (5, "q", "t", 4), (6, None, "empty", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = M.training_plan(df).collect()
    assert len(plan) == len(rows)
    assert all(r.taken == 0 for r in plan if r.size == 0)
    assert next(r for r in plan if r.source == "empty").target == 0
    out = M.training_order(df)
    assert out.columns == df.columns
    assert {r.text for r in out.collect()} <= {r[1] for r in rows}
    assert M.training_plan(df.where("false")).count() == 0 and M.training_order(df.where("false")).count() == 0


def test_positions(spark):
    """The position inverts the cumulative demand, and the integral of a schedule is its target whatever the tilt."""
    df = spark.createDataFrame([(float(d), t) for d in (0, 10, 37, 99.5, 100) for t in (0.5, 0.0, -0.5)], "d double, tilt double")
    for r in df.select("d", "tilt", M.position(F.col("d"), F.lit(100.0), F.col("tilt")).alias("p")).collect():
        assert 0 <= r.p <= 1
        assert abs(100 * (r.p + r.tilt * r.p * (1 - r.p)) - r.d) < 1e-9


def test_order_is_by_position(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    a = [r.doc_id for r in M.training_order(df).collect()]
    assert a == [r.doc_id for r in M.training_order(df.repartition(7)).collect()]  # reruns agree


def times(r, target, tilt):
    """Training times of the copies of a document, found by bisection in the integrated schedule of its source."""
    out = []
    for begin in range(r.start, round(target), r.source_size):
        low, high = 0.0, 1.0
        for _ in range(60):
            t = (low + high) / 2
            low, high = (t, high) if target * (t + tilt * t * (1 - t)) < begin else (low, t)
        out.append((high, min(r.size, round(target) - begin)))
    return out


def test_query_goes_through_the_curriculum(spark, sf):
    """Positions, words and order of op9 against the schedule: what a document gives is what its copies have before the run ends."""
    plan = {r.doc_id: r for r in M.training_plan(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len({r.tilt for r in plan.values()}) > 1
    got = M.op9_mix_sources(spark, sf).collect()
    assert len(got) == len(plan)
    for r in got:
        want = times(plan[r.doc_id], r.target, plan[r.doc_id].tilt) if r.size else []
        assert r.taken == sum(w for _, w in want)
        assert not want or abs(want[0][0] - r.first_position) < 1e-9 and abs(want[-1][0] - r.last_position) < 1e-9
        assert want or r.first_position is None
    order = [1 if r.first_position is None else r.first_position for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("broadcast", [100, -1])
def test_one_id_in_a_third_of_the_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(M, "BROADCAST_GROUPS", broadcast)
    rows = [(i, "w " * (i % 7), f"s{i % 2}") for i in range(60)] + [(7, "a b c", "s0")] * 40 + [(None, "x y", "s1")] * 30 + [(None, None, "s1")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    sf = M.materialise(df, "tables")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = sorted((str(r[0]), r[1], r[4], r[5] or 0) for r in con.execute(M.OP9_SQL).fetchall())
    got = sorted((str(r.doc_id), r.size, r.taken, r.copies[0].position if r.copies else 0) for r in M.training_plan(sf).collect())
    assert got == want


@pytest.mark.parametrize("rows", [2000, 3])
def test_repeated_and_null_ids_meet_their_targets(spark, monkeypatch, rows):
    """Words of the mixed corpus by source come to their targets within a document, whether ids are distinct, all null, or all one."""
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", rows)
    for make in (lambda i: i, lambda i: None, lambda i: 7, lambda i: None if i % 3 else i % 5):
        data = [(make(i), " ".join(["w"] * (15 if i % 2 else 5)) + f" {i % 9}", "a" if i % 4 else "b") for i in range(400)]
        df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
        words, out = {}, M.training_order(df).collect()
        for r in out:
            words[r.source] = words.get(r.source, 0) + len(r.text.split())
        target = {r.source: r.target for r in M.training_plan(df).select("source", "target").distinct().collect()}
        assert {s: abs(words[s] - t) <= 17 for s, t in target.items()} == dict.fromkeys(target, True)
        assert {(r.doc_id, r.text, r.source) for r in out} <= set(data)
