"""Operators that read their input once."""

from pyspark.sql import functions as F

from clausework.operators import extract as X
from clausework.operators import register as R
from clausework.operators import retrieval
from clausework.operators import texts


def plan(df) -> str:
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_topics_are_made_once(spark, tmp_path):
    rows = [(1, "a", ["x", "y"]), (2, "b", ["y", "x", "x"]), (3, None, ["x", "y"]), (4, "a", ["z"]), (5, "a", ["z"]), (6, None, ["z"]), (7, None, ["q"]), (8, "c", None), (9, "d", None)]
    spark.createDataFrame(rows, "id int, source string, terms array<string>").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    got = R.topic_clusters(facts, F.col("terms"), "source", "id", most=2)
    assert sorted((r.id, r.page) for r in got.collect()) == [(1, 0), (2, 0), (3, 1)]
    assert plan(got).count("Scan parquet") == 1


def test_runs_are_counted_without_a_join(spark):
    rows = [(1, n) for n in (3, 1, 2, 2, 7, 8, 10)] + [(2, 5), (2, 5)]
    runs = X.span_runs(spark.createDataFrame(rows, "k int, n int"), "k", "n")
    back = X.expand_runs(runs, "k")
    got = back.groupBy("k", "first", "last").count()
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 3, 3), (1, 7, 8, 2), (1, 10, 10, 1), (2, 5, 5, 1)]
    assert plan(got).count("Exchange") == 1 and "Join" not in plan(got)


def test_texts_meet_rules_once(spark, tmp_path):
    lines = [(1, 0, 0, "the terms here"), (1, 1, 0, "AB holds"), (1, 3, 1, "cause of delay"), (1, 4, 1, "!! AB CD"), (1, 5, 2, "a | b"), (1, 6, 2, "tail cause"), (2, 0, 0, "a | b"), (2, 1, 0, "AB"), (3, 0, 0, "cause of delay")]
    spark.createDataFrame([(*x, x[3].lower().split()) for x in lines], "doc int, ord int, section int, text string, terms array<string>").write.parquet(str(tmp_path / "blocks"))
    rules = spark.createDataFrame([(1, 7, None, "cause of delay", ["cause", "of", "delay"]), (1, 8, 2, "x", ["x"]), (2, 7, None, "cause of delay", ["cause", "of", "delay"])], "doc int, rule int, number int, expected string, terms array<string>")
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    got = retrieval.route_rules(rules, blocks, " of ", r" \| ", "^the ", "^[A-Z]{2}$", F.contains("text", F.lit("!!")))
    seven = {0: "front", 1: "definition,front", 3: "front,index,section", 4: "front,index,section", 5: "index", 6: "index"}
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, o, via) for o, via in seven.items()] + [(1, 8, 1, "definition"), (1, 8, 3, "section"), (1, 8, 4, "section")]
    assert plan(got).count("Scan parquet") == 2 and plan(got).count("Exchange") <= 4


def test_typos_are_found_in_one_pass(spark, tmp_path):
    rows = [
        (1, "valve valve motor, motor valv x"), (1, "valve valved motor motr Motor motob"), (1, None),
        (2, "valve valv"), (None, "valve valve valve valv"), (3, None),
        (4, "motor motor motor motok motok motor1 _motoz_ vent vents"), (5, "able able able abld abld abld abll vent"),
    ]
    spark.createDataFrame(rows, "id int, body string").write.parquet(str(tmp_path / "texts"))
    got = texts.typo_candidates(spark.read.parquet(str(tmp_path / "texts")), "id", "body")
    want = [(1, "motob", "motor"), (1, "motr", "motor"), (1, "valv", "valve"), (1, "valved", "valve"), (4, "motoz", "motor")]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert plan(got).count("Scan parquet") == 1 and plan(got).count("Exchange") == 1 and "Join" not in plan(got)
