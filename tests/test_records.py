"""Identity of findings, release diffs, lessons, labels, evaluation, log profiles, samples and forecasts on small fixtures."""

import datetime

from pyspark.sql import functions as F

from clausework.operators import dedup as D
from clausework.operators import register as G
from clausework.operators import retrieval as R
from clausework.operators import rollup as U

FINDING = "id int, job int, requirement string, category string, evidence array<struct<document:string,locator:string,quote:string>>, suggestion string, issue string, explanation string"


def test_special_keys(spark):
    at = lambda q, loc="1": ("d", loc, q)
    rows = [
        (1, 1, None, "sum", [at("2+2=5")], "write 4", "Sum is wrong", None), (2, 1, None, "sum", [at("2+2=5")], "write four", "Total differs", None), (3, 2, None, "sum", [at("2+2=5")], "write 4", "Sum is wrong", None),
        (4, 1, None, "style", [at("the AБ word")], "a", "Mixed alphabet", None), (5, 1, None, "terms", [at("AБ")], "b", "x", "mixed alphabet in it"), (6, 1, "r", "style", [at("the AБ word")], "a", "Mixed alphabet", None), (7, 1, None, "style", [at("AБ and CД")], "a", "Mixed alphabet", None),
        (8, 1, None, "refs", [at("Table 3"), at("see 4.1", "2")], "a", "Wrong number of a table", None), (9, 1, None, "other", [at("see 4.1", "2"), at("Table 3")], "b", "table reference", None), (10, 1, None, "refs", [at("Table 3"), at("see 3", "2")], "a", "Wrong number of a table", None),
        (11, 1, None, "style", [at("q")], "Do  THIS ", "i", None), (12, 1, None, "style", [at("q"), at("q")], "do this", "j", None), (13, 1, None, None, None, None, None, None), (14, 1, "", None, [], None, None, None),
    ]
    got = {r.id: r.key for r in D.finding_identity(spark.createDataFrame(rows, FINDING), "sum", "(?i)mixed alphabet", "(?i)table", "(?i)number|reference").collect()}
    classes = {}
    for i, k in got.items():
        classes.setdefault(k, set()).add(i)
    assert sorted(map(sorted, classes.values())) == [[1, 2], [3], [4, 5], [6], [7], [8, 9], [10], [11, 12], [13, 14]]


def test_locators_are_unique_inside_a_family(spark):
    shape = "id int, family string, lineage string, meaning string, locator string, context string, trust string"
    old = [(1, "f", None, "m1", "1.1", "c", "t"), (2, "g", None, "m2", "1.1", "c", "t"), (3, "f", None, "same", "2", "c", "t"), (4, "g", None, "same", "3", "c", "t"), (5, "f", "L", "m5", "5", "c", "t")]
    new = [(11, "f", None, "n1", "1.1", "c", "t"), (12, "h", None, "n2", "1.1", "c", "t"), (13, "g", None, "same", "9", "c", "t"), (15, "other", "L", "m5", "5", "c", "u")]
    got = {(r.o_id, r.n_id): r.kind for r in D.release_diff(spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)).collect()}
    assert got == {(1, 11): "meaning_changed", (2, None): "removed", (None, 12): "added", (3, None): "removed", (4, 13): "renumbered", (5, 15): "trust_changed"}


def test_active_lessons(spark):
    day = lambda k: datetime.datetime(2024, 1, k)
    rows = [(i, "a", "x", day(i), i != 5) for i in range(1, 8)] + [(20, "a", "general", day(6), True), (21, "a", "y", day(9), True), (22, "b", "x", day(9), True), (23, None, "x", day(9), True), (24, "a", None, day(9), True)]
    stored = spark.createDataFrame(rows, "id int, owner string, type string, created timestamp, active boolean")
    asked = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "general"), ("a", None), ("c", "x")], "owner string, type string")
    got = [(r.type, r.id) for r in G.active_lessons(asked, stored).orderBy("type", "place").collect()]
    assert got == [("general", 20), ("x", 7), ("x", 20), ("x", 6), ("x", 4)]


def test_invented_labels_are_replaced(spark):
    rows = [("a [S1] b [S9] c [S9] [x]", ["S1", "S2"]), ("[S3]", None), (None, ["S1"]), ("none", [])]
    got = [(r.answer, r.used) for r in R.confirmed_answers(spark.createDataFrame(rows, "t string, s array<string>"), "t", "s").collect()]
    no = "[source not confirmed]"
    assert got == [(f"a [S1] b {no} c {no} [x]", ["S1"]), (no, []), (None, []), ("none", [])]


def test_evaluation(spark):
    reference = spark.createDataFrame([(1, "a", "high", True), (2, "a", None, False), (3, None, "high", True)], "id int, category string, severity string, found boolean")
    issued = spark.createDataFrame([(1, ["p1"], "correct", None), (2, ["p2"], "partially_correct", 1), (3, [], "incorrect", None)], "id int, locators array<string>, verdict string, duplicate_of int")
    controls = spark.createDataFrame([(1, ["p2", "p9"], True), (2, ["p8"], False)], "id int, locators array<string>, triggered boolean")
    run = lambda r=reference, i=issued, c=controls: {(x.dimension, x.value): (x.n, x.hits, x.rate) for x in U.evaluation_summary(r, i, c, ["category", "severity"]).collect()}
    got = run()
    assert got["all", None] == (3, 2, 2 / 3) and got["category", "a"] == (2, 1, 0.5) and got["category", "unspecified"] == (1, 1, 1.0) and got["severity", "high"] == (2, 2, 1.0)
    assert got["precision", None] == (3, 1, 1 / 3) and got["duplicates", None] == (3, 1, 1 / 3) and got["controls", None] == (2, 1, 0.5)
    got = run(reference.withColumn("found", F.when(F.col("id") > 1, F.col("found"))), issued.withColumn("verdict", F.when(F.col("id") > 1, F.col("verdict"))), controls.withColumn("triggered", F.when(F.col("id") > 1, F.col("triggered"))))
    assert [got[k][2] for k in (("all", None), ("category", "a"), ("duplicates", None), ("controls", None))] == [None] * 4 and got["precision", None] == (2, 0, 0.0)
    empty = run(reference.where("false"), issued.where("false"), controls.where("false"))
    assert {k: v[0] for k, v in empty.items()} == {("precision", None): 0, ("duplicates", None): 0, ("controls", None): 0} and {v[2] for v in empty.values()} == {None}


def test_log_profile(spark):
    span = '{"kind": "span", "name": "%s", "status": "%s", "seconds": %s, "exclusive_seconds": 1}'
    lines = [span % ("a", "ok", 2), span % ("a", "failed", 3), span % ("a", "ok", '"x"'), "{", "", None, "[1]", '{"kind": "span", "name": "a"}', '{"kind": "new"}', '{"kind": "observation", "name": "rows", "value": 4}', '{"kind": "observation", "name": "rows", "value": 1}']
    lines += ['{"kind": "start", "session": 1}', '{"kind": "end", "session": 1, "seconds": 9}', '{"kind": "start", "session": 2}', '{"kind": "end", "session": 3, "seconds": 1}', '{"kind": "end", "session": 4}']
    shape = "kind string, name string, status string, session long, seconds double, exclusive_seconds double, value double"
    got = {(r.kind, r.name): (r.n, r.errors, r.total, r.exclusive) for r in U.span_profile(spark.createDataFrame([(x,) for x in lines], "line string"), "line", shape).collect()}
    assert got.pop(("malformed", None))[0] == 8
    assert got.pop(("observation", "rows"))[::2] == (2, 5.0)
    assert got == {("phase", "a"): (2, 1, 5.0, 2.0), ("sessions", "complete"): (1, 0, 9.0, None), ("sessions", "incomplete"): (1, 0, None, None), ("sessions", "stray"): (1, 0, 1.0, None)}


def test_coverage_samples(spark):
    rows = [("k", "measured", i, f"p{i}" if i % 2 else None, None) for i in range(50)] + [("k", "unverified", 1, "z", "s"), (None, "measured", 1, "q", "s"), ("k", "violated", 1, "z", "s")]
    got = {(r.k, r.state): (r.occurrences, r.locators, r.sections) for r in U.compact_coverage(spark.createDataFrame(rows, "k string, state string, o int, l string, s string"), ["k"], "state", "o", "l", "s", 3).collect()}
    assert got == {("k", "measured"): (50, ["p1", "p3", "p5"], []), ("k", "unverified"): (1, ["z"], ["s"]), (None, "measured"): (1, ["q"], ["s"])}


TASK = "job string, id int, stage string, state string, started double, ended double, cached boolean, known boolean, input long, prompt long, completion long, prompt_rate double, generation_rate double"


def test_forecast(spark):
    """By rates, by median times and by defaults; running and cached tasks; work that doesn't exist yet."""
    t = lambda job, i, stage, state, started=None, ended=None, **k: (job, i, stage, state, started, ended, k.get("cached"), k.get("known"), k.get("input"), k.get("prompt"), k.get("completion"), k.get("pr"), k.get("gr"))
    tasks = [t("r", 1, "logic", "done", 0.0, 9.0, prompt=1000, completion=100, pr=100.0, gr=10.0), t("r", 2, "logic", "done", 0.0, 1.0, cached=True, prompt=9, completion=9, pr=1.0, gr=1.0), t("r", 3, "logic", "pending", input=500), t("r", 4, "logic", "pending", known=True), t("r", 5, "language", "running", 95.0), t("r", 6, "sto", "pending")]
    tasks += [t("m", 1, "logic", "done", 0.0, 10.0), t("m", 2, "logic", "split", 0.0, 20.0), t("m", 3, "logic", "pending"), t("m", 4, "sto", "running", 0.0)]
    jobs = spark.createDataFrame([("r", 100.0, [], 2, True), ("m", 100.0, ["cross", "inter", "verify"], 9, True), ("none", 1.0, None, 0, None)], "job string, now double, derived array<string>, related int, check_logic boolean")
    facts = spark.createDataFrame([("r", "x", p) for p in "aab" * 3] + [("r", "alone", "a")] * 20, "job string, topic string, place string")
    references = spark.createDataFrame([("r", 1, 13), ("r", 2, 1)], "job string, document int, n int")
    findings = spark.createDataFrame([("r", s) for s in ("candidate", "candidate", "confirmed", "style")], "job string, status string")
    df = spark.createDataFrame(tasks, TASK)
    future = U.derived_work(jobs, df, facts, references, findings)
    got = {(r.job, r.stage): r.future for r in future.collect()}
    # 9 facts of a topic are 2 tasks, of 2 finished of 4 logic tasks: 4; links 2 + 1; reviewed 1 of 2 analysed, 7 + 24 + 4 tasks ahead
    assert got == {("r", "cross"): 7, ("r", "inter"): 24, ("r", "verify"): 7, ("none", "cross"): 0, ("none", "inter"): 0, ("none", "verify"): 0}
    s = {(r.job, r.stage): (r.open, r.future, r.seconds) for r in U.forecast(jobs, df, future, {"sto": 700, "cross": 1100, "inter": 1100, "verify": 500, "language": 800}).collect()}
    assert s["r", "logic"] == (2, 0, 500 / 100 + 100 / 10 + 1 + 1) and s["r", "language"] == (1, 0, 40 + 80 + 1 - 5.0) and s["r", "sto"] == (1, 0, 40 + 70 + 1.0)
    assert s["r", "cross"] == (0, 7, 7 * (40 + 110 + 1.0)) and s["m", "logic"] == (1, 0, 15.0) and s["m", "sto"] == (1, 0, 3.0)


def test_diff_rounds_are_windows(spark):
    """each round joined both releases in full and joined what was left with what was found, so a task sorted all of them; now one join on the lineage and a window a round, and nulls match nothing."""
    shape = "id int, family string, lineage string, meaning string, locator string, context string, trust string"
    old = [(1, "f", "L", "a", "1", "c", "t"), (2, "f", "L", "b", "2", "c", "t"), (3, None, None, "m", "3", "c", "t"), (4, "f", None, None, "4", "c", "t"), (5, "f", None, "x", "5", "c", "t"), (6, "f", None, "x", "6", "c", "t"), (7, "f", None, "y", None, None, "t")]
    new = [(11, "f", "L", "a", "1", "d", "t"), (13, None, None, "m", "3", "c", "t"), (14, "f", None, None, "4", "c", "u"), (15, "f", None, "x", "5", "c", "t"), (17, "f", None, "y", "7", "z", "t"), (18, "f", None, "w", None, "c", "t")]
    df = D.release_diff(spark.createDataFrame(old, shape), spark.createDataFrame(new, shape))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.o_id, r.n_id): r.kind for r in df.collect()}
    assert got == {(1, 11): "context_changed", (2, 11): "meaning_changed", (3, None): "removed", (None, 13): "added", (4, 14): "trust_changed", (5, 15): "same", (6, None): "removed", (7, 17): "same", (None, 18): "added"}
