"""Operators that SQL can't express against plain versions, and small cases of the others."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from clausework.functions import text as T
from clausework.operators import blocks as B
from clausework.operators import dedup as D
from clausework.operators import joins as J
from clausework.operators import retrieval as R
from clausework.operators import rollup as A
from clausework.operators import rules as U
from clausework.operators import texts as X
from clausework.operators.packing import count_words, lossless_chunks
from clausework.plans.registry import QUERIES


def by(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def test_truth_table(spark):
    values = [True, False, None]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    fact = lambda n, _: F.col(n)
    both = U.compile_rule({"all_of": [{"fact": "a", "in": []}, {"fact": "b", "in": []}]}, fact)
    one = U.compile_rule({"any_of": [{"fact": "a", "in": []}, {"not": {"fact": "b", "in": []}}]}, fact)
    for r in df.select("a", "b", both.alias("x"), one.alias("y")).collect():
        assert r.x == (False if False in (r.a, r.b) else None if None in (r.a, r.b) else True)
        nb = None if r.b is None else not r.b
        assert r.y == (True if True in (r.a, nb) else None if None in (r.a, nb) else False)
    with pytest.raises(ValueError):
        deep = {"unknown": "x"}
        for _ in range(14):
            deep = {"not": deep}
        U.compile_rule(deep, fact)


def test_incomplete_list_is_unknown(spark):
    df = spark.createDataFrame([(["a"], True, 1), (["b"], True, 1), (["b"], False, 1), (["a"], True, 0)], "v array<string>, c boolean, e int")
    got = [r[0] for r in df.select(U.fact_predicate(F.col("v"), F.col("c"), F.col("e"), ["a"])).collect()]
    assert got == [True, False, None, None]


def test_lossless_chunks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chunks = by(lossless_chunks(docs, "doc_id", "text", limit=50).collect(), "doc_id")
    for d in docs.collect():
        own = sorted(chunks[(d.doc_id,)], key=lambda r: r.start)
        assert "".join(r.chunk for r in own) == d.text
        assert all(count_words(r.chunk) <= 50 for r in own)


def test_greedy_groups(spark, sf):
    rows = QUERIES["src8_clause_chunks"](spark, sf).collect()
    blocks = B.build_blocks(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    long = {(b.doc_id, b.ord): len(b.text) > 2000 for b in blocks}
    for _, own in by(rows, "doc_id").items():
        own.sort(key=lambda r: (r.ord, r.part_offset))
        group, used, before = -1, 0, None
        for r in own:
            now = long[r.doc_id, r.ord]
            if group < 0 or used + r.n > 2000 or now != before:
                group, used = group + 1, 0
            used, before = used + r.n, now
            assert r.group == group
    assert {(r.doc_id, r.ord) for r in rows} == set(long)


def test_packets_own_each_block_once(spark, sf):
    owned = by(QUERIES["src11_context_packets"](spark, sf).collect(), "doc_id")
    blocks = by(B.build_blocks(spark.read.parquet(f"{sf}/documents.parquet")).collect(), "doc_id")
    for k, own in blocks.items():
        ords = sorted(b.ord for b in own)
        assert sorted(p.ord for p in owned[k] if p.role == "owned") == ords
        assert len({(p.group, p.ord) for p in owned[k]}) == len(owned[k]) and {p.ord for p in owned[k]} == set(ords)


def test_budgeted_batches(spark, sf):
    """Every rule of a document meets every block of it once, within the budget, in contiguous groups of at most 16; the rest is reported."""
    from clausework.operators.register import budgeted_batches

    blocks = by(B.build_blocks(spark.read.parquet(f"{sf}/documents.parquet")).collect(), "doc_id")
    items = {r.item_id: len(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = by(QUERIES["reg9_budgeted_batches"](spark, sf).collect(), "doc_id")
    assert sum(len(rows) for rows in got.values()) > len(got)
    for (doc,), own in blocks.items():
        size = {b.ord: len(b.text) for b in own}
        asked = sorted(i for i in items if i % 10 == doc % 10)
        met = defaultdict(list)
        for r in got[(doc,)]:
            group = [i for i in asked if r.first_rule <= i <= r.last_rule]
            assert len(group) == r.rules <= 16
            if r.fits:
                held = [o for o in size if r.first <= o <= r.last]
                assert r.size == sum(items[i] for i in group) + sum(size[o] for o in held) <= 3000
                for i in group:
                    met[i] += held
            else:
                assert r.rules == 1 and items[r.first_rule] + max(size.values()) > 3000
                met[r.first_rule] = None
        assert sorted(met) == asked
        assert all(v is None or sorted(v) == sorted(size) for v in met.values())
    rules = spark.createDataFrame([("d", i, 10) for i in range(20)] + [("e", 1, 5)], "doc string, rule long, cost long")
    parts = spark.createDataFrame([("d", i, 30, i == 3) for i in range(5)] + [("f", 0, 1, True)], "doc string, ord long, n long, head boolean")
    rows = [tuple(r) for r in budgeted_batches(rules, parts, "doc", 300).orderBy("doc", "first_rule", "part").collect()]
    assert rows == [("d", 0, 15, 16, 0, 0, 2, 250, True), ("d", 0, 15, 16, 1, 3, 4, 220, True), ("d", 16, 19, 4, 0, 0, 4, 190, True), ("e", 1, 1, 1, None, None, None, 5, False)]


def test_overlap_packs(spark, sf):
    rows = QUERIES["reg8_overlap_packs"](spark, sf).collect()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert len(rows) == lines
    assert max(len(v) for v in by(rows, "l_orderkey", "pack").values()) <= 3


def test_sentences(spark):
    df = spark.createDataFrame([(1, "It is 3.5 now. Then — stop!  Go; and on? Yes")], "doc_id long, text string")
    got = B.sentence_spans(df, "doc_id", "text").orderBy("n").collect()
    text = df.head().text
    assert [r.sentence for r in got] == ["It is 3.5 now.", "Then — stop!", "Go; and on?", "Yes"]
    assert all(text[r.start : r.end] == r.sentence for r in got)


def test_bounds(spark):
    df = spark.createDataFrame([(">=", 5, "<=", 3), (">=", 3, "<=", 3), (">", 3, "<=", 3), (">=", 1, ">=", 9), ("=", 2, "<", 2), ("~", 1, "=", 1)], "a string, x int, b string, y int")
    assert [r[0] for r in df.select(J.compatible(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()] == [False, True, False, True, False, None]


def finding(i, issue, suggestion="", key=None, place="p", quote="q", category="c"):
    return (i, "r", category, [("d", place, quote)], key, suggestion, issue)


FINDING = "id int, requirement string, category string, evidence array<struct<document:string,locator:string,quote:string>>, defect_key string, suggestion string, issue string"


def test_first_keep_is_not_transitive(spark):
    rows = [finding(1, "aaaaaaaaaa"), finding(2, "aaaaaaaaab"), finding(3, "aaaaaaaabb"), finding(4, "aaaaaaaaaa", place="z")]
    got = {r.id: r.duplicate_of for r in D.duplicate_groups(spark.createDataFrame(rows, FINDING), 0.9).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None}


def test_duplicate_rules(spark):
    """Defect keys, equal suggestions across categories with the same quotes, and a hot key that holds a third of the rows."""
    long = "replace it by what the contract says"
    rows = [finding(1, "x", key="k"), finding(2, "quite different", key="k"), finding(3, "y", long), finding(4, "zzz", long, category="other"), finding(5, "zzz", long, category="other", quote="else"), finding(6, "w", "fix", category="other"), finding(7, "w", "fix")]
    rows += [finding(100 + i, "same words", "ok", place="hot") for i in range(40)] + [(200, None, None, None, None, None, None), (201, None, None, None, None, None, None)]
    got = {r.id: r.duplicate_of for r in D.duplicate_groups(spark.createDataFrame(rows, FINDING)).collect()}
    assert {i: got[i] for i in range(1, 8)} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None, 7: None}
    assert got[100] is None and all(got[100 + i] == 100 for i in range(1, 40))
    assert got[200] is None and got[201] == 200
    assert D.duplicate_groups(spark.createDataFrame([], FINDING)).count() == 0


def test_revision_cycle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 3)], "id long, before long")
    assert {r.node: r.root for r in D.revision_roots(df, "id", "before").collect()} == {1: 1, 2: 1, 3: 1, 9: 1}


def test_selection_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("a", 1, 50, "x"), ("a", 2, 60, "y"), ("a", 3, 30, "z")], "k string, o int, s int, i string")
    assert sorted(r.i for r in R.greedy_selection(df, "k", ["o"], "s", 80, 3, "i").collect()) == ["x", "z"]


def test_text(spark):
    df = spark.createDataFrame([("1 234,50",), ("1.5",), ("x",), (None,)], "t string")
    assert [None if r[0] is None else float(r[0]) for r in df.select(T.decimal_value("t")).collect()] == [1234.5, 1.5, None, None]
    flags = X.text_flags(spark.createDataFrame([(1, "a (b the the c"), (2, "x) theme me")], "id int, t string"), ["id"], "t").orderBy("id").collect()
    assert [(r.open_brackets, r.doubled) for r in flags] == [(1, "the"), (-1, None)]
    bad = X.numeric_literals(spark.createDataFrame([(1, "at least 5 ms, 7 and 12,5")], "id int, t string"), ["id"], "t").collect()
    assert [(r.operator, r.value, r.unit) for r in bad] == [("at least", "5", "ms"), ("", "12,5", "")]


def test_exclusive_time_is_never_negative(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, 1, 9.0), (3, 2, 1.0)], "id int, parent int, seconds double")
    assert {r.id: r.exclusive for r in A.exclusive_seconds(df).collect()} == {1: 0.0, 2: 8.0, 3: 1.0}


@pytest.mark.parametrize("name", ["src6_heading_path", "ext15_span_runs", "jn21_edit_plan", "agg1_decision_parts"])
def test_partitioning_does_not_matter(spark, sf, name):
    first = sorted(map(str, QUERIES[name](spark, sf).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, QUERIES[name](spark, sf).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_degradation_by_hand(spark):
    import math
    from statistics import median

    from clausework.plans.stream import samples

    sf = "/root/testdata/sf0.01"
    rows = samples(spark.read.parquet(f"{sf}/events.parquet")).collect()
    seen, alarm, want = defaultdict(list), {}, set()
    for r in sorted(rows, key=lambda r: (r.ended, r.id)):
        if r.prompt < 200 or r.predicted < 96:
            continue
        k = (r.stage, math.floor(math.log(r.prompt) / math.log(1.25)))
        seen[k].append(r)
        own = seen[k]
        low = all(median([getattr(x, c) for x in own[-4:]]) < 0.85 * median([getattr(x, c) for x in own[:5]]) for c in ("prefill", "generation"))
        if len(own) >= 9 and low and (k not in alarm or math.floor(r.ended.timestamp()) - alarm[k] >= 3600):
            alarm[k] = math.floor(r.ended.timestamp())
            want.add((*k, len(own)))
    assert {(r.stage, r.bucket, r.n) for r in QUERIES["str4_throughput_degradation"](spark, sf).collect()} == want


def test_dense_top_ranks_all_equal_vectors(spark, monkeypatch):
    """Of 100 equal vectors those with the smallest keys come out, wherever they stand in a block and however blocks are cut; a zero vector spoils nothing."""
    from clausework.operators.retrieval import dense_top

    rows = [((i * 37) % 100, [1.0, 2.0, 3.0]) for i in range(100)] + [(100 + i, [3.0, 1.0 + i, -2.0]) for i in range(20)] + [(500, [0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    for numbers in (R.BROADCAST_NUMBERS, -1):  # by broadcast, and by a join of blocks
        monkeypatch.setattr(R, "BROADCAST_NUMBERS", numbers)
        got = dense_top(e.where("id in (60, 110)"), e.coalesce(1), "id", "v", 10, salts=3).collect()
        assert [r.key for r in sorted(got, key=lambda r: (r.query, r["rank"]))[:10]] == list(range(10))
        assert len(got) == 20


def test_dense_top_leaves_null_and_zero_vectors_out(spark, monkeypatch):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [None, 1.0], "a"), (None, [1.0, 0.0], "a"), (7, [1.0, 0.0], None), (8, [1.0, 0.0], "b"), (9, [float("nan"), 1.0], "a")]
    e = spark.createDataFrame(rows, "id long, v array<double>, area string")
    for numbers in (R.BROADCAST_NUMBERS, -1):
        monkeypatch.setattr(R, "BROADCAST_NUMBERS", numbers)
        got = {(r.query, r.key) for r in R.dense_top(e, e, "id", "v", 5, ["area"]).collect()}
        assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (8, 8)}
        assert R.dense_top(e.where("false"), e, "id", "v", 5).count() == 0 == R.dense_top(e, e.where("false"), "id", "v", 5).count()


def test_dense_top_compares_equal_dimensions_only(spark, monkeypatch):
    rows = [(1, [1.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 1.0]), (5, []), (6, [0.0, 2.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    for numbers in (R.BROADCAST_NUMBERS, -1):
        monkeypatch.setattr(R, "BROADCAST_NUMBERS", numbers)
        got = {(r.query, r.key) for r in R.dense_top(e, e.coalesce(1), "id", "v", 5).collect()}
        assert got == {(1, 1), (2, 2), (2, 6), (6, 6), (6, 2), (3, 3), (3, 4), (4, 4), (4, 3)}
        assert {(r.query, r.key, r.score) for r in R.dense_top(e.where("id = 3"), e, "id", "v", 1).collect()} == {(3, 3, 1.0)}
        assert R.dense_top(spark.createDataFrame([(9, [1.0] * 7)], "id long, v array<double>"), e, "id", "v", 5).count() == 0


@pytest.mark.parametrize("most", [R.BROADCAST_TERMS, -1])
def test_ranked_terms_with_ties_and_nulls(spark, monkeypatch, most):
    """Both ways of ranking agree: blocks of products, and joins for large sets of queries."""
    monkeypatch.setattr(R, "BROADCAST_TERMS", most)
    monkeypatch.setattr(R, "DOCS", 7)
    monkeypatch.setattr(R, "QUERIES", 2)
    docs = [(i, ["a"] * (i % 3 + 1) + ["b"] * (i % 2) + [f"x{i % 5}"]) for i in range(60)] + [(100, None), (101, []), (102, ["zz"])]
    queries = [(f"q{i}", t) for i, t in enumerate((["a"], ["b", "b", "b", "x1"], ["a", "x2", "zz"], [], None, ["nowhere"]))]
    d, q = spark.createDataFrame(docs, "doc long, terms array<string>"), spark.createDataFrame(queries, "q string, terms array<string>")
    for f, g in ((R.bm25_top, R.bm25), (R.tf_idf_top, R.tf_idf)):
        want = R.top(g(q, d, "q", "doc"), "query", "score", ["doc"], 9).collect()
        got = f(q, d, "q", "doc", 9).collect()
        assert sorted((r.query, r.doc, r["rank"], round(r.score, 6)) for r in got) == sorted((r.query, r.doc, r["rank"], round(r.score, 6)) for r in want)
        assert len(got) == 27
        assert f(q.where("false"), d, "q", "doc", 9).count() == 0 == f(q, d.where("false"), "q", "doc", 9).count()


@pytest.mark.parametrize("runs", [500_000, -1])
def test_short_quotes_are_found_and_recovered(spark, monkeypatch, runs):
    """Quotes of 1 to 6 words, glued to others at their edges and with other white space, against brute force; by broadcast and by a join."""
    from clausework.operators import extract
    from clausework.operators.extract import find_quotes, recover_quotes

    monkeypatch.setattr(extract, "BROADCAST_RUNS", runs)

    docs = {1: "alpha beta gamma delta epsilon zeta eta theta", 2: "xalpha  beta\tgammas delta (epsilon)", 3: "beta beta gamma", 4: None, 5: ""}
    quotes = {i: q for i, q in enumerate(["alpha", "beta gamma", "pha beta gam", "beta gamma delta eps", "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta", "alpha  beta", "beta  beta gamma", "missing", "a"])}
    d = spark.createDataFrame(list(docs.items()), "doc long, text string")
    q = spark.createDataFrame(list(quotes.items()), "item long, quote string")
    got = {(r.item, r.doc, r.start, r.end) for r in find_quotes(q, d, "item", "doc").collect()}
    assert got == {(i, k, t.find(x), t.find(x) + len(x)) for i, x in quotes.items() for k, t in docs.items() if t and x in t}
    flat = lambda t: " ".join(t.split())
    want = {(i, k, "exact" if x in t else "recovered") for i, x in quotes.items() for k, t in docs.items() if t and (x in t or flat(t).count(flat(x)) == 1)}
    assert {tuple(r) for r in recover_quotes(q, d, "item", "doc").collect()} == want
    assert {(1, 2, "recovered"), (6, 1, "recovered"), (7, 3, "recovered")} <= want


def test_row_differences_name_every_document(spark):
    """Pairs of representatives and the membership give all differing pairs of documents back."""
    from itertools import combinations

    from clausework.operators.joins import row_difference_members, row_differences

    data = {("k", 1): "a", ("k", 2): "a", ("k", 3): "b", ("k", 4): "a", ("k", 5): "b", ("k", 6): "c", ("same", 1): "a", ("same", 2): "a"}
    rows = spark.createDataFrame([(k, d, v) for (k, d), v in data.items()], "key string, doc long, v string")
    members = {}
    for r in row_difference_members(rows, ["key"], "doc", ["v"]).collect():
        members.setdefault((r.key, r.representative), []).append(r.doc)
    pairs = row_differences(rows, ["key"], "doc", ["v"]).collect()
    got = {(r.key, *sorted((a, b))) for r in pairs for a in members[r.key, r.a] for b in members[r.key, r.b]}
    assert got == {(x[0], x[1], y[1]) for x, y in combinations(sorted(data), 2) if x[0] == y[0] and data[x] != data[y]}
    assert all(len(members[r.key, r.a]) == r.of_a and len(members[r.key, r.b]) == r.of_b for r in pairs)
    assert {k for k, _ in members} == {"k"}


def test_implied_bounds(spark):
    """Against the integers that two bounds allow in a small range."""
    from itertools import product

    ops = {"<": lambda x, v: x < v, "<=": lambda x, v: x <= v, "=": lambda x, v: x == v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v}
    df = spark.createDataFrame(list(product(ops, (3, 4), ops, (3, 4))) + [("~", 3, "=", 3)], "a string, x int, b string, y int")
    halves = [k / 2 for k in range(-10, 30)]
    for r in df.withColumn("got", J.implies(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect():
        want = None if r.a == "~" else all(ops[r.a](v, r.x) for v in halves if ops[r.b](v, r.y))
        assert r.got == want, r


def test_area_round_trip(spark):
    """An area in order has no problem, and all its references stand under the new ids; absent types are empty."""
    from clausework.sources.area import AREA, area_problems, export_area, import_area, read_area

    def rows(kind, *values):
        return {kind: spark.createDataFrame(list(values), AREA[kind])}

    card = lambda i, kind, term, quote: (i, "s", kind, term, "text", "p", [("p1", quote, 0, len(quote))])
    area = rows("source", ("s", "n", "quoted words")) | rows("profile", ("p", "n", [], ["s"])) | rows("requirement", card("r", "rule", None, "quoted")) | rows("glossary", card("g", "definition", " Term", "quoted words"))
    area |= rows("choice", ("term", "g")) | rows("link", ("l", "r", "g", "r")) | rows("control", ("card", "r", True, False), ("link", "l", False, True))
    back = read_area(spark, export_area(spark, area))
    assert area_problems(back).count() == 0
    new = {k: df.collect() for k, df in import_area(back, "here").items()}
    assert new["requirement"][0].source_id == new["source"][0].id != "s"
    controls = {r.kind: r.id for r in new["control"]}
    assert controls["link"] == new["link"][0].id
    assert new["link"][0].source == new["requirement"][0].id == controls["card"] and new["link"][0].target == new["glossary"][0].id == new["choice"][0].active_entry_id
    assert new["profile"][0].sources == [new["source"][0].id]
    assert area_problems(read_area(spark, export_area(spark, {}))).count() == 0


def test_access_without_roles(spark):
    asked = spark.createDataFrame([("u", "n", "u"), ("v", "n", None), ("w", "n", "u"), ("x", None, None), (None, "n", None)], "user string, node string, owner string")
    users = spark.createDataFrame([("u", "plain"), ("v", "staff"), ("w", "expert")], "user string, kind string")
    grants, roles = spark.createDataFrame([("w", "top", "editor")], "user string, scope string, role string"), spark.createDataFrame([("editor", "edit")], "role string, permission string")
    up = U.closure(spark.createDataFrame([("n", "top")], "child string, parent string"))
    got = {(r.user, r.node): (r.permissions, r.visible) for r in U.accessible(asked, users, grants, up, roles, ["edit", "read"]).collect()}
    assert got == {("u", "n"): ("", True), ("v", "n"): ("edit,read", True), ("w", "n"): ("edit,read", True), ("x", None): ("", False), (None, "n"): ("", False)}


def test_report_files(spark):
    """Files hold the lines in the order of the report, a folder a category."""
    from clausework.sources.area import report_lines, write_report
    from clausework.sources.scratch import new_folder

    rows = [("b", i, f"issue {i}", None, "s & t", [f"one\ntwo {i}"]) for i in range(40)] + [("a", 1, "<i>", "why", None, None)]
    lines = report_lines(spark.createDataFrame(rows, "category string, id int, issue string, explanation string, suggestion string, quotes array<string>"))
    path = new_folder(spark, "report")
    write_report(lines, path)
    read = lambda c: [r.value for r in spark.read.text(f"{path}/category={c}").orderBy(F.input_file_name()).collect()]
    assert read("a") == ["## a", "### <i>", "why", "Suggestion: "]
    assert read("b")[:6] == ["## b", "### issue 0", "", "Suggestion: s & t", "> one", "> two 0"] and len(read("b")) == 201
    assert {r.html for r in lines.where("category = 'a'").collect()} >= {"<h2>a</h2>", "<h3>&lt;i&gt;</h3>"}
    write_report(lines, new_folder(spark, "report"), "csv")


def test_members_of_row_differences_take_no_join(spark):
    """all documents' values were made twice and joined by themselves; now windows over one key tell the representatives."""
    from clausework.operators.joins import row_difference_members

    rows = [("k", 3, "a"), ("k", 1, "a"), ("k", 2, "b"), ("k", 2, "a"), ("one", 1, "a"), ("one", 2, "a"), ("one", 2, "a"), (None, 1, "a"), (None, 2, "b")]
    df = row_difference_members(spark.createDataFrame(rows, "key string, doc int, v string"), ["key"], "doc", ["v"])
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [("k", 1, 1), ("k", 2, 2), ("k", 3, 1)]
