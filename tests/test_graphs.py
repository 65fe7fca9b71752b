import random

from clausework.operators import dedup as D
from clausework.operators import graphs as G
from clausework.operators import rules as U
from tests.test_operators import FINDING, finding


def edges(spark, rows, names="child long, parent long"):
    return spark.createDataFrame(rows, names)


def test_closure_of_any_depth(spark):
    """A chain of 40 is whole; a cycle is marked on all that it holds; diamonds have the shortest distance."""
    rows = [(k, k - 1) for k in range(1, 41)] + [(100, 101), (101, 100), (102, 100), (50, 51), (50, 52), (51, 53), (52, 53), (50, 53), (60, None)]
    got = {(r.node, r.ancestor): (r.distance, r.cycle) for r in U.closure(edges(spark, rows)).collect()}
    assert all(got[k, j] == (k - j, False) for k in range(41) for j in range(k + 1))
    assert got[102, 101] == (2, True) and got[100, 100] == (0, True) and got[102, 102] == (0, False)
    assert got[50, 53] == (1, False) and got[60, 60] == (0, False)


def test_rejected_profiles(spark):
    nodes = spark.createDataFrame([(k,) for k in [*range(20), 30, 31, 32, 40, 41]], "node long")
    rows = [(k, k - 1) for k in range(1, 20)] + [(30, 31), (31, 30), (32, 31), (40, 99), (41, 40)]
    got = {r.node: r.problems for r in U.rejected(nodes, edges(spark, rows)).collect()}
    assert got == {**{k: ["depth"] for k in range(13, 20)}, 30: ["cycle"], 31: ["cycle"], 32: ["cycle"], 40: ["unknown"], 41: ["unknown"]}


def test_components(spark):
    rng = random.Random(4)
    rows = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in G.components(edges(spark, rows, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def sequential(own, looks):
    taken, out = set(), {}
    for i in sorted(set(own) | set(looks)):
        out[i] = taken.isdisjoint(looks.get(i, ()))
        if out[i]:
            taken |= set(own.get(i, ()))
    return out


def kept(spark, own, looks, **more):
    flat = lambda d: spark.createDataFrame([(i, k) for i, ks in d.items() for k in ks], "id long, key string")
    return {r.id: r.kept for r in D.first_kept(flat(own), flat(looks), **more).collect()}


def test_chains_and_stars_settle(spark):
    """A chain of a thousand, whole and in turns of 64 ids; a star of a hundred thousand; random graphs: as the sequential rule says."""
    chain = {k: [f"k{k}"] for k in range(1000)}, {k: [f"k{k - 1}"] for k in range(1, 1000)}
    want = {k: k % 2 == 0 for k in range(1000)}
    assert kept(spark, *chain) == want
    assert kept(spark, *chain, most=300) == want
    star = spark.range(100_000).selectExpr("id", "'hub' AS key")
    assert D.first_kept(star, star).where("kept").collect()[0].id == 0
    rng = random.Random(8)
    for _ in range(3):
        own = {i: {f"k{rng.randint(0, 60)}" for _ in range(2)} for i in range(150)}
        looks = {i: {f"k{rng.randint(0, 60)}" for _ in range(2)} for i in range(150)}
        assert kept(spark, own, looks, peel=2, most=7) == sequential(own, looks)


def test_duplicates_along_a_chain(spark):
    """Each finding is like the next one only: every second is a duplicate of the one before it."""
    rows = [finding(i, "a" * (200 - i) + "b" * i) for i in range(0, 160)]
    rows = [r for k, r in enumerate(rows) if k % 12 == 0 or k % 12 == 11]
    rows = rows[:20]
    from difflib import SequenceMatcher  # noqa: F401

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    issue = {r[0]: next(v for v in r if isinstance(v, str) and v.startswith("a" * 20)) for r in rows}
    want, chosen = {}, []
    for i in sorted(issue):
        like = [j for j in chosen if 1 - distance(issue[i], issue[j]) / max(len(issue[i]), len(issue[j])) >= 0.9]
        want[i] = like[0] if like else None
        if not like:
            chosen.append(i)
    got = {r.id: r.duplicate_of for r in D.duplicate_groups(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == want and len(chosen) > 1 and any(want.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edits_within():
    rng = random.Random(12)
    for _ in range(5000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        most, edits = rng.randint(0, 8), distance(a, b)
        assert D.edits_within(a, b, most) == (edits if edits <= most else None)


def test_duplicates_in_turn_and_by_keys(spark):
    """places that one task goes through, places beyond its rows, and both together follow the sequential rule; one of them keeps many texts of one suggestion."""
    rng, long = random.Random(9), "put what the contract says here"
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(9, 40))) for _ in range(30)]
    rows = []
    for i in range(240):
        issue = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(issue))
            issue[at : at + 1] = rng.choice(["", "x", issue[at] + "y"])
        place = "hot" if i % 3 else f"p{rng.randrange(12)}"
        rows.append(finding(i, "".join(issue), rng.choice([long, "fix", "fix"]), rng.choice([None, None, None, "", f"k{rng.randrange(9)}"]), place, f"q{rng.randrange(9)}", rng.choice(["c", "c", "c", "d"])))
    kept, want = [], {}
    for r in rows:
        i, _, category, evidence, key, suggestion, issue = r
        near = [k for k in kept if k[2] == category and k[3][0][1] == evidence[0][1]]
        near = [k for k in near if key and k[4] == key or k[5] == suggestion and 1 - distance(k[6], issue) / max(len(k[6]), len(issue)) >= 0.9]
        near = near or [k for k in kept if suggestion == long and k[5] == long and k[3] == evidence]
        want[i] = near[0][0] if near else None
        if not near:
            kept.append(r)
    df = spark.createDataFrame(rows[::-1], FINDING)
    for few in (20_000, 20, 1):
        assert {r.id: r.duplicate_of for r in D.duplicate_groups(df, few=few).collect()} == want
    same = [k for k in kept if k[3][0][1] == "hot" and k[2] == "c" and k[5] == "fix"]
    assert len(same) > D.KeptTexts.few and 50 < sum(x is not None for x in want.values()) < 200


def test_duplicates_write_no_pairs(spark, monkeypatch):
    """sixty findings that are all alike have 1 770 pairs; none is written, nor is a row where one task goes through them."""
    from clausework.sources.scratch import written

    sizes = []

    def counted(df, tag="table"):
        out = written(df, tag)
        sizes.append((tag, out.count()))
        return out

    monkeypatch.setattr(D, "written", counted)
    df = spark.createDataFrame([finding(i, f"the value {i} of the table differs from the contract") for i in range(10, 70)], FINDING)
    for few, most in ((20_000, 0), (20, 70)):  # beyond ``few`` rows a row is written once with its match
        got = {r.id: r.duplicate_of for r in D.duplicate_groups(df, few=few).collect()}
        assert got == {10: None, **dict.fromkeys(range(11, 70), 10)} and sum(n for _, n in sizes) <= most


def test_duplicates_of_half_evidence(spark):
    """a missing locator counts as empty: a quote is no locator."""
    rows = [(i, "r", c, [("d", *place)], None, "put what the contract says here", f"{i} differs") for i, c, place in ((1, "c", (None, "q")), (2, "d", ("q", None)), (3, "e", ("", "q")), (4, "f", ("q", "")))]
    df = spark.createDataFrame(rows, FINDING)
    for few in (20_000, 1):
        assert {r.id: r.duplicate_of for r in D.duplicate_groups(df, few=few).collect()} == {1: None, 2: None, 3: 1, 4: 2}


def test_similar_texts(spark):
    """All pairs above the bound are found in spite of the blocking; other groups, short and null texts don't meet."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (9, 10, 12, 30, 31, 60)]
    texts = []
    for t in base:
        for _ in range(12):
            u = list(t)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(u))
                u[at : at + 1] = rng.choice([[], ["x"], [u[at], "y"]])
            texts.append("".join(u))
    rows = [("g", i, t) for i, t in enumerate(texts)] + [("h", 900, texts[0]), ("g", 901, None), ("g", 902, "")]
    df = spark.createDataFrame(rows, "g string, id long, t string")
    got = {(r.a, r.b) for r in D.similar_texts(df, "g", "id", "t").collect()}
    like = df.selectExpr("id AS a", "t AS s").where("g = 'g'").crossJoin(df.selectExpr("id AS b", "t AS u").where("g = 'g'"))
    want = {(r.a, r.b) for r in like.where("a <> b AND length(s) >= 3 AND length(u) >= 3 AND s <> u AND 1 - levenshtein(s, u) / greatest(length(s), length(u)) >= 0.9").select("a", "b").collect()}
    assert {p for p in got if texts[p[0]] != texts[p[1]]} == want and len(want) > 20


def test_dependencies_shuffle_paths_once_a_step(spark):
    import random

    from clausework.operators.joins import transitive_dependencies

    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(40)) for _ in range(70)] * 2 + [(3, 3), (None, 1), (1, None)]
    sizes = {i: rng.randrange(50) for i in range(0, 40, 2)}
    out = {}
    for s, t in set(edges):
        if s is not None and t is not None:
            out.setdefault(s, set()).add(t)
    want = set()
    for root in out:
        depth, level = {}, {root}
        for k in (1, 2, 3):
            level = {t for n in level for t in out.get(n, ())}
            for t in level - {root}:
                depth.setdefault(t, k)
        used = 0
        for d, n in sorted((d, n) for n, d in depth.items()):
            used += sizes.get(n, 0)
            want.add((root, n, d, used <= 120, n in sizes))
    got = transitive_dependencies(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame(list(sizes.items()), "id long, size int"), budget=120)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    # edges: two for the join with sizes, one to be found as targets; a step: its paths by their end; all paths by root
    assert sum(line.lstrip(" :+-*(0123456789)").startswith("Exchange") for line in plan.splitlines()) <= 9
