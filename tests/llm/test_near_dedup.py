import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausework.llm import near_dedup as nd


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_force(texts):
    """Class (least index) of each text: components of all pairs of similarity 0.8 or more."""
    s = sets(texts)
    holds = defaultdict(set)
    for i, x in enumerate(s):
        for g in x:
            holds[g].add(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(s):
        common = defaultdict(int)
        for g in x:
            for j in holds[g]:
                if j < i:
                    common[j] += 1
        if not x:
            common = {j: 1 for j in range(i) if not s[j]}
        for j, c in common.items():
            if not x or c / (len(x) + len(s[j]) - c) >= 0.8 - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_sketch_estimates_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    texts = [" ".join(base), " ".join(base[:600] + [f"z{i}" for i in range(200)])]
    x = pa.array(texts, pa.large_string())
    doc, value, count, at = nd.shingles(x)
    r = nd.registers(doc, value, np.ones(len(doc)), 2, 4096)
    a, b = sets(texts)
    assert abs((r[0] == r[1]).mean() - len(a & b) / len(a | b)) < 0.04
    weights = np.where(np.arange(len(doc)) % 3 == 0, 5.0, 1.0)
    r = nd.registers(doc, value, weights, 2, 4096)
    sides = [(value[at[i] : at[i + 1]], weights[at[i] : at[i + 1]]) for i in (0, 1)]
    assert abs((r[0] == r[1]).mean() - nd.similarities(sides[:1], sides[1:], "count")[0, 0]) < 0.04


def test_probability_jaccard():
    u, v = {1: 2.0, 2: 1.0, 3: 4.0}, {1: 1.0, 3: 1.0, 4: 3.0}
    p, q = ({k: x / sum(d.values()) for k, x in d.items()} for d in (u, v))
    want = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in p.keys() | q.keys()) for d in p.keys() & q.keys())
    side = lambda d: [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))]
    assert abs(nd.similarities(side(u), side(v), "count")[0, 0] - want) < 1e-12


@pytest.mark.parametrize(("block", "facts"), [(nd.BLOCK_TEXTS, nd.BROADCAST_FACTS), (4, nd.BROADCAST_FACTS), (4, -1)])
def test_against_brute_force(spark, monkeypatch, block, facts):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", block)
    monkeypatch.setattr(nd, "BROADCAST_FACTS", facts)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " \n", "one two", "one  two", "one"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice((6, 40, 150, 400)))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 1, 3, 12))):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append("\n".join(copy) if rng.random() < 0.3 else " ".join(copy))
    want = brute_force(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in nd.near_duplicates(df).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    for i in range(len(texts)):
        assert got[i].class_size == want.count(want[i])
        assert got[i].kept == (want[i] == i)
    kept = nd.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_chains_of_a_large_cluster(spark, monkeypatch):
    """A chain of texts, each similar to the next only, and a group of copies of one of its links: heads settle a part, blocks of different components the rest."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 5)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words[i * 6 : i * 6 + 120]) for i in range(40)]
    texts += [" ".join(words[60:180] + [f"end{i}"]) for i in range(30)]
    rng = random.Random(3)
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)


def test_weights(spark):
    """Repeats count in the sketch: the share of equal registers follows the probability Jaccard similarity of the damped multiplicities."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base + base[:30] * 6)]
    doc, value, count, at = nd.shingles(pa.array(texts, pa.large_string()))
    weight = 1.5 - 0.5 / count
    assert weight.max() > 1
    r = nd.registers(doc, value, weight, 2, 8192)
    sides = [(value[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]) for i in (0, 1)]
    want = nd.similarities(sides[:1], sides[1:], "count")[0, 0]
    assert abs((r[0] == r[1]).mean() - want) < 0.03
    flat = nd.registers(doc, value, np.ones(len(doc)), 2, 8192)
    assert abs((flat[0] == flat[1]).mean() - want) > 0.03
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands = {w: nd.sketch(df, weights=w).orderBy("doc_id").select("bands").collect() for w in ("set", "damped", "count")}
    assert bands["set"][0] == bands["damped"][0] == bands["count"][0] and len({str(b[1]) for b in bands.values()}) == 3


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "other words stand here"), (9, "long " * 30_000)], "doc_id long, text string")
    rows = nd.near_duplicates(df).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 3
    assert len(nd.near_dedup(df).collect()) == 3
    assert nd.near_duplicates(df.where("false")).count() == 0
    assert nd.near_dedup(df.where("false")).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = brute_force([r.text for r in rows])
    got = {r.doc_id: r.class_id for r in nd.op2_near_dedup(spark, sf).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[i].doc_id for i in want]
    assert docs.select(nd.word_digest(F.col("text"))).distinct().count() == nd.sketch(docs).select("digest").distinct().count()


@pytest.mark.parametrize("times", [1, 3, 10, 100])
def test_recall_where_repeats_differ(times):
    """Texts of set similarity just above 0.8, of which one repeats a part of itself: their share of common bands at every part and number of repeats."""
    rng = np.random.default_rng(times)
    found, pairs = 0, 0
    for part in (0.1, 0.3, 0.4, 0.5, 0.7):
        for size in (60, 400):
            for _ in range(15):
                value = np.unique(rng.integers(1, 1 << 62, 3 * size, dtype=np.uint64))[: size + size // 4]
                rng.shuffle(value)
                lost = (len(value) - size) // 2
                a, b = np.sort(value[lost:]), np.sort(value[: len(value) - lost])
                shared = np.intersect1d(a, b)
                assert len(shared) / len(np.union1d(a, b)) >= 0.8 - 0.01
                count = np.where(np.isin(a, rng.choice(a, int(part * len(a)), replace=False)), times, 1)
                doc = np.repeat([0, 1], [len(a), len(b)])
                weight = 1.5 - 0.5 / np.concatenate([count, np.ones(len(b))])
                r = nd.registers(doc, np.concatenate([a, b]), weight, 2, nd.BANDS * nd.ROWS).reshape(2, nd.BANDS, nd.ROWS)
                found += bool((r[0] == r[1]).all(axis=1).any())
                pairs += 1
    print(f"{times} repeats: {found} of {pairs} pairs share a band")
    assert found >= 0.95 * pairs


def test_null_ids_cost_no_more(spark):
    """Near copies without ids meet their own text only: as many rows as with distinct ids."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:100], f"x{i}", *base[100:]]) for i in range(300)]
    by_id = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    same = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string")
    for df in (by_id, none, same):
        rows = nd.near_duplicates(df).collect()
        assert len(rows) == 300 and {r.class_texts for r in rows} == {300} and sum(r.kept for r in rows) == 1
