import numpy as np
import pytest

from clausework.operators import retrieval as R
from clausework.operators import vector_index as V
from clausework.plans import ret as P


def table(spark, v, keys=None):
    return spark.createDataFrame([(int(i), x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "id long, v array<float>, area string").repartition(5)


def neighbours(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query, set()).add(r.key)
    return out


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_and_work(spark, clusters):
    """Vectors without structure and in clusters: recall of at least 0.9 at less than a tenth of the comparisons; with a filter too."""
    rng = np.random.default_rng(clusters)
    v = rng.standard_normal((4000, 48))
    if clusters:
        v = rng.standard_normal((clusters, 48))[rng.integers(0, clusters, 4000)] + 0.4 * v
    e = table(spark, v)
    index = V.fit(e, "id", "v")
    rows = V.indexed(e, "id", "v", index, ["area"])
    assert rows.count() == 4000
    if clusters:
        assert index.probes <= len(index.centroids) / 4
    q = e.where("id % 50 = 0")
    for allowed in ([], ["area"]):
        spent = spark.sparkContext.accumulator(0)
        got, want = neighbours(V.search(q, rows, "id", "v", index, 10, allowed, spent)), neighbours(R.dense_top(q, e, "id", "v", 10, allowed))
        recall = np.mean([len(got[i] & want[i]) / len(want[i]) for i in want])
        print(f"{clusters} clusters, filter {allowed}: recall {recall:.3f}, share compared {spent.value / 80 / 4000:.4f}, probes {index.probes} of {len(index.centroids)}")
        assert set(got) == set(want) and recall >= 0.9 and spent.value < 80 * 4000 / 10


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.5, 0.5]), (None, [1.0, 0.0]), (7, [float("inf"), 0.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    index = V.fit(e, "id", "v")
    got = V.search(e, V.indexed(e, "id", "v", index), "id", "v", index, 5)
    assert {(r.query, r.key, r["rank"]) for r in got.collect()} == {(1, 1, 1), (1, 6, 2), (6, 6, 1), (6, 1, 2)}
    assert V.fit(e.where("id in (2, 3)"), "id", "v") is None
    assert V.search(e.where("false"), V.indexed(e, "id", "v", index), "id", "v", index, 5).count() == 0


def test_query(spark):
    """Recall on the given vectors, which have no structure."""
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got, want = neighbours(P.ret6_indexed(spark, sf)), neighbours(R.dense_top(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10))
    assert np.mean([len(got[i] & want[i]) / len(want[i]) for i in want]) >= 0.9
