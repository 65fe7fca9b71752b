import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from clausework.llm.util import materialise
from tests.llm.test_near_dedup import brute_force
from tests.llm.test_quality import plain as quality_counts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialise(f(spark, out[-1], SF), "test"))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality rules", "exact dedup"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d.doc_id in kept for d in stages[0].collect() if not quality_counts(d.text)[5] and labels.get(d.doc_id) == 1]
    assert sum(good) / len(good) > 0.98
    assert all(not quality_counts(d.text)[5] for d in stages[1].collect())


def test_exact(stages):
    groups = defaultdict(list)
    for r in stages[1].collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(min(g)[1] for g in groups.values())


def test_near(stages):
    rows = sorted(stages[2].select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(rows[i].doc_id for i in set(brute_force([r.text for r in rows])))


def test_mix(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    total = Counter()
    for r in before:
        total[r.source] += size[r.doc_id]
    names = sorted(total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    rest = 1.5 * sum(total.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            rest -= target[s]
        free -= full
    taken = Counter()
    for r in after:
        taken[r.source] += size[r.doc_id]
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in names)


def test_encoding(stages):
    from tokenizers import Tokenizer

    from clausework.llm.bpe import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    want = Counter()
    for r in stages[4].collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages[5].collect()) == want


def test_run(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5].collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_and_columns(spark):
    """Nulls in any column, repeated rows, a very long text, and extra columns named like the stages' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    text = " ".join(f"word{i}" for i in range(60_000))
    rows = [(None, text, None, None, None), (None, text, None, None, None), (5, None, "en", "src0", 1), (5, "", None, "src0", 0), (6, text[:900], "en", None, 9)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for c in ("kept", "digest", "size", "taken", "ids", "n_words", "position", "target", "_id", "_kept", "_n", "_digest", "_digest_of_row", "_source", "_size", "_position", "_url", "_c0", "a.b"):
        docs = docs.select("*", docs.text.alias(c))
    columns = docs.columns
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(f(spark, docs, SF), "odd")
        if k < 4:
            assert docs.columns == columns
            assert docs.where("not (kept <=> text) or not (size <=> text)").count() == 0
    assert docs.count() > 0
