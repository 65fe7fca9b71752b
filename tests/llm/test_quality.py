import re
from collections import Counter
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from clausework.llm import quality
from clausework.llm.quality import DEFAULT, fit, fit_crf, judge, measure, op5_quality_rules, viterbi
from clausework.llm.words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#|🙂\x0b ", max_size=60), min_size=1, max_size=6))
def test_counts(texts):
    m = measure(words(pa.array(texts, pa.large_string())))
    got = list(zip(m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words))
    assert [tuple(map(int, g)) for g in got] == [plain(t)[:5] for t in texts]
    assert [b - a for a, b in zip(m.lines, m.lines[1:])] == [sum(bool(WORD.search(x)) for x in t.split("\n")) for t in texts]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(0, 6, 4)
        lines = np.concatenate([[0], np.cumsum(sizes)])
        scores, t = rng.normal(size=lines[-1]), rng.normal(size=(2, 2))
        got = viterbi(scores, lines, t)
        for a, b in zip(lines, lines[1:]):
            worth = lambda p: sum(s * y for s, y in zip(scores[a:b], p)) + sum(t[x][y] for x, y in zip(p, p[1:]))
            if b > a:
                assert abs(worth(got[a:b]) - max(map(worth, product((0, 1), repeat=b - a)))) < 1e-9


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = op5_quality_rules(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    good = [k for k, y in judged if y == 1]
    bad = [k for k, y in judged if y == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.2, sum(bad) / len(bad)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, True), (1, "", False), (1, "", False), (2, "word " * 60, True), (3, "\n".join(f"Line{i} of{i} a long{i} text{i}." for i in range(9000)), True)], "doc_id long, text string, kept boolean")
    got = judge(docs, DEFAULT).collect()
    assert [r.base_failed for r in got] == [True, True, True, True, False]
    assert docs.columns[:2] == judge(docs, DEFAULT).columns[:2]
    assert got[4].kept and len(got[4].content_lines) == 9000
    assert judge(docs.where("false"), DEFAULT).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit(docs, none) == DEFAULT
    assert fit_crf([([1], [1], 1.0)]) == DEFAULT


def test_fit_is_the_likeliest_and_transitions_count():
    """The gradient vanishes where the likelihood, summed over all labellings, is largest; labels that come in runs give transitions that stay."""
    rng = np.random.default_rng(7)
    chains = [([1 | 2 * int(x) for x in rng.integers(0, 2, 5)], rng.integers(0, 2, 5).tolist(), 1.0) for _ in range(12)]
    weights, t = fit_crf(chains, steps=3000, ridge=0.0)

    def likelihood(w, t):
        total, size = 0.0, [len(f) for f, _, _ in chains]
        ones = np.mean([sum(y) / len(y) for _, y, _ in chains])
        for f, y, _ in chains:
            score = lambda p: sum(k * sum(w[b] for b in range(len(w)) if x >> b & 1) for x, k in zip(f, p)) + sum(t[a][b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            every = np.logaddexp.reduce([score(p) for p in product((0, 1), repeat=len(f))])
            total += (score(y) - every) * (sum(y) / ones + (len(y) - sum(y)) / (1 - ones)) / len(y) ** 2
        return total

    best = likelihood(weights, t)
    for k in (0, 1):
        for d in (-0.05, 0.05):
            moved = list(weights)
            moved[k] += d
            assert likelihood(moved, t) < best + 1e-4
    runs = fit_crf([([1] * 12, [1] * 6 + [0] * 6, 1.0)] * 5)[1]
    assert runs[0][0] + runs[1][1] > runs[0][1] + runs[1][0] + 1


def test_transitions_decide(spark):
    """Lines and documents of the given table whose label or verdict differs when the fitted transitions are left out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    emission, t = fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert t[0][0] + t[1][1] > t[0][1] + t[1][0]
    with_t = {r.doc_id: r for r in judge(docs, (emission, t)).collect()}
    without = {r.doc_id: r for r in judge(docs, (emission, [[0, 0], [0, 0]])).collect()}
    lines = sum(a != b for k, r in with_t.items() for a, b in zip(r.content_lines, without[k].content_lines))
    verdicts = sum(r.kept != without[k].kept for k, r in with_t.items())
    print("lines", lines, "verdicts", verdicts, "kept", sum(r.kept for r in with_t.values()))
    assert lines >= 20


def test_one_label_each_and_very_long_texts(spark, monkeypatch):
    """The sample is bounded in chains whatever the length of the labelled texts."""
    monkeypatch.setattr(quality, "SAMPLE_CHAINS", 3)
    docs = spark.createDataFrame([(i, "\n".join(f"{'GET IT NOW!! $$' if i % 2 else 'Some plain words of a line.'} {k}" for k in range(3000))) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(4)], "doc_id long, quality int")
    weights = fit(docs, labels)
    assert weights != DEFAULT
    assert [r.content_share > 0.5 for r in judge(docs, weights).orderBy("doc_id").collect()] == [True, False, True, False]
