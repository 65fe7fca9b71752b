"""Operator 5: quality rules by line sequence labelling.

Every line with a word gets a set of binary features. A linear-chain conditional random field over a text's lines (states: boilerplate 0, content 1) is
fitted here on a bounded sample of labelled documents; Viterbi decoding marks each line, and the share of words on content lines decides
whether the document is kept. Labels are given to documents, so line labels are derived first: weights without transitions are fitted on lines that
carry their document's label, and then lines of bad documents that these weights take for content, and lines of good ones that equal an earlier line,
change sides. What is left mixes both kinds within documents, and the field learns from it how they follow each other. Without labelled
documents ``DEFAULT`` weights are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import least_rows, only_columns
from clausework.llm.words import Words, batches, words

#: The fitting sample: at most so many labelled documents of each label, first by xxhash64 of their id, and of all chains of lines of their whole texts at most so many of each label, first by a hash of id and place.
SAMPLE_DOCS, SAMPLE_CHAINS = 600, 2000
#: Least share of words on content lines.
CONTENT_SHARE = 0.5
#: Lines of a chain at most; a document's lines are cut into such chains for fitting.
CHAIN = 64

FEATURES = (
    "always", "symbols > 0", "symbols > 5 %", "symbols > 20 %", "upper case > 30 %", "upper case > 60 %", "exclamation marks > 20 % of words",
    "bars > 20 % of words", "digits > 30 %", "under 3 words", "under 8 words", "words over 12 long", "no final punctuation", "equals an earlier line",
    "repeated 3-word windows > 50 %", "20 words or more", "60 words or more",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FINAL = np.zeros(256, bool)
_FINAL[[ord(c) for c in ".?!:;\"')"]] = True
#: emission of content against boilerplate per feature, then transitions [from][to]
DEFAULT = ([1.5, -0.2, -0.5, -2.0, -0.5, -1.5, -1.5, -1.5, -1.0, 0.0, 0.0, -0.2, -0.2, -1.5, -1.5, 0.5, 0.5], [[0.5, -0.5], [-0.5, 0.5]])


def cumulative(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def repeated(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (group, key) entries occur twice or more, and which have an earlier equal one."""
    order = np.lexsort((keys, groups))
    k, g = keys[order], groups[order]
    same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same  # lexsort is stable: equal entries stand in their own order
    return twice, later


@dataclass
class Measures:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: np.ndarray  # n+1 offsets of the texts in the table of lines with a word
    line_words: np.ndarray
    features: np.ndarray  # bit sets, int32


def measure(w: Words) -> Measures:
    """Counts of every text and features of every line with a word."""
    buf, n = w.buf, len(w.docs) - 1
    at = w.bounds
    doc_of = np.repeat(np.arange(n), np.diff(at))
    points = cumulative((buf & 0xC0) != 0x80)
    ink = points[w.end] - points[w.start]
    chars = np.bincount(doc_of, ink, n).astype(np.int64)
    symbols = cumulative(_SYMBOL[buf])

    hashes = w.hash(w.start, w.end)
    m = max(0, len(hashes) - 2)
    first = np.flatnonzero(doc_of[:m] == doc_of[2:]) if m else np.zeros(0, np.int64)
    window = (hashes[first] * np.uint64(3) + hashes[first + 1 if m else first]) * np.uint64(0x9E3779B97F4A7C15) + (hashes[first + 2] if m else hashes[first])
    twice = first[repeated(window, doc_of[first])[0]]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[twice + k] = True
    repeat = np.bincount(doc_of[covered], minlength=n)

    ends = np.flatnonzero(buf == 10)
    begin = np.concatenate([w.docs[:-1], ends + 1])  # a text's lines begin at the text and after each \n
    stop = np.concatenate([ends, w.docs[1:]])
    begin.sort()
    stop.sort()
    of = np.concatenate([np.arange(n), np.searchsorted(w.docs, ends, side="right") - 1])
    of.sort()
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    some = b > a
    begin, stop, of, a, b = begin[some], stop[some], of[some], a[some], b[some]
    _, later = repeated(w.hash(begin, stop), of)

    words_in, size = b - a, np.maximum(1, points[w.end[b - 1]] - points[w.start[a]]) if len(a) else np.zeros(0, np.int64)
    count = lambda table: (c := cumulative(table[buf]))[stop] - c[begin]
    letters = np.maximum(1, count(_LETTER))
    bang, bar = np.zeros(256, bool), np.zeros(256, bool)
    bang[33], bar[124] = True, True
    inked = cumulative(ink)
    share = symbols[stop] - symbols[begin]
    again = cumulative(covered)
    tests = [
        np.ones(len(of), bool), share > 0, share > 0.05 * size, share > 0.2 * size, count(_UPPER) > 0.3 * letters, count(_UPPER) > 0.6 * letters, count(bang) > 0.2 * words_in,
        count(bar) > 0.2 * words_in, count(_DIGIT) > 0.3 * size, words_in < 3, words_in < 8, inked[b] - inked[a] > 12 * words_in, ~_FINAL[buf[w.end[b - 1] - 1]] if len(b) else np.zeros(0, bool), later,
        again[b] - again[a] > 0.5 * words_in, words_in >= 20, words_in >= 60,
    ]
    features = np.zeros(len(of), np.int32)
    for k, t in enumerate(tests):
        features |= t.astype(np.int32) << k
    return Measures(
        np.diff(at), chars, symbols[w.docs[1:]] - symbols[w.docs[:-1]], np.bincount(of[later], minlength=n), repeat,
        np.searchsorted(of, np.arange(n + 1)), words_in, features,
    )


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of content against boilerplate per line."""
    bits = (features[:, None] >> np.arange(len(weights))) & 1
    return bits @ weights


def viterbi(scores: np.ndarray, lines: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best labels of all lines; every text is a chain of its own. Works on all texts of a chunk at once, line by line."""
    n = len(lines) - 1
    length = np.diff(lines)
    order = np.argsort(-length, kind="stable")
    first, length = lines[:-1][order], length[order]
    label = np.zeros(len(scores), np.int8)
    back = np.zeros((len(scores), 2), np.int8)
    longest = int(length[0]) if n else 0
    live = np.searchsorted(-length, -np.arange(longest), side="left")  # texts with more than t lines
    best = np.zeros((n, 2))
    for t in range(longest):
        at = first[: live[t]] + t
        if t == 0:
            now = np.zeros((live[0], 2))
        else:
            paths = best[: live[t], :, None] + transitions[None]
            came = paths.argmax(1)
            back[at] = came
            now = np.take_along_axis(paths, came[:, None, :], 1)[:, 0]
        now[:, 1] += scores[at]
        best[: live[t]] = now
    state = np.where(best[:, 1] >= best[:, 0], 1, 0).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        label[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return label


def line_labels(chains: list[tuple[list[int], int, float]]) -> list[list[int]]:
    """Labels of the lines of ``chains`` (features, label of the document, weight): the document's, but for lines that look like the other kind."""
    weights = np.array(fit_crf([(f, [y] * len(f), s) for f, y, s in chains], transitions=False)[0])
    later = 1 << FEATURES.index("equals an earlier line")
    out = []
    for f, y, _ in chains:
        x = np.array(f)
        out.append(np.where(x & later, 0, 1).tolist() if y else (emissions(x, weights) > 0).astype(int).tolist())
    return out


def fit_crf(chains: list[tuple[list[int], list[int], float]], transitions: bool = True, steps: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> tuple[list[float], list[list[float]]]:
    """Maximum-likelihood weights of the field by gradient ascent; ``chains``: (features of the lines, their labels, weight).

    Lines of the two labels weigh the same in sum. With one label only, ``DEFAULT``.
    """
    if len({y for _, labels, _ in chains for y in labels}) < 2:
        return DEFAULT
    size = max(len(f) for f, _, _ in chains)
    x = np.zeros((len(chains), size, len(FEATURES)))
    mask, truth = np.zeros((len(chains), size), bool), np.zeros((len(chains), size))
    for i, (f, y, _) in enumerate(chains):
        x[i, : len(f)] = (np.array(f)[:, None] >> np.arange(len(FEATURES))) & 1
        mask[i, : len(f)] = True
        truth[i, : len(f)] = y
    share = np.array([s for *_, s in chains])
    ones = (truth.sum(1) / mask.sum(1) * share).sum() / share.sum()
    per = share / mask.sum(1)
    per = per * (truth.sum(1) / ones + (mask.sum(1) - truth.sum(1)) / max(1e-9, 1 - ones)) / mask.sum(1)
    per = per / per.sum() * len(chains)
    pairs = mask[:, 1:] & mask[:, :-1]
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    seen = np.array([[(((truth[:, :-1] == i) & (truth[:, 1:] == j) & pairs).sum(1) * per).sum() for j in (0, 1)] for i in (0, 1)])
    scale = (mask.sum(1) * per).sum()
    for _ in range(steps):
        score = x @ w
        alpha, beta = np.zeros((len(chains), size, 2)), np.zeros((len(chains), size, 2))
        alpha[:, 0, 1] = score[:, 0]
        for i in range(1, size):
            a = np.logaddexp(alpha[:, i - 1, 0, None] + t[0], alpha[:, i - 1, 1, None] + t[1])
            a[:, 1] += score[:, i]
            alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
        for i in range(size - 2, -1, -1):
            right = beta[:, i + 1] + np.stack([np.zeros(len(chains)), score[:, i + 1]], 1)
            b = np.logaddexp(t[:, 0] + right[:, 0, None], t[:, 1] + right[:, 1, None])
            beta[:, i] = np.where(mask[:, i + 1, None], b, beta[:, i + 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        content = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]) * mask
        w += rate * (np.einsum("il,ilf->f", (truth * mask - content) * per[:, None], x) / scale * 4 - ridge * w)
        if transitions:
            joint = np.zeros((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    p = alpha[:, :-1, i] + t[i, j] + j * score[:, 1:] + beta[:, 1:, j] - total[:, None]
                    joint[i, j] = ((np.exp(np.minimum(p, 0)) * pairs).sum(1) * per).sum()
            t += rate * ((seen - joint) / scale - ridge * t)
    return w.tolist(), t.tolist()


def line_features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    source = docs.select(*keep, F.col(text).alias("_text_to_judge"))

    def run(frames):
        for batch, column in batches(frames, "_text_to_judge"):
            m = measure(words(column))
            lists = pa.ListArray.from_arrays(pa.array(m.lines, pa.int32()), pa.array(m.features))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "features"])

    schema = ", ".join([*[f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep], "features array<int>"])
    return source.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> tuple[list[float], list[list[float]]]:
    """Weights from a bounded sample of labelled documents (``SAMPLE_DOCS``, ``SAMPLE_CHAINS``); only features of its chains of lines reach the driver.

    Labels other than 0 and 1 and null ids are left out; of several labels of one id the larger counts; repeated documents are each a document. Without a
    labelled document of either kind the weights are ``DEFAULT``.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    chosen = least_rows(known.withColumn("_h", F.xxhash64("_id")), "_y", ["_h", "_id"], SAMPLE_DOCS).select("_id", "_y")
    sample = docs.select(F.col(id_col).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_id", "_y", "_text")
    lines = line_features(sample, "_text", ["_id", "_y"]).where(F.size("features") > 0)
    starts = F.sequence(F.lit(0), F.expr(f"(size(features) - 1) div {CHAIN}"))
    chains = lines.select("_id", "_y", "features", F.posexplode(starts).alias("place", "n")).withColumn("chains", F.expr(f"(size(features) - 1) div {CHAIN} + 1"))
    chains = chains.select("_y", F.xxhash64("_id", "place").alias("h"), F.slice("features", F.col("place") * CHAIN + 1, CHAIN).alias("features"), (1 / F.col("chains")).alias("share"))
    rows = sorted(least_rows(chains, "_y", ["h", "features", "share"], SAMPLE_CHAINS).collect(), key=lambda r: (r._y, r.h, r.features, r.share))
    if len({r._y for r in rows}) < 2:
        return DEFAULT
    labelled = line_labels([(r.features, r._y, r.share) for r in rows])
    return fit_crf([(r.features, y, r.share) for r, y in zip(rows, labelled, strict=True)])


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, content_lines array<boolean>, base_failed boolean, kept boolean"


def judge(docs: DataFrame, weights, text: str = "text", keep: list[str] | None = None, least_share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the measures, the label of every line with a word (``content_lines``) and the verdict appended.

    Columns of these names are replaced. A null text counts as empty: no words, so it fails the base rule. Ids play no part;
    repeated rows get equal verdicts; an empty table gives no rows.
    """
    added = [c.split()[0] for c in COLUMNS.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    keep = only_columns(kept)
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, keep, strict=True)], F.col(text).alias("_text_to_judge"))
    emission, transitions = np.array(weights[0]), np.array(weights[1])

    def run(frames):
        for batch, column in batches(frames, "_text_to_judge"):
            m = measure(words(column))
            label = viterbi(emissions(m.features, emission), m.lines, transitions)
            good = cumulative(m.line_words * label)
            share = (good[m.lines[1:]] - good[m.lines[:-1]]) / np.maximum(1, m.n_words)
            failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
            lists = pa.ListArray.from_arrays(pa.array(m.lines, pa.int32()), pa.array(label == 1))
            new = [*map(pa.array, (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, share)), lists, pa.array(failed), pa.array(~failed & (share >= least_share))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], [*keep, *added])

    schema = ", ".join([*[f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep], COLUMNS])
    return source.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(kept, keep, strict=True)], *added)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, weights, keep=["doc_id"]).drop("content_lines")
