"""Operator 3: secret scans by a randomness test battery.

Three plain patterns give the base spans. Further candidates are long runs of token characters. Each candidate's encoding is inferred
from its characters (hexadecimal, base 32, base 64), and its digits in that encoding go through a battery: the Wald-Wolfowitz runs test and the lag-one serial
correlation test must not reject a random sequence, and the chi-squared statistic of alphabet uniformity must be lower than structured text of that length
would give. The last one yields a p-value under the null hypothesis "structured", whose statistic has a noncentral chi-squared law with a noncentrality in
proportion to the length. False discoveries are controlled per encoding and length class over the whole corpus by Benjamini and
Hochberg's rule, computed from a histogram of p-values, so no candidate list is gathered anywhere.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.util import materialise
from clausework.llm.words import batches

#: Fixed patterns: kind, expression, group whose length counts, least length.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
_COMPILED = {"assign": re.compile(BASE[0][1]), "access": re.compile(BASE[1][1]), "hex": re.compile(r"[0-9a-f]{16,}")}  # a run of 16 is a match of the pattern with its length
_KEYWORD = re.compile(r"[:=]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
#: Encodings: name, alphabet, squared distance of structured text from uniformity per character (noncentrality).
ENCODINGS = {
    "hex": ("0123456789abcdef", 0.9),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.2),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.4),
}
#: Level of the runs and serial tests, false-discovery rate, histogram bins per power of ten of p, and the lowest bin.
ALPHA, RATE, BINS, LOWEST = 0.01, 0.05, 10, 120


def encoding_of(token: str) -> tuple[str, np.ndarray] | None:
    """Inferred encoding of a token and its digits; None if it has only one kind of character, as words and numbers do."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    kinds = any(map(str.isdigit, body)) + any(map(str.islower, body)) + any(map(str.isupper, body))
    if kinds < 2:
        return None
    low = body.lower()
    if set(low) <= set(ENCODINGS["hex"][0]) and (body == low or body == body.upper()):
        name, body = "hex", low
    elif set(body) <= set(ENCODINGS["base32"][0]):
        name = "base32"
    else:
        name = "base64"
    alphabet = ENCODINGS[name][0]
    return name, np.array([alphabet.index(c) for c in body])


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(name: str, x: np.ndarray) -> tuple[float, float, float]:
    """p-values: uniformity under "structured", runs and serial correlation under "random" (two-sided)."""
    n, k = len(x), len(ENCODINGS[name][0])
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    df, away = k - 1, n * ENCODINGS[name][1]
    # noncentral chi-squared law by Sankaran's normal approximation
    h = 1 - 2 * (df + away) * (df + 3 * away) / (3 * (df + 2 * away) ** 2)
    p = (df + 2 * away) / (df + away) ** 2
    m = (h - 1) * (1 - 3 * h)
    z = ((chi / (df + away)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p))
    structured = _normal_tail(-z)
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        return structured, 0.0, 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    runs_p = 2 * _normal_tail(abs(runs - mean) / spread)
    y = x - x.mean()
    r = float((y[1:] * y[:-1]).sum() / max(1e-9, (y * y).sum()))
    serial_p = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    return structured, runs_p, serial_p


def scan_text(t: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str, int]]]:
    """Base spans (kind, start, end), and candidates that pass the runs and serial tests (start, end, stratum, bin of p)."""
    base = []
    if _KEYWORD.search(t):
        base += [("assign", m.start(), m.end()) for m in _COMPILED["assign"].finditer(t) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in t:
        base += [("access", m.start(), m.end()) for m in _COMPILED["access"].finditer(t) if m.end() - m.start() >= 18]
    base += [("hex", m.start(), m.end()) for m in _COMPILED["hex"].finditer(t)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    more = []
    for m in _CANDIDATE.finditer(t):
        if (found := encoding_of(m[0])) is None:
            continue
        p, runs, serial = battery(*found)
        if min(runs, serial) >= ALPHA:
            n = len(found[1])
            stratum = f"{found[0]}:{min(8, int(math.log2(n / 20) * 2))}"  # half octaves of length
            more.append((m.start(), m.end(), stratum, min(LOWEST, int(-math.log10(max(p, 1e-300)) * BINS))))
    return base, more


def thresholds(found: DataFrame, rate: float = RATE) -> DataFrame:
    """``stratum, least``: the least bin whose candidates are discoveries by Benjamini and Hochberg's rule.

    A bin stands for its highest p-value, so the rule errs to the safe side. One row per stratum and bin: at most
    27 strata of ``LOWEST`` + 1 bins, whatever the corpus.
    """
    bins = found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select("stratum", "bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    return ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= rate * F.col("rank") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rate: float = RATE) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base`` and ``spans`` appended: arrays of struct(kind, start, end), by start, then kind.

    Offsets count code points, ends are exclusive. ``spans`` holds the base spans and the random ones that no base span contains. A null
    text has no spans; ids play no part, repeated rows each count as a row in the false-discovery rate; an empty table gives no rows. Columns
    named ``base`` or ``spans`` are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    names = [f"_{i}" for i in range(len(keep))]  # no clash with the columns added here
    source = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], F.col(text).alias("_text_to_scan"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    candidate = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("bin", pa.int32())])

    def run(frames):
        for batch, column in batches(frames, "_text_to_scan"):
            got = [scan_text(t) for t in column.to_pylist()]
            base = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in b] for b, _ in got], pa.list_(span))
            more = pa.array([[dict(zip(("start", "end", "stratum", "bin"), s)) for s in m] for _, m in got], pa.list_(candidate))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], base, more], [*names, "base", "candidates"])

    schema = ", ".join([*[f"{c} {source.schema[c].dataType.simpleString()}" for c in names], "base array<struct<kind:string,start:int,end:int>>", "candidates array<struct<start:int,end:int,stratum:string,bin:int>>"])
    found = materialise(source.mapInArrow(run, schema), "secrets")
    least = thresholds(found, rate).collect()  # at most 27 rows
    bound = F.create_map(*[F.lit(x) for r in least for x in (r.stratum, r.least)]) if least else F.create_map().cast("map<string,int>")
    outside = lambda c: ~F.exists("base", lambda b: (b.start <= c.start) & (b.end >= c.end))
    taken = F.filter("candidates", lambda c: outside(c) & (c.bin >= F.coalesce(F.try_element_at(bound, c.stratum), F.lit(LOWEST + 1))))
    random = F.transform(taken, lambda c: F.struct(F.lit("random").alias("kind"), c.start.alias("start"), c.end.alias("end")))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s.kind)
    order = lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise((rank(a) - rank(b)).cast("int"))
    spans = F.array_sort(F.concat("base", random), order)
    return found.select(*[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], "base", spans.alias("spans"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def base_digest(text: str | None) -> str:
    """SHA-256 of the base spans of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in scan_text(text or "")[0]).encode()).hexdigest()
