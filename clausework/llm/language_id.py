"""Operator 10: language identification by compression.

Per language, one raw-content zstandard dictionary is cut from labelled documents; a text belongs to the language whose dictionary
compresses it to the fewest bytes. Texts and dictionaries are lower-cased and reduced to letters and single spaces, and a dictionary's
words stand in hash order: what it knows is the words of a language, not passages that its sample shares with other languages. Texts of every length are
compressed alike, in pieces, so that each part of a long one is measured against the dictionary rather than against its own beginning. Each
language keeps all that its own sample gives, up to the fixed room. As a smaller one knows fewer words by chance, its sizes are divided by what so small a dictionary costs on texts of other
languages (``handicaps``). The margin between the two best
languages, relative to the best, gives the score; below ``MARGIN`` the answer is rejected (``rejected``), while ``lang_pred`` still names the smaller one.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import least_rows
from clausework.llm.words import batches

#: The learning sample: at most so many documents a language, and at most so many of their words.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 24_000
#: Bytes of a language's dictionary, and of all dictionaries together: with over 700 languages each gets an equal part.
DICTIONARY_BYTES, ALL_BYTES = 96_000, 67_200_000
PIECE_BYTES, LEVEL, MARGIN = 4096, 6, 0.02
#: Lengths of the texts on which small dictionaries are calibrated; at most so many languages give the texts, and as many the dictionaries.
LENGTHS, JUDGES = (16, 64, 256, 1024, 4096), 3
#: Spaces before each piece: without anything that compresses, zstandard would store a short text as it is.
CARRIER = b" " * 64
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words of letters, one space between."""
    return _OTHER.sub(" ", text.lower())


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """The dictionary of each language of ``docs``, the most frequent language first.

    The sample is bounded: the ``SAMPLE_DOCS`` documents a language first in the order of xxhash64 of their id, whatever their length, and of all the words of
    their whole texts the ``SAMPLE_WORDS`` first in the order of a hash of word, place and document; only these reach the driver. Rows with a null language or
    id and texts without a letter are left out; repeated rows count once. A language whose sample gives fewer bytes than the dictionary
    holds keeps all of them, whatever the others have. An empty table gives no dictionary.
    """
    known = docs.select(F.col(lang).alias("lang"), F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("id").isNotNull())
    usable = known.where(F.rlike("text", F.lit(r"\p{L}"))).select("lang", F.xxhash64("id").alias("h"), "id", F.length("text").alias("chars"))
    chosen = least_rows(usable, "lang", ["h", "id", "chars"], SAMPLE_DOCS).select(F.col("lang").alias("_lang"), F.col("id").alias("_id"), F.col("chars").alias("_chars")).distinct()
    same = (F.col("lang") == F.col("_lang")) & (F.col("id") == F.col("_id")) & (F.length("text") == F.col("_chars"))
    sample = known.join(F.broadcast(chosen), same).select("lang", F.xxhash64("id").alias("h"), "text")

    def run(frames):
        for batch, column in batches(frames, "text"):
            rows = [(name, h, i, w) for name, h, t in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), column.to_pylist()) for i, w in enumerate(letters(t).split())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["lang", "h", "place", "word"])

    words = sample.mapInArrow(run, "lang string, h long, place long, word string")
    words = words.select("lang", F.xxhash64("word", "place", "h").alias("h"), "word").distinct()
    taken: dict[str, list[str]] = {}
    for r in sorted(least_rows(words, "lang", ["h", "word"], SAMPLE_WORDS).collect(), key=lambda r: (r.lang, r.h, r.word)):
        taken.setdefault(r.lang, []).append(r.word)
    often = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    room = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(taken)))
    order = sorted(taken, key=lambda name: (-often.get(name, 0), name))  # of equal sizes, the more frequent language
    return {name: " ".join(taken[name]).encode()[:room] for name in order}


def compressor(data: bytes):
    """The function that compresses bytes against the dictionary ``data``."""
    import zstandard

    made = zstandard.ZstdCompressionDict(data.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False).compress


def handicaps(models: dict[str, bytes]) -> dict[str, list[float]]:
    """Per language and length of ``LENGTHS``: how many times the bytes a sample of its size needs, on texts of a language that isn't the dictionary's, of those that the largest size needs.

    Measured on the ``JUDGES`` largest samples: each is cut to the size in question, and words of other samples are the texts. 1 where all samples are equally large.
    """
    largest = sorted(models, key=lambda name: -len(models[name]))[: JUDGES + 1]
    most = max(map(len, models.values()), default=0)
    judges = [m for m in largest if len(models[m]) == most or m == largest[0]][:JUDGES]
    known: dict[int, list[float]] = {most: [1.0] * len(LENGTHS)}

    def bytes_of(own: bytes, foreign: list[bytes]) -> list[int]:
        size = compressor(own)
        return [sum(len(size(CARRIER + t)) for t in _texts(foreign, n)) for n in LENGTHS]

    others = {m: [models[n] for n in largest if n != m] for m in judges}
    full = {m: bytes_of(models[m], others[m]) for m in judges} if any(len(d) < most for d in models.values()) else {}
    for size in {len(d) for d in models.values()} - {most}:
        small = [bytes_of(models[m][:size], others[m]) for m in judges]
        known[size] = [max(1.0, sum(x) / max(1, sum(y))) for x, y in zip(zip(*small), zip(*full.values()))]
    return {name: known[len(d)] for name, d in models.items()}


def _texts(samples: list[bytes], n: int, times: int = 8) -> list[bytes]:
    """Up to ``times`` pieces of n bytes of each sample (the whole of a smaller one)."""
    return [d[k * (len(d) - n) // times :][:n] for d in samples for k in range(times if len(d) > n else 1)]


def classify(docs: DataFrame, models: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected, letters`` appended (columns of these names are replaced).

    A null text or one without a letter gives ``und``, score 0, rejected; so does every text when nothing was learned. Ties go to
    the language that comes first in ``models`` (``learn`` puts the most frequent first), with score 0. Only the text is looked at.
    """
    added = ["lang_pred", "score", "rejected"]
    keep = [c for c in docs.columns if c not in added]
    names = [f"_{i}" for i in range(len(keep))]  # no clash with the columns added here
    source = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, names, strict=True)], F.col(text).alias("_text_to_classify"))
    held = docs.sparkSession.sparkContext.broadcast((models, handicaps(models)))

    def run(frames):
        known = list(held.value[0])
        tools = [compressor(held.value[0][name]) for name in known]
        costs = [held.value[1][name] for name in known]
        uneven = any(c != 1 for own in costs for c in own)

        def one(t: str) -> tuple[str, float, bool]:
            if not known or not any(map(str.isalpha, t[:200])) and not any(map(str.isalpha, t)):
                return "und", 0.0, True
            data = letters(t).encode()
            pieces = [CARRIER + data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
            sizes = [sum(len(size(p)) for p in pieces) for size in tools]
            if uneven:
                near = min(range(len(LENGTHS)), key=lambda k: abs(math.log(max(1, min(len(data), PIECE_BYTES)) / LENGTHS[k])))
                sizes = [size / own[near] for size, own in zip(sizes, costs)]
            order = sorted(range(len(known)), key=lambda i: (sizes[i], i))
            best = sizes[order[0]]
            gap = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
            return known[order[0]], 1 - math.exp(-gap / 0.05), gap < margin

        for batch, column in batches(frames, "_text_to_classify"):
            got = [one(t) for t in column.to_pylist()]
            new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], [*names, *added])

    fields = [source.schema[c] for c in names]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "lang_pred string, score double, rejected boolean"])
    return source.mapInArrow(run, schema).select(*[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], *added)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    models = learn(docs.where(fold != 2))
    asked = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("text").alias("_text"))
    asked = classify(asked.withColumnRenamed("_text", "text"), models)
    return asked.select("doc_id", "held_out", "lang_pred", F.round("score", 9).alias("score"), "rejected")
