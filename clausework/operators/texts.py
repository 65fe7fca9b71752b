"""Text operators that give rows: literals, units, cues, candidates within documents."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clausework.functions import lexicon
from clausework.functions.text import first_case, words

LITERAL = r"(<=|>=|≤|≥|not more than |not less than |at most |at least )?([0-9]+(?:[.,][0-9]+)?)\s?(ms|min|MB|GB|days|%|s|h)?\b"


@F.pandas_udf(T.StringType())  # a type object: this module is also imported by workers, which have no session
def nfkc_fold(s: pd.Series) -> pd.Series:
    """Unicode compatibility form, case-folded: not expressible in the JVM functions."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def numeric_literals(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key, n, operator, value, unit``: numbers with an optional operator before and unit behind; bare single digits are dropped."""
    got = [F.regexp_extract_all(F.col(text), F.lit(LITERAL), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(got, ("operator", "value", "unit"), strict=True)])
    flat = rows.select(*key, F.posexplode(zipped).alias("n", "x")).select(*key, "n", F.trim("x.operator").alias("operator"), "x.value", "x.unit")
    return flat.where(~((F.col("operator") == "") & (F.col("unit") == "") & (F.length("value") == 1)))


def canonical_units(literals: DataFrame, units: DataFrame) -> DataFrame:
    """Adds ``op``, ``base`` and ``amount`` (decimal(38,18)): canonical operator, base unit, value in it. ``units``: unit, base, factor; a small table, joined as it is."""
    pairs = [F.lit(x) for k, v in lexicon.OPERATORS.items() for x in (k, v)]
    op = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("operator")), F.lit("="))
    value = F.replace("value", F.lit(","), F.lit(".")).try_cast("decimal(20,9)")
    return literals.join(units, "unit").withColumn("op", op).withColumn("amount", (value * F.col("factor").cast("decimal(12,6)")).cast("decimal(38,18)"))


def small_cardinals(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key, pos, word, value``: number words zero to ten that don't stand next to another number word, digits, ``hundred``, ``thousand`` or ``half``."""
    near = [*lexicon.SMALL_NUMBERS, "hundred", "thousand", "half"]
    items = rows.select(*key, F.posexplode(words(text)).alias("pos", "word"))
    w = Window.partitionBy(*key).orderBy("pos")
    other = lambda c: F.coalesce(c.isin(*near) | c.rlike("^[0-9]+$"), F.lit(False))
    items = items.withColumn("_bad", other(F.lag("word").over(w)) | other(F.lead("word").over(w)))
    value = F.array_position(F.array(*map(F.lit, lexicon.SMALL_NUMBERS)), F.col("word")) - 1
    return items.where(F.col("word").isin(*lexicon.SMALL_NUMBERS) & ~F.col("_bad")).select(*key, "pos", "word", value.alias("value"))


def modality(text: Column | str) -> Column:
    """Prohibited before recommended before permitted before mandatory; null without a cue."""
    return first_case(lexicon.MODALITIES, F.lower(F.col(text) if isinstance(text, str) else text))


def definitions(blocks: DataFrame, key: list[str], text: str) -> DataFrame:
    """``TERM — definition`` lines: a term of 2 to 25 characters, a definition of 8 or more."""
    p = r"^([^—|:]{2,25}?) (?:—|\||:) (.{8,})$"
    return blocks.where(F.col(text).rlike(p)).select(*key, F.regexp_extract(text, p, 1).alias("term"), F.regexp_extract(text, p, 2).alias("definition"))


def query_plan(queries: DataFrame, key: str, text: str, most: int = 24) -> DataFrame:
    """``key, clause, designations, terms``: leading clause number, designations in the first 300 characters, distinct topic terms."""
    clause = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)*)", 1)
    names = F.array_distinct(F.regexp_extract_all(F.substring(text, 1, 300), F.lit(r"\b[A-Z][a-z]+ [a-z]+"), F.lit(0)))
    kept = F.filter(words(text), lambda w: ~w.isin(*lexicon.STOP_WORDS) & (F.length(w) > 2))
    return queries.select(key, clause.alias("clause"), names.alias("designations"), F.slice(F.array_distinct(kept), 1, most).alias("terms"))


def typo_candidates(blocks: DataFrame, doc: str, text: str, known_count: int = 3) -> DataFrame:
    """``doc, word, suggestion``: a word that is rare in its document with exactly one frequent neighbour there: same first three letters, length within one, one edit.

    Words meet within (document, first three letters), never across a document. Texts are shuffled once, by document; of its sorted words only frequent ones, and rare ones that begin like
    one of them, become rows.
    """
    every = blocks.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.array_join(F.collect_list(text), "\n").alias("text"))
    own = every.select("doc", F.sort_array(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}])\p{Ll}{4,}(?![\p{L}\p{N}])"), F.lit(0))).alias("w"))
    differs = lambda x, i: ~x.eqNullSafe(F.get("w", i))
    known = own.withColumn("known", F.filter("w", lambda x, i: (x == F.get("w", i + (known_count - 1))) & differs(x, i - 1)))
    begun = known.withColumn("begins", F.array_distinct(F.transform("known", lambda x: F.substring(x, 1, 3))))
    rare = F.when(F.size("begins") > 0, F.filter("w", lambda x, i: differs(x, i - 1) & differs(x, i + 1) & F.array_contains("begins", F.substring(x, 1, 3))))
    tagged = lambda words, frequent: F.transform(words, lambda x: F.struct(F.substring(x, 1, 3).alias("block"), x.alias("word"), F.lit(frequent).alias("frequent")))
    rows = begun.select("doc", F.inline_outer(F.concat(tagged("known", True), tagged(rare, False))))  # not inline: Spark would infer a filter that cuts the words again for each of them
    met = rows.withColumn("known", F.collect_list(F.when(F.col("frequent"), F.col("word"))).over(Window.partitionBy("doc", "block"))).where("not frequent")
    near = F.filter("known", lambda x: (F.abs(F.length("word") - F.length(x)) <= 1) & (F.levenshtein("word", x, 1) == 1))
    return met.select("doc", "word", near.alias("near")).where(F.size("near") == 1).select("doc", "word", F.col("near")[0].alias("suggestion"))


def look_alike_names(rows: DataFrame, key: list[str], name: str, siblings: list[str]) -> DataFrame:
    """Names that mix Cyrillic look-alikes and whose Latin fold equals a name of the same ``siblings`` group."""
    fold = F.translate(F.col(name), "АВЕКМНОРСТХаеорсух", "ABEKMHOPCTXaeopcyx")
    mixed = F.col(name).rlike("[А-Яа-я]") & F.col(name).rlike("[A-Za-z]") | (F.col(name) != fold)
    latin = rows.where(F.col(name) == fold).select(*[F.col(s).alias(f"_{s}") for s in siblings], F.col(name).alias("_name")).distinct()
    same = F.col("folded") == F.col("_name")
    for s in siblings:
        same = same & (F.col(s) == F.col(f"_{s}"))
    return rows.where(mixed).withColumn("folded", fold).join(latin, same, "left_semi").select(*key, name, "folded")


def text_flags(blocks: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key, open_brackets, doubled``: opening less closing brackets and the first doubled word."""
    n = lambda c: F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))
    return blocks.select(*key, (n("(") - n(")")).alias("open_brackets"), F.nullif(F.regexp_extract(text, r"(?iu)(?<![\p{L}\p{N}])(\p{L}{2,}) \1(?![\p{L}\p{N}])", 1), F.lit("")).alias("doubled"))
