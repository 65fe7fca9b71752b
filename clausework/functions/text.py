"""Column functions over text: normalisers, terms, numbers, cues. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.lexicon import CONTEXT_ENDINGS, STOP_WORDS, SUFFIXES

INK = r"[^\x20\x09-\x0D]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _one_of(values) -> str:
    return "(" + "|".join(sorted(values, key=lambda v: (-len(v), v))) + ")"


def stemmed_terms(text: Column | str) -> Column:
    """Words without stop words; of words over five characters one suffix is stripped."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))
    return F.transform(kept, lambda w: F.when(F.length(w) > 5, F.regexp_replace(w, _one_of(SUFFIXES) + "$", "")).otherwise(w))


def context_terms(text: Column | str) -> Column:
    """Ordered distinct stems of at least two characters: the longest ending goes first and leaves three characters or more."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1))
    stem = lambda w: F.regexp_replace(w, "^(.{3,}?)" + _one_of(CONTEXT_ENDINGS) + "$", "$1")
    return F.array_distinct(F.transform(kept, stem))


def prefix_terms(text: Column | str, width: int = 7, least: int = 3) -> Column:
    """Words of ``least`` characters or more without stop words, cut to ``width``."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= least))
    return F.transform(kept, lambda w: F.substring(w, 1, width))


def collapsed(text: Column | str) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col(text), r"[\x20\x09-\x0D]+", " "))


def normalised(text: Column | str) -> Column:
    """Soft hyphens out, no-break spaces to spaces, ё to е, punctuation to spaces, collapsed, lower case."""
    clean = F.translate(F.lower(col(text)), " ё­", " е")
    return F.trim(F.regexp_replace(clean, r"[^\p{L}\p{N}]+", " "))


def decimal_value(text: Column | str, kind: str = "decimal(18,6)") -> Column:
    """Number with spaces or no-break spaces between thousands and a comma or point before decimals; null if it is none, never 0."""
    plain = F.translate(F.regexp_replace(col(text), "[  ]", ""), ",", ".")
    return F.when(plain.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), plain.try_cast(kind))


def natural_key(locator: Column | str) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(col(locator), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def content_id(*parts: Column, size: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def first_case(cases: list[tuple[str, str]], text: Column | str, otherwise: str | None = None) -> Column:
    """Label of the first pattern that the text matches: [(label, pattern)]."""
    out = None
    for label, pattern in cases:
        hit = col(text).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(otherwise))
