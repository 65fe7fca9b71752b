"""Queries over text scalars (TXT) and user functions (UDF)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from clausework.functions import lexicon
from clausework.functions import text as T
from clausework.operators import texts as X
from clausework.plans.registry import query
from clausework.plans.src import BLOCKS_SQL, blocks
from clausework.sources.tables import table

STOPS = "[" + ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS) + "]"
LONG = lambda v: "|".join(sorted(v, key=lambda x: (-len(x), x)))


@query(
    "txt1_stemmed_terms",
    f"""SELECT doc_id, sha256(array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOPS}, w)),
  lambda w: CASE WHEN length(w) > 5 THEN regexp_replace(w, '({LONG(lexicon.SUFFIXES)})$', '') ELSE w END), ' ')) AS terms FROM documents""",
)
def txt1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(T.stemmed_terms("text"), " "), 256).alias("terms"))


@query(
    "txt2_context_terms",
    f"""SELECT doc_id, len(t) AS n, sha256(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'),
  lambda w: NOT list_contains({STOPS}, w) AND length(w) > 1), lambda w: regexp_replace(w, '^(.{{3,}}?)({LONG(lexicon.CONTEXT_ENDINGS)})$', '\\1'))) AS t FROM documents)""",
)
def txt2(spark, sf):
    terms = table(spark, sf, "documents").select("doc_id", T.context_terms("text").alias("t"))
    return terms.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("terms"))


@query(
    "txt3_prefix_terms",
    f"""SELECT doc_id, sha256(array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOPS}, w) AND length(w) >= 3), lambda w: left(w, 7)), ' ')) AS terms FROM documents""",
)
def txt3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(T.prefix_terms("text"), " "), 256).alias("terms"))


@query(
    "txt4_normalisers",
    f"""WITH {BLOCKS_SQL} SELECT doc_id, ord, sha256(trim(regexp_replace(translate(lower(text), chr(160) || 'ё' || chr(173), ' е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS normal,
  length(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS collapsed, sha256(replace(lower(nfc_normalize(text)), 'ß', 'ss')) AS folded FROM blocks""",
)
def txt4(spark, sf):
    return blocks(spark, sf).select("doc_id", "ord", F.sha2(T.normalised("text"), 256).alias("normal"), F.length(T.collapsed("text")).alias("collapsed"), F.sha2(X.nfkc_fold("text"), 256).alias("folded"))


LITERAL_SQL = r"(<=|>=|≤|≥|not more than |not less than |at most |at least )?([0-9]+(?:[.,][0-9]+)?)\s?(ms|min|MB|GB|days|%|s|h)?\b"
#: Sentences with numbers and units, derived from the lines of all orders.
LINES_SQL = """lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'Row ' || l_linenumber || ' takes ' || ['not more than ', '>= ', 'at least ', ''][(l_partkey % 4 + 1)::INT] || CAST(l_quantity::BIGINT AS VARCHAR)
  || ' ' || ['ms', 's', 'GB', 'days', 'h'][(l_suppkey % 5 + 1)::INT] || ' of 7.' AS text FROM lineitem)"""


def lines(spark, sf):
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    text = F.concat(F.lit("Row "), F.col("l_linenumber").cast("string"), F.lit(" takes "), pick(("not more than ", ">= ", "at least ", ""), "l_partkey"), F.col("l_quantity").cast("long").cast("string"), F.lit(" "), pick(("ms", "s", "GB", "days", "h"), "l_suppkey"), F.lit(" of 7."))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.alias("text"))


@query(
    "txt5_numeric_literals",
    f"""WITH {BLOCKS_SQL}, x AS (SELECT doc_id, ord, regexp_extract_all(text, '{LITERAL_SQL}', 1) AS o, regexp_extract_all(text, '{LITERAL_SQL}', 2) AS v, regexp_extract_all(text, '{LITERAL_SQL}', 3) AS u FROM blocks),
y AS (SELECT doc_id, ord, unnest(o) AS o, unnest(v) AS value, unnest(u) AS unit, generate_subscripts(v, 1) - 1 AS n FROM x)
SELECT doc_id, ord, n, trim(coalesce(o, '')) AS operator, value, coalesce(unit, '') AS unit FROM y WHERE NOT (trim(coalesce(o, '')) = '' AND coalesce(unit, '') = '' AND length(value) = 1)""",
)
def txt5(spark, sf):
    return X.numeric_literals(blocks(spark, sf), ["doc_id", "ord"], "text")


@query(
    "txt6_canonical_units",
    f"""WITH {LINES_SQL}, u(unit, base, factor) AS (VALUES ('ms', 's', 0.001), ('s', 's', 1.0), ('min', 's', 60.0), ('h', 'h', 1.0), ('days', 'h', 24.0), ('MB', 'GB', 0.001), ('GB', 'GB', 1.0)),
x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(regexp_extract_all(text, '{LITERAL_SQL}', 1)) AS o, unnest(regexp_extract_all(text, '{LITERAL_SQL}', 2)) AS v, unnest(regexp_extract_all(text, '{LITERAL_SQL}', 3)) AS unit FROM lines)
SELECT base, CASE WHEN o LIKE 'not more%' OR o LIKE 'at most%' OR trim(o) IN ('<=', '≤') THEN '<=' WHEN o LIKE 'not less%' OR o LIKE 'at least%' OR trim(o) IN ('>=', '≥') THEN '>=' ELSE '=' END AS op,
  count(*) AS n, CAST(sum(v::DECIMAL(18,3) * factor::DECIMAL(9,3)) AS DOUBLE) AS amount FROM x JOIN u USING (unit) GROUP BY ALL""",
)
def txt6(spark, sf):
    units = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, lexicon.UNITS)) + " AS u(unit, base, factor)")
    found = X.canonical_units(X.numeric_literals(lines(spark, sf), ["l_orderkey", "l_partkey"], "text"), F.broadcast(units))
    return found.groupBy("base", "op").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query(
    "txt7_small_cardinals",
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, string_split('set ' || ['one', 'two', 'ten', 'nine'][(l_partkey % 4 + 1)::INT] || ' ' || ['rings', 'thousand', 'half', 'two'][(l_suppkey % 4 + 1)::INT], ' ') AS w FROM lineitem),
x AS (SELECT *, row_number() OVER () AS id FROM l), t AS (SELECT id, l_orderkey, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM x),
v AS (SELECT *, lag(word) OVER k AS b, lead(word) OVER k AS a FROM t WINDOW k AS (PARTITION BY id ORDER BY pos))
SELECT l_orderkey, pos - 1 AS pos, word, list_position(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], word) - 1 AS value FROM v
WHERE word IN ('zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten') AND NOT coalesce(b IN ('one', 'two', 'ten', 'nine', 'half', 'thousand'), false) AND NOT coalesce(a IN ('one', 'two', 'ten', 'nine', 'half', 'thousand'), false)""",
)
def txt7(spark, sf):
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.monotonically_increasing_id().alias("id"), F.concat_ws(" ", F.lit("set"), pick(("one", "two", "ten", "nine"), "l_partkey"), pick(("rings", "thousand", "half", "two"), "l_suppkey")).alias("text"))
    return X.small_cardinals(rows, ["l_orderkey", "id"], "text").drop("id")


@query(
    "txt8_decimal_parsing",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_extendedprice::DECIMAL(18,2) AS DOUBLE) END AS value FROM lineitem""",
)
def txt8(spark, sf):
    whole = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    shown = F.when(F.col("l_suppkey") % 9 == 0, F.concat(F.lit("n/a "), whole)).otherwise(F.translate(whole, ",.", " ,"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.decimal_value(shown).cast("double").alias("value"))


@query(
    "txt9_modality",
    """WITH s AS (SELECT o_orderkey, 'The part ' || ['must not', 'should', 'may', 'shall', 'does'][(o_orderkey % 5 + 1)::INT] || ' move' || CASE WHEN o_custkey % 3 = 0 THEN '; it must stay' ELSE '' END AS text FROM orders)
SELECT o_orderkey, CASE WHEN text LIKE '%must not%' THEN 'prohibited' WHEN text LIKE '%should%' THEN 'recommended' WHEN text LIKE '%may%' THEN 'permitted' WHEN text LIKE '%must%' OR text LIKE '%shall%' THEN 'mandatory' END AS modality FROM s""",
)
def txt9(spark, sf):
    verb = F.element_at(F.array(*map(F.lit, ("must not", "should", "may", "shall", "does"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit("The part "), verb, F.lit(" move"), F.when(F.col("o_custkey") % 3 == 0, "; it must stay").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", X.modality(text).alias("modality"))


@query(
    "txt10_definitions",
    f"""WITH {BLOCKS_SQL} SELECT doc_id, ord, regexp_extract(text, '^([^—|:]{{2,25}}?) (?:—|\\||:) (.{{8,}})$', 1) AS term, length(regexp_extract(text, '^([^—|:]{{2,25}}?) (?:—|\\||:) (.{{8,}})$', 2)) AS n
FROM blocks WHERE regexp_matches(text, '^([^—|:]{{2,25}}?) (?:—|\\||:) (.{{8,}})$')""",
)
def txt10(spark, sf):
    return X.definitions(blocks(spark, sf), ["doc_id", "ord"], "text").select("doc_id", "ord", "term", F.length("definition").alias("n"))


@query(
    "txt11_query_plan",
    f"""SELECT item_id, regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)', 1) AS clause, array_to_string(list_sort(list_distinct(regexp_extract_all(left(text, 300), '\\b[A-Z][a-z]+ [a-z]+'))), '|') AS designations,
  least(24, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOPS}, w) AND length(w) > 2)))) AS terms FROM benchmark""",
)
def txt11(spark, sf):
    plan = X.query_plan(table(spark, sf, "benchmark"), "item_id", "text")
    return plan.select("item_id", "clause", F.array_join(F.array_sort("designations"), "|").alias("designations"), F.size("terms").alias("terms"))


@query(
    "txt12_natural_order",
    f"""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS r, l_quantity::INT AS c FROM lineitem)
SELECT l_orderkey, 't' || r || '/c' || c AS locator, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY r, c) AS place FROM l""",
)
def txt12(spark, sf):
    from pyspark.sql.window import Window

    rows = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("t"), F.col("l_linenumber").cast("string"), F.lit("/c"), F.col("l_quantity").cast("int").cast("string")).alias("locator"))
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(T.natural_key("locator"))))


@query(
    "txt13_redact_and_flatten",
    """SELECT event_id, 'k' AS path, CASE WHEN event_type = 'error' THEN '***' ELSE json_extract_string(props, '$.k') END AS value FROM events
UNION ALL SELECT event_id, 'user.token', '***' FROM events UNION ALL SELECT event_id, 'user.id', user_id::VARCHAR FROM events""",
)
def txt13(spark, sf):
    """Leaf paths of a nested record as JSON, values under secret-looking keys masked."""
    from clausework.operators.json_paths import flatten_json, redacted

    secret = F.when(F.col("event_type") == "error", F.lit("secret_k")).otherwise(F.lit("k"))
    user = F.to_json(F.struct(F.col("user_id").alias("id"), F.sha2(F.col("user_id").cast("string"), 256).alias("token")))
    body = F.concat(F.lit('{"'), secret, F.lit('": '), F.get_json_object("props", "$.k"), F.lit(', "user": '), user, F.lit("}"))
    flat = flatten_json(table(spark, sf, "events").select("event_id", body.alias("body")), ["event_id"], "body")
    return redacted(flat, "path", "value").select("event_id", F.replace("path", F.lit("secret_k"), F.lit("k")).alias("path"), "value")


@query(
    "txt14_look_alikes",
    """WITH n AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_partkey % 50 = 0 THEN translate(p_name, 'aeopc', 'аеорс') ELSE p_name END AS shown FROM part)
SELECT p_partkey, shown, p_name AS folded FROM n WHERE shown <> p_name AND EXISTS (SELECT 1 FROM n m WHERE m.p_brand = n.p_brand AND m.shown = n.p_name)""",
)
def txt14(spark, sf):
    shown = F.when(F.col("p_partkey") % 50 == 0, F.translate("p_name", "aeopc", "аеорс")).otherwise(F.col("p_name"))
    return X.look_alike_names(table(spark, sf, "part").select("p_partkey", "p_brand", shown.alias("shown")), ["p_partkey"], "shown", ["p_brand"])


@query(
    "txt15_text_flags",
    f"""WITH {BLOCKS_SQL}, t AS (SELECT doc_id, ord, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS w FROM blocks),
d AS (SELECT *, list_filter(range(1, len(w) - 1), lambda i: w[i + 1] = ' ' AND lower(w[i]) = lower(w[i + 2]) AND regexp_matches(w[i], '^\\p{{L}}{{2,}}$')) AS hits FROM t)
SELECT doc_id, ord, (length(text) - length(replace(text, '(', ''))) - (length(text) - length(replace(text, ')', ''))) AS open_brackets, w[hits[1]] AS doubled FROM d""",
)
def txt15(spark, sf):
    return X.text_flags(blocks(spark, sf), ["doc_id", "ord"], "text")


@query(
    "txt16_typo_candidates",
    """WITH w AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word FROM documents),
c AS (SELECT doc, word, count(*) AS n FROM w WHERE regexp_matches(word, '^\\p{Ll}{4,}$') GROUP BY ALL)
SELECT r.doc, r.word, min(k.word) AS suggestion FROM c r JOIN c k ON r.doc = k.doc AND left(r.word, 3) = left(k.word, 3) AND abs(length(r.word) - length(k.word)) <= 1
WHERE r.n = 1 AND k.n >= 3 AND len(list_filter(range(1, greatest(length(r.word), length(k.word)) + 2), lambda i:
   (length(r.word) = length(k.word) AND left(r.word, i - 1) = left(k.word, i - 1) AND substr(r.word, i + 1) = substr(k.word, i + 1) AND r.word <> k.word)
   OR (length(r.word) = length(k.word) + 1 AND left(r.word, i - 1) || substr(r.word, i + 1) = k.word)
   OR (length(k.word) = length(r.word) + 1 AND left(k.word, i - 1) || substr(k.word, i + 1) = r.word))) > 0
GROUP BY r.doc, r.word HAVING count(*) = 1""",
)
def txt16(spark, sf):
    return X.typo_candidates(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "txt17_grounded_parameter",
    f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, regexp_matches(text, '(^|[^0-9.,])' || (l_partkey % 50) || '($|[^0-9.,]|[.,]($|[^0-9]))') AS grounded FROM lines""",
)
def txt17(spark, sf):
    from clausework.operators.extract import grounded

    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", grounded((F.col("l_partkey") % 50).cast("string"), F.col("text")).alias("grounded"))


@query(
    "txt18_category_facet",
    """SELECT event_type, CASE WHEN contains(event_type, 'err') THEN 'logic' WHEN contains(event_type, 'click') OR contains(event_type, 'view') THEN 'formatting' WHEN contains(event_type, 'purchase') THEN 'arithmetic' ELSE 'other' END AS facet, count(*) AS n FROM events GROUP BY ALL""",
)
def txt18(spark, sf):
    facet = T.first_case([("logic", "err"), ("formatting", "click|view"), ("arithmetic", "purchase")], "event_type", "other")
    return table(spark, sf, "events").groupBy("event_type", facet.alias("facet")).agg(F.count("*").alias("n"))


@query(
    "udf1_encoder",
    """SELECT vec_id, true AS same_size, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm FROM embeddings""",
)
def udf1(spark, sf):
    from clausework.functions.encoder import checked_encoder

    encode = checked_encoder(lambda vectors: (x := np.array([*vectors], float)) / np.linalg.norm(x, axis=1, keepdims=True), size=64)
    v = table(spark, sf, "embeddings").select("vec_id", encode("embedding").alias("v"))
    return v.select("vec_id", (F.size("v") == 64).alias("same_size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def hashing_encoder(size: int = 64):
    """Default text encoder for tests: words hashed into ``size`` slots, normalised."""

    def encode(texts):
        out = []
        for t in texts:
            v = [0.0] * size
            for w in (t or "").split():
                v[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % size] += 1
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return encode


@query(
    "udf1_text_encoder",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS word FROM documents), s AS (SELECT doc_id, ('0x' || left(md5(word), 2))::INT % 64 AS slot, count(*) AS c FROM w GROUP BY ALL),
m AS (SELECT doc_id, sqrt(sum(c * c)) AS norm, arg_min(slot, (-c, slot)) AS slot, max(c) AS c FROM s GROUP BY doc_id)
SELECT doc_id, 64 AS n, coalesce(slot, 0)::BIGINT AS slot, coalesce(round(c / norm, 6), 0) AS share FROM documents LEFT JOIN m USING (doc_id)""",
)
def udf1_text(spark, sf):
    """A text encoder plugged in: the dimension of each vector, its first largest slot and that slot's value."""
    from clausework.functions.encoder import checked_encoder

    v = table(spark, sf, "documents").select("doc_id", checked_encoder(hashing_encoder(), size=64)("text").alias("v"))
    return v.select("doc_id", F.size("v").alias("n"), (F.array_position("v", F.array_max("v")) - 1).alias("slot"), F.round(F.array_max("v"), 6).alias("share"))


__all__ = ["lines"]
