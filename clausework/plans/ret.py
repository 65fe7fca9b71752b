"""Queries over retrieval and ranking (RET)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.functions.text import normalised, stemmed_terms, words
from clausework.operators import retrieval as R
from clausework.operators import vector_index as V
from clausework.operators.rules import compile_rule
from clausework.plans.app import FACTS_SQL, facts, plain_fact
from clausework.plans.registry import query
from clausework.plans.src import BLOCKS_SQL, blocks
from clausework.plans.txt import LONG, STOPS
from clausework.functions import lexicon
from clausework.sources.tables import table

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def bm25_sql(docs: str, queries: str, most: int = 100) -> str:
    """CTEs of BM25: ``docs`` and ``queries`` give (key, t: list of terms)."""
    return f"""d AS ({docs}), q0 AS ({queries}),
q AS (SELECT key AS query, term, least(2, list_count(list_filter(t, lambda x: x = term))) AS qtf FROM (SELECT key, t, unnest(list_distinct(t)) AS term FROM q0)),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT key AS doc, any_value(len) AS len, term, count(*) AS tf FROM (SELECT key, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY key, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query, doc, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc)"""


DOCS, BENCH = f"SELECT doc_id AS key, {WORDS_SQL} AS t FROM documents", f"SELECT item_id AS key, {WORDS_SQL} AS t FROM benchmark"


def docs(spark, sf):
    return table(spark, sf, "documents").withColumn("terms", words("text"))


def asked(spark, sf):
    return table(spark, sf, "benchmark").withColumn("terms", words("text"))


@query("ret1_bm25", f"WITH {bm25_sql(DOCS, BENCH)} SELECT query, doc, rank, round(score, 6) AS score FROM rk WHERE rank <= 8")
def ret1(spark, sf):
    got = R.bm25_top(asked(spark, sf), docs(spark, sf), "item_id", "doc_id", 8)
    return got.select("query", "doc", "rank", F.round("score", 6).alias("score"))


@query(
    "ret2_tf_idf",
    f"""WITH d AS ({DOCS}), q AS (SELECT DISTINCT key AS query, unnest(t) AS term FROM ({BENCH})), n AS (SELECT count(*) AS n FROM d),
tf AS (SELECT key AS doc, any_value(len) AS len, term, count(*) AS tf FROM (SELECT key, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY key, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT query, doc, sum(ln(1 + n / (1 + df)) * tf / (1 + len / 60)) AS score FROM tf JOIN q USING (term) JOIN df USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM s) SELECT query, doc, rank, round(score, 6) AS score FROM r WHERE rank <= 8""",
)
def ret2(spark, sf):
    got = R.tf_idf_top(asked(spark, sf), docs(spark, sf), "item_id", "doc_id", 8)
    return got.select("query", "doc", "rank", F.round("score", 6).alias("score"))


@query(
    "ret3_neighbours",
    f"""WITH {BLOCKS_SQL}, h AS (SELECT doc_id, ord FROM blocks WHERE contains(text, '!!')) SELECT b.doc_id, b.ord, bool_or(h.ord = b.ord) AS anchor
FROM blocks b JOIN h ON b.doc_id = h.doc_id AND abs(b.ord - h.ord) <= 2 AND b.ord // 8 = h.ord // 8 GROUP BY ALL""",
)
def ret3(spark, sf):
    b = blocks(spark, sf).select("doc_id", "ord", "text")
    return R.neighbours(b.where("contains(text, '!!')"), b, "doc_id", "ord", 2, F.floor(F.col("ord") / 8))


@query("ret4_exact_alias", "WITH a AS (SELECT p_name, p_brand, min(p_partkey) AS query FROM part GROUP BY ALL) SELECT query, p_partkey AS part FROM a JOIN part USING (p_name, p_brand)")
def ret4(spark, sf):
    """Every name in use is asked once, as its first part writes it; all parts of that brand and normalised name answer."""
    p = table(spark, sf, "part")
    written_ = p.select(F.col("p_partkey").alias("query"), "p_brand", normalised(F.concat(F.lit(" "), F.upper("p_name"), F.lit(", "))).alias("alias"))
    return written_.groupBy("alias", "p_brand").agg(F.min("query").alias("query")).join(p.select(F.col("p_partkey").alias("part"), "p_brand", normalised("p_name").alias("alias")), ["alias", "p_brand"]).select("query", "part")


BOTH = "list_concat(list_transform(w, lambda x: 'r:' || x), list_transform(list_filter(w, lambda x: NOT list_contains({s}, x)), lambda x: 'n:' || CASE WHEN length(x) > 5 THEN regexp_replace(x, '({f})$', '') ELSE x END))".format(s=STOPS, f=LONG(lexicon.SUFFIXES))


@query(
    "ret5_lexical_or",
    "WITH "
    + bm25_sql(
        f"SELECT doc_id AS key, {BOTH} AS t FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)",
        f"SELECT item_id AS key, {BOTH} AS t FROM (SELECT item_id, list_sort(list_distinct(list_filter({WORDS_SQL}, lambda x: length(x) > 1)))[1:16] AS w FROM benchmark)",
    )
    + " SELECT query, doc, rank FROM rk WHERE rank <= 32",
)
def ret5(spark, sf):
    """Raw and normalised fields as one list of tagged terms; at most 16 terms of a query, four times the limit of eight."""
    both = lambda raw, stems: F.concat(F.transform(raw, lambda x: F.concat(F.lit("r:"), x)), F.transform(stems, lambda x: F.concat(F.lit("n:"), x)))
    d = table(spark, sf, "documents").select("doc_id", both(words("text"), stemmed_terms("text")).alias("terms"))
    first = F.slice(F.array_sort(F.array_distinct(F.filter(words("text"), lambda x: F.length(x) > 1))), 1, 16)
    q = table(spark, sf, "benchmark").select("item_id", F.array_join(first, " ").alias("text")).select("item_id", both(words("text"), stemmed_terms("text")).alias("terms"))
    return R.bm25_top(q, d, "item_id", "doc_id", 32).select("query", "doc", "rank")


@query(
    "ret6_dense_top",
    """WITH s AS (SELECT q.vec_id AS query, c.vec_id AS key, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, key) AS rank FROM s) SELECT query, key, rank, round(score, 5) AS score FROM r WHERE rank <= 10""",
)
def ret6(spark, sf):
    e = table(spark, sf, "embeddings")
    got = R.dense_top(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, ["label"])
    return got.select("query", "key", "rank", F.round("score", 5).alias("score"))


@query("ret6_indexed_top")
def ret6_indexed(spark, sf):
    """The nearest of all vectors by an index fitted on a bounded sample; tests hold its recall against ``ret6_dense_top``'s exact way."""
    e = table(spark, sf, "embeddings")
    index = V.fit(e, "vec_id", "embedding")
    if index is None:
        return R.dense_top(e, e, "vec_id", "embedding", 10).select("query", "key", "rank", "score")
    got = V.search(e.where("vec_id % 100 = 0"), V.indexed(e, "vec_id", "embedding", index), "vec_id", "embedding", index, 10)
    return got.select("query", "key", "rank", F.round("score", 5).alias("score"))


@query(
    "ret7_rank_fusion",
    f"""WITH {bm25_sql(DOCS, BENCH)}, ds AS (SELECT q.vec_id AS query, c.vec_id AS doc, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM ds),
u AS (SELECT query, doc, rank FROM rk WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM dr WHERE rank <= 20),
f AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY ALL),
x AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
j AS (SELECT coalesce(f.query, x.query) AS query, coalesce(f.doc, x.doc) AS doc, coalesce(score, 0) AS score, x.doc IS NOT NULL AS exact FROM f FULL JOIN x ON f.query = x.query AND f.doc = x.doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, round(score, 6) DESC, doc) AS rank FROM j) SELECT query, doc, exact, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def ret7(spark, sf):
    from clausework.operators.extract import find_quotes

    lexical = R.bm25_top(asked(spark, sf), docs(spark, sf), "item_id", "doc_id", 20)
    e = table(spark, sf, "embeddings")
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    dense = R.dense_top(e.join(ids, "vec_id", "left_semi"), e, "vec_id", "embedding", 20).withColumnRenamed("key", "doc")
    exact = find_quotes(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")), table(spark, sf, "documents"), "item_id", "doc_id").select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"))
    fused = R.fuse([lexical, dense], exact)
    w = Window.partitionBy("query").orderBy(F.col("exact").desc(), F.round("score", 6).desc(), "doc")
    return fused.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query", "doc", "exact", "rank", F.round("score", 6).alias("score"))


@query(
    "ret8_filter_before_limit",
    f"WITH {bm25_sql(DOCS + ' WHERE lang = ' + chr(39) + 'en' + chr(39) + ' AND source IN (SELECT ' + chr(39) + 'src' + chr(39) + ' || n_nationkey FROM nation WHERE n_regionkey = 1)', BENCH)} SELECT query, doc, rank FROM rk WHERE rank <= 8",
)
def ret8(spark, sf):
    eligible = table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    d = docs(spark, sf).where("lang = 'en'").join(eligible, "source", "left_semi")
    return R.bm25_top(asked(spark, sf), d, "item_id", "doc_id", 8).select("query", "doc", "rank")


W = r"'[\p{L}\p{N}]+'"
#: Pages as records: title, the menu's links as heading path, body; the page's language as its template. Some bodies begin with a clause number or as a note.
PAGES_SQL = f"""pg AS (SELECT *, regexp_extract_all(lower(body), {W}) AS bt, regexp_extract_all(lower(title), {W}) AS tt, regexp_extract_all(lower(heading), {W}) AS ht FROM (
  SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '4.' || (page_id % 9) || ' ' WHEN page_id % 11 = 0 THEN 'Note ' ELSE '' END || array_to_string(regexp_extract_all(html, '<p>([^<]*)', 1), ' ') AS body, regexp_extract(html, '<h1>([^<]*)', 1) AS title,
  array_to_string(regexp_extract_all(html, '<a href[^>]*>([^<]*)', 1), ' ') AS heading, CASE WHEN page_id % 13 <> 0 THEN regexp_extract(html, 'lang="([a-z]*)"', 1) END AS template, page_id % 4 = 0 AS card, regexp_extract(url, '://[^/]*/[^/]*/([0-9]+)', 1) AS number FROM pages))"""


def pages(spark, sf):
    prefix = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("4."), (F.col("page_id") % 9).cast("string"), F.lit(" "))).when(F.col("page_id") % 11 == 0, "Note ").otherwise("")
    every = lambda p: F.array_join(F.regexp_extract_all("html", F.lit(p), F.lit(1)), " ")
    template = F.when(F.col("page_id") % 13 != 0, F.regexp_extract("html", 'lang="([a-z]*)"', 1))
    p = table(spark, sf, "pages").select("page_id", F.concat(prefix, every("<p>([^<]*)")).alias("body"), F.regexp_extract("html", "<h1>([^<]*)", 1).alias("title"), every("<a href[^>]*>([^<]*)").alias("heading"), template.alias("template"), (F.col("page_id") % 4 == 0).alias("card"), F.regexp_extract("url", "://[^/]*/[^/]*/([0-9]+)", 1).alias("number"))
    return p.select("*", *[words(c).alias(f"{c}_terms") for c in ("body", "title", "heading")])


TAGGED = "list_concat(list_concat(list_transform({b}, lambda x: 'b:' || x), list_transform({t}, lambda x: 't:' || x)), list_transform({h}, lambda x: 'h:' || x))"


@query(
    "ret9_context_relevance",
    rf"""WITH {PAGES_SQL}, {bm25_sql("SELECT page_id AS key, " + TAGGED.format(b="bt", t="tt", h="ht") + " AS t FROM pg",
        "SELECT item_id AS key, " + TAGGED.format(b="w", t="w", h="w") + f" AS t FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark)", 1000).replace("sum(qtf *", "sum(CASE left(term, 2) WHEN 't:' THEN 1.6 WHEN 'h:' THEN 1.3 ELSE 1.0 END * qtf *")},
lx AS (SELECT query, doc, rank - 1 AS place FROM rk WHERE rank <= 80), n AS (SELECT query, count(*) AS n FROM lx GROUP BY query),
ex AS (SELECT * FROM (SELECT item_id AS query, page_id AS doc, row_number() OVER (PARTITION BY item_id ORDER BY page_id) - 1 AS place FROM benchmark JOIN pg ON number = item_id::VARCHAR) WHERE place < 30),
eb AS (SELECT ex.query, doc, coalesce(n, 0) + place AS place FROM ex LEFT JOIN n USING (query)),
bo AS (SELECT coalesce(lx.query, eb.query) AS query, coalesce(lx.doc, eb.doc) AS doc, coalesce(eb.place, lx.place) AS lexical, eb.place IS NOT NULL AS exact FROM lx FULL JOIN eb ON lx.query = eb.query AND lx.doc = eb.doc),
ds AS (SELECT q.vec_id AS query, c.vec_id AS doc, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND c.vec_id IN (SELECT page_id FROM pages)),
dn AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) - 1 AS dense FROM ds) WHERE dense < 48),
c AS (SELECT coalesce(bo.query, dn.query) AS query, coalesce(bo.doc, dn.doc) AS doc, lexical, dense, coalesce(exact, false) AS exact FROM bo FULL JOIN dn ON bo.query = dn.query AND bo.doc = dn.doc),
b AS (SELECT item_id, list_distinct({WORDS_SQL}) AS w, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS wanted FROM benchmark),
s AS (SELECT query, doc, exact, 4 * len(list_intersect(w, bt)) / greatest(len(w), 1) + 1.3 * len(list_intersect(w, tt)) / greatest(len(w), 1) + 0.6 * len(list_intersect(w, ht)) / greatest(len(w), 1)
  + CASE WHEN wanted IS NULL THEN 0 WHEN template = wanted THEN 2.5 WHEN template IS NOT NULL THEN -0.9 ELSE -0.15 END + CASE WHEN card THEN 0.15 ELSE 0 END - CASE WHEN length(body) < 100 AND regexp_matches(body, '^\s*[0-9]+[0-9.]*\s') THEN 1.4 ELSE 0 END
  - CASE WHEN starts_with(body, 'Note') AND len(list_intersect(w, bt)) < 2 THEN 1 ELSE 0 END - CASE WHEN length(trim(body)) < 8 THEN 1 ELSE 0 END + coalesce(1 / (lexical + 1), 0) + coalesce(0.45 / (dense + 1), 0) AS score FROM c JOIN b ON query = item_id JOIN pg ON doc = page_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, round(score, 6) DESC, doc) AS rank FROM s) SELECT query, doc, exact, rank, round(score, 6) AS score FROM r WHERE rank <= 6""",
)
def ret9(spark, sf):
    p, e = pages(spark, sf), table(spark, sf, "embeddings")
    q = asked(spark, sf).select("item_id", F.array_distinct("terms").alias("terms"), F.col("terms").alias("_w"), F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "de").alias("wanted"))
    tag = lambda c, t: F.transform(c, lambda x: F.concat(F.lit(t), x))
    tagged = lambda body, title, heading: F.concat(tag(body, "b:"), tag(title, "t:"), tag(heading, "h:"))
    lexical = R.bm25_top(q.select("item_id", tagged("_w", "_w", "_w").alias("terms")), p.select("page_id", tagged("body_terms", "title_terms", "heading_terms").alias("terms")), "item_id", "page_id", 80, most=1000, term_weight=lambda t: {"b": 1.0, "t": 1.6, "h": 1.3}[t[0]])
    place = F.row_number().over(Window.partitionBy("query").orderBy("doc")) - 1
    exact = q.join(p, F.col("number") == F.col("item_id").cast("string")).select(F.col("item_id").alias("query"), F.col("page_id").alias("doc")).withColumn("place", place).where("place < 30")
    dense = R.dense_top(e.join(q.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), e.join(p.select(F.col("page_id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "embedding", 48)
    c = R.context_candidates(lexical.select("query", "doc", (F.col("rank") - 1).alias("place")), exact, dense.select("query", F.col("key").alias("doc"), (F.col("rank") - 1).alias("place")))
    j = c.join(q.select(F.col("item_id").alias("query"), "terms", "wanted"), "query").join(p.withColumnRenamed("page_id", "doc"), "doc")
    scored = j.select("query", "doc", "exact", R.context_relevance(j, r"^\s*[0-9]+[0-9.]*\s", "Note").alias("score"))
    w = Window.partitionBy("query").orderBy(F.col("exact").desc(), F.round("score", 6).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("query", "doc", "exact", "rank", F.round("score", 6).alias("score"))


#: Lines of text from order lines: lead-ins, list items, conditions and plain sentences; four orders make a document, each order a heading.
LINES_SQL = """ln AS (SELECT l_orderkey // 4 AS doc, l_orderkey AS heading, row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord,
  CASE WHEN l_linenumber = 1 THEN 'Order ' || l_orderkey || ' holds these parts:' WHEN l_returnflag <> 'R' THEN '- part ' || l_partkey WHEN l_linenumber % 2 = 0 THEN 'If part ' || l_partkey || ' is late' ELSE 'Part ' || l_partkey || ' by supplier ' || l_suppkey END AS text FROM lineitem)"""


def lines(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("doc", F.expr("l_orderkey div 4"))
    part = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" holds these parts:"))).when(F.col("l_returnflag") != "R", F.concat(F.lit("- part "), part))
    text = text.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("If part "), part, F.lit(" is late"))).otherwise(F.concat(F.lit("Part "), part, F.lit(" by supplier "), F.col("l_suppkey").cast("string")))
    order = F.row_number().over(Window.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return l.select("doc", F.col("l_orderkey").alias("heading"), order.alias("ord"), text.alias("text")).withColumn("terms", words("text"))


LIST, CUE = r"^\s*(?:[-–—]|[a-z]\)|[0-9]+[.)])\s", "^(?:If |Note)"


@query(
    "ret10_context_bundle",
    rf"""WITH {LINES_SQL}, t AS (SELECT *, regexp_matches(text, '{LIST}') AS item, regexp_matches(text, '{CUE}') AS cue, regexp_matches(text, ':\s*$') AS colon FROM ln),
a AS (SELECT h.doc, h.ord AS hit, h.ord + d.d AS ord, h.heading AS hh, h.item OR h.colon AS walks, t.text, t.heading, coalesce(t.item, false) AS item, coalesce(t.cue, false) AS cue, coalesce(t.colon, false) AS colon
  FROM t h CROSS JOIN (SELECT unnest(range(-13, 19)) AS d) d LEFT JOIN t ON t.doc = h.doc AND t.ord = h.ord + d.d),
s1 AS (SELECT *, coalesce(min(CASE WHEN ord < hit AND NOT (item AND NOT colon) THEN hit - ord END) OVER w, 14) AS stop FROM a WINDOW w AS (PARTITION BY doc, hit)),
s2 AS (SELECT *, coalesce(max(CASE WHEN ord = hit - stop AND colon THEN ord END) OVER w, hit - stop + 1) AS lead_ FROM s1 WINDOW w AS (PARTITION BY doc, hit)),
s3 AS (SELECT *, min(CASE WHEN ord > lead_ AND NOT (item OR cue) THEN ord END) OVER w AS brk FROM s2 WINDOW w AS (PARTITION BY doc, hit)),
s4 AS (SELECT *, coalesce(text IS NOT NULL AND ord <> hit AND ((walks AND ord >= lead_ AND ord < least(coalesce(brk, lead_ + 18), lead_ + 18)) OR (abs(ord - hit) <= 2 AND heading = hh AND (list_has_any(['late', 'supplier'], regexp_extract_all(lower(text), {W})) OR cue))), false) AS inn,
  walks AND coalesce(brk, lead_ + 19) > lead_ + 18 AS cut FROM s3),
s5 AS (SELECT *, count(*) FILTER (inn) OVER w AS k, coalesce(sum(length(text)) FILTER (inn) OVER w, 0) AS run FROM s4 WINDOW w AS (PARTITION BY doc, hit ORDER BY ord ROWS UNBOUNDED PRECEDING)),
s6 AS (SELECT *, inn AND k <= 16 AND run <= 10000 AS kept FROM s5),
g AS (SELECT doc, hit, count(*) FILTER (kept) AS items, coalesce(sum(length(text)) FILTER (kept), 0)::BIGINT AS chars, count(*) FILTER (inn) > count(*) FILTER (kept) AS truncated, bool_or(cut) AS cut, coalesce(string_agg(ord::VARCHAR, ',' ORDER BY ord) FILTER (kept), '') AS lines FROM s6 GROUP BY doc, hit)
SELECT doc, hit, items, chars, truncated, NOT cut AND NOT truncated AS complete, lines FROM g""",
)
def ret10(spark, sf):
    l = lines(spark, sf)
    hits = l.select("doc", F.col("ord").alias("hit"), F.array(F.lit("late"), F.lit("supplier")).alias("roots"))
    return R.context_bundle(hits, l, "doc", "ord", LIST, CUE)


@query(
    "ret10_row_context",
    """WITH c AS (SELECT l_orderkey, l_linenumber AS "row", c AS "column" FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), (SELECT unnest(range(1, 5)) AS c))
SELECT h.l_orderkey, h."row", h."column", least(24, count(p.l_orderkey)) AS peers, count(p.l_orderkey) <= 24 AS complete FROM c h LEFT JOIN c p ON p.l_orderkey = h.l_orderkey AND (p."row" = h."row" OR p."row" = 1 AND p."column" = h."column") AND NOT (p."row" = h."row" AND p."column" = h."column")
GROUP BY ALL""",
)
def ret10_rows(spark, sf):
    cells = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row")).distinct().withColumn("column", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return R.row_context(cells, cells, "l_orderkey")


@query(
    "ret11_interleave",
    """WITH r AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents), g AS (SELECT *, sum(n) OVER (ORDER BY turn, source ROWS UNBOUNDED PRECEDING) AS running FROM r)
SELECT doc_id, source, turn, running::BIGINT AS running FROM g WHERE running <= 200000""",
)
def ret11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return R.interleave(d, "source", "doc_id", "n", 200_000).select("doc_id", "source", "turn", "running")


#: Conditions and counter-conditions of an experience, by its number.
CONDITIONS = [{"fact": "segment", "in": ["BUILDING", "MACHINERY"]}, {"any_of": [{"fact": "nation", "in": [1, 2, 3, 5, 8, 13]}, {"fact": "balance", "in": ["debt"]}]}, {"not": {"fact": "balance", "in": ["debt"]}}]
COUNTERS = [{"fact": "nation", "in": [3, 4]}, {"all_of": [{"fact": "balance", "in": ["debt"]}, {"fact": "segment", "in": ["HOUSEHOLD"]}]}]


@query(
    "ret12_experience_selection",
    f"""WITH RECURSIVE {FACTS_SQL}, e AS (SELECT o.*, CASE o_orderkey % 3 WHEN 0 THEN seg IN ('BUILDING', 'MACHINERY') WHEN 1 THEN nat IN (1, 2, 3, 5, 8, 13) OR bal = 'debt' ELSE NOT (bal = 'debt') END AS cond,
  CASE o_orderkey % 2 WHEN 0 THEN nat IN (3, 4) ELSE bal = 'debt' AND seg = 'HOUSEHOLD' END AS counter FROM orders o JOIN f ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'),
o AS (SELECT o_custkey, o_orderkey, o_orderkey % 50 + 10 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY -round_even(o_totalprice, 0), o_orderkey) AS seq FROM e WHERE cond AND NOT counter),
w AS (SELECT o_custkey, o_orderkey, seq, CASE WHEN n <= 80 THEN n ELSE 0 END AS used, CASE WHEN n <= 80 THEN 1 ELSE 0 END AS cnt, n <= 80 AS taken FROM o WHERE seq = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.seq, CASE WHEN used + n <= 80 AND cnt < 3 THEN used + n ELSE used END, CASE WHEN used + n <= 80 AND cnt < 3 THEN cnt + 1 ELSE cnt END, used + n <= 80 AND cnt < 3 FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.seq = w.seq + 1)
SELECT o_custkey, o_orderkey FROM w WHERE taken""",
)
def ret12(spark, sf):
    """Approved experience of the wanted stage whose condition holds and whose counter-condition is known not to hold; then by score within the budget."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'").join(facts(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda rules: reduce(lambda c, i: c.when(F.col("o_orderkey") % len(rules) == i, compile_rule(rules[i], plain_fact)), range(len(rules)), F.when(F.lit(False), F.lit(None).cast("boolean")))
    o = o.where(pick(CONDITIONS) & ~pick(COUNTERS)).withColumn("rank", -F.bround("o_totalprice", 0)).withColumn("tokens", F.col("o_orderkey") % 50 + 10)
    return R.greedy_selection(o, "o_custkey", ["rank", "o_orderkey"], "tokens", 80, 3, "o_orderkey")


@query(
    "ret13_label_check",
    """WITH c AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM c),
l AS (SELECT conv_id, turn, list_filter(w, lambda x: regexp_matches(x, '^[A-Z][a-z]+$')) AS l, coalesce(s, []) AS s FROM p WHERE role = 'assistant')
SELECT conv_id, turn, array_to_string(list_sort(list_filter(l, lambda x: list_contains(s, x))), ',') AS used, array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(s, x))), ',') AS unknown FROM l""",
)
def ret13(spark, sf):
    w = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    c = table(spark, sf, "conversations").withColumn("w", w).withColumn("s", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    c = c.select("conv_id", "turn", F.filter("w", lambda x: x.rlike("^[A-Z][a-z]+$")).alias("l"), F.coalesce("s", F.array().cast("array<string>")).alias("s"))
    return R.checked_labels(c, ["conv_id", "turn"], "l", "s").select("conv_id", "turn", F.array_join("used", ",").alias("used"), F.array_join("unknown", ",").alias("unknown"))


@query(
    "ret13_confirmed_answers",
    r"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '(^|\s)([A-Z][a-z]+)', '\1[\2]', 'g') AS t, list_distinct(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM c),
l AS (SELECT conv_id, turn, t, list_distinct(regexp_extract_all(t, '\[([A-Z][a-z]+)\]', 1)) AS l, coalesce(s, []) AS s FROM p WHERE role = 'assistant')
SELECT conv_id, turn, sha256(list_reduce(list_prepend(t, list_filter(l, lambda x: NOT list_contains(s, x))), lambda a, x: replace(a, '[' || x || ']', '[source not confirmed]'))) AS answer_sha, array_to_string(list_sort(list_filter(l, lambda x: list_contains(s, x))), ',') AS used FROM l""",
)
def ret13_answers(spark, sf):
    """Turns of the assistant whose capitalised words are labels; those that the turn before holds are confirmed."""
    w = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    c = table(spark, sf, "conversations").withColumn("s", F.lag(w).over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    c = c.withColumn("t", F.regexp_replace("text", r"(^|\s)([A-Z][a-z]+)", "$1[$2]"))
    return R.confirmed_answers(c, "t", "s", r"\[([A-Z][a-z]+)\]").select("conv_id", "turn", F.sha2("answer", 256).alias("answer_sha"), F.array_join("used", ",").alias("used"))


@query(
    "ret14_rule_routing",
    f"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id AS doc, ord, ord // 8 AS section, text, regexp_extract_all(lower(text), {W}) AS t FROM blocks),
r AS (SELECT doc_id AS doc, item_id AS rule, CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 + 1 END AS number, bm.text AS expected, list_distinct(regexp_extract_all(lower(bm.text), {W})) AS w FROM documents JOIN benchmark bm ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
h AS (SELECT doc, section, arg_min(text, ord) AS title, arg_min(t, ord) AS tt FROM b GROUP BY ALL),
c AS (SELECT DISTINCT doc, rule, section FROM r JOIN h USING (doc) WHERE section + 1 = number OR len(list_intersect(w, tt)) / greatest(len(w), 1) >= 0.7),
e AS (SELECT doc, min(ord) AS stop FROM b WHERE ord < 120 AND contains(text, ' | ') GROUP BY doc),
tok AS (SELECT DISTINCT doc, token FROM (SELECT doc, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS token FROM b WHERE contains(text, '!!')) WHERE regexp_matches(token, '^[A-Z][A-Z0-9_-]{{1,15}}$')),
df0 AS (SELECT doc, ord, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS token FROM b JOIN h USING (doc, section) WHERE NOT contains(text, '!!') AND regexp_matches(title, '(?i)(^| )(the|der|la|le) ')),
tf AS (SELECT doc, rule, ord, len, term, count(*) AS tf FROM (SELECT doc, rule, ord, len(t) AS len, w, unnest(t) AS term FROM b JOIN r USING (doc)) WHERE list_contains(w, term) GROUP BY ALL),
sc AS (SELECT doc, rule, ord, sum(ln(1 + n / (1 + df)) * tf / (1 + len / 60)) AS score FROM (SELECT *, count(*) OVER (PARTITION BY doc, rule, term) AS df FROM tf) JOIN (SELECT doc, count(*) AS n FROM b GROUP BY doc) USING (doc) GROUP BY ALL),
top AS (SELECT doc, rule, ord, ord // 8 AS section FROM (SELECT *, row_number() OVER (PARTITION BY doc, rule ORDER BY round(score, 6) DESC, ord) AS k FROM sc) WHERE k <= 8),
u AS (SELECT doc, rule, ord, 'section' AS via FROM c JOIN b USING (doc, section)
  UNION SELECT r.doc, rule, ord, 'front' FROM r JOIN b USING (doc) LEFT JOIN e USING (doc) WHERE number IS NULL AND regexp_matches(expected, '(?i)(^| )(of|and|in) ') AND ord < least(120, coalesce(stop, 120))
  UNION SELECT doc, rule, ord, 'definition' FROM df0 JOIN tok USING (doc, token) JOIN r USING (doc)
  UNION SELECT b.doc, rule, b.ord, 'index' FROM top JOIN b ON b.doc = top.doc AND abs(b.ord - top.ord) <= 1 AND b.section = top.section)
SELECT doc, rule, ord, string_agg(via, ',' ORDER BY via) AS via FROM u GROUP BY ALL""",
)
def ret14(spark, sf):
    """Every document is checked against one rule of the benchmark; sections are eight blocks with their first as title."""
    b = blocks(spark, sf).select(F.col("doc_id").alias("doc"), "ord", F.floor(F.col("ord") / 8).alias("section"), "text")
    items = asked(spark, sf).select(F.col("item_id").alias("rule"), F.col("text").alias("expected"), F.array_distinct("terms").alias("terms"))
    n = items.count()
    rules = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % n).alias("rule"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 4 + 1).alias("number")).join(items, "rule")
    return R.route_rules(rules, b, "(?i)(^| )(of|and|in) ", r" \| ", "(?i)(^| )(the|der|la|le) ", "^[A-Z][A-Z0-9_-]{1,15}$", F.contains("text", F.lit("!!")))
