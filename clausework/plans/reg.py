"""Queries over the register, workflow tables and packing (REG)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.functions.text import prefix_terms
from clausework.operators import register as R
from clausework.plans.registry import query
from clausework.plans.src import BLOCKS_SQL, blocks
from clausework.plans.txt import STOPS
from clausework.sources.tables import table


@query(
    "reg1_register_filter",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority LIKE '%HIGH%' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)",
)
def reg1(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    found = o.where(F.col("o_orderstatus").isin("O", "P") & F.contains("o_orderpriority", F.lit("HIGH")))
    return found.join(l.where("l_returnflag = 'R' and l_quantity > 30"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("reg2_pages", "SELECT o_orderkey, o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1) // 3)::BIGINT AS page FROM orders")
def reg2(spark, sf):
    o = table(spark, sf, "orders").withColumn("late", -F.unix_date(F.to_date("o_orderdate")))
    return R.page_numbers(o, ["late", "o_orderkey"], 3, ["o_custkey"]).select("o_orderkey", "o_custkey", "page")


@query("reg3_disposition_upsert", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id, round(value, 4) AS value, event_type = 'error' AND length(props) < 9 AS rejected FROM r WHERE n = 1")
def reg3(spark, sf):
    last = R.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"), ((F.col("event_type") == "error") & (F.length("props") < 9)).alias("rejected"))


@query("reg4_error_register", "SELECT user_id, ts::DATE AS day, min(event_id) AS id, count(*) AS n, bool_or(value > 100) AS fatal FROM events WHERE event_type = 'error' GROUP BY user_id, ts::DATE")
def reg4(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("id"), F.count("*").alias("n"), F.bool_or(F.col("value") > 100).alias("fatal"))


@query("reg5_lessons", "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'general' END AS scope, count(*) AS evidence FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY source")
def reg5(spark, sf):
    return R.lessons(table(spark, sf, "labels").where("quality = 0").join(table(spark, sf, "documents"), "doc_id"), "source", "lang")


@query(
    "reg6_versioned_update",
    """WITH h AS (SELECT user_id, count(*) AS now FROM events WHERE event_type = 'click' GROUP BY user_id), u AS (SELECT user_id, event_id AS upd, (SELECT now FROM h WHERE h.user_id = e.user_id) - event_id % 2 AS expected FROM events e WHERE event_type = 'purchase'),
r AS (SELECT u.user_id, upd, expected = coalesce(now, 0) AS fits, row_number() OVER (PARTITION BY u.user_id, expected = coalesce(now, 0) ORDER BY upd) AS n FROM u LEFT JOIN h ON u.user_id = h.user_id)
SELECT user_id, upd AS "update", CASE WHEN fits AND n = 1 THEN 'accepted' ELSE 'conflict' END AS state FROM r""",
)
def reg6(spark, sf):
    e = table(spark, sf, "events")
    h = e.where("event_type = 'click'").withColumn("revision", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("user_id", "revision")
    n = h.groupBy("user_id").agg(F.max("revision").alias("now"))
    u = e.where("event_type = 'purchase'").join(n, "user_id", "left").select("user_id", F.col("event_id").alias("update"), (F.col("now") - F.col("event_id") % 2).alias("expected"))
    return R.versioned_update(h, u, "user_id")


@query(
    "reg6_active_lessons",
    """WITH l AS (SELECT event_id AS id, user_id AS owner, CASE WHEN event_id % 4 = 0 THEN 'general' ELSE event_type END AS type, ts AS created FROM events WHERE event_id % 3 > 0), a AS (SELECT DISTINCT user_id AS owner, event_type AS type FROM events),
r AS (SELECT a.owner, a.type, l.id, row_number() OVER (PARTITION BY a.owner, a.type ORDER BY created DESC, l.id DESC) AS place FROM a JOIN l ON l.owner = a.owner AND l.type IN (a.type, 'general')) SELECT owner, type, id, place FROM r WHERE place <= 4""",
)
def reg6_lessons(spark, sf):
    e = table(spark, sf, "events")
    stored = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.when(F.col("event_id") % 4 == 0, "general").otherwise(F.col("event_type")).alias("type"), F.col("ts").alias("created"), (F.col("event_id") % 3 > 0).alias("active"))
    return R.active_lessons(e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("type")), stored)


@query("reg7_rule_batches", "SELECT p_partkey, p_brand, p_type, ((row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1) // 6)::BIGINT AS page FROM part")
def reg7(spark, sf):
    return R.page_numbers(table(spark, sf, "part"), ["p_partkey"], 6, ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type", "page")


@query(
    "reg8_overlap_packs",
    """WITH RECURSIVE g AS (SELECT l_orderkey, l_linenumber, list_sort(list_distinct(list((l_suppkey % 8)::INT))) AS b FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seq FROM g),
w AS (SELECT l_orderkey, l_linenumber, seq, [{'n': 1, 'b': b}] AS packs, 1 AS spot FROM r WHERE seq = 1
  UNION ALL SELECT l_orderkey, l_linenumber, seq, CASE WHEN spot IS NULL THEN list_append(packs, {'n': 1, 'b': b}) ELSE list_transform(packs, lambda p, i: CASE WHEN i = spot THEN {'n': p.n + 1, 'b': list_distinct(list_concat(p.b, b))} ELSE p END) END, coalesce(spot, len(packs) + 1)
  FROM (SELECT *, CASE WHEN list_max(gain) > 0 THEN list_position(gain, list_max(gain)) END AS spot
    FROM (SELECT r.*, packs, list_transform(packs, lambda p: CASE WHEN p.n < 3 AND list_sum(list_transform(list_distinct(list_concat(p.b, r.b)), lambda x: 100 + x)) <= 400 THEN coalesce(list_sum(list_transform(list_intersect(p.b, r.b), lambda x: 100 + x)), 0)::INT ELSE 0 END) AS gain
      FROM w JOIN r ON r.l_orderkey = w.l_orderkey AND r.seq = w.seq + 1)))
SELECT l_orderkey, l_linenumber, (spot - 1)::INT AS pack FROM w""",
)
def reg8(spark, sf):
    b = F.array_sort(F.collect_set(F.struct((F.col("l_suppkey") % 8).alias("id"), (100 + F.col("l_suppkey") % 8).alias("n"))))
    rules = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(b.alias("blocks"))
    return R.pack_by_overlap(rules, "l_orderkey", "l_linenumber", "blocks", 3, 400)


@query(
    "reg9_budgeted_batches",
    f"""WITH RECURSIVE {BLOCKS_SQL}, b AS (SELECT doc_id, list(ord ORDER BY ord) AS ords, list(ord % 8 = 0 ORDER BY ord) AS heads, list(c ORDER BY ord) AS cum, max(n) AS most, count(*) AS n FROM (SELECT doc_id, ord, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS c FROM blocks) GROUP BY doc_id),
r AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items, list(length(bm.text) ORDER BY item_id) AS costs, count(*) AS m FROM documents JOIN benchmark bm ON item_id % 10 = doc_id % 10 GROUP BY doc_id),
g(doc_id, lo, hi) AS (SELECT doc_id, lo, least(lo + 15, m - 1) FROM (SELECT doc_id, m, unnest(range(0, m, 16)) AS lo FROM r)
  UNION ALL SELECT doc_id, CASE h WHEN 0 THEN lo ELSE lo + (hi - lo + 1) // 2 END, CASE h WHEN 0 THEN lo + (hi - lo + 1) // 2 - 1 ELSE hi END FROM g JOIN r USING (doc_id) LEFT JOIN b USING (doc_id), (VALUES (0), (1)) AS v(h)
  WHERE hi > lo AND NOT coalesce(list_sum(costs[lo + 1:hi + 1]) + most <= 3000, false)),
f AS (SELECT g.*, items[lo + 1] AS first_rule, items[hi + 1] AS last_rule, hi - lo + 1 AS rules, list_sum(costs[lo + 1:hi + 1]) AS cost, coalesce(list_sum(costs[lo + 1:hi + 1]) + most <= 3000, false) AS fits FROM g JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)),
p(doc_id, lo, part, s, e) AS (SELECT doc_id, lo, -1, 0::BIGINT, 0::BIGINT FROM f WHERE fits
  UNION ALL SELECT doc_id, lo, part + 1, e, CASE WHEN e0 < n THEN coalesce(list_max(list_filter(range(e + (e0 - e) // 2 + 1, e0), lambda k: heads[k + 1])), e0) ELSE e0 END
  FROM (SELECT p.*, b.n, heads, p.e + len(list_filter(cum[p.e + 1:], lambda x: x - coalesce(cum[p.e], 0) <= 3000 - cost)) AS e0 FROM p JOIN f ON f.doc_id = p.doc_id AND f.lo = p.lo AND fits JOIN b ON b.doc_id = p.doc_id WHERE p.e < b.n))
SELECT f.doc_id, first_rule::BIGINT AS first_rule, last_rule::BIGINT AS last_rule, rules::INT AS rules, part::INT AS part, ords[s + 1]::BIGINT AS first, ords[e]::BIGINT AS last, (cost + cum[e] - coalesce(cum[s], 0))::BIGINT AS size, true AS fits FROM p JOIN f ON f.doc_id = p.doc_id AND f.lo = p.lo AND fits JOIN b ON b.doc_id = p.doc_id WHERE part >= 0
UNION ALL SELECT doc_id, first_rule, last_rule, rules, NULL, NULL, NULL, cost, false FROM f WHERE NOT fits AND (hi = lo)""",
)
def reg9(spark, sf):
    """Every document is checked against a tenth of the benchmark's items; a block's cost is its length."""
    b = blocks(spark, sf).select("doc_id", "ord", F.length("text").alias("n"), (F.col("ord") % 8 == 0).alias("head"))
    items = table(spark, sf, "benchmark").select((F.col("item_id") % 10).alias("_k"), F.col("item_id").alias("rule"), F.length("text").alias("cost"))
    rules = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 10).alias("_k")).join(items, "_k").drop("_k")
    return R.budgeted_batches(rules, b, "doc_id", 3000)


@query(
    "reg10_topic_clusters",
    f"""WITH f AS (SELECT doc_id, source, sha256(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOPS}, w) AND length(w) >= 3), lambda w: left(w, 7)))), ' ')) AS topic FROM documents),
w AS (SELECT topic FROM f GROUP BY topic HAVING count(DISTINCT source) >= 2) SELECT topic, doc_id, ((row_number() OVER (PARTITION BY topic ORDER BY doc_id) - 1) // 8)::BIGINT AS page FROM f JOIN w USING (topic)""",
)
def reg10(spark, sf):
    return R.topic_clusters(table(spark, sf, "documents"), prefix_terms("text"), "source", "doc_id")


@query("reg11_cache_reuse", "WITH c AS (SELECT sha256(text) AS d, min(n_chars) AS answer FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, n_chars AS answer, sha256(text) IN (SELECT d FROM c) AS cached FROM documents")
def reg11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))
    cache = d.where("doc_id % 2 = 0").groupBy("digest").agg(F.min("n").alias("answer"))
    return R.reuse(d, cache, "digest", lambda fresh: fresh.select("digest", F.col("n").alias("answer"))).select("doc_id", "answer", "cached")


def length_scorer(texts: list[str]) -> list[tuple[str, float]]:
    """A deterministic stand-in for a model: label by length, score by the share of spaces."""
    return [("long" if len(t or "") > 1000 else "short", (t or "").count(" ") / max(1, len(t or ""))) for t in texts]


@query("reg12_scored_stage", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS label, round((length(text) - length(replace(text, ' ', ''))) / greatest(1, length(text)), 6) AS score, true AS valid FROM documents")
def reg12(spark, sf):
    return R.score_requests(table(spark, sf, "documents"), "doc_id", "text", length_scorer).withColumn("score", F.round("score", 6))


@query(
    "reg13_ledger_completeness",
    "SELECT conv_id, count(*) AS parts, min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS complete, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS digest FROM conversations WHERE conv_id % 9 <> 0 OR turn <> 1 GROUP BY conv_id",
)
def reg13(spark, sf):
    return R.complete_sequences(table(spark, sf, "conversations").where("conv_id % 9 <> 0 or turn <> 1"), "conv_id", "turn", "text")


@query("udf3_scorer", "SELECT event_id, CASE WHEN length(props) > 8 THEN 'long' ELSE 'short' END AS label, round((length(props) - length(replace(props, ' ', ''))) / length(props), 6) AS score, true AS valid FROM events")
def udf3(spark, sf):
    """The same scorer interface over another table: any callable of a batch of requests."""
    score = lambda texts: [("long" if len(t) > 8 else "short", t.count(" ") / len(t)) for t in texts]
    return R.score_requests(table(spark, sf, "events"), "event_id", "props", score).withColumn("score", F.round("score", 6))
