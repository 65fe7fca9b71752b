"""Queries over roll-ups, metrics and evaluation (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework.operators import rollup as R
from clausework.plans.jn import jn9  # noqa: F401  registers the outline query that agg13 builds on
from clausework.plans.registry import SQL, query
from clausework.plans.src import BLOCKS_SQL, blocks
from clausework.sources.tables import table

PARTS_SQL = """p AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' AND l_partkey % 9 = 0 THEN 'contradicts' WHEN l_orderkey % 5 = 0 THEN 'absent' WHEN l_orderkey % 5 IN (1, 2) THEN 'supports' WHEN l_orderkey % 5 = 3 THEN 'not_applicable' ELSE 'unsure' END AS claim,
  l_discount < 0.095 AS evidence, l_tax < 0.075 AS complete FROM lineitem)"""


@query(
    "agg1_decision_parts",
    f"""WITH {PARTS_SQL} SELECT l_orderkey, count(*) AS parts, CASE WHEN count(*) FILTER (claim = 'contradicts') > 0 THEN 'violated' WHEN bool_and(claim = 'absent') AND bool_and(complete) THEN 'violated' WHEN bool_and(claim = 'supports') AND bool_and(complete) THEN 'satisfied'
  WHEN bool_and(claim = 'not_applicable') AND bool_and(evidence) THEN 'not_applicable' ELSE 'unknown' END AS verdict FROM p GROUP BY l_orderkey""",
)
def agg1(spark, sf):
    k = F.col("l_orderkey") % 5
    claim = F.when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 9 == 0), "contradicts").when(k == 0, "absent").when(k.isin(1, 2), "supports").when(k == 3, "not_applicable").otherwise("unsure")
    return R.aggregate_parts(table(spark, sf, "lineitem").withColumn("claim", claim), ["l_orderkey"], "claim", F.col("l_discount") < 0.095, F.col("l_tax") < 0.075)


@query(
    "agg2_compound",
    """WITH m AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'satisfied' WHEN 'R' THEN 'violated' ELSE 'unknown' END AS v, l_orderkey % 2 = 0 AS every, 1 + l_orderkey % 4 AS expected FROM lineitem),
g AS (SELECT l_orderkey, bool_and(every) AS every, count(*) AS n, max(expected) AS x, count(*) FILTER (v = 'satisfied') AS good, count(*) FILTER (v = 'violated') AS bad FROM m GROUP BY l_orderkey)
SELECT l_orderkey, n AS members, CASE WHEN every THEN CASE WHEN bad > 0 THEN 'violated' WHEN good = n AND n = x THEN 'satisfied' ELSE 'unknown' END ELSE CASE WHEN good > 0 THEN 'satisfied' WHEN bad = n AND n = x THEN 'violated' ELSE 'unknown' END END AS verdict FROM g""",
)
def agg2(spark, sf):
    v = F.when(F.col("l_returnflag") == "A", "satisfied").when(F.col("l_returnflag") == "R", "violated").otherwise("unknown")
    m = table(spark, sf, "lineitem").select("l_orderkey", v.alias("v"), F.when(F.col("l_orderkey") % 2 == 0, "all_of").otherwise("any_of").alias("kind"), (1 + F.col("l_orderkey") % 4).alias("expected"))
    return R.compound(m, "l_orderkey", "kind", "v", "expected")


@query(
    "agg3_coverage_summary",
    """WITH s AS (SELECT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'checked' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'unresolved' ELSE 'checked' END ELSE 'not_applicable' END AS s FROM orders),
g AS (SELECT o_custkey, o_orderpriority, CASE WHEN bool_or(s = 'unresolved') THEN 'unverified' WHEN bool_and(s = 'checked') THEN 'checked' WHEN bool_and(s = 'not_applicable') THEN 'not_applicable' ELSE 'separate' END AS state FROM s GROUP BY ALL)
SELECT o_orderpriority, state, count(*) AS n FROM g GROUP BY ALL""",
)
def agg3(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "checked").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 3 == 0, "unresolved").otherwise("checked")).otherwise("not_applicable")
    return R.coverage_states(table(spark, sf, "orders").withColumn("s", s), ["o_custkey", "o_orderpriority"], "s").groupBy("o_orderpriority", "state").agg(F.count("*").alias("n"))


@query(
    "agg4_stage_metrics",
    "SELECT event_type, count(*) AS tasks, count(*) FILTER (user_id % 4 = 0) AS cached, round(sum(value), 4) AS seconds, sum(event_id % 100)::BIGINT AS prompt, sum(greatest(0, user_id % 3 - 1))::BIGINT AS retries FROM events GROUP BY event_type",
)
def agg4(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("tasks"), F.count_if(F.col("user_id") % 4 == 0).alias("cached"), F.round(F.sum("value"), 4).alias("seconds"), F.sum(F.col("event_id") % 100).alias("prompt"), F.sum(F.greatest(F.lit(0), F.col("user_id") % 3 - 1)).alias("retries"))


LOG_FIELDS = "kind string, name string, status string, session long, seconds double, exclusive_seconds double, value double"


@query(
    "agg5_span_profile",
    """WITH l AS (SELECT event_id % 8 AS k, event_type AS name, user_id * 10 + event_id % 10 AS session, round(value, 2) AS v FROM events),
f AS (SELECT CASE WHEN k < 5 THEN 'phase' WHEN k = 5 THEN 'observation' WHEN k = 7 THEN 'malformed' END AS kind, CASE WHEN k < 6 THEN name END AS name, v, k FROM l WHERE k <> 6),
s AS (SELECT session, bool_or(k = 1) AS a, bool_or(k = 2) AS b, sum(v) FILTER (k = 2) AS w FROM (SELECT session, session % 3 AS k, v FROM l WHERE k = 6) GROUP BY session)
SELECT kind, name, count(*) AS n, count(*) FILTER (kind = 'phase' AND v > 100) AS errors, round(CASE WHEN kind <> 'malformed' THEN sum(v) END, 3) AS total, round(CASE WHEN kind = 'phase' THEN sum(v / 2) END, 3) AS exclusive FROM f GROUP BY kind, name
UNION ALL SELECT 'sessions', CASE WHEN a AND b THEN 'complete' WHEN a THEN 'incomplete' ELSE 'stray' END, count(*), 0, round(sum(w), 3), NULL FROM s WHERE a OR b GROUP BY 2""",
)
def agg5(spark, sf):
    """Events as lines of a log: spans, observations, session marks, and lines that are cut or of no kind."""
    e, k = table(spark, sf, "events"), F.col("event_id") % 8
    v, session = F.round("value", 2), F.col("user_id") * 10 + F.col("event_id") % 10
    span = F.to_json(F.struct(F.lit("span").alias("kind"), F.col("event_type").alias("name"), F.when(v > 100, "failed").otherwise("ok").alias("status"), v.alias("seconds"), (v / 2).alias("exclusive_seconds")))
    seen = F.to_json(F.struct(F.lit("observation").alias("kind"), F.col("event_type").alias("name"), v.alias("value")))
    mark = F.when(session % 3 == 1, F.to_json(F.struct(F.lit("start").alias("kind"), session.alias("session")))).when(session % 3 == 2, F.to_json(F.struct(F.lit("end").alias("kind"), session.alias("session"), v.alias("seconds"))))
    lines = e.select(F.when(k < 5, span).when(k == 5, seen).when(k == 6, mark).otherwise(F.when(F.col("event_id") % 16 == 7, '{"kind": "span", "name": ').otherwise('{"kind": "span"}')).alias("line")).where("line is not null")
    got = R.span_profile(lines, "line", LOG_FIELDS)
    return got.withColumns({c: F.round(c, 3) for c in ("total", "exclusive")})


@query(
    "agg6_exclusive_time",
    """WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id - event_id % 5 END AS parent, value::DOUBLE AS sec FROM events), k AS (SELECT parent, sum(sec) AS c FROM s GROUP BY parent)
SELECT id, round(greatest(0, sec - coalesce(c, 0)), 6) AS exclusive FROM s LEFT JOIN k ON s.id = k.parent""",
)
def agg6(spark, sf):
    k = F.col("event_id") % 5
    s = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(k != 0, F.col("event_id") - k).alias("parent"), F.col("value").alias("seconds"))
    return R.exclusive_seconds(s).select("id", F.round("exclusive", 6).alias("exclusive"))


@query("agg7_distribution", "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, min(l_extendedprice) AS least, round(median(l_extendedprice), 4) AS median, max(l_extendedprice) AS most, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL")
def agg7(spark, sf):
    return R.distribution(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumn("median", F.round("median", 4)).withColumn("total", F.round("total", 2))


@query(
    "agg8_plan_summary",
    f"""WITH {BLOCKS_SQL}, s AS (SELECT doc_id, length(text) * CASE WHEN ord % 3 = 0 THEN 2 ELSE 1 END AS sent, length(text) AS own, sha FROM blocks)
SELECT lang, count(DISTINCT s.doc_id) AS documents, count(DISTINCT sha) AS texts, round(sum(sent) / sum(own), 6) AS passes FROM s JOIN documents USING (doc_id) GROUP BY lang""",
)
def agg8(spark, sf):
    s = blocks(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    n = F.length("text")
    return s.groupBy("lang").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("sha").alias("texts"), F.round(F.sum(n * F.when(F.col("ord") % 3 == 0, 2).otherwise(1)) / F.sum(n), 6).alias("passes"))


@query(
    "agg9_area_metrics",
    "SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS requirements, count(*) FILTER (p_type = 'PROMO') AS terms, count(*) FILTER (p_size > 25) AS confirmed, count(DISTINCT p_name) FILTER (p_size < 3) AS conflicts FROM part GROUP BY p_brand",
)
def agg9(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.col("p_type") == "ECONOMY").alias("requirements"), F.count_if(F.col("p_type") == "PROMO").alias("terms"), F.count_if(F.col("p_size") > 25).alias("confirmed"), F.count_distinct(F.when(F.col("p_size") < 3, F.col("p_name"))).alias("conflicts"))


@query(
    "agg10_precision_recall",
    """WITH j AS (SELECT source, lang, toxic = 1 AS ref, CASE WHEN l.doc_id IS NULL THEN NULL ELSE contains(text, 'idiot') OR contains(text, 'moron') END AS found FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS n, round(CASE WHEN count(*) FILTER (ref AND found IS NULL) = 0 THEN count(*) FILTER (ref AND found) / nullif(count(*) FILTER (ref), 0) END, 6) AS recall, round(count(*) FILTER (ref AND found) / nullif(count(*) FILTER (found), 0), 6) AS precision FROM j GROUP BY source""",
)
def agg10(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    hit = F.contains("text", F.lit("idiot")) | F.contains("text", F.lit("moron"))
    return R.evaluation(j, ["source"], F.coalesce(F.col("toxic") == 1, F.lit(False)), F.when(F.col("toxic").isNotNull(), hit))


@query(
    "agg10_evaluation_summary",
    """WITH r AS (SELECT d.doc_id AS id, coalesce(lang, 'unspecified') AS category, coalesce(CASE WHEN length(text) > 3000 THEN 'high' WHEN length(text) > 500 THEN 'low' END, 'unspecified') AS severity, contains(text, 'idiot') OR contains(text, 'moron') AS found FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1),
i AS (SELECT doc_id AS id, doc_id % 50 AS place, CASE WHEN quality = 1 THEN 'correct' WHEN quality = 0 THEN 'incorrect' END AS verdict, CASE WHEN doc_id % 9 = 0 THEN doc_id - 1 END AS dup FROM labels), c AS (SELECT s_suppkey AS id, s_suppkey % 120 AS place, s_acctbal > 0 AS triggered FROM supplier),
g AS (SELECT category, severity, count(*) AS n, count(*) FILTER (found) AS hits, grouping(category, severity) AS w FROM r GROUP BY GROUPING SETS ((category), (severity), ()))
SELECT CASE w WHEN 1 THEN 'category' WHEN 2 THEN 'severity' ELSE 'all' END AS dimension, coalesce(category, severity) AS value, n, hits, CASE WHEN n > 0 THEN round(hits / n, 6) END AS rate FROM g
UNION ALL SELECT 'precision', NULL, count(verdict), count(*) FILTER (verdict = 'correct'), round(count(*) FILTER (verdict = 'correct') / count(verdict), 6) FROM i
UNION ALL SELECT 'duplicates', NULL, count(*), count(dup), round(count(dup) / count(*), 6) FROM i
UNION ALL SELECT 'controls', NULL, count(*), count(*) FILTER (place IN (SELECT place FROM i)), round(count(*) FILTER (triggered) / count(*), 6) FROM c""",
)
def agg10_summary(spark, sf):
    """Toxic documents as reference items, labels as findings, suppliers as negative controls."""
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    hit = F.contains("text", F.lit("idiot")) | F.contains("text", F.lit("moron"))
    severity = F.when(F.length("text") > 3000, "high").when(F.length("text") > 500, "low")
    reference = d.join(l, "doc_id").where("toxic = 1").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), severity.alias("severity"), hit.alias("found"))
    verdict = F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "incorrect")
    issued = l.select(F.col("doc_id").alias("id"), F.array(F.col("doc_id") % 50).alias("locators"), verdict.alias("verdict"), F.when(F.col("doc_id") % 9 == 0, F.col("doc_id") - 1).alias("duplicate_of"))
    controls = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_suppkey") % 120).cast("long")).alias("locators"), (F.col("s_acctbal") > 0).alias("triggered"))
    return R.evaluation_summary(reference, issued, controls, ["category", "severity"]).withColumn("rate", F.round("rate", 6))


@query(
    "agg11_coverage_samples",
    """WITH r AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'measured' ELSE 'unverified' END AS state, l_orderkey * 8 + l_linenumber AS o, CASE WHEN l_partkey % 3 > 0 THEN l_partkey END AS loc, CASE WHEN l_partkey % 5 = 0 THEN l_shipdate::DATE::VARCHAR END AS sec FROM lineitem WHERE l_quantity > 5),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, state, loc IS NULL ORDER BY o, loc) AS a, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, state, sec IS NULL ORDER BY o, sec) AS b FROM r)
SELECT l_suppkey, l_returnflag, state, count(*) AS occurrences, coalesce(string_agg(loc, ',' ORDER BY a) FILTER (loc IS NOT NULL AND a <= 20), '') AS locators, coalesce(string_agg(sec, ',' ORDER BY b) FILTER (sec IS NOT NULL AND b <= 20), '') AS sections FROM n GROUP BY ALL""",
)
def agg11_samples(spark, sf):
    l = table(spark, sf, "lineitem")
    state = F.when(F.col("l_quantity") <= 5, "confirmed").when(F.col("l_linestatus") == "O", "measured").otherwise("unverified")
    r = l.select("l_suppkey", "l_returnflag", state.alias("state"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("loc"), F.when(F.col("l_partkey") % 5 == 0, F.to_date("l_shipdate").cast("string")).alias("sec"))
    got = R.compact_coverage(r, ["l_suppkey", "l_returnflag"], "state", "o", "loc", "sec")
    return got.withColumn("locators", F.array_join(F.col("locators").cast("array<string>"), ",")).withColumn("sections", F.array_join("sections", ","))


@query(
    "agg11_occurrence_compaction",
    """WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT user_id, event_type, string_agg(event_id, ',' ORDER BY event_id) FILTER (n <= 8) AS shown, greatest(0, count(*) - 8) AS more FROM r GROUP BY ALL""",
)
def agg11(spark, sf):
    c = R.compact(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", 8)
    return c.select("user_id", "event_type", F.array_join(F.transform("shown", lambda x: x.cast("string")), ",").alias("shown"), "more")


@query("agg12_register_facets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg12(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "agg13_template_state",
    "SELECT k, CASE WHEN bool_or(state = 'question' OR contains(notes, 'order')) THEN 'violated' WHEN bool_and(state IN ('matched', 'conditional')) THEN 'checked' ELSE 'unknown' END AS verdict, count(*) AS elements FROM (" + SQL["jn9_outline_differences"] + ") GROUP BY k",
)
def agg13(spark, sf):
    """State of a template from its elements: violated if any is, checked if all are, else unknown."""
    s = jn9(spark, sf)
    bad, good = F.bool_or((F.col("state") == "question") | F.contains("notes", F.lit("order"))), F.bool_and(F.col("state").isin("matched", "conditional"))
    return s.groupBy("k").agg(F.when(bad, "violated").when(good, "checked").otherwise("unknown").alias("verdict"), F.count("*").alias("elements"))


OUTPUTS = {"language": 800, "logic": 1800, "sto": 700, "cross": 1100, "inter": 1100, "verify": 500}


@query(
    "agg14_remaining_time",
    """WITH t AS (SELECT user_id % 20 AS job, event_id AS id, CASE event_type WHEN 'click' THEN 'language' WHEN 'view' THEN 'logic' WHEN 'purchase' THEN 'sto' WHEN 'signup' THEN 'verify' ELSE 'cross' END AS stage, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'split' ELSE 'done' END AS state,
  floor(epoch(ts))::BIGINT::DOUBLE AS started, CASE WHEN event_id % 5 > 1 THEN floor(epoch(ts))::BIGINT + round(value, 2) END AS ended, event_id % 7 = 0 AS cached, event_id % 11 = 0 AS known, CASE WHEN event_id % 3 = 0 THEN event_id % 500 END AS input, event_id % 900 AS prompt, event_id % 400 AS completion,
  CASE WHEN user_id % 4 > 0 THEN 100.0 + event_id % 50 END AS pr, CASE WHEN user_id % 4 > 0 THEN 20.0 + event_id % 9 END AS gr FROM events),
j AS (SELECT job, max(started) + 100 AS now, job % 3 = 0 AS no_cross, job % 3 = 1 AS no_inter, job % 6 AS related, job % 7 <> 0 AS check_logic FROM t GROUP BY job),
m AS (SELECT job, stage, median(ended - started) AS s, median(prompt) FILTER (prompt > 0) AS i, median(completion) FILTER (completion > 0) AS o FROM t WHERE NOT cached GROUP BY ALL), r AS (SELECT job, median(pr) AS rate_in, median(gr) AS rate_out FROM t WHERE NOT cached GROUP BY job),
c AS (SELECT job, count(*) FILTER (stage = 'logic') AS logic, count(*) FILTER (stage = 'logic' AND state IN ('done', 'split')) AS fin, count(*) FILTER (state = 'done' AND stage <> 'verify') AS ana, count(*) FILTER (state IN ('pending', 'running') AND stage <> 'verify') AS ahead FROM t GROUP BY job),
g AS (SELECT job, sum(ceil(n / 8)) AS groups FROM (SELECT job, id % 37 AS topic, count(*) AS n, count(DISTINCT id % 5) AS p FROM t WHERE stage = 'logic' AND state = 'done' GROUP BY ALL) WHERE p >= 2 GROUP BY job),
l AS (SELECT doc_id % 20 AS job, sum(ceil((length(text) // 100) / 12)) AS links FROM documents GROUP BY 1), f AS (SELECT job, count(*) FILTER (id % 4 = 0) AS cand, count(*) FILTER (id % 4 > 1) AS rev FROM t WHERE stage = 'cross' GROUP BY job),
x AS (SELECT j.*, c.*, coalesce(cand, 0) AS cand, coalesce(rev, 0) AS rev, CASE WHEN NOT no_cross AND check_logic THEN CASE WHEN fin > 0 THEN ceil(coalesce(groups, 0) * logic / fin) ELSE ceil(logic / 3) END + coalesce(links, 0) END AS cross_, CASE WHEN NOT no_inter THEN 12 * related END AS inter_
  FROM j JOIN c USING (job) LEFT JOIN g USING (job) LEFT JOIN l USING (job) LEFT JOIN f USING (job)),
y AS (SELECT *, ceil((cand + (coalesce(cross_, 0) + coalesce(inter_, 0) + ahead) * CASE WHEN ana > 0 THEN rev / greatest(ana, 1) ELSE 0.3 END) / 3) AS verify_ FROM x),
w AS (SELECT job, 'cross' AS stage, cross_ AS future FROM y WHERE cross_ IS NOT NULL UNION ALL SELECT job, 'inter', inter_ FROM y WHERE inter_ IS NOT NULL UNION ALL SELECT job, 'verify', verify_ FROM y),
d AS (SELECT unnest(['language', 'logic', 'sto', 'cross', 'inter', 'verify']) AS stage, unnest([800, 1800, 700, 1100, 1100, 500]) AS d),
o AS (SELECT t.job, t.stage, 1 AS open, 0 AS future, state, started, known, now, coalesce(coalesce(nullif(input, 0), i, 4000) / rate_in + coalesce(o, d, 1000) / rate_out + 1, s, 35) AS sec FROM t JOIN j USING (job) LEFT JOIN m USING (job, stage) LEFT JOIN r USING (job) LEFT JOIN d USING (stage) WHERE state IN ('pending', 'running')),
e AS (SELECT job, stage, 1 AS open, 0 AS future, CASE WHEN state = 'running' THEN greatest(3, sec - (now - started)) WHEN known THEN 1 ELSE sec END AS sec FROM o
  UNION ALL SELECT w.job, w.stage, 0, future, future * coalesce(coalesce(i, 4000) / rate_in + coalesce(o, d, 1000) / rate_out + 1, s, 35) FROM w LEFT JOIN m USING (job, stage) LEFT JOIN r USING (job) LEFT JOIN d USING (stage))
SELECT job, stage, sum(open)::BIGINT AS open, sum(future)::BIGINT AS future, round(sum(sec), 2) AS seconds FROM e GROUP BY job, stage""",
)
def agg14(spark, sf):
    """Events as tasks of twenty jobs; findings from the tasks of one stage, referring blocks from the documents."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    stage = F.when(F.col("event_type") == "click", "language").when(F.col("event_type") == "view", "logic").when(F.col("event_type") == "purchase", "sto").when(F.col("event_type") == "signup", "verify").otherwise("cross")
    began = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    timed = F.col("user_id") % 4 > 0
    tasks = e.select(
        (F.col("user_id") % 20).alias("job"), k.alias("id"), stage.alias("stage"), F.when(k % 5 == 0, "pending").when(k % 5 == 1, "running").when(k % 5 == 2, "split").otherwise("done").alias("state"), began.alias("started"), F.when(k % 5 > 1, began + F.round("value", 2)).alias("ended"),
        (k % 7 == 0).alias("cached"), (k % 11 == 0).alias("known"), F.when(k % 3 == 0, k % 500).alias("input"), (k % 900).alias("prompt"), (k % 400).alias("completion"), F.when(timed, 100.0 + k % 50).alias("prompt_rate"), F.when(timed, 20.0 + k % 9).alias("generation_rate"),
    )
    job = F.col("job")
    jobs = tasks.groupBy("job").agg((F.max("started") + 100).alias("now")).withColumns({"derived": F.when(job % 3 == 0, F.array(F.lit("cross"))).when(job % 3 == 1, F.array(F.lit("inter"))), "related": job % 6, "check_logic": job % 7 != 0})
    facts = tasks.where("stage = 'logic' and state = 'done'").select("job", (F.col("id") % 37).alias("topic"), (F.col("id") % 5).alias("place"))
    references = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("job"), F.col("doc_id").alias("document"), F.expr("length(text) div 100").alias("n"))
    findings = tasks.where("stage = 'cross'").select("job", F.element_at(F.array(*map(F.lit, ("candidate", "style", "confirmed", "rejected"))), (F.col("id") % 4 + 1).cast("int")).alias("status"))
    return R.forecast(jobs, tasks, R.derived_work(jobs, tasks, facts, references, findings), OUTPUTS).withColumn("seconds", F.round("seconds", 2))


@query("agg15_queue_statistics", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderdate) AS oldest FROM orders GROUP BY ALL")
def agg15(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"))


CARDS_SQL = """c AS (SELECT p_partkey AS id, p_brand AS provenance, CASE WHEN p_size < 5 THEN 'needs_review' WHEN p_size % 7 = 0 THEN 'rejected' ELSE 'confirmed' END AS state, p_type AS modality, (p_size % 3)::VARCHAR AS scope, split_part(p_name, ' ', 2) AS category, p_size FROM part),
l AS (SELECT l_orderkey || '/' || l_linenumber AS locator, l_partkey, l_discount = 0 AND l_tax = 0 AS review, l_returnflag AS reason FROM lineitem)"""


def cards(spark, sf):
    state = F.when(F.col("p_size") < 5, "needs_review").when(F.col("p_size") % 7 == 0, "rejected").otherwise("confirmed")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("provenance"), state.alias("state"), F.col("p_type").alias("modality"), (F.col("p_size") % 3).cast("string").alias("scope"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category"), "p_size")


@query(
    "agg16_analysis_summary",
    f"""WITH {CARDS_SQL}, g AS (SELECT provenance, state, modality, scope, category, count(*) AS n, grouping(provenance, state, modality, scope, category) AS w FROM c GROUP BY GROUPING SETS ((provenance), (state), (modality), (scope), (category), ()))
SELECT CASE w WHEN 15 THEN 'provenance' WHEN 23 THEN 'state' WHEN 27 THEN 'modality' WHEN 29 THEN 'scope' WHEN 30 THEN 'category' ELSE 'cards' END AS dimension, coalesce(provenance, state, modality, scope, category) AS value, n FROM g
UNION ALL SELECT 'unresolved dependencies', NULL, count(*) FROM lineitem WHERE l_suppkey % 9 = 0 AND l_partkey IN (SELECT id FROM c)
UNION ALL SELECT 'review queue', NULL, (SELECT count(*) FROM c WHERE state = 'needs_review') + (SELECT count(*) FROM l WHERE review)""",
)
def agg16(spark, sf):
    c, lines = cards(spark, sf), table(spark, sf, "lineitem")
    dependencies = lines.select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 9 == 0).alias("unresolved"))
    return R.analysis_summary(c, ["provenance", "state", "modality", "scope", "category"], dependencies, review_queue(spark, sf))


def review_queue(spark, sf):
    c = cards(spark, sf).select(F.col("id").cast("string").alias("locator"), "id", "state", F.when(F.col("p_size") < 3, "size").otherwise("small").alias("reason"))
    ledger = table(spark, sf, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("locator"), F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), "needs_review").otherwise("closed").alias("state"), F.col("l_returnflag").alias("reason"))
    return R.review_queue(c, ledger)


@query(
    "agg16_review_queue",
    f"""WITH {CARDS_SQL} SELECT id::VARCHAR AS locator, id AS candidate, CASE WHEN p_size < 3 THEN 'size' ELSE 'small' END AS reason FROM c WHERE state = 'needs_review'
UNION ALL SELECT locator, NULL, reason FROM l WHERE review""",
)
def agg16_queue(spark, sf):
    return review_queue(spark, sf)
