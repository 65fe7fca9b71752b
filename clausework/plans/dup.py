"""Queries over duplicates, diffs and merges (DUP)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.functions.text import normalised
from clausework.operators import dedup as D
from clausework.plans.registry import query
from clausework.plans.src import BLOCKS_SQL, blocks
from clausework.sources.tables import table


@query(
    "dup1_finding_identity",
    """WITH f AS (SELECT user_id, event_type, ts::DATE AS day, list_sort(list(CAST(floor(value / 20) AS BIGINT)::VARCHAR)) AS ev, min(event_id) AS id FROM events GROUP BY ALL),
k AS (SELECT *, sha256(event_type || '|' || array_to_string(ev, ',')) AS key FROM f) SELECT key, min(id) AS id, count(*) AS n FROM k GROUP BY key""",
)
def dup1(spark, sf):
    f = table(spark, sf, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.collect_list(F.floor(F.col("value") / 20).cast("string")).alias("ev"), F.min("event_id").alias("id"))
    k = f.select("id", D.finding_key(F.col("event_type"), evidence=F.col("ev")).alias("key"))
    n = k.groupBy("key").agg(F.count("*").alias("n"))
    return D.first_of(k, F.col("key"), ["id"]).join(n, "key")


@query(
    "dup1_special_keys",
    r"""WITH f AS (SELECT event_id AS id, user_id % 30 AS job, CASE WHEN event_id % 4 = 0 THEN 'r' || event_id % 3 END AS req, CASE WHEN event_id % 6 = 0 THEN 'arithmetic' ELSE event_type END AS cat, event_id % 3 AS k, floor(value / 40)::INT AS p,
  ['Mixed alphabet', 'Wrong number of the table', 'Other'][(event_id % 3 + 1)::INT] AS issue, CASE WHEN event_id % 5 > 0 THEN 'Write   ' || ['it', 'IT', 'that'][(event_id % 7 % 3 + 1)::INT] END AS sug FROM events),
q AS (SELECT *, CASE k WHEN 0 THEN 'the word AБ' || p || ' here' WHEN 1 THEN 'table ' || p || '.1 and ' || p % 3 ELSE 'quote ' || p END AS quote FROM f),
w AS (SELECT *, CASE WHEN req IS NULL AND k = 1 THEN concat_ws(chr(29), 'numbered_reference', 'reference', array_to_string(list_sort(list_distinct([p || '.1', (p % 3)::VARCHAR, '7'])), chr(30)), array_to_string(list_sort(['d' || chr(31) || p, 'd' || chr(31) || 'x']), chr(30)))
  WHEN req IS NULL AND k = 0 THEN concat_ws(chr(29), 'mixed_alphabet', 'identifier', 'd' || chr(31) || p || chr(31) || 'AБ' || p)
  ELSE concat_ws(chr(29), CASE WHEN cat = 'arithmetic' THEN 'arithmetic' ELSE trim(regexp_replace(lower(coalesce(sug, issue)), '\s+', ' ', 'g')) END, cat, array_to_string(list_sort(['d' || chr(31) || p || chr(31) || quote, 'd' || chr(31) || 'x' || chr(31) || 'page 7']), chr(30))) END AS what FROM q)
SELECT id, left(sha256(job || chr(28) || what), 24) AS key FROM w""",
)
def dup1_special(spark, sf):
    """Findings from events: mixed alphabets, numbers of references, sums, and plain proposals; each with two pieces of evidence."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    p = F.floor(F.col("value") / 40).cast("int")
    quote = F.when(k % 3 == 0, F.concat(F.lit("the word AБ"), p.cast("string"), F.lit(" here"))).when(k % 3 == 1, F.concat(F.lit("table "), p.cast("string"), F.lit(".1 and "), (p % 3).cast("string"))).otherwise(F.concat(F.lit("quote "), p.cast("string")))
    piece = lambda loc, q: F.struct(F.lit("d").alias("document"), loc.alias("locator"), q.alias("quote"))
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    f = e.select(
        k.alias("id"), (F.col("user_id") % 30).alias("job"), F.when(k % 4 == 0, F.concat(F.lit("r"), (k % 3).cast("string"))).alias("requirement"), F.when(k % 6 == 0, "arithmetic").otherwise(F.col("event_type")).alias("category"),
        F.array(piece(p.cast("string"), quote), piece(F.lit("x"), F.lit("page 7"))).alias("evidence"), F.when(k % 5 > 0, F.concat(F.lit("Write   "), pick(k % 7 % 3, "it", "IT", "that"))).alias("suggestion"),
        pick(k % 3, "Mixed alphabet", "Wrong number of the table", "Other").alias("issue"), F.lit(None).cast("string").alias("explanation"),
    )
    return D.finding_identity(f, "arithmetic", "(?i)mixed alphabet", "(?i)table|figure|appendix", "(?i)number|reference")


@query(
    "dup2_duplicate_groups",
    """WITH RECURSIVE f AS (SELECT event_id AS id, event_type AS req, event_id % 2 AS cat, user_id AS doc, CAST(floor(value / 60) AS BIGINT) AS place, CAST(floor(value / 20) AS BIGINT) AS quote, CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS dk,
  ['replace it by the value of the contract', 'fix', 'fix it'][(event_id % 3 + 1)::INT] AS sug, 'the value ' || CAST(floor(value) AS BIGINT) || ' of user ' || user_id || [' differs from the contract', ' is missing there', ' contradicts the contract'][(event_id % 7 % 3 + 1)::INT] AS iss,
  row_number() OVER (PARTITION BY event_type, user_id, floor(value / 60) ORDER BY event_id) AS seq FROM events),
w AS (SELECT req, doc, place, id, seq, [{'id': id, 'cat': cat, 'dk': dk, 'sug': sug, 'iss': iss, 'quote': quote}] AS keep, NULL::BIGINT AS m FROM f WHERE seq = 1
  UNION ALL SELECT req, doc, place, id, seq, CASE WHEN m IS NULL THEN list_append(keep, {'id': id, 'cat': cat, 'dk': dk, 'sug': sug, 'iss': iss, 'quote': quote}) ELSE keep END, m
  FROM (SELECT f.*, keep, coalesce(list_filter(keep, lambda x: x.cat = f.cat AND (coalesce(x.dk = f.dk, false) OR x.sug = f.sug AND 1 - levenshtein(x.iss, f.iss) / greatest(length(x.iss), length(f.iss)) >= 0.9))[1].id,
     CASE WHEN length(f.sug) > 24 THEN list_filter(keep, lambda x: x.sug = f.sug AND x.quote = f.quote)[1].id END) AS m FROM w JOIN f ON f.req = w.req AND f.doc = w.doc AND f.place = w.place AND f.seq = w.seq + 1))
SELECT id, m AS duplicate_of FROM w""",
)
def dup2(spark, sf):
    """Findings from events: requirement by type, evidence in the user's document, a defect key for every fifth."""
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    e = table(spark, sf, "events")
    text = lambda c: c.cast("long").cast("string")
    evidence = F.array(F.struct(F.col("user_id").cast("string").alias("document"), text(F.floor(F.col("value") / 60)).alias("locator"), text(F.floor(F.col("value") / 20)).alias("quote")))
    issue = F.concat(F.lit("the value "), text(F.floor("value")), F.lit(" of user "), F.col("user_id").cast("string"), pick(F.col("event_id") % 7 % 3, " differs from the contract", " is missing there", " contradicts the contract"))
    f = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("requirement"), (F.col("event_id") % 2).alias("category"), evidence.alias("evidence"), F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 3).cast("string")).alias("defect_key"), pick(F.col("event_id") % 3, "Replace it by the value of the contract", "Fix", "Fix it").alias("suggestion"), issue.alias("issue"))
    return D.duplicate_groups(f)


@query(
    "dup3_coalesce_findings",
    "SELECT l_orderkey, l_returnflag, array_to_string(list_sort(list_distinct(list(l_linestatus || l_linenumber))), '; ') AS texts, count(DISTINCT l_partkey) AS evidence, CASE WHEN bool_or(l_tax = 0) THEN 'question' ELSE 'error' END AS kind FROM lineitem GROUP BY ALL",
)
def dup3(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("t", F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    return D.coalesce_findings(l, ["l_orderkey", "l_returnflag"], "t", "l_partkey", F.col("l_tax") == 0)


@query(
    "dup4_cue_duplicates",
    f"""WITH {BLOCKS_SQL}, k AS (SELECT doc_id, ord, regexp_extract(lower(text), '(^|[^\\p{{L}}])(the|der|la|el|of|and|le) ([\\p{{L}}]+)', 2) AS modal, regexp_extract(lower(text), '(^|[^\\p{{L}}])(the|der|la|el|of|and|le) ([\\p{{L}}]+)', 3) AS verb FROM blocks)
SELECT doc_id, modal, verb, min(ord) AS ord, count(*) AS n FROM k WHERE modal <> '' GROUP BY ALL""",
)
def dup4(spark, sf):
    """Same document, cue and following word only; a lexicon of cues stands in for morphology."""
    p = r"(^|[^\p{L}])(the|der|la|el|of|and|le) ([\p{L}]+)"
    k = blocks(spark, sf).select("doc_id", "ord", F.regexp_extract(F.lower("text"), p, 2).alias("modal"), F.regexp_extract(F.lower("text"), p, 3).alias("verb")).where("modal <> ''")
    return k.groupBy("doc_id", "modal", "verb").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))


@query("dup5_semantic_hash", "SELECT p_partkey, sha256(p_name || '|' || p_type || '|' || p_size) AS meaning FROM part")
def dup5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string")), 256).alias("meaning"))


@query(
    "dup6_context_digest",
    "WITH m AS (SELECT s_nationkey, string_agg(sha256(s_name), '' ORDER BY sha256(s_name)) AS m FROM supplier GROUP BY s_nationkey) SELECT n_nationkey AS nation, sha256(sha256(n_name) || coalesce(m, '')) AS digest FROM nation LEFT JOIN m ON n_nationkey = s_nationkey",
)
def dup6(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.sha2("n_name", 256).alias("d"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.sha2("s_name", 256).alias("d"))
    return D.context_digest(n, s, "nation", "d")


@query(
    "dup7_release_diff",
    """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS lineage, sha256(o_custkey || '|' || o_totalprice::DECIMAL(18,2)) AS meaning, o_custkey || '/' || o_orderdate::DATE AS locator, o_orderpriority AS context, o_orderstatus AS trust, o_custkey % 3 AS family FROM orders),
o AS (SELECT * FROM r WHERE id % 13 <> 0), n AS (SELECT -id AS id, lineage, CASE WHEN id % 5 = 0 THEN 'new' || id ELSE meaning END AS meaning, CASE WHEN id % 7 = 0 THEN 'moved' || id ELSE locator END AS locator, CASE WHEN id % 3 = 0 THEN 'x' ELSE context END AS context, trust, CASE WHEN id % 19 = 0 THEN family + 1 ELSE family END AS family FROM r WHERE id % 17 <> 0),
m1 AS (SELECT o.id AS a, n.id AS b FROM o JOIN n USING (lineage)), o2 AS (SELECT * FROM o WHERE id NOT IN (SELECT a FROM m1)), n2 AS (SELECT * FROM n WHERE id NOT IN (SELECT b FROM m1)),
m2 AS (SELECT min(o2.id) AS a, min(n2.id) AS b FROM o2 JOIN n2 USING (family, meaning) GROUP BY family, meaning HAVING count(*) = 1), o3 AS (SELECT * FROM o2 WHERE id NOT IN (SELECT a FROM m2)), n3 AS (SELECT * FROM n2 WHERE id NOT IN (SELECT b FROM m2)),
m3 AS (SELECT min(o3.id) AS a, min(n3.id) AS b FROM o3 JOIN n3 USING (family, locator) GROUP BY family, locator HAVING count(*) = 1), m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
SELECT o.id AS o_id, n.id AS n_id, CASE WHEN o.meaning <> n.meaning THEN 'meaning_changed' WHEN o.locator <> n.locator THEN 'renumbered' WHEN o.context <> n.context THEN 'context_changed' WHEN o.trust <> n.trust THEN 'trust_changed' ELSE 'same' END AS kind FROM m JOIN o ON o.id = a JOIN n ON n.id = b
UNION ALL SELECT id, NULL, 'removed' FROM o3 WHERE id NOT IN (SELECT a FROM m3) UNION ALL SELECT NULL, id, 'added' FROM n3 WHERE id NOT IN (SELECT b FROM m3)""",
)
def dup7(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    meaning = F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")), 256)
    r = o.select(k.alias("id"), F.when(k % 4 != 0, k).alias("lineage"), meaning.alias("meaning"), F.concat_ws("/", F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string")).alias("locator"), F.col("o_orderpriority").alias("context"), F.col("o_orderstatus").alias("trust"), (F.col("o_custkey") % 3).alias("family"))
    i = F.col("id")
    n = r.where("id % 17 <> 0").select(
        (-i).alias("id"), "lineage", F.when(i % 5 == 0, F.concat(F.lit("new"), i.cast("string"))).otherwise(F.col("meaning")).alias("meaning"),
        F.when(i % 7 == 0, F.concat(F.lit("moved"), i.cast("string"))).otherwise(F.col("locator")).alias("locator"), F.when(i % 3 == 0, "x").otherwise(F.col("context")).alias("context"), "trust", F.when(i % 19 == 0, F.col("family") + 1).otherwise(F.col("family")).alias("family"),
    )
    return D.release_diff(r.where("id % 13 <> 0"), n)


@query(
    "dup8_glossary_choice",
    """WITH e AS (SELECT p_name, p_partkey AS id, p_type FROM part), c AS (SELECT p_name, max(p_partkey) AS id FROM part WHERE p_size = 7 GROUP BY p_name)
SELECT e.p_name, arg_min(e.id, CASE WHEN e.id = c.id THEN -1 ELSE e.id END) AS active, count(*) AS entries, count(DISTINCT lower(p_type)) > 1 AS conflict FROM e LEFT JOIN c ON e.p_name = c.p_name GROUP BY e.p_name""",
)
def dup8(spark, sf):
    p = table(spark, sf, "part").select("p_name", F.col("p_partkey").alias("id"), "p_type", "p_size")
    return D.glossary_choice(p, p.where("p_size = 7").groupBy("p_name").agg(F.max("id").alias("id")), "p_name", ["id"], "p_type")


@query(
    "dup9_seen_keys",
    f"WITH {BLOCKS_SQL} SELECT doc_id, min(ord) AS ord, count(*) AS n FROM blocks GROUP BY doc_id, trim(regexp_replace(translate(lower(text), chr(160) || 'ё' || chr(173), ' е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))",
)
def dup9(spark, sf):
    return blocks(spark, sf).groupBy("doc_id", normalised("text").alias("k")).agg(F.min("ord").alias("ord"), F.count("*").alias("n")).drop("k")


@query(
    "dup10_revision_families",
    """WITH RECURSIVE o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS before FROM orders),
w(id, root) AS (SELECT id, id FROM o WHERE before IS NULL UNION ALL SELECT o.id, w.root FROM o JOIN w ON o.before = w.id)
SELECT root, count(*) AS revisions, count(*) FILTER (id % 3 = 0) AS selected, count(*) FILTER (id % 3 = 0) <> 1 AS conflict FROM w GROUP BY root""",
)
def dup10(spark, sf):
    before = F.when(F.col("o_orderkey") % 4 != 0, F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    r = D.revision_roots(table(spark, sf, "orders").select("o_orderkey", before.alias("before")), "o_orderkey", "before")
    chosen = F.count_if(F.col("node") % 3 == 0)
    return r.groupBy("root").agg(F.count("*").alias("revisions"), chosen.alias("selected"), (chosen != 1).alias("conflict"))
