"""Queries over applicability, inheritance and access (APP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework.operators import rules as R
from clausework.plans.registry import query
from clausework.sources.tables import table

RULE = {"all_of": [{"any_of": [{"fact": "segment", "in": ["BUILDING", "MACHINERY"]}, {"fact": "nation", "in": [1, 2, 3]}]}, {"not": {"fact": "balance", "in": ["debt"]}}, {"any_of": [{"fact": "nation", "in": [3, 4]}, {"unknown": "size"}, {"fact": "segment", "in": ["BUILDING"]}]}]}
#: Facts of customers: the segment is unknown for every seventh, the nation for every fifth.
FACTS_SQL = """f AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nat,
  CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS bal FROM customer),
s AS (SELECT *, (seg IN ('BUILDING', 'MACHINERY') OR nat IN (1, 2, 3)) AND NOT (bal IN ('debt')) AND (nat IN (3, 4) OR NULL::BOOLEAN OR seg IN ('BUILDING')) AS state FROM f)"""


def facts(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("nation"),
        F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("balance"),
    )


def plain_fact(name, values):
    return F.col(name).isin(*values)


@query("app1_three_valued_rule", f"WITH {FACTS_SQL} SELECT c_custkey, CASE WHEN state IS NULL THEN 'unknown' WHEN state THEN 'applicable' ELSE 'not_applicable' END AS state FROM s")
def app1(spark, sf):
    return facts(spark, sf).select("c_custkey", R.state_label(R.compile_rule(RULE, plain_fact)).alias("state"))


@query(
    "app2_evidenced_facts",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN quality = 1 OR toxic = 1 THEN 'applicable' WHEN l.doc_id % 3 = 0 THEN 'not_applicable' ELSE 'unknown' END AS state
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def app2(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("values"), (F.col("doc_id") % 3 == 0).alias("complete"), F.lit(1).alias("evidence"))
    j = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return j.select("doc_id", R.state_label(R.fact_predicate(F.col("values"), F.col("complete"), F.col("evidence"), ["good", "toxic"])).alias("state"))


@query(
    "app3_missing_reasons",
    f"""WITH {FACTS_SQL}, t AS (SELECT *, seg IN ('BUILDING', 'MACHINERY') OR nat IN (1, 2, 3) AS a, NOT (bal IN ('debt')) AS b, nat IN (3, 4) OR NULL::BOOLEAN OR seg IN ('BUILDING') AS c FROM s),
m AS (SELECT *, list_concat(CASE WHEN seg IS NULL THEN ['segment'] ELSE [] END, CASE WHEN nat IS NULL THEN ['nation'] ELSE [] END) AS unk FROM t)
SELECT c_custkey, array_to_string(list_sort(CASE WHEN a = false OR b = false OR c = false THEN [] ELSE
  list_distinct(list_concat(CASE WHEN a THEN [] ELSE unk END, CASE WHEN c THEN [] ELSE list_concat(['unknown'], unk) END)) END), ',') AS missing FROM m""",
)
def app3(spark, sf):
    gone = lambda n: F.when(F.col(n).isNull(), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    _, missing = R.trace_rule(RULE, plain_fact, gone)
    return facts(spark, sf).select("c_custkey", F.array_join(F.array_sort(missing), ",").alias("missing"))


def tree(spark, sf):
    """Edges customer to nation to region, as text keys, with a cycle between two regions."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = table(spark, sf, "region").where("r_regionkey in (0, 1)").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.concat(F.lit("r"), (1 - F.col("r_regionkey")).cast("string")).alias("parent"))
    return c.unionByName(n).unionByName(r)


TREE_SQL = """e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'r' || (1 - r_regionkey) FROM region WHERE r_regionkey IN (0, 1)),
w(node, ancestor, distance, path, cycle) AS (SELECT k, k, 0, [k], false FROM (SELECT child AS k FROM e UNION SELECT parent FROM e)
  UNION ALL SELECT node, parent, distance + 1, list_append(path, parent), list_contains(path, parent) FROM w JOIN e ON ancestor = child WHERE NOT cycle),
closure AS (SELECT node, ancestor, min(distance) AS distance, ancestor IN (SELECT node FROM w WHERE distance > 0 AND node = ancestor) AS cycle FROM w GROUP BY ALL)"""


@query("app4_inheritance_closure", f"WITH RECURSIVE {TREE_SQL} SELECT * FROM closure")
def app4(spark, sf):
    return R.closure(tree(spark, sf))


@query(
    "app4_rejected_profiles",
    """WITH RECURSIVE e AS (SELECT s_suppkey AS child, CASE WHEN s_suppkey % 29 = 0 THEN s_suppkey + 1 WHEN s_suppkey % 41 = 0 THEN -s_suppkey ELSE s_suppkey - 1 - s_suppkey % 3 END AS parent FROM supplier WHERE s_suppkey % 17 > 1),
w(node, ancestor, distance, path, cycle) AS (SELECT s_suppkey, s_suppkey, 0, [s_suppkey], false FROM supplier
  UNION ALL SELECT node, parent, distance + 1, list_append(path, parent), list_contains(path, parent) FROM w JOIN e ON ancestor = child WHERE NOT cycle),
c AS (SELECT node, ancestor, min(distance) AS distance FROM w GROUP BY ALL), l AS (SELECT DISTINCT node FROM w WHERE distance > 0 AND node = ancestor),
r AS (SELECT node, list_filter([CASE WHEN bool_or(ancestor IN (SELECT node FROM l)) THEN 'cycle' END, CASE WHEN max(distance) > 5 THEN 'depth' END, CASE WHEN bool_or(ancestor NOT IN (SELECT s_suppkey FROM supplier)) THEN 'unknown' END], lambda x: x IS NOT NULL) AS problems FROM c GROUP BY node)
SELECT node, array_to_string(problems, ',') AS problems FROM r WHERE len(problems) > 0""",
)
def app4_rejected(spark, sf):
    """Suppliers in chains of inheritance, some of which loop, name unknown parents or run deeper than five steps."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("node"))
    k = F.col("node")
    parent = F.when(k % 29 == 0, k + 1).when(k % 41 == 0, -k).otherwise(k - 1 - k % 3)
    edges = s.where(k % 17 > 1).select(k.alias("child"), parent.alias("parent"))
    return R.rejected(s, edges, depth=5).select("node", F.array_join("problems", ",").alias("problems"))


@query(
    "app5_any_facet",
    """WITH p AS (SELECT s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal > 5000 AND s_suppkey % 3 <> 0 END AS state FROM supplier)
SELECT s_nationkey, CASE WHEN bool_or(coalesce(state, false)) THEN true WHEN count(*) FILTER (state IS NULL) > 0 THEN NULL ELSE false END AS state, count(*) AS paths FROM p GROUP BY s_nationkey""",
)
def app5(spark, sf):
    state = F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_acctbal") > 5000) & (F.col("s_suppkey") % 3 != 0))
    return R.any_applies(table(spark, sf, "supplier").select("s_nationkey", state.alias("state")), ["s_nationkey"], "state")


@query(
    "app6_obligation_ledger",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, c_nationkey, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'open' END, CASE WHEN c_acctbal < 0 THEN 'debt' END,
  CASE WHEN c_custkey IS NULL THEN 'no customer' END, CASE WHEN l_discount > 0.08 THEN 'discount' END], lambda x: x IS NOT NULL), ',') AS issues
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def app6(spark, sf):
    l, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    found = R.issues(("open", F.coalesce(F.col("o_orderstatus") != "F", F.lit(False))), ("debt", F.coalesce(F.col("c_acctbal") < 0, F.lit(False))), ("no customer", F.col("c_custkey").isNull()), ("discount", F.col("l_discount") > 0.08))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "c_nationkey", F.array_join(found, ",").alias("issues"))


@query(
    "app7_local_refinement",
    """WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus <> 'P' END AS state, o_totalprice::BIGINT AS hash FROM orders),
c AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_linestatus = 'F' AND coalesce(l_discount > 0.05, false)) AS off, min(CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE o_totalprice::BIGINT END) AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)
SELECT id, CASE WHEN coalesce(off, false) AND NOT coalesce(h <> hash, false) THEN false ELSE state END AS state, coalesce(h <> hash, false) AS parent_changed FROM p LEFT JOIN c ON id = l_orderkey""",
)
def app7(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cents = F.bround(F.col("o_totalprice"), 0).cast("long")
    parents = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus") != "P").alias("state"), cents.alias("hash"))
    children = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("parent_id"), (F.col("l_returnflag") == "R").alias("approved"), (F.col("l_linestatus") == "F").alias("current"), (F.col("l_discount") > 0.05).alias("holds"),
        F.when(F.col("l_partkey") % 13 == 0, -1).otherwise(cents).alias("parent_hash"),
    )
    return R.refine(parents, children)


@query(
    "app8_candidate_gating",
    """WITH r AS (SELECT doc_id, list_filter([CASE WHEN quality = 0 THEN 'ambiguous' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN length(text) < 200 THEN 'short' END], lambda x: x IS NOT NULL) AS reasons FROM labels JOIN documents USING (doc_id))
SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(list_filter(reasons, lambda x: x NOT IN ('ambiguous', 'short'))) = 0 AS usable FROM r""",
)
def app8(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    reasons = R.issues(("ambiguous", F.col("quality") == 0), ("toxic", F.col("toxic") == 1), ("short", F.length("text") < 200))
    usable = F.size(F.array_except(reasons, F.array(F.lit("ambiguous"), F.lit("short")))) == 0
    return j.select("doc_id", F.array_join(reasons, ",").alias("reasons"), usable.alias("usable"))


@query("app9_scope_notices", "SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS rows, min(l_orderkey) AS first FROM lineitem WHERE l_discount = 0 GROUP BY ALL")
def app9(spark, sf):
    """One notice per (document, release, proof), with the rows it stands for."""
    out = table(spark, sf, "lineitem").where("l_discount = 0")
    return out.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.min("l_orderkey").alias("first"))


@query(
    "app10_hierarchical_access",
    f"""WITH RECURSIVE {TREE_SQL}, u AS (SELECT s_suppkey AS usr, CASE s_suppkey % 11 WHEN 0 THEN 'staff' WHEN 1 THEN 'expert' ELSE 'plain' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN 'r' || (s_suppkey % 5) ELSE 'n' || s_nationkey END AS scope, ['owner', 'editor', 'reader'][(s_suppkey % 3 + 1)::INT] AS role FROM supplier),
r(role, permission) AS (VALUES ('owner', 'edit'), ('owner', 'read'), ('editor', 'comment'), ('editor', 'read'), ('reader', 'read')),
a AS (SELECT DISTINCT l_suppkey AS usr, 'c' || o_custkey AS node, CASE WHEN o_custkey % 2 = 0 THEN l_suppkey END AS owner FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT a.usr, a.node, a.owner, any_value(kind) AS kind, CASE any_value(kind) WHEN 'staff' THEN ['comment', 'edit', 'read'] ELSE list_sort(list_distinct(list_concat(coalesce(list(permission) FILTER (permission IS NOT NULL), []), CASE any_value(kind) WHEN 'expert' THEN ['read'] ELSE [] END))) END AS p
  FROM a LEFT JOIN u ON a.usr = u.usr LEFT JOIN closure ON closure.node = a.node AND closure.ancestor = u.scope LEFT JOIN r ON closure.node IS NOT NULL AND r.role = u.role GROUP BY ALL)
SELECT usr AS "user", node, array_to_string(p, ',') AS permissions, coalesce(kind = 'staff' OR list_contains(p, 'edit') OR coalesce(owner = usr, false), false) AS visible FROM p""",
)
def app10(spark, sf):
    """Suppliers ask for the customers they deliver to; roles are granted on nations and regions."""
    pick = F.element_at(F.array(F.lit("owner"), F.lit("editor"), F.lit("reader")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    scope = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string"))).otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user"), scope.alias("scope"), pick.alias("role"), F.when(F.col("s_suppkey") % 11 == 0, "staff").when(F.col("s_suppkey") % 11 == 1, "expert").otherwise("plain").alias("kind"))
    roles = spark.sql("SELECT * FROM VALUES ('owner', 'edit'), ('owner', 'read'), ('editor', 'comment'), ('editor', 'read'), ('reader', 'read') AS r(role, permission)")
    pairs = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("user"), "o_custkey").distinct()
    asked = pairs.select("user", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.when(F.col("o_custkey") % 2 == 0, F.col("user")).alias("owner"))
    return R.accessible(asked, s.select("user", "kind"), s.select("user", "scope", "role"), R.closure(tree(spark, sf)), roles, ["comment", "edit", "read"])


@query(
    "app11_disabled_overlay",
    f"""WITH RECURSIVE {TREE_SQL}, d AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_name = 'ASIA')
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM closure JOIN d ON ancestor = d.node WHERE closure.node = 'c' || c_custkey)""",
)
def app11(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    r = table(spark, sf, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    items = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return R.without_disabled(items, "node", n.unionByName(r), R.closure(tree(spark, sf))).select("c_custkey")


@query("udf2_joined_verifier", "SELECT c_custkey, coalesce(doc_id IS NOT NULL, false) AS verified, coalesce(quality = 1, false) AS granted FROM customer LEFT JOIN labels ON c_custkey = doc_id")
def udf2(spark, sf):
    """Verification and grants as tables to join, not as callbacks for each row."""
    verified = table(spark, sf, "labels").select(F.col("doc_id").alias("_doc"), F.col("quality").alias("_quality"))
    j = table(spark, sf, "customer").join(verified, F.col("c_custkey") == F.col("_doc"), "left")
    return j.select("c_custkey", F.col("_doc").isNotNull().alias("verified"), F.coalesce(F.col("_quality") == 1, F.lit(False)).alias("granted"))
