"""Queries over quotes, provenance, coverage and validation (EXT)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.operators import extract as X
from clausework.operators.rules import issues
from clausework.operators.texts import nfkc_fold
from clausework.plans.registry import query
from clausework.plans.src import BLOCKS_SQL, blocks
from clausework.sources.tables import table


def quotes(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))


@query(
    "ext1_inherited_modality",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, CASE left(o_orderpriority, 1) WHEN '1' THEN 'parent' WHEN '2' THEN 'plain' ELSE 'item' END AS kind, o_orderstatus AS m FROM orders),
l AS (SELECT *, max(pos) FILTER (kind <> 'item') OVER (PARTITION BY o_custkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS at FROM o)
SELECT l.o_orderkey, CASE WHEN l.kind = 'parent' THEN l.m WHEN l.kind = 'item' AND p.kind = 'parent' THEN p.m END AS inherited FROM l LEFT JOIN o p ON p.o_custkey = l.o_custkey AND p.pos = l."at" """,
)
def ext1(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    o = table(spark, sf, "orders").withColumn("kind", F.when(first == "1", "parent").when(first == "2", "plain").otherwise("item"))
    return X.inherited_modality(o, "o_custkey", ["o_orderdate", "o_orderkey"], "kind", "o_orderstatus").select("o_orderkey", "inherited")


#: Fixed patterns of the query.
CUES = [("prohibited", r"\b(?:must not|shall not|may not)\b"), ("mandatory", r"\b(?:must|shall)\b"), ("recommended", r"\bshould\b"), ("permitted", r"\bmay\b")]
ITEM, CONDITION, EXCEPTION, FIELDS = r"^\s*[-–•]", r"(?i)\bif\b", r"(?i)\bunless\b", r"(?i)(?:column|field|parameter)[^:]*:"
ANY_CUE = "|".join(f"(?:{p})" for _, p in CUES)


def sentences_of_lines(spark, sf):
    """Order lines as blocks: lead-ins of lists, list items with and without a cue, sentences of several scopes, plain text."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    p, n, k = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_partkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("The supplier "), n, F.lit(" must list, if asked:"))).when(k == 1, F.concat(F.lit("- part "), p))
        .when(k == 2, F.concat(F.lit("If late, the carrier shall must wait "), n, F.lit(" days. It may ask; Part "), p, F.lit(" must not leave, unless paid, but should be seen.")))
        .when(k == 3, F.concat(F.lit("- the form must have columns: «A"), p, F.lit("», «B»"))).when(k == 4, F.concat(F.lit("Part "), p, F.lit(" is here.")))
        .otherwise(F.concat(F.lit("  The clerk should sign. The clerk may, and must pay "), n, F.lit(" :")))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", place.alias("ord"), text.alias("text"))


LINES_SQL = """b AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, CASE l_partkey % 6 WHEN 0 THEN 'The supplier ' || l_suppkey || ' must list, if asked:' WHEN 1 THEN '- part ' || l_partkey
  WHEN 2 THEN 'If late, the carrier shall must wait ' || l_suppkey || ' days. It may ask; Part ' || l_partkey || ' must not leave, unless paid, but should be seen.' WHEN 3 THEN '- the form must have columns: «A' || l_partkey || '», «B»' WHEN 4 THEN 'Part ' || l_partkey || ' is here.'
  ELSE '  The clerk should sign. The clerk may, and must pay ' || l_suppkey || ' :' END AS t FROM lineitem)"""
SCOPES_SQL = rf"""p AS (SELECT doc, ord, string_split(regexp_replace(t, '([.;!?])(\s+[\p{{Lu}}–—-])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM b), u AS (SELECT doc, ord, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS n FROM p),
e AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc, ord ORDER BY n ROWS UNBOUNDED PRECEDING)::INT AS z, regexp_replace(raw, '^\s+', '') AS s FROM u),
m AS (SELECT doc, ord, n, z - length(s) AS f, z, s, string_split(regexp_replace(s, '(?i)({ANY_CUE})', chr(1) || '\1', 'g'), chr(1)) AS q FROM e), v AS (SELECT * EXCLUDE (q), unnest(q) AS piece, generate_subscripts(q, 1) - 1 AS i FROM m),
w AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc, ord, n ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) AS off, regexp_extract(piece, '(?i)^({ANY_CUE})', 1) AS act FROM v),
k AS (SELECT *, substr(piece, length(act) + 1) AS rest, CASE {" ".join(f"WHEN regexp_matches(act, '(?i)^(?:{p})$') THEN '{name}'" for name, p in CUES)} END AS modality FROM w WHERE i > 0),
g AS (SELECT *, CASE WHEN lag(modality) OVER x = modality AND trim(lag(rest) OVER x) = '' THEN 0 ELSE 1 END AS fresh FROM k WINDOW x AS (PARTITION BY doc, ord, n ORDER BY i)), h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, ord, n ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM g),
sc AS (SELECT doc, ord, n, f, z, s, c, min(off) AS off, arg_min(act, i) AS act, arg_min(modality, i) AS modality, string_agg(piece, '' ORDER BY i) AS whole FROM h GROUP BY ALL),
own AS (SELECT doc, ord, (f + CASE WHEN c = 1 THEN 0 ELSE off END)::INT AS start, coalesce(f + lead(off) OVER (PARTITION BY doc, ord, n ORDER BY c), z)::INT AS "end", coalesce(nullif(regexp_replace(substr(s, 1, off::INT), '^[\s,:]+|[\s,:]+$', '', 'g'), ''), 'document_author') AS subject, act AS action,
  coalesce(nullif(regexp_replace(substr(whole, length(act) + 1), '^\s+|\s+$', '', 'g'), ''), s) AS object, modality FROM sc),
bm AS (SELECT doc, ord, CASE WHEN count(DISTINCT modality) = 1 THEN min(modality) ELSE 'mixed' END AS m FROM own GROUP BY ALL),
fa AS (SELECT b.doc, b.ord, t, regexp_matches(t, '{ITEM}') AS item, m, m IS NOT NULL AND regexp_matches(t, ':\s*$') AS opens, regexp_matches(t, '{CONDITION}') AS cond, regexp_matches(t, '{EXCEPTION}') AS exc FROM b LEFT JOIN bm USING (doc, ord)),
la AS (SELECT *, max(ord) FILTER (NOT item) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM fa),
cx AS (SELECT l.doc, l.ord, l.t, l.m, p.ord AS parent, p.m AS pm, list_filter([CASE WHEN l.cond THEN l.ord END, CASE WHEN p.cond THEN p.ord END], lambda x: x IS NOT NULL) AS conditions, list_filter([CASE WHEN l.exc THEN l.ord END, CASE WHEN p.exc THEN p.ord END], lambda x: x IS NOT NULL) AS exceptions
  FROM la l LEFT JOIN fa p ON l.item AND p.doc = l.doc AND p.ord = l.prev AND p.opens),
ev AS (SELECT * FROM own UNION ALL SELECT doc, ord, 0, length(t)::INT, 'document_author', 'include_item', t, pm FROM cx WHERE parent IS NOT NULL AND m IS NULL),
nm AS (SELECT *, CASE WHEN regexp_matches(object, '{FIELDS}') AND len(regexp_extract_all(object, '«([^»]+)»', 1)) > 1 THEN regexp_extract_all(object, '«([^»]+)»', 1) END AS names FROM ev),
ro AS (SELECT doc, ord, start, "end", subject, CASE WHEN names IS NULL THEN action ELSE 'include_field' END AS action, unnest(coalesce(names, [object])) AS object, modality, CASE WHEN names IS NOT NULL THEN 'required_fields' END AS "group" FROM nm)
SELECT ro.doc AS l_orderkey, ro.ord, start, "end", subject, action, object, modality, array_to_string(conditions, ',') AS conditions, array_to_string(exceptions, ',') AS exceptions, parent, "group" FROM ro JOIN cx USING (doc, ord)"""


@query("ext1_modal_scopes", f"WITH {LINES_SQL}, {SCOPES_SQL}")
def ext1_scopes(spark, sf):
    s = X.modal_scopes(sentences_of_lines(spark, sf), "l_orderkey", "ord", "text", CUES, ITEM, CONDITION, EXCEPTION, FIELDS)
    return s.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("conditions", "exceptions")})


@query(
    "ext2_list_members",
    """WITH r AS (SELECT l_orderkey, 'Order ' || l_orderkey || ' must hold: ' || string_agg('part ' || l_partkey, '; ' ORDER BY l_partkey, l_suppkey) AS t, list('part ' || l_partkey ORDER BY l_partkey, l_suppkey) AS m FROM lineitem GROUP BY l_orderkey),
u AS (SELECT l_orderkey, CASE WHEN len(m) > 1 THEN list_transform(m, lambda x: 'Order ' || l_orderkey || ' must hold: ' || x) ELSE [t] END AS u FROM r),
v AS (SELECT l_orderkey, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS n FROM u) SELECT l_orderkey, n, unit, left(sha256(unit), 16) AS unit_id FROM v""",
)
def ext2(spark, sf):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))), lambda x: F.concat(F.lit("part "), x.l_partkey.cast("string")))
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(parts, "; ").alias("m"))
    r = r.select("l_orderkey", F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" must hold: "), "m").alias("rule"))
    return X.split_members(r, "l_orderkey", "rule")


EXAMPLE, ONE_LINE, ENDS = "^(The|Der|La) ", r"^(The|Der|La) [\p{L}]+ [\p{L}]+[.]?$", "[$]{3}"


@query(
    "ext3_catalogue_groups",
    rf"""WITH RECURSIVE {BLOCKS_SQL}, v AS (SELECT doc_id, ord, length(text) AS n, {{'a': contains(text, '!!'), 'c': ord // 40, 'h': nullif(contains(text, ' | '), false)}} AS k, regexp_matches(text, '{EXAMPLE}') AS st, regexp_matches(text, '{ONE_LINE}') AS alone,
  regexp_matches(text, '{ENDS}') AS en, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS seq FROM blocks),
w AS (SELECT doc_id, ord, seq, k, 0 AS grp, n AS used, 0 AS segment, st AS example, st AND alone AS only_, st AND NOT alone AS inside FROM v WHERE seq = 1
  UNION ALL SELECT doc_id, ord, seq, k, CASE WHEN fresh THEN grp + 1 ELSE grp END, CASE WHEN fresh THEN n ELSE used + n END, CASE WHEN fresh THEN 0 WHEN st OR flag <> example OR only_ THEN segment + 1 ELSE segment END, flag, st AND alone, flag AND NOT (st AND alone)
  FROM (SELECT v.doc_id, v.ord, v.seq, v.k, v.n, v.st, v.alone, w.grp, w.used, w.segment, w.example, w.only_, v.k IS DISTINCT FROM w.k OR w.used > 5000 AS fresh, v.st OR (w.inside AND v.k IS NOT DISTINCT FROM w.k AND NOT v.en) AS flag
    FROM w JOIN v ON v.doc_id = w.doc_id AND v.seq = w.seq + 1))
SELECT doc_id, ord, grp AS "group", segment, example FROM w""",
)
def ext3(spark, sf):
    """Appendix: a shouting block; clause: forty blocks; heading: a table row or none."""
    b = blocks(spark, sf).select("doc_id", "ord", "text", F.contains("text", F.lit("!!")).alias("appendix"), F.floor(F.col("ord") / 40).alias("clause"), F.when(F.contains("text", F.lit(" | ")), True).alias("heading"))
    return X.catalogue_groups(b, "doc_id", "ord", ["appendix", "clause", "heading"], EXAMPLE, ONE_LINE, ENDS)


CITED_SQL = """c AS (SELECT item_id, doc_id, (strpos(d.text, b.text) - 1)::INT AS s, (strpos(d.text, b.text) - 1 + length(b.text))::INT AS e, CASE WHEN doc_id % 4 = 0 THEN 'x' || b.text ELSE b.text END AS quote,
  CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(d.text) END AS sha, CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS source FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


@query(
    "ext4_quote_provenance",
    f"""WITH {CITED_SQL} SELECT item_id, c.source, s AS start, array_to_string(list_filter([CASE WHEN d.doc_id IS NULL THEN 'source' END, CASE WHEN d.doc_id IS NOT NULL AND sha256(d.text) <> sha THEN 'changed' END,
  CASE WHEN d.doc_id IS NOT NULL AND substr(d.text, s + 1, e - s) <> quote THEN 'quote' END], lambda x: x IS NOT NULL), ',') AS errors FROM c LEFT JOIN documents d ON c.source = d.doc_id""",
)
def ext4(spark, sf):
    d = table(spark, sf, "documents").withColumn("sha", F.sha2("text", 256))
    c = X.find_quotes(quotes(spark, sf), d, "item_id", "doc_id").join(quotes(spark, sf), "item_id").join(d.select("doc_id", "sha"), "doc_id")
    c = c.select("item_id", "start", "end", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), F.col("quote"))).otherwise(F.col("quote")).alias("quote"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha")).alias("source_sha"), F.when(F.col("doc_id") % 7 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"))
    return X.provenance_errors(c, d, "doc_id").select("item_id", F.col("doc_id").alias("source"), "start", F.array_join("errors", ",").alias("errors"))


@query(
    "ext5_quote_recovery",
    r"""WITH q AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN replace(text, ' ', '  ') ELSE text END AS quote, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS flat FROM benchmark),
d AS (SELECT doc_id, text, regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g') AS flat FROM documents)
SELECT item_id, doc_id, CASE WHEN contains(text, quote) THEN 'exact' ELSE 'recovered' END AS state FROM q JOIN d ON contains(d.flat, q.flat) WHERE contains(text, quote) OR (length(d.flat) - length(replace(d.flat, q.flat, ''))) / length(q.flat) = 1""",
)
def ext5(spark, sf):
    q = quotes(spark, sf).withColumn("quote", F.when(F.col("item_id") % 2 == 0, F.replace("quote", F.lit(" "), F.lit("  "))).otherwise(F.col("quote")))
    return X.recover_quotes(q, table(spark, sf, "documents"), "item_id", "doc_id")


@query(
    "ext6_evidence_hydration",
    f"""WITH {BLOCKS_SQL}, e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 1200 AS doc_id, (l_suppkey % 12) AS ord, CASE WHEN l_suppkey % 3 = 0 THEN 'given' END AS quote FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, e.doc_id, e.ord, length(coalesce(quote, text)) AS n, quote IS NULL AND text IS NULL AS missing FROM e LEFT JOIN blocks b ON e.doc_id = b.doc_id AND e.ord = b.ord""",
)
def ext6(spark, sf):
    """Evidence that names only a block takes its text; what is found nowhere is marked."""
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 1200).alias("doc_id"), (F.col("l_suppkey") % 12).cast("int").alias("ord"), F.when(F.col("l_suppkey") % 3 == 0, "given").alias("quote"))
    j = e.join(blocks(spark, sf).select("doc_id", "ord", "text"), ["doc_id", "ord"], "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "doc_id", "ord", F.length(F.coalesce("quote", "text")).alias("n"), (F.col("quote").isNull() & F.col("text").isNull()).alias("missing"))


@query(
    "ext7_completeness_screen",
    """WITH c AS (SELECT l_orderkey, l_partkey % 200 AS pos FROM lineitem WHERE l_returnflag <> 'N'), s AS (SELECT l_orderkey, l_suppkey % 200 AS s, l_suppkey % 200 + 40 AS e FROM lineitem WHERE l_returnflag = 'N')
SELECT l_orderkey, pos FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = c.l_orderkey AND pos >= s AND pos < e)""",
)
def ext7(spark, sf):
    l = table(spark, sf, "lineitem")
    cues = l.where("l_returnflag <> 'N'").select("l_orderkey", (F.col("l_partkey") % 200).alias("pos"))
    spans = l.where("l_returnflag = 'N'").select("l_orderkey", (F.col("l_suppkey") % 200).alias("start"), (F.col("l_suppkey") % 200 + 40).alias("end"))
    return X.uncovered(cues, spans, "l_orderkey")


@query(
    "ext7_completeness_verdicts",
    """WITH c AS (SELECT l_orderkey AS id, l_partkey % 200 AS pos FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey % 5 = 0), s AS (SELECT l_orderkey AS id, l_suppkey % 200 AS s, l_suppkey % 200 + 90 AS e FROM lineitem WHERE l_returnflag = 'N'),
u AS (SELECT id, list(pos ORDER BY pos) AS miss FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = c.id AND pos >= s AND pos < e) GROUP BY id), d AS (SELECT l_orderkey AS id, bool_or(l_discount = 0 AND l_tax < 0.02) AS open FROM lineitem GROUP BY l_orderkey), n AS (SELECT l_orderkey AS id, count(*) FILTER (l_linenumber = 1) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS id, coalesce(miss, []) AS miss, coalesce(open, false) AS open, coalesce(n, 0) AS n, o_custkey % 4 > 0 AS explicit, ['mandatory', 'permitted', 'mixed'][(o_custkey % 3 + 1)::INT] AS modality, list_sort(list_filter([CASE WHEN coalesce(len(miss), 0) > 0 THEN 'uncovered_normative_cues' END, CASE WHEN coalesce(n, 0) = 0 THEN 'no_obligations' END,
  CASE WHEN open THEN 'unresolved_dependency' END, CASE WHEN o_orderkey % 7 = 0 THEN 'complex_syntax_needs_semantic_validation' END, CASE WHEN o_orderstatus = 'P' THEN 'example_not_a_general_rule' END, CASE WHEN o_orderkey % 23 = 0 THEN 'definition_not_an_obligation' END, CASE WHEN o_orderkey % 19 = 0 THEN 'condition_needs_interpretation' END,
  CASE WHEN o_orderkey % 29 = 0 THEN 'two_readings' END], lambda x: x IS NOT NULL)) AS reasons FROM orders LEFT JOIN u ON u.id = o_orderkey LEFT JOIN d ON d.id = o_orderkey LEFT JOIN n ON n.id = o_orderkey)
SELECT id, CASE WHEN len(miss) = 0 AND NOT open THEN 'complete' ELSE 'incomplete' END AS structural, CASE WHEN len(reasons) = 0 AND n = 1 AND explicit AND modality <> 'mixed' THEN 'verified_simple' ELSE 'unknown' END AS semantic, array_to_string(miss, ',') AS uncovered, array_to_string(reasons, ',') AS reasons FROM r""",
)
def ext7_verdicts(spark, sf):
    """Orders as cards, their lines as cues, obligations and dependencies."""
    l, o, k = table(spark, sf, "lineitem"), table(spark, sf, "orders"), F.col("o_orderkey")
    spans = l.where("l_returnflag = 'N'")
    held = spans.groupBy(F.col("l_orderkey").alias("_id")).agg(F.count_if(F.col("l_linenumber") == 1).alias("obligations"))
    cards = o.join(held, k == F.col("_id"), "left").select(
        k.alias("id"), F.when(k % 7 == 0, "this, and that").otherwise("this").alias("text"), "obligations", (F.col("o_custkey") % 4 > 0).alias("explicit"), F.element_at(F.array(*map(F.lit, ("mandatory", "permitted", "mixed"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("modality"),
        (F.col("o_orderstatus") == "P").alias("example"), (k % 23 == 0).alias("definition"), (k % 19 == 0).alias("unknown_condition"), F.when(k % 29 == 0, F.array(F.lit("two_readings"))).alias("ambiguities"),
    )
    cues = l.where("l_returnflag <> 'N' and l_partkey % 5 = 0").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 200).alias("pos"))
    covered = spans.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 200).alias("start"), (F.col("l_suppkey") % 200 + 90).alias("end"))
    needs = l.select(F.col("l_orderkey").alias("id"), (F.col("l_discount") == 0).alias("required"), (F.col("l_tax") < 0.02).alias("unresolved"))
    got = X.completeness_screen(cards, cues, covered, needs, "[,;]")
    return got.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("uncovered", "reasons")})


LEDGER_SQL = "g AS (SELECT CASE WHEN doc_id % 90 = 0 AND ord = 0 THEN -1 ELSE doc_id END AS doc_id, ord FROM blocks WHERE (doc_id + ord) % 50 <> 0 UNION ALL SELECT doc_id, ord FROM blocks WHERE (doc_id + ord) % 77 = 0)"


def ledger(b):
    moved = F.when((F.col("doc_id") % 90 == 0) & (F.col("ord") == 0), -1).otherwise(F.col("doc_id")).alias("doc_id")
    return b.where("(doc_id + ord) % 50 <> 0").select(moved, "ord").unionByName(b.where("(doc_id + ord) % 77 = 0").select("doc_id", "ord"))


@query(
    "ext8_coverage_audit",
    f"""WITH {BLOCKS_SQL}, {LEDGER_SQL}, n AS (SELECT doc_id, ord, count(*) AS n FROM g GROUP BY ALL)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(b.ord, n.ord) AS ord, CASE WHEN n.n IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'unknown' ELSE 'repeated' END AS problem
FROM blocks b FULL JOIN n ON b.doc_id = n.doc_id AND b.ord = n.ord WHERE n.n IS NULL OR b.doc_id IS NULL OR n.n > 1""",
)
def ext8(spark, sf):
    b = blocks(spark, sf).select("doc_id", "ord")
    return X.coverage_audit(b, ledger(b), ["doc_id", "ord"])


QUALITY_SQL = """SELECT d.doc_id, text, list_filter([CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END, CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN length(text) < 300 THEN 'short' END,
  CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '***') THEN 'symbols' END], lambda x: x IS NOT NULL) AS reasons FROM documents d LEFT JOIN labels l USING (doc_id)"""


def assessed(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known")), "doc_id", "left")
    has = lambda s: F.contains("text", F.lit(s))
    yes = lambda c: F.coalesce(c, F.lit(False))
    reasons = issues(("unlabelled", F.col("known").isNull()), ("poor", yes(F.col("quality") == 0)), ("toxic", yes(F.col("toxic") == 1)), ("short", F.length("text") < 300), ("shouting", has("!!")), ("table", has(" | ")), ("symbols", has("***")))
    return j.withColumn("reasons", reasons)


STATUS_SQL = "CASE WHEN len(reasons) = 0 THEN 'ready' WHEN list_contains(reasons, 'poor') OR list_contains(reasons, 'toxic') THEN 'reference' ELSE 'candidate' END"


def status():
    bad = F.array_contains("reasons", "poor") | F.array_contains("reasons", "toxic")
    return F.when(F.size("reasons") == 0, "ready").when(bad, "reference").otherwise("candidate")


@query("ext9_quality_assessment", f"WITH a AS ({QUALITY_SQL}) SELECT doc_id, array_to_string(reasons, ',') AS reasons, {STATUS_SQL} AS status FROM a")
def ext9(spark, sf):
    return assessed(spark, sf).select("doc_id", F.array_join("reasons", ",").alias("reasons"), status().alias("status"))


@query(
    "ext9_card_assessment",
    """WITH c AS (SELECT o_orderkey AS id, o_custkey AS loc, CASE WHEN o_orderkey % 10 < 2 THEN ['definition', 'permission'][(o_orderkey % 2 + 1)::INT] ELSE 'requirement' END AS entity, o_orderkey % 31 > 0 AS prov, o_orderkey % 37 > 0 AS prof, o_orderkey % 3 = 0 AS approved, CASE WHEN o_orderkey % 17 > 0 THEN 'verified' ELSE 'unknown' END AS semantic,
  CASE WHEN o_orderkey % 41 = 0 THEN 'incomplete' ELSE 'complete' END AS structural, o_orderkey % 13 = 0 AS amb, o_orderkey % 14 = 0 AS cond, o_orderkey % 26 = 0 AS resolved, o_orderkey % 43 > 0 AS known, ['mandatory', 'prohibited', 'mandatory', 'mixed'][(o_custkey % 4 + 1)::INT] AS modality, o_custkey % 11 AS obl, o_custkey % 5 AS cnd,
  ['atom', 'all_of', 'any_of', 'not'][(o_orderkey % 4 + 1)::INT] AS op, o_custkey % 9 AS operands, CASE WHEN o_orderkey % 8 > 0 THEN o_totalprice / 300000 + 0.6 END AS confidence, CASE o_orderkey % 6 WHEN 0 THEN 'Approve the plan' WHEN 1 THEN 'If late, pay' WHEN 2 THEN 'Duties are set out in the annex' ELSE 'The clerk must pay' END AS quote FROM orders),
q AS (SELECT l_orderkey AS id, l_suppkey AS loc FROM lineitem UNION SELECT id, loc FROM c), d AS (SELECT l_orderkey AS id, l_discount < 0.05 AS req, l_tax = 0 AND l_linenumber = 2 AS unres, CASE WHEN l_linenumber = 3 THEN l_partkey ELSE l_suppkey END AS target FROM lineitem),
m AS (SELECT d.id, bool_or(unres) AS open, bool_or(req AND NOT unres AND q.id IS NULL) AS apart, bool_or(req AND NOT unres) AS held FROM d LEFT JOIN q ON q.id = d.id AND q.loc = d.target GROUP BY d.id), g AS (SELECT DISTINCT q.id FROM q WHERE loc % 71 = 0),
j AS (SELECT c.*, coalesce(open, false) AS open, coalesce(apart, false) AS apart, coalesce(held, false) AS held, g.id IS NOT NULL AS gap, entity = 'requirement' AS duty FROM c LEFT JOIN m USING (id) LEFT JOIN g USING (id)),
r AS (SELECT id, duty, list_filter([CASE WHEN NOT prov THEN 'provenance' END, CASE WHEN semantic <> 'verified' OR structural = 'incomplete' THEN 'incomplete' END, CASE WHEN amb AND NOT resolved THEN 'ambiguity' END, CASE WHEN cond AND NOT resolved THEN 'condition' END, CASE WHEN open THEN 'dependency' END, CASE WHEN apart THEN 'dependency_context' END,
  CASE WHEN gap AND NOT approved THEN 'source_gap' END, CASE WHEN NOT prof THEN 'profile' END, CASE WHEN duty AND starts_with(quote, 'Approve') THEN 'administrative_action' END, CASE WHEN duty AND starts_with(quote, 'If') AND cnd = 0 AND NOT held THEN 'implicit_context' END, CASE WHEN duty AND contains(quote, 'set out in the annex') THEN 'context_statement' END,
  CASE WHEN duty AND NOT known THEN 'applicability' END, CASE WHEN duty AND modality = 'mixed' THEN 'modality' END, CASE WHEN duty AND obl = 0 THEN 'no_obligation' END, CASE WHEN duty AND NOT (op = 'atom' OR op IN ('all_of', 'any_of') AND operands >= 2) THEN 'composition' END, CASE WHEN NOT approved AND NOT coalesce(confidence >= 0.9, false) THEN 'confidence' END], lambda x: x IS NOT NULL) AS reasons FROM j)
SELECT id, CASE WHEN len(reasons) > 0 THEN 'candidate' WHEN duty THEN 'ready' ELSE 'reference' END AS status, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') WHEN duty THEN '' ELSE 'reference' END AS reasons FROM r""",
)
def ext9_cards(spark, sf):
    """Orders as cards, their lines as citations and dependencies, some customers' and suppliers' places as gaps of the source."""
    o, l, k, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    cards = o.select(
        k.alias("id"), c.alias("locator"), F.when(k % 10 < 2, pick(k % 2, "definition", "permission")).otherwise("requirement").alias("entity"), (k % 31 > 0).alias("provenance"), (k % 37 > 0).alias("profile"), (k % 3 == 0).alias("approved"), F.when(k % 17 > 0, "verified").otherwise("unknown").alias("semantic"),
        F.when(k % 41 == 0, "incomplete").otherwise("complete").alias("structural"), (k % 13 == 0).alias("ambiguous"), (k % 14 == 0).alias("condition_open"), (k % 26 == 0).alias("resolved"), (k % 43 > 0).alias("applies_known"), pick(c % 4, "mandatory", "prohibited", "mandatory", "mixed").alias("modality"),
        (c % 11).alias("obligations"), (c % 5).alias("conditions"), pick(k % 4, "atom", "all_of", "any_of", "not").alias("operator"), (c % 9).alias("operands"), F.when(k % 8 > 0, F.col("o_totalprice") / 300000 + 0.6).alias("confidence"),
    )
    quote = F.when(k % 6 == 0, "Approve the plan").when(k % 6 == 1, "If late, pay").when(k % 6 == 2, "Duties are set out in the annex").otherwise("The clerk must pay")
    citations = o.select(k.alias("id"), c.alias("locator"), F.lit(0).alias("n"), quote.alias("quote")).unionByName(l.where("l_suppkey is not null").join(o.select(k.alias("_k"), c.alias("_c")), F.col("l_orderkey") == F.col("_k"), "left").where("_c is null or l_suppkey <> _c").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("locator"), F.lit(1).alias("n"), F.lit("seen").alias("quote")))
    needs = l.select(F.col("l_orderkey").alias("id"), (F.col("l_discount") < 0.05).alias("required"), ((F.col("l_tax") == 0) & (F.col("l_linenumber") == 2)).alias("unresolved"), F.when(F.col("l_linenumber") == 3, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("target"))
    gaps = citations.where("locator % 71 = 0").select("locator")
    got = X.quality_reasons(cards, citations, needs, gaps, "^Approve", "^If ", "set out in the annex")
    return got.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "ext10_duplicate_screen",
    f"""WITH a AS ({QUALITY_SQL}), s AS (SELECT doc_id, sha256(text) AS sha, {STATUS_SQL} AS status FROM a), f AS (SELECT *, status <> 'candidate' AS c, min(doc_id) OVER (PARTITION BY sha, status <> 'candidate') AS first FROM s)
SELECT doc_id, status, CASE WHEN c AND first <> doc_id THEN first END AS duplicate_of FROM f""",
)
def ext10(spark, sf):
    a = assessed(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha"), status().alias("status"))
    return X.screen(a, "doc_id", F.col("sha"), F.col("status") != "candidate").select("doc_id", "status", "duplicate_of")


@query(
    "ext11_matrix_completeness",
    """WITH e AS (SELECT c_custkey, p FROM customer, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) v(p)), g AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(e.p, g.p) AS p, coalesce(n, 0) AS n, c_custkey IS NOT NULL AS expected FROM e FULL JOIN g ON c_custkey = o_custkey AND e.p = g.p WHERE c_custkey IS NULL OR n IS NULL OR n <> 1""",
)
def ext11(spark, sf):
    units = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    e = table(spark, sf, "customer").select("c_custkey", F.explode(units).alias("p"))
    g = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("p"))
    return X.matrix_problems(e, g, ["c_custkey", "p"])


@query(
    "ext12_decision_validation",
    """WITH d AS (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS outcome, min(l_linestatus) AS claim, min(l_partkey) AS evidence FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN d.n IS NULL THEN 'none' END, CASE WHEN d.n > 1 THEN 'several' END, CASE WHEN d.n IS NOT NULL AND NOT (outcome || claim IN ('AF', 'NO', 'RF')) THEN 'illegal' END,
  CASE WHEN d.n IS NOT NULL AND p_partkey IS NULL THEN 'evidence' END], lambda x: x IS NOT NULL), ',') AS problems FROM orders LEFT JOIN d ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON evidence = p_partkey""",
)
def ext12(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("outcome"), F.min("l_linestatus").alias("claim"), F.min("l_partkey").alias("evidence"))
    j = table(spark, sf, "orders").join(d, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, sf, "part").where("p_size > 5").select("p_partkey"), F.col("evidence") == F.col("p_partkey"), "left")
    some = F.col("n").isNotNull()
    found = issues(("none", ~some), ("several", F.coalesce(F.col("n") > 1, F.lit(False))), ("illegal", some & ~F.concat("outcome", "claim").isin("AF", "NO", "RF") & some), ("evidence", some & F.col("p_partkey").isNull()))
    return j.select("o_orderkey", F.array_join(F.when(some, found).otherwise(F.array(F.lit("none"))), ",").alias("problems"))


@query(
    "ext13_scope_proof",
    f"""WITH {BLOCKS_SQL}, {LEDGER_SQL}, s AS (SELECT doc_id, ord // 8 AS section, count(*) AS n, sha256(string_agg(sha, '' ORDER BY ord)) AS fingerprint FROM blocks GROUP BY ALL),
m AS (SELECT doc_id, ord // 8 AS section, count(*) AS missing FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = b.doc_id AND g.ord = b.ord) GROUP BY ALL)
SELECT doc_id, section, n, fingerprint, coalesce(missing, 0) AS missing, missing IS NULL AS complete FROM s LEFT JOIN m USING (doc_id, section)""",
)
def ext13(spark, sf):
    b = blocks(spark, sf).withColumn("section", F.floor(F.col("ord") / 8)).select("doc_id", "ord", "section", "sha")
    missing = b.join(ledger(b).distinct(), ["doc_id", "ord"], "left_anti").groupBy("doc_id", "section").agg(F.count("*").alias("missing"))
    out = X.fingerprint(b, ["doc_id", "section"], "ord", "sha").join(missing, ["doc_id", "section"], "left")
    return out.withColumn("complete", F.col("missing").isNull()).withColumn("missing", F.coalesce("missing", F.lit(0)))


@query(
    "ext14_positive_evidence",
    """WITH e AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS expected, count(DISTINCT l_linenumber) FILTER (l_returnflag <> 'R') AS got FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, expected, got, CASE WHEN got = expected THEN 'supported' ELSE 'insufficient' END AS state FROM e""",
)
def ext14(spark, sf):
    """Each obligation of a rule needs its own checked outcome; otherwise the rule is downgraded."""
    e = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("e"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("g"))
    left = F.size(F.array_except("e", "g"))
    return e.select("l_orderkey", F.size("e").alias("expected"), F.size("g").alias("got"), F.when(left == 0, "supported").otherwise("insufficient").alias("state"))


@query(
    "ext15_span_runs",
    """WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM n)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM g GROUP BY l_orderkey, g""",
)
def ext15(spark, sf):
    runs = X.span_runs(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    return X.expand_runs(runs, "l_orderkey").groupBy("l_orderkey", "first", "last").agg(F.count("*").alias("n"))


@query("ext16_glossary_identity", "SELECT 'term|' || lower(p_name) AS identity, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY lower(p_name)")
def ext16(spark, sf):
    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.translate("p_name", "o", "ｏ"))  # full-width letters fold to plain ones
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("term|"), nfkc_fold(shown)).alias("identity"))
    return p.groupBy("identity").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(
    "ext17_locator_repair",
    f"""WITH {BLOCKS_SQL}, c AS (SELECT item_id, doc_id, CASE WHEN item_id % 2 = 0 THEN 'p1' ELSE 'p9999' END AS locator, trim(string_split(b.text, chr(10))[1]) AS q FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT item_id, c.doc_id, count(*) AS n, min(b.locator) AS place, bool_or(b.locator = c.locator) AS ok FROM c JOIN blocks b ON b.doc_id = c.doc_id AND contains(b.text, q) WHERE length(q) >= 12 GROUP BY ALL)
SELECT item_id, doc_id, CASE WHEN n = 1 AND NOT ok THEN place ELSE locator END AS repaired FROM c LEFT JOIN h USING (item_id, doc_id)""",
)
def ext17(spark, sf):
    found = X.find_quotes(quotes(spark, sf), table(spark, sf, "documents"), "item_id", "doc_id").join(quotes(spark, sf), "item_id")
    c = found.select(F.concat_ws("/", "item_id", "doc_id").alias("id"), "item_id", "doc_id", F.when(F.col("item_id") % 2 == 0, "p1").otherwise("p9999").alias("locator"), F.get(F.split("quote", "\n"), F.lit(0)).alias("quote"))
    return X.repair_locators(c, blocks(spark, sf), "doc_id", "locator", "text").select("item_id", "doc_id", "repaired")


@query(
    "ext18_exhaustive_cover",
    f"""WITH {BLOCKS_SQL}, {LEDGER_SQL}, e AS (SELECT doc_id, count(*) AS n, sha256(string_agg(ord, '' ORDER BY ord)) AS f FROM blocks GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS n, sha256(string_agg(ord, '' ORDER BY ord)) AS f FROM g GROUP BY doc_id)
SELECT e.doc_id, e.n, coalesce(e.f = h.f, false) AS reusable FROM e LEFT JOIN h USING (doc_id)""",
)
def ext18(spark, sf):
    b = blocks(spark, sf).select("doc_id", "ord")
    mark = lambda df: X.fingerprint(df.withColumn("d", F.col("ord").cast("string")), ["doc_id"], "ord", "d")
    got = mark(ledger(b)).select("doc_id", F.col("fingerprint").alias("got"))
    return mark(b).join(got, "doc_id", "left").select("doc_id", "n", F.coalesce(F.col("fingerprint") == F.col("got"), F.lit(False)).alias("reusable"))


@query(
    "ext19_source_identity",
    rf"""WITH {BLOCKS_SQL}, f AS (SELECT doc_id, min(ord) AS ord, arg_min(text, ord) AS text FROM blocks GROUP BY doc_id),
v AS (SELECT doc_id, 'short_title' AS field, lower(split_part(trim(text), ' ', 1)) AS value, text AS quote, ord FROM f UNION ALL SELECT doc_id, 'full_title', '  ' || text || '  ', CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END, ord FROM f
  UNION ALL SELECT doc_id, 'approved_by', CASE WHEN doc_id % 2 = 0 THEN 'nobody else' ELSE '' END, text, CASE WHEN doc_id % 3 = 0 THEN ord - 1 ELSE ord END FROM f WHERE doc_id % 7 <> 0),
j AS (SELECT v.doc_id AS source, field, trim(regexp_replace(value, '\s+', ' ', 'g')) AS value, coalesce(contains(b.text, quote) AND contains(lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))), lower(trim(regexp_replace(value, '\s+', ' ', 'g')))), false) AS good
  FROM v LEFT JOIN blocks b ON b.doc_id = v.doc_id AND b.ord = v.ord),
s AS (SELECT *, CASE WHEN value = '' THEN 'empty' WHEN good THEN 'identified' ELSE 'unverified' END AS state FROM j)
SELECT source, field, CASE WHEN state = 'identified' THEN value ELSE '' END AS value, state,
  CASE WHEN count(*) FILTER (field <> 'approved_by' AND state = 'identified') OVER w = 2 AND count(*) FILTER (state = 'unverified') OVER w = 0 THEN 'identified' ELSE 'needs_review' END AS status FROM s WINDOW w AS (PARTITION BY source)""",
)
def ext19(spark, sf):
    """Titles of documents from their first block; some quotes are altered, some locators wrong."""
    b = blocks(spark, sf).select(F.col("doc_id").alias("source"), F.col("ord").alias("locator"), "text")
    first = b.groupBy("source").agg(F.min("locator").alias("locator"), F.min_by("text", "locator").alias("text"))
    short = first.select("source", F.lit("short_title").alias("field"), F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("value"), "locator", F.col("text").alias("quote"))
    full = first.select("source", F.lit("full_title").alias("field"), F.concat(F.lit("  "), "text", F.lit("  ")).alias("value"), "locator", F.when(F.col("source") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("quote"))
    by = first.where("source % 7 <> 0").select("source", F.lit("approved_by").alias("field"), F.when(F.col("source") % 2 == 0, "nobody else").otherwise("").alias("value"), (F.col("locator") - F.when(F.col("source") % 3 == 0, 1).otherwise(0)).alias("locator"), F.col("text").alias("quote"))
    every = short.unionByName(full).unionByName(by)
    return X.identity_fields(every.select("source", "field", "value"), every.select("source", "field", F.lit(1).alias("n"), "locator", "quote"), b)


@query(
    "ext20_context_demotion",
    f"""WITH {BLOCKS_SQL}, c AS (SELECT doc_id AS id, doc_id // 8 AS batch, doc_id % 5 AS ord FROM documents),
d AS (SELECT id, batch, CASE WHEN id % 31 = 0 THEN 'odd' WHEN id % 4 < 3 THEN 'ready' ELSE 'candidate' END AS status FROM c WHERE id % 97 <> 0 UNION ALL SELECT id, batch, 'ready' FROM c WHERE id % 101 = 0),
e AS (SELECT id, c.ord + id % 4 AS ord, CASE WHEN id % 6 = 0 THEN 'zzz' ELSE left(text, 9) END AS quote FROM c JOIN blocks b ON b.doc_id = id AND b.ord = c.ord + id % 4 WHERE id % 9 <> 0),
w AS (SELECT c.batch, count(d.id) = count(DISTINCT c.id) AND count(DISTINCT d.id) = count(DISTINCT c.id) AS whole FROM c LEFT JOIN d ON d.id = c.id GROUP BY c.batch),
g AS (SELECT c.id, bool_and(abs(e.ord - c.ord) <= 2 AND coalesce(contains(b.text, e.quote), false)) AS good FROM e JOIN c USING (id) LEFT JOIN blocks b ON b.doc_id = e.id AND b.ord = e.ord GROUP BY c.id),
s AS (SELECT c.id, d.status, CASE WHEN NOT whole THEN 'incomplete' WHEN coalesce(d.status NOT IN ('ready', 'candidate'), true) THEN 'status' WHEN d.status = 'ready' AND NOT coalesce(good, false) THEN 'unsupported' END AS reason
  FROM c JOIN w USING (batch) LEFT JOIN (SELECT id, min(status) AS status FROM d GROUP BY id) d ON d.id = c.id LEFT JOIN g ON g.id = c.id)
SELECT id, CASE WHEN reason IS NULL THEN status ELSE 'candidate' END AS status, reason FROM s""",
)
def ext20(spark, sf):
    """One card a document, decided in batches of eight; some decisions are missing, doubled or odd, some quotes too far off or altered."""
    cards = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 8).alias("batch"), F.col("doc_id").alias("doc"), (F.col("doc_id") % 5).cast("int").alias("ord"))
    status = F.when(F.col("id") % 31 == 0, "odd").when(F.col("id") % 4 < 3, "ready").otherwise("candidate")
    decisions = cards.where("id % 97 <> 0").select("batch", "id", status.alias("status")).unionByName(cards.where("id % 101 = 0").select("batch", "id", F.lit("ready").alias("status")))
    b = blocks(spark, sf).select(F.col("doc_id").alias("doc"), F.col("ord").cast("int").alias("ord"), "text")
    far = cards.where("id % 9 <> 0").select("id", "doc", (F.col("ord") + F.col("id") % 4).cast("int").alias("ord"))
    evidence = far.join(b, ["doc", "ord"]).select("id", "doc", "ord", F.when(F.col("id") % 6 == 0, "zzz").otherwise(F.substring("text", 1, 9)).alias("quote"))
    return X.contextual_decisions(cards, decisions, evidence, b)
