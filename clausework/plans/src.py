"""Queries over blocks, outlines, chunks and tables (SRC)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.functions.text import content_id
from clausework.operators import blocks as B
from clausework.operators.packing import lossless_chunks, packets, section_packs
from clausework.plans.registry import query
from clausework.sources.tables import table

BLOCKS_SQL = r"""blocks AS (
  SELECT doc_id, ord, 'p' || (ord + 1) AS locator, text, sha256(text) AS sha, doc_sha
  FROM (SELECT doc_id, sha256(text) AS doc_sha, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)
  WHERE regexp_matches(text, '[^\x20\x09-\x0D]'))"""
#: Fixed patterns of the kinds.
KINDS = [("licence", "(?i)licen[sc]e"), ("symbols", "[#$%&*]{3}"), ("bars", r" \| "), ("shouting", "!! ")]


def greedy_sql(rows: str, limit: int, most: int | None = None) -> str:
    """Recursive CTE of greedy packing. ``rows`` gives key, seq (from 1 without gaps), n and chg; ``w`` has key, seq and g."""
    new = f"r.chg IS DISTINCT FROM w.chg OR w.used + r.n > {limit}" + (f" OR w.cnt >= {most}" if most else "")
    return f"""r AS ({rows}), w AS (SELECT key, seq, chg, 0 AS g, n AS used, 1 AS cnt FROM r WHERE seq = 1
  UNION ALL SELECT r.key, r.seq, r.chg, CASE WHEN {new} THEN g + 1 ELSE g END, CASE WHEN {new} THEN r.n ELSE used + r.n END, CASE WHEN {new} THEN 1 ELSE cnt + 1 END FROM w JOIN r ON r.key = w.key AND r.seq = w.seq + 1)"""


OUTLINE_SQL = """o AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(left(o_orderpriority, 1) AS INT) AS lvl,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders)"""


def blocks(spark, sf):
    return B.build_blocks(table(spark, sf, "documents"))


def outline(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("lvl"))


@query("src1_build_blocks", f"WITH {BLOCKS_SQL} SELECT doc_id, ord, locator, sha, doc_sha, length(text) AS n FROM blocks")
def src1(spark, sf):
    return blocks(spark, sf).select("doc_id", "ord", "locator", "sha", "doc_sha", F.length("text").alias("n"))


@query("src2_content_ids", f"WITH {BLOCKS_SQL} SELECT doc_id, ord, left(sha256(doc_sha || '|' || locator || '|' || text), 16) AS block_id FROM blocks")
def src2(spark, sf):
    return B.block_ids(blocks(spark, sf)).select("doc_id", "ord", "block_id")


@query(
    "src3_source_kind",
    f"""WITH {BLOCKS_SQL}, k(kind, p) AS (VALUES ('licence', '(?i)licen[sc]e'), ('symbols', '[#$%&*]{{3}}'), ('bars', ' \\| '), ('shouting', '!! ')),
h AS (SELECT doc_id, ord, kind FROM blocks, k WHERE ord < 35 AND length(text) <= 180 AND regexp_matches(text, p)),
g AS (SELECT doc_id, count(DISTINCT kind) AS n, min(kind) AS kind, min(ord) AS ord FROM h GROUP BY doc_id)
SELECT doc_id, CASE WHEN n = 1 THEN kind ELSE 'unknown' END AS kind, CASE WHEN n = 1 THEN ord END AS evidence
FROM (SELECT DISTINCT doc_id FROM blocks) LEFT JOIN g USING (doc_id)""",
)
def src3(spark, sf):
    return B.classify_source(blocks(spark, sf), KINDS)


PROFILE_SQL = r"""prof AS (SELECT item_id::VARCHAR AS item, lower(array_to_string(w[1:3], ' ')) AS name, lower(array_to_string(w[1:6], ' ')) AS detail
  FROM (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE regexp_matches(w[1], '^[\p{L}\p{N}]+$')),
p AS (SELECT name, min(detail) AS detail FROM prof GROUP BY name)"""


@query(
    "src4_profile_scoring",
    f"""WITH {BLOCKS_SQL}, {PROFILE_SQL},
h AS (SELECT doc_id, ord, name, 3 + CASE WHEN length(text) <= 200 THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), detail) THEN 2 ELSE 0 END AS score
  FROM blocks JOIN p ON contains(lower(text), name) WHERE ord < 120
    AND list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), string_split(name, ' ')[1])),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord, name) AS k FROM h)
SELECT d.doc_id, coalesce(name, 'undefined') AS profile, coalesce(score, 0) AS score, CASE WHEN name IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence
FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN (SELECT * FROM r WHERE k = 1) x ON d.doc_id = x.doc_id""",
)
def src4(spark, sf):
    w = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    items = table(spark, sf, "benchmark").select(w.alias("w")).where(F.get("w", F.lit(0)).rlike(r"^[\p{L}\p{N}]+$"))
    named = items.select(F.lower(F.array_join(F.slice("w", 1, 3), " ")).alias("name"), F.lower(F.array_join(F.slice("w", 1, 6), " ")).alias("detail"))
    return B.score_profiles(blocks(spark, sf), named.groupBy("name").agg(F.min("detail").alias("detail")))


@query(
    "src5_title_precedence",
    f"""WITH {BLOCKS_SQL}, d AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'norm' ELSE 'note' END AS kind, CASE WHEN toxic = 1 THEN 0.5 ELSE 0.9 END AS confidence,
  lang AS evidence FROM labels l JOIN documents USING (doc_id)),
t AS (SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN 'de' ELSE NULL END AS title FROM blocks WHERE ord = 0)
SELECT doc_id, CASE WHEN confidence < 0.8 OR (title IS NOT NULL AND title <> evidence) THEN 'unknown' ELSE kind END AS kind,
  CASE WHEN confidence < 0.8 THEN 'weak' WHEN title IS NOT NULL AND title <> evidence THEN 'title' ELSE 'accepted' END AS reason
FROM d LEFT JOIN t USING (doc_id)""",
)
def src5(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    decisions = labels.join(docs, "doc_id").select("doc_id", F.when(F.col("quality") == 1, "norm").otherwise("note").alias("kind"), F.when(F.col("toxic") == 1, 0.5).otherwise(0.9).alias("confidence"), F.col("lang").alias("evidence"))
    titles = blocks(spark, sf).where("ord = 0").select("doc_id", F.when(F.length("text") % 5 == 0, "de").alias("title"))
    return B.accept_titles(decisions, titles)


@query(
    "src6_heading_path",
    f"""WITH {OUTLINE_SQL}
SELECT a.o_custkey, a.o_orderkey, (SELECT string_agg(b.o_orderkey, '/' ORDER BY b.pos) FROM o b
   WHERE b.o_custkey = a.o_custkey AND b.pos <= a.pos AND NOT EXISTS (SELECT 1 FROM o c WHERE c.o_custkey = a.o_custkey AND c.pos > b.pos AND c.pos <= a.pos AND c.lvl <= b.lvl)) AS path
FROM o a""",
)
def src6(spark, sf):
    rows = B.heading_path(outline(spark, sf), "o_custkey", ["o_orderdate", "o_orderkey"], "lvl", "o_orderkey", 5)
    return rows.select("o_custkey", "o_orderkey", F.array_join(F.transform("path", lambda k: k.cast("string")), "/").alias("path"))


@query(
    "src7_outline_numbers",
    f"""WITH {OUTLINE_SQL}
SELECT a.o_custkey, a.o_orderkey, array_to_string(list_transform(range(1, a.lvl + 1), lambda k: (list_count(list_filter(h, lambda x: x.lvl = k AND x.pos <= a.pos
   AND x.pos > coalesce(list_max(list_transform(list_filter(h, lambda y: y.lvl < k AND y.pos <= a.pos), lambda y: y.pos)), 0))))::VARCHAR), '.') AS number
FROM o a JOIN (SELECT o_custkey, list({{'pos': pos, 'lvl': lvl}}) AS h FROM o GROUP BY o_custkey) USING (o_custkey)""",
)
def src7(spark, sf):
    return B.outline_numbers(outline(spark, sf), "o_custkey", ["o_orderdate", "o_orderkey"], "lvl", 5).select("o_custkey", "o_orderkey", "number")


PARTS_SQL = """parts AS (SELECT doc_id, ord, length(text) > 2000 AS chg, part_offset, length(substr(text, part_offset + 1, 2000)) AS n FROM
  (SELECT *, unnest(CASE WHEN length(text) <= 2000 THEN [0] ELSE range(0, greatest(1, length(text) - 200), 1800) END) AS part_offset FROM blocks))"""


@query(
    "src8_clause_chunks",
    f"""WITH RECURSIVE {BLOCKS_SQL}, {PARTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, part_offset) AS seq FROM parts),
{greedy_sql("SELECT doc_id AS key, seq, n, chg FROM s", 2000)} SELECT doc_id, ord, part_offset, n, g AS "group" FROM s JOIN w ON doc_id = key AND s.seq = w.seq""",
)
def src8(spark, sf):
    parts = B.split_oversized(blocks(spark, sf)).withColumn("n", F.length("part"))
    parts = parts.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "part_offset")))
    return B.greedy_groups(parts, ["doc_id"], "seq", "n", 2000, change=F.length("text") > 2000).select("doc_id", "ord", "part_offset", "n", "group")


@query(
    "src9_lossless_chunks",
    r"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS s, 0 AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, e, least(CASE WHEN ea = len THEN len WHEN a1 >= 0 THEN a1 + 1 WHEN a2 >= 0 THEN a2 + 2 WHEN a3 >= 0 THEN a3 + 2 WHEN a4 >= 0 THEN a4 + 1 ELSE ea END, len)
  FROM (SELECT *, CASE WHEN strpos(rs, chr(10)) > 0 THEN ea - strpos(rs, chr(10)) ELSE -1 END AS a1, CASE WHEN strpos(rs, ' .') > 0 THEN ea - strpos(rs, ' .') - 1 ELSE -1 END AS a2,
      CASE WHEN strpos(rs, ' ;') > 0 THEN ea - strpos(rs, ' ;') - 1 ELSE -1 END AS a3, CASE WHEN strpos(rs, ' ') > 0 THEN ea - strpos(rs, ' ') ELSE -1 END AS a4
    FROM (SELECT *, reverse(substr(text, fl + 1, ea - fl)) AS rs
      FROM (SELECT *, e + CAST(floor(0.7 * (ea - e)) AS INT) AS fl
        FROM (SELECT doc_id, text, s, e, length(text) AS len, CASE WHEN length(regexp_extract(substr(text, e + 1), '^(?:\s*\S+){200}\s*')) > 0 THEN e + length(regexp_extract(substr(text, e + 1), '^(?:\s*\S+){200}\s*')) ELSE length(text) END AS ea FROM w WHERE e < length(text))))))
SELECT doc_id, s AS start, e AS "end", len(regexp_extract_all(substr(text, s + 1, e - s), '\S+'))::INT AS n_tokens, sha256(substr(text, s + 1, e - s)) AS sha FROM w WHERE e > 0""",
)
def src9(spark, sf):
    return lossless_chunks(table(spark, sf, "documents"), "doc_id", "text", limit=200).select("doc_id", "start", "end", "n_tokens", F.sha2("chunk", 256).alias("sha"))


@query(
    "src10_section_packing",
    f"""WITH RECURSIVE {BLOCKS_SQL}, b AS (SELECT doc_id, ord, text, ord // 4 AS section, CASE WHEN ord // 4 % 3 = 0 THEN (ord // 32)::VARCHAR ELSE ord // 32 || '/' || ord // 8 END AS chg, CASE WHEN doc_id % 2 = 0 THEN ord // 3 END AS r FROM blocks),
c AS (SELECT doc_id, section, any_value(chg) AS chg, sum(length(text) + 90)::BIGINT AS n FROM b GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS seq FROM c),
{greedy_sql("SELECT doc_id AS key, seq, n, chg FROM s", 1500)},
p AS (SELECT b.doc_id, list({{'o': ord, 'f': 0, 't': text, 'r': r}} ORDER BY ord) AS l FROM b JOIN s ON b.doc_id = s.doc_id AND b.section = s.section JOIN w ON s.doc_id = key AND s.seq = w.seq GROUP BY b.doc_id, g),
h AS (SELECT doc_id, l, list_sum(list_transform(l, lambda x: length(x.t) + 90)) > 1500 AND (len(l) > 1 OR length(l[1].t) >= 128) AS big FROM p
  UNION ALL SELECT doc_id, l, list_sum(list_transform(l, lambda x: length(x.t) + 90)) > 1500 AND (len(l) > 1 OR length(l[1].t) >= 128) FROM (SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN [l[1:m], l[m + 1:]]
      ELSE [[{{'o': l[1].o, 'f': l[1].f, 't': substr(l[1].t, 1, cut), 'r': l[1].r}}], [{{'o': l[1].o, 'f': (l[1].f + cut)::INT, 't': substr(l[1].t, cut + 1), 'r': l[1].r}}]] END) AS l
    FROM (SELECT *, CASE WHEN strpos(reverse(near), ' ') > 0 THEN low + length(near) - strpos(reverse(near), ' ') ELSE length(l[1].t) // 2 END AS cut
      FROM (SELECT *, substr(l[1].t, low + 1, length(l[1].t) // 2 + 200 - low) AS near FROM (SELECT *, greatest(1, length(l[1].t) // 2 - 200) AS low,
          coalesce(list_sort(list_transform(list_filter(range(1, len(l)), lambda i: l[i + 1].r IS NULL OR l[i + 1].r IS DISTINCT FROM l[i].r), lambda i: {{'d': abs(i - len(l) // 2), 'i': i}}))[1].i, len(l) // 2) AS m FROM h WHERE big))))),
n AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY l[1].o, l[1].f) - 1 AS pack FROM h WHERE NOT big)
SELECT doc_id, pack, x.o AS ord, x.f AS "offset", sha256(x.t) AS sha FROM (SELECT doc_id, pack, unnest(l) AS x FROM n)""",
)
def src10(spark, sf):
    """Lines with sections of four lines below headings of 8 and 32, which the table has not; every second document is a table of rows of three lines."""
    b = blocks(spark, sf)
    at = lambda n: F.floor(F.col("ord") / n).cast("string")
    b = b.withColumns({"section": F.floor(F.col("ord") / 4), "path": F.when(F.floor(F.col("ord") / 4) % 3 == 0, F.array(at(32))).otherwise(F.array(at(32), at(8), at(4))), "row": F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("ord") / 3))})
    return section_packs(b, "doc_id", "ord", limit=1500).select("doc_id", "pack", "ord", "offset", F.sha2("text", 256).alias("sha"))


@query(
    "src11_context_packets",
    f"""WITH RECURSIVE {BLOCKS_SQL}, s AS (SELECT doc_id, ord, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS seq, CASE WHEN doc_id % 3 = 0 THEN ord // 16 END AS tab, ord // 4 AS r FROM blocks),
{greedy_sql("SELECT doc_id AS key, seq, n, 0 AS chg FROM s", 7000, 12)}, owned AS (SELECT s.doc_id, s.ord, s.seq, s.tab, s.r, g FROM s JOIN w ON s.doc_id = key AND s.seq = w.seq),
refs AS (SELECT doc_id, ord, unnest(list_filter([CASE WHEN ord % 8 <> 0 THEN ord - ord % 8 WHEN ord % 64 <> 0 THEN ord - ord % 64 END, CASE WHEN ord % 16 = 5 THEN ord + 9 END, CASE WHEN doc_id % 3 = 0 AND ord % 16 > 1 THEN ord - ord % 16 + 1 END], lambda x: x IS NOT NULL)) AS ref FROM s),
e AS (SELECT doc_id, g, min(seq) AS a, max(seq) AS z FROM owned GROUP BY ALL),
v AS (SELECT doc_id, g, ord FROM owned UNION SELECT o.doc_id, o.g, s.ord FROM owned o JOIN s ON s.doc_id = o.doc_id AND s.tab = o.tab AND s.r = o.r
  UNION SELECT e.doc_id, e.g, s.ord FROM e JOIN s ON s.doc_id = e.doc_id AND s.seq BETWEEN a - 2 AND z + 2),
x AS (SELECT * FROM v UNION SELECT x.doc_id, x.g, s.ord FROM x JOIN refs f ON f.doc_id = x.doc_id AND f.ord = x.ord JOIN s ON s.doc_id = f.doc_id AND s.ord = f.ref)
SELECT x.doc_id, x.g AS "group", x.ord, CASE WHEN o.ord IS NULL THEN 'context' ELSE 'owned' END AS role FROM x LEFT JOIN owned o ON o.doc_id = x.doc_id AND o.g = x.g AND o.ord = x.ord""",
)
def src11(spark, sf):
    """Lines refer to the headings of their 8 and 64, some to a note; every third document is a table of rows of four lines under a header line in each 16."""
    b, o = blocks(spark, sf), F.col("ord")
    b = b.withColumns({"n": F.length("text"), "table": F.when(F.col("doc_id") % 3 == 0, F.floor(o / 16)), "row": F.floor(o / 4)}).select("doc_id", "ord", "n", "table", "row")
    heading = F.when(o % 8 != 0, o - o % 8).when(o % 64 != 0, o - o % 64)
    refs = b.select("doc_id", "ord", F.explode(F.array_compact(F.array(heading, F.when(o % 16 == 5, o + 9), F.when((F.col("doc_id") % 3 == 0) & (o % 16 > 1), o - o % 16 + 1)))).alias("ref"))
    return packets(b, refs, "doc_id", "ord", "n")


@query(
    "src12_sentence_spans",
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.;!?])(\s+[\p{Lu}–—-])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS n FROM p), e AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)::INT AS stop, regexp_replace(raw, '^\s+', '') AS t FROM u)
SELECT doc_id, n, stop - length(t) AS start, stop AS "end", sha256(t) AS sha FROM e""",
)
def src12(spark, sf):
    return B.sentence_spans(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "n", "start", "end", F.sha2("sentence", 256).alias("sha"))


@query(
    "src13_grid_audit",
    """WITH c AS (SELECT l_orderkey, l_linenumber AS r0, 1 + l_partkey % 4 AS c0, 1 + l_suppkey % 2 AS rs, 1 + l_partkey % 3 AS cs FROM lineitem),
s AS (SELECT l_orderkey, r, unnest(range(c0, c0 + cs)) AS k FROM (SELECT *, unnest(range(r0, r0 + rs)) AS r FROM c)),
g AS (SELECT l_orderkey, r, k, count(*) AS n FROM s GROUP BY ALL)
SELECT l_orderkey, count(*) FILTER (n > 1 AND r <= 7 AND k <= 4) AS overlaps, 28 - count(*) FILTER (r <= 7 AND k <= 4) AS gaps, count(*) FILTER (r > 7 OR k > 4) AS outside FROM g GROUP BY l_orderkey""",
)
def src13(spark, sf):
    cells = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("row"), (1 + F.col("l_partkey") % 4).alias("col"), (1 + F.col("l_suppkey") % 2).alias("rowspan"), (1 + F.col("l_partkey") % 3).alias("colspan"))
    return B.grid_audit(cells.withColumn("rows", F.lit(7)).withColumn("cols", F.lit(4)), ["l_orderkey"])


@query(
    "src13_header_bindings",
    """WITH c AS (SELECT l_orderkey, l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS id, l_linenumber AS r, 1 + l_suppkey % 2 AS rs, l_partkey % 9 = 0 AS whole, l_partkey % 40 AS p, 4 + l_suppkey % 30 AS n,
  l_linenumber <= 2 AS header, l_orderkey % 3 = 0 AS rep FROM lineitem),
d AS (SELECT *, CASE WHEN whole THEN 0 ELSE p END AS lo, CASE WHEN whole THEN 70 ELSE p + n END AS hi FROM c),
m AS (SELECT a.l_orderkey, a.id, b.id AS h, b.r, b.lo, round((least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (a.hi - a.lo), 5) AS share FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND b.header AND b.r < a.r AND a.lo < b.hi AND b.lo < a.hi
  AND (NOT a.rep OR b.r = (SELECT max(x.r) FROM d x WHERE x.l_orderkey = a.l_orderkey AND x.header AND x.r < a.r))),
g AS (SELECT l_orderkey, id, list(h ORDER BY r, lo, h) FILTER (share >= 0.15) AS hs, list(h ORDER BY r, lo, h) FILTER (share < 0.15) AS ss FROM m GROUP BY ALL),
f AS (SELECT a.l_orderkey, a.id, max({'r': b.r, 'id': b.id}).id AS grp FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND b.lo = 0 AND b.hi = 70 AND NOT b.header AND b.r < a.r GROUP BY ALL),
k AS (SELECT a.l_orderkey, a.id, list(b.id ORDER BY b.r, b.lo, b.id) AS ls FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND NOT b.header AND b.r <= a.r AND a.r < b.r + b.rs AND b.lo < a.lo GROUP BY ALL)
SELECT d.l_orderkey, d.id, coalesce(array_to_string(hs, ','), '') AS headers, coalesce(array_to_string(ss, ','), '') AS slivers, grp AS "group", coalesce(array_to_string(ls, ','), '') AS labels
FROM d LEFT JOIN g USING (l_orderkey, id) LEFT JOIN f USING (l_orderkey, id) LEFT JOIN k USING (l_orderkey, id)""",
)
def src13_bindings(spark, sf):
    """Lines as cells of uneven width: the first two rows are headers, every ninth part is a cell of full width, every third table repeats its headers."""
    whole = F.col("l_partkey") % 9 == 0
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    cells = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 100 + place).cast("long").alias("id"), F.col("l_linenumber").cast("long").alias("row"), (1 + F.col("l_suppkey") % 2).alias("rowspan"), F.when(whole, 0).otherwise(F.col("l_partkey") % 40).alias("left"),
        F.when(whole, 70).otherwise(F.col("l_partkey") % 40 + 4 + F.col("l_suppkey") % 30).alias("right"), (F.col("l_linenumber") <= 2).alias("header"), F.lit(70).alias("width"), (F.col("l_orderkey") % 3 == 0).alias("repeats"),
    )
    bound = B.header_bindings(cells, ["l_orderkey"], repeated="repeats")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return bound.select("l_orderkey", "id", text("headers"), text("slivers"), "group", text("labels"))


@query(
    "src14_table_diff",
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || ' ' || CAST(l_quantity::BIGINT AS VARCHAR)) AS v, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
a AS (SELECT * FROM l WHERE p % 7 <> 0), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN p % 3 = 0 THEN replace(v, ' ', ' <= ') WHEN p % 5 = 0 THEN v || 'x' ELSE v END AS v FROM l WHERE p % 11 <> 0),
j AS (SELECT l_orderkey, l_linenumber, a.v AS x, b.v AS y FROM a FULL JOIN b USING (l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, CASE WHEN y IS NULL THEN 'removed' WHEN x IS NULL THEN 'added' ELSE 'changed' END AS kind,
  array_to_string(regexp_extract_all(coalesce(x, ''), '[0-9.,]+|[<>=≤≥-]|\\bnot?\\b'), ' ') <> array_to_string(regexp_extract_all(coalesce(y, ''), '[0-9.,]+|[<>=≤≥-]|\\bnot?\\b'), ' ')
    OR coalesce(trim(x), '') IN ('', '-', '–') <> (coalesce(trim(y), '') IN ('', '-', '–')) AS critical
FROM j WHERE x IS DISTINCT FROM y""",
)
def src14(spark, sf):
    value = F.concat("l_returnflag", F.lit(" "), F.col("l_quantity").cast("long").cast("string"))
    cells = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(value).alias("v"), F.min("l_partkey").alias("p"))
    other = F.when(F.col("p") % 3 == 0, F.replace("v", F.lit(" "), F.lit(" <= "))).when(F.col("p") % 5 == 0, F.concat("v", F.lit("x"))).otherwise(F.col("v"))
    return B.compare_tables(cells.where("p % 7 <> 0"), cells.where("p % 11 <> 0").withColumn("v", other), ["l_orderkey", "l_linenumber"], "v")


@query(
    "src15_continued_tables",
    """WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey % 2 AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page,
  o_orderstatus = 'O' AS continued, left(o_orderpriority, 1) AS path, 0.0 AS l, CAST(100 + o_orderkey % 3 AS DOUBLE) AS r FROM orders),
w AS (SELECT *, lag(number) OVER v AS n0, lag(path) OVER v AS p0, lag(page) OVER v AS g0, lag(l) OVER v AS l0, lag(r) OVER v AS r0 FROM t WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, coalesce(continued AND number = n0 AND path IS NOT DISTINCT FROM p0 AND page = g0 + 1 AND abs(l - l0) < 0.015 * greatest(abs(r0 - l0), 1e-9) AND abs(r - r0) < 0.015 * greatest(abs(r0 - l0), 1e-9), false) AS continues FROM w""",
)
def src15(spark, sf):
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    t = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 2).alias("number"), page.alias("page"), (F.col("o_orderstatus") == "O").alias("continued"),
        F.substring("o_orderpriority", 1, 1).alias("path"), F.lit(0.0).alias("left"), (100 + F.col("o_orderkey") % 3).cast("double").alias("right"),
    )
    return B.continued_tables(t, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "continues")


@query(
    "src16_row_bundles",
    f"""WITH RECURSIVE s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, length(concat_ws('|', l_partkey, l_suppkey, l_quantity, l_extendedprice)) + 30 AS n FROM lineitem),
{greedy_sql("SELECT l_orderkey AS key, seq, n, 0 AS chg FROM s", 200)} SELECT l_orderkey, s.seq, n, g AS "group" FROM s JOIN w ON l_orderkey = key AND s.seq = w.seq""",
)
def src16(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    rows = rows.withColumn("n", F.length(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])) + 30)
    return B.greedy_groups(rows, ["l_orderkey"], "seq", "n", 200).select("l_orderkey", "seq", "n", "group")


@query(
    "src19_append_records",
    """WITH s AS (SELECT o_orderkey, o_orderstatus AS version, sha256(o_totalprice::DECIMAL(18,2)::VARCHAR) AS digest FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey, o_orderstatus AS version, sha256((CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice::DECIMAL(18,2) + 1 ELSE o_totalprice::DECIMAL(18,2) END)::DECIMAL(18,2)::VARCHAR) AS digest FROM orders)
SELECT n.o_orderkey, CASE WHEN s.digest IS NULL THEN 'insert' ELSE 'conflict' END AS outcome FROM n LEFT JOIN s USING (o_orderkey, version) WHERE s.digest IS NULL OR s.digest <> n.digest
UNION ALL SELECT DISTINCT l_orderkey, 'dangling' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)""",
)
def src19(spark, sf):
    orders = table(spark, sf, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    record = lambda p: (F.col("o_orderkey"), F.col("o_orderstatus").alias("version"), F.sha2(p.cast("decimal(18,2)").cast("string"), 256).alias("digest"))
    stored = orders.where("o_orderkey % 3 <> 0").select(*record(price))
    new = orders.select(*record(F.when(F.col("o_orderkey") % 5 == 0, price + 1).otherwise(price)))
    insert, conflict = B.append_records(stored, new, ["o_orderkey", "version"], "digest")
    refs = B.dangling_refs(table(spark, sf, "lineitem").select("l_orderkey").distinct(), stored, "l_orderkey", "o_orderkey")
    out = insert.select("o_orderkey", F.lit("insert").alias("outcome")).unionByName(conflict.select("o_orderkey", F.lit("conflict").alias("outcome")))
    return out.unionByName(refs.select(F.col("l_orderkey").alias("o_orderkey"), F.lit("dangling").alias("outcome")))


@query(
    "src20_release_manifest",
    """WITH m AS (SELECT o_custkey % 10 AS release, o_orderkey, sha256(o_orderstatus || '|' || o_orderkey) AS digest FROM orders WHERE o_orderkey % 17 <> 0),
links AS (SELECT o.o_custkey % 10 AS release, l.l_orderkey AS source, (l.l_partkey * 7) % (SELECT count(*) FROM orders) AS target FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
miss AS (SELECT k.release, count(DISTINCT target) AS n FROM links k WHERE EXISTS (SELECT 1 FROM m WHERE m.release = k.release AND m.o_orderkey = k.source)
   AND NOT EXISTS (SELECT 1 FROM m WHERE m.release = k.release AND m.o_orderkey = k.target) GROUP BY k.release),
bad AS (SELECT m.release, count(*) AS items, count(*) FILTER (m.digest <> sha256((CASE WHEN o.o_orderkey % 101 = 0 THEN 'X' ELSE o.o_orderstatus END) || '|' || o.o_orderkey)) AS altered FROM m JOIN orders o USING (o_orderkey) GROUP BY m.release)
SELECT release, items, altered, coalesce(n, 0) AS outside, altered = 0 AND coalesce(n, 0) = 0 AS usable FROM bad LEFT JOIN miss USING (release)""",
)
def src20(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    release = (F.col("o_custkey") % 10).alias("release")
    manifest = orders.where("o_orderkey % 17 <> 0").select(release, "o_orderkey", F.sha2(F.concat_ws("|", "o_orderstatus", F.col("o_orderkey").cast("string")), 256).alias("digest"))
    n = orders.count()
    links = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(release, F.col("l_orderkey").alias("source"), (F.col("l_partkey") * 7 % n).alias("target"))
    held = manifest.select("release", F.col("o_orderkey").alias("_k"))
    inner = links.join(held, (links.release == held.release) & (F.col("source") == F.col("_k")), "left_semi")
    outside = inner.join(held, (inner.release == held.release) & (F.col("target") == F.col("_k")), "left_anti").groupBy("release").agg(F.count_distinct("target").alias("outside"))
    now = F.sha2(F.concat_ws("|", F.when(F.col("o_orderkey") % 101 == 0, "X").otherwise(F.col("o_orderstatus")), F.col("o_orderkey").cast("string")), 256)
    checked = manifest.join(orders.select("o_orderkey", now.alias("now")), "o_orderkey").groupBy("release").agg(F.count("*").alias("items"), F.count_if(F.col("digest") != F.col("now")).alias("altered"))
    out = checked.join(outside, "release", "left").withColumn("outside", F.coalesce("outside", F.lit(0)))
    return out.withColumn("usable", (F.col("altered") == 0) & (F.col("outside") == 0))


FINDINGS_SQL = "f AS (SELECT event_type AS category, event_id AS id, 'User ' || user_id || ' <' || event_type || '>' AS issue, 'Value & unit' AS explanation, CASE WHEN event_id % 3 <> 0 THEN 'Check it' END AS suggestion, CASE WHEN event_id % 2 = 0 THEN [props] ELSE [] END AS quotes FROM events)"


@query(
    "src18_report_rows",
    f"""WITH {FINDINGS_SQL}, t AS (SELECT category, 'finding' AS kind, issue AS text FROM f UNION ALL SELECT category, 'text', explanation FROM f UNION ALL SELECT category, 'text', 'Suggestion: ' || coalesce(suggestion, '') FROM f
  UNION ALL SELECT category, 'quote', unnest(quotes) FROM f UNION ALL SELECT DISTINCT category, 'category', category FROM f),
h AS (SELECT *, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS e, CASE kind WHEN 'category' THEN 'h2' WHEN 'finding' THEN 'h3' WHEN 'text' THEN 'p' ELSE 'blockquote' END AS tag FROM t)
SELECT category, 'markdown' AS form, CASE kind WHEN 'category' THEN '## ' WHEN 'finding' THEN '### ' WHEN 'text' THEN '' ELSE '> ' END || text AS line FROM h UNION ALL SELECT category, 'html', '<' || tag || '>' || e || '</' || tag || '>' FROM h""",
)
def src18(spark, sf):
    """Both text reports as they stand in their files, a folder a category."""
    from clausework.sources.area import report_lines, write_report
    from clausework.sources.scratch import new_folder

    quotes = F.when(F.col("event_id") % 2 == 0, F.array("props")).otherwise(F.array().cast("array<string>"))
    issue = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" <"), "event_type", F.lit(">"))
    lines = report_lines(table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("id"), issue.alias("issue"), F.lit("Value & unit").alias("explanation"), F.when(F.col("event_id") % 3 != 0, "Check it").alias("suggestion"), quotes.alias("quotes")))
    read = []
    for form in ("markdown", "html"):
        path = new_folder(spark, "report")
        write_report(lines, path, form)
        read.append(spark.read.schema("value string, category string").text(path).select("category", F.lit(form).alias("form"), F.col("value").alias("line")))
    return read[0].unionByName(read[1])


def area(spark, sf):
    """An area from the tables: nations are sources, regions profiles, suppliers requirements, parts glossary entries; some records are broken on purpose."""
    text = lambda c: F.col(c).cast("string")
    named = lambda mark, c: F.concat(F.lit(mark), text(c))
    none = F.lit(None).cast("string")
    cite = lambda start, end, quote: F.array(F.struct(F.lit("p1").alias("locator"), quote.alias("quote"), F.lit(start).alias("start"), F.lit(end).alias("end")))
    nation, region, supplier, part = (table(spark, sf, t) for t in ("nation", "region", "supplier", "part"))
    s = supplier.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    requirement = s.select(named("q", "s_suppkey").alias("id"), named("n", "s_nationkey").alias("source_id"), F.when(F.col("s_suppkey") % 13 == 0, "definition").otherwise("requirement").alias("entity_type"), none.alias("term"), F.col("s_name").alias("description"),
        F.when(F.col("s_suppkey") % 3 == 0, named("r", "s_nationkey")).alias("local_profile"), cite(0, 6, F.when(F.col("s_suppkey") % 7 == 0, "NATIVE").otherwise(F.substring("n_name", 1, 6))).alias("citations"))
    glossary = part.select(named("g", "p_partkey").alias("id"), F.concat(F.lit("n"), (F.col("p_size") % 30).cast("string")).alias("source_id"), F.lit("definition").alias("entity_type"), F.upper("p_name").alias("term"), F.col("p_type").alias("description"), none.alias("local_profile"), cite(0, 7, F.lit("NATION_")).alias("citations"))
    choice = part.groupBy(F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("p")).select("key", F.concat(F.lit("g"), (F.col("p") + F.when(F.col("p") % 5 == 0, 1).otherwise(0)).cast("string")).alias("active_entry_id"))
    link = supplier.select(named("k", "s_suppkey").alias("id"), named("q", "s_suppkey").alias("source"), F.concat(F.lit("q"), (F.col("s_suppkey") + 1).cast("string")).alias("target"), named("g", "s_nationkey").alias("basis"))
    control = supplier.select(F.when(F.col("s_suppkey") % 2 == 0, "card").otherwise("profile").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, named("q", "s_suppkey")).otherwise(named("r", "s_suppkey")).alias("id"), (F.col("s_suppkey") % 3 == 0).alias("enabled"), (F.col("s_suppkey") % 4 == 0).alias("deleted"))
    profile = region.select(named("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.array(F.concat(F.lit("r"), (F.col("r_regionkey") + 1).cast("string"))).alias("parents"), F.array(named("n", "r_regionkey")).alias("sources"))
    return {"source": nation.select(named("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("text")), "profile": profile, "requirement": requirement, "glossary": glossary, "choice": choice, "link": link, "control": control}


AREA_SQL = """src AS (SELECT 'n' || n_nationkey AS id, n_name AS text FROM nation),
pro AS (SELECT 'r' || r_regionkey AS id, 'r' || (r_regionkey + 1) AS parent, 'n' || r_regionkey AS source FROM region),
req AS (SELECT 'q' || s_suppkey AS id, 'n' || s_nationkey AS source_id, CASE WHEN s_suppkey % 13 = 0 THEN 'definition' ELSE 'requirement' END AS entity_type, CASE WHEN s_suppkey % 3 = 0 THEN 'r' || s_nationkey END AS local_profile, CASE WHEN s_suppkey % 7 = 0 THEN 'NATIVE' ELSE substr(n_name, 1, 6) END AS quote, 6 AS e FROM supplier JOIN nation ON n_nationkey = s_nationkey),
glo AS (SELECT 'g' || p_partkey AS id, 'n' || (p_size % 30) AS source_id, upper(p_name) AS term, 'NATION_' AS quote, 7 AS e FROM part),
cho AS (SELECT lower(p_name) AS key, 'g' || (min(p_partkey) + CASE WHEN min(p_partkey) % 5 = 0 THEN 1 ELSE 0 END) AS entry FROM part GROUP BY lower(p_name)),
lnk AS (SELECT 'k' || s_suppkey AS id, 'q' || s_suppkey AS source, 'q' || (s_suppkey + 1) AS target, 'g' || s_nationkey AS basis FROM supplier),
ctl AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'card' ELSE 'profile' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'q' ELSE 'r' END || s_suppkey AS id, s_suppkey % 3 = 0 AS enabled, s_suppkey % 4 = 0 AS deleted FROM supplier),
crd AS (SELECT id FROM req UNION ALL SELECT id FROM glo)"""


@query(
    "src17_area_problems",
    f"""WITH {AREA_SQL}
SELECT 'profile' AS kind, id, 'parent absent' AS problem FROM pro WHERE parent NOT IN (SELECT id FROM pro) UNION ALL SELECT 'profile', id, 'source absent' FROM pro WHERE source NOT IN (SELECT id FROM src)
UNION ALL SELECT 'requirement', id, 'source absent' FROM req WHERE source_id NOT IN (SELECT id FROM src) UNION ALL SELECT 'glossary', id, 'source absent' FROM glo WHERE source_id NOT IN (SELECT id FROM src)
UNION ALL SELECT 'requirement', id, 'profile absent' FROM req WHERE local_profile NOT IN (SELECT id FROM pro) UNION ALL SELECT 'requirement', id, 'wrong type' FROM req WHERE entity_type = 'definition'
UNION ALL SELECT 'requirement', req.id, 'citation not in its source' FROM req JOIN src ON source_id = src.id WHERE substr(text, 1, e) <> quote OR length(text) < e
UNION ALL SELECT 'glossary', glo.id, 'citation not in its source' FROM glo JOIN src ON source_id = src.id WHERE substr(text, 1, e) <> quote OR length(text) < e
UNION ALL SELECT 'choice', key, 'entry of another term' FROM cho LEFT JOIN glo ON entry = glo.id WHERE lower(term) IS DISTINCT FROM key
UNION ALL SELECT 'link', id, 'source absent' FROM lnk WHERE source NOT IN (SELECT id FROM crd) UNION ALL SELECT 'link', id, 'target absent' FROM lnk WHERE target NOT IN (SELECT id FROM crd) UNION ALL SELECT 'link', id, 'basis absent' FROM lnk WHERE basis NOT IN (SELECT id FROM crd)
UNION ALL SELECT 'control', id, 'object absent' FROM ctl WHERE NOT CASE kind WHEN 'card' THEN id IN (SELECT id FROM crd) ELSE id IN (SELECT id FROM pro) END UNION ALL SELECT 'control', id, 'deleted and enabled' FROM ctl WHERE enabled AND deleted""",
)
def src17_problems(spark, sf):
    from clausework.sources.area import area_problems, export_area, read_area

    return area_problems(read_area(spark, export_area(spark, area(spark, sf))))


@query(
    "src17_area_import",
    f"""WITH {AREA_SQL}, m AS (
SELECT 'source' AS kind, left(sha256('area|source|' || id), 32) AS id, text AS refers FROM src
UNION ALL SELECT 'profile', left(sha256('area|profile|' || id), 32), left(sha256('area|profile|' || parent), 32) || ',' || left(sha256('area|source|' || source), 32) FROM pro
UNION ALL SELECT 'requirement', left(sha256('area|card|' || id), 32), left(sha256('area|source|' || source_id), 32) || ',' || coalesce(left(sha256('area|profile|' || local_profile), 32), '') || ',' || sha256(left(sha256('area|source|' || source_id), 32) || '|p1|0|' || quote) FROM req
UNION ALL SELECT 'glossary', left(sha256('area|card|' || id), 32), left(sha256('area|source|' || source_id), 32) || ',,' || sha256(left(sha256('area|source|' || source_id), 32) || '|p1|0|' || quote) FROM glo
UNION ALL SELECT 'choice', key, left(sha256('area|card|' || entry), 32) FROM cho
UNION ALL SELECT 'link', left(sha256('area|link|' || id), 32), left(sha256('area|card|' || source), 32) || ',' || left(sha256('area|card|' || target), 32) || ',' || left(sha256('area|card|' || basis), 32) FROM lnk
UNION ALL SELECT 'control', left(sha256('area|' || kind || '|' || id), 32), CASE WHEN deleted THEN 'deleted' WHEN enabled THEN 'enabled' ELSE 'disabled' END FROM ctl)
SELECT * FROM m""",
)
def src17(spark, sf):
    """Every record of the imported area with what it refers to under the new ids."""
    from clausework.sources.area import export_area, import_area, read_area

    got = import_area(read_area(spark, export_area(spark, area(spark, sf))), "area")
    card = F.concat_ws(",", "source_id", F.coalesce("local_profile", F.lit("")), F.col("citations")[0]["context"])
    refers = {"source": F.col("text"), "profile": F.concat_ws(",", F.array_join("parents", ","), F.array_join("sources", ",")), "requirement": card, "glossary": card, "choice": F.col("active_entry_id"), "link": F.concat_ws(",", "source", "target", "basis"), "control": F.when(F.col("deleted"), "deleted").when(F.col("enabled"), "enabled").otherwise("disabled")}
    rows = [got[k].select(F.lit(k).alias("kind"), F.col("key" if k == "choice" else "id").alias("id"), r.alias("refers")) for k, r in refers.items()]
    return reduce(DataFrame.unionByName, rows)


__all__ = ["blocks", "content_id", "outline"]
