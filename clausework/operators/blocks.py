"""Blocks of documents: building, addressing, outlines, chunking, packing, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.functions.text import INK, content_id


def build_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ord, locator, text, sha, doc_sha``: one row per line with ink; order is a column."""
    lines = docs.select(F.col(doc).alias("doc_id"), F.sha2(text, 256).alias("doc_sha"), F.posexplode(F.split(text, "\n")).alias("ord", "text"))
    lines = lines.where(F.col("text").rlike(INK))
    return lines.select("doc_id", "ord", F.concat(F.lit("p"), (F.col("ord") + 1).cast("string")).alias("locator"), "text", F.sha2("text", 256).alias("sha"), "doc_sha")


def block_ids(blocks: DataFrame) -> DataFrame:
    """Content-addressed ids: of digest, locator and text."""
    return blocks.withColumn("block_id", content_id(F.col("doc_sha"), F.col("locator"), F.col("text")))


def classify_source(blocks: DataFrame, patterns: list[tuple[str, str]], first: int = 35, longest: int = 180) -> DataFrame:
    """``doc_id, kind, evidence``: the only kind whose pattern a short early block matches, with its first such block; otherwise unknown."""
    early = blocks.where((F.col("ord") < first) & (F.length("text") <= longest))
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in patterns]))
    hits = early.select("doc_id", "ord", F.explode(kinds).alias("kind"))
    per = hits.groupBy("doc_id").agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("only"), F.min("ord").alias("at"))
    one = F.col("kinds") == 1
    found = per.select("doc_id", F.when(one, F.col("only")).otherwise("unknown").alias("kind"), F.when(one, F.col("at")).alias("evidence"))
    return blocks.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), "evidence")


def score_profiles(blocks: DataFrame, profiles: DataFrame, first: int = 120, short: int = 200) -> DataFrame:
    """``profiles``: name, detail. Score of a block that contains a profile's name: words of the name, +3 if short, +2 if it has the detail too.

    ``doc_id, profile, score, confidence``: the best (score, then earliest block, then name); no match: undefined, 0. Names meet blocks by their
    first word, so no block is held against every profile.
    """
    named = profiles.select("name", "detail", F.split(F.lower("name"), " ").alias("_words")).withColumn("_first", F.col("_words")[0])
    front = blocks.where(F.col("ord") < first).select("doc_id", "ord", "text", F.lower("text").alias("_low"))
    keys = front.withColumn("_first", F.explode(F.array_distinct(F.regexp_extract_all("_low", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))))
    hit = keys.join(named, "_first").where(F.contains("_low", F.lower("name")))
    score = F.size("_words") + F.when(F.length("text") <= short, 3).otherwise(0) + F.when(F.contains("_low", F.lower("detail")), 2).otherwise(0)
    best = hit.withColumn("score", score).groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "name")).alias("b"))
    every = blocks.select("doc_id").distinct().join(best, "doc_id", "left")
    return every.select("doc_id", F.coalesce("b.name", F.lit("undefined")).alias("profile"), F.coalesce(-F.col("b.s"), F.lit(0)).alias("score"), F.when(F.col("b.name").isNull(), 0.0).otherwise(1.0).alias("confidence"))


def accept_titles(decisions: DataFrame, titles: DataFrame, least: float = 0.8) -> DataFrame:
    """``decisions``: doc_id, kind, confidence, evidence; ``titles``: doc_id, title (explicit type of a standalone title block).

    Accepted with enough confidence and evidence; unknown if an explicit title contradicts the evidence.
    """
    joined = decisions.join(titles, "doc_id", "left")
    weak = (F.col("confidence") < least) | F.col("evidence").isNull()
    against = F.col("title").isNotNull() & (F.col("title") != F.col("evidence"))
    return joined.select("doc_id", F.when(weak | against, "unknown").otherwise(F.col("kind")).alias("kind"), F.when(weak, "weak").when(against, "title").otherwise("accepted").alias("reason"))


def heading_path(rows: DataFrame, key: str, order: list[str], level: str, title: str, levels: int) -> DataFrame:
    """Adds ``path``: titles of the open headings up to each row; a heading of level L closes those of level L and deeper.

    For each level the last heading is found by a running maximum of (order, title), and stays open while no heading of a lower level came later.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("_at", at)
    for k in range(1, levels + 1):
        rows = rows.withColumn(f"_h{k}", F.max(F.when(F.col(level) == k, F.struct("_at", F.col(title).alias("t")))).over(w))
    parts = []
    for k in range(1, levels + 1):
        lower = F.greatest(*[F.coalesce(F.col(f"_h{j}._at"), F.lit(0)) for j in range(1, k)], F.lit(0)) if k > 1 else F.lit(0)
        parts.append(F.when(F.col(f"_h{k}._at") > lower, F.col(f"_h{k}.t")))
    return rows.withColumn("path", F.array_compact(F.array(*parts))).drop("_at", *[f"_h{k}" for k in range(1, levels + 1)])


def outline_numbers(rows: DataFrame, key: str, order: list[str], level: str, levels: int) -> DataFrame:
    """Adds ``number``: dotted counters of each level, restarting under a new parent.

    The counter of level k counts its headings since the last one of a lower level, the group of which is a running count of lower ones.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(1, levels + 1):
        rows = rows.withColumn(f"_g{k}", F.count_if(F.col(level) < k).over(w))
        inner = Window.partitionBy(key, f"_g{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"_c{k}", F.count_if(F.col(level) == k).over(inner))
        parts.append(F.when(F.col(level) >= k, F.col(f"_c{k}").cast("string")))
    return rows.withColumn("number", F.concat_ws(".", *parts)).drop(*[f"_{x}{k}" for x in "gc" for k in range(1, levels + 1)])


def _fold(items: Column, size, limit: int, most: int | None) -> Column:
    """Group numbers of an ordered array by greedy packing: a new group where the sum of sizes would pass ``limit`` or the count ``most``, or the key changes."""
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("key"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        new = (a.g < 0) | (a["sum"] + size(x) > limit) | (a.n >= most if most else F.lit(False)) | ~a.key.eqNullSafe(x.key)
        g = F.when(new, a.g + 1).otherwise(a.g)
        return F.struct(g.alias("g"), F.when(new, size(x)).otherwise(a["sum"] + size(x)).cast("long").alias("sum"), F.when(new, 1).otherwise(a.n + 1).alias("n"), x.key.alias("key"), F.array_append(a.out, g).alias("out"))

    return F.aggregate(items, start, step, lambda a: a.out)


def greedy_groups(rows: DataFrame, keys: list[str], order: str, size: str, limit: int, most: int | None = None, change: Column | None = None) -> DataFrame:
    """Adds ``group``: ordered greedy packing within ``keys``; one document is one fold over its sizes (texts stay outside of it)."""
    item = F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"), (change if change is not None else F.lit("")).cast("string").alias("key"))
    folded = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    folded = folded.withColumn("_groups", _fold(F.col("_items"), lambda x: x.s, limit, most))
    flat = folded.select(*keys, F.inline(F.arrays_zip(F.col("_items.o").alias("o"), F.col("_groups").alias("group")))).withColumnRenamed("o", order)
    return rows.join(flat, [*keys, order])


def split_oversized(blocks: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """Parts of at most ``size`` characters with ``overlap``, with their offset."""
    starts = F.when(F.length("text") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(size - overlap)))
    cut = blocks.withColumn("part_offset", F.explode(starts))
    return cut.withColumn("part", F.substring(F.col("text"), F.col("part_offset") + 1, F.lit(size)))


_SENTENCE_ENDS = r"(?<=[.;!?])(?=\s+[\p{Lu}–—-])"


def sentence_array(text: Column) -> Column:
    """``array<struct<start, end, sentence>>``: the rows of ``sentence_spans`` as a column, for what stays within its text."""

    def placed(parts):
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x)))
        own = lambda end: lambda s: F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("sentence"))
        cut = lambda e: F.transform(parts, lambda x, i: F.transform(F.array(F.regexp_replace(x, r"^\s+", "")), own(F.get(e, i + 1)))[0])
        return F.transform(F.array(ends), cut)[0]

    return F.transform(F.array(F.split(text, _SENTENCE_ENDS)), placed)[0]


def sentence_spans(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc_id, n, start, end, sentence``: split after ``.;!?`` before white space and a capital or dash; decimals stay whole."""
    parts = docs.select(F.col(doc).alias("doc_id"), F.split(F.col(text), _SENTENCE_ENDS).alias("p"))
    ends = F.aggregate("p", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x)))
    spans = parts.withColumn("e", ends).select("doc_id", "e", F.posexplode("p").alias("n", "raw"))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    return spans.select("doc_id", "n", (F.col("e")[F.col("n")] + lead).alias("start"), F.col("e")[F.col("n") + 1].alias("end"), F.regexp_replace("raw", r"^\s+", "").alias("sentence"))


def grid_audit(cells: DataFrame, table: list[str]) -> DataFrame:
    """``cells``: table columns, row, col, rowspan, colspan, rows, cols -> per table: overlaps, gaps and cells outside of the grid."""
    slots = cells.select(*table, "row", "col", "rows", "cols", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("r"), "colspan")
    slots = slots.select(*table, "rows", "cols", "r", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("c"))
    inside = (F.col("r") <= F.col("rows")) & (F.col("c") <= F.col("cols"))
    per = slots.groupBy(*table, "rows", "cols", "r", "c").agg(F.count("*").alias("n"), F.first(inside).alias("inside"))
    return per.groupBy(*table).agg(
        F.count_if(F.col("inside") & (F.col("n") > 1)).alias("overlaps"),
        (F.first(F.col("rows") * F.col("cols")) - F.count_if("inside")).alias("gaps"),
        F.count_if(~F.col("inside")).alias("outside"),
    )


def header_bindings(cells: DataFrame, table: list[str], least: float = 0.15, repeated: str | None = None) -> DataFrame:
    """``table, id, headers, slivers, groups, labels``: the header cells above each cell that overlap at least ``least`` of its width, those that overlap less, the last full-width cell
    above it (a row group), and the cells to its left in its rows (row labels); arrays of ids in order of row and left edge.

    ``cells``: table columns, id, row, rowspan, left and right edge (whole numbers, in any unit of width; right is exclusive), header (its row is a header row) and width (of the table). ``repeated`` names a
    column of tables that repeat their header: there only the last header row above a cell counts. A header of any level binds by its own width, so merged headers bind to all cells below
    them. A cell that no header overlaps has an empty array: it is an orphan. Header cells bind to the headers above them. Null edges, or none to the right of the left one, bind nothing.

    One shuffle by the table; labels come from a window over each row, headers and groups from one over the rows above. Of tables that repeat their header, a cell holds the last header row only.
    """
    kind, real = cells.schema["id"].dataType.simpleString(), reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in [*table, "row"]])
    held = F.coalesce(F.col(repeated), F.lit(False)) if repeated else F.lit(False)
    c = cells.select(*table, "id", "row", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), "width", F.col("header"), held.alias("_rep"), real.alias("_real"), F.when(F.col("rowspan") > 0, F.col("rowspan")).otherwise(0).alias("_span"))
    at = F.explode(F.when((F.col("_span") > 1) & F.col("row").isNotNull(), F.sequence("row", F.col("row") + F.col("_span") - 1)).otherwise(F.array("row")))
    spread = c.repartition(*table).select("*", at.alias("_at"), F.struct("row", "left", "id").alias("_place"))
    own, is_head = F.col("_at").eqNullSafe(F.col("row")), F.col("_real") & F.col("header")
    line = Window.partitionBy(*table, "_at").orderBy("left")
    gives = F.col("_real") & ~F.col("header") & F.col("left").isNotNull() & (F.col("_span") > 0)
    placed = F.struct("row", "left", "id", "right")
    whole_row = F.collect_list(F.when(own & is_head & F.col("_rep"), placed)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    lined = spread.withColumns({"_labels": F.collect_list(F.when(gives, F.col("_place"))).over(line.rangeBetween(Window.unboundedPreceding, -1)), "_row_heads": whole_row}).where(own)
    above = Window.partitionBy(*table).orderBy("row").rangeBetween(Window.unboundedPreceding, -1)
    full = F.col("_real") & (F.col("left") == 0) & (F.col("right") == F.col("width")) & ~F.col("header")
    last = F.max(F.when(is_head & F.col("_rep"), F.struct("row", F.size("_row_heads").alias("n"), F.col("_row_heads").alias("h")))).over(above)
    seen = lined.withColumns({"_last": last, "_every": F.collect_list(F.when(is_head & ~F.col("_rep"), placed)).over(above), "_group": F.max(F.when(full, F.struct("row", "id"))).over(above)})
    width = F.greatest(F.lit(1), F.col("right") - F.col("left"))
    share = lambda h: F.round((F.least("right", h.right) - F.greatest("left", h.left)) / width, 5)
    heads = F.when(F.col("_rep"), F.coalesce("_last.h", F.array().cast(lined.schema["_row_heads"].dataType))).otherwise(F.col("_every"))
    met = F.filter(heads, lambda h: (h.left < F.col("right")) & (F.col("left") < h.right) & (h.left < h.right) & (F.col("left") < F.col("right")))
    shared = F.array_sort(F.transform(met, lambda h: F.struct(h.row.alias("row"), h.left.alias("left"), h.id.alias("id"), (share(h) >= least).alias("binds"))))
    ids = lambda found: F.transform(found, lambda x: x.id)
    known = seen.select("*", shared.alias("_met"))
    none = F.array().cast(f"array<{kind}>")
    return known.select(
        *table, "id",
        F.when(F.col("_real"), ids(F.filter("_met", lambda x: x.binds))).otherwise(none).alias("headers"), F.when(F.col("_real"), ids(F.filter("_met", lambda x: ~x.binds))).otherwise(none).alias("slivers"),
        F.when(F.col("_real"), F.col("_group.id")).alias("group"), F.when(F.col("_real") & F.col("left").isNotNull(), ids(F.array_sort("_labels"))).otherwise(none).alias("labels"),
    )


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cell diff of two parses by anchor: added, removed, changed; critical if digits, signs or blankness differ."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    both = x.withColumn("_a", F.lit(True)).join(y.withColumn("_b", F.lit(True)), keys, "full")
    kind = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    facts = lambda c: F.concat_ws(" ", F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9.,]+|[<>=≤≥-]|\bnot?\b"), F.lit(0)))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")).isin("", "-", "–")
    critical = (facts(F.col("a")) != facts(F.col("b"))) | (blank(F.col("a")) != blank(F.col("b")))
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", critical.alias("critical"))


def continued_tables(tables: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``tables``: doc, order, number, page, continued, left, right, path -> adds ``continues``: the table continues the one before it."""
    w = Window.partitionBy(doc).orderBy(*order)
    before = {c: F.lag(c).over(w) for c in ("number", "page", "left", "right", "path")}
    near = lambda c: F.abs(F.col(c) - before[c]) < 0.015 * F.greatest(F.abs(before["right"] - before["left"]), F.lit(1e-9))
    link = F.col("continued") & (F.col("number") == before["number"]) & F.col("path").eqNullSafe(before["path"]) & (F.col("page") == before["page"] + 1) & near("left") & near("right")
    return tables.withColumn("continues", F.coalesce(link, F.lit(False)))


def append_records(stored: DataFrame, new: DataFrame, keys: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): an equal record again is nothing, the same key with other content is a conflict."""
    old = stored.select(*keys, F.col(digest).alias("_old"))
    joined = new.dropDuplicates([*keys, digest]).join(old, keys, "left")
    return joined.where(F.col("_old").isNull()).drop("_old"), joined.where(F.col("_old") != F.col(digest)).drop("_old")


def dangling_refs(refs: DataFrame, records: DataFrame, ref: str, key: str) -> DataFrame:
    return refs.join(records.select(F.col(key).alias("_key")), F.col(ref) == F.col("_key"), "left_anti")
