"""Ranked retrieval of many queries at once.

A set of queries that is counted to be small is broadcast: the corpus is then read once, each task scores its documents against all queries by matrix
products of bounded blocks and passes on its k best a query. Larger sets of queries go through joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from clausework.functions.arrow import small_batches
from clausework.functions.text import words
from clausework.sources.scratch import written

#: Query terms are broadcast up to this count; more are joined by a shuffle on the term.
BROADCAST_TERMS = 200_000
#: Numbers in the query vectors that are broadcast at most (8 bytes each); more meet the corpus in a join of blocks.
BROADCAST_NUMBERS = 8_000_000
#: Documents and queries of one matrix product.
DOCS, QUERIES = 512, 128
#: Numbers of a dense matrix of documents by terms at most (8 bytes each); wider ones are made some rows at a time.
NUMBERS = 1_000_000


def top(rows: DataFrame, key: str, score: str, tie: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each key by score rounded to six places, then the tie columns; adds ``rank`` from 1. Each task cuts to k before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.round(score, 6).desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _terms(df: DataFrame, key: str, terms: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.explode(terms).alias("term"))


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_TERMS else df


def _query_terms(queries: DataFrame, query: str, terms: str, most: int | None, cap: int) -> tuple[DataFrame, int]:
    """(query, term, qtf): of each query at most ``most`` distinct terms in their order, with counts capped; and their number."""
    cut = F.slice(F.array_distinct(terms), 1, most) if most else F.array_distinct(terms)
    q = queries.select(F.col(query).alias("query"), F.col(terms).alias("_all"), F.explode(cut).alias("term"))
    q = q.select("query", "term", F.least(F.lit(cap), F.size(F.array_compact(F.filter("_all", lambda x: x == F.col("term"))))).alias("qtf"))
    return q, q.count()


def bm25(queries: DataFrame, docs: DataFrame, query: str, doc: str, terms: str = "terms", k1: float = 1.5, b: float = 0.75, most: int = 100, cap: int = 2, weight: Column | None = None) -> DataFrame:
    """``query, doc, score`` of every document that shares a term with the query. Both sides have an array of terms.

    Only postings of query terms are counted; the corpus' size and mean length are one row of aggregates.
    """
    q, n_terms = _query_terms(queries, query, terms, most, cap)
    sized = docs.select(F.col(doc).alias("doc"), F.coalesce(F.size(terms), F.lit(0)).alias("len"), F.col(terms).alias("terms"))
    n, mean = sized.agg(F.count("*"), F.avg("len")).head()
    wanted = _small(q.select("term").distinct(), n_terms)
    tf = sized.select("doc", "len", F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = _small(q.join(df, "term").select("query", "term", (F.col("qtf") * idf * (weight if weight is not None else 1.0)).alias("w")), n_terms)
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
    return tf.join(weighted, "term").groupBy("query", "doc").agg(F.sum(part).alias("score"))


def tf_idf(queries: DataFrame, docs: DataFrame, query: str, doc: str, terms: str = "terms") -> DataFrame:
    """``query, doc, score``: ln(1 + n / (1 + df)) * tf / (1 + length / 60) over the distinct terms of a query."""
    q, n_terms = _query_terms(queries, query, terms, None, 1)
    n = docs.count()
    wanted = _small(q.select("term").distinct(), n_terms)
    tf = docs.select(F.col(doc).alias("doc"), F.size(terms).alias("len"), F.explode(terms).alias("term")).join(wanted, "term", "left_semi").groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.log(1 + F.lit(n) / (1 + F.count("*"))).alias("idf"))
    weighted = _small(q.join(df, "term"), n_terms)
    return tf.join(weighted, "term").groupBy("query", "doc").agg(F.sum(F.col("idf") * F.col("tf") / (1 + F.col("len") / 60)).alias("score"))


def _best(scores: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best rows of each column by score rounded to six places, then rank; minus infinity is out."""
    enough = scores > -np.inf
    if len(scores) > k:
        enough &= scores >= np.partition(scores, -k, axis=0)[-k] - 2e-6  # rounding moves a score by less
    at, of = np.nonzero(enough)
    order = np.lexsort((ranks[at], -np.round(scores[at, of], 6), of))
    at, of = at[order], of[order]
    first = np.searchsorted(of, np.arange(scores.shape[1]))
    keep = np.arange(len(of)) - first[of] < k
    return at[keep], of[keep]


def _ranks(keys: pa.Array) -> np.ndarray:
    out = np.empty(len(keys), np.int64)
    out[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
    return out


def _slices(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, DOCS) for batch in frames for i in range(0, batch.num_rows, DOCS))


def postings(docs: DataFrame, doc: str, terms: str, vocabulary: list[str]) -> DataFrame:
    """``doc, len, ids, tfs``: of each document its length and the counts of the terms of ``vocabulary`` it holds, by their place there. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))

    def run(frames):
        known = pa.array(held.value, pa.string())
        for batch in _slices(frames):
            lists = batch.column("terms")
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy()
            at = np.repeat(np.arange(len(length)), length)
            key, tf = np.unique((at * len(known) + ids)[ids >= 0], return_counts=True)
            bounds = pa.array(np.searchsorted(key, np.arange(len(length) + 1) * len(known)).astype(np.int32))
            own = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(length.astype(np.int32)), *own], ["doc", "len", "ids", "tfs"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, len int, ids array<int>, tfs array<int>")


def _scored_top(q: DataFrame, docs: DataFrame, doc: str, terms: str, k: int, idf: Callable, part: Callable, term_weight: Callable | None) -> DataFrame:
    """``query, doc, score, rank`` of the k best documents of each query. ``q``: query, term, qtf, counted to be few; ``idf(n, df)``; ``part(tf, len, mean)``."""
    asked: dict = {}
    for r in q.collect():
        asked.setdefault(r.query, []).append((r.term, r.qtf))
    vocabulary = sorted({t for own in asked.values() for t, _ in own if t is not None})
    place = {t: i for i, t in enumerate(vocabulary)}
    with small_batches(docs.sparkSession, DOCS):  # rows are as long as their texts
        found = written(postings(docs, doc, terms, vocabulary), "postings")
    n, mean = found.agg(F.count("*"), F.avg("len")).head()
    df = np.zeros(len(vocabulary))
    for r in found.select(F.explode("ids").alias("i")).groupBy("i").count().collect():  # at most one row a term
        df[r.i] = r["count"]
    weight = idf(n, df) * np.array([term_weight(t) if term_weight else 1.0 for t in vocabulary])
    blocks = []  # of queries: names, their terms' places, weights (term, query)
    names = sorted(asked)
    for i in range(0, len(names), QUERIES):
        part_of = names[i : i + QUERIES]
        own = np.array(sorted({place[t] for name in part_of for t, _ in asked[name] if t in place}), np.int64)
        w = np.zeros((len(own), len(part_of)))
        for j, name in enumerate(part_of):
            for t, qtf in asked[name]:
                if t in place:
                    w[np.searchsorted(own, place[t]), j] = qtf * weight[place[t]]
        blocks.append((part_of, own, w))
    held = docs.sparkSession.sparkContext.broadcast(blocks)
    kinds = q.schema["query"].dataType, found.schema["doc"].dataType

    def run(frames):
        for batch in _slices(frames):
            keys, length = batch.column("doc"), batch.column("len").to_numpy()
            at = np.repeat(np.arange(len(length)), pc.list_value_length(batch.column("ids")).to_numpy())
            ids, tf = (batch.column(c).flatten().to_numpy() for c in ("ids", "tfs"))
            value, ranks = part(tf, length[at], mean or 1.0), _ranks(keys)
            for part_of, own, w in held.value:
                column = np.searchsorted(own, ids)
                hit = (column < len(own)) & (own[np.minimum(column, max(0, len(own) - 1))] == ids) if len(own) else np.zeros(len(ids), bool)
                scores, held_by, of_hit, step = np.empty((len(length), len(part_of))), (w != 0).astype(np.float32), at[hit], max(1, NUMBERS // max(1, len(own)))
                for i in range(0, len(length), step):
                    a, z = np.searchsorted(of_hit, [i, i + step])
                    counts = np.zeros((min(step, len(length) - i), len(own)))
                    counts[of_hit[a:z] - i, column[hit][a:z]] = value[hit][a:z]
                    scores[i : i + step] = counts @ w
                    scores[i : i + step][(counts != 0).astype(np.float32) @ held_by == 0] = -np.inf  # shares no term
                rows, of = _best(scores, ranks, k)
                yield pa.RecordBatch.from_arrays([pa.array([part_of[j] for j in of], to_arrow_type(kinds[0])), keys.take(pa.array(rows)), pa.array(scores[rows, of])], ["query", "doc", "score"])

    best = found.mapInArrow(run, f"query {kinds[0].simpleString()}, doc {kinds[1].simpleString()}, score double")
    return top(best, "query", "score", ["doc"], k)


def bm25_top(queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int, terms: str = "terms", k1: float = 1.5, b: float = 0.75, most: int = 100, cap: int = 2, term_weight: Callable[[str], float] | None = None) -> DataFrame:
    """``query, doc, score, rank``: the k best documents of each query by ``bm25``, ties by document. ``term_weight`` gives a term's factor, as for fields.

    Nulls and empty term arrays share no term; a query without a term has no rows; an empty corpus gives none.
    """
    q, n_terms = _query_terms(queries, query, terms, most, cap)
    if n_terms > BROADCAST_TERMS:
        weight = F.udf(term_weight, "double")("term") if term_weight else None
        return top(bm25(queries, docs, query, doc, terms, k1, b, most, cap, weight), "query", "score", ["doc"], k)
    idf = lambda n, df: np.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, length, mean: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
    return _scored_top(q, docs, doc, terms, k, idf, part, term_weight)


def tf_idf_top(queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int, terms: str = "terms") -> DataFrame:
    """``query, doc, score, rank``: the k best documents of each query by ``tf_idf``, ties by document."""
    q, n_terms = _query_terms(queries, query, terms, None, 1)
    if n_terms > BROADCAST_TERMS:
        return top(tf_idf(queries, docs, query, doc, terms), "query", "score", ["doc"], k)
    return _scored_top(q, docs, doc, terms, k, lambda n, df: np.log(1 + n / (1 + df)), lambda tf, length, mean: tf / (1 + length / 60), None)


def neighbours(hits: DataFrame, blocks: DataFrame, doc: str, order: str, reach: int, section: Column | None = None) -> DataFrame:
    """Blocks within ``reach`` of a hit in the same section, with ``anchor`` true for hits. An equi-join on the neighbours' numbers, not a range join."""
    sec = section if section is not None else F.lit(0)
    around = hits.select(doc, F.col(order).alias("_hit"), sec.alias("_sec"), F.explode(F.sequence(F.col(order) - reach, F.col(order) + reach)).alias(order))
    near = blocks.withColumn("_own", sec).join(around, [doc, order]).where("_own = _sec")
    return near.groupBy(doc, order).agg(F.bool_or(F.col("_hit") == F.col(order)).alias("anchor"))


def dense_top(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, allowed: list[str] | None = None, salts: int = 64) -> DataFrame:
    """``query, key, score, rank``: the k nearest by cosine of each query, exact, ties by key. Columns ``allowed`` must be equal on both sides and are checked before ranking (null equals nothing).

    Rows with a null key or vector, and vectors of length zero or with a null or infinite number, are near to none and left out on both sides; vectors of different dimensions are never
    compared, so a query ranks vectors of its own dimension only. Query vectors are broadcast when
    they are counted to be at most ``BROADCAST_NUMBERS`` numbers; else blocks of them meet blocks of the corpus on (block, salt), so that no
    block of queries gathers the corpus in one task. Each matrix product passes on its k best a query.
    """
    allowed = allowed or []
    names = ["key", *allowed, "v"]
    clean = lambda df: df.select(F.col(key).alias("key"), *allowed, F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null and not exists(v, x -> x is null)")
    q, c = clean(queries), clean(corpus)
    kind, query_kind = (df.schema["key"].dataType.simpleString() for df in (c, q))
    shape = f"query {query_kind}, key {kind}, score double"
    arrow = to_arrow_type(q.schema["key"].dataType)

    def unit(lists: pa.Array) -> np.ndarray:
        v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
        with np.errstate(all="ignore"):
            return v / np.linalg.norm(v, axis=1, keepdims=True)

    def product(table_q, table_c) -> pa.RecordBatch:
        """The best of each query among the vectors of its dimension."""
        of_q, of_c = (pc.list_value_length(t["v"]).to_numpy(zero_copy_only=False) for t in (table_q, table_c))
        found = []
        for d in np.setdiff1d(np.intersect1d(of_q, of_c), [0]):
            same = [{n: t[n].filter(pa.array(sizes == d)) for n in names} for t, sizes in ((table_q, of_q), (table_c, of_c))]
            found += product_of_equal(*same).to_pylist() if len(np.unique(of_q)) > 1 else [product_of_equal(*same)]
        if len(found) == 1 and isinstance(found[0], pa.RecordBatch):
            return found[0]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in (("query", arrow), ("key", table_c["key"].type), ("score", pa.float64()))], ["query", "key", "score"])

    def product_of_equal(table_q, table_c) -> pa.RecordBatch:
        with np.errstate(all="ignore"):
            s = unit(table_c["v"]) @ unit(table_q["v"]).T
        s[~np.isfinite(s)] = -np.inf
        for name in allowed:
            a, b = (np.array(t[name].to_pylist(), object) for t in (table_c, table_q))
            s[(a[:, None] != b[None, :]) | np.equal(a, None)[:, None]] = -np.inf
        rows, of = _best(s, _ranks(table_c["key"]), k)
        return pa.RecordBatch.from_arrays([pa.array(table_q["key"].take(pa.array(of)), arrow), table_c["key"].take(pa.array(rows)), pa.array(s[rows, of])], ["query", "key", "score"])

    if q.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).head()[0] <= BROADCAST_NUMBERS:
        asked = q.toArrow().combine_chunks()
        blocks = [{n: part[n].combine_chunks() for n in names} for i in range(0, asked.num_rows, QUERIES) for part in [asked.slice(i, QUERIES)]]
        held = queries.sparkSession.sparkContext.broadcast(blocks)

        def run(frames):
            for batch in _slices(frames):
                for block in held.value:
                    yield product(block, {n: batch.column(n) for n in names})

        return top(c.mapInArrow(run, shape), "query", "score", ["key"], k)

    item = F.struct(*names)
    number = lambda n: F.spark_partition_id().cast("long") * (1 << 20) + F.floor(F.monotonically_increasing_id() % (1 << 33) / n)
    packed = lambda df, n: df.withColumn("block", number(n)).groupBy("block").agg(F.collect_list(item).alias("items"))
    qs = written(packed(q, QUERIES), "query-blocks")
    places = qs.select(F.col("block").alias("_b"), F.row_number().over(Window.orderBy("block")).alias("place"))  # numbers only
    qs = qs.join(places, F.col("block") == F.col("_b")).select(F.col("place").alias("block"), "items")
    n_blocks = qs.count()
    cs = packed(c, DOCS).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).select("salt", F.col("items").alias("cs"), F.explode(F.sequence(F.lit(1), F.lit(n_blocks))).alias("block"))
    pairs = cs.join(qs.select("block", F.col("items").alias("qs"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), ["block", "salt"]).select("qs", "cs")

    def meet(frames):
        for batch in frames:
            for i in range(batch.num_rows):
                sides = [pa.RecordBatch.from_struct_array(batch.column(n).slice(i, 1).flatten()) for n in ("qs", "cs")]
                yield product(*[{n: side.column(n) for n in names} for side in sides])

    return top(pairs.mapInArrow(meet, shape), "query", "score", ["key"], k)


def fuse(routes: list[DataFrame], exact: DataFrame | None = None, k: int = 60) -> DataFrame:
    """``query, doc, score, exact``: reciprocal rank fusion of routes (query, doc, rank from 1); exact hits come first."""
    every = routes[0].select("query", "doc", "rank")
    for r in routes[1:]:
        every = every.unionByName(r.select("query", "doc", "rank"))
    out = every.groupBy("query", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    if exact is None:
        return out.withColumn("exact", F.lit(False))
    return out.join(exact.select("query", "doc", F.lit(True).alias("exact")).distinct(), ["query", "doc"], "full").select("query", "doc", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("exact", F.lit(False)).alias("exact"))


def context_relevance(j: DataFrame, short_clause: str, note: str) -> Column:
    """Relevance of a candidate: cover of the query's distinct ``terms`` by body, title and heading, the wanted template, the record's kind, penalties for bare clause
    numbers, notes and near-empty bodies, the lexical place ``lexical`` and the dense place ``dense`` (from 0, null where a route missed it).

    ``j``: terms, body_terms, title_terms, heading_terms, body, template, wanted (null: any), card (whether it is a requirement or a definition), lexical, dense.
    """
    den = F.greatest(F.size("terms"), F.lit(1))
    met = lambda field: F.size(F.array_intersect("terms", field))
    score = 4 * met("body_terms") / den + 1.3 * met("title_terms") / den + 0.6 * met("heading_terms") / den
    score += F.when(F.col("wanted").isNull(), 0.0).when(F.col("template") == F.col("wanted"), 2.5).when(F.col("template").isNotNull(), -0.9).otherwise(-0.15)
    score += F.when(F.col("card"), 0.15).otherwise(0.0)
    score -= F.when((F.length("body") < 100) & F.rlike("body", F.lit(short_clause)), 1.4).otherwise(0.0)
    score -= F.when(F.startswith("body", F.lit(note)) & (met("body_terms") < 2), 1.0).otherwise(0.0)
    score -= F.when(F.length(F.trim("body")) < 8, 1.0).otherwise(0.0)
    return score + F.coalesce(1 / (F.col("lexical") + 1), F.lit(0.0)) + F.coalesce(0.45 / (F.col("dense") + 1), F.lit(0.0))


def context_candidates(lexical: DataFrame, exact: DataFrame, dense: DataFrame) -> DataFrame:
    """``query, doc, lexical, dense, exact`` of three routes (query, doc, place from 0). Exact hits stand behind all lexical ones of their query, also where both found them."""
    n = lexical.groupBy(F.col("query").alias("_q")).agg(F.count("*").alias("_n"))
    behind = exact.join(n, F.col("query") == F.col("_q"), "left").select("query", "doc", (F.coalesce("_n", F.lit(0)) + F.col("place")).alias("_behind"))
    both = lexical.join(behind, ["query", "doc"], "full").select("query", "doc", F.coalesce("_behind", "place").alias("lexical"), F.col("_behind").isNotNull().alias("exact"))
    every = both.join(dense.withColumnRenamed("place", "dense"), ["query", "doc"], "full")
    return every.select("query", "doc", "lexical", "dense", F.coalesce("exact", F.lit(False)).alias("exact"))


def context_bundle(hits: DataFrame, lines: DataFrame, doc: str, order: str, list_item: str, cue: str, most: int = 16, size: int = 10_000) -> DataFrame:
    """``doc, hit, items, chars, truncated, complete, lines``: what belongs to a hit.

    ``hits``: doc, hit, roots (terms of the query); ``lines``: doc, order, heading, text, terms. Lines within two places under the same heading belong to it if they share a term with the
    query or begin with a cue. A hit that is a list item or ends with a colon brings its list: back over up to 13 list items to a lead-in that ends with a
    colon, from there on up to 18 lines, as long as they are list items or begin with a cue; a longer list makes the bundle incomplete. At most ``most`` lines
    and ``size`` characters in the order of the text; a bundle that passes either is truncated.

    A hit's line finds its stop, its break and the lines around it in windows over its document, so a line is shuffled once or twice and not once for each of the 32 places around it.
    """
    item = lambda c: F.coalesce(F.rlike(c, F.lit(list_item)), F.lit(False))
    cued = lambda c: F.coalesce(F.rlike(c, F.lit(cue)), F.lit(False))
    colon = lambda c: F.coalesce(F.rlike(c, F.lit(r":\s*$")), F.lit(False))
    asked = hits.select(doc, F.col("hit").alias(order), "roots", F.lit(True).alias("_hit"))
    near = lines.join(asked, [doc, order], "left")
    listed, broken = item("text") & ~colon("text"), ~(item("text") | cued("text"))
    near = near.select(doc, order, "heading", "terms", "roots", "_hit", F.length("text").alias("_size"), cued("text").alias("_cued"), colon("text").alias("_colon"), listed.alias("_listed"), broken.alias("_broken"), (item("text") | colon("text")).alias("_walks"))
    at, w = F.col(order), Window.partitionBy(doc).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gap, hole = at - F.lag(order).over(w) != 1, F.lead(order).over(w) - at != 1  # lines that are missing stop and break as others do
    near = near.withColumn("_gap", F.when(F.coalesce(gap, F.lit(True)), at - 1)).withColumn("_hole", F.when(F.coalesce(hole, F.lit(True)), at + 1))
    stop = F.max(F.when(~F.col("_listed"), F.struct(at.alias("at"), F.col("_colon").alias("colon")))).over(before)
    near = near.withColumn("_stop", stop).withColumn("_missing", F.max("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.least(F.min(F.when(F.col("_broken"), at)).over(w.rangeBetween(1, 18)), F.min("_hole").over(w.rangeBetween(0, 18)))
    near = near.withColumn("_next", F.coalesce(later, at + 19))
    item_of = lambda *c: F.collect_list(F.struct(at.alias("at"), F.col("_size").alias("size"), *c))
    beside = item_of(F.col("heading").alias("heading"), F.col("_cued").alias("cued"), F.col("terms").alias("terms")).over(w.rangeBetween(-2, 2))
    near = near.withColumn("_beside", beside).withColumn("_around", item_of().over(w.rangeBetween(-13, 18))).where("_hit")
    last_stop = F.greatest(F.col("_stop.at"), F.col("_missing"))
    far = at - last_stop > 13
    leads = ~far & F.coalesce((F.col("_stop.at") == last_stop) & F.col("_stop.colon"), F.lit(False))
    near = near.withColumn("_lead", F.when(far, at - 13).when(leads, last_stop).otherwise(last_stop + 1))
    near = near.withColumn("_break", F.when((F.col("_lead") < at) & F.col("_broken"), at).otherwise(F.col("_next")))
    last = F.col("_lead") + 18
    near = near.withColumns({"_cut": F.col("_walks") & (F.col("_break") > last), "_end": F.when(F.col("_walks"), F.least("_break", last)).otherwise(F.col("_lead"))})
    belongs = lambda x: (x["at"] != at) & x["size"].isNotNull()
    by_list = F.filter("_around", lambda x: belongs(x) & (x["at"] >= F.col("_lead")) & (x["at"] < F.col("_end")))
    by_place = F.filter("_beside", lambda x: F.coalesce(belongs(x) & (x["heading"] == F.col("heading")) & (x["cued"] | F.arrays_overlap("roots", x["terms"])), F.lit(False)))
    members = F.array_sort(F.array_union(by_list, F.transform(by_place, lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size")))))
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<string>").alias("out"))

    def take(a, x):  # the running size counts those that don't fit, too
        run = a.run + x["size"]
        fits = (run <= size) & (F.size(a.out) < most)
        return F.struct(run.alias("run"), F.when(fits, run).otherwise(a.chars).alias("chars"), F.when(fits, F.array_append(a.out, x["at"].cast("string"))).otherwise(a.out).alias("out"))

    near = near.withColumn("_members", members).withColumn("_kept", F.aggregate("_members", start, take))
    items = F.size("_kept.out").cast("long")
    truncated = F.size("_members") > items
    return near.select(doc, at.alias("hit"), items.alias("items"), F.col("_kept.chars").alias("chars"), truncated.alias("truncated"), (~F.col("_cut") & ~truncated).alias("complete"), F.array_join("_kept.out", ",").alias("lines"))


def row_context(hits: DataFrame, cells: DataFrame, table: str, most: int = 24) -> DataFrame:
    """``table, row, column, peers, complete``: of each hit cell the other cells of its row and the header cell of its column, at most ``most`` in the order of the table. ``cells``: table, row, column.

    Peers are counted from the columns of a row and of the header row, so cells never meet each other and rows are shuffled, not pairs. Null places have none."""
    h = hits.groupBy(table, "row").agg(F.collect_list(F.struct("column")).alias("_hits"))
    rows = cells.where(F.col("row").isNotNull() & F.col("column").isNotNull()).groupBy(table, "row").agg(F.collect_set("column").alias("_cells"))
    heads = rows.where("row = 1").select(table, F.col("_cells").alias("_heads"))
    j = h.join(rows, [table, "row"], "left").join(heads, table, "left").select(table, "row", "_cells", "_heads", F.inline("_hits"))
    held = lambda c: F.coalesce(F.array_contains(c, F.col("column")).cast("int"), F.lit(0))
    beside = F.coalesce(F.array_size("_cells"), F.lit(0)) - held("_cells") + F.when(F.col("row") != 1, held("_heads")).otherwise(0)
    n = F.when(F.col("column").isNotNull(), beside).otherwise(0)
    return j.select(table, "row", "column", F.least(n, F.lit(most)).cast("long").alias("peers"), (n <= most).alias("complete"))


def route_rules(rules: DataFrame, blocks: DataFrame, front: str, stop: str, definitions: str, acronym: str, quoted: Column, least: float = 0.7, first: int = 120, k: int = 8, reach: int = 1) -> DataFrame:
    """``doc, rule, ord, via``: the blocks of its document that a rule is checked on, and the sorted ways that led there.

    ``rules``: doc, rule, number (null: none), expected (text), terms (distinct words of the expected text); ``blocks``: doc, ord, section, text. A section's first block is its title, its
    number the section's place from 1. ``section``: all blocks of sections of the rule's number or whose title holds at least ``least`` of its terms. ``front``: the first ``first`` blocks up to one
    that matches ``stop``, for rules without a number whose text matches ``front``. ``definition``: blocks of sections titled like ``definitions`` that hold an acronym of a ``quoted`` block.
    ``index``: the k best blocks of the document by TF-IDF, with neighbours within ``reach`` in their section.

    Texts are shuffled once, by document, to meet the rules; what each block shows of a rule is taken there, and the rest are windows over those narrow rows, dealt as they are.
    """
    tokens = lambda c: F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_-]+"), F.lit(0)), lambda x: x.rlike(acronym))
    of_quoted = blocks.withColumn("_quoted", quoted).where("_quoted").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list(tokens("text")))).alias("_quotes"))  # an explode would cut tokens before the filter
    is_front = F.coalesce(F.col("number").isNull() & F.rlike("expected", F.lit(front)), F.lit(False))
    r = rules.select("doc", "rule", "number", F.col("terms").alias("_asked"), is_front.alias("_front")).join(of_quoted, "doc", "left")
    read = blocks.withColumn("_quoted", quoted).join(r.hint("merge"), "doc").withColumn("_terms", words("text"))
    met = read.withColumn("_met", F.array_intersect("_asked", "_terms"))
    cover = F.size("_met") / F.greatest(F.size("_asked"), F.lit(1))
    held = F.when(F.col("_quotes").isNotNull() & ~F.col("_quoted"), F.arrays_overlap(tokens("text"), "_quotes"))
    shown = met.select(
        "doc", "rule", "ord", "section", "_front", F.size("_terms").alias("_len"),
        F.coalesce((F.col("section") + 1 == F.col("number")) | (cover >= least), F.lit(False)).alias("_same"),
        F.coalesce(F.when(F.col("_front") & (F.col("ord") < first), F.rlike("text", F.lit(stop))), F.lit(False)).alias("_stop"),
        F.coalesce(F.when(F.col("_quotes").isNotNull(), F.rlike("text", F.lit(definitions))), F.lit(False)).alias("_defines"),
        F.coalesce(held, F.lit(False)).alias("_held"),
        F.transform("_met", lambda x: F.struct(x.alias("term"), (F.size("_terms") - F.size(F.array_remove("_terms", x))).alias("tf"))).alias("_met"),
    )

    whole, flags = Window.partitionBy("doc", "rule"), ["_front", "_same", "_stop", "_defines", "_held"]
    hit = shown.select("doc", "rule", "ord", "section", "_len", *flags, F.posexplode_outer("_met").alias("_i", "_m")).withColumns({"term": F.col("_m.term"), "tf": F.col("_m.tf")})
    counted = hit.withColumns({"_df": F.count("term").over(Window.partitionBy("doc", "rule", "term")), "_blocks": F.count(F.when(F.coalesce("_i", F.lit(0)) == 0, 1)).over(whole)})
    part = F.log(1 + F.col("_blocks") / (1 + F.col("_df"))) * F.col("tf") / (1 + F.col("_len") / 60)
    scored = counted.groupBy("doc", "rule", "ord", "section").agg(F.sum(part).alias("score"), *[F.bool_or(f).alias(f) for f in flags])
    place = F.row_number().over(whole.orderBy(F.round("score", 6).desc_nulls_last(), "ord"))
    best = scored.select("*", (F.col("score").isNotNull() & (place <= k)).alias("_best"), F.min(F.when(F.col("_stop"), F.col("ord"))).over(whole).alias("_end"))
    section = Window.partitionBy("doc", "rule", "section").orderBy("ord")
    ways = {
        "definition": F.col("_held") & F.first("_defines").over(section),
        "front": F.col("_front") & (F.col("ord") < F.coalesce("_end", F.lit(first))),
        "index": F.max("_best").over(section.rangeBetween(-reach, reach)),
        "section": F.first("_same").over(section),
    }
    found = best.select("doc", "rule", "ord", F.array_compact(F.array(*[F.when(way, F.lit(name)) for name, way in ways.items()])).alias("via"))
    return found.where(F.size("via") > 0).select("doc", "rule", "ord", F.array_join("via", ",").alias("via"))


def covering_titles(rules: DataFrame, sections: DataFrame, least: float = 0.7) -> DataFrame:
    """``rules``: rule, terms; ``sections``: section, terms -> pairs in which the section holds at least ``least`` of the rule's distinct terms.

    Pairs meet on the rule's rarest terms only: a section that lacks all of the n - ceil(least * n) + 1 rarest can't cover enough.
    """
    r = rules.select("rule", F.array_distinct("terms").alias("t")).where(F.size("t") > 0)
    s = sections.select("section", F.array_distinct("terms").alias("st"))
    df = s.select(F.explode("st").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    flat = r.select("rule", F.size("t").alias("n"), F.explode("t").alias("term")).join(df, "term", "left")
    w = Window.partitionBy("rule").orderBy(F.coalesce("df", F.lit(0)), "term")
    rare = flat.withColumn("i", F.row_number().over(w)).where(F.col("i") <= F.col("n") - F.ceil(least * F.col("n")) + 1).where("df is not null")
    found = rare.select("rule", "term").join(s.select("section", F.explode("st").alias("term")), "term").select("rule", "section").distinct()
    j = found.join(r, "rule").join(s, "section")
    cover = F.size(F.array_intersect("t", "st")) / F.size("t")
    return j.select("rule", "section", F.round(cover, 6).alias("cover")).where(F.col("cover") >= least)


def interleave(rows: DataFrame, area: str, order: str, size: str, budget: int) -> DataFrame:
    """Areas take turns, each in its own order, while the running size stays within the budget.

    A row whose own area alone passes the budget before it can't be taken, so only a bounded head of each area meets in the last window.
    """
    w = Window.partitionBy(area).orderBy(order)
    own = rows.withColumn("turn", F.row_number().over(w)).withColumn("_own", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_own") <= budget).drop("_own")
    run = F.sum(size).over(Window.orderBy("turn", area).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("running", run).where(F.col("running") <= budget)


def greedy_selection(rows: DataFrame, key: str, order: list[str], size: str, budget: int, most: int, item: str) -> DataFrame:
    """``key, item``: in order, take what still fits the budget, skip what doesn't, at most ``most``. One fold per key over sizes."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(size).cast("long").alias("_s"), F.col(item).alias("_i")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{rows.schema[item].dataType.simpleString()}>").alias("out"))

    def step(a, x):
        fits = (a.used + x["_s"] <= budget) & (F.size(a.out) < most)
        return F.struct(F.when(fits, a.used + x["_s"]).otherwise(a.used).alias("used"), F.when(fits, F.array_append(a.out, x["_i"])).otherwise(a.out).alias("out"))

    return listed.select(key, F.explode(F.aggregate("l", start, step, lambda a: a.out)).alias(item))


def checked_labels(answers: DataFrame, key: list[str], labels: str, sources: str) -> DataFrame:
    """``key, used, unknown``: labels of an answer that are in its list of sources, and those that aren't."""
    return answers.select(*key, F.array_sort(F.array_intersect(labels, sources)).alias("used"), F.array_sort(F.array_except(labels, sources)).alias("unknown"))


def confirmed_answers(answers: DataFrame, text: str, sources: str, label: str = r"\[(S[0-9]+)\]", instead: str = "[source not confirmed]") -> DataFrame:
    """Adds ``answer`` (labels in brackets that aren't in the list ``sources`` are replaced, confirmed ones stay) and ``used`` (the confirmed ones, sorted). ``label`` has one group, the label's name, within
    square brackets. A null text gives a null answer, a null list confirms nothing."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(label), F.lit(1)))
    known = F.coalesce(sources, F.array().cast("array<string>"))
    swap = lambda a, x: F.replace(a, F.concat(F.lit("["), x, F.lit("]")), F.lit(instead))
    return answers.withColumns({"answer": F.aggregate(F.array_except(found, known), F.col(text), swap), "used": F.array_sort(F.array_intersect(found, known))})
