"""Operator 2: near-duplicates by ProbMinHash, banding and exact verification.

A text is the weighted set of its shingles of five words. Every shingle sends a Poisson process of arrivals, of a rate equal to its weight, into
``BANDS * ROWS`` registers; a register keeps its earliest arrival and the shingle it came from. The processes advance in turns and stop
as soon as an arrival is later than the latest register, so a text costs little more than one arrival a shingle. Two texts agree in a
register with the probability of their probability Jaccard similarity. A shingle that stands n times in a text weighs ``1.5 - 0.5 / n`` (``weights="damped"``, the
default): repeats count, but at most half as much again, so that two texts of like sets stay candidates of each other however often one repeats its parts. ``"count"`` takes plain
multiplicities, ``"set"`` weighs all shingles alike. Candidates are then verified by the exact Jaccard similarity of their sets of shingles (by probability Jaccard for ``"count"``).

1. Texts of equal word sequences are one node from the start (SHA-based digest of the words).
2. Nodes that agree in all registers of a band are linked to the band's least node; the connected components of these links are clusters of candidates.
   A pair of probability Jaccard similarity 0.8 shares a band with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.9999. Of set similarity 0.8 with repeats on one side only, the
   probability Jaccard similarity is at least 0.72 and the probability of a band at least 0.98.
3. Within each cluster pairs are verified exactly: shingle sets meet in blocks of bounded size, intersections of all pairs of two blocks come from a
   product of two incidence matrices, and only the links of a spanning forest leave a task. Blocks hold sets of like size, because sets whose sizes
   differ by more than the least similarity can't be similar. A cluster that fits one block is one task. Of a larger one, each text is first compared
   with the ``HEADS`` heads that it shares most bands with, which is linear; only components that these links leave in a band with others go on, and there only
   blocks of different components meet.
4. The connected components of the verified links are the classes.

The work of step 3 grows with the square of a cluster only in components that share a band and that their heads don't join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.components import components
from clausework.llm.util import materialise, only_columns
from clausework.llm.words import batches, mix, words

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 6
#: Shingles of one block, and texts of one block, at most (a larger text stands alone).
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 512
#: Heads that each text of a large cluster is compared with first.
HEADS = 3
#: Facts about large clusters and their blocks up to this many rows are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_FACTS = 200_000
_FIRST = np.uint64(0x9E3779B97F4A7C15)
_PRIMES = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(column: pa.Array, length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, count) of the distinct shingles of each text, ordered, and their n+1 bounds. A text of fewer words is one shingle of all of them."""
    w = words(column)
    at, n = w.bounds, len(column)
    h = w.hash(w.start, w.end)
    counts = np.diff(at)
    doc = np.repeat(np.arange(n), counts)
    last = len(h) - length + 1
    begin = np.flatnonzero(doc[: max(0, last)] == doc[length - 1 :]) if last > 0 else np.zeros(0, np.int64)
    value = np.zeros(len(begin), np.uint64)
    for k in range(length):
        value = mix((value + h[begin + k]) * _FIRST + _PRIMES[k % 5])
    few = np.flatnonzero((counts > 0) & (counts < length))
    short = np.zeros(len(few), np.uint64)
    for k in range(length - 1):
        has = counts[few] > k
        short[has] = mix((short[has] + h[at[few[has]] + k]) * _FIRST + _PRIMES[(k + 1) % 5])
    doc, value = np.concatenate([doc[begin], few]), np.concatenate([value, short])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first], np.diff(np.append(first, len(doc))), np.searchsorted(doc[first], np.arange(n + 1))


def registers(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash registers of n texts: n x m hashes of the shingles that arrived first."""
    q = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    doc, x, h, rate = doc.astype(np.int64), np.zeros(len(doc)), value, 1.0 / weight
    turn = 0
    while len(doc):
        turn += 1
        a = mix(h + np.uint64(turn * int(_FIRST) % 2**64))
        b = mix(a ^ _PRIMES[0])
        x = x - np.log(((a >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * rate
        slot = doc * m + ((b >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        earlier = np.flatnonzero(x < q[slot])
        if len(earlier):
            order = earlier[np.lexsort((h[earlier], x[earlier], slot[earlier]))]
            s = slot[order]
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            q[s[keep]], who[s[keep]] = x[order[keep]], h[order[keep]]
        live = x < q.reshape(n, m).max(1)[doc]
        doc, x, h, rate = doc[live], x[live], h[live], rate[live]
    return who.reshape(n, m)


def word_digest(text: Column) -> Column:
    """Hex of the first 16 bytes of the SHA-256 of the words, joined by one space; the same as the digest of ``sketch``."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.substring(F.sha2(F.trim(spaced), 256), 1, 32)


def sketch(docs: DataFrame, text: str = "text", id_col: str = "doc_id", weights: str = "damped", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, digest`` (16 bytes of the SHA-256 of the word sequence), ``shingles`` (number) and ``bands`` (hashes) of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(frames):
        for batch, column in batches(frames, "text"):
            doc, value, count, _ = shingles(column)
            n = len(column)
            weight = {"set": np.ones_like, "count": np.array, "damped": lambda c: 1.5 - 0.5 / c}[weights](count.astype(float))
            r = registers(doc, value, weight, n, bands * rows).reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _FIRST, (n, bands))
            for k in range(rows):
                key = mix((key + r[:, :, k]) * _PRIMES[k % 5])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
            sizes = np.bincount(doc, minlength=n)
            digests = [hashlib.sha256(b" ".join(t.encode().split())).digest()[:16] for t in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "digest", "shingles", "bands"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, digest binary, shingles long, bands array<long>")


def shingle_sets(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``digest``, ``hashes`` and ``counts`` (little-endian uint64 and uint32 of the distinct shingles) of every row."""
    source = docs.select(*keep, F.col(text).alias("_text"))

    def run(frames):
        for batch, column in batches(frames, "_text"):
            _, value, count, at = shingles(column)
            digests = [hashlib.sha256(b" ".join(t.encode().split())).digest()[:16] for t in column.to_pylist()]
            pieces = list(zip(at, at[1:]))
            new = [pa.array(digests, pa.binary()), pa.array([value[a:b].tobytes() for a, b in pieces], pa.binary()), pa.array([count[a:b].astype(np.uint32).tobytes() for a, b in pieces], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], [*keep, "digest", "hashes", "counts"])

    schema = ", ".join([*[f"{c} {source.schema[c].dataType.simpleString()}" for c in keep], "digest binary, hashes binary, counts binary"])
    return source.mapInArrow(run, schema)


def similarities(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], weights: str) -> np.ndarray:
    """Exact similarity of each text of a with each of b (shingles, counts)."""
    if weights == "count":
        out = np.zeros((len(a), len(b)))
        for i, (x, p) in enumerate(a):
            for j, (y, q) in enumerate(b):
                _, s, t = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                u, v = p / p.sum(), q / q.sum()
                both = u[s] / v[t]  # sum over shared d of 1 / sum over d' of max(u[d'] / u[d], v[d'] / v[d])
                order = np.argsort(both)
                r = both[order]
                # sum of max(u', v' r) over all d' for ratio r = u[d] / v[d], by prefix sums over the shared shingles' own ratios
                uc, vc = np.append(0, np.cumsum(u[s][order])), np.append(0, np.cumsum(v[t][order]))
                k = np.searchsorted(r, r, side="right")
                most = (uc[-1] - uc[k]) + r * vc[k] + (1 - uc[-1]) + r * (1 - vc[-1])
                out[i, j] = (u[s][order] / most).sum()
        return out
    flat_a, flat_b = np.concatenate([x for x, _ in a]), np.concatenate([x for x, _ in b])
    shared = np.intersect1d(flat_a, flat_b)
    na, nb = np.array([len(x) for x, _ in a]), np.array([len(x) for x, _ in b])
    row_a, row_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    col_a, col_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
    hit_a = (col_a < len(shared)) & (shared[np.minimum(col_a, max(0, len(shared) - 1))] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
    hit_b = (col_b < len(shared)) & (shared[np.minimum(col_b, max(0, len(shared) - 1))] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
    row_a, col_a, row_b, col_b = row_a[hit_a], col_a[hit_a], row_b[hit_b], col_b[hit_b]
    common = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, len(shared), 4096):  # blocks of columns bound the memory
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        p, q = (col_a >= c) & (col_a < c + 4096), (col_b >= c) & (col_b < c + 4096)
        x[row_a[p], col_a[p] - c], y[row_b[q], col_b[q] - c] = 1, 1
        common += x @ y.T
    return common / (na[:, None] + nb[None, :] - common)


def forest(rows: list[tuple[bytes, np.ndarray, np.ndarray]], side: list[int], weights: str, least: float) -> list[tuple[bytes, bytes]]:
    """Verified links (a spanning forest of all of them) as pairs of digests.

    ``side``: a row's block; pairs within the block 0 and between 0 and 1 are compared, or all if there is one block.
    """
    rows = sorted(zip(side, rows), key=lambda r: (r[0], r[1][0]))
    parts = [[r for s, r in rows if s == k] for k in (0, 1)]
    items = parts[0] + parts[1]
    root = list(range(len(items)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(x, y, at_x, at_y):
        if not x or not y:
            return
        sims = similarities([(r[1], r[2]) for r in x], [(r[1], r[2]) for r in y], weights)
        for i, j in zip(*np.nonzero(sims >= least - 1e-6), strict=True):
            p, q = find(int(i) + at_x), find(int(j) + at_y)
            if p != q:
                root[max(p, q)] = min(p, q)

    if parts[1]:
        unite(parts[0], parts[1], 0, len(parts[0]))
    else:
        unite(parts[0], parts[0], 0, 0)
    return [(items[i][0], items[r][0]) for i in range(len(items)) if (r := find(i)) != i]


def _met(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with written ``facts``, which are broadcast when they are counted to be few: a hot key of ``rows`` then stays where it is."""
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_FACTS else facts, on, how)


def _deal(items: DataFrame, key: list[str]) -> DataFrame:
    """``key, n``: the number of blocks that the shingles and texts of each key need."""
    need = F.greatest(F.sum("shingles") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)
    return materialise(items.groupBy(*key).agg(F.ceil(need).cast("int").alias("n")), "blocks")


def star_tasks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs``: digest, head -> tasks in which each head (side 0) meets a block of its texts (side 1)."""
    dealt = _deal(pairs.join(sets.select("digest", "shingles"), "digest"), ["head"])
    name = F.sha2(F.concat_ws(":", F.hex("head"), "block"), 256).cast("binary").alias("task")
    placed = _met(pairs, dealt, ["head"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("n")).cast("int"))
    others = placed.join(sets.select("digest", "hashes", "counts"), "digest")
    heads = dealt.join(sets.select(F.col("digest").alias("head"), "hashes", "counts"), "head").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return others.select(name, F.lit(1).alias("side"), "digest", "hashes", "counts").unionByName(heads.select(name, F.lit(0).alias("side"), F.col("head").alias("digest"), "hashes", "counts"))


def block_tasks(members: DataFrame) -> DataFrame:
    """``members``: cluster, part, digest, shingles, hashes, counts -> tasks of two blocks of a cluster, or of one with itself.

    Blocks are cut by size class (sizes within a factor of the least similarity), ``part`` and hash. Texts of one part, unless it is null, are known to be
    of one class, so they don't meet each other.
    """
    width = F.floor(F.log(F.greatest(F.col("shingles"), F.lit(1))) / F.lit(-np.log(SIMILARITY))).cast("int")
    classed = members.withColumn("k", width).withColumn("part", F.coalesce("part", F.lit(b"")))
    blocks = _deal(classed, ["cluster", "k", "part"])
    near = blocks.alias("a").join(blocks.alias("b"), (F.col("a.cluster") == F.col("b.cluster")) & (F.col("b.k") - F.col("a.k")).between(0, 1))
    near = near.select(F.col("a.cluster").alias("cluster"), *[F.col(f"{t}.{c}").alias(f"{c}{t}") for t in "ab" for c in ("k", "part", "n")])
    near = near.where("not (parta = partb and parta != X'') and (ka < kb or parta <= partb)")
    near = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    near = near.where("ka < kb or parta < partb or i <= j")
    near = near.withColumn("task", F.sha2(F.concat_ws(":", F.hex("cluster"), "ka", F.hex("parta"), "i", "kb", F.hex("partb"), "j"), 256).cast("binary"))
    same = (F.col("ka") == F.col("kb")) & (F.col("parta") == F.col("partb")) & (F.col("i") == F.col("j"))
    side = lambda t, block, n: [F.col("cluster"), "task", F.col(f"k{t}").alias("k"), F.col(f"part{t}").alias("part"), F.col(block).alias("block"), F.lit(n).alias("side")]
    sides = near.select(*side("a", "i", 0)).unionByName(near.where(~same).select(*side("b", "j", 1)))
    placed = _met(classed, blocks, ["cluster", "k", "part"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("n")).cast("int"))
    return placed.join(sides, ["cluster", "k", "part", "block"]).select("task", "side", "digest", "hashes", "counts")


def compare(tasks: DataFrame, weights: str, least: float) -> DataFrame:
    """Links ``u, v`` that join all similar pairs of each task."""

    def run(group: pa.Table) -> pa.Table:
        rows = [(d, np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)) for d, h, c in zip(*(group.column(c).to_pylist() for c in ("digest", "hashes", "counts")), strict=True)]
        links = forest(rows, group.column("side").to_pylist(), weights, least)
        return pa.table({"u": pa.array([a for a, _ in links], pa.binary()), "v": pa.array([b for _, b in links], pa.binary())})

    return tasks.groupBy("task").applyInArrow(run, "u binary, v binary")


def head_links(banded: DataFrame) -> DataFrame:
    """``banded``: digest, key -> ``digest, head, n``: each digest with the least ones of its keys, but not with itself, and the number of keys they share."""
    heads = banded.groupBy("key").agg(F.min("digest").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    return banded.join(heads, "key").where("digest != head").groupBy("digest", "head").agg(F.count("*").alias("n"))


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("digest").alias("u"), F.col("head").alias("v"))


def verified_links(members: DataFrame, pairs: DataFrame, weights: str = "damped", least: float = SIMILARITY) -> DataFrame:
    """``members``: cluster, digest, shingles, bands, hashes, counts; ``pairs``: ``head_links`` of all of them -> links ``u, v`` that join all similar pairs that share a band."""
    sums = members.groupBy("cluster").agg(F.sum("shingles").alias("_sum"), F.count("*").alias("_n"))
    large = materialise(sums.where((F.col("_sum") > BLOCK_SHINGLES) | (F.col("_n") > BLOCK_TEXTS)).select("cluster"), "large")
    small = _met(members, large, ["cluster"], "left_anti").select(F.col("cluster").alias("task"), F.lit(0).alias("side"), "digest", "hashes", "counts")
    links = compare(small, weights, least)
    if large.isEmpty():
        return links
    sets = materialise(_met(members, large, ["cluster"], "left_semi"), "large-members")
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("digest").orderBy(F.col("n").desc(), "head"))).where(F.col("_n") <= HEADS)
    best = materialise(best.select("digest", "head").join(sets.select("digest"), "digest", "left_semi"), "stars")
    star = materialise(compare(star_tasks(best, sets), weights, least), "star-links")
    links = links.unionByName(star)
    found = components(star).select(F.col("node").alias("digest"), "root")
    rooted = materialise(sets.drop("cluster").join(found, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "rooted")
    # components that share a band, as one row each: from here on a settled component is a node
    met = head_links(rooted.select(F.col("root").alias("digest"), F.explode("bands").alias("key")).distinct())
    clusters = components(_linked(met)).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    rest = _met(rooted.drop("bands"), materialise(clusters, "open"), ["root"])
    whole = materialise(rest.groupBy("cluster", "root").agg(F.count("*").alias("_k")).where(F.col("_k") >= BLOCK_TEXTS).select("cluster", "root", F.col("root").alias("part")), "parts")
    return links.unionByName(compare(block_tasks(_met(rest, whole, ["cluster", "root"], "left")), weights, least))


def _texts_of(docs: DataFrame, chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the chosen nodes, met on their ids. Ids that several rows share (null is one) are met on the words too, so that a node has the rows of its own words only."""
    columns = ["_node", "cluster", "shingles", "bands", "_text_of"]
    repeated = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    if repeated.isEmpty():
        return docs.join(chosen, F.col("_doc") == F.col("_id")).select(*columns)
    again = lambda name: F.col(name).eqNullSafe(F.col("_again"))
    once = docs.join(chosen.join(repeated, again("_id"), "left_anti"), F.col("_doc") == F.col("_id")).select(*columns)
    shared = docs.join(repeated, again("_doc"), "left_semi").withColumn("_words", F.unhex(word_digest(F.col("_text_of"))))
    met = shared.join(chosen.join(repeated, again("_id"), "left_semi"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_node")))
    return once.unionByName(met.select(*columns))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", weights: str = "damped", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, class_texts, kept, digest``.

    ``class_id``: least id of the class (null if all its ids are); ``class_size``: its rows; ``class_texts``: its different word sequences; ``kept``: the
    row stands for its class. Null and empty texts have no words: they form one class of equal texts. Of repeated rows with the class's id
    one is kept. An empty table gives no rows; other columns are not read.
    """
    rows = materialise(sketch(docs, text, id_col, weights).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    nodes = rows.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"), F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")

    banded = nodes.where("shingles > 0").select("digest", F.explode("bands").alias("key"))
    pairs = materialise(head_links(banded), "pairs")
    clusters = materialise(components(_linked(pairs)), "clusters")

    chosen = clusters.join(nodes.select(F.col("digest").alias("node"), "first", "shingles", "bands"), "node")
    chosen = chosen.select(F.col("node").alias("_node"), F.col("root").alias("cluster"), "shingles", "bands", F.col("first.doc_id").alias("_id"))
    texts = _texts_of(docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text_of")), chosen, rows)
    sets = shingle_sets(texts, "_text_of", ["_node", "cluster", "shingles", "bands"]).where(F.col("digest") == F.col("_node")).drop("_node")
    members = materialise(sets.dropDuplicates(["digest"]), "members")

    classes = materialise(components(verified_links(members, pairs, weights, least)), "classes")
    labelled = nodes.select("digest", "first", "n").join(classes.withColumnsRenamed({"node": "digest"}), "digest", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "digest"))
    facts = labelled.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"), F.count("*").alias("class_texts"))
    mapping = materialise(labelled.select("digest", "root").join(facts, "root").drop("root"), "mapping")
    out = rows.select("doc_id", "digest", "row").join(mapping, "digest")
    return out.select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", "class_texts", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their class, all their columns unchanged, whatever their names. Rows that agree in id and words are told apart by a row number.

    Null and empty texts are one class, of which one row stays; a null id ranks last. An empty table gives no rows.
    """
    names = only_columns(docs.columns)
    numbered = docs.toDF(*names)
    text, id_col = (names[docs.columns.index(c)] for c in (text, id_col))
    found = materialise(near_duplicates(numbered, text, id_col, **how), "near")
    keys = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("_kept"), F.count("*").alias("_same")).where("not _kept or _same > 1")
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "_kept")
    joined = numbered.withColumn("_digest_of_row", word_digest(F.col(text))).join(keys, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_digest_of_row") == F.col("_digest")), "left")
    plain = joined.where(F.col("_kept").isNull()).select(*names)
    tied = joined.where("_kept").withColumn("_n", F.row_number().over(Window.partitionBy("_digest_of_row").orderBy(text))).where("_n = 1").select(*names)
    return plain.unionByName(tied).toDF(*docs.columns)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")
