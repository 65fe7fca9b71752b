"""Operator 12: prefix trie of conversations, built as ternary search trees over range shards.

A turn (role, text) becomes a digest of 16 bytes and a length; a conversation the digests of its turns in order. Conversations are range-sorted by
that sequence, then id, so a shard holds neighbours, and a group of equal conversations of any size is dealt over shards. A shard encodes its digests
by a dictionary and inserts its distinct sequences into one ternary search tree, the median first and then the medians of both halves, so that the
branches of each node are balanced. One pass from the last node to the first accumulates members, leaves and savings. Only nodes on the path of a
shard's first or last conversation can stand in other shards too: these are emitted as parts and merged by sums, less what a shard shares with the one
before it. All other nodes are whole.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.util import materialise, table

WIDTH = 16  # bytes of a turn's digest
#: Turns of one conversation that one row holds while sequences are put together; ids of one piece of a list of ends; turns a shard, about.
PIECE, ENDS, SHARD_TURNS = 512, 4096, 1_000_000
#: Copies of boundary nodes that are met by the salted children of one hot node.
SALTS = 32
NONE = sha256(b"").hexdigest()
ROWS = 8192


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, seq`` (digests of its turns in order) and ``lens`` (code points of their texts), one row a conversation.

    Null role or text counts as empty; turns ascend, null first, ties by digest, so the order of repeated rows plays no part. Rows without a conversation id
    belong to no conversation and are left out. Turns are range-sorted and packed into pieces where they lie, so a conversation of any length reaches
    its one row in pieces of ``PIECE`` turns.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * WIDTH))
    short = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(t).alias("len"))
    short = materialise(short, "trie-turns")
    by = ["conv_id", "turn", "digest"]
    spread = short.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "digest", "len", F.spark_partition_id().alias("part"))
    ddl = "conv_id long, part int, piece int, seq binary, lens array<int>"
    kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("seq", pa.binary()), ("lens", pa.list_(pa.int32()))])

    def pack(frames):
        rows = (x for b in frames for x in zip(*[b.column(c).to_pylist() for c in ("conv_id", "part", "digest", "len")], strict=True))
        out = []
        for conv_id, found in groupby(rows, key=lambda x: x[0]):
            piece, seq, lens, part = 0, [], [], None
            for _, part, one, length in found:
                seq.append(one)
                lens.append(length)
                if len(seq) == PIECE:
                    out.append((conv_id, part, piece, b"".join(seq), lens))
                    piece, seq, lens = piece + 1, [], []
            if seq:
                out.append((conv_id, part, piece, b"".join(seq), lens))
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    pieces = F.array_sort(F.collect_list(F.struct("part", "piece", "seq", "lens")))
    whole = spread.mapInArrow(pack, ddl).groupBy("conv_id").agg(pieces.alias("p"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("p.seq", F.hex), "")).alias("seq"), F.flatten("p.lens").alias("lens"))


def rebuilt(seqs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first ``h`` turns replaced by those of the conversation ``conv_id - conv_id % every`` (fewer if it is shorter, none if absent); ``h`` is the
    unsigned CRC-32 of the decimal id modulo ``most``. One head is met by fewer than ``2 * every`` ids, so no key is hot."""
    h, head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.col("conv_id") - F.col("conv_id") % every
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_head"), F.substring("seq", 1, WIDTH * (most - 1)).alias("_seq"), F.slice("lens", 1, most - 1).alias("_lens"))
    both = seqs.withColumns({"_h": h.cast("int"), "_at": head}).join(heads, F.col("_at") == F.col("_head"), "left")
    seq = F.concat(F.coalesce(F.expr(f"substring(_seq, 1, _h * {WIDTH})"), F.lit(b"")), F.expr(f"substring(seq, _h * {WIDTH} + 1)"))
    lens = F.concat(F.coalesce(F.slice("_lens", 1, F.col("_h")), F.array().cast("array<int>")), F.slice("lens", F.col("_h") + 1, F.greatest(F.size("lens"), F.lit(1))))
    return both.select("conv_id", seq.alias("seq"), lens.alias("lens"))


class Trie:
    """Ternary search tree over codes. Node 0 is the root; every other node has a code, its trie parent and the links ``lo``, ``eq``, ``hi``."""

    def __init__(self):
        self.code, self.lo, self.eq, self.hi = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.least, self.members = [-1], [0], [None], [0]

    def _new(self, code: int, parent: int) -> int:
        for column, value in ((self.code, code), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.least, None), (self.members, 0)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], least: int, count: int) -> int:
        """Adds ``count`` conversations of one sequence, ``least`` the smallest id; returns its last node."""
        code, lo, eq, hi, members, low = self.code, self.lo, self.eq, self.hi, self.members, self.least
        at = 0
        members[0] += count
        low[0] = least if low[0] is None else min(low[0], least)
        for c in codes:
            above, at = at, eq[at]
            if at < 0:
                at = eq[above] = self._new(c, above)
            else:
                while code[at] != c:
                    links = lo if c < code[at] else hi
                    if links[at] < 0:
                        links[at] = self._new(c, above)
                    at = links[at]
            members[at] += count
            low[at] = least if low[at] is None else min(low[at], least)
        return at

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        out = [node]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out[::-1]


def build(found: list[tuple[list[int], int, int]]) -> tuple[Trie, list[int]]:
    """Tree of sorted distinct sequences (codes, smallest id, count), medians first, and the last node of each."""
    trie, ends = Trie(), [0] * len(found)
    spans = [(0, len(found))]
    while spans:
        a, b = spans.pop()
        if a < b:
            m = (a + b) // 2
            ends[m] = trie.insert(*found[m])
            spans += [(m + 1, b), (a, m)]
    return trie, ends


FIELDS = "kind string, shard int, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, weighted long, distinct_len long, len long, first boolean, ends_last boolean, on_last boolean, ends_sha256 string, piece int, ends string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (f.strip().split(" ") for f in FIELDS.split(","))])


def _identities(seq: bytes) -> list[bytes]:
    """Digest of each prefix of a sequence, the empty one first: resumed turn by turn."""
    h, out = sha256(), []
    for a in range(0, len(seq) + WIDTH, WIDTH):
        out.append(h.copy().digest()[:WIDTH])
        h.update(seq[a : a + WIDTH])
    return out


def _shard_rows(frames):
    """Rows of one shard: ``whole`` nodes, ``part`` nodes of the boundary, ``ends`` pieces of the ids that end at its first and last sequence."""
    seqs, least, counts, hashes, length_of = [], [], [], [], {}
    shard, pieces = None, []  # ids of the first and of the newest sequence, as pieces of text
    ids: list[int] = []

    def close():  # ids that wait belong to the newest sequence
        if ids:
            text = ",".join(map(str, ids))
            hashes[-1].update(text.encode() if counts[-1] == len(ids) else b"," + text.encode())
            pieces[-1].append(text)
            ids.clear()

    for batch in frames:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "seq", "lens", "shard")]
        for conv_id, seq, lens, shard in zip(*columns, strict=True):  # noqa: B007
            if not seqs or seq != seqs[-1]:
                close()
                if len(pieces) > 1:
                    pieces.pop()
                seqs.append(seq)
                least.append(conv_id)
                counts.append(0)
                hashes.append(sha256())
                pieces.append([])
                for k, n in enumerate(lens):
                    length_of[seq[WIDTH * k : WIDTH * (k + 1)]] = n
            counts[-1] += 1
            ids.append(conv_id)
            if len(ids) == ENDS:
                close()
    if not seqs:
        return
    close()
    code = {d: k for k, d in enumerate(sorted(length_of))}  # the shard's dictionary
    found = [([code[s[a : a + WIDTH]] for a in range(0, len(s), WIDTH)], c, n) for s, c, n in zip(seqs, least, counts, strict=True)]
    lengths = [length_of[d] for d in sorted(length_of)]
    trie, ends = build(found)
    del found
    n = len(trie.code)
    own = [0, *[lengths[c] for c in trie.code[1:]]]
    children, leaves, weighted, distinct = [0] * n, [0] * n, [m * k for m, k in zip(trie.members, own, strict=True)], own[:]
    for i in range(n - 1, 0, -1):  # a node comes after its parent
        p = trie.parent[i]
        leaves[i] = leaves[i] or 1
        children[p] += 1
        leaves[p] += leaves[i]
        weighted[p] += weighted[i]
        distinct[p] += distinct[i]
    leaves[0] = leaves[0] or 1
    digest_of = {}
    for k, e in enumerate(ends):
        digest_of[e] = hashes[k].hexdigest()
    first, last = trie.path(ends[0]), trie.path(ends[-1])
    identity = dict(zip(first, _identities(seqs[0]), strict=True)) | dict(zip(last, _identities(seqs[-1]), strict=True))
    on_first, on_last = set(first), set(last)
    open_ends = {ends[0], ends[-1]}
    out = []
    for i in range(n):
        p = trie.parent[i]
        row = {"shard": shard, "depth": trie.depth[i], "conv_id": trie.least[i], "n_convs": trie.members[i], "n_children": children[i], "n_leaves": leaves[i]}
        row |= {"kind": "whole", "weighted": weighted[i], "distinct_len": distinct[i], "parent": identity.get(p)}
        if i in identity:
            row |= {"kind": "part", "node": identity[i], "len": own[i], "first": i in on_first, "on_last": i in on_last, "ends_last": i == ends[-1]}
            row["ends_sha256"] = None if i in open_ends else digest_of.get(i)
        else:
            row["ends_sha256"] = digest_of.get(i, NONE)
            row["parent_conv_id"] = None if p in identity else trie.least[p]
        out.append(row)
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)
            out = []
    for e, texts in zip(dict.fromkeys([ends[0], ends[-1]]), [pieces[0], pieces[-1]], strict=False):
        out += [{"kind": "ends", "shard": shard, "node": identity[e], "piece": k, "ends": t} for k, t in enumerate(texts)]
    yield pa.RecordBatch.from_pylist(out, SCHEMA)


def _ends_digests(pieces: DataFrame) -> DataFrame:
    """``node, found``: digest of the ids of all pieces of a node, read as a stream in their order."""

    def run(frames):
        rows = (x for b in frames for x in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True))
        out = []
        for node, found in groupby(rows, key=lambda x: x[0]):
            h = sha256()
            for k, (_, text) in enumerate(found):
                h.update((b"," if k else b"") + text.encode())
            out.append((node, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "found"])

    return pieces.repartition("node").sortWithinPartitions("node", "shard", "piece").select("node", "ends").mapInArrow(run, "node binary, found string")


def _merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes from the parts of all shards: sums, less what a shard's first path shares with the last path of the shard before."""
    shards = parts.where("depth = 0").select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("before"))  # one row a shard
    mine = parts.where("first").select("shard", "node", "depth")
    theirs = parts.where("on_last").select(F.col("shard").alias("before"), F.col("node"))
    shared = mine.join(shards, "shard").join(theirs, ["before", "node"]).groupBy("shard", "before").agg(F.max("depth").alias("shared"))
    following = shared.select(F.col("before").alias("shard"), F.col("shared").alias("shared_after"))
    ended = parts.where("ends_last").select("shard", F.col("depth").alias("end_depth"))
    known = parts.join(shared.select("shard", "shared"), "shard", "left").join(following, "shard", "left").join(ended, "shard")
    again = F.col("first") & (F.col("depth") <= F.coalesce("shared", F.lit(-1)))
    below = F.sum(F.when(again, F.col("len")).otherwise(0)).over(Window.partitionBy("shard").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0))
    goes_on = F.col("on_last") & (F.coalesce("shared_after", F.lit(-1)) >= F.col("end_depth"))
    fixed = known.select(
        "node", "parent", "depth", "conv_id", "n_convs", "len", "weighted", "ends_sha256",
        (F.col("distinct_len") - F.when(again, below).otherwise(0)).alias("distinct_len"),
        (F.col("n_children") - (again & (F.col("depth") < F.col("shared"))).cast("int")).alias("n_children"),
        (F.col("n_leaves") - goes_on.cast("int")).alias("n_leaves"),
    )
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighted", "distinct_len")]
    return fixed.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), *added)


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the trie of sequences (``conv_id, seq, lens``), one row each.

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id``; ``n_convs`` members; ``n_children``; ``n_leaves`` childless nodes of the subtree; ``saved_tokens`` code points that
    sharing its nodes saves; ``ends_sha256`` of the ids that end here. A conversation without turns ends at the root. An empty table has no node. Ids must be
    distinct (repeated ones count as members of their own). ``shards``: by default one for each ``SHARD_TURNS`` turns, at least as many as shuffle partitions.
    """
    spark = convs.sparkSession
    if shards is None:
        turns = convs.agg(F.sum(F.size("lens") + 1)).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    dealt = convs.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("shard", F.spark_partition_id())
    rows = materialise(dealt.select("conv_id", "seq", "lens", "shard").mapInArrow(_shard_rows, FIELDS), "trie-nodes")
    merged = materialise(_merged(rows.where("kind = 'part'")), "trie-boundary")
    ends = _ends_digests(rows.where("kind = 'ends'"))
    parents = merged.select(F.col("node").alias("_p"), F.col("conv_id").alias("_id"))
    saved = (F.col("weighted") - F.col("distinct_len")).alias("saved_tokens")
    boundary = merged.join(ends, "node", "left").join(parents, F.col("parent") == F.col("_p"), "left")
    boundary = boundary.select("conv_id", "depth", F.col("_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved, F.coalesce("found", "ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    whole = rows.where("kind = 'whole'").select(*OUT[:6], saved, "ends_sha256", "parent")
    inner = whole.where("parent is null").select(*OUT)
    salted = whole.where("parent is not null").withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)))
    spread = parents.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    outer = salted.join(spread, (F.col("parent") == F.col("_p")) & (salted["_salt"] == spread["_salt"])).withColumn("parent_conv_id", F.col("_id")).select(*OUT)
    return inner.unionByName(outer).unionByName(boundary)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(sequences(table(spark, sf_dir, "conversations")), "trie-own")
    return prefix_trie(materialise(rebuilt(own), "trie-rebuilt"))


OP12_SQL = """
WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id AS varchar), ''), lambda x: cast(ascii(x) AS bigint))),
    lambda c, b: xor(c >> 8, t[cast(xor(c, b) & 255 AS bigint) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (SELECT h.conv_id, t.k, t.v FROM heads h JOIN turns t ON t.conv_id = h.head AND t.k <= h.h
    UNION ALL SELECT h.conv_id, t.k, t.v FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h),
lists AS (SELECT h.conv_id, coalesce(s, []) AS s FROM heads h LEFT JOIN (SELECT conv_id, list(v ORDER BY k) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, s, d, s[1:d] AS p FROM lists, LATERAL (SELECT unnest(range(len(s) + 1)) AS d)),
nodes AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS saved FROM prefixes GROUP BY p, d),
up AS (SELECT a.p, count(*) FILTER (b.depth = a.depth + 1) AS n_children, sum(b.saved) AS saved_tokens,
    count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes c WHERE c.depth = b.depth + 1 AND c.p[1:b.depth] = b.p)) AS n_leaves
    FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p GROUP BY a.p)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, u.n_children, u.n_leaves, cast(u.saved_tokens AS bigint) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN up u ON u.p = n.p LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]
"""
