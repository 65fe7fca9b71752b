"""Operator 11: Merkle manifest of a table, a SHA-256 midstate tree.

Rows become leaves, the leaves of a group (a source) a tree of runs of ``fan`` nodes, the groups' subroots a tree of the same kind above them. One
task builds ``levels`` levels of one block of ``fan ** levels`` neighbouring nodes, so a group of any size is many blocks, and a few rounds (one for each
``levels`` levels) reach its top. A parent keeps a copy of its hash state from before each child slot. On the way down each block is given the path above
it, as the siblings to the left and right of each level; the states before its slots are made once a block. To fold a changed leaf, the state of
its slot is resumed with the replacement and the siblings to its right only, level by level up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.util import materialise, only_columns, ranked, table

FAN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of an Arrow batch that a task gives back, about.
ROWS = 4096
NODE = "grp string, pos long, n long, digest string"


def field_bytes(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in order."""
    return F.sha2(F.concat(*[field_bytes(v) for v in values]), 256)


class Block:
    """Levels above neighbouring nodes. ``states[i]`` of a level is its parent's hash state before the slot of node ``i``."""

    def __init__(self, nodes: list[bytes], count: int, fan: int):
        self.fan, self.levels = fan, []
        for _ in range(count):
            states, above = [], []
            for a in range(0, len(nodes), fan):
                h = sha256()
                for digest in nodes[a : a + fan]:
                    states.append(h.copy())
                    h.update(digest)
                above.append(h.hexdigest().encode())
            self.levels.append((nodes, states))
            nodes = above
        self.top = nodes[0]

    def siblings(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """Digests to the left and right of node ``i`` and of its ancestors in this block."""
        for nodes, _ in self.levels:
            first = i - i % self.fan
            yield b"".join(nodes[first:i]), b"".join(nodes[i + 1 : first + self.fan])
            i //= self.fan

    def fold(self, i: int, digest: bytes) -> bytes:
        """The top with ``digest`` in the place of node ``i``."""
        for nodes, states in self.levels:
            h = states[i].copy()
            h.update(digest)
            h.update(b"".join(nodes[i + 1 : i - i % self.fan + self.fan]))
            digest = h.hexdigest().encode()
            i //= self.fan
        return digest


def levels_in_block(n: int, fan: int, most: int) -> int:
    """Levels of a group of ``n`` nodes until one is left, at most ``most``."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // fan), k + 1
    return k


def _by_block(frames, size: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (group, block of ``size`` positions); the rows of a task are sorted by both."""
    rows = (row for batch in frames for row in batch.to_pylist())
    for key, found in groupby(rows, key=lambda r: (r["grp"], r["block"])):
        yield key, list(found)


def _dealt(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes with their block, each block whole and sorted in one task."""
    if "block" not in nodes.columns:
        nodes = nodes.withColumn("block", F.expr(f"pos div {size}"))
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _up(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """The top of each block: a node of the next round."""
    size = fan**levels

    def run(frames):
        out: list[dict] = []
        for (grp, block), rows in _by_block(frames, size):
            n = rows[0]["n"]
            top = Block([r["digest"].encode() for r in rows], levels_in_block(n, fan, levels), fan).top
            out.append({"grp": grp, "pos": block, "n": -(-n // size), "digest": top.decode()})
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, _schema(NODE))
                out = []
        yield pa.RecordBatch.from_pylist(out, _schema(NODE))

    return _dealt(nodes.select("grp", "pos", "n", "digest"), size).mapInArrow(run, NODE)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.strip().split(" ") for part in ddl.split(","))])


def _climb(nodes: DataFrame, fan: int, levels: int, tag: str) -> list[DataFrame]:
    """Rounds of nodes from the given ones to those where each group has one node left."""
    rounds = [nodes]
    while not rounds[-1].where("n > 1").isEmpty():
        rounds.append(materialise(_up(rounds[-1], fan, levels), tag))
    return rounds


PATH = "lefts array<string>, rights array<string>, subroot string"


def _down(nodes: DataFrame, paths: DataFrame, fan: int, levels: int) -> DataFrame:
    """Paths of all nodes (``grp, pos`` and ``PATH``), from those of the tops of their blocks (``grp, block`` and ``PATH``)."""
    size, ddl = fan**levels, f"grp string, pos long, {PATH}"

    def run(frames):
        out: list[dict] = []
        for (grp, _), (path, *rows) in _by_block(frames, size):
            block = Block([r["digest"].encode() for r in rows], levels_in_block(rows[0]["n"], fan, levels), fan)
            for i, r in enumerate(rows):
                own = [(a.decode(), b.decode()) for a, b in block.siblings(i)]
                lefts, rights = [a for a, _ in own] + path["lefts"], [b for _, b in own] + path["rights"]
                out.append({"grp": grp, "pos": r["pos"], "lefts": lefts, "rights": rights, "subroot": path["subroot"]})
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, _schema(ddl))
                    out = []
        yield pa.RecordBatch.from_pylist(out, _schema(ddl))

    given = nodes.select("grp", "pos", "n", "digest", F.expr(f"pos div {size}").alias("block"))
    above = paths.select("grp", F.lit(-1).cast("long").alias("pos"), "block", "lefts", "rights", "subroot")
    return _dealt(given.unionByName(above, allowMissingColumns=True), size).mapInArrow(run, ddl)


def _descend(rounds: list[DataFrame], top: DataFrame, fan: int, levels: int, tag: str) -> DataFrame:
    """Paths of the nodes of the second round (the tops of the first blocks), from those of the last round's."""
    paths = top
    for nodes in reversed(rounds[1:-1]):
        paths = materialise(_down(nodes, paths.withColumnRenamed("pos", "block"), fan, levels), tag)
    return paths


PROVED = "digest string, subroot string, proof_sha256 string, folded_root string"


def _prove(leaves: DataFrame, paths: DataFrame, fan: int, levels: int, proofs: bool) -> DataFrame:
    """Each leaf's proof and fold. ``leaves``: ``grp, pos, n, digest, changed`` (null: unchanged) and columns that are carried."""
    size = fan**levels
    carried = [c for c in leaves.columns if c not in ("grp", "pos", "n", "digest", "changed")]
    kept = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in carried)
    ddl = f"{PROVED}, siblings array<string>" if proofs else PROVED

    def batch(source: pa.Table, places: list[int], out: list[dict]) -> pa.RecordBatch:
        own = source.take(pa.array(places, pa.int64())).combine_chunks()
        new = pa.Table.from_pylist(out, _schema(ddl))
        for c in carried:
            new = new.append_column(c, own.column(c))
        return new.combine_chunks().to_batches()[0]

    def proved(rows: list[dict]) -> list[dict]:
        path, *rows = rows
        block = Block([r["digest"].encode() for r in rows], levels_in_block(rows[0]["n"], fan, levels), fan)
        above = [(a.encode(), b.encode()) for a, b in zip(path["lefts"], path["rights"], strict=True)]
        kept_states = [sha256(a) for a, _ in above]  # of the ancestors, before the slot of this block's top
        out = []
        for i, r in enumerate(rows):
            own = [*block.siblings(i), *above]
            proof = sha256()
            for a, b in own:
                proof.update(a)
                proof.update(b)
            digest = block.fold(i, (r["changed"] or r["digest"]).encode())
            for state, (_, right) in zip(kept_states, above, strict=True):
                h = state.copy()
                h.update(digest)
                h.update(right)
                digest = h.hexdigest().encode()
            found = {"digest": r["digest"], "subroot": path["subroot"], "proof_sha256": proof.hexdigest(), "folded_root": digest.decode()}
            if proofs:
                text = b"".join(a + b for a, b in own).decode()
                found["siblings"] = [text[k : k + 64] for k in range(0, len(text), 64)]
            out.append(found)
        return out

    tree = ["grp", "block", "pos", "n", "digest", "changed", "lefts", "rights", "subroot"]

    def run(frames):
        pending: list[pa.RecordBatch] = []  # rows of the blocks that have not come to their end

        def settle(source: pa.Table, last: bool):
            rows = source.select(tree).to_pylist()
            done, places, at = [], [], 0
            for _, found in groupby(rows, key=lambda r: (r["grp"], r["block"])):
                found = list(found)
                if at + len(found) < len(rows) or last:
                    done += proved(found)
                    places += range(at + 1, at + len(found))
                    at += len(found)
            return (batch(source, places, done) if done else None), source.slice(at).combine_chunks().to_batches()

        for frame in frames:
            pending.append(frame)
            if sum(map(len, pending)) >= 2 * size:
                out, pending = settle(pa.Table.from_batches(pending), False)
                if out is not None:
                    yield out
        if pending:
            out, _ = settle(pa.Table.from_batches(pending), True)
            if out is not None:
                yield out

    given = leaves.withColumn("block", F.expr(f"pos div {size}"))
    top = paths.select("grp", F.lit(-1).cast("long").alias("pos"), "block", "lefts", "rights", "subroot")
    return _dealt(given.unionByName(top, allowMissingColumns=True), size).mapInArrow(run, f"{ddl}, {kept}" if kept else ddl)


def manifest(leaves: DataFrame, order: list[str], group: str = "source", changed: str | None = None, proofs: bool = False, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Merkle manifest of rows that have a ``leaf`` (hex digest): the columns of ``leaves`` with ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A group's leaves ascend by ``order`` (null first) and then by leaf, so equal keys have one order and repeated rows any. While a group has several nodes,
    every ``fan`` neighbours become the digest of their digests. Subroots in order of ``group`` (null first, UTF-8 bytewise) likewise give the root.
    ``changed`` names a column of replaced leaves (null: unchanged); ``folded_root`` takes it in the place of the leaf, with the original siblings.
    ``proofs`` adds ``siblings``, the digests a verifier needs, in the order of ``proof_sha256``. An empty table gives no rows. Columns of any other name are carried.
    """
    spark = leaves.sparkSession
    names = leaves.columns
    stand = only_columns(names)
    at = dict(zip(names, stand, strict=True))
    given = leaves.toDF(*stand).withColumns({"grp": F.col(at[group]).cast("string"), "digest": F.col(at["leaf"]), "changed": F.col(at[changed]) if changed else F.lit(None).cast("string")})
    first = materialise(ranked(given, ["grp"], [at[c] for c in order] + ["digest"]), "merkle-leaves")
    nodes = first.select("grp", "pos", "n", "digest")
    rounds = _climb(nodes, fan, levels, "merkle-up")
    if len(rounds) == 1:  # every leaf is a subroot already
        rounds.append(nodes)
    subroots = rounds[-1].select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest")
    forest = materialise(ranked(subroots, ["all"], ["name"]), "merkle-forest")
    higher = _climb(forest.select(F.col("all").alias("grp"), "pos", "n", "digest"), fan, levels, "merkle-up")
    if len(higher) == 1:
        higher.append(higher[0])
    root = higher[-1].first()
    nothing = F.array().cast("array<string>")
    paths = _descend(higher, higher[-1].select("grp", "pos", nothing.alias("lefts"), nothing.alias("rights"), F.lit(None).cast("string").alias("subroot")), fan, levels, "merkle-down")
    paths = _down(higher[0], paths.withColumnRenamed("pos", "block"), fan, levels)
    tops = forest.join(paths.select("pos", "lefts", "rights"), "pos").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("digest").alias("subroot"))
    paths = _descend(rounds, materialise(tops, "merkle-down"), fan, levels, "merkle-down")
    out = _prove(first.select("grp", "pos", "n", "digest", "changed", *stand), paths.withColumnRenamed("pos", "block"), fan, levels, proofs)
    top = F.lit(root["digest"] if root else None).cast("string")
    added = {"subroot": F.col("subroot"), "root": top, "proof_sha256": F.col("proof_sha256"), "folded_root": F.col("folded_root"), "verified": F.col("folded_root") == top}
    if proofs:
        added["siblings"] = F.col("siblings")
    return out.select(*[F.col(s).alias(n) for s, n in zip(stand, names, strict=True) if n not in added], *[c.alias(n) for n, c in added.items()])


def tampered_leaf(*values: Column, text: Column, key: Column) -> Column:
    """Leaf of the row with A-Z of the text in lower case, where 5 divides the unsigned CRC-32 of the decimal key; else null. ``values`` come before the text."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(key.cast("string").cast("binary")) % 5 == 0, leaf_digest(*values, lower))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "source", leaf_digest(*values).alias("leaf"), tampered_leaf(*values[:-1], text=values[-1], key=F.col("doc_id")).alias("changed"))
    done = manifest(materialise(leaves, "merkle-rows"), ["doc_id"], changed="changed")
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _manifest_sql(source_levels: int = 7, forest_levels: int = 5) -> str:
    """SQL with one step a level, enough for 16 ** 7 rows a source and 16 ** 5 sources."""
    field = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
    before = " || ".join(field.format(c) for c in FIELDS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)""",
        f"""rows_ AS (SELECT doc_id, source, sha256({before} || {field.format("text")}) AS leaf, sha256({before} || {field.format(lower)}) AS low,
            CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id AS varchar), ''), lambda x: cast(ascii(x) AS bigint))),
            lambda c, b: xor(c >> 8, t[cast(xor(c, b) & 255 AS bigint) + 1])), 4294967295) % 5 END AS crc FROM documents, crc_table)""",
        """leaves AS (SELECT *, CASE WHEN crc = 0 THEN low ELSE leaf END AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
            count(*) OVER (PARTITION BY source) AS n FROM rows_)""",
        "s0 AS (SELECT source AS g, p AS pos, n, leaf AS digest FROM leaves)",
    ]

    def level(name: str, k: int) -> list[str]:
        below = f"{name}{k}"
        return [
            f"{below}r AS (SELECT g, pos // 16 AS run, n, list(digest ORDER BY pos) AS run_digests FROM {below} GROUP BY ALL)",
            f"{name}{k + 1} AS (SELECT g, run AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run_digests, '')) ELSE run_digests[1] END AS digest FROM {below}r)",
        ]

    for k in range(source_levels):
        parts += level("s", k)
    parts.append(f"subroots AS (SELECT g AS source, digest AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM s{source_levels})")
    parts.append("f0 AS (SELECT 0 AS g, p AS pos, n, subroot AS digest FROM subroots)")
    for k in range(forest_levels):
        parts += level("f", k)
    parts.append("a0 AS (SELECT l.doc_id, l.source, l.leaf, l.p, b.subroot, b.p AS q, l.used AS fold, '' AS proof FROM leaves l JOIN subroots b ON l.source IS NOT DISTINCT FROM b.source)")
    at = 0
    for name, levels, pos, key in (("s", source_levels, "p", "a.source IS NOT DISTINCT FROM r.g"), ("f", forest_levels, "q", "r.g = 0")):
        for k in range(levels):
            i = f"({pos} // {16**k} % 16)"
            left, right = f"array_to_string(run_digests[1:{i}], '')", f"array_to_string(run_digests[{i} + 2:], '')"
            parts.append(
                f"a{at + 1} AS (SELECT a.* EXCLUDE (fold, proof), CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold, proof || {left} || {right} AS proof "
                f"FROM a{at} a JOIN {name}{k}r r ON {key} AND r.run = {pos} // {16 ** (k + 1)})"
            )
            at += 1
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified FROM a{at}, f{forest_levels}"""


OP11_SQL = _manifest_sql()
