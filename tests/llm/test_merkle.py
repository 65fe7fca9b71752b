from hashlib import sha256
from itertools import groupby
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from clausework.llm import merkle as M


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fan):
    """Levels of a tree, the given nodes first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[a : a + fan]) for a in range(0, len(below), fan)])
    return levels


def prove(levels, i, leaf, fan):
    """Siblings of node i by level, and the top with ``leaf`` in its place."""
    siblings = []
    for nodes in levels[:-1]:
        a = i - i % fan
        run = nodes[a : a + fan]
        siblings += run[: i - a] + run[i - a + 1 :]
        leaf = digest(*run[: i - a], leaf, *run[i - a + 1 :])
        i //= fan
    return siblings, leaf


def plain(rows, fan=16):
    """rows: (source, key, leaf, changed or None)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    trees = [(s, list(g)) for s, g in groupby(order, key=lambda r: r[0])]
    built = [climb([r[2] for r in g], fan) for _, g in trees]
    above = climb([b[-1][0] for b in built], fan) if built else []
    out = []
    for k, ((s, g), b) in enumerate(zip(trees, built, strict=True)):
        for i, r in enumerate(g):
            low, top = prove(b, i, r[3] or r[2], fan)
            high, root = prove(above, k, top, fan)
            out.append((s, r[1], r[2], b[-1][0], above[-1][0], digest(*low, *high), root, root == above[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.source, r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "source string, doc_id long, leaf string, changed string")


@pytest.mark.parametrize(("fan", "levels"), [(16, 3), (2, 1), (3, 2), (4, 1)])
def test_trees_of_many_rounds(spark, fan, levels):
    """Groups of 1, of full and of ragged runs, nulls, repeated keys and rows; more groups than ``fan``."""
    sizes = {None: 5, "a": 1, "b": 16, "c": 17, "é": 64, "Z": 33, "zz": 2, **{f"s{k}": 1 for k in range(20)}}
    rows = [(s, i // 2 if s == "Z" else i, digest(str(s), str(i)), digest("new", str(i)) if i % 3 == 0 else None) for s, n in sizes.items() for i in range(n)]
    rows += [("c", None, digest("n"), None), ("c", 3, digest("c", "3"), digest("x"))]
    got = M.manifest(table(spark, rows).repartition(5), ["doc_id"], changed="changed", fan=fan, levels=levels)
    assert rows_of(got) == plain(rows, fan)


def test_sixteen_and_one(spark):
    """A run of one node becomes its digest, a lone leaf stays itself."""
    rows = [("a", i, digest(str(i)), None) for i in range(257)] + [("b", 0, digest("b"), None)]
    got = rows_of(M.manifest(table(spark, rows), ["doc_id"], changed="changed"))
    assert got == plain(rows) and all(r[-1] for r in got)
    lone = rows_of(M.manifest(table(spark, rows[-1:]), ["doc_id"]))
    assert lone == [("b", 0, digest("b"), digest("b"), digest("b"), digest(), digest("b"), True)]


def test_proofs_verify(spark):
    """The siblings given are enough to recompute the root, and their digest is ``proof_sha256``."""
    rows = [("a" if i % 3 else "b", i, digest(str(i)), None) for i in range(50)]
    for r in M.manifest(table(spark, rows), ["doc_id"], proofs=True).collect():
        assert digest(*r.siblings) == r.proof_sha256 and r.leaf not in r.siblings and r.folded_root == r.root


def test_empty_and_clashing_columns(spark):
    df = table(spark, [])
    assert M.manifest(df, ["doc_id"]).count() == 0
    rows = spark.createDataFrame([("a", 1, digest("1"), "p", 7, 8), ("a", 2, digest("2"), "q", 9, None)], "source string, doc_id long, leaf string, grp string, pos int, n int")
    got = M.manifest(rows, ["doc_id"])
    assert got.columns == [*rows.columns, "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(tuple(r)[3:6] for r in got.collect()) == [("p", 7, 8), ("q", 9, None)]


def test_leaves(spark):
    rows = [(1, "s", "de", 3, "Añ\nZ"), (None, None, None, None, None), (5, "", "", 0, ""), (10, "s", "de", 3, "UPPER Ä")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    values = [F.col(c) for c in M.FIELDS]
    got = df.select(M.leaf_digest(*values).alias("leaf"), M.tampered_leaf(*values[:-1], text=values[-1], key=F.col("doc_id")).alias("t")).collect()
    for row, r in zip(rows, got, strict=True):
        assert r.leaf == plain_leaf(row)
        hit = row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0
        assert r.t == (plain_leaf((*row[:-1], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[-1]))) if hit else None)


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, M.op11_merkle_manifest(spark, sf).collect()))
    assert got == sorted(con.execute(M.OP11_SQL).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    rows = []
    for d in docs:
        low = (*d[:-1], None if d.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text))
        rows.append((d.source, d.doc_id, plain_leaf(d), plain_leaf(low) if crc32(str(d.doc_id).encode()) % 5 == 0 else None))
    assert got == sorted(r[1:] for r in plain(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2
