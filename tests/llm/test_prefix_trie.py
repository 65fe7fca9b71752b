import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from clausework.llm import prefix_trie as T
from tests.test_queries import rows_of


def plain(convs):
    """Nodes of conversations (id, sequence of (turn, code points)), straight from the definition."""
    nodes = {}
    for c, seq in convs:
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        parents = {q[:-1] for q in nodes if q}
        saved = sum((len(nodes[q]) - 1) * q[-1][1] for q in under if q)
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        up = min(c for c, _ in nodes[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in under)
        out.append((min(c for c, _ in members), len(p), up, len(members), children, sum(q not in parents for q in under), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, convs):
    rows = [(c, b"".join(sha256(str(t).encode()).digest()[: T.WIDTH] for t, _ in seq), [n for _, n in seq]) for c, seq in convs]
    return spark.createDataFrame([(c, bytearray(s), n) for c, s, n in rows], "conv_id long, seq binary, lens array<int>")


def nodes_of(df):
    return sorted([tuple(r) for r in df.select(*T.OUT).collect()], key=str)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_shards_agree_with_the_definition(spark, shards):
    """Groups of equal conversations over many shards, prefixes of others, empty ones: every number of shards gives the same nodes."""
    rng = random.Random(shards)
    turn = lambda: (rng.choice("abc"), 5)
    convs = [(c, [turn() for _ in range(rng.randint(0, 5))]) for c in range(120)]
    convs += [(1000 + c, [("a", 5), ("b", 5)]) for c in range(80)]  # a hot one, that others extend
    convs += [(2000 + c, []) for c in range(30)] + [(-5, [("z", 2)] * 300)]
    rng.shuffle(convs)
    assert nodes_of(T.prefix_trie(table(spark, convs), shards)) == plain(convs)


def test_copies_that_end_a_shard_and_go_on_in_a_later_one(spark):
    convs = [(c, [("a", 3)]) for c in range(50)] + [(c, [("a", 3), ("b", 4)]) for c in range(50, 100)]
    for shards in (3, 10, 25):
        assert nodes_of(T.prefix_trie(table(spark, convs), shards)) == plain(convs)


def test_ends_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "ENDS", 3)
    convs = [(c, [("a", 3)]) for c in range(20)] + [(c, [("b", 1)]) for c in range(20, 41)] + [(50, [("c", 1)])]
    for shards in (1, 4):
        assert nodes_of(T.prefix_trie(table(spark, convs), shards)) == plain(convs)


def test_medians_balance_the_branches():
    """A thousand children of the root stand at most ten links deep."""
    trie, _ = T.build([([k], k, 1) for k in range(1000)])

    def links(c):
        at, n = trie.eq[0], 0
        while trie.code[at] != c:
            at, n = (trie.lo if c < trie.code[at] else trie.hi)[at], n + 1
        return n

    assert max(map(links, range(1000))) <= 10


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 4)
    turns = [(7, k, "u", f"t{k}") for k in range(50)] + [(8, None, None, None), (8, 1, "u", "x"), (8, 1, "u", "x"), (None, 1, "u", "lost")]
    random.Random(1).shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: r for r in T.sequences(df).collect()}
    one = lambda r, t: sha256(f"{len(r)}:{r}{t}".encode()).digest()[: T.WIDTH]
    assert set(got) == {7, 8}
    assert bytes(got[7].seq) == b"".join(one("u", f"t{k}") for k in range(50)) and got[7].lens == [len(f"t{k}") for k in range(50)]
    assert bytes(got[8].seq) == one("", "") + 2 * one("u", "x") and got[8].lens == [0, 1, 1]


def test_rebuilding(spark):
    """Heads from the hundred's first conversation: whole if shorter, none if absent; a conversation without turns left ends at the root."""
    own = {c: [(f"{c}.{k}", 4) for k in range(n)] for c, n in [(100, 3), *[(100 + k, 1 + k % 7) for k in range(1, 30)], *[(200 + k, 1 + k % 4) for k in range(1, 30)]]}
    got = {r.conv_id: (bytes(r.seq), r.lens) for r in T.rebuilt(table(spark, list(own.items()))).collect()}
    want = []
    for c, seq in own.items():
        h = crc32(str(c).encode()) % 6
        want.append((c, own.get(c - c % 100, [])[:h] + seq[h:]))
    assert got == {r.conv_id: (bytes(r.seq), r.lens) for r in table(spark, want).collect()}
    assert any(not s for _, s in want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.prefix_trie(T.rebuilt(T.sequences(empty))).count() == 0


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    names, got = rows_of(T.op12_prefix_trie(spark, sf))
    want = con.execute(f"select {', '.join(names)} from ({T.OP12_SQL})").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want)
