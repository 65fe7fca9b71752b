import random
from hashlib import sha256

import numpy as np
import pytest
import tiktoken

from clausework.llm import corpus_bpe as C


@pytest.fixture(scope="module")
def ranks():
    return C.Ranks(C.default_ranks(), C.default_pattern())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=C.default_pattern(), mergeable_ranks=ranks.rank, special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_replay_equals_the_library(ranks, library):
    """Runs of tokens, which open pairs of lower rank, and code points of many scripts and kinds of white space."""
    rng = random.Random(3)
    tokens = [w.decode("utf-8", "ignore") for w in ranks.rank]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randint(0, 15))) for _ in range(2000)]
    texts += ["".join(c for c in t if c.isalpha()) for t in texts]
    kinds = [lambda: rng.randint(1, 0x250), lambda: rng.randint(0x250, 0x3000), lambda: rng.randint(0x4E00, 0x9FFF), lambda: rng.choice([9, 10, 13, 28, 32, 0x85, 0xA0, 0x2003, 0x1F600])]
    texts += ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randint(0, 80))) for _ in range(1000)]
    texts += ["", "<|endoftext|> x", "a" * 20_000, " " * 5000 + "x", "ab" * 7000 + "\n\n"]
    for t, packed in zip(texts, ranks.encode(texts, {}), strict=True):
        assert ids_of(packed) == library.encode_ordinary(t)
        assert ranks.decode(ids_of(packed)) == t.encode()


def test_lower_ranks_come_first(tmp_path):
    """A merge opens a pair of lower rank: its word takes that one before the other places of the higher rank."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"aab", b"bcb", b"cab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" " + str(k).encode() + b"\n" for k, t in enumerate(tokens)))
    v = C.Ranks(str(path), C.default_pattern())
    own = tiktoken.Encoding("own", pat_str=C.default_pattern(), mergeable_ranks=v.rank, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert [ids_of(p) for p in v.encode(texts, {})] == [own.encode_ordinary(t) for t in texts]


def test_corpus_table(spark, library):
    """Every distinct word once, with its count and ids; the broadcast part is the most frequent words within its bytes."""
    texts = ["one two two three three three", "three two", "", None, "one  \n"]
    words = C.word_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    got = {r.word: (r.n, ids_of(r.ids)) for r in words.collect()}
    assert {w: n for w, (n, _) in got.items()} == {"one": 2, " two": 3, " three": 3, "three": 1, "  \n": 1}
    assert all(ids == library.encode_ordinary(w) for w, (_, ids) in got.items())
    all_bytes = sum(len(w) + 4 * len(ids) + C.PER_WORD for w, (_, ids) in got.items())
    assert C.frequent(words, all_bytes).count() == len(got)
    assert C.frequent(words, 0).count() == 0
    few = C.frequent(words, all_bytes * 2 // 3).collect()
    assert {" two", " three"} >= {r.word for r in few if got[r.word][0] > 2} and sum(len(r.word) + len(r.ids) + C.PER_WORD for r in few) <= all_bytes * 2 // 3


@pytest.mark.parametrize("most", [C.WORD_BYTES, 3000, 0])
def test_whole_table(spark, sf, library, monkeypatch, most):
    """Documents whole, with all words broadcast, with some, and with none."""
    monkeypatch.setattr(C, "COUNTED", 500)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in C.round_trip_digests(docs, most=most).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256((d.text or "").encode()).hexdigest()


def test_encode_decode_and_edges(spark, library):
    rows = [(1, None, "k", [1]), (None, "", "k", None), (1, "Hello wörld 你好", None, [2]), (1, "Hello wörld 你好", None, [2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, ids array<int>")
    out = C.encode(df)
    assert out.columns == ["doc_id", "text", "word", "ids"]
    got = sorted((str(r.text), r.word, r.ids) for r in out.collect())
    ids = library.encode_ordinary("Hello wörld 你好")
    assert got == sorted([("None", "k", []), ("", "k", []), *[("Hello wörld 你好", None, ids)] * 2])
    back = C.decode(out.withColumn("_decoded", out["word"]))
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == sorted(["", "", "Hello wörld 你好", "Hello wörld 你好"])
    assert C.decode(spark.createDataFrame([(None,), ([ids[-1]],)], "ids array<int>")).where("decoded is null").count() == 1
    assert C.encode(df.where("false")).count() == 0 and C.round_trip_digests(df.where("false")).count() == 0
    assert sorted(r.n_tokens for r in C.round_trip_digests(df).collect()) == [0, 0, len(ids), len(ids)]


def test_query(spark, sf):
    got = C.op13_corpus_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
