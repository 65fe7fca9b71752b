import zlib

from pyspark.sql import functions as F

from clausework.llm import language_id as L
from clausework.llm.language_id import classify, learn, op10_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.truth for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 9, "en", 0.0), (2, "le chat et le chien " * 9, "fr", 1.0), (None, "x y", "en", 1.0), (3, None, None, 1.0)], "doc_id long, text string, lang string, score double")
    models = learn(docs)
    assert list(models) == ["en", "fr"]
    asked = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, " 12 !? "), (4, "le chien et le chat et le chien"), (5, "the dog " * 40_000)], "doc_id int, text string")
    got = classify(asked, models).collect()
    assert [(r.lang_pred, r.score) for r in got[:4]] == [("und", 0.0)] * 4
    assert [r.lang_pred for r in got[4:]] == ["fr", "en"]
    assert classify(asked.where("false"), models).count() == 0
    assert {r.lang_pred for r in classify(asked, learn(docs.where("false"))).collect()} == {"und"}
    clash = classify(docs, models)
    assert clash.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]


def test_rare_language_leaves_the_others_whole(spark):
    """A language of two words, and one of digits only, beside the large ones: each is still told, and the others keep their dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rare = spark.createDataFrame([(-1, "zorbix quanuu", "xx"), (-2, "12 345 6789", "digits")], "doc_id long, text string, lang string").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    alone, both = learn(docs.where(fold != 2)), learn(docs.where(fold != 2).unionByName(rare))
    assert set(both) == {*alone, "xx"}
    assert all(both[name] == alone[name] for name in alone)
    asked = docs.where(fold == 2).unionByName(spark.createDataFrame([("-3", "quanuu zorbix", "xx"), ("-4", "zorbix zorbix quanuu", "xx")], "doc_id string, text string, lang string").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    rows = classify(asked, both).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(r.lang_pred == "xx" for r in rows if r.lang == "xx")


def test_brute_force(spark, sf):
    """Sizes taken anew with zstandard, text by text, give the same languages and scores."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    tools = {}
    for name, data in models.items():
        tools[name] = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    own = L.handicaps(models)
    for r in classify(docs, models).select("text", "lang_pred", "score").collect():
        words = b" ".join(w.encode() for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = L.letters(r.text).encode()
        assert data.split() == words.split()
        near = min(range(len(L.LENGTHS)), key=lambda k: abs(math.log(min(len(data), L.PIECE_BYTES) / L.LENGTHS[k])))
        sizes = sorted((sum(len(t.compress(L.CARRIER + data[i : i + L.PIECE_BYTES])) for i in range(0, len(data), L.PIECE_BYTES)) / own[name][near], list(models).index(name), name) for name, t in tools.items())
        assert r.lang_pred == sizes[0][2]
        assert abs(r.score - (1 - math.exp(-(sizes[1][0] / sizes[0][0] - 1) / 0.05))) < 1e-9


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    """Words come from all of a text, not its beginning; repeated rows count once; no more than the stated words reach the driver."""
    text = " ".join("abcdefghij"[int(c)] * 3 + "xyz"[i % 3] for i, c in enumerate(str(zlib.crc32(b"x")) * 4000))
    rows = [(1, text + " lastword", "en")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert b"lastword" in b" ".join(learn(docs, "text").values()) or len(text.split()) > L.SAMPLE_WORDS
    monkeypatch.setattr(L, "SAMPLE_WORDS", 10)
    assert len(learn(docs)["en"].split()) == 10
