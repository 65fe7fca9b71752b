import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from clausework.llm import warc
from clausework.llm.util import new_path
from clausework.llm.warc import OP4_SQL, op4_warc, read_archives, restore, store, write_archives


def op4_rows(spark, df):
    sf = new_path(spark, "tables")
    df.write.parquet(f"{sf}/pages.parquet")
    return op4_warc(spark, sf).collect()


def test_round_trip(spark):
    big, odd = "<p>" + "é" * 200_000 + "</p>", "x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(1, "http://a/", big), (2, None, big), (3, "u", odd), (4, "u", odd), (5, "u", ""), (6, "u", None), (7, "u", "tiny"), (8, "u", "tiny"), (None, "n\r\nx", odd), (3, "u", odd)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = new_path(spark, "test")
    write_archives(df, path)
    records = read_archives(spark, path)
    assert len(op4_rows(spark, df)) == len(rows)
    assert records.where("verified = false").count() == 0
    payloads, headers = store(records)
    assert payloads.count() == len({h or "" for *_, h in rows})
    got = restore(payloads, headers).collect()
    assert sorted((r.id or "", bytes(r.payload).decode()) for r in got) == sorted((str(i) if i else "", h or "") for i, _, h in rows)
    kinds = sorted((r.id or "", r.record_type, r.refers_to) for r in got)
    assert kinds == [("", "revisit", "3"), ("1", "response", None), ("2", "revisit", "1"), ("3", "response", None), ("3", "response", None), ("4", "revisit", "3"), *[(str(i), "response", None) for i in (5, 6, 7, 8)]]


def test_long_archive_and_hot_payload(spark, monkeypatch):
    """One file of many records, with records longer than a batch of pieces, and payloads that hold most rows."""
    monkeypatch.setattr(warc, "SHARE", 4)
    rows = [(i, f"http://a/{i}\r\n", "<p>" + f"row {i % 3}\r\n\r\n" * (60_000 if i % 50 == 0 else 60)) for i in range(400)] + [(1000 + i, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "test")
    write_archives(df, path)
    records = read_archives(spark, path)
    assert records.select(F.input_file_name()).distinct().count() <= 1
    got = {r.id: (bytes(r.payload).decode(), r.url) for r in restore(*store(records)).collect()}
    assert got == {str(i): (h or "", u and u.replace("\r\n", "%0D%0A")) for i, u, h in rows}


def test_broken_archives(spark):
    import pytest

    whole = [b"WARC/1.0\r\nContent-Length: 9", b"ab", b"cd"]  # 2 + 4 + 2 bytes are 8 of 9
    with pytest.raises(ValueError):
        list(warc.parse(iter([whole[0]])))
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"HTTP/1.1 200", b""])))
    fields, head, block = next(warc.parse(iter([b"WARC/1.0\r\nContent-Length: 8", b"ab", b"cd", b""])))
    assert block == b"ab\r\n\r\ncd" and fields["Content-Length"] == "8"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = new_path(spark, "test")
    write_archives(df, path)
    assert read_archives(spark, path).count() == 0


def test_whole_table(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(OP4_SQL).fetchall()
    got = op4_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert F is not None


def test_query_takes_its_rows_from_the_restored_records(spark, monkeypatch):
    """What op4 reports is hashed from payloads that went through the store: a changed or lost one shows."""
    df = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "a" * 200), (3, "u", "b" * 200)], "page_id long, url string, html string")

    def spoiled(payloads, headers):
        kept = payloads.where(F.col("digest") != sha256(b"b" * 200).hexdigest())
        return restore(kept.withColumn("block", F.lit(zlib.compress(b"a" * 200 + b"!"))), headers)

    monkeypatch.setattr(warc, "restore", spoiled)
    assert sorted((r.page_id, r.payload_bytes) for r in op4_rows(spark, df)) == [(1, 201), (2, 201), (3, None)]


def test_line_ends_of_payloads(spark, monkeypatch):
    """Payloads of any line ends come back, in the middle and in the last place of a file: the four ends, null, empty, and all strings of up to five of CR, LF and a letter."""
    from itertools import product

    ends = ["abc\r", "abc\n", "abc\r\n", "abc\r\n\r\n", "abc\r\n\r", None, "", "\r\n", "\r\n\r\n"]
    every = ["".join(p) for n in range(6) for p in product("\r\na", repeat=n)]
    for per_file, texts in ((1, ends), (2, ends), (1, every[::7]), (1000, every)):
        monkeypatch.setattr(warc, "RECORDS_PER_FILE", per_file)
        rows = [(i, "u", t) for i, t in enumerate(texts)]
        path = new_path(spark, "test")
        write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
        got = {int(r.id): bytes(r.payload).decode() for r in restore(*store(read_archives(spark, path))).collect()}
        assert got == {i: t or "" for i, _, t in rows}
