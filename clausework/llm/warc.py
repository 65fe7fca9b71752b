"""Operator 4: content-addressed WARC archives.

Writing: of pages with equal payloads of at least ``LEAST`` bytes, the one with the smallest id is a ``response`` record and holds the bytes; the others
are ``revisit`` records of headers only, which name the response and the payload's SHA-256. Archives are WARC/1.0 files that Spark's own text
writer produces in the shared folder: a record's blank lines are the writer's line separator, so executors need no common disk. Reading: Spark's
text reader streams each file in pieces between blank lines, which are put together into records by their Content-Length, so a task holds one record and one
batch of pieces, whatever the size of an archive. Payloads are kept once per digest, which is computed again from the bytes, record headers
stay in a table of their own, and a join on the digest restores each original record. Digests that hold at least one ``SHARE``-th of
the rows (so fewer than ``SHARE`` of them) are broadcast when planning and dealt over ``SALTS`` keys when restoring.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.util import materialise, new_path

#: Payloads below this many bytes always stand in a response of their own.
LEAST = 100
#: Records of one archive file at most.
RECORDS_PER_FILE = 20_000
#: A digest with more than this share of the rows is hot; its rows are dealt over so many keys.
SHARE, SALTS = 1000, 64
_END = "\r\n\r\n"
FIELDS = ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "Content-Length")


def plan_records(pages: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """``pages`` as records: ``id, url, payload, digest, bytes, record_type, refers_to``.

    A null payload counts as empty. Null ids rank after all others. Of repeated rows with the winning id each is a response: which of them is
    the original can't be told, and nothing is lost. An empty table gives no rows; other columns are not read, so they can't clash.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    named = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    hashed = pages.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= LEAST).drop("bytes")
    groups = materialise(hashed.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    rows = groups.agg(F.sum("n")).head()[0] or 0
    hot, other = (groups.where(c).select("digest", F.col("first.id").alias("refers_to")) for c in (F.col("n") > rows / SHARE, F.col("n") <= rows / SHARE))
    met = F.broadcast(hot.withColumnRenamed("digest", "_hot").withColumnRenamed("refers_to", "_to"))
    told = hashed.join(met, F.col("digest") == F.col("_hot"), "left")
    rest = told.where("_hot is null").select("id", "digest").join(other, "digest")
    later = told.where("_hot is not null").select("id", "digest", F.col("_to").alias("refers_to")).unionByName(rest).where(~F.col("id").eqNullSafe(F.col("refers_to")))
    later = later.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    keyed = named.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    joined = keyed.join(later, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    kind = F.when(F.col("_digest").isNull(), "response").otherwise("revisit")
    return joined.select("id", "url", "payload", "digest", "bytes", kind.alias("record_type"), "refers_to")


def record_text() -> F.Column:
    """A WARC record without its closing blank lines."""
    clean = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"),
        F.when(F.col("id").isNotNull(), F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), clean(F.col("id")), F.lit(">"))).otherwise(F.lit("\r\nWARC-Record-ID: <urn:page>")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), clean(F.col("url")))).otherwise(""),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(F.col("record_type") == "revisit", F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), clean(F.col("refers_to")), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, payload: str = "html", id_col: str = "page_id", url: str = "url") -> None:
    """Write ``pages`` as gzip-compressed WARC files under ``path``.

    Nulls, ties and repeated rows as in ``plan_records``; line ends within ids and URLs are percent-encoded in headers. An empty table gives no
    archive; columns other than the three named are left out.
    """
    records = plan_records(pages, payload, id_col, url).select(record_text().alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Stream:
    """Bytes of archives, asked for piece by piece; each piece was followed by blank lines, but for some last ones of a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        self.held += b"\r\n\r\n"
        return True

    def head(self) -> bytes | None:
        """Up to the next blank lines. Blank lines before it are skipped: the reader doesn't tell whether the last piece of a file was followed by any, so a
        file whose last record ends in a line end leaves four bytes that it doesn't have, and no header begins with them."""
        seen = self.at
        while (k := self.held.find(b"\r\n\r\n", seen)) <= self.at:
            if k == self.at:
                self.at = seen = k + 4
            else:
                seen = max(0, len(self.held) - self.at - 4)
                if not self._more():
                    return None
        out = bytes(self.held[self.at : k])
        self.at = k + 4
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


_HEADER = re.compile(r"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse(pieces: Iterator[bytes]):
    """Records of archives, given in pieces between blank lines: (header fields by name, exact header text, block)."""
    stream = _Stream(pieces)
    while (head := stream.head()) is not None:
        text = head.decode()
        version, _, rest = text.partition("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(_HEADER.findall(rest))
        block = stream.take(int(fields["Content-Length"]))
        stream.take(4)
        yield fields, text, block
    if len(stream.held) > stream.at:
        raise ValueError("an archive ends within a header")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the gzip-compressed archives under ``path``: ``id, record_type, url, digest, refers_to, header, block, verified``.

    Ids come as text, null where a page had none. ``verified``: the block's own SHA-256 equals the digest that the header claims (null for
    revisits). A folder without an archive gives no rows; records keep no other columns of their pages.
    """
    pieces = spark.read.option("lineSep", _END).option("pathGlobFilter", "part-*.gz").schema("value string").text(path).select(F.col("value").cast("binary"))
    names = ["id", "record_type", "url", "digest", "refers_to", "header", "block", "verified"]
    kinds = [*[pa.string()] * 6, pa.binary(), pa.bool_()]

    def run(frames):
        from hashlib import sha256

        bare = lambda s: None if s is None or s == "<urn:page>" else s.removeprefix("<urn:page:").removesuffix(">")
        rows, size = [], 0
        for f, text, block in parse(piece.as_py() for batch in frames for piece in batch.column(0)):
            digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
            response = f["WARC-Type"] == "response"
            rows.append((bare(f.get("WARC-Record-ID")), f["WARC-Type"], f.get("WARC-Target-URI"), digest, bare(f.get("WARC-Refers-To")), text, block if response else None, sha256(block).hexdigest() == digest if response else None))
            size += len(block)
            if size > 4_000_000 or len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    schema = "id string, record_type string, url string, digest string, refers_to string, header string, block binary, verified boolean"
    return pieces.mapInArrow(run, schema)


def responses(records: DataFrame) -> DataFrame:
    """``digest, block`` of every response. A record whose bytes don't match their claimed digest is an error, not a row."""
    good = F.when(F.col("verified"), F.col("digest")).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")))
    return records.where(F.col("record_type") == "response").select(good.alias("digest"), "block")


def store(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers): payload bytes once per verified digest, and every record's exact header apart from them.

    Payloads are dealt by digest, which is how ``restore`` joins them, so the bytes move once, and each is compressed (``zlib``) for the way.
    """
    return _each(responses(records), "block", zlib.compress).dropDuplicates(["digest"]), materialise(records.drop("block", "verified"), "headers")


def _each(df: DataFrame, name: str, f) -> DataFrame:
    """``df`` with ``f`` applied to each of the bytes of column ``name``; null stays null."""

    def run(frames):
        for batch in (whole.slice(i, 500) for whole in frames for i in range(0, whole.num_rows, 500)):
            k = batch.schema.get_field_index(name)
            made = pa.array([None if x is None else f(x) for x in batch.column(k).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if i == k else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def restore(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """The original records: every header with its payload, by a join on the digest. A revisit whose response is missing has a null payload."""
    counts = headers.groupBy("digest").agg(F.count("*").alias("n"))
    hot = F.broadcast(materialise(counts.where(F.col("n") > max(1, headers.count() / SHARE)).select(F.col("digest").alias("_hot")), "hot"))
    salted = headers.join(hot, F.col("digest") == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("header", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0)).drop("_hot")
    kept = payloads.select(F.col("digest").alias("_digest"), F.col("block").alias("payload")).join(hot, F.col("_digest") == F.col("_hot"), "left")
    kept = kept.select("_digest", "payload", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_s"))
    joined = salted.join(kept, (F.col("digest") == F.col("_digest")) & (F.col("_salt") == F.col("_s")), "left").drop("_digest", "_salt", "_s")
    return _each(joined, "payload", zlib.decompress)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    write_archives(pages, path)
    restored = restore(*store(read_archives(spark, path)))  # the archives are the written copy; each side reads them
    kind = pages.schema["page_id"].dataType
    size, digest = F.length("payload").cast("long"), F.sha2("payload", 256)
    return restored.select(F.col("id").cast(kind).alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""
