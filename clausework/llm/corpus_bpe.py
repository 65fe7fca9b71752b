"""Operator 13: byte-level BPE of rank files, the merges replayed over the distinct words of the corpus.

The words of all texts (matches of the pattern) are counted by Spark, each task handing on its distinct ones, and dealt by their digest over shards. A shard
holds its words as one array of symbols, an inverted index from each mergeable pair to the positions where it stands, and applies the merges in order of rank, each
at all its positions from left to right; only pairs with the two neighbours of a merged place enter the index anew. The table of encoded words then
encodes and decodes the texts. It is broadcast as the ``WORD_BYTES`` most frequent bytes of it: a word beyond that bound is rarer than every broadcast one, and the task that
meets it replays it with the other new words of its batch, in the same way. So is a word that the counts show to stand once in the corpus, as no second text could take it from the table.

In a rank file a pair merges if its joined bytes are a token, in the order of the tokens' ranks, so several pairs may make one token, and a merge can open a pair of a lower
rank. That one comes first in its word: the places of the higher rank that are left in that word are put off.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.bpe import _NARROW, _SLOW
from clausework.llm.util import materialise, only_columns, table
from clausework.llm.words import batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1_000_000  # bytes of text of a batch
#: Distinct words that a task counts before it hands them on; bytes of words and ids that are broadcast; bytes of words of a shard's replay; encoded words kept by a worker.
COUNTED, WORD_BYTES, REPLAY_BYTES, KEPT_WORDS = 150_000, 16_000_000, 1_000_000, 50_000
#: A word counts as so many bytes more than its own and those of its ids.
PER_WORD = 16
_loaded: dict[tuple[str, str], Ranks] = {}
_tables: dict[tuple[str, str, str], dict[str, bytes]] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Ranks:
    """A rank file: tokens by rank, and the rank that each pair of tokens merges into."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        from clausework.llm.bpe import PATTERN

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
        if len(set(self.rank.values())) < len(self.rank) or any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("ranks must be distinct and hold every byte")
        self.width = max(self.rank.values()) + 1
        self.bytes_of = {r: word for word, r in self.rank.items()}
        self.first = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.merged: dict[int, int] = {}  # of left * width + right
        for word, r in self.rank.items():
            for k in range(1, len(word)):
                a, b = self.rank.get(word[:k]), self.rank.get(word[k:])
                if a is not None and b is not None:
                    self.merged[a * self.width + b] = r
        pairs = (self.first[:, None] * self.width + self.first).ravel().tolist()
        self.byte_pairs = np.array([self.merged.get(k, -1) for k in pairs], np.int64).reshape(256, 256)
        self.wide = regex.compile(pattern)
        self.narrow = re.compile(_NARROW) if pattern == PATTERN else None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return (self.wide if self.narrow is None or _SLOW.search(text) else self.narrow).findall(text)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers. A word that is a token is that token, whatever its merges make."""
        rank = self.rank.get
        out = [None if (r := rank(w)) is None else r.to_bytes(4, "little") for w in words]
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            for k, ids in zip(rest, _replay(self, [words[k] for k in rest]), strict=True):
                out[k] = ids
        return out

    def encode(self, texts: list[str], given: dict[str, bytes]) -> list[bytes]:
        """Ids of each text, packed. Words outside of the ``given`` table are replayed together."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in set(chain.from_iterable(cut)).difference(given) if w not in known]
        if new:
            known.update(zip(new, self.replay([w.encode() for w in new]), strict=True))
        out = []
        for ws in cut:
            try:
                out.append(b"".join(map(given.__getitem__, ws)))
            except KeyError:  # a word beyond the table
                out.append(b"".join([given[w] if w in given else known[w] for w in ws]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _replay(v: Ranks, words: list[bytes]) -> list[bytes]:
    """Packed ids of each word, by one inverted index from pairs (by the token they merge into) to positions."""
    width, get = v.width, v.merged.get
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = v.first[data]
    start[ends] = -1  # no pair reaches over the end of a word
    n = len(start)
    ranks = np.where((start[:-1] >= 0) & (start[1:] >= 0), v.byte_pairs[data[:-1], data[1:]], -1)
    places = np.flatnonzero(ranks >= 0)
    order = places[np.argsort(ranks[places], kind="stable")]
    found, at = np.unique(ranks[order], return_index=True)
    index = {r: part.tolist() for r, part in zip(found.tolist(), np.split(order, at[1:]), strict=True)} if len(found) else {}
    active = found.tolist()  # ascending, so a heap
    symbols, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    while active:
        r = heappop(active)
        places = index.pop(r)
        places.sort()
        held, left_over, as_left = -1, [], r * width
        for i in places:
            if i < held:
                left_over.append(i)
                continue
            s = symbols[i]
            j = after[i]
            t = symbols[j]
            if s < 0 or t < 0 or get(s * width + t) != r:
                continue
            k = after[j]
            symbols[i], symbols[j] = r, -2  # -2: merged away
            after[i] = k
            before[k] = i
            lower = False
            t = symbols[k]
            if t >= 0 and (q := get(as_left + t)) is not None:
                if q in index:
                    index[q].append(i)
                else:
                    index[q] = [i]
                    heappush(active, q)
                lower = q < r
            h = before[i]  # -1 before the first word: symbols[-1] is a word's end
            s = symbols[h]
            if s >= 0 and (q := get(s * width + r)) is not None:
                if q in index:
                    index[q].append(h)
                else:
                    index[q] = [h]
                    heappush(active, q)
                lower = lower or q < r
            if lower:
                held = ends[np.searchsorted(ends, i)]  # the rest of this word waits for the lower rank
        if left_over:
            if r in index:
                index[r] += left_over
            else:
                index[r] = left_over
                heappush(active, r)
    final = np.array(symbols, np.int64)
    live = final >= 0
    packed, stop = final[live].astype("<u4").tobytes(), (4 * np.cumsum(live)[ends]).tolist()
    return [packed[a:b] for a, b in zip([0, *stop], stop, strict=False)]


def _ranks(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(path, pattern)
    return _loaded[path, pattern]


def word_counts(docs: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """``word, n``: the distinct words of all texts and how often they stand there."""

    def run(frames):
        v, found = _ranks(path, pattern), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for _, column in batches(frames, "text", CHUNK):
            found.update(chain.from_iterable(map(v.words, column.to_pylist())))
            if len(found) > COUNTED:
                yield out()
                found.clear()
        if found:
            yield out()

    part = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(counts: DataFrame, path: str, pattern: str) -> DataFrame:
    """``word, n, ids`` (packed) of each counted word, replayed in shards of about ``REPLAY_BYTES``."""

    def run(frames):
        v = _ranks(path, pattern)
        waiting: list[pa.RecordBatch] = []

        def out():
            whole = pa.Table.from_batches(waiting)
            ids = v.replay([w.encode() for w in whole.column("word").to_pylist()])
            waiting.clear()
            yield from whole.append_column("ids", pa.array(ids, pa.binary())).to_batches()

        size = 0
        for batch in frames:
            waiting.append(batch)
            size += batch.nbytes
            if size > REPLAY_BYTES:
                yield from out()
                size = 0
        if waiting:
            yield from out()

    return counts.select("word", "n").mapInArrow(run, "word string, n long, ids binary")


def word_table(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None, least: int = 1) -> DataFrame:
    """``word, n, ids`` of all distinct words of the corpus that stand there at least ``least`` times; written to the shared folder. Null and empty texts have no words."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()
    counts = word_counts(docs, text, path, pattern)
    return materialise(encoded_words(counts.where(F.col("n") >= least), path, pattern), "bpe-words")


def frequent(words: DataFrame, most: int = WORD_BYTES) -> DataFrame:
    """The most frequent words whose texts and ids have at most ``most`` bytes together. Counts are summed by size class first, so only words of the last class that fits in part are ranked."""
    size = F.octet_length("word") + F.octet_length("ids") + PER_WORD
    sized = words.select("word", "ids", "n", size.cast("long").alias("size"))
    by_class = sized.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.sum("size").alias("size"))  # at most 63 rows
    above = by_class.select("k", (F.sum("size").over(Window.orderBy(F.col("k").desc())) - F.col("size")).alias("above"), "size")
    classes = above.where(F.col("above") < most).select("k", "above", (F.col("above") + F.col("size") <= most).alias("whole"))
    near = sized.withColumn("k", F.floor(F.log2("n"))).join(F.broadcast(classes), "k")
    full = near.where("whole").select("word", "ids")
    cut = near.where("not whole")  # of one class: ranked within ranges of hashes of equal share, so that no task holds it all
    share = 1024
    spread = cut.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(share)))
    room = F.sum("size").over(Window.partitionBy("_salt").orderBy(F.col("n").desc(), "word")) <= (F.lit(most) - F.col("above")) / share
    return full.unionByName(spread.withColumn("_fits", room).where("_fits").select("word", "ids"))


def _broadcast(spark: SparkSession, words: DataFrame, most: int):
    """The frequent words as one broadcast Arrow stream; its size is bounded by ``most``."""
    found = frequent(words, most).toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _given(sent, key: str, path: str, pattern: str) -> dict[str, bytes]:
    """The broadcast table as a dictionary, made once a worker."""
    at = (key, path, pattern)
    if at not in _tables:
        _tables.clear()
        found = pa.ipc.open_stream(sent.value).read_all()
        _tables[at] = dict(zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True))
    return _tables[at]


def _passed(docs: DataFrame, text: str, words: DataFrame | None, ranks: str | None, pattern: str | None, most: int, columns: str, make) -> DataFrame:
    """``docs`` with the columns that ``make(ranks, packed ids)`` gives for each batch."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()
    spark = docs.sparkSession
    words = word_table(docs, text, path, pattern, least=2) if words is None else words
    sent = _broadcast(spark, words, most)
    key, stand = uuid.uuid4().hex, only_columns(docs.columns)
    new = [c.strip().split(" ")[0] for c in columns.split(",")]
    kept = [n for n in docs.columns if n not in new]
    pick = [s for s, n in zip(stand, docs.columns, strict=True) if n in kept]

    def run(frames: Iterator[pa.RecordBatch]):
        v, given = _ranks(path, pattern), _given(sent, key, path, pattern)
        for batch, column in batches(frames, "text", CHUNK):
            made = make(v, v.encode(column.to_pylist(), given))
            yield pa.RecordBatch.from_arrays([*[batch.column(s) for s in pick], *made], [*pick, *new])
        v.known = {}
        pa.default_memory_pool().release_unused()

    source = docs.toDF(*stand).select(*pick, F.col(stand[docs.columns.index(text)]).cast("string").alias("text"))
    schema = ", ".join([*[f"`{s}` {source.schema[s].dataType.simpleString()}" for s in pick], columns])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(s).alias(n) for s, n in zip(pick, kept, strict=True)], *new)


def _id_lists(packed: list[bytes]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int64)
    return pa.LargeListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))).cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, text: str = "text", words: DataFrame | None = None, ranks: str | None = None, pattern: str | None = None, most: int = WORD_BYTES) -> DataFrame:
    """``docs`` with ``ids`` (array of token ids) appended; a column of that name is replaced.

    ``words``: the encoded words of a corpus (``word_table``), made from ``docs`` where it is not given. Null and empty texts have no ids. No special tokens: their strings are
    ordinary text. Each row is its own: nulls, ties and repeats in other columns play no part, and columns of any name are carried. An empty table gives no rows.
    """
    return _passed(docs, text, words, ranks, pattern, most, "ids array<int>", lambda v, packed: [_id_lists(packed)])


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the bytes of the ids appended (binary: ids may end within a character); null ids give null, unknown ids are an error. A column ``into`` is replaced."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()
    stand = only_columns(docs.columns)
    pick = [(s, n) for s, n in zip(stand, docs.columns, strict=True) if n != into]
    at = stand[docs.columns.index(ids)]

    def run(frames):
        v = _ranks(path, pattern)
        for batch in frames:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                found = [None if x is None else v.decode(x) for x in part.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(s) for s, _ in pick], pa.array(found, pa.binary())], [*[s for s, _ in pick], "_decoded"])

    source = docs.toDF(*stand).select(*[s for s, _ in pick], F.col(at).alias("_ids"))
    schema = ", ".join([*[f"`{s}` {source.schema[s].dataType.simpleString()}" for s, _ in pick], "_decoded binary"])
    return source.mapInArrow(run, schema).select(*[F.col(s).alias(n) for s, n in pick], F.col("_decoded").alias(into))


def round_trip_digests(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None, most: int = WORD_BYTES) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and the SHA-256 of the packed ids and of the bytes decoded from them, in one pass; nulls and the rest as in ``encode``."""
    from hashlib import sha256

    def made(v: Ranks, packed: list[bytes]) -> list[pa.Array]:
        back = [sha256(v.decode(np.frombuffer(p, "<u4").tolist())).hexdigest() for p in packed]
        return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha256(p).hexdigest() for p in packed], pa.string()), pa.array(back, pa.string())]

    return _passed(docs, text, None, ranks, pattern, most, "n_tokens long, ids_sha256 string, decoded_sha256 string", made).drop(text)


def op13_corpus_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
