"""Operator 7: byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into words by the vocabulary's pattern. The distinct new words of a batch form one array of symbols; an index maps each pair's
rank to all positions where the pair stands, a heap holds the active ranks. Ranks are applied in ascending order, each at all its positions
from left to right, and the lists of the pairs that a merge makes or breaks are updated. A merge only makes pairs of higher rank (checked when
the vocabulary is loaded), so ascending ranks give the library's result. Encoded words are kept in a dictionary of the
worker; beyond ``KEPT_WORDS`` entries it becomes the older of two generations, from which words in use are taken over.
"""

from __future__ import annotations

import json
import re
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.words import batches

KEPT_WORDS, CHUNK = 200_000, 2_000_000
VOCABULARY = "byte_bpe_50k.json"
_loaded: dict[str, Vocabulary] = {}
#: Fixed value: the word pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of code points below U+0250 without the numeric signs of ``_SLOW``.
_NARROW = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
_SLOW = re.compile("[\x1c-\x1f²³¹¼-¾ɐ-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable Latin-1 stands for itself, other bytes for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letter[c] for c in word) for word, i in ids.items()}
        self.first = np.zeros(256, np.int64)
        for c, b in letter.items():
            self.first[b] = ids[c]
        self.width = 1 << 20
        self.rank: dict[int, int] = {}  # of a pair
        self.lefts, self.rights, self.news = [], [], []
        born: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            new = ids[a + b]
            if born.get(ids[a], -1) >= r or born.get(ids[b], -1) >= r or new in born:
                raise ValueError("a merge of this vocabulary uses a token that a later merge makes")
            born[new] = r
            self.rank[ids[a] * self.width + ids[b]] = r
            self.lefts.append(ids[a])
            self.rights.append(ids[b])
            self.news.append(new)
        pairs = (self.first[:, None] * self.width + self.first).ravel().tolist()
        self.byte_ranks = np.array([self.rank.get(k, -1) for k in pairs]).reshape(256, 256)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.splits = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.wide, self.narrow = regex.compile(PATTERN), re.compile(_NARROW)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        return (self.wide if _SLOW.search(text) else self.narrow).findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Words of the text, and ids where special tokens stand."""
        if self.splits is None or not self.splits.search(text):
            return self.words(text)
        out: list[str | int] = []
        at = 0
        for m in self.splits.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pieces(t) for t in texts]
        distinct = {w for ws in cut for w in ws if isinstance(w, str)} if self.special else set(chain.from_iterable(cut))
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for w in distinct:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        if new:
            known.update(zip(new, merge_words(self, [w.encode() for w in new]), strict=True))
        out = []
        for ws in cut:
            try:
                out.append([*chain.from_iterable(map(known.__getitem__, ws))])
            except KeyError:  # special tokens among the words
                out.append([i for w in ws for i in ((w,) if isinstance(w, int) else known[w])])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def merge_words(v: Vocabulary, words: list[bytes]) -> list[tuple[int, ...]]:
    """Ids of each word, by one pair occurrence index over all of them."""
    width, get, lefts, rights, news = v.width, v.rank.get, v.lefts, v.rights, v.news
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    start = v.first[data]
    start[ends] = -1  # no pair reaches over the end of a word
    n = len(start)
    # the index at first: positions of each pair of bytes, in order
    ranks = np.where((start[:-1] >= 0) & (start[1:] >= 0), v.byte_ranks[data[:-1], data[1:]], -1)
    places = np.flatnonzero(ranks >= 0)
    order = places[np.argsort(ranks[places], kind="stable")]
    found, at = np.unique(ranks[order], return_index=True)
    index: list[list[int] | None] = [None] * len(news)
    for r, part in zip(found.tolist(), np.split(order, at[1:]), strict=True) if len(found) else ():
        index[r] = part.tolist()
    active = found.tolist()  # sorted, so a heap
    symbols, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    while active:
        r = heappop(active)
        left, right, new = lefts[r], rights[r], news[r]
        places = index[r]
        index[r] = None
        places.sort()
        as_left, as_right = new * width, new
        for i in places:
            if symbols[i] != left:
                continue
            j = after[i]
            if symbols[j] != right:
                continue
            k = after[j]
            symbols[i], symbols[j] = new, -2  # -2: merged away
            after[i] = k
            before[k] = i
            s = symbols[k]
            if s >= 0 and (q := get(as_left + s)) is not None:
                if index[q] is None:
                    index[q] = [i]
                    heappush(active, q)
                else:
                    index[q].append(i)
            h = before[i]  # -1 before the first word: symbols[-1] is a word's end
            s = symbols[h]
            if s >= 0 and (q := get(s * width + as_right)) is not None:
                if index[q] is None:
                    index[q] = [h]
                    heappush(active, q)
                else:
                    index[q].append(h)
    stop = ends.tolist()
    return [tuple([s for s in symbols[a:b] if s >= 0]) for a, b in zip([0, *[e + 1 for e in stop]], stop, strict=False)]


def _vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _fields(schema, drop: str):
    return [f for f in schema.fields if f.name != drop]


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str | None = None, spark_keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``into`` (array of token ids) appended; a column of that name is replaced.

    ``spark_keep``: columns to carry along (default: all). Null and empty texts have no ids. Special tokens of the vocabulary that stand in a text
    become their id, as the library does by default. Ids, ties and repeated rows play no part: each row is its own.
    """
    path = vocabulary or default_vocabulary()
    keep = [c for c in (docs.columns if spark_keep is None else spark_keep) if c != into]
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text_to_encode"))

    def run(frames):
        v = _vocabulary(path)
        for batch, column in batches(frames, "_text_to_encode", CHUNK):
            ids = pa.array(v.encode(column.to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids], [*keep, into])

    fields = [source.schema[c] for c in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], f"`{into}` array<int>"])
    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the text of the ids appended; null ids give null. Unknown ids are an error."""
    path = vocabulary or default_vocabulary()
    keep = [c for c in docs.columns if c != into]

    def run(frames):
        v = _vocabulary(path)
        for batch in frames:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                column = part.column(ids)
                at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
                flat, null = column.flatten().to_numpy(zero_copy_only=False).tolist(), column.is_null().to_pylist()
                texts = [None if x else v.decode(flat[b:e]) for b, e, x in zip(at.tolist(), at[1:].tolist(), null, strict=False)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, into])

    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], f"`{into}` string"])
    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids`` and ``decoded``, the text decoded from those ids, in one pass of one worker a task."""
    path = vocabulary or default_vocabulary()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text_to_encode"))

    def run(frames):
        v = _vocabulary(path)
        for batch, column in batches(frames, "_text_to_encode", CHUNK):
            ids = v.encode(column.to_pylist())
            new = [pa.array(ids, pa.list_(pa.int32())), pa.array([v.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], [*keep, "ids", "decoded"])
        v.older = {}  # idle workers stay; half of their memory is enough
        pa.default_memory_pool().release_unused()

    fields = [source.schema[c] for c in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "ids array<int>, decoded string"])
    return source.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, from the real ids and the text decoded from them."""
    back = round_trip(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"], vocabulary=vocabulary)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
