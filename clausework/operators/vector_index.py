"""Approximate nearest vectors: buckets around centroids, sign codes of random hyperplanes, exact cosines of what both leave.

Centroids and hyperplanes come from a bounded sample of the corpus; every vector is indexed by its nearest centroid and its code. A query probes its nearest buckets, ranks their vectors by the
Hamming distance of codes (64 bytes instead of a vector), and only the best share of those is compared exactly. How many buckets and what share are measured on the sample, so that they follow
the data: clustered vectors need few buckets, vectors without structure need most of them and rely on the codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from clausework.operators.retrieval import BROADCAST_NUMBERS, _ranks, _slices, dense_top, top
from clausework.sources.scratch import written

#: Rows of the sample, vectors of the sample a bucket, buckets at most, bits of a code.
SAMPLE, A_BUCKET, BUCKETS, BITS = 8192, 64, 512, 512


@dataclass
class VectorIndex:
    centroids: np.ndarray
    planes: np.ndarray
    probes: int  # buckets that a query looks into
    share: float  # of their vectors that are compared exactly

    def bucket(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centroids.T, axis=1) if len(unit) else np.zeros(0, np.int64)

    def code(self, unit: np.ndarray) -> np.ndarray:
        """Signs against the hyperplanes, as rows of 64-bit words."""
        return np.packbits(unit @ self.planes > 0, axis=1).view(np.uint64) if len(unit) else np.zeros((0, self.planes.shape[1] // 64), np.uint64)

    def probed(self, unit: np.ndarray) -> np.ndarray:
        """Boolean matrix of queries and buckets."""
        near = np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]
        out = np.zeros((len(unit), len(self.centroids)), bool)
        np.put_along_axis(out, near, True, axis=1)
        return out


def clean_vectors(df: DataFrame, key: str, vector: str, kept: list[str]) -> DataFrame:
    """``key, kept, v``: rows with a key and a vector of finite numbers that isn't zero."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), *kept, v.alias("v")).where("key is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    v = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(lists) else np.zeros((0, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit(corpus: DataFrame, key: str, vector: str, k: int = 10, recall: float = 0.98, sample: int = SAMPLE, seed: int = 7) -> VectorIndex | None:
    """An index for vectors of the dimension that most of the sample has: the ``sample`` rows whose keys' hashes are least. ``probes`` and ``share`` each keep ``recall`` of the ``k`` nearest of 128 of them.
    None if no vector can be indexed."""
    rows = clean_vectors(corpus, key, vector, []).withColumn("_h", F.xxhash64("key")).orderBy("_h", "key").limit(sample).select("v").toArrow().column("v").combine_chunks()
    if not len(rows):
        return None
    sizes = rows.value_lengths().to_numpy()
    dim = int(np.bincount(sizes).argmax())
    unit = _unit(rows.filter(pa.array(sizes == dim)), dim)
    rng, n = np.random.default_rng(seed), len(unit)
    centroids = unit[rng.choice(n, max(1, min(BUCKETS, n // A_BUCKET)), replace=False)].copy()
    for _ in range(8):
        own = np.argmax(unit @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    index = VectorIndex(centroids, rng.standard_normal((dim, BITS)), len(centroids), 1.0)
    asked = rng.choice(n, min(128, n), replace=False)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, n - 1)]
    if near.shape[1]:
        order = np.argsort(np.argsort(-(unit[asked] @ centroids.T), axis=1, kind="stable"), axis=1)  # place of each bucket for each query
        index.probes = int(np.quantile(np.take_along_axis(order, index.bucket(unit)[near], axis=1), recall, method="higher")) + 1
        code = index.code(unit)
        far = np.stack([np.bitwise_count(code ^ code[i]).sum(axis=1) for i in asked])
        places = np.stack([np.searchsorted(np.sort(d), d[m], side="right") for d, m in zip(far, near, strict=True)])
        index.share = min(1.0, float(np.quantile(places, recall, method="higher")) / n)
    return index


def indexed(corpus: DataFrame, key: str, vector: str, index: VectorIndex, allowed: list[str] | None = None) -> DataFrame:
    """``key, allowed, v, bucket, code`` of every vector of the index's dimension, written to the shared folder."""
    dim, kept = index.planes.shape[0], allowed or []
    rows = clean_vectors(corpus, key, vector, kept).where(F.size("v") == dim)
    held = corpus.sparkSession.sparkContext.broadcast(index)  # at most BUCKETS + BITS vectors

    def run(frames: Iterator[pa.RecordBatch]):
        for batch in _slices(frames):
            unit = _unit(batch.column("v"), dim)
            code = pa.array([c.tobytes() for c in held.value.code(unit)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.bucket(unit), pa.int32()), code], [*batch.schema.names, "bucket", "code"])

    return written(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("bucket", IntegerType()), StructField("code", BinaryType())])), "vectors")


def search(queries: DataFrame, table: DataFrame, key: str, vector: str, index: VectorIndex, k: int, allowed: list[str] | None = None, compared: Accumulator | None = None) -> DataFrame:
    """``query, key, score, rank``: about the k nearest by cosine of each query among the ``indexed`` rows, scores exact, ties by key. Columns ``allowed`` must be equal on both sides and are checked before
    anything is cut. Queries are broadcast; sets of more than ``BROADCAST_NUMBERS`` numbers are answered by ``dense_top`` instead. Queries of another dimension, null, zero or infinite ones have no rows.
    ``compared`` counts exact comparisons.
    """
    allowed, dim = allowed or [], index.planes.shape[0]
    q = clean_vectors(queries, key, vector, allowed).where(F.size("v") == dim)
    if q.count() * dim > BROADCAST_NUMBERS:
        return dense_top(q.withColumnRenamed("v", "_v").select("key", *allowed, F.col("_v").alias("v")), table, "key", "v", k, allowed)
    asked = q.toArrow()
    unit = _unit(asked.column("v").combine_chunks(), dim)
    wanted = [asked.column(a).to_pylist() for a in allowed]
    sent = table.sparkSession.sparkContext.broadcast((index, unit, index.code(unit), index.probed(unit), wanted, asked.column("key").to_pylist()))
    kind, query_kind = table.schema["key"].dataType, q.schema["key"].dataType

    def run(frames):
        model, unit, codes, probed, wanted, names = sent.value
        for batch in _slices(frames):
            buckets, keys = batch.column("bucket").to_numpy(), batch.column("key")
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(len(batch), -1)
            own, ranks = _unit(batch.column("v"), dim), _ranks(keys)
            filters = [np.array(batch.column(a).to_pylist(), object) for a in allowed]
            of, at, scores = [], [], []
            for i, name in enumerate(names):
                fits = probed[i][buckets]
                for have, want in zip(filters, wanted, strict=True):
                    fits = fits & (have == want[i]) if want[i] is not None else np.zeros(len(batch), bool)
                place = np.flatnonzero(fits)
                if not len(place):
                    continue
                best = min(len(place), max(k, math.ceil(model.share * len(place))))
                far = np.bitwise_count(code[place] ^ codes[i]).sum(axis=1)
                place = place[np.argpartition(far, best - 1)[:best]]
                if compared is not None:
                    compared.add(len(place))
                s = own[place] @ unit[i]
                first = np.lexsort((ranks[place], -np.round(s, 6)))[:k]
                of += [name] * len(first)
                at += place[first].tolist()
                scores += s[first].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(of, to_arrow_type(query_kind)), keys.take(pa.array(at, pa.int64())), pa.array(scores, pa.float64())], ["query", "key", "score"])

    found = table.select("key", *allowed, "v", "bucket", "code").mapInArrow(run, f"query {query_kind.simpleString()}, key {kind.simpleString()}, score double")
    return top(found, "query", "score", ["key"], k)
