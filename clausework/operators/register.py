"""Register, workflow tables, pages, packing and reuse."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from clausework.functions.arrow import python_values


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_numbers(rows: DataFrame, order: list[str], size: int, group: list[str]) -> DataFrame:
    """Adds ``page`` from 0 within each group."""
    return rows.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size))


def versioned_update(history: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``history``: key, revision; ``updates``: key, expected, update -> accepted if the expected revision is the latest; of several accepted ones for a key the first is taken."""
    now = history.groupBy(key).agg(F.max("revision").alias("_now"))
    j = updates.join(now, key, "left")
    fits = F.col("expected") == F.coalesce("_now", F.lit(0))
    w = Window.partitionBy(key, fits).orderBy("update")
    return j.withColumn("state", F.when(fits & (F.row_number().over(w) == 1), "accepted").otherwise("conflict")).select(key, "update", "state")


def active_lessons(asked: DataFrame, stored: DataFrame, most: int = 4) -> DataFrame:
    """``owner, type, id, place``: the newest ``most`` active lessons of an owner for a document type, those for ``general`` included; ties by the larger id.

    ``asked``: owner, type; ``stored``: id, owner, type, created, active. Lessons are cut to the newest of each owner and type in each task before they meet the asked types. Null owners and types have none.
    """
    newest = [F.col("created").desc(), F.col("id").desc()]
    kept = stored.where("active").select("id", "owner", F.col("type").alias("_type"), "created").withColumn("_n", F.row_number().over(Window.partitionBy("owner", "_type").orderBy(*newest))).where(F.col("_n") <= most)
    wanted = asked.select("owner", "type").distinct().where("type is not null").withColumn("_type", F.explode(F.array_distinct(F.array(F.col("type"), F.lit("general")))))
    ranked = wanted.join(kept, ["owner", "_type"]).withColumn("place", F.row_number().over(Window.partitionBy("owner", "type").orderBy(*newest)))
    return ranked.where(F.col("place") <= most).select("owner", "type", "id", "place")


def lessons(feedback: DataFrame, key: str, kind: str) -> DataFrame:
    """Confirmed feedback as lessons: of one document type if all its evidence has that type, else general."""
    g = feedback.groupBy(key).agg(F.count_distinct(kind).alias("_k"), F.min(kind).alias("_one"), F.count("*").alias("evidence"))
    return g.select(key, F.when(F.col("_k") == 1, F.col("_one")).otherwise("general").alias("scope"), "evidence")


def ordered_folds(df: DataFrame, key: str, order: str, columns: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Ordered folds of keys: rows of a key stand together and in order in one partition, which is walked key by key; memory holds one key's rows.

    Many small keys cost no group overhead. A key is one document here, whose rows are keys and sizes, not texts.
    """
    placed = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)

    def run(frames):
        held: list[tuple] = []
        out: list[tuple] = []

        def table_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        def flush():
            out.extend(fold(held))
            held.clear()

        for batch in frames:
            for row in zip(*(python_values(c) for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    flush()
                held.append(row)
            if len(out) > 5000:
                yield table_of(out)
                out.clear()
        if held:
            flush()
        if out:
            yield table_of(out)

    shape = df.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(shape)
    return placed.mapInArrow(run, shape)


def pack_by_overlap(rules: DataFrame, document: str, rule: str, blocks: str, most: int = 16, limit: int = 52_000) -> DataFrame:
    """``document, rule, pack``: greedy packs of rules that reuse the same evidence blocks. ``blocks``: array of struct(id, n)."""

    def fold(rows: list[tuple]) -> list[tuple]:
        packs: list[tuple[list, dict, int]] = []  # names, blocks, their size
        for _, name, ids, sizes in rows:
            own = dict(zip(ids, sizes, strict=True))
            best, saved, whole = None, 0, sum(own.values())
            for i, (names, held, size) in enumerate(packs):
                if len(names) < most:
                    both = own.keys() & held.keys()
                    shared = sum(own[b] for b in both)
                    if shared > saved and size + whole - shared <= limit:
                        best, saved = i, shared
            if best is None:
                packs.append(([name], own, whole))
            else:
                names, held, _ = packs[best]
                names.append(name)
                held.update(own)
                packs[best] = names, held, sum(held.values())
        return [(rows[0][0], name, i) for i, (names, *_) in enumerate(packs) for name in names]

    kind = lambda c: rules.schema[c].dataType.simpleString()
    columns = rules.select(document, rule, F.col(f"{blocks}.id").alias("_ids"), F.col(f"{blocks}.n").alias("_sizes"))
    return ordered_folds(columns, document, rule, ["_ids", "_sizes"], fold, f"{document} {kind(document)}, {rule} {kind(rule)}, pack int")


def budgeted_batches(rules: DataFrame, blocks: DataFrame, document: str, budget: int, most: int = 16) -> DataFrame:
    """``document, first_rule, last_rule, rules, part, first, last, size, fits``: every rule of a document meets every block of it exactly once, within the budget.

    ``rules``: document, rule, cost; ``blocks``: document, ord, n, head (begins a section). Rules go in contiguous groups of at most ``most``; a group's parts are contiguous blocks that fill what its
    costs leave of the budget, cut before the last heading if that lies in a part's second half. A group that doesn't fit a block is halved; a single rule that
    doesn't is reported (``fits`` false, no part), never cut, and so are the rules of a document without blocks. Documents without a rule have no rows.
    """
    place = lambda kind, order: (F.lit(kind << 40) + F.col(order)).alias("place")
    kind = blocks.schema[document].dataType.simpleString()
    rows = rules.select(document, place(0, "rule"), F.lit(0).alias("kind"), F.col("rule").cast("long").alias("item"), F.col("cost").cast("long").alias("size"), F.lit(False).alias("head"))
    rows = rows.unionByName(blocks.select(document, place(1, "ord"), F.lit(1).alias("kind"), F.col("ord").cast("long").alias("item"), F.col("n").cast("long").alias("size"), "head"))

    def fold(held: list[tuple]) -> list[tuple]:
        asked = [(r[3], r[4]) for r in held if r[2] == 0]
        given = [(r[3], r[4], r[5]) for r in held if r[2] == 1]
        out = []

        def parts(room: int) -> list[tuple[int, int]] | None:
            cuts, start = [], 0
            while start < len(given):
                end, used = start, 0
                while end < len(given) and used + given[end][1] <= room:
                    used += given[end][1]
                    end += 1
                if end == start:
                    return None
                if end < len(given):
                    edge = next((k for k in range(end - 1, start + (end - start) // 2, -1) if given[k][2]), end)
                    end = edge
                cuts.append((start, end))
                start = end
            return cuts or None

        todo = [asked[i : i + most] for i in range(0, len(asked), most)][::-1]
        while todo:
            group = todo.pop()
            cost = sum(c for _, c in group)
            cuts = parts(budget - cost)
            if cuts:
                out += [(held[0][0], group[0][0], group[-1][0], len(group), k, given[a][0], given[b - 1][0], cost + sum(g[1] for g in given[a:b]), True) for k, (a, b) in enumerate(cuts)]
            elif len(group) == 1:
                out.append((held[0][0], group[0][0], group[0][0], 1, None, None, None, cost, False))
            else:
                half = len(group) // 2
                todo += [group[half:], group[:half]]
        return out

    schema = f"{document} {kind}, first_rule long, last_rule long, rules int, part int, first long, last long, size long, fits boolean"
    return ordered_folds(rows, document, "place", ["kind", "item", "size", "head"], fold, schema)


def topic_clusters(facts: DataFrame, terms: Column, source: str, item: str, most: int = 8, least_sources: int = 2) -> DataFrame:
    """``topic, item, page``: facts by the SHA-256 of their sorted distinct terms, from at least ``least_sources`` sources, in pages of ``most``.

    Texts are read and their terms made once: sources are counted in windows on the topic, which share one shuffle of digests."""
    digest = F.sha2(F.array_join(F.array_sort(F.array_distinct(terms)), " "), 256)
    t = facts.select(digest.alias("topic"), F.col(source).alias("_source"), item).where("topic is not null").repartition("topic")
    nth = F.when(F.col("_source").isNotNull(), F.dense_rank().over(Window.partitionBy("topic").orderBy(F.col("_source").asc_nulls_last())))
    wide = t.withColumn("_nth", nth).withColumn("_of", F.max("_nth").over(Window.partitionBy("topic"))).where(F.col("_of") >= least_sources)
    return page_numbers(wide.select("topic", item), [item], most, ["topic"])


def reuse(requests: DataFrame, cache: DataFrame, digest: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests with their cached answer, and the others computed once per digest. Adds ``answer`` and ``cached``."""
    c = cache.select(F.col(digest).alias("_d"), "answer")
    known = requests.join(c, F.col(digest) == F.col("_d")).drop("_d").withColumn("cached", F.lit(True))
    fresh = requests.join(c, F.col(digest) == F.col("_d"), "left_anti")
    done = compute(fresh.dropDuplicates([digest])).select(F.col(digest).alias("_d"), "answer")
    return known.unionByName(fresh.join(done, F.col(digest) == F.col("_d")).drop("_d").withColumn("cached", F.lit(False)))


def score_requests(requests: DataFrame, key: str, text: str, scorer: Callable[[list[str]], list[tuple[str, float]]]) -> DataFrame:
    """``key, label, score, valid``: a pluggable scorer over batches of requests; scores out of [0, 1] are marked, not dropped."""
    kind = requests.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            got = scorer(pdf[text].tolist())
            yield pd.DataFrame({key: pdf[key], "label": [g[0] for g in got], "score": [float(g[1]) for g in got], "valid": [0 <= g[1] <= 1 for g in got]})

    return requests.select(key, text).mapInPandas(run, f"{key} {kind}, label string, score double, valid boolean")


def complete_sequences(parts: DataFrame, key: str, sequence: str, text: str) -> DataFrame:
    """``key, parts, complete, digest``: sequence numbers run from 0 without gap or repetition; digest of the parts' digests in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(sequence), F.sha2(text, 256).alias("d"))))
    whole = (F.min(sequence) == 0) & (F.max(sequence) + 1 == F.count("*")) & (F.count_distinct(sequence) == F.count("*"))
    return parts.groupBy(key).agg(F.count("*").alias("parts"), whole.alias("complete"), F.sha2(F.array_join(F.transform(listed, lambda x: x.d), ""), 256).alias("digest"))
