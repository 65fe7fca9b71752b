"""Quotes, provenance, coverage and validation of extracted statements."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from clausework.functions.arrow import bounded_slices
from clausework.operators.blocks import sentence_array
from clausework.operators.register import ordered_folds

#: Short quotes up to this many are broadcast.
BROADCAST_QUOTES = 100_000
#: Quotes whose runs of words are broadcast at most (about 100 bytes each); more meet the documents in a join on hashes of runs.
BROADCAST_RUNS = 500_000
#: Words of documents that a task looks through at once; a longer document is looked through as a whole.
SLICE_WORDS = 200_000
_WORDS = r"[^\x20\x09-\x0D]+"


def grounded(value: Column, quote: Column) -> Column:
    """The value occurs in the quote, not glued to other digits."""
    return F.rlike(quote, F.concat(F.lit("(^|[^0-9.,])"), F.regexp_replace(value, r"([.+*?|()\[\]{}^$\\])", r"\\$1"), F.lit("($|[^0-9.,]|[.,]($|[^0-9]))")))


def _grams(text: Column, n: int) -> Column:
    """Hashes of all runs of n words. The words are bound by an outer transform, so they are cut once and not for each run."""
    bound = F.array(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)))
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " "))))
    return F.transform(bound, runs)[0]


def candidates(quotes: DataFrame, docs: DataFrame, item: str, doc: str, text: str = "text", n: int = 4) -> DataFrame:
    """Pairs of quote and document that may hold it; none that does is left out. Edges of a quote may be glued to others, so its inner words meet the document:
    the second to fifth in a row, or all inner ones of a quote of three to five words, by an equi-join on hashes of word runs. Only the run's hash and the key are shuffled;
    texts join again by key. Quotes of one or two words have no inner word and are looked for in each document (``_short_candidates``)."""
    w = F.regexp_extract_all("quote", F.lit(_WORDS), F.lit(0))
    q = quotes.select(item, "quote", F.least(F.size(w) - 2, F.lit(n)).alias("run"), w.alias("w"))
    sizes = [r.run for r in q.where("run >= 1").select("run").distinct().collect()]  # at most n
    keyed = q.where("run >= 1").select(item, "run", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("run")), " ")).alias("g"))
    pairs = _short_candidates(quotes.where(F.size(w) < 3), docs, item, doc, text)
    if sizes and keyed.count() <= BROADCAST_RUNS:
        return pairs.unionByName(_run_candidates(q.where("run >= 1").select(item, F.slice("w", F.lit(2), F.col("run")).alias("words")), docs, item, doc, text)).distinct()
    for k in sizes:
        d = docs.select(doc, F.explode(F.array_distinct(_grams(F.col(text), k))).alias("g"))
        pairs = pairs.unionByName(d.join(keyed.where(F.col("run") == k).select(item, "g"), "g").select(item, doc))
    return pairs.distinct()


def _run_candidates(runs: DataFrame, docs: DataFrame, item: str, doc: str, text: str) -> DataFrame:
    """Pairs of quotes and documents that hold their run of words. ``runs``: item, words, counted to be few: they are broadcast, and each task looks for all of them in
    its documents at once, over the places of the runs' words. Equal 64-bit codes of different runs give a pair too many, which the caller's comparison of texts drops."""
    held: dict[int, dict] = {}
    words: dict[str, int] = {}
    for r in runs.collect():
        ids = tuple(words.setdefault(w, len(words)) for w in r.words)
        held.setdefault(len(ids), {}).setdefault(ids, []).append(r[item])
    code = lambda parts: reduce(lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(1)), parts)
    sizes = []
    for k, found in held.items():
        codes = code([np.array([ids[j] for ids in found], np.uint64) for j in range(k)])
        of_code: dict[int, list] = {}
        for c, items in zip(codes.tolist(), found.values()):
            of_code.setdefault(c, []).extend(items)
        sizes.append((k, np.array(sorted(of_code), np.uint64), [of_code[c] for c in sorted(of_code)]))
    known = docs.sparkSession.sparkContext.broadcast((list(words), sizes))
    rows = docs.select(F.col(doc), F.coalesce(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), F.array().cast("array<string>")).alias("_w"))
    kind = to_arrow_type(runs.schema[item].dataType)

    def run(frames):
        names, asked = known.value
        vocabulary = pa.array(names, pa.string())
        for batch in (part for whole in frames for part in bounded_slices(whole, "_w", SLICE_WORDS)):
            lists = batch.column("_w")
            ids = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            which, items = [], []
            for k, codes, own in asked:
                n = len(ids) - k + 1
                if n < 1:
                    continue
                at = np.flatnonzero((np.minimum.reduce([ids[j : j + n] for j in range(k)]) >= 0) & (of[:n] == of[k - 1 :]))
                here = code([ids[at + j].astype(np.uint64) for j in range(k)])
                place = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
                hit = codes[place] == here
                for d, i in set(zip(of[at[hit]].tolist(), place[hit].tolist())):
                    which += [d] * len(own[i])
                    items += own[i]
            yield pa.RecordBatch.from_arrays([pa.array(items, kind), batch.column(doc).take(pa.array(which, pa.int64()))], [item, doc])

    return rows.mapInArrow(run, f"`{item}` {runs.schema[item].dataType.simpleString()}, `{doc}` {docs.schema[doc].dataType.simpleString()}")


def _short_candidates(quotes: DataFrame, docs: DataFrame, item: str, doc: str, text: str, block: int = 1000) -> DataFrame:
    """Pairs of quotes of one or two words and documents that hold their words apart from white space. The quotes are counted; blocks of ``block`` meet each
    document in turn, so no more than a block stands in a row. Up to ``BROADCAST_QUOTES`` quotes are broadcast."""
    flat = F.trim(F.regexp_replace("quote", r"[\x20\x09-\x0D]+", " "))
    q = quotes.select(F.col(item), flat.alias("_q")).where("_q <> ''")
    count = q.count()
    if not count:
        return docs.select(doc).crossJoin(q.select(item)).where("false").select(item, doc)
    held = q.groupBy(F.pmod(F.xxhash64("_q", item), F.lit(-(-count // block))).alias("_b")).agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col("_q").alias("q"))).alias("_quotes"))
    flat_text = F.array(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " "))  # bound by a transform, so it is made once a row
    met = F.transform(flat_text, lambda t: F.transform(F.filter("_quotes", lambda x: F.contains(t, x.q)), lambda x: x.i))[0]
    return docs.select(doc, text).where(F.col(text).isNotNull()).crossJoin(F.broadcast(held) if count <= BROADCAST_QUOTES else held).select(doc, F.explode(met).alias(item)).select(item, doc)


def find_quotes(quotes: DataFrame, docs: DataFrame, item: str, doc: str, text: str = "text") -> DataFrame:
    """``item, doc, start, end``: verbatim occurrences (the first in each document) of quotes of one word or more."""
    pairs = candidates(quotes, docs, item, doc, text).join(quotes, item).join(docs.select(doc, text), doc)
    found = pairs.withColumn("start", F.position(F.col("quote"), F.col(text)) - 1)
    return found.where("start >= 0").select(item, doc, "start", (F.col("start") + F.length("quote")).alias("end"))


def provenance_errors(citations: DataFrame, fragments: DataFrame, doc: str, text: str = "text", sha: str = "sha") -> DataFrame:
    """``citations``: doc, start, end, quote, source_sha -> adds ``errors``: missing source, changed source, quote not at its place."""
    j = citations.join(fragments.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.col(sha).alias("_sha")), F.col(doc) == F.col("_doc"), "left")
    at = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    errors = F.array_compact(F.array(F.when(F.col("_doc").isNull(), "source"), F.when(F.col("_sha") != F.col("source_sha"), "changed"), F.when(at != F.col("quote"), "quote")))
    return j.withColumn("errors", errors).drop("_doc", "_text", "_sha")


def recover_quotes(quotes: DataFrame, docs: DataFrame, item: str, doc: str, text: str = "text") -> DataFrame:
    """``item, doc, state``: exact, or recovered if the quote occurs exactly once with other white space. Nothing but white space is repaired."""
    flat = lambda c: F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")
    pairs = candidates(quotes, docs, item, doc, text).join(quotes, item).join(docs.select(doc, text), doc)
    pairs = pairs.withColumn("_t", flat(F.col(text))).withColumn("_q", F.trim(flat(F.col("quote"))))
    times = (F.length("_t") - F.length(F.replace("_t", F.col("_q"), F.lit("")))) / F.length("_q")
    state = F.when(F.contains(text, F.col("quote")), "exact").when(times == 1, "recovered")
    return pairs.withColumn("state", state).where("state is not null").select(item, doc, "state")


def inherited_modality(rows: DataFrame, key: str, order: list[str], kind: str, modality: str) -> DataFrame:
    """Adds ``inherited``: list items take the modality of the parent before them, until a block that is neither ends the list."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(kind) != "item", F.struct(F.col(kind).alias("k"), F.col(modality).alias("m")))
    last = F.last(mark, ignorenulls=True).over(w)
    return rows.withColumn("_last", last).withColumn("inherited", F.when((F.col(kind) == "item") & (F.col("_last.k") == "parent"), F.col("_last.m")).when(F.col(kind) == "parent", F.col(modality))).drop("_last")


def modal_scopes(blocks: DataFrame, doc: str, order: str, text: str, cues: list[tuple[str, str]], item: str, condition: str, exception: str, fields: str) -> DataFrame:
    """``doc, order, start, end, subject, action, object, modality, conditions, exceptions, parent, group``: atomic obligations of a document's blocks, each with its span in its block.

    ``cues``: (modality, pattern) in order of precedence. A sentence is cut before each cue; a scope runs from its cue (the first from the sentence's start) to the next one, and cues of one modality that only white space
    parts are one. ``subject`` is the sentence before the cue (``document_author`` if nothing is), ``action`` the cue, ``object`` what follows it (the sentence if nothing does). A block with a scope that ends with a
    colon opens a list: blocks that match ``item`` after it inherit its modality (``mixed`` if its scopes differ), conditions and exceptions, until a block that doesn't; an item without a scope is
    an obligation to include it. ``conditions`` and ``exceptions`` are the orders of the blocks that match these patterns, its own and its parent's. A scope whose object matches ``fields`` and quotes two or more
    names in « » becomes one row a name, of the ``group`` required_fields. Null texts have no scope; blocks without one and outside of lists have no row. Scopes are found within their block's row;
    only the window over a document's blocks shuffles.
    """
    any_ = "|".join(f"(?:{p})" for _, p in cues)
    said = lambda c, p: F.coalesce(F.rlike(c, F.lit(p)), F.lit(False))
    let = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  binds a value, so that it is made once a row
    stripped = lambda c: F.regexp_replace(c, r"^[\s,:]+|[\s,:]+$", "")
    blank = lambda c, other: let(c, lambda x: F.when(x == "", other).otherwise(x))
    kind = lambda action: F.coalesce(*[F.when(F.rlike(action, F.lit(f"(?i)^(?:{p})$")), name) for name, p in cues])
    after = lambda c, action: F.substring(c, F.length(action) + 1, F.length(c))

    def piece(x):
        return let(F.regexp_extract(x, f"(?i)^({any_})", 1), lambda action: F.struct(x.alias("piece"), action.alias("action"), kind(action).alias("modality"), after(x, action).alias("rest")))

    def grow(a, x):  # a piece opens a scope, or is added to the last one
        joins = F.coalesce((a.modality == x.modality) & (F.trim(a.rest) == ""), F.lit(False))
        last = F.get(a.out, F.size(a.out) - 1)
        longer = F.concat(F.slice(a.out, F.lit(1), F.size(a.out) - 1), F.array(F.struct(last.at.alias("at"), last.action.alias("action"), last.modality.alias("modality"), F.concat(last.whole, x.piece).alias("whole"))))
        out = F.when(joins, longer).otherwise(F.array_append(a.out, F.struct(a.at.alias("at"), x.action.alias("action"), x.modality.alias("modality"), x.piece.alias("whole"))))
        return F.struct((a.at + F.length(x.piece)).alias("at"), x.modality.alias("modality"), x.rest.alias("rest"), out.alias("out"))

    def scopes(s):
        def placed(out):
            def one(x, i):
                rest = F.trim(F.regexp_replace(after(x.whole, x.action), r"^\s+|\s+$", ""))
                end = F.coalesce(s.start + F.get(out, i + 1).at, s.end)
                return F.struct((s.start + F.when(i == 0, 0).otherwise(x.at)).alias("start"), end.alias("end"), blank(stripped(F.substring(s.sentence, F.lit(1), x.at)), F.lit("document_author")).alias("subject"), x.action.alias("action"), blank(rest, s.sentence).alias("object"), x.modality.alias("modality"))

            return F.transform(out, one)

        def found(m):
            begin = F.struct(F.length(m[0]).alias("at"), F.lit(None).cast("string").alias("modality"), F.lit(None).cast("string").alias("rest"), F.array().cast("array<struct<at:int,action:string,modality:string,whole:string>>").alias("out"))
            return let(F.aggregate(F.transform(F.slice(m, F.lit(2), F.size(m)), piece), begin, grow, lambda a: a.out), placed)

        return let(F.split(F.regexp_replace(s.sentence, f"(?i)({any_})", "\x01$1"), "\x01"), found)

    at, none = F.col(order), F.array().cast(f"array<{blocks.schema[order].dataType.simpleString()}>")
    b = blocks.select(doc, order, F.coalesce(text, F.lit("")).alias("_t"))
    b = b.withColumn("_own", F.flatten(F.transform(sentence_array(F.col("_t")), scopes)))
    told = F.array_distinct(F.filter(F.transform("_own", lambda x: x.modality), lambda m: m.isNotNull()))
    b = b.withColumn("_m", F.when(F.size("_own") > 0, let(told, lambda m: F.when(F.size(m) == 1, m[0]).otherwise("mixed"))))
    facts = b.withColumns({"_item": said("_t", item), "_opens": F.col("_m").isNotNull() & said("_t", r":\s*$"), "_c": F.when(said("_t", condition), F.array(at)).otherwise(none), "_x": F.when(said("_t", exception), F.array(at)).otherwise(none)})
    before = Window.partitionBy(doc).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("_item"), F.struct("_opens", at.alias("o"), "_m", "_c", "_x")), ignorenulls=True).over(before)
    facts = facts.withColumn("_p", last).withColumn("_p", F.when(F.col("_item") & F.col("_p._opens"), F.col("_p")))
    context = [F.array_distinct(F.concat(F.col(c), F.coalesce(F.col(f"_p.{c}"), none))).alias(n) for c, n in (("_c", "conditions"), ("_x", "exceptions"))]
    include = F.struct(F.lit(0).alias("start"), F.length("_t").alias("end"), F.lit("document_author").alias("subject"), F.lit("include_item").alias("action"), F.col("_t").alias("object"), F.col("_p._m").alias("modality"))
    each = F.when(F.col("_p").isNotNull() & F.col("_m").isNull() & (F.trim("_t") != ""), F.array(include)).otherwise(F.col("_own"))

    def rows(x):
        row = lambda action, what, group: F.struct(x.start.alias("start"), x.end.alias("end"), x.subject.alias("subject"), action.alias("action"), what.alias("object"), x.modality.alias("modality"), group.cast("string").alias("group"))
        names = F.when(said(x.object, fields), F.regexp_extract_all(x.object, F.lit("«([^»]+)»"), F.lit(1)))
        return let(names, lambda n: F.when(F.size(n) > 1, F.transform(n, lambda name: row(F.lit("include_field"), name, F.lit("required_fields")))).otherwise(F.array(row(x.action, x.object, F.lit(None)))))

    # An outer generator: for an inner one Spark would make the array a second time, to leave out empty ones beforehand.
    flat = facts.select(doc, order, *context, F.col("_p.o").alias("parent"), F.flatten(F.transform(each, rows)).alias("_rows")).select("*", F.inline_outer("_rows")).where("action is not null")
    return flat.select(doc, order, "start", "end", "subject", "action", "object", "modality", "conditions", "exceptions", "parent", "group")


def split_members(rules: DataFrame, key: str, text: str, mark: str = ":", between: str = ";") -> DataFrame:
    """``key, n, unit, unit_id``: members of a list keep the introduction; a rule of one member stays whole."""
    lead, rest = F.substring_index(text, mark, 1), F.expr(f"substring({text}, length(substring_index({text}, '{mark}', 1)) + 2)")
    parts = F.filter(F.transform(F.split(rest, between), lambda x: F.trim(x)), lambda x: x != "")
    units = F.when(F.size(parts) > 1, F.transform(parts, lambda p: F.concat(F.trim(lead), F.lit(": "), p))).otherwise(F.array(F.col(text)))
    out = rules.select(key, F.posexplode(units).alias("n", "unit"))
    return out.withColumn("unit_id", F.substring(F.sha2("unit", 256), 1, 16))


def catalogue_groups(blocks: DataFrame, document: str, order: str, key: list[str], example: str, one_line: str, ends: str, limit: int = 5000) -> DataFrame:
    """``document, order, group, segment, example``: consecutive blocks of one ``key`` (appendix, clause, heading), in groups that close once they hold more than ``limit`` characters.

    A block that matches ``example`` begins an example segment; it lasts until a block that matches ``ends``, or the key changes. One that matches ``one_line`` is an example by itself. Segments number
    the runs within a group, so that examples can be left out. Blocks: document, order, text and the key's columns; nulls in a key are a value; a null text is no example and has size 0.
    One ordered walk over each document's keys and sizes.
    """
    is_ = lambda p: F.coalesce(F.rlike("text", F.lit(p)), F.lit(False))
    facts = blocks.select(
        document, order, F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).alias("_key"), F.coalesce(F.length("text"), F.lit(0)).alias("_n"), is_(example).alias("_starts"),
        (is_(example) & is_(one_line)).alias("_alone"), is_(ends).alias("_ends"),
    )

    def fold(rows: list[tuple]) -> list[tuple]:
        out, before, group, used, segment, inside, last = [], None, -1, 0, 0, False, None
        for doc, at, name, n, starts, alone, stops in rows:
            if name != before:
                inside = False
            if name != before or used > limit:
                group, used, segment, last = group + 1, 0, 0, None
            if inside and not starts and stops:
                inside = False
            flag = starts or inside
            if last is not None and (starts or flag != last[0] or last[1]):
                segment += 1
            out.append((doc, at, group, segment, flag))
            last = flag, alone
            inside = flag and not alone
            before, used = name, used + n
        return out

    kind = lambda c: blocks.schema[c].dataType.simpleString()
    return ordered_folds(facts, document, order, ["_key", "_n", "_starts", "_alone", "_ends"], fold, f"{document} {kind(document)}, {order} {kind(order)}, group int, segment int, example boolean")


def uncovered(cues: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``cues``: key, pos; ``spans``: key, start, end (exclusive) -> cues that no span covers. Spans of a key are one sorted merge by running maximum, not a join of all pairs."""
    events = cues.select(key, F.col("pos").alias("_at"), F.lit(1).alias("_cue"), F.lit(None).cast("long").alias("_end")).unionByName(spans.select(key, F.col("start").alias("_at"), F.lit(0).alias("_cue"), F.col("end").cast("long").alias("_end")))
    w = Window.partitionBy(key).orderBy("_at", "_cue").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_reach", F.max("_end").over(w)).where("_cue = 1 and (_reach is null or _reach <= _at)").select(key, F.col("_at").alias("pos"))


def completeness_screen(cards: DataFrame, cues: DataFrame, spans: DataFrame, dependencies: DataFrame, syntax: str) -> DataFrame:
    """``id, structural, semantic, uncovered, reasons``: whether a card's obligations cover its text, and the sorted reasons why it can't be accepted by itself.

    ``cards``: id, text, obligations (number), explicit, modality, example, definition, unknown_condition, ambiguities (array); ``cues``: id, pos of normative words; ``spans``: id, start, end of obligations; ``dependencies``: id,
    required, unresolved. ``structural`` is complete if every cue is covered and no required dependency is unresolved; ``semantic`` is ``verified_simple`` only for one explicit obligation of a
    known modality without any reason, else ``unknown``. A text that matches ``syntax`` needs more than words. Nulls count as false, none and empty.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    missing = uncovered(cues, spans, "id").groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("_missing"))
    open_ = dependencies.groupBy("id").agg(F.bool_or(yes("required") & yes("unresolved")).alias("_open"))
    j = cards.join(missing, "id", "left").join(open_, "id", "left")
    none, n = F.coalesce(F.col("obligations"), F.lit(0)) == 0, F.coalesce("_missing", F.array().cast("array<bigint>"))
    own = [
        ("uncovered_normative_cues", F.size(n) > 0), ("no_obligations", none), ("unresolved_dependency", yes("_open")), ("complex_syntax_needs_semantic_validation", F.coalesce(F.rlike("text", F.lit(syntax)), F.lit(False))),
        ("example_not_a_general_rule", yes("example")), ("definition_not_an_obligation", yes("definition")), ("condition_needs_interpretation", yes("unknown_condition")),
    ]
    reasons = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(c, name) for name, c in own])), F.coalesce("ambiguities", F.array().cast("array<string>")))))
    simple = (F.size(reasons) == 0) & (F.col("obligations") == 1) & yes("explicit") & F.coalesce(F.col("modality").isin("mandatory", "prohibited", "recommended", "permitted"), F.lit(False))
    whole = (F.size(n) == 0) & ~yes("_open")
    return j.select("id", F.when(whole, "complete").otherwise("incomplete").alias("structural"), F.when(simple, "verified_simple").otherwise("unknown").alias("semantic"), n.alias("uncovered"), reasons.alias("reasons"))


def quality_reasons(cards: DataFrame, citations: DataFrame, dependencies: DataFrame, gaps: DataFrame, administrative: str, implicit: str, statement: str, least: float = 0.9) -> DataFrame:
    """``id, status, reasons``: a card is ``ready`` without a reason, ``reference`` material if it states no duty, else a ``candidate``.

    ``cards``: id, locator, entity (definition, permission, recommendation and assumption are reference), provenance (verified), profile, approved, semantic, structural, ambiguous, condition_open, resolved (its questions are
    answered by an expert), applies_known, modality, obligations, conditions (number), operator (of its composition: atom, all_of, any_of) and operands, confidence; ``citations``: id, locator, n, quote; ``dependencies``: id, required,
    unresolved, target; ``gaps``: locators that the source lacks. Reasons come in their fixed order. The three patterns are held against the quotes of the card's own locator. Nulls count as false, none
    and empty; a null confidence is too low.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    cited = citations.select("id", "locator").unionByName(cards.select("id", "locator")).where("locator is not null").distinct()
    met = dependencies.join(cited.select(F.col("id").alias("_i"), F.col("locator").alias("_l")), (F.col("id") == F.col("_i")) & (F.col("target") == F.col("_l")), "left")
    by_card = met.groupBy("id").agg(
        F.bool_or(yes("unresolved")).alias("_open"), F.bool_or(yes("required") & ~yes("unresolved") & F.col("_l").isNull()).alias("_apart"), F.bool_or(yes("required") & ~yes("unresolved")).alias("_held"))
    gap = cited.join(gaps.select("locator").distinct(), "locator", "left_semi").select("id").distinct().withColumn("_gap", F.lit(True))
    own = citations.join(cards.select("id", "locator"), ["id", "locator"]).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim(F.coalesce("quote", F.lit(""))).alias("q")))), lambda x: x.q), " ").alias("_quoted"))
    j = cards.join(by_card, "id", "left").join(gap, "id", "left").join(own, "id", "left").withColumn("_quoted", F.coalesce("_quoted", F.lit("")))
    says = lambda p: F.rlike("_quoted", F.lit(p))
    duty = ~F.coalesce(F.col("entity").isin("definition", "permission", "recommendation", "assumption"), F.lit(False))
    few = F.coalesce("operator", F.lit("unknown"))
    composed = (few == "atom") | (few.isin("all_of", "any_of") & (F.coalesce("operands", F.lit(0)) >= 2))
    complete = F.coalesce(F.col("semantic").isin("verified", "verified_simple", "model_reviewed"), F.lit(False)) & (F.coalesce("structural", F.lit("")) != "incomplete")
    cases = [
        ("provenance", ~yes("provenance")), ("incomplete", ~complete), ("ambiguity", yes("ambiguous") & ~yes("resolved")), ("condition", yes("condition_open") & ~yes("resolved")), ("dependency", yes("_open")), ("dependency_context", yes("_apart")),
        ("source_gap", yes("_gap") & ~yes("approved")), ("profile", ~yes("profile")), ("administrative_action", duty & says(administrative)), ("implicit_context", duty & says(implicit) & (F.coalesce("conditions", F.lit(0)) == 0) & ~yes("_held")), ("context_statement", duty & says(statement)),
        ("applicability", duty & ~yes("applies_known")), ("modality", duty & ~F.coalesce(F.col("modality").isin("mandatory", "prohibited"), F.lit(False))), ("no_obligation", duty & (F.coalesce("obligations", F.lit(0)) == 0)), ("composition", duty & ~composed),
        ("confidence", ~yes("approved") & ~F.coalesce((F.col("confidence") >= least) & ~F.isnan("confidence") & (F.col("confidence") < float("inf")), F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in cases]))
    ready = F.when(duty, F.array().cast("array<string>")).otherwise(F.array(F.lit("reference")))
    return j.select("id", F.when(F.size(found) > 0, "candidate").when(duty, "ready").otherwise("reference").alias("status"), F.when(F.size(found) > 0, found).otherwise(ready).alias("reasons"))


def coverage_audit(fragments: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, problem``: fragments without a row of the ledger, rows without a fragment, fragments with more than one row."""
    f = fragments.select(*keys).withColumn("_f", F.lit(1))
    g = ledger.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = f.join(g, keys, "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_f").isNull(), "unknown").when(F.col("_n") > 1, "repeated")
    return j.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def screen(rows: DataFrame, key: str, digest: Column, competes: Column) -> DataFrame:
    """Adds ``duplicate_of``: among rows that compete, the first of equal digest keeps and the others name it."""
    w = Window.partitionBy("_d", "_c").orderBy(key)
    marked = rows.withColumn("_d", digest).withColumn("_c", competes)
    first = F.first(key).over(w)
    return marked.withColumn("duplicate_of", F.when(F.col("_c") & (first != F.col(key)), first)).drop("_d", "_c")


def matrix_problems(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n``: cells of the expected matrix that don't occur exactly once, and cells outside of it."""
    g = got.groupBy(*keys).agg(F.count("*").alias("n"))
    j = expected.select(*keys).withColumn("_e", F.lit(1)).join(g, keys, "full")
    return j.where("_e is null or n is null or n <> 1").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.col("_e").isNotNull().alias("expected"))


def span_runs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``key, first, last``: contiguous runs of numbers; repeated numbers count once. One shuffle by key and one sort: repeated numbers share their rank, so none is dropped beforehand."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.select(key, order).withColumn("_g", F.col(order) - F.dense_rank().over(w))
    return r.groupBy(key, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_g")


def expand_runs(runs: DataFrame, key: str) -> DataFrame:
    """The numbers of runs again, each beside its run: ``key, first, last, n``."""
    return runs.select(key, "first", "last", F.explode(F.sequence("first", "last")).alias("n"))


def fingerprint(rows: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """``keys, n, fingerprint``: SHA-256 over the digests in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(digest).alias("d"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x.d), ""), 256).alias("fingerprint"))


def repair_locators(citations: DataFrame, blocks: DataFrame, doc: str, locator: str, text: str, least: int = 12) -> DataFrame:
    """``citations``: id, doc, locator, quote -> adds ``repaired``: the only block of the document that holds the trimmed quote; a right or unclear locator stays.

    Blocks and citations meet on the document.
    """
    q = citations.select("id", doc, F.col(locator).alias("_given"), F.trim("quote").alias("_q"))
    hits = q.where(F.length("_q") >= least).join(blocks.select(doc, F.col(locator).alias("_at"), F.col(text).alias("_t")), doc).where(F.contains("_t", F.col("_q")))
    g = hits.groupBy("id", "_given").agg(F.count("*").alias("n"), F.min("_at").alias("_at"), F.bool_or(F.col("_at") == F.col("_given")).alias("right"))
    fixed = g.select("id", F.when(F.col("right") | (F.col("n") != 1), F.col("_given")).otherwise(F.col("_at")).alias("repaired"))
    return citations.join(fixed, "id", "left").withColumn("repaired", F.coalesce("repaired", F.col(locator)))


def identity_fields(values: DataFrame, citations: DataFrame, blocks: DataFrame, required: tuple[str, ...] = ("full_title", "short_title")) -> DataFrame:
    """``source, field, value, state, status``: what a source says about itself, each value held against its own quotes.

    ``values``: source, field, value; ``citations``: source, field, n (their order), locator, quote; ``blocks``: source, locator, text. An empty or null value is ``empty``. A value is ``identified`` if
    it has quotes, all of them stand in their blocks, and it occurs in them, joined by a space, apart from case and white space; else it is ``unverified`` and left out. A source is
    ``identified`` if no field is unverified and the ``required`` ones have a value, else it ``needs_review``.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    held = citations.join(blocks.select("source", "locator", F.col("text").alias("_text")), ["source", "locator"], "left")
    held = held.withColumn("_exact", F.coalesce(F.contains("_text", F.col("quote")) & (F.col("quote") != ""), F.lit(False)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "quote"))), lambda x: x.quote), " ")
    quoted = held.groupBy("source", "field").agg(F.bool_and("_exact").alias("_all"), joined.alias("_quotes"))
    j = values.join(quoted, ["source", "field"], "left").withColumn("_v", F.coalesce(flat(F.col("value")), F.lit("")))
    good = F.coalesce(F.col("_all") & F.contains(F.lower(flat(F.col("_quotes"))), F.lower("_v")), F.lit(False))
    j = j.withColumn("state", F.when(F.col("_v") == "", "empty").when(good, "identified").otherwise("unverified")).withColumn("value", F.when(F.col("state") == "identified", F.col("_v")).otherwise(""))
    named = F.count_if(F.col("field").isin(*required) & (F.col("state") == "identified"))
    whole = j.groupBy(F.col("source").alias("_s")).agg(((named == len(required)) & (F.count_if(F.col("state") == "unverified") == 0)).alias("_ok"))
    return j.join(whole, F.col("source") == F.col("_s")).select("source", "field", "value", "state", F.when(F.col("_ok"), "identified").otherwise("needs_review").alias("status"))


def contextual_decisions(cards: DataFrame, decisions: DataFrame, evidence: DataFrame, blocks: DataFrame, reach: int = 2) -> DataFrame:
    """``id, status, reason``: decisions on ready cards, demoted to ``candidate`` where the context doesn't bear them out.

    ``cards``: id, batch, doc, ord (of a cited block; a row for each); ``decisions``: batch, id, status; ``evidence``: id, doc, ord, quote; ``blocks``: doc, ord, text. The decisions of a batch must name its
    cards exactly once each, else all are ``incomplete``. A ready decision needs evidence, each quote of it verbatim in a block within ``reach`` of one that the card cites.
    """
    own = cards.select("batch", "id").distinct()
    told = decisions.groupBy("batch", "id").agg(F.count("*").alias("_n"), F.min("status").alias("_status"))
    both = own.withColumn("_card", F.lit(True)).join(told, ["batch", "id"], "full")
    whole = both.groupBy("batch").agg(F.bool_and(F.col("_card").isNotNull() & (F.coalesce("_n", F.lit(0)) == 1)).alias("_whole"))
    near = cards.select("id", "doc", F.explode(F.sequence(F.col("ord") - reach, F.col("ord") + reach)).alias("ord")).distinct()
    met = evidence.join(near.withColumn("_near", F.lit(True)), ["id", "doc", "ord"], "left").join(blocks.select("doc", "ord", F.col("text").alias("_text")), ["doc", "ord"], "left")
    good = met.groupBy("id").agg(F.bool_and(F.col("_near").isNotNull() & (F.col("quote") != "") & F.coalesce(F.contains("_text", F.col("quote")), F.lit(False))).alias("_good"))
    j = both.where("_card").join(whole, "batch").join(good, "id", "left")
    reason = F.when(~F.col("_whole"), "incomplete").when(~F.coalesce(F.col("_status").isin("ready", "candidate"), F.lit(False)), "status").when((F.col("_status") == "ready") & ~F.coalesce("_good", F.lit(False)), "unsupported")
    return j.select("id", F.when(reason.isNull(), F.col("_status")).otherwise("candidate").alias("status"), reason.alias("reason"))
