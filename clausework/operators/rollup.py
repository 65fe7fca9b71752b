"""Verdict roll-ups, metrics and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def aggregate_parts(parts: DataFrame, keys: list[str], claim: str, evidence: Column, complete: Column) -> DataFrame:
    """One verdict per obligation from its parts: a contradiction anywhere violates; absence needs all parts absent and the scope complete; satisfied needs all
    parts; not applicable needs evidence; anything else is unknown."""
    n = lambda v: F.count_if(F.col(claim) == v)
    whole = F.bool_and(complete)
    verdict = (
        F.when(n("contradicts") > 0, "violated").when((n("absent") == F.count("*")) & whole, "violated").when((n("supports") == F.count("*")) & whole, "satisfied")
        .when((n("not_applicable") == F.count("*")) & F.bool_and(evidence), "not_applicable").otherwise("unknown")
    )
    return parts.groupBy(*keys).agg(verdict.alias("verdict"), F.count("*").alias("parts"))


def compound(members: DataFrame, key: str, kind: str, verdict: str, expected: str) -> DataFrame:
    """Verdict of an ``all_of`` or ``any_of`` composition; members short of the expected number leave it unknown unless it is decided already."""
    good, bad = F.count_if(F.col(verdict) == "satisfied"), F.count_if(F.col(verdict) == "violated")
    full = F.count("*") == F.max(expected)
    all_of = F.when(bad > 0, "violated").when((good == F.count("*")) & full, "satisfied").otherwise("unknown")
    any_of = F.when(good > 0, "satisfied").when((bad == F.count("*")) & full, "violated").otherwise("unknown")
    return members.groupBy(key).agg(F.when(F.max(kind) == "all_of", all_of).otherwise(any_of).alias("verdict"), F.count("*").alias("members"))


def coverage_states(rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Per key: unverified if any state is unresolved, else checked or not_applicable if all are so, else separate."""
    n = lambda v: F.count_if(F.col(state) == v)
    out = F.when(n("unresolved") > 0, "unverified").when(n("checked") == F.count("*"), "checked").when(n("not_applicable") == F.count("*"), "not_applicable").otherwise("separate")
    return rows.groupBy(*keys).agg(out.alias("state"))


def exclusive_seconds(spans: DataFrame) -> DataFrame:
    """``spans``: id, parent, seconds -> adds ``exclusive``: less the sum of direct children, never below 0."""
    inner = spans.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.sum("seconds").alias("_s"))
    return spans.join(inner, F.col("id") == F.col("_p"), "left").withColumn("exclusive", F.greatest(F.lit(0.0), F.col("seconds") - F.coalesce("_s", F.lit(0.0)))).drop("_p", "_s")


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact n, minimum, median, maximum and total."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"), F.sum(value).alias("total"))


def evaluation(rows: DataFrame, keys: list[str], reference: Column, found: Column) -> DataFrame:
    """Recall over reference items only if all are judged (``found`` not null), precision over the judged ones. Nulls where nothing is judged."""
    judged = found.isNotNull()
    recall = F.when(F.count_if(reference & ~judged) == 0, F.count_if(reference & found) / F.nullif(F.count_if(reference), F.lit(0)))
    precision = F.count_if(reference & found) / F.nullif(F.count_if(judged & found), F.lit(0))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"))


def evaluation_summary(reference: DataFrame, issued: DataFrame, controls: DataFrame, dimensions: list[str]) -> DataFrame:
    """``dimension, value, n, hits, rate``: a report held against adjudicated reference items.

    ``reference``: id, the dimensions (category, severity), found (null: not judged); ``issued``: id, locators (array), verdict (correct, partially_correct, incorrect; null: not judged), duplicate_of (null: none); ``controls``:
    id, locators (array), triggered (null: not judged). Rows: ``all`` and every value of each dimension (null as ``unspecified``) with items, found ones and recall, null unless all items are judged; ``precision`` over the
    judged findings (partly correct ones don't count as correct); ``duplicates``, the fraction of findings that are duplicates, null unless all are judged; ``controls`` with those that overlap a
    finding in a locator and, as the rate, the share of triggered ones, null unless all are judged. An empty ``reference`` has no row of its own.
    """
    own = reference.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unspecified")).alias(d) for d in dimensions], "found")
    g = own.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(F.count("*").alias("n"), F.count_if("found").alias("hits"), F.count_if(F.col("found").isNull()).alias("_open"), F.grouping_id().alias("_g"))
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        bit = (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i))
        name, value = F.when(F.col("_g") == bit, d).otherwise(name), F.when(F.col("_g") == bit, F.col(d)).otherwise(value)
    complete = F.sum("_open").over(Window.partitionBy("_g")) == 0  # one row a value
    recall = g.select(name.alias("dimension"), value.alias("value"), "n", "hits", F.when(complete & (F.col("n") > 0), F.col("hits") / F.col("n")).alias("rate"))
    judged = F.count("verdict")
    told = issued.agg(F.count("*").alias("_all"), judged.alias("_judged"), F.count_if(F.col("verdict") == "correct").alias("_right"), F.count_if(F.col("verdict").isNotNull() & F.col("duplicate_of").isNotNull()).alias("_twice"))
    nothing = F.lit(None).cast("string").alias("value")
    precision = told.select(F.lit("precision").alias("dimension"), nothing, F.col("_judged").alias("n"), F.col("_right").alias("hits"), F.when(F.col("_judged") > 0, F.col("_right") / F.col("_judged")).alias("rate"))
    twice = told.select(F.lit("duplicates").alias("dimension"), nothing, F.col("_all").alias("n"), F.col("_twice").alias("hits"), F.when((F.col("_judged") == F.col("_all")) & (F.col("_all") > 0), F.col("_twice") / F.col("_all")).alias("rate"))
    places = issued.select(F.explode("locators").alias("_at")).distinct()
    near = controls.select("id", F.explode("locators").alias("_at")).join(places, "_at", "left_semi").select(F.col("id").alias("_near")).distinct()
    c = controls.join(near, F.col("id") == F.col("_near"), "left").agg(F.count("*").alias("n"), F.count("_near").alias("hits"), F.when((F.count("triggered") == F.count("*")) & (F.count("*") > 0), F.count_if("triggered") / F.count("*")).alias("rate"))
    return recall.unionByName(precision).unionByName(twice).unionByName(c.select(F.lit("controls").alias("dimension"), nothing, "n", "hits", "rate"))


def span_profile(lines: DataFrame, line: str, fields: str) -> DataFrame:
    """``kind, name, n, errors, total, exclusive``: a profile of log lines in JSON (``fields``: DDL with kind, name, status, session, seconds, exclusive_seconds, value).

    ``phase``: calls, those not ``ok``, seconds and exclusive seconds; ``observation``: count and sum; ``sessions`` of state ``complete``, ``incomplete`` (started only) or ``stray`` (ended only), with the wall seconds of
    ended ones; ``malformed``: lines that are no JSON object of a known kind with the members that its kind needs.
    """
    r = lines.select(F.from_json(line, fields, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    has = lambda *c: reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in c])
    kind = F.when((F.col("kind") == "start") & has("session"), "start").when((F.col("kind") == "end") & has("session", "seconds"), "end").when((F.col("kind") == "span") & has("name", "status", "seconds", "exclusive_seconds"), "span").when((F.col("kind") == "observation") & has("name", "value"), "observation").otherwise("malformed")
    r = r.withColumn("kind", kind)
    flat = r.where(F.col("kind").isin("span", "observation", "malformed")).groupBy(F.when(F.col("kind") == "span", "phase").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") != "malformed", F.col("name")).alias("name")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("errors"), F.sum(F.when(F.col("kind") == "span", F.col("seconds")).when(F.col("kind") == "observation", F.col("value"))).alias("total"), F.sum(F.when(F.col("kind") == "span", F.col("exclusive_seconds"))).alias("exclusive"))
    s = r.where(F.col("kind").isin("start", "end")).groupBy("session").agg(F.bool_or(F.col("kind") == "start").alias("a"), F.bool_or(F.col("kind") == "end").alias("b"), F.sum(F.when(F.col("kind") == "end", F.col("seconds"))).alias("_wall"))
    state = F.when(F.col("a") & F.col("b"), "complete").when(F.col("a"), "incomplete").otherwise("stray")
    return flat.unionByName(s.groupBy(F.lit("sessions").alias("kind"), state.alias("name")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("errors"), F.sum("_wall").alias("total"), F.lit(None).cast("double").alias("exclusive")))


def compact(rows: DataFrame, keys: list[str], evidence: str, most: int = 24) -> DataFrame:
    """One row per key with its first ``most`` pieces of evidence and the number of the others."""
    w = Window.partitionBy(*keys).orderBy(evidence)
    ranked = rows.select(*keys, evidence).withColumn("_n", F.row_number().over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col(evidence))))
    return ranked.groupBy(*keys).agg(shown.alias("shown"), F.greatest(F.lit(0), F.count("*") - most).alias("more"))


def compact_coverage(rows: DataFrame, keys: list[str], state: str, order: str, locator: str, section: str, most: int = 20) -> DataFrame:
    """``keys, occurrences, locators, sections``: measured and unverified results of one check as one row each, with their number and samples of the first ``most`` locators and sections by ``order`` (null ones left
    out, repeated ones kept). Each task keeps its own first ones before they are ranked, so no key is gathered."""
    known = rows.where(F.col(state).isin("measured", "unverified"))
    counted = known.groupBy(*keys, state).agg(F.count("*").alias("occurrences"))
    out = counted
    for name, c in (("locators", locator), ("sections", section)):
        ranked = known.where(F.col(c).isNotNull()).select(*keys, state, order, c).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, state).orderBy(order, c))).where(F.col("_n") <= most)
        got = ranked.groupBy(*keys, state).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(c).alias("v")))), lambda x: x.v).alias(name))
        same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, state]])
        out = out.alias("a").join(got.alias("b"), same, "left").select("a.*", F.coalesce(f"b.{name}", F.array().cast(got.schema[name].dataType)).alias(name))
    return out


def stage_times(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``job, stage, seconds, inputs, outputs``; ``job, prompt_rate, generation_rate``): medians over tasks whose result wasn't taken from a cache; numbers of zero or less are no sample."""
    fresh = tasks.where(~F.coalesce("cached", F.lit(False)))
    some = lambda c: F.median(F.when(F.col(c) > 0, F.col(c)))
    by_stage = fresh.groupBy("job", "stage").agg(F.median(F.col("ended") - F.col("started")).alias("seconds"), some("prompt").alias("inputs"), some("completion").alias("outputs"))
    return by_stage, fresh.groupBy("job").agg(some("prompt_rate").alias("prompt_rate"), some("generation_rate").alias("generation_rate"))


def derived_work(jobs: DataFrame, tasks: DataFrame, facts: DataFrame, references: DataFrame, findings: DataFrame, facts_a_task: int = 8, blocks_a_task: int = 12, directions: int = 12, findings_a_task: int = 3) -> DataFrame:
    """``job, stage, future``: tasks that don't exist yet, of stages that are made from the results of others.

    ``cross``, from the facts of logic tasks: one task for every ``facts_a_task`` facts of a topic that stands in two places or more, scaled from the finished logic tasks to all of them (a third of them
    while none is finished), and one for every ``blocks_a_task`` blocks of a document that refer elsewhere. ``inter``: ``directions`` for each group of related documents. ``verify``: one for every ``findings_a_task``
    candidates, those that exist and those that the work ahead will make at the rate so far (0.3 a task while nothing is analysed). A stage that a job names in ``derived`` is made already.

    ``jobs``: job, derived (array), related (groups), check_logic; ``facts``: job, topic, place; ``references``: job, document, n; ``findings``: job, status.
    """
    made = lambda stage: F.array_contains(F.coalesce("derived", F.array().cast("array<string>")), stage)
    logic = F.col("stage") == "logic"
    counts = tasks.groupBy("job").agg(
        F.count_if(logic).alias("_logic"), F.count_if(logic & F.col("state").isin("done", "split")).alias("_finished"),
        F.count_if((F.col("state") == "done") & (F.col("stage") != "verify")).alias("_analysed"), F.count_if(F.col("state").isin("pending", "running") & (F.col("stage") != "verify")).alias("_ahead"),
    )
    topics = facts.groupBy("job", "topic").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places")).where("places >= 2").groupBy("job").agg(F.sum(F.ceil(F.col("n") / facts_a_task)).alias("_groups"))
    links = references.groupBy("job").agg(F.sum(F.ceil(F.col("n") / blocks_a_task)).alias("_links"))
    found = findings.groupBy("job").agg(F.count_if(F.col("status") == "candidate").alias("_candidates"), F.count_if(~F.col("status").isin("style", "candidate", "verifying")).alias("_reviewed"))
    j = jobs
    for part in (counts, topics, links, found):
        j = j.join(part, "job", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    projected = F.when(n("_finished") > 0, F.ceil(n("_groups") * n("_logic") / F.greatest(n("_finished"), F.lit(1)))).otherwise(F.ceil(n("_logic") / 3))
    cross = F.when(~made("cross") & F.coalesce("check_logic", F.lit(True)), projected + n("_links"))
    inter = F.when(~made("inter"), directions * n("related"))
    rate = F.when(n("_analysed") > 0, n("_reviewed") / F.greatest(n("_analysed"), F.lit(1))).otherwise(0.3)
    verify = F.when(~made("verify"), F.ceil((n("_candidates") + (n(cross) + n(inter) + n("_ahead")) * rate) / findings_a_task))
    each = F.array(*[F.struct(F.lit(s).alias("stage"), c.cast("long").alias("future")) for s, c in (("cross", cross), ("inter", inter), ("verify", verify))])
    return j.select("job", F.inline(each)).where("future is not null")


def forecast(jobs: DataFrame, tasks: DataFrame, future: DataFrame, outputs: dict[str, int]) -> DataFrame:
    """``job, stage, open, future, seconds``: the time that is left of each stage, for its pending and running tasks and for those of ``future`` (``derived_work``).

    A task takes its prompt by the job's median rate, its output by the other, and a second; where a rate is unknown, its stage's median time, or 35 s. The prompt is the task's ``input``, or the stage's median, or
    4000 tokens; the output is the stage's median, or what ``outputs`` says, or 1000. A pending task whose result is ``known`` takes a second, a running one what is left of its time at ``now`` (of jobs), at least
    three seconds.

    ``tasks``: job, stage, state, started, ended, cached, known, input, prompt, completion, prompt_rate, generation_rate; ``jobs``: job, now.
    """
    by_stage, by_job = stage_times(tasks)
    default = F.create_map(*[F.lit(x) for kv in outputs.items() for x in kv])

    def seconds(prompt: Column) -> Column:
        size_in = F.coalesce(F.nullif(prompt, F.lit(0)), "inputs", F.lit(4000))
        size_out = F.coalesce("outputs", F.element_at(default, F.col("stage")), F.lit(1000))
        by_rate = size_in / F.col("prompt_rate") + size_out / F.col("generation_rate") + 1
        return F.coalesce(by_rate, "seconds", F.lit(35.0))

    known = lambda df: df.join(by_stage, ["job", "stage"], "left").join(by_job, "job", "left")
    open_ = tasks.where(F.col("state").isin("pending", "running")).select("job", "stage", "state", "started", "known", "input")
    one = F.when((F.col("state") == "pending") & F.coalesce("known", F.lit(False)), 1.0).otherwise(seconds(F.col("input")))
    left = F.when(F.col("state") == "running", F.greatest(F.lit(3.0), one - F.coalesce(F.col("now") - F.col("started"), F.lit(0)))).otherwise(one)
    rows = known(open_).join(jobs.select("job", "now"), "job", "left").select("job", "stage", F.lit(1).alias("open"), F.lit(0).cast("long").alias("future"), left.alias("s"))
    later = known(future).select("job", "stage", F.lit(0).alias("open"), "future", (F.col("future") * seconds(F.lit(None).cast("long"))).alias("s"))
    return rows.unionByName(later).groupBy("job", "stage").agg(F.sum("open").alias("open"), F.sum("future").alias("future"), F.sum("s").alias("seconds"))


def analysis_summary(cards: DataFrame, dimensions: list[str], dependencies: DataFrame, queue: DataFrame) -> DataFrame:
    """``dimension, value, n``: cards by each dimension and in all, dependencies of the cards that are unresolved, and the length of the review queue.

    ``dependencies``: id (of a card), unresolved. All dimensions come from one pass of grouping sets; a null value of a dimension is a value.
    """
    g = cards.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    own = [(1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i)) for i in range(len(dimensions))]
    name, value = F.lit("cards"), F.lit(None).cast("string")
    for d, bit in zip(dimensions, own, strict=True):
        name, value = F.when(F.col("_g") == bit, d).otherwise(name), F.when(F.col("_g") == bit, F.col(d).cast("string")).otherwise(value)
    open_ = dependencies.where("unresolved").join(cards.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("n"))
    counted = lambda df, label: df.select(F.lit(label).alias("dimension"), F.lit(None).cast("string").alias("value"), "n")
    return g.select(name.alias("dimension"), value.alias("value"), "n").unionByName(counted(open_, "unresolved dependencies")).unionByName(counted(queue.agg(F.count("*").alias("n")), "review queue"))


def review_queue(cards: DataFrame, ledger: DataFrame) -> DataFrame:
    """``locator, candidate, reason``: cards and fragments without a card that need review. ``cards``: locator, id, state, reason; ``ledger``: locator, state, reason."""
    need = F.col("state") == "needs_review"
    kind = cards.schema["id"].dataType
    return cards.where(need).select("locator", F.col("id").alias("candidate"), "reason").unionByName(ledger.where(need).select("locator", F.lit(None).cast(kind).alias("candidate"), "reason"))
