"""Log, rate and throughput checks, as batch operators and as streams over the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType
from pyspark.sql.window import Window

FIRST, LAST, DROP, COOLDOWN = 5, 4, 0.85, 3600
LEAST_PROMPT, LEAST_PREDICTED = 200, 96


def reassembled(parts: DataFrame, key: str) -> DataFrame:
    """``parts``: key, part (from 0), total, text, sha -> per key: state and digest of the joined text.

    States: error (gap, repeated part, two totals or a wrong digest), incomplete (the last part is missing), complete.
    """
    listed = F.array_sort(F.collect_list(F.struct("part", "text")))
    g = parts.groupBy(key).agg(
        listed.alias("_l"), F.count("*").alias("parts"), F.count_distinct("part").alias("_d"), F.max("part").alias("_hi"), F.min("total").alias("_t0"), F.max("total").alias("_t1"),
        F.bool_and(F.sha2("text", 256) == F.col("sha")).alias("_ok"),
    )
    broken = (F.col("_t0") != F.col("_t1")) | ~F.col("_ok") | (F.col("_d") != F.col("parts")) | (F.col("_hi") + 1 > F.col("_t1")) | (F.col("_hi") + 1 != F.col("_d"))
    state = F.when(broken, "error").when(F.col("_d") < F.col("_t1"), "incomplete").otherwise("complete")
    return g.select(key, "parts", state.alias("state"), F.sha2(F.array_join(F.transform("_l", lambda x: x.text), ""), 256).alias("digest"))


def deliveries(rows: DataFrame, keys: list[str], digest: str, order: list[str]) -> DataFrame:
    """Adds ``state``: accepted (first of its key), repeated (same digest again) or conflict (another digest)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(digest).over(w)
    return rows.withColumn("state", F.when(F.row_number().over(w) == 1, "accepted").when(F.col(digest) == first, "repeated").otherwise("conflict"))


def rate_limited(rows: DataFrame, limits: dict[str, int], minutes: int = 15, ts: str = "ts") -> DataFrame:
    """Adds ``recent`` (attempts of the first limit's identity in the last minutes, this one included), ``blocked`` (any limit is reached) and ``by`` (the first such limit's column, else null).

    ``limits``: how many attempts each identity column bears, in the order of their weight. Null identities share one count.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    count = {c: F.count("*").over(Window.partitionBy(c).orderBy(at).rangeBetween(-minutes * 60 * 1_000_000, 0)) for c in limits}
    by = F.coalesce(*[F.when(count[c] >= most, F.lit(c)) for c, most in limits.items()])
    return rows.withColumns({"recent": count[next(iter(limits))], "by": by}).withColumn("blocked", F.col("by").isNotNull())


def rate_stream(rows: DataFrame, identity: str, most: int, window: str = "15 minutes", slide: str = "1 minute", wait: str = "24 hours") -> DataFrame:
    """Sliding counts per identity; windows older than the watermark are purged."""
    g = rows.withWatermark("ts", wait).groupBy(F.window("ts", window, slide).alias("w"), identity).agg(F.count("*").alias("recent"))
    return g.where(F.col("recent") >= most).select(identity, F.col("w.end").alias("until"), "recent")


def bucket_of(prompt: Column) -> Column:
    return F.floor(F.log(prompt) / math.log(1.25)).cast("int")


def degradations(samples: DataFrame, stage: str, order: list[str], slice_seconds: int = 3600) -> DataFrame:
    """``samples``: stage, prompt, predicted, prefill, generation (rates), ended -> samples at which both recent medians fall below 85 % of the baseline.

    A bucket is a stage and a prompt size on a scale of 1.25. The first five samples are its baseline; recent are the last four. An alarm
    silences its bucket for an hour, which is a fold over the times of the candidate alarms of the bucket. Buckets are few, so their samples are dealt over slices of time: places and recent samples
    are found within slices, and across them over the at most six samples at a slice's edges. Nulls in a rate or a time leave a sample out.
    """
    s = samples.where((F.col("prompt") >= LEAST_PROMPT) & (F.col("predicted") >= LEAST_PREDICTED) & F.col("prefill").isNotNull() & F.col("generation").isNotNull() & F.col("ended").isNotNull())
    s = s.withColumn("bucket", bucket_of(F.col("prompt"))).withColumn("_t", F.unix_seconds(F.col("ended").cast("timestamp"))).withColumn("_slice", F.floor(F.col("_t") / slice_seconds))
    key, own = [stage, "bucket"], [stage, "bucket", "_slice"]
    inner = Window.partitionBy(*own).orderBy(*order)
    placed = s.withColumn("_r", F.row_number().over(inner)).withColumn("_m", F.count("*").over(Window.partitionBy(*own)))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = s.groupBy(*own).agg(F.count("*").alias("_c")).select(*own, before.alias("_before"))
    ranked = placed.join(offsets, own).withColumn("n", (F.col("_r") + F.col("_before")).cast("int"))
    rates = F.struct("prefill", "generation")
    inside = ranked.withColumn("_last", F.collect_list(rates).over(inner.rowsBetween(1 - LAST, 0))).where(F.col("_r") >= LAST)
    edges = ranked.where((F.col("_r") < LAST) | (F.col("_m") - F.col("_r") < LAST - 1))
    edges = edges.withColumn("_last", F.collect_list(rates).over(Window.partitionBy(*key).orderBy("n").rowsBetween(1 - LAST, 0))).where(F.col("_r") < LAST)
    first = ranked.where(F.col("n") <= FIRST).groupBy(*key).agg(F.median("prefill").alias("_prefill"), F.median("generation").alias("_generation"))
    every = inside.unionByName(edges).where(F.col("n") >= FIRST + LAST).join(F.broadcast(first), key)  # one row a bucket: stages times sizes on a logarithmic scale

    def middle(c):
        own_ = F.array_sort(F.col(f"_last.{c}"))
        return (F.get(own_, F.lit((LAST - 1) // 2)) + F.get(own_, F.lit(LAST // 2))) / 2

    low = every.where((middle("prefill") / F.col("_prefill") < DROP) & (middle("generation") / F.col("_generation") < DROP))
    listed = low.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_t", "n"))).alias("l"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.when(a.last.isNull() | (x["_t"] - a.last >= COOLDOWN), F.struct(x["_t"].alias("last"), F.array_append(a.out, x.n).alias("out"))).otherwise(a)
    alarms = listed.select(*key, F.explode(F.aggregate("l", start, step, lambda a: a.out)).alias("n"))
    return low.join(alarms, [*key, "n"]).select(*key, "n", "ended")


def alive(rows: DataFrame, identity: str, seconds: int = 120, now: Column | None = None) -> DataFrame:
    """``identity, last, alive``: the latest heartbeat lies within the seconds before ``now`` (default: the latest of all, one row of aggregates)."""
    last = rows.groupBy(identity).agg(F.max("ts").alias("last"))
    if now is None:
        now = F.lit(last.agg(F.max("last")).head()[0])
    return last.withColumn("alive", F.unix_micros(F.col("last").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - seconds * 1_000_000)


def sessions(rows: DataFrame, identity: str, started: Column, ended: Column, gap: str = "6 hours") -> DataFrame:
    """``identity, start, events, state`` per session of events less than ``gap`` apart. Works on tables and, with a watermark, on streams."""
    rows = rows if isinstance(rows.schema["ts"].dataType, TimestampType) else rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a cast would lose the watermark
    g = rows.groupBy(identity, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.bool_or(started).alias("_s"), F.bool_or(ended).alias("_e"))
    state = F.when(F.col("_s") & F.col("_e"), "complete").when(F.col("_s"), "incomplete").otherwise("stray")
    return g.select(identity, F.col("w.start").alias("start"), "events", state.alias("state"))
