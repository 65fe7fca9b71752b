"""Streams with state of their own: log reassembly and throughput alarms on ``transformWithStateInPandas``, and an idempotent sink.

State lives in RocksDB under the query's checkpoint: values and lists that grow by appending, so a key's past is not rewritten with each micro-batch, and event-time timers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clausework.sources.scratch import new_folder
from clausework.streaming.streams import COOLDOWN, DROP, FIRST, LAST, LEAST_PREDICTED, LEAST_PROMPT, bucket_of, deliveries

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(out: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that its source holds, in as many micro-batches as the source cuts it to, and returns what it put out. ``folder`` keeps output and checkpoint: a second run with the
    same folder goes on where the first one ended."""
    spark, folder = out.sparkSession, folder or new_folder(out.sparkSession, "stream")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def files_of(parts: list[DataFrame], folder: str | None = None) -> DataFrame:
    """A stream of the rows of ``parts``, one micro-batch or more for each, in their order: they are written to the shared folder one after another and read a file at a time.
    A part is one file and so copied by one task: what is costly to compute belongs in a table before."""
    spark, folder = parts[0].sparkSession, folder or new_folder(parts[0].sparkSession, "source")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


class _Reassembly(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "parts long, low int, high int, top int, bad boolean, done boolean, timer long")
        self.texts = handle.getListState("texts", "part int, text string")

    def handleInputRows(self, key, rows, timerValues):
        """Each call on the state is a round trip: a micro-batch of a key reads and writes its facts once and appends its texts once."""
        parts, low, high, top, bad, done, timer = self.facts.get() or (0, None, None, -1, False, False, None)
        latest, added = 0, []
        for pdf in rows:
            latest = max(latest, int(pdf.ts.max().value // 1_000_000))
            for part, total, text, sha in zip(pdf.part.tolist(), pdf.total.tolist(), pdf.text, pdf.sha, strict=True):
                bad = bad or hashlib.sha256(text.encode()).hexdigest() != sha
                low, high, top, parts = total if low is None else min(low, total), total if high is None else max(high, total), max(top, part), parts + 1
                added.append((part, text))
        self.texts.appendList(added)
        bad = bad or low != high or top + 1 > high
        if latest + self.wait_ms != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = latest + self.wait_ms
            self.handle.registerTimer(timer)
        if not bad and parts == high and not done:
            again, row = self._joined(key, parts, "complete")
            if not again:
                done = True
                yield row
        self.facts.update((parts, low, high, top, bad, done, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        parts, _, high, top, bad, done, _ = self.facts.get()
        if bad or top + 1 != parts:
            yield self._joined(key, parts, "error")[1]
        elif not done:
            again, row = self._joined(key, parts, "incomplete" if parts < high else "complete")
            yield row if not again else row.assign(state="error")
        for state in (self.facts, self.texts):
            state.clear()

    def _joined(self, key, parts, name):
        """(whether a part came twice, the row): both from the texts, as parts are counted."""
        texts = sorted(tuple(x) for x in self.texts.get())
        digest = hashlib.sha256("".join(t for _, t in texts).encode()).hexdigest()
        return len({p for p, _ in texts}) < len(texts), pd.DataFrame({"key": [key[0]], "parts": [parts], "state": [name], "digest": [digest]})



def reassemble(parts: DataFrame, key: str, wait: str = "1 hour") -> DataFrame:
    """Stream form of ``reassembled``: ``parts`` also has ``ts``. A log is put out as complete with its last part; ``wait`` after its newest part, by a timer, as an error (a gap, a repeated part, two totals or a
    wrong digest, wherever they arrived) or as incomplete. A part that comes between its log's completion and the timer makes an error row of its own. Later than ``wait``, rows are dropped as late.

    A key's texts are a list to which a micro-batch appends; its counts and totals are a value. Whether a part came twice is told from the list, when a row is put out.
    """
    kind, (n, unit) = parts.schema[key].dataType.simpleString(), wait.split()
    ms = int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000
    out = parts.select(F.col(key).alias("key"), "part", "total", "text", "sha", "ts").withWatermark("ts", wait).groupBy("key")
    found = out.transformWithStateInPandas(_Reassembly(ms), f"key {kind}, parts long, state string, digest string", "Append", "EventTime")
    return found.withColumnRenamed("key", key)


class _Throughput(StatefulProcessor):
    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, prefill double, generation double")
        self.base = handle.getListState("base", "prefill double, generation double")
        self.recent = handle.getListState("recent", "prefill double, generation double")
        self.place = handle.getValueState("place", "n int, alarm long")
        self.next = handle.getValueState("next", "timer long")

    def handleInputRows(self, key, rows, timerValues):
        added = [(int(r.at), int(r.id), float(r.prefill), float(r.generation)) for pdf in rows for r in pdf.itertuples()]
        self.waiting.appendList(added)
        self._wake(min(a for a, *_ in added))
        yield from ()

    def _wake(self, at):
        """One timer a bucket, for the earliest sample that waits: each timer that expires reads all that wait."""
        timer = (at // 1000 // self.every_ms + 1) * self.every_ms
        now = self.next.get()[0] if self.next.exists() else None
        if now is not None and now <= timer:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(timer)
        self.next.update((timer,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.next.clear()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = sorted(x for x in held if x[0] <= until), [x for x in held if x[0] > until]
        if rest:
            self._wake(max(min(x[0] for x in rest), until))
        if not ready:
            return
        n, alarm = self.place.get() if self.place.exists() else (0, None)
        base = [tuple(x) for x in self.base.get()] if self.base.exists() else []
        recent = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        out, normal = [], None
        for at, _, *rates in ready:
            n += 1
            if n <= FIRST:
                base.append(tuple(rates))
            recent = [*recent, tuple(rates)][-LAST:]
            seconds = at // 1_000_000
            if n < FIRST + LAST or (alarm is not None and seconds - alarm < COOLDOWN):
                continue
            normal = normal or [_median(base, i) for i in (0, 1)]
            if all(_median(recent, i) / normal[i] < DROP for i in (0, 1)):
                alarm = seconds
                out.append((key[0], key[1], n, at))
        self.place.update((n, alarm))
        self.base.put(base)
        self.recent.put(recent)
        self.waiting.put(rest) if rest else self.waiting.clear()
        yield pd.DataFrame(out, columns=["stage", "bucket", "n", "at"])

    def close(self) -> None:
        pass


def _median(rows: list[tuple], i: int) -> float:
    x = sorted(r[i] for r in rows)
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def degradation_alarms(samples: DataFrame, stage: str, wait: str = "1 hour", every_seconds: int = 600) -> DataFrame:
    """Stream form of ``degradations``; ``ended`` is the event time. Samples may arrive in any order within ``wait``: they wait in a list until the watermark has passed them, and are then taken in order of time
    and id. A bucket keeps its first five and last four samples, its count and its last alarm. Samples that are too small or lack a rate or time are left out, as in the batch form."""
    kind = samples.schema[stage].dataType.simpleString()
    s = samples.where((F.col("prompt") >= LEAST_PROMPT) & (F.col("predicted") >= LEAST_PREDICTED) & F.col("prefill").isNotNull() & F.col("generation").isNotNull() & F.col("ended").isNotNull())
    s = s.select(F.col(stage).alias("stage"), bucket_of(F.col("prompt")).alias("bucket"), F.unix_micros(F.col("ended").cast("timestamp")).alias("at"), "id", "prefill", "generation", F.col("ended").cast("timestamp").alias("ended"))
    out = s.withWatermark("ended", wait).groupBy("stage", "bucket").transformWithStateInPandas(_Throughput(every_seconds * 1000), f"stage {kind}, bucket int, n int, at long", "Append", "EventTime")
    return out.select(F.col("stage").alias(stage), "bucket", "n", F.timestamp_micros("at").alias("ended"))


def delivery_sink(folder: str, keys: list[str], digest: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch`` that takes each delivery once: rows get ``state`` accepted, repeated or conflict against all batches before, and are stored by batch id.

    A batch's rows are one folder, written over if the batch comes again, and a ledger of batch ids says which folders count; the ledger's entry is written last. So a batch that is replayed after a crash, before
    or after its entry, adds nothing and changes nothing, and a batch without an entry is not seen by others. ``stored_deliveries`` reads the result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = stored_deliveries(spark, folder, batch.schema)
        if stored is not None and not stored.where(F.col("batch") == batch_id).isEmpty():
            return
        judged = deliveries(batch, keys, digest, order)
        if stored is not None:
            old = stored.where("state = 'accepted'").select(*keys, F.col(digest).alias("_old"))
            known = F.when(F.col("_old").isNull(), F.col("state")).when(F.col("_old") == F.col(digest), "repeated").otherwise("conflict")
            judged = judged.join(old, keys, "left").withColumn("state", known).drop("_old")
        judged.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/entry={batch_id}")

    return write


def stored_deliveries(spark: SparkSession, folder: str, schema: StructType) -> DataFrame | None:
    """Rows (of ``schema``) of the batches that the ledger holds, with ``state`` and ``batch``; None before the first one."""
    try:
        ledger = spark.read.schema("batch long").parquet(f"{folder}/ledger/entry=*")
        ledger = ledger.select("batch").distinct()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    full = StructType([*schema.fields, StructField("state", StringType()), StructField("batch", LongType())])
    return spark.read.schema(full).parquet(f"{folder}/rows").join(F.broadcast(ledger), "batch", "left_semi")  # one row a batch
