"""Queries of the stream-shaped operators (STR): batch forms, and streams that run to the end of what they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework.plans.registry import SQL, query
from clausework.sources.scratch import new_folder, written
from clausework.sources.tables import table
from clausework.streaming import stateful as W
from clausework.streaming import streams as S


def log_parts(spark, sf):
    """Turns as parts: some are lost, some altered."""
    from pyspark.sql.window import Window

    c = table(spark, sf, "conversations").withColumn("total", F.count("*").over(Window.partitionBy("conv_id")))
    c = c.where("conv_id % 10 <> 3 or turn + 1 < total").where("conv_id % 10 <> 4 or turn <> 1")
    sha = F.when((F.col("conv_id") % 10 == 5) & (F.col("turn") == 0), "bad").otherwise(F.sha2("text", 256))
    return c.select("conv_id", F.col("turn").cast("int").alias("part"), F.col("total").cast("int").alias("total"), "text", sha.alias("sha"))


@query(
    "str1_log_reassembly",
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations), p AS (SELECT conv_id, turn, total, text, conv_id % 10 = 5 AND turn = 0 AS bad FROM c WHERE (conv_id % 10 <> 3 OR turn + 1 < total) AND (conv_id % 10 <> 4 OR turn <> 1))
SELECT conv_id, count(*) AS parts, CASE WHEN bool_or(bad) OR max(turn) + 1 > max(total) OR max(turn) + 1 <> count(DISTINCT turn) OR count(DISTINCT turn) <> count(*) THEN 'error' WHEN count(*) < max(total) THEN 'incomplete' ELSE 'complete' END AS state,
  sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM p GROUP BY conv_id""",
)
def str1(spark, sf):
    return S.reassembled(log_parts(spark, sf), "conv_id")


@query("str1_log_stream", SQL["str1_log_reassembly"])
def str1_stream(spark, sf):
    """The same rows from a stream: the parts of a log come in four micro-batches, out of order, and a marker three days later brings the end of all waits."""
    parts = log_parts(spark, sf).withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, part, 0)"))
    parts = written(parts.withColumn("_batch", F.pmod(F.xxhash64("conv_id", "part"), F.lit(4))), "parts")
    last = spark.range(1).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("part"), F.lit(1).alias("total"), F.lit("").alias("text"), F.sha2(F.lit(""), 256).alias("sha"), F.expr("timestamp '2024-01-04 00:00:00'").alias("ts"))
    stream = W.files_of([*[parts.where(F.col("_batch") == k).drop("_batch") for k in range(4)], last, last])
    return W.run_to_end(W.reassemble(stream, "conv_id", "1 day")).where("conv_id is not null")


@query(
    "str2_idempotent_delivery",
    """WITH e AS (SELECT event_id, user_id, event_id % 40 AS seq, event_type AS digest FROM events), w AS (SELECT *, row_number() OVER k AS n, first_value(digest) OVER k AS d FROM e WINDOW k AS (PARTITION BY user_id, seq ORDER BY event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'accepted' WHEN digest = d THEN 'repeated' ELSE 'conflict' END AS state FROM w""",
)
def str2(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 40).alias("seq"), F.col("event_type").alias("digest"))
    return S.deliveries(e, ["user_id", "seq"], "digest", ["event_id"]).select("event_id", "state")


@query("str2_delivery_sink", SQL["str2_idempotent_delivery"])
def str2_sink(spark, sf):
    """The same states from a stream of three micro-batches into a sink that keeps a ledger of them."""
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 40).alias("seq"), F.col("event_type").alias("digest"))
    last = e.agg(F.max("event_id")).first()[0] or 0
    stream = W.files_of([e.where((F.col("event_id") > k * last / 3 - (k == 0)) & (F.col("event_id") <= (k + 1) * last / 3)) for k in range(3)])
    folder = new_folder(spark, "deliveries")
    sink = W.delivery_sink(folder, ["user_id", "seq"], "digest", ["event_id"])
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return W.stored_deliveries(spark, folder, e.schema).select("event_id", "state")


@query(
    "str3_rate_limit",
    """WITH e AS (SELECT *, event_id % 97 AS ip FROM events) SELECT event_id, count(*) OVER u AS recent, count(*) OVER u >= 3 OR count(*) OVER i >= 12 AS blocked, CASE WHEN count(*) OVER u >= 3 THEN 'user_id' WHEN count(*) OVER i >= 12 THEN 'ip' END AS by
FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 360 MINUTES PRECEDING AND CURRENT ROW), i AS (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 360 MINUTES PRECEDING AND CURRENT ROW)""",
)
def str3(spark, sf):
    """A limit for each user and a wider one for each address."""
    e = table(spark, sf, "events").withColumn("ip", F.col("event_id") % 97)
    return S.rate_limited(e, {"user_id": 3, "ip": 12}, 360).select("event_id", "recent", "blocked", "by")


def samples(df):
    v = F.col("value")
    slow = F.when(F.col("event_id") % 1000 > 700, 0.5).otherwise(1.0)
    return df.select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), (200 + F.pmod(F.col("event_id"), F.lit(3)) * 100).cast("double").alias("prompt"), (90 + F.col("event_id") % 50).cast("double").alias("predicted"), (slow * (100 + v % 7)).alias("prefill"), (slow * (60 + v % 5)).alias("generation"), F.col("ts").alias("ended"))


@query(
    "str4_throughput_degradation",
    """WITH RECURSIVE s AS (SELECT event_id AS id, event_type AS stage, floor(ln((200 + event_id % 3 * 100)::DOUBLE) / ln(1.25))::INT AS bucket, CASE WHEN event_id % 1000 > 700 THEN 0.5 ELSE 1.0 END::DOUBLE * (100 + value % 7) AS prefill, CASE WHEN event_id % 1000 > 700 THEN 0.5 ELSE 1.0 END::DOUBLE * (60 + value % 5) AS generation, ts AS ended
  FROM events WHERE 90 + event_id % 50 >= 96),
r AS (SELECT *, row_number() OVER (PARTITION BY stage, bucket ORDER BY ended, id) AS n FROM s),
m AS (SELECT stage, bucket, n, ended, median(prefill) OVER w / median(CASE WHEN n <= 5 THEN prefill END) OVER k AS p, median(generation) OVER w / median(CASE WHEN n <= 5 THEN generation END) OVER k AS g FROM r
  WINDOW k AS (PARTITION BY stage, bucket), w AS (PARTITION BY stage, bucket ORDER BY n ROWS 3 PRECEDING)),
l AS (SELECT *, floor(epoch(ended))::BIGINT AS t, row_number() OVER (PARTITION BY stage, bucket ORDER BY floor(epoch(ended)), n) AS seq FROM m WHERE n >= 9 AND p < 0.85 AND g < 0.85),
w AS (SELECT stage, bucket, n, ended, seq, t AS last, true AS fires FROM l WHERE seq = 1
  UNION ALL SELECT l.stage, l.bucket, l.n, l.ended, l.seq, CASE WHEN t - last >= 3600 THEN t ELSE last END, t - last >= 3600 FROM w JOIN l ON l.stage = w.stage AND l.bucket = w.bucket AND l.seq = w.seq + 1)
SELECT stage, bucket, n, ended FROM w WHERE fires""",
)
def str4(spark, sf):
    return S.degradations(samples(table(spark, sf, "events")), "stage", ["ended", "id"])


@query("str4_throughput_stream", SQL["str4_throughput_degradation"])
def str4_stream(spark, sf):
    """The same alarms from a stream: samples come in three micro-batches, out of order within ten minutes, and a marker a year later brings the last of them to their turn."""
    e = samples(table(spark, sf, "events")).withColumn("ended", F.col("ended").cast("timestamp"))
    least, most = e.agg(F.min("ended"), F.max("ended")).first()
    at = (F.unix_micros("ended") - F.unix_micros(F.lit(least))) / F.greatest(F.lit(1), F.unix_micros(F.lit(most)) - F.unix_micros(F.lit(least)))
    moved = F.least(F.lit(2), F.floor(3 * at + F.pmod(F.col("id"), F.lit(7)) / 1e5))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("end").alias("stage"), F.lit(1e3).alias("prompt"), F.lit(1e3).alias("predicted"), F.lit(1.0).alias("prefill"), F.lit(1.0).alias("generation"), (F.lit(most) + F.expr("INTERVAL 365 DAYS")).alias("ended"))
    stream = W.files_of([*[e.where(moved == k) for k in range(3)], last.select(*e.columns), last.select(*e.columns)])
    return W.run_to_end(W.degradation_alarms(stream, "stage", "1 day")).where("stage <> 'end'")


@query("str5_liveness", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, last, last >= (SELECT max(ts) FROM events) - INTERVAL 7200 SECONDS AS alive FROM l")
def str5(spark, sf):
    return S.alive(table(spark, sf, "events"), "user_id", 7200)


@query(
    "str6_session_completeness",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS events, CASE WHEN bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase') THEN 'complete' WHEN bool_or(event_type = 'signup') THEN 'incomplete' ELSE 'stray' END AS state FROM s GROUP BY user_id, s""",
)
def str6(spark, sf):
    out = S.sessions(table(spark, sf, "events"), "user_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return out.withColumn("start", F.unix_micros("start"))
