import datetime
from hashlib import sha256

from pyspark.sql import functions as F

from clausework.plans import stream as P
from clausework.sources.scratch import new_folder
from clausework.streaming import stateful as W
from clausework.streaming import streams as S

PART = "k string, part int, total int, text string, sha string, ts timestamp"
DAY = datetime.datetime(2024, 1, 1)


def part(k, i, total, text="t", sha=None, minute=0):
    return (k, i, total, text, sha or sha256(text.encode()).hexdigest(), DAY + datetime.timedelta(minutes=minute))


def same(a, b, columns):
    assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


def test_reassembly_over_micro_batches(spark):
    """Parts of a log in several micro-batches, also two totals, a repeated part, a wrong digest and a part out of range that only show across them: as the batch form says."""
    first = [part("whole", 1, 3, "b"), part("totals", 0, 2), part("again", 0, 3, "x"), part("digest", 0, 1, sha="bad"), part("range", 0, 2), part("gap", 0, 3), part("short", 0, 3), part("one", 0, 1, "")]
    second = [part("whole", 0, 3, "a", minute=3), part("totals", 1, 3, minute=3), part("again", 0, 3, "x", minute=5), part("range", 5, 2, minute=3), part("gap", 2, 3, minute=3), part("short", 1, 3, minute=2)]
    third = [part("whole", 2, 3, "c", minute=9)]
    end = [part("end", 0, 1, minute=60 * 24 * 3)]
    frames = [spark.createDataFrame(x, PART) for x in (first, second, third)]
    last = spark.createDataFrame(end, PART)
    got = W.run_to_end(W.reassemble(W.files_of([*frames, last, last]), "k", "6 hours")).where("k <> 'end'")
    batch = S.reassembled(frames[0].unionByName(frames[1]).unionByName(frames[2]), "k")
    same(got, batch, ["k", "parts", "state", "digest"])
    assert {r.k: r.state for r in got.collect()} == {"whole": "complete", "one": "complete", "short": "incomplete", **dict.fromkeys(["totals", "again", "digest", "range", "gap"], "error")}


def test_state_calls_of_a_log_do_not_grow_with_its_parts():
    """each part of a log took two or three calls on the state, each a round trip; now a micro-batch reads and writes a log's facts once. A part that came twice in a log of the right count is told."""
    import pandas as pd

    class State:
        def __init__(self):
            self.value, self.calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def appendList(self, rows):
            self.calls, self.value = self.calls + 1, [*(self.value or []), *rows]

        def clear(self):
            self.value = None

    class Handle:
        timers: set = set()
        registerTimer = staticmethod(timers.add)
        deleteTimer = staticmethod(timers.remove)

    log = W._Reassembly(60_000)
    log.handle, log.facts, log.texts = Handle, State(), State()
    frame = lambda ids: [pd.DataFrame([part("k", i, 90, str(i), minute=i) for i in ids], columns=["k", "part", "total", "text", "sha", "ts"])]
    assert list(log.handleInputRows(("k",), frame(range(0, 90, 2)), None)) == []
    assert log.facts.calls + log.texts.calls == 3 and len(Handle.timers) == 1
    (done,) = log.handleInputRows(("k",), frame(range(1, 90, 2)), None)
    assert (done.parts[0], done.state[0], done.digest[0]) == (90, "complete", sha256("".join(map(str, range(90))).encode()).hexdigest())
    assert log.facts.calls + log.texts.calls == 7 and len(Handle.timers) == 1 and list(log.handleExpiredTimer(("k",), None, None)) == []
    list(log.handleInputRows(("k",), frame([*range(89), 0]), None))
    (twice,) = log.handleExpiredTimer(("k",), None, None)
    assert twice.state[0] == "error" and twice.parts[0] == 90


def test_reassembly_after_a_restart(spark):
    """A second run of the same query goes on with the state of the first one."""
    source, folder = new_folder(spark, "source"), new_folder(spark, "stream")
    run = lambda rows: W.run_to_end(W.reassemble(W.files_of([spark.createDataFrame(rows, PART)], source), "k", "6 hours"), folder)
    assert run([part("a", 0, 2, "x"), part("b", 0, 2)]).count() == 0
    got = run([part("a", 1, 2, "y", minute=4)]).collect()
    assert [(r.k, r.parts, r.state, r.digest) for r in got] == [("a", 2, "complete", sha256(b"xy").hexdigest())]
    run([part("end", 0, 1, minute=60 * 24 * 3)])
    got = run([part("end", 0, 1, minute=60 * 24 * 3)]).where("k <> 'end'").collect()
    assert sorted((r.k, r.state) for r in got) == [("a", "complete"), ("b", "incomplete")]


def test_registered_streams(spark, sf):
    same(P.str1_stream(spark, sf), P.str1(spark, sf), ["conv_id", "parts", "state", "digest"])
    assert {r.state for r in P.str1(spark, sf).select("state").distinct().collect()} == {"complete", "incomplete", "error"}
    same(P.str2_sink(spark, sf), P.str2(spark, sf), ["event_id", "state"])
    same(P.str4_stream(spark, sf), P.str4(spark, sf).withColumn("ended", F.col("ended").cast("timestamp")), ["stage", "bucket", "n", "ended"])
    assert P.str4(spark, sf).count() > 0


def test_replayed_batches_add_nothing(spark):
    """A batch that comes again, after its ledger entry or after a crash before it, changes nothing; conflicts are found within a batch and across batches."""
    folder = new_folder(spark, "sink")
    shape = "id int, job string, seq int, digest string"
    sink = W.delivery_sink(folder, ["job", "seq"], "digest", ["id"])
    zero = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 0, "x"), (3, "a", 0, "y"), (4, None, 1, "n")], shape)
    one = spark.createDataFrame([(5, "a", 0, "x"), (6, "a", 0, "z"), (7, "b", 0, "q")], shape)
    assert W.stored_deliveries(spark, folder, zero.schema) is None
    sink(zero, 0)
    state = lambda: {r.id: r.state for r in W.stored_deliveries(spark, folder, zero.schema).collect()}
    assert state() == {1: "accepted", 2: "repeated", 3: "conflict", 4: "accepted"}
    sink(zero, 0)
    S.deliveries(one, ["job", "seq"], "digest", ["id"]).write.parquet(f"{folder}/rows/batch=1")  # a crash before the entry
    assert set(state()) == {1, 2, 3, 4}
    for _ in range(2):
        sink(one, 1)
        assert state() == {1: "accepted", 2: "repeated", 3: "conflict", 4: "accepted", 5: "repeated", 6: "conflict", 7: "accepted"}


def test_two_limits(spark):
    rows = [(i, "u" if i < 5 else f"v{i}", "ip", DAY + datetime.timedelta(minutes=i)) for i in range(12)] + [(20, "u", "other", DAY + datetime.timedelta(minutes=40))]
    got = {r.id: (r.recent, r.blocked, r.by) for r in S.rate_limited(spark.createDataFrame(rows, "id int, who string, ip string, ts timestamp"), {"who": 4, "ip": 9}).collect()}
    assert [got[i] for i in (2, 3, 4, 7, 8, 20)] == [(3, False, None), (4, True, "who"), (5, True, "who"), (1, False, None), (1, True, "ip"), (1, False, None)]


def test_sessions_and_rates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = S.sessions(e, "user_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    assert batch.agg(F.sum("events")).first()[0] == e.count()
    last = e.limit(1).withColumns({"user_id": F.lit(-1).cast(e.schema["user_id"].dataType), "ts": F.expr("timestamp '2200-01-01 00:00:00'")})
    stream = lambda: W.files_of([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), last, last])
    got = W.run_to_end(S.sessions(stream().withWatermark("ts", "60 days"), "user_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")).where("user_id >= 0")
    same(got, batch, ["user_id", "start", "events", "state"])
    counts = W.run_to_end(S.rate_stream(stream(), "user_id", 2, "360 minutes", "60 minutes", "60 days"))
    assert counts.where("recent < 2").count() == 0 and counts.count() > 0


def test_one_timer_a_bucket():
    """each timer that expires reads what waits, so a bucket keeps one timer and not one for each ten minutes that hold samples."""

    class State:
        def __init__(self, many):
            self.rows, self.many, self.reads = None, many, 0

        def exists(self):
            return self.rows is not None

        def get(self):
            self.reads += 1
            return iter(self.rows) if self.many else self.rows

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows = [*(self.rows or []), *rows]

        def update(self, row):
            self.rows = row

        def clear(self):
            self.rows = None

    class Handle:
        timers: set = set()

        def getListState(self, name, shape):
            return State(True)

        def getValueState(self, name, shape):
            return State(False)

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

        def listTimers(self):
            return iter(sorted(self.timers))

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    import pandas as pd

    handle, processor = Handle(), W._Throughput(600_000)
    processor.init(handle)
    start, step = 1_704_067_200_000_000, 300_000_000
    frame = pd.DataFrame({"at": [start + i * step for i in range(1000)], "id": range(1000), "prefill": [100.0] * 500 + [50.0] * 500, "generation": 60.0})
    frame.loc[500:, "generation"] = 30.0
    list(processor.handleInputRows(("s", 1), iter([frame[500:], frame[:500]]), None))
    assert len(handle.timers) == 1
    out = []
    for until in (400, 2000):
        clock = Clock((start + until * step) // 1000)
        for timer in [t for t in sorted(handle.timers) if t <= clock.ms]:
            out += [f for f in processor.handleExpiredTimer(("s", 1), clock, timer)]
            handle.deleteTimer(timer)
        assert len(handle.timers) == (1 if until == 400 else 0)
    assert processor.waiting.reads == 2 and processor.place.get()[0] == 1000
    assert pd.concat(out).n.tolist()[:2] == [502, 514]
