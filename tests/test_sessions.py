"""Sessions as a stream give what the batch query and a plain walk over the events give."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lexmill.streaming import sessions

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "session_id string, at timestamp, status string"
STALE = 600


def plain(events, now):
    """session, started, seen, events, status of those that are over."""
    out = []
    for name in sorted({e[0] for e in events if e[0] and e[1]}):
        run = None
        for at, _, status in sorted((e[1], (e[2] or "running") in sessions.FINAL, e[2] or "running") for e in events if e[0] == name and e[1]):
            if run and (at - run[1]).total_seconds() > STALE:
                out.append((name, *run, "completed"))
                run = None
            run = (run[0] if run else at, at, run[2] + 1 if run else 1)
            if status in sessions.FINAL:
                out.append((name, *run, status))
                run = None
        if run and (now - run[1]).total_seconds() > STALE:
            out.append((name, *run, "completed"))
    return sorted(out)


def rows(df):
    micros = df.select("session_id", F.unix_micros("started").alias("a"), F.unix_micros("seen").alias("b"), "events", "status").collect()
    at = lambda m: START + timedelta(microseconds=m - int(START.timestamp() * 1_000_000))
    return sorted((r.session_id, at(r.a), at(r.b), r.events, r.status) for r in micros)


def made(seed):
    rnd, out = random.Random(seed), []
    for k in range(12):
        at = rnd.randrange(3000)
        while at < 40_000:
            out.append((f"s{k}", START + timedelta(seconds=at, microseconds=rnd.randrange(3)), rnd.choice([None, "running", "running", "running", "completed", "failed"])))
            at += rnd.choice([0, 30, 200, 600, 601, 2500])
    return out + [("s1", None, "failed"), (None, START, "running")]


def test_batch_equals_a_walk(spark):
    events = made(1)
    df = spark.createDataFrame(events, SCHEMA)
    want = plain(events, max(e[1] for e in events if e[1]))
    assert rows(sessions.ended(df, STALE)) == want and len(want) > 100
    assert rows(sessions.ended(df.limit(0), STALE)) == []


def test_stream_equals_batch(spark, tmp_path):
    events = [e for e in made(2) if e[0] and e[1]]
    # they come out of order by less than the delay, in several batches; then late ones, far behind the watermark
    rnd = random.Random(3)
    come = sorted(events, key=lambda e: e[1] + timedelta(seconds=rnd.randrange(900)))
    parts = [come[k : k + len(come) // 5 + 1] for k in range(0, len(come), len(come) // 5 + 1)]
    end = START + timedelta(days=3)
    parts += [[("end", end, "running")], [("s1", START + timedelta(seconds=5), "failed"), ("late", START, "failed"), ("end", end + timedelta(seconds=5), "running")]]
    for k, part in enumerate(parts):
        path = tmp_path / "events" / f"{k:02}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(path))
    spark.conf.set(*sessions.STORE)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "events"))
        out = sessions.stream_of_ended(stream, STALE, "1000 seconds")
        run = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert run.awaitTermination(300)
    finally:
        spark.conf.unset(sessions.STORE[0])
    got = rows(spark.read.schema(sessions.ENDED).parquet(str(tmp_path / "out")))
    assert got == plain(events, end) == [r for r in rows(sessions.ended(spark.createDataFrame(events + [("end", end, "running")], SCHEMA), STALE))] and len(got) > 100
