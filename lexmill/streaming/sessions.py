"""Sessions of running work, from their events, in a batch or as a stream.

A session is a run of events(session_id, at, status) of one id. It ends with its first event of a final status, or when it is
silent for more than `stale`: it is then completed. Later events of the id begin another session. Events at one time are in the
order of status, final ones last; null times and ids are left out; a null status counts as running.

`ended` is the batch query. `stream_of_ended` gives the same rows as a stream, each once its end is certain, whatever the order in which
events come within the watermark's delay; events behind the watermark are late and left out. The state of an id is one open
session, folded up to the watermark, and its events since then: it doesn't grow with the session's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Statuses that end a session; fixed values.
FINAL = ("completed", "failed")
ENDED = "session_id string, started timestamp, seen timestamp, events long, status string"
#: Seconds of one id that are cut in one group.
SPAN = 3_600
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _events(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("session_id").cast("string").alias("session_id"), F.col("at").cast("timestamp").alias("at"), F.coalesce("status", F.lit("running")).alias("status"))
    return rows.where("session_id is not null and at is not null")


def runs(events: DataFrame, stale_seconds: int) -> DataFrame:
    """events(session_id, at, status) -> session_id, started, seen, events, status (running, or a final one) of every session, open ones too."""
    final, micros = F.col("status").isin(*FINAL), lambda c: F.unix_micros(c)
    apart = lambda start, seen, ends, w: F.coalesce((micros(start) - micros(F.lag(seen).over(w)) > stale_seconds * 1_000_000) | F.lag(ends).over(w), F.lit(True)).cast("int")
    upto = lambda w: F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # an id may hold a third of all events: its spans of time are cut on their own, then only the pieces meet
    span = Window.partitionBy("session_id", "span").orderBy("at", "ends", "status")
    each = _events(events).withColumns({"span": F.floor(micros("at") / (SPAN * 1_000_000)), "ends": final})
    each = each.withColumn("fresh", apart("at", "at", "ends", span)).withColumn("piece", upto(span))
    totals = lambda status, n: (F.min("started").alias("started"), F.max("seen").alias("seen"), F.sum(n).alias("events"), F.max(status).alias("status"))
    pieces = each.withColumns({"started": F.col("at"), "seen": F.col("at")}).groupBy("session_id", "span", "piece").agg(*totals(F.when(final, F.col("status")), F.lit(1)))
    whole = Window.partitionBy("session_id").orderBy("span", "piece")
    joined = pieces.withColumn("ends", F.col("status").isNotNull()).withColumn("fresh", apart("started", "seen", "ends", whole)).withColumn("run", upto(whole))
    return joined.groupBy("session_id", "run").agg(*totals("status", "events")).withColumn("status", F.coalesce("status", F.lit("running"))).drop("run")


def ended(events: DataFrame, stale_seconds: int, now: DataFrame | None = None) -> DataFrame:
    """The sessions of `runs` that are over at now(now), one row; by default the time of the last event."""
    now = _events(events).agg(F.max("at").alias("now")) if now is None else now
    over = F.unix_micros(now.select("now").limit(1).scalar()) - F.unix_micros("seen") > stale_seconds * 1_000_000
    rows = runs(events, stale_seconds).where(over | F.col("status").isin(*FINAL))
    return rows.withColumn("status", F.when(F.col("status") == "running", "completed").otherwise(F.col("status")))


class Sessions(StatefulProcessor):
    """Folds an id's events up to the watermark, in their order, and gives the sessions that end there."""

    def __init__(self, stale_seconds: int):
        self.stale = stale_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, seen long, events long")
        self.pending = handle.getListState("pending", "at long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        come = [(at, status) for part in rows for at, status in zip(part["micros"].tolist(), part["status"].tolist(), strict=True) if at >= mark]
        if come:
            self.pending.appendList(come)
            self._wake(min(at for at, _ in come), mark)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        now = self.open.get() if self.open.exists() else None
        now = None if now is None else tuple(now)
        events = sorted((tuple(e) for e in self.pending.get()) if self.pending.exists() else (), key=lambda e: (e[0], e[1] in FINAL, e[1]))
        settled = [e for e in events if e[0] < mark]
        over = []
        for at, status in settled:
            if now and at - now[1] > self.stale:
                over.append((*now, "completed"))
                now = None
            now = (now[0] if now else at, at, now[2] + 1 if now else 1)
            if status in FINAL:
                over.append((*now, status))
                now = None
        if now and mark - now[1] > self.stale:
            over.append((*now, "completed"))
            now = None
        left = events[len(settled) :]
        if left:
            self.pending.put(left)
            self._wake(left[0][0], mark)
        else:
            self.pending.clear()
        if now:
            self.open.update(now)
            self._wake(now[1] + self.stale, mark)
        else:
            self.open.clear()
        if over:
            time = lambda k: pd.to_datetime([x[k] for x in over], unit="us")
            yield pd.DataFrame({"session_id": [key[0]] * len(over), "started": time(0), "seen": time(1), "events": [x[2] for x in over], "status": [x[3] for x in over]})

    def _wake(self, after: int, mark: int) -> None:
        """A timer for the first watermark beyond `after`."""
        self.handle.registerTimer(max(after, mark) // 1000 + 1)

    def close(self) -> None:
        pass


def stream_of_ended(events: DataFrame, stale_seconds: int, late: str = "1 hour") -> DataFrame:
    """The sessions of a stream of events(session_id, at, status), to be written in append mode; ids are dealt by hash. Needs STORE."""
    rows = _events(events).withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(stale_seconds), ENDED, "Append", "EventTime")
