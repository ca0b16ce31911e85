"""A keyed counter of attempts with a cap for each session and one for each day, as arbitrary state of a stream.

Each service has its own state: attempts by day and by session. A request counts
unless its session, or else its day, has reached its cap; a request that is turned
away counts nowhere. Timers of event time drop a day's count once the watermark has passed its end
and a session's count once it has been idle for as long as the caller says, so state doesn't grow with
the stream. Days are those of UTC; a late request counts on its own day.

Requests of a service are taken in the order of time and id within a batch of rows that Spark
hands over, and batch by batch as they come. Rows without service, session or time are turned away as
``invalid``. The state and its timers live in the checkpoint: a restarted stream goes on counting
where it was. RocksDB is the store that this kind of state needs (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SESSION_CAP, DAY_CAP = 5, 50
DAY_MS = 86_400_000
RESULT = "service string, session string, id long, at timestamp, allowed boolean, reason string, of_session int, of_day int"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Counter(StatefulProcessor):
    def __init__(self, session_cap: int, day_cap: int, idle_ms: int):
        self.session_cap, self.day_cap, self.idle_ms = session_cap, day_cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "n int")
        self.sessions = handle.getMapState("sessions", "session string", "n int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame, out = frame.sort_values(["at", "id"]), []
            for session, request, at in zip(frame.session, frame.id, frame["at"], strict=True):
                ms = int(at.timestamp() * 1000)
                day = ms // DAY_MS
                n, last = self.sessions.getValue((session,)) if self.sessions.containsKey((session,)) else (0, ms)
                of_day = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
                reason = "session" if n >= self.session_cap else "day" if of_day >= self.day_cap else None
                if reason is None:
                    n, of_day = n + 1, of_day + 1
                    self.days.updateValue((day,), (of_day,))
                    self.handle.registerTimer((day + 1) * DAY_MS)
                self.sessions.updateValue((session,), (n, max(last, ms)))
                self.handle.registerTimer(max(last, ms) + self.idle_ms)
                out.append((key[0], session, request, at, reason is None, reason, n, of_day))
            yield pd.DataFrame(out, columns=["service", "session", "id", "at", "allowed", "reason", "of_session", "of_day"]).astype({"of_session": "int32", "of_day": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (day,) in [k for k in self.days.keys() if (k[0] + 1) * DAY_MS <= now]:
            self.days.removeKey((day,))
        for (session,) in [k for k, (_, last) in self.sessions.iterator() if last + self.idle_ms <= now]:
            self.sessions.removeKey((session,))
        yield from ()

    def close(self) -> None:
        pass


def reserved(requests: DataFrame, session_cap: int = SESSION_CAP, day_cap: int = DAY_CAP, late: str = "1 hour", idle_ms: int = DAY_MS) -> DataFrame:
    """What becomes of each of a stream's requests (service, session, id, at): allowed or not, why not, and both counts behind it."""
    good = F.col("service").isNotNull() & F.col("session").isNotNull() & F.col("at").isNotNull()
    named = requests.select("service", "session", F.col("id").cast("long").alias("id"), "at")
    counted = named.where(good).withWatermark("at", late).groupBy("service").transformWithStateInPandas(_Counter(session_cap, day_cap, idle_ms), RESULT, "Append", "EventTime")
    none = F.lit(None)
    invalid = named.where(~good).select("service", "session", "id", "at", F.lit(False).alias("allowed"), F.lit("invalid").alias("reason"), none.cast("int").alias("of_session"), none.cast("int").alias("of_day"))
    return counted.unionByName(invalid)
