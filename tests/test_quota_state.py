"""The stateful counter over two days, restarted from its checkpoint, against plain Python."""

import datetime as dt
import random

import pytest

from strandspark.streaming import quota

UTC = dt.timezone.utc


def plain(batches, session_cap, day_cap):
    days, sessions, out = {}, {}, {}
    for batch in batches:
        for service, session, i, at in sorted(batch, key=lambda r: (r[3], r[2])):
            d, s = (service, at.date()), (service, session)
            reason = "session" if sessions.get(s, 0) >= session_cap else "day" if days.get(d, 0) >= day_cap else None
            if reason is None:
                days[d], sessions[s] = days.get(d, 0) + 1, sessions.get(s, 0) + 1
            out[i] = (reason is None, reason, sessions.get(s, 0), days.get(d, 0))
    return out


@pytest.fixture
def stream(spark, tmp_path):
    quota.use_rocksdb(spark)
    schema = "service string, session string, id long, at timestamp"

    def run(rows, **how):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = quota.reserved(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), **how)
        query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return {r.id: (r.allowed, r.reason, r.of_session, r.of_day) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_two_days_both_caps_and_a_restart(stream):
    rng, start = random.Random(2), dt.datetime(2024, 5, 1, 8, tzinfo=UTC)
    made, i = [], 0
    for day in (0, 0, 1):  # the second batch goes on within the first day, after a restart
        batch = []
        for _ in range(40):
            i += 1
            batch.append((rng.choice("ab"), f"s{day}{rng.randrange(7)}", i, start + dt.timedelta(days=day, minutes=i)))
        made.append(batch)
    got = {}
    for batch in made:
        got = stream(batch, session_cap=4, day_cap=18)
    want = plain(made, 4, 18)
    assert got == want
    assert {r for _, r, _, _ in want.values()} == {None, "session", "day"}


def test_timers_forget_and_odd_rows_are_turned_away(spark, stream, tmp_path):
    start = dt.datetime(2024, 5, 1, 8, tzinfo=UTC)
    stream([("a", "s", n, start + dt.timedelta(minutes=n)) for n in range(1, 5)], session_cap=3, day_cap=9)
    stream([("a", "t", 9, start + dt.timedelta(days=3)), ("a", None, 10, start), (None, "s", 11, start), ("a", "s", 12, None)], session_cap=3, day_cap=9)  # moves the watermark past the first day
    got = stream([("a", "s", 13, start + dt.timedelta(days=3, minutes=5))], session_cap=3, day_cap=9)
    assert got[4] == (False, "session", 3, 3) and got[13] == (True, None, 1, 2)
    assert all(got[n][:2] == (False, "invalid") for n in (10, 11, 12))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "days").load()
    assert state.count() == 1
