import glob
import os
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from leadspark.operators import ledger
from leadspark.schemas import LEDGER_EVENT_SCHEMA
from leadspark.sources.stage import fresh_path
from leadspark.streaming import budget

ZONE = ZoneInfo("America/Los_Angeles")


def calendar(ts):
    utc = ts.replace(tzinfo=timezone.utc)
    return utc.strftime("%Y-%m"), utc.astimezone(ZONE).strftime("%Y-%m-%d")


def loop(events, month_cap, day_cap):
    """The ledger one event at a time."""
    state, out = {}, {}
    for account, eid, ts, kind, want, reserved, actual in sorted(events, key=lambda e: (e[2], e[1])):
        month, day = calendar(ts)
        m, d, used, day_used = state.get(account, ("", "", 0, 0))
        granted = limit = None
        if kind == "reserve":
            used, day_used = (used if m == month else 0), (day_used if d == day else 0)
            month_left, day_left = max(0, month_cap - used), max(0, day_cap - day_used)
            granted = max(0, min(want, month_left, day_left))
            limit = None if granted >= want else "day" if day_left <= month_left else "month"
            m, d, used, day_used = month, day, used + granted, day_used + granted
        elif m == month:
            unused = max(0, reserved - max(0, actual))
            used = max(0, used - unused)
            if d == day:
                day_used = max(0, day_used - unused)
        state[account] = (m, d, used, day_used)
        out[eid] = (granted, limit, used, day_used)
    return out


def events(seed, settles=True):
    rnd = random.Random(seed)
    out = []
    for eid in range(1500):
        ts = datetime(2026, 2, 24) + timedelta(seconds=rnd.randrange(14 * 86400))
        kind = "settle" if settles and rnd.random() < 0.4 else "reserve"
        out.append((f"a{rnd.randrange(3)}", eid, ts, kind, rnd.randrange(0, 8), rnd.randrange(0, 9), rnd.randrange(-1, 6)))
    return out


@pytest.mark.parametrize("caps", [(40, 9), (1000, 30), (15, 30)])
def test_settlement_equals_the_loop(spark, caps):
    data = events(1)
    steps = ledger.budget_settle(spark.createDataFrame(data, LEDGER_EVENT_SCHEMA), *caps, rows_per_task=50).collect()
    assert {r.event_id: (r.granted, r.limited_by, r.used, r.day_used) for r in steps} == loop(data, *caps)


@pytest.mark.parametrize("caps", [(40, 9), (1000, 30), (15, 30)])
def test_grants_equal_the_loop(spark, caps):
    data = events(2, settles=False)
    rows = ledger.budget_grant(spark.createDataFrame(data, LEDGER_EVENT_SCHEMA), *caps, rows_per_task=50).collect()
    want = loop(data, *caps)
    assert {r.event_id: (r.granted, r.limited_by) for r in rows} == {k: v[:2] for k, v in want.items()}
    asked = {e[1] for e in data if e[4] > 0}
    assert {r.event_id: (r.used, r.day_used) for r in rows if r.event_id in asked} == {k: v[2:] for k, v in want.items() if k in asked}


def test_one_quota_day_over_two_months(spark):
    rows = [("a", 1, datetime(2026, 8, 31, 23), 20), ("a", 2, datetime(2026, 9, 1, 1), 20)]
    df = spark.createDataFrame(rows, "account string, event_id long, ts timestamp, want long")
    assert [r.granted for r in ledger.budget_grant(df, 15, 30).orderBy("event_id").collect()] == [15, 15]


def test_peek_resets_with_the_calendar(spark):
    data = [("a", 1, datetime(2026, 8, 15, 12), "reserve", 10, 0, 0)]
    steps = ledger.budget_settle(spark.createDataFrame(data, LEDGER_EVENT_SCHEMA), 1000, 30)
    for now, want in [("2026-08-15 20:00:00", (10, 10)), ("2026-08-16 20:00:00", (10, 0)), ("2026-09-02 00:00:00", (0, 0))]:
        row = ledger.budget_peek(steps, F.lit(now).cast("timestamp"), 1000, 30).collect()[0]
        assert (row.used, row.day_used) == want and row.can_search


def land(spark, landing, rows):
    spark.createDataFrame(rows, LEDGER_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(landing)


def test_stream_puts_events_in_order_and_reports_late_ones(spark):
    data = events(3)
    landing, sink, progress = (fresh_path(spark, n) for n in ("in", "out", "state"))
    # four days a trigger, a fifth of the events two days late: within the delay of six days
    start = datetime(2026, 2, 24)
    trigger = {e[1]: (e[2] - start).days + (2 if e[1] % 5 == 0 else 0) for e in data}
    for k in range(0, 17, 4):
        land(spark, landing, [e for e in data if k <= trigger[e[1]] < k + 4])
        steps = budget.ledger_steps(spark.readStream.schema(LEDGER_EVENT_SCHEMA).parquet(landing), 40, 9, "6 days")
        budget.run_to_end(steps, sink, progress)
    late = [("a0", 10_000 + k, start + timedelta(hours=k), "reserve", 3, 0, 0) for k in range(3)]
    land(spark, landing, [*late, ("new", 20_000, datetime(2026, 3, 13), "reserve", 3, 0, 0)])
    budget.run_to_end(steps, sink, progress)
    table = spark.createDataFrame([*data, ("new", 20_000, datetime(2026, 3, 13), "reserve", 3, 0, 0)], LEDGER_EVENT_SCHEMA)
    before = spark.read.schema(steps.schema).parquet(sink).filter("NOT late").count()
    assert before < table.count()
    budget.close_stream(table, landing, "6 days")
    budget.run_to_end(steps, sink, progress)
    got = spark.read.schema(steps.schema).parquet(sink).filter("account IS NOT NULL").collect()
    want = loop([*data, ("new", 20_000, datetime(2026, 3, 13), "reserve", 3, 0, 0)], 40, 9)
    assert {r.event_id: (r.granted, r.limited_by, r.used, r.day_used) for r in got if not r.late} == want
    assert sorted((r.event_id, r.granted, r.used) for r in got if r.late) == [(10_000 + k, None, None) for k in range(3)]


def test_a_finished_table_streams_like_the_batch(spark):
    data = events(4)
    got = budget.budget_stream(spark.createDataFrame(data, LEDGER_EVENT_SCHEMA), 40, 9, "20 days").collect()
    assert {r.event_id: (r.granted, r.limited_by, r.used, r.day_used) for r in got} == loop(data, 40, 9) and not any(r.late for r in got)


def test_a_table_longer_than_the_delay_streams_like_the_batch(spark, monkeypatch):
    monkeypatch.setattr(budget, "ROWS_PER_TRIGGER", 400)
    data = events(5)
    timeless = ("a0", 50_000, None, "reserve", 3, 0, 0)
    table = spark.createDataFrame([*data, timeless], LEDGER_EVENT_SCHEMA)
    got = budget.budget_stream(table, 40, 9, "2 days", 2).collect()
    assert {r.event_id: (r.granted, r.limited_by, r.used, r.day_used) for r in got if not r.late} == loop(data, 40, 9)
    assert [(r.event_id, r.granted) for r in got if r.late] == [(50_000, None)]


def test_a_long_table_lands_in_many_files_in_order_of_arrival(spark, monkeypatch):
    monkeypatch.setattr(budget, "ROWS_PER_TRIGGER", 300)
    data = events(6)
    landing = fresh_path(spark, "in")
    budget.land_in_turn(spark.createDataFrame(data, LEDGER_EVENT_SCHEMA), landing, "2 days", 3)
    files = sorted(glob.glob(f"{landing}/*.parquet"), key=lambda f: os.stat(f).st_mtime_ns)
    parts = [spark.read.parquet(f).collect() for f in files]
    assert len(files) > 3 and sorted(r.event_id for p in parts for r in p) == sorted(e[1] for e in data)
    newest = max(r.ts for r in parts[0])
    for part in parts[1:]:
        assert min(r.ts for r in part) > newest - timedelta(days=2)
        newest = max(newest, *(r.ts for r in part))


def test_big_caps_and_months_of_one_account(spark):
    rnd = random.Random(11)
    data = []
    for eid in range(3000):
        ts = datetime(2025, 11, 20) + timedelta(seconds=rnd.randrange(150 * 86400))
        kind = "settle" if rnd.random() < 0.4 else "reserve"
        data.append(("a", eid, ts, kind, rnd.randrange(0, 3000), rnd.randrange(0, 4000), rnd.randrange(-1, 600)))
    for caps in ((100_000, 10_000), (60_000, 2_500)):
        steps = ledger.budget_settle(spark.createDataFrame(data, LEDGER_EVENT_SCHEMA), *caps, rows_per_task=100).collect()
        assert {r.event_id: (r.granted, r.limited_by, r.used, r.day_used) for r in steps} == loop(data, *caps)


def test_empty_and_null(spark):
    assert ledger.budget_settle(spark.createDataFrame([], LEDGER_EVENT_SCHEMA), 40, 9).count() == 0
    assert ledger.budget_grant(spark.createDataFrame([], "account string, event_id long, ts timestamp, want long"), 40, 9).count() == 0
    rows = [(None, 1, datetime(2026, 3, 3), "reserve", 5, None, None), (None, 2, datetime(2026, 3, 4), "settle", None, 3, None), ("a", 3, datetime(2026, 3, 3), "reserve", None, 0, 0)]
    got = {r.event_id: (r.granted, r.used) for r in ledger.budget_settle(spark.createDataFrame(rows, LEDGER_EVENT_SCHEMA), 40, 9).collect()}
    assert got == {1: (5, 5), 2: (None, 2), 3: (0, 0)}


@pytest.mark.parametrize("span_us", [40_000_000, 900_000, 60_000_000])
def test_a_burst_is_cut_by_rows(spark, span_us):
    rnd = random.Random(span_us)
    begin = datetime(2026, 3, 3, 12, 0, 0)
    data = []
    for eid in range(4000):
        ts = begin + timedelta(microseconds=rnd.randrange(span_us))
        kind = "settle" if rnd.random() < 0.5 else "reserve"
        data.append(("a", eid, ts, kind, rnd.randrange(0, 4), rnd.randrange(0, 4), rnd.randrange(-1, 4)))
    df = spark.createDataFrame(data, LEDGER_EVENT_SCHEMA)
    steps = ledger.budget_settle(df, 40, 9, rows_per_task=100)
    assert {r.event_id: (r.granted, r.limited_by, r.used, r.day_used) for r in steps.collect()} == loop(data, 40, 9)
    parts = df.repartitionByRange(40, "account", "ts", "event_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 15 and max(r["count"] for r in parts) <= 400
