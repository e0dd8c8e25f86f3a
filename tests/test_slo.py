"""ST-3..ST-11, W-4 (reference metric cases)."""

from pyspark.sql import functions as F

from helpers import ts
from nightjar.operators import slo


def test_running_connections_plus_minus(spark):
    d = spark.createDataFrame([("ws", ts("2024-01-01 00:00:00"), 1, 1), ("ws", ts("2024-01-01 00:30:00"), 2, 1),
                               ("ws", ts("2024-01-01 01:10:00"), 3, -1)],
                              "label string, ts timestamp_ntz, seq long, delta long")
    assert [r.connections for r in slo.running_connections(d).orderBy("seq").collect()] == [1, 2, 1]


def test_queue_depth_missing_fields_zero(spark):
    g = spark.createDataFrame([("q", ts("2024-01-01 00:00:00"), 9.0, 9.0, 9.0),
                               ("q", ts("2024-01-01 00:01:00"), 3.0, 1.0, None),
                               ("r", ts("2024-01-01 00:00:00"), None, None, None)],
                              "queue string, ts timestamp_ntz, waiting double, active double, delayed double")
    d = {r.queue: r.depth for r in slo.queue_depth(g).collect()}
    assert d == {"q": 4.0, "r": 0.0}
    assert slo.gauge_sum(slo.queue_depth(g)).first().total == 4.0


def test_counter_increase_with_reset(spark):
    s = spark.createDataFrame([("c", ts("2024-01-01 00:00:00"), 10.0), ("c", ts("2024-01-01 00:10:00"), 15.0),
                               ("c", ts("2024-01-01 00:20:00"), 3.0), ("c", ts("2024-01-01 00:30:00"), 5.0)],
                              "series string, ts timestamp_ntz, value double")
    r = slo.counter_increase(s).first()
    assert (r.increase, r.resets, r.samples) == (5.0 + 3.0 + 2.0, 1, 4)


def test_ingestion_lag_ms(spark):
    j = spark.createDataFrame([(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:01.250000"))],
                              "enqueued_at timestamp_ntz, started_at timestamp_ntz")
    assert slo.ingestion_lag(j).first().lag_ms == 1250.0


def test_windowed_quantiles_sketch_matches_exact_rank(spark):
    rows = [(ts("2024-01-01 00:00:00").replace(second=i), float(v)) for i, v in enumerate([5, 1, 9, 3, 7])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = slo.windowed_quantiles(df, "ts", "v", window="5 minutes", slide="5 minutes", method="sketch").collect()
    assert len(out) == 1 and (out[0].n, out[0].p50, out[0].p95) == (5, 5.0, 9.0)
    ex = slo.windowed_quantiles(df, "ts", "v", window="5 minutes", slide="5 minutes", method="exact").first()
    assert ex.p50 == 5.0


def test_sliding_windows_cover_each_row_window_over_slide_times(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:07:30"), "500"), (ts("2024-01-01 00:07:40"), "200")],
                               "ts timestamp_ntz, status string")
    out = slo.error_ratio(df, "ts").collect()
    assert len(out) == 20
    assert all(r.requests == 2 and r.errors == 1 and r.breach for r in out)
    rate = slo.event_rate(df, "ts").collect()
    assert {r.rate_per_s for r in rate} == {2 / 300}


def test_sustained_breach_holds_and_resets(spark):
    base = ts("2024-01-01 00:00:00")
    import datetime as dt
    conds = [True] * 21 + [False] + [True] * 5
    ev = spark.createDataFrame([("r", base + dt.timedelta(seconds=15 * i), c) for i, c in enumerate(conds)],
                               "rule string, ts timestamp_ntz, cond boolean")
    runs = slo.sustained_breach(ev, ["rule"], "ts", "cond", "5 minutes").orderBy("started_at").collect()
    assert [(r.evaluations, r.firing) for r in runs] == [(21, True), (5, False)]
    assert runs[0].fired_at == base + dt.timedelta(seconds=300)


def _runs(spark, rows, hold="5 minutes"):
    ev = spark.createDataFrame(rows, "rule string, ts timestamp_ntz, cond boolean")
    out = slo.sustained_breach(ev, ["rule"], "ts", "cond", hold).collect()
    return sorted((r.rule, r.started_at, r.ended_at, r.evaluations, r.fired_at) for r in out)


def _at(i, day="2024-01-01"):
    import datetime as dt
    return ts(f"{day} 00:00:00") + dt.timedelta(seconds=15 * i)


def test_sustained_breach_counts_a_repeated_evaluation_once(spark):
    rows = [("r", _at(i), True) for i in range(25)] + [("r", _at(11), True)]
    assert _runs(spark, rows) == [("r", _at(0), _at(24), 25, _at(20))]
    # one of them says false: the run is cut there
    rows[-1] = ("r", _at(11), False)
    assert [(a, n, f) for _, a, _, n, f in _runs(spark, rows)] == [(_at(0), 11, None), (_at(12), 13, None)]


def test_sustained_breach_missing_or_null_evaluation_resets(spark):
    rows = [("r", _at(i), True) for i in range(42) if i != 20] + [("s", _at(i), None if i == 5 else True) for i in range(9)]
    assert [(r, n, f) for r, _, _, n, f in _runs(spark, rows)] == [
        ("r", 20, None), ("r", 21, _at(41)), ("s", 5, None), ("s", 3, None)]


def test_sustained_breach_across_days_and_levels(spark):
    """Runs over midnight, over several whole days, and over the edge of a
    256-day bucket are one run each."""
    day = 5760
    edge = (19723 // 256 + 1) * 256 - 19723  # days from 2024-01-01 to the next 256-day edge
    spans = [("a", day - 3, day + 30), ("b", 100, 3 * day + 7), ("c", edge * day - 40, edge * day + 40),
             ("c", edge * day + 42, edge * day + 43)]
    rows = [(r, _at(i), True) for r, x, y in spans for i in range(x, y)]
    need = 20
    want = sorted((r, _at(x), _at(y - 1), y - x, _at(x + need) if y - 1 - x >= need else None) for r, x, y in spans)
    assert _runs(spark, rows) == want


def test_no_unbucketed_window_in_sustained_breach(spark):
    ev = spark.createDataFrame([("r", _at(0), True)], "rule string, ts timestamp_ntz, cond boolean")
    plan = slo.sustained_breach(ev, ["rule"], "ts", "cond", "5 minutes")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_last_samples_fill_until_stale(spark):
    import datetime as dt
    s = spark.createDataFrame([("q", ts("2024-01-01 00:00:07"), 1.0), ("q", ts("2024-01-01 00:00:08"), 7.0),
                               ("q", ts("2024-01-01 00:01:00"), 2.0), ("q", ts("2024-01-01 00:01:00"), 3.0)],
                              "queue string, ts timestamp_ntz, value double")
    out = {r.evaluated_at: r.value for r in slo.last_samples(s, ["queue"], "ts", F.col("value"), "15 seconds", "1 minute").collect()}
    base = ts("2024-01-01 00:00:00")
    want = {base + dt.timedelta(seconds=t): 7.0 for t in (15, 30, 45)}
    want |= {base + dt.timedelta(seconds=t): 3.0 for t in (60, 75, 90, 105)}
    assert out == want


def test_rolling_increase_against_raw_samples(spark):
    """Each evaluation's last hour, from the samples themselves: resets, equal
    times, gaps longer than the window, and several series."""
    import datetime as dt
    import random
    rnd, base, rows = random.Random(4), ts("2024-01-01 00:00:00"), []
    for name in "ab":
        at, value = 0, 0.0
        for _ in range(60):
            at += rnd.choice([0, 1, 60, 299, 300, 900, 4000])
            value = float(rnd.randint(0, 3)) if rnd.random() < 0.1 else value + rnd.randint(0, 5)
            rows.append((name, base + dt.timedelta(seconds=at), value))
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")
    got = {(r.series, r.evaluated_at): (r.increase, r.samples) for r in slo.rolling_increase(df, step="5 minutes").collect()}
    want = {}
    for name in "ab":
        own = sorted((t, v) for n, t, v in rows if n == name)
        for k in range(0, 800):
            t = base + dt.timedelta(minutes=5 * k)
            seen = [v for u, v in own if t - dt.timedelta(hours=1) < u <= t]
            if len(seen) > 1:
                rise = sum(y if y < x else y - x for x, y in zip(seen, seen[1:]))
                want[name, t] = (rise, len(seen))
    assert got == want


def test_group_notifications(spark):
    f = spark.createDataFrame([("A", ts("2024-01-01 00:00:00"), ts("2024-01-01 00:20:00")),
                               ("A", ts("2024-01-01 00:02:00"), None)],
                              "alertname string, fired_at timestamp_ntz, resolved_at timestamp_ntz")
    out = slo.group_notifications(f, "2024-01-01 09:00:00").orderBy("sent_at").collect()
    got = [(r.sent_at, r.alerts, r.reason) for r in out]
    assert got[0] == (ts("2024-01-01 00:00:30"), 1, "initial")
    assert got[1] == (ts("2024-01-01 00:05:30"), 2, "update")
    assert got[2] == (ts("2024-01-01 00:20:30"), 1, "update")
    assert got[3][2] == "repeat" and got[3][0] == ts("2024-01-01 04:20:30")
