"""Service-level queries over metric samples (ST-3..ST-11, W-4).

Sliding windows (5 min every 15 s) are computed from *panes*: rows are
aggregated once per slide-wide pane (partial aggregation, sketches for
quantiles), and only the small pane rows are copied into the windows that
contain them.  Copying raw rows into every overlapping window (20× here)
is avoided; exact quantiles copy counted distinct values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar.functions.scalars import ts_literal
from nightjar.operators.sequence import running_sum

DEFAULT_QUANTILES = (0.5, 0.95, 0.99)
# Metric alert rules: name, threshold, hold duration.  Fixed values.
ALERT_RULES = {
    "APIHighLatencyP95": (1000.0, "5 minutes"),
    "APIHighErrorRate": (0.05, "5 minutes"),
    "IngestionBacklogHigh": (10000.0, "5 minutes"),
    "QueueDepthHigh": (500.0, "10 minutes"),
    "QueueJobFailuresFiring": (0.0, "5 minutes"),
}
# Upper bounds of latency buckets in ms (the last bucket is unbounded).  Fixed values.
BUCKET_BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def _seconds(spec: str) -> int:
    n, unit = spec.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return int(n) * mult


def _q_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def ingestion_lag(jobs: DataFrame, enqueued: str = "enqueued_at", started: str = "started_at") -> DataFrame:
    """ST-3: processing start − enqueue time in milliseconds."""
    return jobs.withColumn("lag_ms", F.expr(f"timestampdiff(MILLISECOND, {enqueued}, {started})").cast("double"))


def _panes(df: DataFrame, ts_col: str, slide: str, keys: Sequence[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys, F.window(ts_col, slide)["start"].alias("_pane")).agg(*aggs)


def _spread(panes: DataFrame, window: str, slide: str) -> DataFrame:
    """Copy each pane row into the ``window/slide`` windows that contain it."""
    w, s = _seconds(window), _seconds(slide)
    if w % s:
        raise ValueError("window must be a multiple of slide")
    k = F.explode(F.sequence(F.lit(0), F.lit(w // s - 1))).alias("_k")
    out = panes.select("*", k).withColumn("window_start", F.expr(f"timestampadd(SECOND, -_k * {s}, _pane)"))
    return out.drop("_k", "_pane")


def _with_end(df: DataFrame, window: str) -> DataFrame:
    """Window end from its start (kept out of the grouping key)."""
    return df.withColumn("window_end", F.expr(f"timestampadd(SECOND, {_seconds(window)}, window_start)"))


def histogram_quantile(counts: Column, total: Column, p: float, bounds: Sequence[float] = BUCKET_BOUNDS) -> Column:
    """Quantile p from cumulative bucket counts (``counts[i]`` samples are at
    most ``bounds[i]``): linear inside the first bucket that reaches rank
    p * total, counted from 0 below the first bound; a rank beyond the last
    bound gives that bound; null without samples."""
    rank = F.lit(float(p)) * total
    edges = F.array(*[F.lit(float(x)) for x in bounds])
    at = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int")
    upper, reached = F.get(edges, at - 1), F.get(counts, at - 1)
    lower = F.when(at > 1, F.get(edges, at - 2)).otherwise(F.least(F.lit(0.0), F.lit(float(bounds[0]))))
    below = F.when(at > 1, F.get(counts, at - 2)).otherwise(F.lit(0))
    return (F.when(total == 0, F.lit(None).cast("double")).when(at == 0, F.lit(float(bounds[-1])))
            .otherwise(lower + (upper - lower) * ((rank - below) / (reached - below))))


def windowed_quantiles(df: DataFrame, ts_col: str, value_col: str, keys: Sequence[str] = (),
                       window: str = "5 minutes", slide: str = "15 seconds",
                       quantiles: Sequence[float] = DEFAULT_QUANTILES, method: str = "histogram",
                       bounds: Sequence[float] = BUCKET_BOUNDS, sketch_k: int = 200) -> DataFrame:
    """ST-4 / ST-5: quantiles of ``value_col`` per sliding window (and keys).

    ``histogram`` (default): bucket counts per pane, summed per window and
    interpolated; a window costs as many numbers as there are bounds, and
    merging is exact.  ``exact``: equal values of a pane are counted first and
    the interpolating ``percentile`` weighs them, so the copies into windows
    are of distinct values.  ``sketch``: a KLL sketch per pane; its rank error
    is about 1.7 / sketch_k ** 0.9 of the window's samples (1.3 % at 200)."""
    keys = list(keys)
    names = [_q_name(p) for p in quantiles]
    if method == "histogram":
        value = F.col(value_col)
        buckets = [f"_b{i}" for i in range(len(bounds))]
        panes = _panes(df.where(value.isNotNull()), ts_col, slide, keys,
                       [*[F.count_if(value <= float(x)).alias(b) for b, x in zip(buckets, bounds, strict=True)],
                        F.count(F.lit(1)).alias("_n")])
        merged = _with_end(_spread(panes, window, slide).groupBy("window_start", *keys).agg(
            *[F.sum(b).alias(b) for b in buckets], F.sum("_n").alias("n")), window)
        counted = merged.select("window_start", "window_end", *keys, "n", F.array(*buckets).alias("_c"))
        return counted.select("window_start", "window_end", *keys, "n",
                              *[histogram_quantile(F.col("_c"), F.col("n"), p, bounds).alias(q)
                                for p, q in zip(quantiles, names, strict=True)])
    if method == "exact":
        panes = (df.withColumn("_v", F.col(value_col).cast("double")).where(F.col("_v").isNotNull())
                 .groupBy(*keys, F.window(ts_col, slide)["start"].alias("_pane"), "_v")
                 .agg(F.count(F.lit(1)).alias("_n")))
        g = _with_end(_spread(panes, window, slide).groupBy("window_start", *keys).agg(
            F.sum("_n").alias("n"), *[F.percentile("_v", p, F.col("_n")).alias(q)
                                      for p, q in zip(quantiles, names, strict=True)]), window)
        return g.select("window_start", "window_end", *keys, "n", *names)
    if method != "sketch":
        raise ValueError("method must be 'histogram', 'exact' or 'sketch'")
    panes = _panes(df, ts_col, slide, keys,
                   [F.kll_sketch_agg_double(F.col(value_col).cast("double"), sketch_k).alias("_s"),
                    F.count(F.col(value_col)).alias("_n")])
    merged = _with_end(_spread(panes, window, slide).groupBy("window_start", *keys).agg(
        F.kll_merge_agg_double("_s").alias("_s"), F.sum("_n").alias("n")), window)
    # one sketch read per window for all quantiles, in its own projection
    qs = merged.select("window_start", "window_end", *keys, "n",
                       F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(p) for p in quantiles])).alias("_q"))
    return qs.select("window_start", "window_end", *keys, "n", *[F.col("_q")[i].alias(q) for i, q in enumerate(names)])


def event_rate(df: DataFrame, ts_col: str, keys: Sequence[str] = (), window: str = "5 minutes",
               slide: str = "15 seconds") -> DataFrame:
    """ST-6: events per second over each sliding window, by label."""
    keys = list(keys)
    panes = _panes(df, ts_col, slide, keys, [F.count(F.lit(1)).alias("_n")])
    g = _with_end(_spread(panes, window, slide).groupBy("window_start", *keys).agg(F.sum("_n").alias("events")),
                  window)
    return g.withColumn("rate_per_s", F.col("events") / F.lit(float(_seconds(window))))


def error_ratio(df: DataFrame, ts_col: str, status_col: str = "status", keys: Sequence[str] = (),
                window: str = "5 minutes", slide: str = "15 seconds", threshold: float = 0.05) -> DataFrame:
    """ST-7: share of 5xx statuses (anchored ``5..``) per sliding window and
    whether it exceeds the threshold."""
    keys = list(keys)
    panes = _panes(df, ts_col, slide, keys, [F.count(F.lit(1)).alias("_n"),
                                              F.count_if(F.col(status_col).rlike("^5..$")).alias("_e")])
    g = _with_end(_spread(panes, window, slide).groupBy("window_start", *keys).agg(
        F.sum("_n").alias("requests"), F.sum("_e").alias("errors")), window)
    ratio = F.col("errors") / F.col("requests")
    return g.withColumn("error_ratio", ratio).withColumn("breach", ratio > F.lit(threshold))


def _rises(samples: DataFrame, series: str, ts_col: str, value_col: str, window: str, tie_col: str | None) -> DataFrame:
    """Each sample with ``_w``, its tumbling window, ``_prev``, the series'
    value before it (the last one of an earlier window for a window's first
    sample; samples of one instant go by ``tie_col``, by default the value),
    and ``_rise``: the difference, or the new value after a reset.  Samples are ordered within
    their window only; across windows, one last value each is carried."""
    tie = tie_col or value_col
    w = samples.withColumn("_w", F.window(ts_col, window))
    last = w.groupBy(series, "_w").agg(F.max_by(value_col, F.struct(ts_col, tie)).alias("_last"))
    carried = last.select(series, "_w", F.lag("_last").over(Window.partitionBy(series).orderBy("_w.start"))
                          .alias("_carry"))
    inside = F.lag(value_col).over(Window.partitionBy(series, "_w").orderBy(ts_col, tie))
    d = (w.withColumn("_inside", inside).join(carried, [series, "_w"])
         .withColumn("_prev", F.coalesce("_inside", "_carry")))
    return d.withColumn("_rise", F.when(F.col("_prev").isNull(), F.lit(0.0))
                        .when(F.col(value_col) < F.col("_prev"), F.col(value_col))
                        .otherwise(F.col(value_col) - F.col("_prev")))


def counter_increase(samples: DataFrame, series: str = "series", ts_col: str = "ts", value_col: str = "value",
                     window: str = "1 hour", tie_col: str | None = None) -> DataFrame:
    """ST-8: increase of a monotone counter per series and tumbling window:
    the sum of deltas to the sample before; a drop means a reset (the new
    value is the delta).  No extrapolation to the window edges."""
    d = _rises(samples, series, ts_col, value_col, window, tie_col)
    g = d.groupBy(series, "_w").agg(F.sum("_rise").alias("increase"), F.count(F.lit(1)).alias("samples"),
                                    F.count_if(F.col(value_col) < F.col("_prev")).alias("resets"))
    return g.select(series, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                    "increase", "samples", "resets")


def rolling_increase(samples: DataFrame, series: str = "series", ts_col: str = "ts", value_col: str = "value",
                     window: str = "1 hour", step: str = "15 seconds", tie_col: str | None = None) -> DataFrame:
    """ST-8 at every evaluation: the increase over the last ``window`` (open
    at its start, closed at its end) at each multiple of ``step``, for windows
    with two samples at least; no extrapolation.

    Samples become panes of one step that hold (first, last) of the running
    total of rises; the total never falls, so a window's increase is the
    largest last minus the smallest first of its panes, merged in any order.
    A pane is copied into two window-long buckets, its own and the next, whose
    evaluations look back over at most the bucket before: a task holds two
    windows of one series, whatever the series' length."""
    w, s = _seconds(window), _seconds(step)
    if w % s:
        raise ValueError("window must be a multiple of step")
    tie = tie_col or value_col
    d = _rises(samples, series, ts_col, value_col, window, tie_col).withColumn(
        "_micros", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts_col})"))
    # running total within the window, and what the windows before add to it
    upto = Window.partitionBy(series, "_w").orderBy(ts_col, tie).rowsBetween(Window.unboundedPreceding,
                                                                             Window.currentRow)
    totals = d.groupBy(series, "_w").agg(F.sum("_rise").alias("_all")).select(
        series, "_w", F.coalesce(F.sum("_all").over(Window.partitionBy(series).orderBy("_w.start").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_base"))
    c = d.withColumn("_in", F.sum("_rise").over(upto)).join(totals, [series, "_w"])
    total = F.col("_base") + F.col("_in")
    # pane n holds the samples of ((n - 1) step, n step]: the evaluation at n step is the first to see them
    panes = c.groupBy(series, F.ceil(F.col("_micros") / F.lit(s * 1_000_000)).cast("long").alias("_n")).agg(
        F.min(total).alias("_first"), F.max(total).alias("_last"), F.count(F.lit(1)).alias("_count"))
    per = w // s
    bucket = F.floor(F.col("_n") / per)
    copies = panes.select("*", F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    # a bucket's evaluations are generated once for the series that have panes in reach
    grid = (copies.groupBy(series, "_b").agg(F.lit(1).alias("_one"))
            .select(series, "_b", F.explode(F.sequence(F.col("_b") * per, F.col("_b") * per + (per - 1))).alias("_n")))
    rows = copies.select(series, "_b", "_n", "_first", "_last", "_count", F.lit(False).alias("_eval")).unionByName(
        grid.withColumn("_eval", F.lit(True)), allowMissingColumns=True)
    reach = Window.partitionBy(series, "_b").orderBy("_n").rangeBetween(-(per - 1), 0)
    seen = rows.select(series, "_n", "_eval", (F.max("_last").over(reach) - F.min("_first").over(reach)).alias("increase"),
                       F.sum("_count").over(reach).alias("samples"))
    return seen.where("_eval and samples >= 2").select(
        series, F.expr(f"timestampadd(SECOND, _n * {s}, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("evaluated_at"),
        "increase", "samples")


def queue_depth(gauges: DataFrame, as_of: dt.datetime | str | None = None, queue: str = "queue",
                ts_col: str = "ts") -> DataFrame:
    """ST-9: depth = waiting + active + delayed (a missing field counts 0),
    the latest sample per queue (at or before ``as_of``)."""
    g = gauges if as_of is None else gauges.where(F.col(ts_col) <= ts_literal(as_of))
    depth = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("waiting", "active", "delayed")), F.lit(0.0))
    latest = g.groupBy(queue).agg(F.max_by(F.struct(depth.alias("depth"), F.col(ts_col).alias("sampled_at")),
                                           F.col(ts_col)).alias("_l"))
    return latest.select(queue, "_l.depth", "_l.sampled_at")


def gauge_sum(depths: DataFrame, value_col: str = "depth") -> DataFrame:
    """ST-9: the sum of the latest gauges over all series (one row)."""
    return depths.agg(F.sum(value_col).alias("total"), F.count(F.lit(1)).alias("series"))


def running_connections(deltas: DataFrame, label: str = "label", ts_col: str = "ts", tie_col: str = "seq",
                        bucket_unit: str = "hour") -> DataFrame:
    """W-4: +1 on open, −1 on close; the current value after every event."""
    return running_sum(deltas, label, ts_col, tie_col, "delta", "connections", bucket_unit)


def last_samples(samples: DataFrame, series: Sequence[str], ts_col: str, value: Column, step: str = "15 seconds",
                 staleness: str = "5 minutes", tie: Column | None = None) -> DataFrame:
    """A gauge as its evaluations see it: for each series and multiple of
    ``step``, the last sample at or before it that is younger than
    ``staleness`` (samples of one instant go by ``tie``, by default the
    value).  A step keeps its last sample only, and that row is copied into
    the evaluations it can reach; both are partial aggregations."""
    s, k = _seconds(step), -(-_seconds(staleness) // _seconds(step))
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts_col})")
    last = F.struct(micros.alias("us"), (value if tie is None else tie).alias("tie"), value.alias("v"))
    panes = samples.groupBy(*series, F.ceil(micros / F.lit(s * 1_000_000)).cast("long").alias("_n")).agg(
        F.max(last).alias("_s"))
    reached = panes.select(*series, F.explode(F.sequence(F.col("_n"), F.col("_n") + k)).alias("_n"), "_s").where(
        F.col("_n") * s * 1_000_000 - F.col("_s.us") < _seconds(staleness) * 1_000_000)
    return reached.groupBy(*series, "_n").agg(F.max("_s").alias("_s")).select(
        *series, F.expr(f"timestampadd(SECOND, _n * {s}, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("evaluated_at"),
        F.col("_s.v").alias("value"))


#: Runs are joined within a day, then within these many times the span before.
RUN_LEVELS = (1, 256, 65536)


def _join_runs(runs: DataFrame, series: list[str], size: int) -> DataFrame:
    """Runs that follow each other within a bucket of ``size`` steps, joined;
    runs marked closed can have no neighbour and are left alone."""
    bucket = F.when(F.col("_closed"), F.col("_a")).otherwise(F.floor(F.col("_a") / size))
    w = Window.partitionBy(*series, "_closed", "_bucket").orderBy("_a")
    opens = F.when(F.lag("_b").over(w) == F.col("_a") - 1, 0).otherwise(1)
    marked = runs.withColumn("_bucket", bucket).withColumn("_opens", opens).withColumn(
        "_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = marked.groupBy(*series, "_closed", "_bucket", "_run").agg(
        F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"), F.sum("evaluations").alias("evaluations"))
    # a run that touches neither end of its bucket is complete
    inner = (F.pmod("_a", F.lit(size)) != 0) & (F.pmod(F.col("_b") + 1, F.lit(size)) != 0)
    return joined.withColumn("_closed", F.col("_closed") | inner).drop("_bucket", "_run")


def sustained_breach(evals: DataFrame, series: Sequence[str], ts_col: str, cond_col: str, hold: str,
                     step: str = "15 seconds") -> DataFrame:
    """ST-10 (batch): an alert fires once its condition has been true at every
    evaluation (one per ``step``) for ``hold``; a false, null or missing
    evaluation resets it.  An evaluation that comes several times in one step
    counts once, and as false if any of them is.

    Runs of true evaluations are joined within (series, day), and what touches
    a day's edges within wider and wider buckets: a run's summary (first and
    last step, times, count) merges associatively, so no task sorts a whole
    series.  Returns one row per run: start, end, fired_at (null if it never
    held)."""
    series = list(series)
    s, need = _seconds(step), -(-_seconds(hold) // _seconds(step))
    n = F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts_col})") / s)
    once = evals.groupBy(*series, n.alias("_a")).agg(
        F.min(ts_col).alias("started_at"), F.bool_and(F.coalesce(F.col(cond_col), F.lit(False))).alias("_true"))
    runs = once.where("_true").select(*series, "_a", F.col("_a").alias("_b"), "started_at",
                                      F.col("started_at").alias("ended_at"), F.lit(1).cast("long").alias("evaluations"),
                                      F.lit(False).alias("_closed"))
    for times in RUN_LEVELS:
        runs = _join_runs(runs, series, times * 86400 // s)
    fired = F.when(F.col("_b") - F.col("_a") >= need, F.expr(f"timestampadd(SECOND, {need * s}, started_at)"))
    return runs.select(*series, "started_at", "ended_at", "evaluations", fired.alias("fired_at"),
                       fired.isNotNull().alias("firing"))


# --------------------------------------------------------------------------
# ST-11: notification grouping (batch twin)
# --------------------------------------------------------------------------
NOTIFY_SCHEMA = "alertname string, sent_at timestamp_ntz, alerts long, reason string"


def _notify_group(group_wait: int, group_interval: int, repeat_interval: int, horizon: pd.Timestamp):
    gw, gi, ri = (pd.Timedelta(seconds=x) for x in (group_wait, group_interval, repeat_interval))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["alertname"].iloc[0]
        ev = [(t, 1) for t in pdf["fired_at"]]
        ev += [(t, -1) for t in pdf["resolved_at"] if pd.notna(t) and t <= horizon]
        ev.sort(key=lambda e: (e[0], -e[1]))
        out, i, n, active = [], 0, len(ev), 0
        while i < n:
            # idle group: the first firing opens it, the first flush waits group_wait
            flush = ev[i][0] + gw
            while i < n and ev[i][0] <= flush:
                active += ev[i][1]
                i += 1
            if active <= 0:
                continue
            if flush > horizon:
                break
            out.append((name, flush, active, "initial"))
            last_tick = last_sent = flush
            while True:
                # the next grid tick at which something can happen: a change or a repeat
                target = last_sent + ri if i >= n else min(ev[i][0], last_sent + ri)
                k = max(1, -(-(target - last_tick) // gi))
                tick = last_tick + gi * k
                if tick > horizon:
                    i = n
                    break
                changed = False
                while i < n and ev[i][0] <= tick:
                    active += ev[i][1]
                    i += 1
                    changed = True
                last_tick = tick
                if active <= 0:
                    break  # group resolved; a later firing opens it again
                if changed:
                    out.append((name, tick, active, "update"))
                    last_sent = tick
                elif tick - last_sent >= ri:
                    out.append((name, tick, active, "repeat"))
                    last_sent = tick
        return pd.DataFrame(out, columns=["alertname", "sent_at", "alerts", "reason"])
    return run


def group_notifications(firings: DataFrame, as_of: dt.datetime | str, group_wait: int = 30,
                        group_interval: int = 300, repeat_interval: int = 14400) -> DataFrame:
    """ST-11 (batch twin): notification times per alert name, given firing
    episodes (alertname, fired_at, resolved_at — null while still firing),
    simulated up to ``as_of``.  First flush ``group_wait`` after the group
    opens; afterwards on the ``group_interval`` grid when the group changed,
    or a repeat after ``repeat_interval``.  Each decision depends on the
    previous one, so it runs per alert name with ``applyInPandas`` over that
    name's episodes (one row per episode, not per sample)."""
    horizon = pd.Timestamp(as_of)
    fn = _notify_group(group_wait, group_interval, repeat_interval, horizon)
    return firings.select("alertname", "fired_at", "resolved_at").groupBy("alertname").applyInPandas(
        fn, NOTIFY_SCHEMA)
