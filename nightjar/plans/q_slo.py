"""Registered SLO / metric queries (ST-3..ST-11, ST-13, W-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import analytics as an
from nightjar.operators import slo
from nightjar.plans.oracle_views import with_views
from nightjar.plans.q_analytics import summary_sql
from nightjar.plans.registry import AS_OF, register
from nightjar.plans.views import Domain

LAG_SQL = ("SELECT job_id, queue, enqueued_at, started_at, "
           "CAST(date_diff('millisecond', enqueued_at, started_at) AS DOUBLE) AS lag_ms FROM ingestion_jobs")


def _spread_sql(src: str, ts: str, keys: str = "") -> str:
    """Rows copied into every 5-minute window (15 s slide) that contains them."""
    k = f"{keys}, " if keys else ""
    return f"""
SELECT {k}value, w.window_start, w.window_start + INTERVAL 5 MINUTE AS window_end FROM (
  SELECT *, time_bucket(INTERVAL 15 SECOND, {ts}) AS pane FROM ({src}) s) r,
  LATERAL (SELECT r.pane - to_seconds(15 * i) AS window_start FROM range(20) t(i)) w"""


def _interp(p: float) -> str:
    """Linear interpolation between the order statistics around position
    p·(n−1): (ceil−pos)·low + (pos−floor)·high."""
    pos = f"((n - 1) * CAST({p} AS DOUBLE))"
    lo, hi = f"vs[CAST(floor({pos}) AS BIGINT) + 1]", f"vs[CAST(ceil({pos}) AS BIGINT) + 1]"
    return (f"CASE WHEN floor({pos}) = ceil({pos}) OR {lo} = {hi} THEN {lo} "
            f"ELSE (ceil({pos}) - {pos}) * {lo} + ({pos} - floor({pos})) * {hi} END AS {slo._q_name(p)}")


BOUNDS = "[0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]"


def _hist(p: float) -> str:
    """Prometheus-style interpolation in the first bucket that reaches the rank."""
    at = f"list_position(list_transform(c, lambda x: x >= CAST({p} AS DOUBLE) * n), true)"
    lower = f"(CASE WHEN {at} > 1 THEN CAST(b[{at} - 1] AS DOUBLE) ELSE 0.0 END)"
    below = f"(CASE WHEN {at} > 1 THEN c[{at} - 1] ELSE 0 END)"
    return (f"CASE WHEN coalesce({at}, 0) = 0 THEN 10000.0 ELSE {lower} + (CAST(b[{at}] AS DOUBLE) - {lower}) "
            f"* ((CAST({p} AS DOUBLE) * n - {below}) / (c[{at}] - {below})) END AS {slo._q_name(p)}")


def _hist_sql(src: str, ts: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
SELECT {k}window_start, window_end, n, {", ".join(_hist(p) for p in slo.DEFAULT_QUANTILES)}
FROM (SELECT {k}window_start, window_end, count(*) AS n, {BOUNDS} AS b,
             list_transform({BOUNDS}, lambda e: len(list_filter(list(value), lambda v: v <= e))) AS c
      FROM ({_spread_sql(src, ts, keys)}) x GROUP BY {k}window_start, window_end) h"""


@register("st3_ingestion_lag", with_views(f"SELECT job_id, queue, lag_ms FROM ({LAG_SQL}) l", ["ingestion_jobs"]))
def st3(d: Domain):
    return slo.ingestion_lag(d.ingestion_jobs).select("job_id", "queue", "lag_ms")


@register("st4_lag_quantiles", with_views(_hist_sql(f"SELECT enqueued_at, lag_ms AS value FROM ({LAG_SQL}) l",
                                                     "enqueued_at"), ["ingestion_jobs"]))
def st4(d: Domain):
    """ST-4: p50/p95/p99 ingestion lag per 5-minute window every 15 s (bucket counts)."""
    return slo.windowed_quantiles(slo.ingestion_lag(d.ingestion_jobs), "enqueued_at", "lag_ms")


@register("st4_lag_quantiles_exact", with_views(f"""
SELECT window_start, window_end, n, {", ".join(_interp(p) for p in slo.DEFAULT_QUANTILES)}
FROM (SELECT window_start, window_end, count(*) AS n, list_sort(list(value)) AS vs
      FROM ({_spread_sql(f"SELECT enqueued_at, lag_ms AS value FROM ({LAG_SQL}) l", "enqueued_at")}) x
      GROUP BY window_start, window_end) g""", ["ingestion_jobs"]))
def st4e(d: Domain):
    """ST-4 with interpolated exact percentiles over counted values."""
    return slo.windowed_quantiles(slo.ingestion_lag(d.ingestion_jobs), "enqueued_at", "lag_ms", method="exact")


@register("st5_latency_quantiles", with_views(_hist_sql("SELECT ts, method, duration_ms AS value FROM http_requests",
                                                         "ts", "method"), ["http_requests"]))
def st5(d: Domain):
    return slo.windowed_quantiles(d.http_requests, "ts", "duration_ms", ["method"])


@register("st6_request_rate", with_views(f"""
SELECT window_start, window_end, status, count(*) AS events, count(*) / 300.0 AS rate_per_s
FROM ({_spread_sql("SELECT ts, status, 1 AS value FROM http_requests", "ts", "status")}) x
GROUP BY window_start, window_end, status""", ["http_requests"]))
def st6(d: Domain):
    return slo.event_rate(d.http_requests, "ts", ["status"])


ERR_SQL = f"""
SELECT window_start, window_end, method, count(*) AS requests, CAST(sum(value) AS BIGINT) AS errors,
       sum(value) / count(*) AS error_ratio, sum(value) / count(*) > 0.05 AS breach
FROM ({_spread_sql("SELECT ts, method, CASE WHEN regexp_matches(status, '^5..$') THEN 1 ELSE 0 END AS value "
                   "FROM http_requests", "ts", "method")}) x
GROUP BY window_start, window_end, method"""


@register("st7_error_ratio", with_views(ERR_SQL, ["http_requests"]))
def st7(d: Domain):
    return slo.error_ratio(d.http_requests, "ts", "status", ["method"])


@register("st8_counter_increase", with_views("""
SELECT series, window_start, window_start + INTERVAL 1 HOUR AS window_end,
       sum(CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END) AS increase,
       count(*) AS samples, count(*) FILTER (WHERE value < prev) AS resets
FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS prev
      FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM counter_samples) b) l
GROUP BY series, window_start""", ["counter_samples"]))
def st8(d: Domain):
    return slo.counter_increase(d.counter_samples)


@register("st8_increase_last_hour", with_views("""
SELECT series, evaluated_at, sum(rise) - arg_min(rise, [epoch_us(ts), value]) AS increase, count(*) AS samples
FROM (SELECT series, ts, value, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS rise
      FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS prev FROM counter_samples) l) r,
  LATERAL (SELECT time_bucket(INTERVAL 5 MINUTE, r.ts - INTERVAL 1 MICROSECOND) + to_seconds(300 * (i + 1)) AS evaluated_at
           FROM range(12) t(i)) w
GROUP BY series, evaluated_at HAVING count(*) >= 2""", ["counter_samples"]))
def st8h(d: Domain):
    """ST-8 at every 5-minute evaluation: the increase over the last hour."""
    return slo.rolling_increase(d.counter_samples, step="5 minutes")


DEPTH_SQL = """
SELECT queue, arg_max(coalesce(waiting, 0) + coalesce(active, 0) + coalesce(delayed, 0), ts) AS depth,
       max(ts) AS sampled_at
FROM queue_gauges WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY queue"""


@register("st9_queue_depth", with_views(DEPTH_SQL, ["queue_gauges"]))
def st9(d: Domain):
    return slo.queue_depth(d.queue_gauges, AS_OF)


@register("st9_gauge_sum", with_views(f"SELECT sum(depth) AS total, count(*) AS series FROM ({DEPTH_SQL}) q",
                                      ["queue_gauges"]))
def st9s(d: Domain):
    return slo.gauge_sum(slo.queue_depth(d.queue_gauges, AS_OF))


@register("w4_running_connections", with_views("""
SELECT label, seq, ts, delta,
       CAST(sum(delta) OVER (PARTITION BY label ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS connections
FROM connection_deltas""", ["connection_deltas"]))
def w4(d: Domain):
    return slo.running_connections(d.connection_deltas)


def _runs_sql(evals: str, keys: str = "", hold: int = 300) -> str:
    """Runs of true 15-second evaluations per series (one row per evaluation)
    and when their hold made them fire."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    fired = f"min(evaluated_at) FILTER (WHERE evaluated_at - st >= INTERVAL {hold} SECOND)"
    return f"""
SELECT {k}min(evaluated_at) AS started_at, max(evaluated_at) AS ended_at, count(*) AS evaluations,
       {fired} AS fired_at, {fired} IS NOT NULL AS firing
FROM (SELECT *, min(evaluated_at) OVER (PARTITION BY {k}island) AS st FROM (
        SELECT *, CAST(floor(epoch(evaluated_at) / 15) AS BIGINT) - row_number() OVER ({part}ORDER BY evaluated_at) AS island
        FROM (SELECT {k}time_bucket(INTERVAL 15 SECOND, evaluated_at) AS evaluated_at FROM ({evals}) x
              GROUP BY {k}time_bucket(INTERVAL 15 SECOND, evaluated_at) HAVING bool_and(breach)) e) i) j
GROUP BY {k}island"""


BREACH_SQL = _runs_sql(f"SELECT method, window_end AS evaluated_at, breach FROM ({ERR_SQL}) e", "method")


def _breaches(d: Domain):
    def build():
        evals = slo.error_ratio(d.http_requests, "ts", "status", ["method"])
        return slo.sustained_breach(evals, ["method"], "window_end", "breach", "5 minutes", "15 seconds")
    return d.memo("breaches", build)


@register("st10_sustained_breach", with_views(BREACH_SQL, ["http_requests"]))
def st10(d: Domain):
    """ST-10: runs where the 5xx ratio of a method stayed above 5 % at every
    15-second evaluation, and when the 5-minute hold made them fire."""
    return _breaches(d)


def _rule_runs(evals, name: str, value_col: str):
    threshold, hold = slo.ALERT_RULES[name]
    evals = evals.withColumn("breach", F.col(value_col) > threshold).withColumn("rule", F.lit(name))
    runs = slo.sustained_breach(evals, ["rule"], "window_end", "breach", hold, "15 seconds")
    return runs.select("started_at", "ended_at", "evaluations", "fired_at", "firing")


@register("st10_APIHighErrorRate", with_views(_runs_sql(f"""
SELECT window_end AS evaluated_at, sum(value) / count(*) > 0.05 AS breach
FROM ({_spread_sql("SELECT ts, CASE WHEN regexp_matches(status, '^5..$') THEN 1 ELSE 0 END AS value FROM http_requests",
                   "ts")}) x GROUP BY window_end"""), ["http_requests"]))
def st10_errors(d: Domain):
    return _rule_runs(slo.error_ratio(d.http_requests, "ts", "status"), "APIHighErrorRate", "error_ratio")


@register("st10_APIHighLatencyP95", with_views(_runs_sql(
    "SELECT window_end AS evaluated_at, p95 > 1000 AS breach FROM ("
    + _hist_sql("SELECT ts, duration_ms AS value FROM http_requests", "ts") + ") q"), ["http_requests"]))
def st10_latency(d: Domain):
    return _rule_runs(slo.windowed_quantiles(d.http_requests, "ts", "duration_ms"), "APIHighLatencyP95", "p95")


@register("st10_IngestionBacklogHigh", with_views(_runs_sql(
    "SELECT window_end AS evaluated_at, p95 > 10000 AS breach FROM ("
    + _hist_sql(f"SELECT enqueued_at, lag_ms AS value FROM ({LAG_SQL}) l", "enqueued_at") + ") q"),
    ["ingestion_jobs"]))
def st10_backlog(d: Domain):
    return _rule_runs(slo.windowed_quantiles(slo.ingestion_lag(d.ingestion_jobs), "enqueued_at", "lag_ms"),
                      "IngestionBacklogHigh", "p95")


def _gauge_sql(staleness: str) -> str:
    """Every 15-second evaluation of each queue's depth: the last sample that
    is younger than the staleness bound."""
    return f"""
SELECT queue, evaluated_at, arg_max(depth, [epoch_us(ts), CAST(depth AS BIGINT)]) AS depth
FROM (SELECT queue, ts, coalesce(waiting, 0) + coalesce(active, 0) + coalesce(delayed, 0) AS depth FROM queue_gauges) g,
  LATERAL (SELECT time_bucket(INTERVAL 15 SECOND, g.ts - INTERVAL 1 MICROSECOND) + to_seconds(15 * (i + 1)) AS evaluated_at
           FROM range({1 + 3600 // 15}) t(i)) w
WHERE evaluated_at - ts < INTERVAL {staleness} GROUP BY queue, evaluated_at"""


@register("st10_QueueDepthHigh", with_views(
    _runs_sql(f"SELECT queue, evaluated_at, depth > 6 AS breach FROM ({_gauge_sql('1 HOUR')}) q", "queue", 600), ["queue_gauges"]))
def st10_depth(d: Domain):
    """Depth above a threshold at every evaluation for 10 minutes.  The
    synthetic gauges stay below 16 and are minutes apart, so the query uses a
    threshold of 6 and a staleness bound of an hour; the rule's own values are
    in ``slo.ALERT_RULES`` and the operator's defaults."""
    depth = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("waiting", "active", "delayed")), F.lit(0.0))
    evals = slo.last_samples(d.queue_gauges, ["queue"], "ts", depth, staleness="1 hour")
    return slo.sustained_breach(evals.withColumn("breach", F.col("value") > 6), ["queue"], "evaluated_at", "breach",
                                slo.ALERT_RULES["QueueDepthHigh"][1])


@register("st10_QueueJobFailuresFiring", with_views(_runs_sql(f"""
SELECT queue, window_end AS evaluated_at, true AS breach
FROM ({_spread_sql("SELECT queue, started_at, 1 AS value FROM ingestion_jobs WHERE NOT succeeded", "started_at", "queue")}) x
GROUP BY queue, window_end""", "queue"), ["ingestion_jobs"]))
def st10_failures(d: Domain):
    """A queue whose 5-minute failure rate is above zero for 5 minutes; an
    evaluation without a failure has no row, which ends a run just as zero does."""
    rate = slo.event_rate(d.ingestion_jobs.where("not succeeded"), "started_at", ["queue"])
    threshold, hold = slo.ALERT_RULES["QueueJobFailuresFiring"]
    return slo.sustained_breach(rate.withColumn("breach", F.col("rate_per_s") > threshold), ["queue"], "window_end",
                                "breach", hold)


@register("st11_group_notifications", None)
def st11(d: Domain):
    """ST-11: notifications per alert name over the ST-10 firing episodes
    (applyInPandas per name; no SQL oracle)."""
    firings = _breaches(d).where("firing").select(
        F.concat(F.lit("APIHighErrorRate/"), F.col("method")).alias("alertname"),
        F.col("fired_at"), F.expr("timestampadd(SECOND, 15, ended_at)").alias("resolved_at"))
    return slo.group_notifications(firings, AS_OF)


DAY_WHERE = ("WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00' "
             "AND created_at < TIMESTAMP '2024-01-16 00:00:00'")


@register("st13_daily_summary", with_views(
    "SELECT '2024-01-15' AS day, * FROM (" + summary_sql(DAY_WHERE, DAY_WHERE) + ") s",
    ["alerts", "incidents", "vulnerabilities", "assets"]))
def st13(d: Domain):
    return an.daily_summary(d.alerts, d.incidents, d.vulnerabilities, d.assets, "2024-01-15")


# -- ST-12: the live views' aggregation, run over the whole table ---------------
@register("st12_live_trend", with_views("""
SELECT strftime(created_at, '%Y-%m-%d') AS date,
       CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'high') AS BIGINT) AS high,
       CAST(count_if(severity = 'medium') AS BIGINT) AS medium, CAST(count_if(severity = 'low') AS BIGINT) AS low,
       CAST(count_if(severity = 'info') AS BIGINT) AS info, count(*) AS total
FROM alerts GROUP BY 1""", ["alerts"]))
def st12t(d: Domain):
    """ST-12: the per-day severity counts the live trend stream maintains
    (the same function, applied to the table as a batch)."""
    from nightjar.streaming.live import alerts_trend_stream
    return alerts_trend_stream(d.alerts)


@register("st12_live_summary", with_views("""
SELECT count(*) AS alerts_total, CAST(count_if(status = 'open') AS BIGINT) AS alerts_open,
       CAST(count_if(severity = 'critical') AS BIGINT) AS alerts_critical,
       CAST(count_if(severity = 'high') AS BIGINT) AS alerts_high,
       CAST(count_if(severity = 'medium') AS BIGINT) AS alerts_medium,
       CAST(count_if(severity = 'low') AS BIGINT) AS alerts_low FROM alerts""", ["alerts"]))
def st12s(d: Domain):
    from nightjar.streaming.live import summary_stream
    return summary_stream(d.alerts)


VISIBLE_SQL = """
SELECT entity, id, min(ts) FILTER (WHERE op = 'create') AS created_at,
       arg_max(severity, place) FILTER (WHERE severity IS NOT NULL) AS severity,
       arg_max(status, place) FILTER (WHERE status IS NOT NULL) AS status
FROM (SELECT *, concat(strftime(ts, '%Y%m%d%H%M%S%f'), '|', lpad(change_id, 40, ' ')) AS place FROM live_changes) p
GROUP BY entity, id
HAVING count(*) FILTER (WHERE op = 'create') > 0 AND count(*) FILTER (WHERE op = 'delete') = 0"""


@register("st12_summary_after_changes", with_views("SELECT " + ", ".join(
    [f"count(*) FILTER (WHERE entity = 'alert'{c}) AS {n}" for c, n in (
        ("", "alerts_total"), (" AND status = 'open'", "alerts_open"), (" AND severity = 'critical'", "alerts_critical"),
        (" AND severity = 'high'", "alerts_high"), (" AND severity = 'medium'", "alerts_medium"),
        (" AND severity = 'low'", "alerts_low"))]
    + [f"count(*) FILTER (WHERE entity = 'incident'{c}) AS {n}" for c, n in (
        ("", "incidents_total"), (" AND status = 'open'", "incidents_open"),
        (" AND status = 'investigating'", "incidents_investigating"),
        (" AND status IN ('open', 'investigating')", "active_incidents"))]) + f" FROM ({VISIBLE_SQL}) v", ["live_changes"]))
def st12c(d: Domain):
    """ST-12: the live dashboard counts of alerts and incidents after all of
    their creations, patches and deletions (batch form of the delta stream)."""
    from nightjar.streaming.live import live_summary, visible_rows
    return live_summary(visible_rows(d.live_changes))


@register("st12_trend_after_changes", with_views(f"""
SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
       count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info,
       count(*) AS total
FROM ({VISIBLE_SQL}) v WHERE entity = 'alert' GROUP BY 1""", ["live_changes"]))
def st12d(d: Domain):
    from nightjar.streaming.live import live_trend, visible_rows
    return live_trend(visible_rows(d.live_changes))
