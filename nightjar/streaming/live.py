"""Live views as streaming aggregates (ST-12) and streaming SLO windows (ST-4..ST-7).

Timestamps are TIMESTAMP_NTZ at rest; a watermark needs TIMESTAMP, so event
time is cast (session time zone UTC) before ``withWatermark`` and the
window bounds are cast back.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from nightjar import schemas
from nightjar.functions.scalars import dow_sunday0, hour_of_day
from nightjar.operators.slo import BUCKET_BOUNDS, histogram_quantile


def _event_time(df: DataFrame, ts_col: str, watermark: str) -> DataFrame:
    return df.withColumn("_evt", F.col(ts_col).cast("timestamp")).withWatermark("_evt", watermark)


def alerts_trend_stream(alerts: DataFrame, watermark: str = "1 day") -> DataFrame:
    """ST-12: the A-1 per-day severity counts, maintained incrementally
    (``update`` output mode; state per day is dropped past the watermark, and
    with it alerts later than that: ``live_trend`` counts them)."""
    a = _event_time(alerts, "created_at", watermark)
    g = a.groupBy(F.window("_evt", "1 day").alias("_d")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in schemas.SEVERITIES],
        F.count(F.lit(1)).alias("total"))
    return g.select(F.date_format(F.col("_d.start"), "yyyy-MM-dd").alias("date"), *schemas.SEVERITIES, "total")


def alerts_heatmap_stream(alerts: DataFrame) -> DataFrame:
    """ST-12: the A-2 day-of-week × hour counts (168 keys, ``complete`` mode)."""
    return alerts.groupBy(dow_sunday0("created_at").alias("day_of_week"),
                          hour_of_day("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def summary_stream(alerts: DataFrame) -> DataFrame:
    """ST-12: the alert part of the dashboard summary (one row, ``complete``)."""
    st, sev = F.col("status"), F.col("severity")
    return alerts.agg(F.count(F.lit(1)).alias("alerts_total"), F.count_if(st == "open").alias("alerts_open"),
                      *[F.count_if(sev == s).alias(f"alerts_{s}") for s in ("critical", "high", "medium", "low")])


# --------------------------------------------------------------------------
# ST-12 under changes: signed deltas of the visible rows
# --------------------------------------------------------------------------
# A change: entity ('alert' | 'incident'), id, op ('create' | 'patch' |
# 'delete'), change_id, ts, and the fields it carries (null = absent).
CHANGE_FIELDS = ("severity", "status")
DELTA_SCHEMA = "entity string, id string, created_at timestamp, severity string, status string, delta int"
_DELTA_STATE = ("created_at timestamp, deleted boolean, severity string, severity_at string, "
                "status string, status_at string, shown_severity string, shown_status string, shown boolean")


def _order(changes: DataFrame) -> Column:
    """A change's place, as text that sorts like (ts, change_id)."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmssSSSSSS")
    return F.concat(ts, F.lit("|"), F.lpad(F.col("change_id").cast("string"), 40, " "))


def _prepared(changes: DataFrame) -> DataFrame:
    return changes.select(
        F.col("entity").cast("string").alias("entity"), F.col("id").cast("string").alias("id"), "op",
        F.col("ts").cast("timestamp").alias("ts"), _order(changes).alias("place"), *CHANGE_FIELDS)


def _delta(key: tuple, batches, state):
    """Fold the changes into the entity's state, whatever their order, and
    emit -1 for what it showed before and +1 for what it shows now."""
    entity, ident = key
    created, deleted, held, shown = None, False, {f: (None, "") for f in CHANGE_FIELDS}, None
    if state.exists:
        created, deleted, sev, sev_at, st, st_at, was_sev, was_st, was = state.get
        held = {"severity": (sev, sev_at), "status": (st, st_at)}
        shown = (was_sev, was_st) if was else None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.op == "create":
                created = row.ts if created is None else min(created, row.ts)
            deleted = deleted or row.op == "delete"
            for f in CHANGE_FIELDS:
                value = getattr(row, f)
                if isinstance(value, str) and row.place > held[f][1]:
                    held[f] = (value, row.place)
    now = (held["severity"][0], held["status"][0]) if created is not None and not deleted else None
    rows = []
    if now != shown:
        rows += [(entity, ident, created, *shown, -1)] if shown else []
        rows += [(entity, ident, created, *now, 1)] if now else []
    state.update((created, deleted, *held["severity"], *held["status"], *(now or (None, None)), now is not None))
    yield pd.DataFrame(rows, columns=["entity", "id", "created_at", "severity", "status", "delta"])


def signed_deltas(changes: DataFrame) -> DataFrame:
    """ST-12: a stream of changes of alerts and incidents (union them) as
    signed rows: +1 for each new visible value, -1 for the one it replaces, so
    a patched row leaves its old count and a deleted one leaves for good.

    State per entity holds each field's newest value with its place and what
    was counted last; changes may come late, out of order or twice, nothing
    is dropped by a watermark.  Append the rows to a table (the file sink is
    exactly once) and count them with ``live_summary`` and ``live_trend``."""
    return _prepared(changes).groupBy("entity", "id").applyInPandasWithState(
        _delta, DELTA_SCHEMA, _DELTA_STATE, "append", GroupStateTimeout.NoTimeout)


def visible_rows(changes: DataFrame) -> DataFrame:
    """The batch form of ``signed_deltas``: one row (delta 1) per entity that
    was created and not deleted, with the newest value of each field."""
    p = _prepared(changes)
    g = p.groupBy("entity", "id").agg(
        F.min(F.when(F.col("op") == "create", F.col("ts"))).alias("created_at"),
        F.max(F.col("op") == "delete").alias("_deleted"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("place"))).alias(f) for f in CHANGE_FIELDS])
    return g.where("created_at is not null and not _deleted").select(
        "entity", "id", "created_at", *CHANGE_FIELDS, F.lit(1).alias("delta"))


def live_summary(deltas: DataFrame) -> DataFrame:
    """ST-12: the dashboard counts of alerts and incidents (one row; on a
    stream of deltas in ``complete`` mode)."""
    def count(entity: str, cond: Column | None = None) -> Column:
        hit = F.col("entity") == entity
        return F.coalesce(F.sum(F.when(hit if cond is None else hit & cond, F.col("delta"))), F.lit(0)).cast("long")
    st, sev = F.col("status"), F.col("severity")
    return deltas.agg(
        count("alert").alias("alerts_total"), count("alert", st == "open").alias("alerts_open"),
        *[count("alert", sev == s).alias(f"alerts_{s}") for s in ("critical", "high", "medium", "low")],
        count("incident").alias("incidents_total"), count("incident", st == "open").alias("incidents_open"),
        count("incident", st == "investigating").alias("incidents_investigating"),
        count("incident", st.isin("open", "investigating")).alias("active_incidents"))


def live_trend(deltas: DataFrame) -> DataFrame:
    """ST-12: per-day severity counts of alerts (``complete`` mode; a late
    alert counts for its day however late it comes)."""
    a = deltas.where(F.col("entity") == "alert")
    g = a.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(
        *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("delta"))), F.lit(0)).cast("long").alias(s)
          for s in schemas.SEVERITIES], F.sum("delta").cast("long").alias("total"))
    return g.where("total > 0")


def _paned(s: DataFrame, keys: Sequence[str], window: str, slide: str, aggs: dict) -> DataFrame:
    """Sliding windows in two steps: each row enters one pane of ``slide``
    length, and the panes' few numbers enter the windows that hold them."""
    panes = s.groupBy(*keys, F.window("_evt", slide).alias("_p")).agg(*[c.alias(n) for n, c in aggs.items()])
    return (panes.withColumn("_t", F.window_time("_p"))
            .groupBy(*keys, F.window("_t", window, slide).alias("_w")).agg(*[F.sum(n).alias(n) for n in aggs]))


def _bounds(w: str = "_w") -> list:
    return [F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"),
            F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end")]


def quantiles_stream(samples: DataFrame, ts_col: str, value_col: str, keys: Sequence[str] = (),
                     window: str = "5 minutes", slide: str = "15 seconds", watermark: str = "1 minute",
                     quantiles: Sequence[float] = (0.5, 0.95, 0.99), bounds: Sequence[float] = BUCKET_BOUNDS
                     ) -> DataFrame:
    """ST-4/ST-5 on a stream: the batch form's bucket quantiles per sliding
    window; a window is emitted once the watermark passes its end (``append``).
    State per window is one number per bucket."""
    s = _event_time(samples.where(F.col(value_col).isNotNull()), ts_col, watermark)
    buckets = [f"_b{i}" for i in range(len(bounds))]
    g = _paned(s, keys, window, slide,
               {b: F.count_if(F.col(value_col) <= float(x)) for b, x in zip(buckets, bounds, strict=True)}
               | {"n": F.count(F.lit(1))})
    counted = g.select(*_bounds(), *keys, "n", F.array(*buckets).alias("_c"))
    return counted.select("window_start", "window_end", *keys, "n",
                          *[histogram_quantile(F.col("_c"), F.col("n"), p, bounds)
                            .alias("p" + f"{p * 100:g}".replace(".", "_")) for p in quantiles])


def error_ratio_stream(requests: DataFrame, ts_col: str = "ts", status_col: str = "status",
                       keys: Sequence[str] = (), window: str = "5 minutes", slide: str = "15 seconds",
                       watermark: str = "1 minute", threshold: float = 0.05) -> DataFrame:
    """ST-6/ST-7 on a stream: request count, 5xx ratio and breach flag per window."""
    s = _event_time(requests, ts_col, watermark)
    g = _paned(s, keys, window, slide, {"requests": F.count(F.lit(1)),
                                        "errors": F.count_if(F.col(status_col).rlike("^5..$"))})
    ratio = F.col("errors") / F.col("requests")
    return g.select(*_bounds(), *keys, "requests", "errors", ratio.alias("error_ratio"),
                    (ratio > threshold).alias("breach"))
