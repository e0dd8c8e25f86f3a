"""Analytics over alerts, incidents, assets and vulnerabilities
(A-1..A-11, J-3..J-7, J-12, W-1, SET-1, SO-3..SO-6).

Every operator is a lazy ``DataFrame -> DataFrame`` function.  Fact tables
are aggregated *before* they meet a dimension (partial aggregation absorbs
hot keys map-side, and the join then sees one row per key); only fixed-size
dimensions (techniques, tactics, the 7×24 grid, one-row totals) are broadcast
explicitly — other join strategies are left to AQE, which broadcasts a side
only after measuring it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.functions.scalars import (check_range, days_before, dow_sunday0, hour_of_day, iso_utc, map_values,
                                        round_half_up, utc_day)


def _sev_count(sev: str, col: str = "severity") -> Column:
    return F.count_if(F.col(col) == sev)


def since(df: DataFrame, ts_col: str, days: int, as_of: dt.datetime | str) -> DataFrame:
    """F-4: rolling window ``ts >= as_of - days·24h`` (not midnight aligned)."""
    check_range("days", days, 1, schemas.MAX_DAYS)
    return df.where(F.col(ts_col) >= days_before(as_of, days))


# --------------------------------------------------------------------------
# A-1 / A-2 / A-3 / J-12
# --------------------------------------------------------------------------
def alerts_trend(alerts: DataFrame, days: int, as_of: dt.datetime | str) -> DataFrame:
    """A-1: per UTC day (``YYYY-MM-DD``): counts by severity + total, only days
    with alerts, ascending.  One pass with conditional counts (no pivot job)."""
    a = since(alerts.select("created_at", "severity"), "created_at", days, as_of)
    aggs = [_sev_count(s).alias(s) for s in schemas.SEVERITIES]
    out = a.groupBy(utc_day("created_at").alias("date")).agg(*aggs)
    total = sum((F.col(s) for s in schemas.SEVERITIES[1:]), F.col(schemas.SEVERITIES[0]))
    return out.withColumn("total", total).orderBy("date")


def alerts_heatmap(alerts: DataFrame, days: int, as_of: dt.datetime | str) -> DataFrame:
    """A-2: sparse (day_of_week Sunday=0, hour) counts in UTC."""
    a = since(alerts.select("created_at"), "created_at", days, as_of)
    return a.groupBy(dow_sunday0("created_at").alias("day_of_week"),
                     hour_of_day("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def heatmap_grid(heatmap: DataFrame) -> DataFrame:
    """J-12: densify to the full 7×24 grid, missing cells = 0."""
    # the 168 cells come from one range, no cross product
    grid = heatmap.sparkSession.range(7 * 24).select((F.col("id") / 24).cast("int").alias("day_of_week"),
                                                     (F.col("id") % 24).cast("int").alias("hour"))
    return (F.broadcast(grid).join(heatmap, ["day_of_week", "hour"], "left")
            .select("day_of_week", "hour", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def heatmap_levels(cells: DataFrame) -> DataFrame:
    """A-3: ratio = count / max(1, max count); level 0 if ratio ≤ 0 else
    1 + min(4, floor(ratio·5)).  The max is a scalar subquery (no join, no
    single-partition window over the cells)."""
    mx = cells.agg(F.greatest(F.lit(1), F.max("count"))).scalar()
    ratio = F.col("count") / mx
    level = F.when(ratio <= 0, F.lit(0)).otherwise(1 + F.least(F.lit(4), F.floor(ratio * 5).cast("int")))
    return cells.select(*cells.columns, ratio.alias("ratio"), level.cast("int").alias("level"))


# --------------------------------------------------------------------------
# A-4 / J-4 / SO-5 / J-7 / SO-6
# --------------------------------------------------------------------------
def technique_lookup(counts: DataFrame, techniques: DataFrame, id_col: str = "technique_id") -> DataFrame:
    """J-4: left lookup into the fixed technique dimension; a missing name is
    the id itself, a missing tactic is ``unknown``."""
    t = F.broadcast(techniques.select(F.col("id").alias(id_col), F.col("name").alias("_name"),
                                      F.col("tactic").alias("_tactic")))
    j = counts.join(t, id_col, "left")
    return j.select(*[c for c in counts.columns if c == id_col],
                    F.coalesce("_name", F.col(id_col)).alias("name"),
                    F.coalesce("_tactic", F.lit("unknown")).alias("tactic"),
                    *[c for c in counts.columns if c != id_col])


def mitre_frequency(mappings: DataFrame, techniques: DataFrame) -> DataFrame:
    """A-4: alerts per technique with name/tactic, count desc (id breaks ties)."""
    counts = mappings.groupBy(F.col("mitre_technique_id").alias("technique_id")).agg(
        F.count(F.lit(1)).alias("count"))
    return technique_lookup(counts, techniques).orderBy(F.desc("count"), "technique_id")


def top_techniques(frequency: DataFrame, k: int = 10) -> DataFrame:
    """SO-5: the first ``k`` rows of A-4 (a top-k report)."""
    return frequency.orderBy(F.desc("count"), "technique_id").limit(k)


def techniques_by_tactic(techniques: DataFrame, tactic: str | None = None) -> DataFrame:
    """F-7 + SO-7: exact tactic filter (unknown tactic → empty), id order."""
    t = techniques if tactic is None else techniques.where(F.col("tactic") == tactic)
    return t.orderBy("id")


def tactic_order(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(schemas.TACTIC_ORDER)), "tactic_position int, tactic string")


def technique_matrix(techniques: DataFrame, mappings: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """J-7 + SO-6: every technique of a known tactic with its alert count
    (0 when none), in kill-chain order.  Tactics outside the fixed list are
    dropped.  ``alerts`` optionally restricts the counted alerts (semi join)."""
    m = mappings
    if alerts is not None:
        m = m.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
    counts = m.groupBy(F.col("mitre_technique_id").alias("id")).agg(F.count(F.lit(1)).alias("alert_count"))
    dim = F.broadcast(techniques.join(F.broadcast(tactic_order(techniques.sparkSession)), "tactic"))
    return (dim.join(counts, "id", "left")
            .select("tactic_position", "tactic", F.col("id").alias("technique_id"), "name",
                    F.coalesce("alert_count", F.lit(0)).cast("long").alias("alert_count"))
            .orderBy("tactic_position", "technique_id"))


# --------------------------------------------------------------------------
# A-5 / J-5 / A-6 / W-1 / J-6
# --------------------------------------------------------------------------
def detection_by_source(sources: DataFrame, raw_events: DataFrame, alerts: DataFrame) -> DataFrame:
    """A-5: per source raw events in, alerts out and the rate in percent with
    one decimal (0 when there are no raw events).  Both facts are aggregated
    per source before the joins (J-5)."""
    raw = raw_events.groupBy(F.col("ingestion_source_id").alias("source_id")).agg(
        F.count(F.lit(1)).alias("raw_event_count"))
    al = (alerts.where(F.col("ingestion_source_id").isNotNull())
          .groupBy(F.col("ingestion_source_id").alias("source_id")).agg(F.count(F.lit(1)).alias("alert_count")))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"),
                       F.col("type").alias("source_type"))
    j = s.join(raw, "source_id", "left").join(al, "source_id", "left")
    rawc = F.coalesce("raw_event_count", F.lit(0)).cast("long")
    alc = F.coalesce("alert_count", F.lit(0)).cast("long")
    rate = F.when(rawc > 0, round_half_up(alc / rawc * 1000) / 10).otherwise(F.lit(0.0))
    return (j.select("source_id", "source_name", "source_type", rawc.alias("raw_event_count"),
                     alc.alias("alert_count"), rate.cast("double").alias("alert_rate"))
            .orderBy(F.desc("raw_event_count"), "source_id"))


def rule_samples(alerts: DataFrame) -> DataFrame:
    """W-1: one representative alert per (title, severity): the earliest, then
    the smallest id.  ``min_by`` combines map-side, so a hot group never
    gathers in one task."""
    return alerts.groupBy("title", "severity").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by("id", F.struct("created_at", "id")).alias("sample_alert_id"))


def detection_by_rule(alerts: DataFrame, mappings: DataFrame) -> DataFrame:
    """A-6 (+ J-6): ingestion-sourced alerts grouped by (title, severity), count
    and the technique ids of the group's sample alert; count desc."""
    g = rule_samples(alerts.where(F.col("ingestion_source_id").isNotNull()))
    techs = (mappings.join(g.select(F.col("sample_alert_id").alias("alert_id")), "alert_id", "left_semi")
             .groupBy(F.col("alert_id").alias("sample_alert_id"))
             .agg(F.array_sort(F.collect_set("mitre_technique_id")).alias("mitre_technique_ids")))
    return (g.join(techs, "sample_alert_id", "left")
            .select("title", "severity",
                    F.coalesce("mitre_technique_ids", F.array().cast("array<string>")).alias("mitre_technique_ids"),
                    "count", "sample_alert_id")
            .orderBy(F.desc("count"), "title", "severity"))


# --------------------------------------------------------------------------
# J-3 / A-7 / A-8
# --------------------------------------------------------------------------
def _points(col: str, table: dict) -> Column:
    return map_values(col, table, 0)


def asset_exposure(assets: DataFrame, vulnerabilities: DataFrame, alerts: DataFrame) -> DataFrame:
    """J-3: every asset with its open vulnerabilities and unresolved alerts,
    each child side aggregated per asset *before* the join (no fan-out)."""
    v = (vulnerabilities.where((F.col("status") == "open") & F.col("asset_id").isNotNull())
         .groupBy("asset_id").agg(
             F.count(F.lit(1)).alias("open_vulnerabilities"),
             _sev_count("critical").alias("critical_vulnerabilities"),
             F.sum(_points("severity", schemas.VULN_POINTS)).alias("vuln_points")))
    a = (alerts.where(F.col("status").isin(*schemas.UNRESOLVED_ALERT_STATUSES) & F.col("asset_id").isNotNull())
         .groupBy("asset_id").agg(
             F.count(F.lit(1)).alias("open_alerts"),
             _sev_count("critical").alias("critical_alerts"),
             F.sum(_points("severity", schemas.ALERT_POINTS)).alias("alert_points")))
    base = assets.select(F.col("id").alias("asset_id"), "name", "type", "criticality")
    j = base.join(v, "asset_id", "left").join(a, "asset_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return j.select("asset_id", "name", "type", "criticality",
                    *[z(c).alias(c) for c in ("open_vulnerabilities", "critical_vulnerabilities", "open_alerts",
                                              "critical_alerts", "vuln_points", "alert_points")])


def risk_score(points: Column, criticality: Column) -> Column:
    """min(100, round(points · multiplier)) in double arithmetic."""
    mult = map_values(criticality, schemas.CRITICALITY_MULTIPLIER, 1.0).cast("double")
    return F.least(F.lit(100.0), round_half_up(points.cast("double") * mult)).cast("long")


def risk_tier(score: Column | str) -> Column:
    """A-8: ≥75 Critical, ≥50 High, ≥25 Medium, else Low."""
    s = F.col(score) if isinstance(score, str) else score
    out = None
    for lo, label in schemas.RISK_TIERS[:-1]:
        out = F.when(s >= lo, F.lit(label)) if out is None else out.when(s >= lo, F.lit(label))
    return out.otherwise(F.lit(schemas.RISK_TIERS[-1][1]))


def asset_risk(assets: DataFrame, vulnerabilities: DataFrame, alerts: DataFrame, top_n: int | None = None) -> DataFrame:
    """A-7: per asset counts and a 0-100 risk score, highest first."""
    e = asset_exposure(assets, vulnerabilities, alerts)
    out = e.select("asset_id", "name", "type", "criticality", "open_vulnerabilities", "critical_vulnerabilities",
                   "open_alerts", "critical_alerts",
                   risk_score(F.col("vuln_points") + F.col("alert_points"), F.col("criticality")).alias("risk_score"))
    out = out.withColumn("risk_tier", risk_tier("risk_score")).orderBy(F.desc("risk_score"), "asset_id")
    return out.limit(top_n) if top_n else out


# --------------------------------------------------------------------------
# A-9 / A-10 / A-11 / SO-3
# --------------------------------------------------------------------------
def dashboard_summary(alerts: DataFrame, incidents: DataFrame, vulnerabilities: DataFrame,
                      assets: DataFrame) -> DataFrame:
    """A-9 (+ A-10): one global aggregate per table (4 scans instead of 13
    counts), each a scalar subquery returning a struct, read into one row."""
    st, sev = F.col("status"), F.col("severity")

    def one(df: DataFrame, *aggs: Column) -> Column:
        return df.agg(F.struct(*aggs).alias("s")).scalar()

    a = one(alerts, F.count(F.lit(1)).alias("alerts_total"), F.count_if(st == "open").alias("alerts_open"),
            *[F.count_if(sev == s).alias(f"alerts_{s}") for s in ("critical", "high", "medium", "low")])
    i = one(incidents, F.count(F.lit(1)).alias("incidents_total"), F.count_if(st == "open").alias("incidents_open"),
            F.count_if(st == "investigating").alias("incidents_investigating"))
    v = one(vulnerabilities, F.count(F.lit(1)).alias("vulnerabilities_total"),
            F.count_if(st == "open").alias("vulnerabilities_open"),
            F.count_if((st == "open") & (sev == "critical")).alias("vulnerabilities_critical"))
    s = one(assets, F.count(F.lit(1)).alias("assets_total"))
    out = alerts.sparkSession.range(1).select(a.alias("_a"), i.alias("_i"), v.alias("_v"), s.alias("_s")).select(
        "_a.*", "_i.*", "_v.*", "_s.*")
    return out.withColumn("active_incidents", F.col("incidents_open") + F.col("incidents_investigating"))


def severity_share(summary: DataFrame) -> DataFrame:
    """A-11: bar width per severity = count / max(1, critical, high, medium,
    low) · 100 (info is not part of the summary)."""
    sevs = ["critical", "high", "medium", "low"]
    mx = F.greatest(F.lit(1), *[F.col(f"alerts_{s}") for s in sevs])
    return summary.select(*[(F.col(f"alerts_{s}") / mx * 100).alias(f"share_{s}") for s in sevs])


def recent_alerts(alerts: DataFrame, mappings: DataFrame, k: int = 5) -> DataFrame:
    """SO-3: the ``k`` newest alerts with their technique ids; the limit runs
    first so only ``k`` alerts (at most 500) reach the broadcast join."""
    check_range("k", k, 1, 500)
    top = alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(k)
    return (with_techniques(top, mappings, small_alerts=True)
            .orderBy(F.desc("created_at"), F.desc("id")))


def with_techniques(alerts: DataFrame, mappings: DataFrame, small_alerts: bool = False) -> DataFrame:
    """J-1 / P-2: alerts with a sorted ``mitre_technique_ids`` array (``[]`` when
    none).  Mappings are folded per alert first (one row per alert, bounded
    by the technique dimension), then left-joined on the alert id.
    ``small_alerts`` marks a side of proven small size (a top-k) that may be
    broadcast to prune the mappings before aggregation."""
    m = mappings
    if small_alerts:
        m = m.join(F.broadcast(alerts.select(F.col("id").alias("alert_id"))), "alert_id", "left_semi")
    folded = m.groupBy(F.col("alert_id").alias("id")).agg(
        F.array_sort(F.collect_set("mitre_technique_id")).alias("mitre_technique_ids"))
    j = alerts.join(folded, "id", "left")
    return j.select(*alerts.columns,
                    F.coalesce("mitre_technique_ids", F.array().cast("array<string>")).alias("mitre_technique_ids"))


# --------------------------------------------------------------------------
# SET-1 / P-3
# --------------------------------------------------------------------------
def timeline_projection(df: DataFrame, kind: str) -> DataFrame:
    """P-3: alert or incident → (id, kind, title, severity, status, occurred_at,
    mitre_technique_ids); incidents carry ``[]``."""
    techs = F.col("mitre_technique_ids") if "mitre_technique_ids" in df.columns else F.array().cast("array<string>")
    return df.select(F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), "title", "severity",
                     "status", F.col("created_at").alias("occurred_ts"), iso_utc("created_at").alias("occurred_at"),
                     techs.alias("mitre_technique_ids"))


def timeline(alerts: DataFrame, incidents: DataFrame, mappings: DataFrame, days: int, limit: int,
             as_of: dt.datetime | str) -> DataFrame:
    """SET-1: newest ``limit`` alerts and incidents merged; on equal times an
    alert precedes an incident.  Each branch is cut to ``limit`` first
    (``TakeOrderedAndProject``), and technique ids are joined after the cut."""
    check_range("limit", limit, 1, schemas.MAX_TIMELINE_LIMIT)
    # the branch cut uses the merged order's key (id as text), so ties at
    # the cut keep exactly the rows the merged order would keep
    order = [F.desc("created_at"), F.col("id").cast("string").asc()]
    a = since(alerts, "created_at", days, as_of).orderBy(*order).limit(limit)
    i = since(incidents, "created_at", days, as_of).orderBy(*order).limit(limit)
    a = with_techniques(a, mappings, small_alerts=True)
    u = timeline_projection(a, "alert").unionByName(timeline_projection(i, "incident"))
    return u.orderBy(F.desc("occurred_ts"), "kind", "id").limit(limit).drop("occurred_ts")


def daily_summary(alerts: DataFrame, incidents: DataFrame, vulnerabilities: DataFrame, assets: DataFrame,
                  day: str) -> DataFrame:
    """ST-13: the scheduled daily report — the A-9 summary over the alerts and
    incidents created on one UTC day (date-partition prunable), with the
    vulnerability and asset totals as of the run."""
    start = dt.datetime.fromisoformat(day)
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(start + dt.timedelta(days=1)).cast("timestamp_ntz")
    in_day = (F.col("created_at") >= lo) & (F.col("created_at") < hi)
    s = dashboard_summary(alerts.where(in_day), incidents.where(in_day), vulnerabilities, assets)
    return s.select(F.lit(day).alias("day"), *s.columns)


def daily_report(alerts: DataFrame, incidents: DataFrame, vulnerabilities: DataFrame, assets: DataFrame,
                 day: str, out_path: str) -> DataFrame:
    """ST-13 job body: the day's summary plus a CSV export of the day's alerts
    (newest first) under ``out_path``; scheduling stays external."""
    from nightjar.sinks.export import export_csv
    start = dt.datetime.fromisoformat(day)
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(start + dt.timedelta(days=1)).cast("timestamp_ntz")
    export_csv(alerts.where((F.col("created_at") >= lo) & (F.col("created_at") < hi)), f"{out_path}/alerts")
    summary = daily_summary(alerts, incidents, vulnerabilities, assets, day)
    summary.write.mode("overwrite").json(f"{out_path}/summary")
    return summary
