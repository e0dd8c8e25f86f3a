"""Listing, hunting and lookups (P-*, F-*, SO-1/2/7, J-1, J-2, J-10, A-12, A-13).

Filters are plain predicates on the lazy frame, so Catalyst pushes them into
the Parquet scan (and prunes date partitions for time bounds).  A page is an
ordered ``offset/limit`` (``TakeOrderedAndProject``: each task keeps only its
best ``offset + size`` rows); deep pages use the keyset form instead.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar import schemas
from nightjar.functions.scalars import check_range, enum_rank, id_prefix, ts_literal

ENUM_SORT_DOMAINS = {"severity": schemas.SEVERITIES, "criticality": schemas.SEVERITIES}
DASH = "—"
#: Rows that a page may skip; every task keeps the skipped rows of its part.
MAX_OFFSET = 100_000


# --------------------------------------------------------------------------
# F-*: predicates
# --------------------------------------------------------------------------
def equality_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """F-1: AND of ``col = value`` for every parameter given; ``None`` (and an
    empty string) means the parameter is absent."""
    cond = None
    for c, v in filters.items():
        if v is None or (isinstance(v, str) and v == ""):
            continue
        term = F.col(c) == F.lit(v)
        cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


def contains_filter(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """F-2: case-sensitive substring match; empty/absent text = no filter."""
    return df if not text else df.where(F.col(column).contains(text))


def since_filter(df: DataFrame, column: str, since: dt.datetime | str | None) -> DataFrame:
    """F-3: inclusive lower bound (partition-prunable)."""
    return df if since is None else df.where(F.col(column) >= ts_literal(since))


def unresolved_alerts(alerts: DataFrame) -> DataFrame:
    """F-5: status in (open, acknowledged)."""
    return alerts.where(F.col("status").isin(*schemas.UNRESOLVED_ALERT_STATUSES))


def unread(notifications: DataFrame) -> DataFrame:
    """F-6: read_at is null."""
    return notifications.where(F.col("read_at").isNull())


def ingestion_sourced(alerts: DataFrame) -> DataFrame:
    """F-6: alerts that came from an ingestion source."""
    return alerts.where(F.col("ingestion_source_id").isNotNull())


def lookup(df: DataFrame, id_value, id_col: str = "id") -> DataFrame:
    """F-8: point lookup; not found → empty frame."""
    return df.where(F.col(id_col) == F.lit(id_value)).limit(1)


def own_rows(df: DataFrame, user_id, user_col: str = "user_id") -> DataFrame:
    """F-9: rows of one user only (always ANDed)."""
    return df.where(F.col(user_col) == F.lit(user_id))


def retain(df: DataFrame, ts_col: str, as_of: dt.datetime | str, hours: int = 168) -> DataFrame:
    """F-12: keep rows newer than ``as_of - hours``."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return df.where(F.col(ts_col) >= ts_literal(as_of - dt.timedelta(hours=hours)))


# --------------------------------------------------------------------------
# SO-1 / SO-2 / SO-4 / SO-7: ordering and pages
# --------------------------------------------------------------------------
def sort_key(column: str, descending: bool) -> list[Column]:
    """SO-4 + null order: enums sort by declaration rank; nulls last on asc and
    first on desc (the relational default being reproduced)."""
    c = enum_rank(column, ENUM_SORT_DOMAINS[column]) if column in ENUM_SORT_DOMAINS else F.col(column)
    return [c.desc_nulls_first() if descending else c.asc_nulls_last()]


def ordered(df: DataFrame, sort_by: str = "created_at", order: str = "desc", id_col: str = "id") -> DataFrame:
    """SO-7: a total order (id breaks ties) so pages never overlap."""
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    keys = sort_key(sort_by, order == "desc")
    if id_col in df.columns and sort_by != id_col:
        keys.append(F.col(id_col).asc())
    return df.orderBy(*keys)


def page(df: DataFrame, page_no: int = 1, page_size: int = 25, sort_by: str = "created_at", order: str = "desc",
         entity: str | None = None, max_page_size: int = schemas.MAX_PAGE_SIZE) -> DataFrame:
    """SO-1: ``ORDER BY`` one whitelisted column, skip (page−1)·size, take size.

    Up to ``MAX_OFFSET`` rows are skipped by sorting them; a deeper page starts
    at the row before it, which ``row_at`` finds from counts per range."""
    check_range("page", page_no, 1, 10**9)
    check_range("page_size", page_size, 1, max_page_size)
    if entity is not None and sort_by not in schemas.SORTABLE.get(entity, [sort_by]):
        raise ValueError(f"{entity} cannot be sorted by {sort_by}")
    out = ordered(df, sort_by, order)
    skip = (page_no - 1) * page_size
    if skip > MAX_OFFSET:
        before = row_at(df, skip - 1, sort_by, order)
        return out.limit(0) if before is None else keyset_page(df, page_size, sort_by, tuple(before), order=order)
    return (out.offset(skip) if skip else out).limit(page_size)


#: Ranges that one pass of ``row_at`` counts, and rows that it sorts at last.
RANGES, SORTED_ROWS = 1024, 100_000


def _places(c: Column, kind: T.DataType, chunk: int) -> Column:
    """A column as a number in the same order; text by seven bytes at a time."""
    if isinstance(kind, T.StringType):
        piece = F.hex(F.substring(c.cast("binary"), 7 * chunk + 1, 7))
        return F.conv(F.rpad(piece, 14, "0"), 16, 10).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("long" if isinstance(kind, (T.IntegralType, T.BooleanType)) else "double")


def row_at(df: DataFrame, rank: int, sort_by: str = "created_at", order: str = "desc", id_col: str = "id"):
    """(sort key, id) of the row at a 0-based rank of ``ordered``, or None.

    Each pass counts the rows per range of the sort key (one partial
    aggregation; at most ``RANGES`` counts reach the driver) and goes on inside
    the range that holds the rank, down to the id where the keys are equal,
    until few enough rows are left to sort.  Rows before the page are counted,
    never sorted or moved."""
    ranked = sort_by in ENUM_SORT_DOMAINS
    key = enum_rank(sort_by, ENUM_SORT_DOMAINS[sort_by]) if ranked else F.col(sort_by)
    desc = order == "desc"
    levels = [(key, T.IntegerType() if ranked else df.schema[sort_by].dataType, desc),
              (F.col(id_col), df.schema[id_col].dataType, False)]
    part = df
    for column, kind, down in levels:
        present = part.where(column.isNotNull()).count()
        missing = part.where(column.isNull()).count()
        nulls_first = down
        if rank >= present + missing:
            return None
        in_nulls = rank < missing if nulls_first else rank >= present
        rank -= missing if nulls_first and not in_nulls else present if in_nulls and not nulls_first else 0
        part = part.where(column.isNull() if in_nulls else column.isNotNull())
        left, chunk = (missing if in_nulls else present), 0
        while not in_nulls and left > SORTED_ROWS:
            place = _places(column, kind, chunk)
            low, high = part.agg(F.min(place), F.max(place)).first()
            if low == high:
                longest = part.agg(F.max(F.octet_length(column))).first()[0] if isinstance(kind, T.StringType) else 0
                chunk += 1
                if 7 * chunk >= longest:
                    break  # all equal: the next level decides
                continue
            width = (high - low) / RANGES if isinstance(low, float) else -(-(high - low + 1) // RANGES)
            at = F.least(F.floor((place - F.lit(low)) / F.lit(width)), F.lit(RANGES - 1)).cast("int")
            if not isinstance(low, float):
                at = F.expr("int(0)") + ((place - F.lit(low)) / F.lit(width)).cast("long").cast("int")
            counts = sorted(((r[0], r[1]) for r in part.groupBy(at.alias("at")).count().collect()), reverse=down)
            for bucket, n in counts:
                if rank < n:
                    break
                rank -= n
            part, shrunk = part.where(at == bucket), n < left
            left = n
            if not shrunk and isinstance(low, float):
                break  # doubles too close to be told apart by width
        if left <= SORTED_ROWS:
            break
    row = ordered(part, sort_by, order, id_col).select(sort_by, id_col).offset(rank).limit(1).collect()
    return row[0] if row else None


def keyset_page(df: DataFrame, page_size: int, sort_by: str = "created_at", after: tuple | None = None,
                id_col: str = "id", order: str = "desc", entity: str | None = None) -> DataFrame:
    """SO-1, deep pages: the rows after the ``(key, id)`` of the last row seen,
    in the order of ``page`` (enums by rank, nulls first when descending and
    last when ascending; either direction); no offset, so page 10 000 costs
    what page 1 costs."""
    if entity is not None and sort_by not in schemas.SORTABLE.get(entity, [sort_by]):
        raise ValueError(f"{entity} cannot be sorted by {sort_by}")
    out = ordered(df, sort_by, order, id_col)
    if after is not None:
        k, i = after
        desc, ranked = order == "desc", sort_by in ENUM_SORT_DOMAINS
        key = enum_rank(sort_by, ENUM_SORT_DOMAINS[sort_by]) if ranked else F.col(sort_by)
        at = F.lit(ENUM_SORT_DOMAINS[sort_by].index(k)) if ranked and k in ENUM_SORT_DOMAINS[sort_by] else F.lit(k)
        later_id = F.col(id_col) > F.lit(i)
        if k is None:  # the rest of the null keys; when descending, all others follow them
            rest = key.isNull() & later_id
            rest = rest | key.isNotNull() if desc else rest
        else:
            rest = (key < at if desc else key > at) | ((key == at) & later_id)
            rest = rest if desc else rest | key.isNull()
        out = out.where(rest)
    return out.limit(page_size)


def filtered_total(df: DataFrame) -> DataFrame:
    """A-12: total rows under the page's filters, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_bounds(totals: DataFrame, page_no: int, page_size: int) -> DataFrame:
    """SO-2: total_pages = max(1, ceil(total/size)); the 1-based first and last
    row shown (0..0 when empty)."""
    t = F.col("total")
    return totals.select(
        t,
        F.greatest(F.lit(1), F.ceil(t / F.lit(page_size))).cast("long").alias("total_pages"),
        F.when(t == 0, F.lit(0)).otherwise(F.lit((page_no - 1) * page_size + 1)).cast("long").alias("start"),
        F.least(F.lit(page_no * page_size), t).cast("long").alias("end"),
    )


def paged(df: DataFrame, page_no: int, page_size: int, sort_by: str = "created_at", order: str = "desc",
          entity: str | None = None, max_page_size: int = schemas.MAX_PAGE_SIZE) -> dict[str, DataFrame]:
    """Envelope {items, total}: both come from the same lazy filtered frame."""
    return {"items": page(df, page_no, page_size, sort_by, order, entity, max_page_size),
            "total": filtered_total(df)}


# --------------------------------------------------------------------------
# Entity listings
# --------------------------------------------------------------------------
def public_users(users: DataFrame) -> DataFrame:
    """P-1: exactly the public columns (never a password hash), oldest first."""
    return users.select("id", "email", "name", "role", "is_active", "created_at").orderBy("created_at", "id")


def list_alerts(alerts: DataFrame, mappings: DataFrame, status=None, severity=None, asset_id=None,
                incident_id=None, page_no: int = 1, page_size: int = 25, sort_by: str = "created_at",
                order: str = "desc") -> dict[str, DataFrame]:
    """F-1 + SO-1 + J-1: a page of alerts with technique ids; ids are joined
    after the page is cut."""
    from nightjar.operators.analytics import with_techniques
    f = equality_filters(alerts, {"status": status, "severity": severity, "asset_id": asset_id,
                                  "incident_id": incident_id})
    env = paged(f, page_no, page_size, sort_by, order, "alerts")
    items = with_techniques(env["items"], mappings, small_alerts=True)
    env["items"] = ordered(items, sort_by, order)
    return env


def hunt_raw_events(raw_events: DataFrame, ingestion_source_id=None, source_ip: str | None = None,
                    normalized_type: str | None = None, since=None, page_no: int = 1,
                    page_size: int = 100) -> dict[str, DataFrame]:
    """Hunting (F-1/F-2/F-3 + SO-1): newest first, page size up to 500."""
    f = equality_filters(raw_events, {"ingestion_source_id": ingestion_source_id,
                                      "normalized_type": normalized_type})
    f = contains_filter(f, "source_ip", source_ip)
    f = since_filter(f, "received_at", since)
    return paged(f, page_no, page_size, "received_at", "desc", None, schemas.MAX_RAW_EVENT_PAGE_SIZE)


# --------------------------------------------------------------------------
# F-2 / F-3 over landed events: days that cannot match are not opened
# --------------------------------------------------------------------------
def _trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a text."""
    n = F.length(c) - 2
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                                        lambda i: F.substring(c, i, F.lit(3))))


def day_trigrams(raw_events: DataFrame, day_col: str = "received_date", column: str = "source_ip") -> DataFrame:
    """(day, trigram) of all values of a column: a side table of a few thousand
    rows a day at most for addresses, however many events a day has."""
    return (raw_events.where(F.col(column).isNotNull()).select(day_col, column).distinct()
            .select(day_col, F.explode(_trigrams(F.col(column))).alias("trigram")).distinct())


def matching_days(trigrams: DataFrame, text: str, day_col: str = "received_date") -> list | None:
    """The days on which some value may contain ``text``: those that have all of
    its trigrams.  None (any day) for a text of fewer than three characters."""
    wanted = sorted({text[i:i + 3] for i in range(len(text) - 2)})
    if not wanted:
        return None
    days = (trigrams.where(F.col("trigram").isin(wanted)).groupBy(day_col)
            .agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted)))
    return [r[0] for r in days.select(day_col).collect()]  # one value per day


def hunt_landed(raw_events: DataFrame, trigrams: DataFrame, source_ip: str | None = None,
                day_col: str = "received_date", **filters) -> dict[str, DataFrame]:
    """``hunt_raw_events`` over landed events (partitioned by day) that opens
    only the days whose trigrams allow ``source_ip``.  A day that the side table
    does not know yet is opened too, so a late side table costs time, not rows."""
    days = matching_days(trigrams, source_ip, day_col) if source_ip else None
    if days is not None:
        known = [r[0] for r in trigrams.select(day_col).distinct().collect()]
        skipped = sorted(set(known) - set(days))
        raw_events = raw_events.where(F.col(day_col).isNull() | ~F.col(day_col).isin(skipped)) if skipped else raw_events
    return hunt_raw_events(raw_events, source_ip=source_ip, **filters)


def audit_view(audit_logs: DataFrame, users: DataFrame) -> DataFrame:
    """P-4 + J-10: actor e-mail or ``system``; target ``type:first 8 chars`` or
    ``—``; ip or ``—``.  Users are folded to (id, email) before the join, and
    rows without an actor are dealt over partitions."""
    u = users.select(F.col("id").alias("actor_id"), F.col("email").alias("_email"))
    j = left_lookup(audit_logs, u, "actor_id")
    return j.select(
        "id", "action",
        F.coalesce("_email", F.lit("system")).alias("actor"),
        F.when(F.col("target_type").isNotNull(),
               F.concat(F.col("target_type"), F.lit(":"), F.coalesce(id_prefix("target_id"), F.lit(""))))
        .otherwise(F.lit(DASH)).alias("target"),
        F.coalesce("ip_address", F.lit(DASH)).alias("ip_address"),
        "created_at",
    )


def skew_safe_lookup(fact: DataFrame, dim: DataFrame, key: str, hot_share: float = 0.01,
                     salt_buckets: int = 16) -> DataFrame:
    """Left lookup join ``fact ⟕ dim`` on ``key`` that splits hot keys.

    A key is hot when it holds at least ``hot_share`` of all fact rows (one
    count per key, partial aggregation, and the total as a scalar subquery), so at most
    ``1 / hot_share`` keys qualify whatever the data size: that list is safe
    to broadcast.  Fact rows of a hot key are spread over ``salt_buckets``
    salts by a hash of the row (not ``rand()``, so a retried task salts
    alike), and the matching dim rows are copied once per salt; every other
    key joins on salt 0.  Result = the plain left join."""
    if not 0 < hot_share <= 1:
        raise ValueError("hot_share must be in (0, 1]")
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where(F.col("_n") >= total * F.lit(hot_share)).select(key, F.lit(True).alias("_hot"))
    row_hash = F.xxhash64(*[F.col(c) for c in fact.columns])
    f = (fact.join(F.broadcast(hot), key, "left")
         .withColumn("_salt", F.when(F.col("_hot"), F.pmod(row_hash, F.lit(salt_buckets))).otherwise(F.lit(0)))
         .drop("_hot"))
    d = (dim.join(F.broadcast(hot), key, "left")
         .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt_buckets - 1)))
                                        .otherwise(F.array(F.lit(0)))))
         .drop("_hot"))
    return f.join(d, [key, "_salt"], "left").drop("_salt")


def left_lookup(fact: DataFrame, dim: DataFrame, key: str, id_col: str = "id", spread: int = 64) -> DataFrame:
    """Left lookup join ``fact ⟕ dim`` on ``key`` where most keys may be null:
    rows without a key match nothing, so a salt of their id deals them over
    partitions instead of sending all of them to the null key's."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(id_col), F.lit(spread))).otherwise(F.lit(0)).cast("int")
    return (fact.withColumn("_salt", salt).join(dim.withColumn("_salt", F.lit(0)), [key, "_salt"], "left")
            .drop("_salt"))


def with_assignee(alerts: DataFrame, users: DataFrame, placeholder: str = "Unassigned",
                  hot_share: float | None = None) -> DataFrame:
    """J-10: alert → assignee e-mail (placeholder when none / unknown).
    ``hot_share`` switches to ``skew_safe_lookup`` for a large user table
    with hot assignees; otherwise AQE picks broadcast or shuffle join."""
    u = users.select(F.col("id").alias("assigned_to_id"), F.col("email").alias("assignee"))
    j = (skew_safe_lookup(alerts, u, "assigned_to_id", hot_share) if hot_share
         else left_lookup(alerts, u, "assigned_to_id"))
    return j.select(*alerts.columns, F.coalesce("assignee", F.lit(placeholder)).alias("assignee"))


def with_asset_name(vulnerabilities: DataFrame, assets: DataFrame, placeholder: str = DASH,
                    hot_share: float | None = None) -> DataFrame:
    """J-10: vulnerability → asset name (placeholder when none / unknown)."""
    a = assets.select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"))
    j = (skew_safe_lookup(vulnerabilities, a, "asset_id", hot_share) if hot_share
         else left_lookup(vulnerabilities, a, "asset_id"))
    return j.select(*vulnerabilities.columns, F.coalesce("asset_name", F.lit(placeholder)).alias("asset_name"))


def incident_detail(incidents: DataFrame, alerts: DataFrame, timeline: DataFrame, incident_id) -> dict[str, DataFrame]:
    """J-2 for one incident: the row, its alerts (newest first) and its
    timeline (oldest first), each a filtered scan — the child lists are
    never gathered into one array, however many children an incident has."""
    return {
        "incident": lookup(incidents, incident_id),
        "alerts": alerts.where(F.col("incident_id") == F.lit(incident_id)).orderBy(F.desc("created_at"), "id"),
        "timeline": timeline.where(F.col("incident_id") == F.lit(incident_id)).orderBy("created_at", "id"),
    }


def incident_overview(incidents: DataFrame, alerts: DataFrame, timeline: DataFrame) -> DataFrame:
    """J-2 for every incident: linked alert counts and the first/last timeline
    entry, each child side aggregated per incident before the joins."""
    a = (alerts.where(F.col("incident_id").isNotNull()).groupBy("incident_id")
         .agg(F.count(F.lit(1)).alias("alert_count"),
              F.count_if(F.col("severity") == "critical").alias("critical_alert_count"),
              F.max("created_at").alias("last_alert_at")))
    t = (timeline.groupBy("incident_id")
         .agg(F.count(F.lit(1)).alias("timeline_count"),
              F.min_by("message", F.struct("created_at", "id")).alias("first_entry"),
              F.max_by("message", F.struct("created_at", "id")).alias("last_entry")))
    base = incidents.select(F.col("id").alias("incident_id"), "title", "severity", "status", "created_at")
    j = base.join(a, "incident_id", "left").join(t, "incident_id", "left")
    return j.select("incident_id", "title", "severity", "status", "created_at",
                    F.coalesce("alert_count", F.lit(0)).cast("long").alias("alert_count"),
                    F.coalesce("critical_alert_count", F.lit(0)).cast("long").alias("critical_alert_count"),
                    "last_alert_at",
                    F.coalesce("timeline_count", F.lit(0)).cast("long").alias("timeline_count"),
                    "first_entry", "last_entry")


def unread_count(notifications: DataFrame, user_id=None) -> DataFrame:
    """A-13: unread notifications, for one user or (``None``) per user; the
    count ignores any list filter."""
    n = notifications if user_id is None else own_rows(notifications, user_id)
    if user_id is not None:
        return n.agg(F.count_if(F.col("read_at").isNull()).alias("unread"))
    return n.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"),
                                    F.count(F.lit(1)).alias("total"))


def list_notifications(notifications: DataFrame, user_id, unread_only: bool = False, page_no: int = 1,
                       page_size: int = 25) -> dict[str, DataFrame]:
    """F-9 (+F-6) + SO-7: own notifications newest first, plus unread count."""
    own = own_rows(notifications, user_id)
    f = unread(own) if unread_only else own
    env = paged(f, page_no, page_size, "created_at", "desc")
    env["unread"] = unread_count(notifications, user_id)
    return env


# --------------------------------------------------------------------------
# One list function per read route (F-1 filters, SO-1 whitelist, SO-7 order)
# --------------------------------------------------------------------------
def list_incidents(incidents: DataFrame, status=None, severity=None, assigned_to_id=None, page_no: int = 1,
                   page_size: int = 25, sort_by: str = "created_at", order: str = "desc") -> dict[str, DataFrame]:
    f = equality_filters(incidents, {"status": status, "severity": severity, "assigned_to_id": assigned_to_id})
    return paged(f, page_no, page_size, sort_by, order, "incidents")


def list_assets(assets: DataFrame, type=None, criticality=None, page_no: int = 1, page_size: int = 25,  # noqa: A002
                sort_by: str = "created_at", order: str = "desc") -> dict[str, DataFrame]:
    f = equality_filters(assets, {"type": type, "criticality": criticality})
    return paged(f, page_no, page_size, sort_by, order, "assets")


def list_vulnerabilities(vulnerabilities: DataFrame, status=None, severity=None, asset_id=None, page_no: int = 1,
                         page_size: int = 25, sort_by: str = "created_at", order: str = "desc") -> dict[str, DataFrame]:
    f = equality_filters(vulnerabilities, {"status": status, "severity": severity, "asset_id": asset_id})
    return paged(f, page_no, page_size, sort_by, order, "vulnerabilities")


def list_iocs(iocs: DataFrame, type=None, severity=None, page_no: int = 1, page_size: int = 25,  # noqa: A002
              sort_by: str = "created_at", order: str = "desc") -> dict[str, DataFrame]:
    f = equality_filters(iocs, {"type": type, "severity": severity})
    return paged(f, page_no, page_size, sort_by, order, "iocs")


def list_audit_logs(audit_logs: DataFrame, action=None, actor_id=None, page_no: int = 1, page_size: int = 25,
                    order: str = "desc") -> dict[str, DataFrame]:
    f = equality_filters(audit_logs, {"action": action, "actor_id": actor_id})
    return paged(f, page_no, page_size, "created_at", order)


def list_sources(sources: DataFrame) -> DataFrame:
    """SRC-4 + SO-7: every ingestion source, oldest first."""
    return ordered(sources, "created_at", "asc")
