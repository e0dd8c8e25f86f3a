"""Change application as batch jobs (M-1..M-13, W-2, W-3, J-8, J-9, J-11, F-11).

A batch of change records is applied to a table snapshot; each operator
returns the new snapshot plus the rows the change derives (timeline, audit,
notifications, conflicts, unknown ids).  Patches are tri-state per field:
absent = keep, null = clear, value = set.  Folding patches per entity uses
``max_by`` (partial aggregation, safe for hot entities); sequential facts
("the status just before this patch") use ``sequence.carry_forward``.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.functions.scalars import stable_id, ts_literal
from nightjar.operators.sequence import carry_forward_many

# Defaults applied on create (M-1), per entity.
CREATE_DEFAULTS = {
    "alerts": {"status": "open"},
    "incidents": {"status": "open"},
    "vulnerabilities": {"status": "open"},
    "iocs": {"severity": "medium"},
    "assets": {"criticality": "medium"},
}


def _as_of(as_of) -> Column:
    return ts_literal(as_of if not isinstance(as_of, str) else dt.datetime.fromisoformat(as_of))


# Target name of an entity in audit actions and notifications.
SINGULAR = {"alerts": "alert", "incidents": "incident", "vulnerabilities": "vulnerability", "iocs": "ioc",
            "assets": "asset", "users": "user", "ingestion_sources": "ingestion_source",
            "threat_actors": "threat_actor", "mitre_techniques": "mitre_technique"}


# --------------------------------------------------------------------------
# J-8 / J-9 / J-11
# --------------------------------------------------------------------------
def semi_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id", ids_col: str = "id") -> DataFrame:
    """J-8: rows whose id is in a list (a left semi join; the list is a frame)."""
    return df.join(ids.select(F.col(ids_col).alias(id_col)), id_col, "left_semi")


def reject_existing(incoming: DataFrame, existing: DataFrame, keys: Sequence[str],
                    order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """J-9: (new, conflicts).  The first request per key of the batch (by
    ``order_col``, else by a hash of the row) is new unless the key exists
    already; every other row of the batch is a conflict, never an upsert."""
    # rows that agree in everything are numbered by place, so that one of them is first
    place = F.struct(*([F.col(order_col)] if order_col else []), F.xxhash64(*[F.col(c) for c in incoming.columns]))
    tagged = incoming.withColumn("_place", place)
    # one row per key (combined map-side), so a key with many requests is no task's own
    first = tagged.groupBy(*keys).agg(F.min("_place").alias("_first"))
    fresh = (first.join(existing.select(*keys).distinct(), list(keys), "left_anti")
             .select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first"))
    same = functools.reduce(Column.__and__, [tagged[k].eqNullSafe(fresh[f"_k_{k}"]) for k in keys])
    joined = tagged.join(fresh, same & (tagged["_place"] == fresh["_first"]), "left")
    copies = F.row_number().over(Window.partitionBy("_first", *keys).orderBy(F.lit(0)))
    firsts = joined.where(F.col("_first").isNotNull()).withColumn("_nth", copies)
    late = joined.where(F.col("_first").isNull())
    return (firsts.where("_nth = 1").select(*incoming.columns),
            firsts.where("_nth > 1").select(*incoming.columns).unionByName(late.select(*incoming.columns)))


def fit(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the columns of a table; null where they have none."""
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in table.schema.fields])


def append_rows(snapshot: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot followed by new rows, whatever columns either has: a
    column that one side lacks is null there, and one whose types differ (ids
    that are numbers in an old table) becomes text."""
    old, new = dict(snapshot.dtypes), dict(rows.dtypes)
    mixed = [c for c in old if c in new and old[c] != new[c]]
    text = {c: F.col(c).cast("string") for c in mixed}
    return (snapshot.withColumns(text) if text else snapshot).unionByName(
        rows.withColumns(text) if text else rows, allowMissingColumns=True)


def dedupe(df: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """SET-2: one row per key — unique (type, value) indicators, e-mails,
    actor names.  With ``order_col`` the first row by that order is kept
    (deterministic, combined map-side); without it any one row."""
    if order_col is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
            .select(*keys, "_first.*").select(*df.columns))


def referential_split(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id",
                      nullable: bool = True) -> tuple[DataFrame, DataFrame]:
    """J-11: (accepted, quarantined) — a row whose non-null foreign key has no
    parent is quarantined with a reason."""
    # the ids of the batch are reduced first, so a batch that names one source
    # in every row does not meet the registry in one task
    ids = child.where(F.col(fk).isNotNull()).select(fk).distinct()
    unknown = ids.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    missing = child.join(unknown, fk, "left_semi").withColumn("reason", F.lit(f"unknown {fk}"))
    accepted = child.join(unknown, fk, "left_anti")
    if nullable:
        return accepted, missing
    without = child.where(F.col(fk).isNull()).withColumn("reason", F.lit(f"no {fk}"))
    return accepted.where(F.col(fk).isNotNull()), missing.unionByName(without)


# --------------------------------------------------------------------------
# F-11: validation
# --------------------------------------------------------------------------
ENTITY_RULES = {
    "alerts": {"enums": {"severity": schemas.SEVERITIES, "status": schemas.ALERT_STATUSES},
               "lengths": {"title": (1, schemas.TITLE_MAX), "description": (0, schemas.DESCRIPTION_MAX)},
               "required": ["title", "severity"]},
    "incidents": {"enums": {"severity": schemas.SEVERITIES, "status": schemas.INCIDENT_STATUSES},
                  "lengths": {"title": (1, schemas.TITLE_MAX), "description": (0, schemas.DESCRIPTION_MAX)},
                  "required": ["title", "severity"]},
    "vulnerabilities": {"enums": {"severity": schemas.SEVERITIES, "status": schemas.VULN_STATUSES},
                        "lengths": {"title": (1, schemas.TITLE_MAX), "description": (0, schemas.DESCRIPTION_MAX)},
                        "required": ["title", "severity"]},
    "iocs": {"enums": {"type": schemas.IOC_TYPES, "severity": schemas.SEVERITIES},
             "lengths": {"value": (1, schemas.IOC_VALUE_MAX), "description": (0, schemas.DESCRIPTION_MAX)},
             "required": ["type", "value"]},
    "notes": {"enums": {}, "lengths": {"message": (1, schemas.NOTE_MAX)}, "required": ["message"]},
    "assets": {"enums": {"type": schemas.ASSET_TYPES, "criticality": schemas.SEVERITIES},
               "lengths": {"name": (1, schemas.TITLE_MAX)}, "required": ["name", "type"]},
}


def validation_reasons(df: DataFrame, entity: str) -> Column:
    """Array of reasons a row breaks its entity's rules (empty = valid)."""
    rules = ENTITY_RULES[entity]
    checks = []
    for c in rules.get("required", []):
        if c in df.columns:
            checks.append(F.when(F.col(c).isNull(), F.lit(f"{c}: required")))
    for c, dom in rules.get("enums", {}).items():
        if c in df.columns:
            checks.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*dom), F.lit(f"{c}: invalid value")))
    for c, (lo, hi) in rules.get("lengths", {}).items():
        if c in df.columns:
            n = F.char_length(F.col(c))
            checks.append(F.when(n < lo, F.lit(f"{c}: too short")))
            checks.append(F.when(n > hi, F.lit(f"{c}: too long")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """F-11: (valid, rejected) where rejected carries ``reasons``."""
    tagged = df.withColumn("reasons", validation_reasons(df, entity))
    return (tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0))


# --------------------------------------------------------------------------
# M-1: creates with defaults
# --------------------------------------------------------------------------
def apply_creates(creates: DataFrame, entity: str, as_of, snapshot: DataFrame | None = None) -> DataFrame:
    """M-1: fill defaults (status/severity/criticality, tags ``[]``, times =
    ``as_of``) and append to the snapshot when given."""
    out = creates
    for c, v in CREATE_DEFAULTS.get(entity, {}).items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
        else:
            out = out.withColumn(c, F.lit(v))
    if entity == "vulnerabilities":
        out = out.withColumn("discovered_at", F.coalesce(F.col("discovered_at"), _as_of(as_of))
                             if "discovered_at" in out.columns else _as_of(as_of))
    if entity == "assets":
        out = out.withColumn("tags", F.coalesce(F.col("tags"), F.array().cast("array<string>"))
                             if "tags" in out.columns else F.array().cast("array<string>"))
    for c in ("created_at", "updated_at"):
        out = out.withColumn(c, F.coalesce(F.col(c), _as_of(as_of)) if c in out.columns else _as_of(as_of))
    if snapshot is None:
        return out
    return snapshot.unionByName(fit(out, snapshot))


def create_entities(creates: DataFrame, entity: str, as_of) -> dict[str, DataFrame]:
    """M-1 for assets / vulnerabilities / indicators: reject invalid rows
    (F-11), fill defaults, derive a deterministic id from ``request_id`` when
    no id is given, and write a ``<entity>.created`` audit row."""
    valid, rejected = validate(creates, entity)
    rows = apply_creates(valid, entity, as_of)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", stable_id(F.lit(entity), F.col("request_id")))
    audit = derive_audit(rows.withColumn("change_id", F.col("id")).withColumn("ts", F.col("created_at")),
                         SINGULAR[entity], "created", target_col="id")
    return {"rows": rows, "audit": audit, "rejected": rejected}


def delete_rows(table: DataFrame, deleted: DataFrame, entity: str, as_of) -> dict[str, DataFrame]:
    """M-8 for tables nothing references (vulnerabilities, indicators):
    the rows go, with a ``<entity>.deleted`` audit row each."""
    return {"table": table.join(deleted.select("id"), "id", "left_anti"),
            "audit": deletion_audit(deleted.join(table.select("id"), "id", "left_semi"), entity, as_of)}


# --------------------------------------------------------------------------
# M-2: generic tri-state patches
# --------------------------------------------------------------------------
def fold_patches(changes: DataFrame, fields: Mapping[str, Column], key: str = "entity_id", ts_col: str = "ts",
                 tie_col: str = "change_id", extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """Per entity and field: was it touched, and its newest value (which may
    be a deliberate null).  ``fields`` maps field → its *present* predicate;
    ``extra_aggs`` ride along in the same aggregation (one shuffle)."""
    aggs = [F.max(ts_col).alias("_last_ts"), *extra_aggs]
    for f, present in fields.items():
        order = F.when(present, F.struct(F.col(ts_col), F.col(tie_col)))
        aggs.append(F.max(present.cast("int")).alias(f"_{f}_touched"))
        aggs.append(F.max_by(F.col(f), order).alias(f"_{f}_new"))
    return changes.groupBy(key).agg(*aggs)


def apply_patches(snapshot: DataFrame, changes: DataFrame, fields: Mapping[str, Column], key: str = "entity_id",
                  id_col: str = "id", ts_col: str = "ts", tie_col: str = "change_id",
                  touch_col: str | None = "updated_at",
                  set_once: Mapping[str, Column] | None = None) -> dict[str, DataFrame]:
    """M-2: last value per field wins; unknown ids are reported, not created.

    ``set_once`` (W-2) maps a timestamp column to the predicate of the
    patches that set it: it takes the time of the first such patch unless it
    already has a value, and never moves afterwards."""
    set_once = dict(set_once or {})
    extra = [F.min(F.when(cond, F.col(ts_col))).alias(f"_{c}_first") for c, cond in set_once.items()]
    folded = fold_patches(changes, fields, key, ts_col, tie_col, extra).withColumnRenamed(key, id_col)
    j = snapshot.join(folded, id_col, "left")
    cols = []
    for c in snapshot.columns:
        if c in fields:
            cols.append(F.when(F.col(f"_{c}_touched") == 1, F.col(f"_{c}_new")).otherwise(F.col(c)).alias(c))
        elif c in set_once:
            cols.append(F.coalesce(F.col(c), F.col(f"_{c}_first")).alias(c))
        elif c == touch_col:
            cols.append(F.greatest(F.col(c), F.col("_last_ts")).alias(c))
        else:
            cols.append(F.col(c))
    unknown = changes.join(snapshot.select(F.col(id_col).alias(key)), key, "left_anti")
    return {"snapshot": j.select(*cols), "unknown": unknown}


# --------------------------------------------------------------------------
# M-5 / M-11 / M-10 / W-2 / W-3: incidents
# --------------------------------------------------------------------------
# Patchable fields per entity (tri-state: a ``<field>_set`` flag column in the
# change log marks presence; without it a non-null value means "set").
PATCHABLE = {
    "incidents": ["title", "description", "severity", "status", "assigned_to_id"],
    "alerts": ["title", "description", "severity", "status", "assigned_to_id", "incident_id"],
    "vulnerabilities": ["title", "description", "cve_id", "severity", "status", "asset_id"],
    "iocs": ["type", "value", "severity", "description", "source", "threat_actor_id"],
    "assets": ["name", "type", "ip_address", "hostname", "criticality", "owner", "tags"],
}


def present(changes: DataFrame, field: str) -> Column:
    """Whether a patch carries ``field``: its ``<field>_set`` flag (for
    ``x_id`` also ``x_set``) when the change log has one, so null can mean
    "clear"; else a non-null value."""
    for flag in (f"{field}_set", f"{field.removesuffix('_id')}_set"):
        if flag in changes.columns:
            return F.col(flag)
    return F.col(field).isNotNull()


def patch_fields(snapshot: DataFrame, changes: DataFrame, entity: str) -> dict[str, Column]:
    """The entity's patchable fields that the change log carries.  A patch of
    a field that the snapshot has no column for is an error, not ignored."""
    lost = [f for f in PATCHABLE[entity] if f in changes.columns and f not in snapshot.columns]
    if lost:
        raise ValueError(f"{entity} has no column for patched field(s) {', '.join(lost)}")
    return {f: present(changes, f) for f in PATCHABLE[entity] if f in changes.columns and f in snapshot.columns}


def _patch_with_history(snapshot: DataFrame, changes: DataFrame, entity: str, kind: str,
                        set_once: Mapping[str, Column] | None, bucket_unit: str) -> dict[str, DataFrame]:
    """Shared M-2/M-10/M-11 core: new snapshot, unknown ids, the per-patch
    before/after sequence of status, assignee and title, the assignment
    notifications and the audit rows of the known patches."""
    if "author_id" not in changes.columns:
        changes = changes.withColumn("author_id", F.lit(None).cast("long"))
    fields = patch_fields(snapshot, changes, entity)
    res = apply_patches(snapshot, changes, fields, set_once=set_once)
    known = changes.join(snapshot.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    tracked = [f for f in ("status", "assigned_to_id", "title") if f in snapshot.columns]
    carried = [f for f in tracked if f in fields]
    seq = carry_forward_many(known, "entity_id", "ts", "change_id",
                             [(f, fields[f], f, f"{f}_before", f"{f}_after") for f in carried],
                             seed=snapshot.select(F.col("id").alias("entity_id"), *carried),
                             bucket_unit=bucket_unit) if carried else known
    fixed = [f for f in tracked if f not in fields]
    if fixed:
        # fields no patch can change keep their snapshot value before and after
        snap_vals = snapshot.select(F.col("id").alias("entity_id"),
                                    *[F.col(f).alias(f"{f}_{w}") for f in fixed for w in ("before", "after")])
        seq = seq.join(snap_vals, "entity_id", "left")
    notify = None
    if "assigned_to_id" in fields:
        a_set = fields["assigned_to_id"]
        notify = (seq.where(a_set & F.col("assigned_to_id").isNotNull()
                            & (F.col("assigned_to_id_before").isNull()
                               | (F.col("assigned_to_id") != F.col("assigned_to_id_before"))))
                  .select(stable_id(F.lit("notification"), F.col("change_id")).alias("id"),
                          F.col("assigned_to_id").alias("user_id"), F.lit(SINGULAR[entity]).alias("type"),
                          F.lit(f"{kind} assigned to you").alias("title"), F.col("title_after").alias("message"),
                          F.lit(None).cast("timestamp_ntz").alias("read_at"), F.col("ts").alias("created_at"),
                          "change_id"))
    audit = derive_audit(seq.withColumn("_meta", F.to_json(F.struct(F.col("status_after").alias("status")))),
                         SINGULAR[entity], "updated", target_col="entity_id", metadata_col="_meta")
    return {"snapshot": res["snapshot"], "unknown": res["unknown"], "sequence": seq,
            "notifications": notify, "audit": audit}


def patch_incidents(incidents: DataFrame, changes: DataFrame, bucket_unit: str = "hour") -> dict[str, DataFrame]:
    """M-5: incident patches.  ``changes``: change_id, entity_id, ts, any of
    title / description / severity / status / assigned_to_id (null or a
    ``<field>_set`` flag marks absence), [author_id].

    * closed_at is set once, at the first patch to resolved/closed (W-2), and
      never cleared on reopen;
    * a patch that really changes the status adds a timeline row "Status
      changed from A to B" (W-3: the status just before the patch);
    * assigning someone other than the current assignee notifies them, with
      the incident title after the patch as message (M-11);
    * every patch of a known incident writes an audit row with the status
      after it (M-10)."""
    out = _patch_with_history(incidents, changes, "incidents", "Incident",
                              {"closed_at": F.col("status").isin(*schemas.CLOSED_INCIDENT_STATUSES)}
                              if "status" in changes.columns else None, bucket_unit)
    seq = out["sequence"]
    if "status" not in changes.columns:  # no status patches: no status_change rows
        out["timeline"] = None
        return out
    timeline = seq.where(F.col("status").isNotNull() & (F.col("status") != F.col("status_before"))).select(
        stable_id(F.lit("timeline"), F.col("change_id")).alias("id"),
        F.col("entity_id").alias("incident_id"), "author_id", F.lit("status_change").alias("event_type"),
        F.concat(F.lit("Status changed from "), F.col("status_before"), F.lit(" to "), F.col("status"))
        .alias("message"),
        F.col("ts").alias("created_at"), "change_id")
    out["timeline"] = timeline
    return out


def patch_alerts(alerts: DataFrame, changes: DataFrame, bucket_unit: str = "hour") -> dict[str, DataFrame]:
    """M-2 for alerts (title, description, severity, status, assignee,
    incident link; technique lists go through ``replace_mappings``): new
    snapshot, unknown ids, "Alert assigned to you" notifications (M-11) and
    ``alert.updated`` audit rows with the status after each patch (M-10)."""
    return _patch_with_history(alerts, changes, "alerts", "Alert", None, bucket_unit)


# --------------------------------------------------------------------------
# M-6: vulnerabilities
# --------------------------------------------------------------------------
def patch_vulnerabilities(vulnerabilities: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """M-6: status patches; remediated_at is set once at the first patch to
    ``remediated`` (W-2) and kept after."""
    out = apply_patches(vulnerabilities, changes, patch_fields(vulnerabilities, changes, "vulnerabilities"),
                        touch_col="updated_at", set_once={"remediated_at": F.col("status") == "remediated"})
    return out | {"audit": update_audit(vulnerabilities, changes, "vulnerabilities")}


def update_audit(snapshot: DataFrame, changes: DataFrame, entity: str) -> DataFrame:
    """M-10 for plain patches: one ``<entity>.updated`` row per patch of a
    known row, with the patch's status as metadata where it has one."""
    known = changes.join(snapshot.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    if "status" in known.columns:
        known = known.withColumn("_meta", F.to_json(F.struct("status")))
    return derive_audit(known, SINGULAR[entity], "updated", metadata_col="_meta")


def patch_assets(assets: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """M-2 for assets, with ``asset.updated`` audit rows."""
    out = apply_patches(assets, changes, patch_fields(assets, changes, "assets"))
    return out | {"audit": update_audit(assets, changes, "assets")}


# --------------------------------------------------------------------------
# M-7: indicators
# --------------------------------------------------------------------------
def merge_iocs(iocs: DataFrame, incoming: DataFrame, as_of) -> dict[str, DataFrame]:
    """M-7 (create): new (type, value) pairs are inserted with defaults;
    pairs already tracked — or repeated in the batch — go to conflicts."""
    order = "incoming_id" if "incoming_id" in incoming.columns else None
    new, conflicts = reject_existing(incoming, iocs, ["type", "value"], order)
    ts = _as_of(as_of)
    inserted = apply_creates(new, "iocs", as_of)
    for c in ("first_seen_at", "last_seen_at"):
        inserted = inserted.withColumn(c, F.coalesce(F.col(c), ts) if c in inserted.columns else ts)
    if "id" not in inserted.columns:
        inserted = inserted.withColumn("id", F.concat(F.col("type"), F.lit(":"), F.col("value")))
    if "threat_actor_id" not in inserted.columns:
        inserted = inserted.withColumn("threat_actor_id", F.lit(None).cast("string"))
    audit = derive_audit(inserted.withColumn("change_id", F.col("id")).withColumn("ts", F.col("created_at")),
                         "ioc", "created", target_col="id")
    inserted = fit(inserted, iocs)
    return {"inserted": inserted, "conflicts": conflicts, "audit": audit, "snapshot": iocs.unionByName(inserted)}


def patch_iocs(iocs: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """M-7 (update): any patch bumps last_seen_at to the patch time; the
    severity field is tri-state."""
    out = apply_patches(iocs, changes, patch_fields(iocs, changes, "iocs"), touch_col="last_seen_at")
    return out | {"audit": update_audit(iocs, changes, "iocs")}


# --------------------------------------------------------------------------
# M-3 / M-4: mappings and opening incidents
# --------------------------------------------------------------------------
def replace_mappings(mappings: DataFrame, patches: DataFrame) -> DataFrame:
    """M-3: the newest technique list given for an alert replaces all of its
    mappings (``[]`` clears); alerts without a list keep theirs."""
    latest = (patches.where(F.col("mitre_technique_ids").isNotNull())
              .groupBy(F.col("entity_id").alias("alert_id"))
              .agg(F.max_by("mitre_technique_ids", F.struct("ts", "change_id")).alias("_ids")))
    kept = mappings.join(latest.select("alert_id"), "alert_id", "left_anti")
    new = latest.select("alert_id", F.explode(F.array_distinct("_ids")).alias("mitre_technique_id"))
    return kept.unionByName(new)


def open_incidents(incidents: DataFrame, alerts: DataFrame, timeline: DataFrame, requests: DataFrame,
                   as_of) -> dict[str, DataFrame]:
    """M-4: each request opens an incident (defaults applied), seeds a
    timeline note "Incident opened" and links its listed alerts (unknown
    alert ids are ignored; an alert listed twice goes to the newest request).
    ``requests``: request_id, title, [description], severity, status,
    assigned_to_id, author_id, alert_ids, ts."""
    ts = F.coalesce(F.col("ts"), _as_of(as_of)) if "ts" in requests.columns else _as_of(as_of)
    req = requests.withColumn("_id", stable_id(F.lit("incident"), F.col("request_id"))).withColumn("_ts", ts)
    created = apply_creates(
        req.select(F.col("_id").alias("id"), "title",
                   (F.col("description") if "description" in req.columns else F.lit(None).cast("string"))
                   .alias("description"), "severity",
                   (F.col("status") if "status" in req.columns else F.lit(None).cast("string")).alias("status"),
                   "assigned_to_id", F.col("_ts").alias("created_at"), F.col("_ts").alias("updated_at")),
        "incidents", as_of).withColumn("closed_at", F.lit(None).cast("timestamp_ntz"))
    notes = req.select(stable_id(F.lit("opened"), F.col("request_id")).alias("id"), F.col("_id").alias("incident_id"),
                       "author_id", F.lit("note").alias("event_type"), F.lit("Incident opened").alias("message"),
                       F.col("_ts").alias("created_at"))
    links = (req.select(F.col("_id").alias("_incident"), "_ts", "request_id", F.explode("alert_ids").alias("id"))
             .groupBy("id").agg(F.max_by("_incident", F.struct("_ts", "request_id")).alias("_incident")))
    links = semi_by_ids(links, alerts)
    linked = alerts.join(links, "id", "left").withColumn(
        "incident_id", F.coalesce(F.col("_incident"), F.col("incident_id").cast("string"))).drop("_incident")
    audit = derive_audit(
        req.withColumn("change_id", F.col("request_id"))
        .withColumn("_meta", F.to_json(F.struct(F.coalesce("severity", F.lit("medium")).alias("severity"))))
        .withColumn("ts", F.col("_ts")),
        "incident", "created", target_col="_id", metadata_col="_meta")
    from nightjar.sinks.ingest import realtime_feed
    return {"incidents": append_rows(incidents, created), "created": created, "timeline": append_rows(timeline, notes),
            "notes": notes, "alerts": linked, "links": links, "audit": audit,
            "feed": realtime_feed(created, "incident.created")}


def create_alerts(creates: DataFrame, as_of) -> dict[str, DataFrame]:
    """M-1 for alerts (the create path): invalid requests are rejected with
    reasons (F-11); valid ones get defaults and a deterministic id, one
    mapping row per listed technique, an ``alert.created`` audit row with the
    severity and a realtime ``alert.created`` message.
    ``creates``: request_id, title, severity, [description, source_ip,
    asset_id, mitre_technique_ids, author_id, ts]."""
    from nightjar.sinks.ingest import realtime_feed
    valid, rejected = validate(creates, "alerts")
    ts = F.coalesce(F.col("ts"), _as_of(as_of)) if "ts" in valid.columns else _as_of(as_of)
    opt = {c: (F.col(c) if c in valid.columns else F.lit(None).cast(t)) for c, t in
           (("description", "string"), ("source_ip", "string"), ("asset_id", "long"), ("author_id", "long"),
            ("mitre_technique_ids", "array<string>"))}
    base = valid.select(
        stable_id(F.lit("alert"), F.lit("create"), F.col("request_id")).alias("id"), "title",
        opt["description"].alias("description"), "severity", F.lit(None).cast("string").alias("status"),
        opt["source_ip"].alias("source_ip"), opt["asset_id"].alias("asset_id"),
        F.lit(None).cast("long").alias("ingestion_source_id"), F.lit(None).cast("long").alias("assigned_to_id"),
        F.lit(None).cast("long").alias("incident_id"), ts.alias("created_at"), ts.alias("updated_at"),
        opt["author_id"].alias("author_id"), "request_id",
        F.coalesce(opt["mitre_technique_ids"], F.array().cast("array<string>")).alias("mitre_technique_ids"))
    alerts = apply_creates(base, "alerts", as_of)
    mappings = alerts.select(F.col("id").alias("alert_id"),
                             F.explode(F.array_distinct("mitre_technique_ids")).alias("mitre_technique_id"))
    audit = derive_audit(alerts.withColumn("change_id", F.col("request_id")).withColumn("ts", F.col("created_at"))
                         .withColumn("_meta", F.to_json(F.struct(F.col("severity")))),
                         "alert", "created", target_col="id", metadata_col="_meta")
    out = alerts.drop("author_id", "request_id")
    feed = realtime_feed(out.withColumn("mitre_technique_ids", F.array_sort(F.array_distinct("mitre_technique_ids"))),
                         "alert.created")
    return {"alerts": out.drop("mitre_technique_ids"), "alert_mitre_mappings": mappings, "audit": audit,
            "feed": feed, "rejected": rejected}


# --------------------------------------------------------------------------
# M-8: deletes with propagation
# --------------------------------------------------------------------------
def cascade_delete(child: DataFrame, fk: str, deleted: DataFrame, deleted_col: str = "id") -> DataFrame:
    """M-8 CASCADE: drop child rows of deleted parents."""
    return child.join(deleted.select(F.col(deleted_col).alias(fk)), fk, "left_anti")


def set_null_on_delete(child: DataFrame, fk: str, deleted: DataFrame, deleted_col: str = "id") -> DataFrame:
    """M-8 SET NULL: clear references to deleted parents."""
    # rows without a reference (often most of them) never enter the join, so
    # the null key is not one hot partition
    d = deleted.select(F.col(deleted_col).alias(fk)).distinct().withColumn("_gone", F.lit(True))
    j = child.where(F.col(fk).isNotNull()).join(d, fk, "left")
    loose = child.where(F.col(fk).isNull())
    return loose.unionByName(j.select(*[F.when(F.col("_gone"), F.lit(None).cast(child.schema[fk].dataType)).otherwise(F.col(fk))
                      .alias(fk) if c == fk else F.col(c) for c in child.columns]))


def deletion_audit(deleted: DataFrame, entity: str, as_of) -> DataFrame:
    """M-10 for deletes: one ``<entity>.deleted`` row per deleted id, no
    metadata; ``deleted`` may carry ``ts`` and ``author_id``."""
    d = deleted.withColumn("change_id", F.col("id")).withColumn("entity_id", F.col("id"))
    if "ts" not in d.columns:
        d = d.withColumn("ts", _as_of(as_of))
    return derive_audit(d, entity, "deleted")


def delete_entities(tables: Mapping[str, DataFrame], entity: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """M-8 for any entity: the rows go, and every foreign key that points at
    them is walked in the catalogue's order (``schemas.FOREIGN_KEYS``): its
    children go too, with what points at *them*, or lose the reference.
    ``tables`` holds the tables to change; one that is absent is left alone.
    Returns the tables that change, new."""
    out = dict(tables)
    if entity in out:
        out[entity] = out[entity].join(deleted.select("id"), "id", "left_anti")
    touched, queue = {entity}, [(entity, deleted.select("id"))]
    while queue:
        parent, gone = queue.pop(0)
        for child, column, target, action in schemas.FOREIGN_KEYS:
            if target != parent or child not in out:
                continue
            touched.add(child)
            if action == "set null":
                out[child] = set_null_on_delete(out[child], column, gone)
                continue
            if any(t == child for _, _, t, _ in schemas.FOREIGN_KEYS):
                queue.append((child, out[child].join(gone.select(F.col("id").alias(column)), column, "left_semi")
                              .select("id")))
            out[child] = cascade_delete(out[child], column, gone)
    return {t: out[t] for t in out if t in touched}


def delete_alerts(alerts: DataFrame, mappings: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """M-8 for alerts: rows removed, their mappings cascade."""
    return delete_entities({"alerts": alerts, "alert_mitre_mappings": mappings}, "alerts", deleted)


def delete_incidents(incidents: DataFrame, alerts: DataFrame, timeline: DataFrame,
                     deleted: DataFrame) -> dict[str, DataFrame]:
    """M-8 for incidents: timeline cascades, alerts lose the link."""
    return delete_entities({"incidents": incidents, "incident_timeline_events": timeline, "alerts": alerts},
                           "incidents", deleted)


def delete_assets(assets: DataFrame, alerts: DataFrame, vulnerabilities: DataFrame,
                  deleted: DataFrame) -> dict[str, DataFrame]:
    """M-8 for assets: alerts and vulnerabilities lose the link."""
    return delete_entities({"assets": assets, "alerts": alerts, "vulnerabilities": vulnerabilities}, "assets", deleted)


def delete_users(users: DataFrame, alerts: DataFrame, incidents: DataFrame, notifications: DataFrame,
                 audit_logs: DataFrame, deleted: DataFrame, timeline: DataFrame | None = None
                 ) -> dict[str, DataFrame]:
    """M-8 for users: notifications cascade; assignees, audit actors and (when
    given) timeline authors are cleared."""
    tables = {"users": users, "notifications": notifications, "alerts": alerts, "incidents": incidents,
              "audit_logs": audit_logs}
    return delete_entities(tables if timeline is None else tables | {"incident_timeline_events": timeline}, "users",
                           deleted)


def delete_threat_actors(threat_actors: DataFrame, iocs: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """M-8 for threat actors: indicators lose the actor."""
    return delete_entities({"threat_actors": threat_actors, "iocs": iocs}, "threat_actors", deleted)


def delete_techniques(techniques: DataFrame, mappings: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """M-8 for techniques: alert mappings cascade."""
    return delete_entities({"mitre_techniques": techniques, "alert_mitre_mappings": mappings}, "mitre_techniques",
                           deleted)


def delete_sources(sources: DataFrame, raw_events: DataFrame, alerts: DataFrame,
                   deleted: DataFrame) -> dict[str, DataFrame]:
    """M-8 for ingestion sources: raw events cascade, alerts lose the source."""
    return delete_entities({"ingestion_sources": sources, "raw_events": raw_events, "alerts": alerts},
                           "ingestion_sources", deleted)


# --------------------------------------------------------------------------
# M-9 / M-10 / M-12 / M-13
# --------------------------------------------------------------------------
def mark_read(notifications: DataFrame, user_id, ids: DataFrame | None, as_of) -> DataFrame:
    """M-9: ``read_at = existing or as_of`` for the user's own listed rows;
    ``ids=None`` marks all of the user's unread rows (read-all)."""
    own = F.col("user_id") == F.lit(user_id)
    if ids is None:
        hit = own
        j = notifications
    else:
        j = notifications.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
        hit = own & F.coalesce(F.col("_hit"), F.lit(False))
    out = j.withColumn("read_at", F.when(hit & F.col("read_at").isNull(), _as_of(as_of)).otherwise(F.col("read_at")))
    return out.select(*notifications.columns)


def derive_audit(changes: DataFrame, entity: str, verb: str, target_col: str = "entity_id",
                 actor_col: str = "author_id", metadata_col: str | None = None,
                 ip_col: str | None = None) -> DataFrame:
    """M-10: one audit row per change: action ``<entity>.<verb>``, target
    type/id, optional actor, ip and metadata JSON (absent fields stay null)."""
    def opt(c, typ):
        return F.col(c) if c and c in changes.columns else F.lit(None).cast(typ)
    action = F.concat(F.lit(f"{entity}."), F.lit(verb)) if isinstance(verb, str) else verb
    return changes.select(
        stable_id(F.lit("audit"), F.lit(entity), F.col("change_id")).alias("id"),
        opt(actor_col, "long").alias("actor_id"),
        action.alias("action"),
        F.lit(entity).alias("target_type"),
        F.col(target_col).cast("string").alias("target_id"),
        opt(ip_col, "string").alias("ip_address"),
        opt(metadata_col, "string").alias("metadata"),
        F.col("ts").alias("created_at"),
    )


def toggle_sources(sources: DataFrame, toggles: DataFrame) -> dict[str, DataFrame]:
    """M-12: set ``is_active``; unknown ids reported; audit action
    ``ingestion_source.enabled|disabled`` with the source type."""
    res = apply_patches(sources, toggles, {"is_active": F.lit(True)}, touch_col=None)
    known = toggles.join(sources.select(F.col("id").alias("entity_id"), F.col("type").alias("_type")),
                         "entity_id", "inner")
    verb = F.when(F.col("is_active"), F.lit("ingestion_source.enabled")).otherwise(F.lit("ingestion_source.disabled"))
    audit = known.withColumn("_meta", F.to_json(F.struct(F.col("_type").alias("type")))).select(
        stable_id(F.lit("audit"), F.lit("ingestion_source"), F.col("change_id")).alias("id"),
        (F.col("author_id") if "author_id" in known.columns else F.lit(None).cast("long")).alias("actor_id"),
        verb.alias("action"), F.lit("ingestion_source").alias("target_type"),
        F.col("entity_id").cast("string").alias("target_id"), F.lit(None).cast("string").alias("ip_address"),
        F.col("_meta").alias("metadata"), F.col("ts").alias("created_at"))
    return {"snapshot": res["snapshot"], "unknown": res["unknown"], "audit": audit}


def append_timeline_notes(timeline: DataFrame, incidents: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """M-13: notes for existing incidents become timeline rows (type note);
    notes for unknown incidents are returned as rejected."""
    ok = semi_by_ids(notes, incidents, "incident_id")
    rows = ok.select(stable_id(F.lit("note"), F.col("note_id")).alias("id"), "incident_id", "author_id",
                     F.lit("note").alias("event_type"), F.col("message"), F.col("ts").alias("created_at"))
    rejected = notes.join(incidents.select(F.col("id").alias("incident_id")), "incident_id", "left_anti")
    return {"timeline": timeline.unionByName(rows.select(*timeline.columns)), "added": rows, "rejected": rejected}
