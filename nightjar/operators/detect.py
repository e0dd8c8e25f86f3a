"""Detection rules (DET-1..DET-5).

Rules are data: an ordered list of ``Rule`` values compiled into one
``CASE WHEN … END`` struct expression, evaluated first-match-wins over the
JSON text of the payload.  The expression is native (regex inside whole-stage
codegen); users extend detection by passing a longer list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.functions.scalars import ColumnOrName, _col, from_suffix, keep_rows, stable_id

DETECTION_TYPE = "struct<title:string,description:string,severity:string,mitre_technique_ids:array<string>>"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str          # Java regex, matched case-insensitively anywhere in the text
    title: str
    description: str      # text before the optional " from <ip>" and the final "."
    severity: str
    techniques: tuple[str, ...]


# The three built-in rules, in evaluation order
# (DET-2 failed authentication, DET-3 sudo, DET-4 malware).
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("failed_auth", "failed password|authentication failure|invalid user",
         "Failed authentication attempt detected",
         "Ingested telemetry matched a failed-authentication pattern", "medium", ("T1110",)),
    Rule("sudo", "sudo:.*COMMAND=",
         "Privileged command execution via sudo",
         "Ingested telemetry recorded a sudo command execution", "low", ("T1548",)),
    Rule("malware", "ransomware|malware detected|trojan",
         "Malware indicator in ingested telemetry",
         "Ingested telemetry matched a known malware/ransomware keyword", "critical", ("T1486",)),
)


def rule_matches(rule: Rule, text: ColumnOrName) -> Column:
    """DET-2..4 / SC-5: case-insensitive unanchored regex test."""
    return _col(text).rlike(f"(?i){rule.pattern}")


def detection(text: ColumnOrName, source_ip: ColumnOrName, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """DET-1: struct(title, description, severity, mitre_technique_ids) of the
    first matching rule, or null."""
    out = None
    for r in rules:
        result = F.struct(
            F.lit(r.title).alias("title"),
            F.concat(F.lit(r.description), from_suffix(source_ip), F.lit(".")).alias("description"),
            F.lit(r.severity).alias("severity"),
            F.array(*[F.lit(t) for t in r.techniques]).cast("array<string>").alias("mitre_technique_ids"),
        )
        cond = rule_matches(r, text)
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out if out is not None else F.lit(None).cast(DETECTION_TYPE)


def rule_index(text: ColumnOrName, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Position of the first matching rule, or null (DET-1 first match wins)."""
    out = None
    for i, r in enumerate(rules):
        cond = rule_matches(r, text)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def detect(events: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, payload_col: str = "payload",
           ip_col: str = "source_ip") -> DataFrame:
    """Adds a nullable ``detection`` column to normalised events.  The payload
    is matched as stored JSON text (keys, quotes and escapes included).

    The regexes run once per row in their own projection (``_rule``); the
    result fields are then array lookups by rule position, which keeps the
    generated code small however long the rule list is."""
    def arr(values):
        return F.array(*[F.lit(v) for v in values])
    staged = events.withColumn("_rule", rule_index(F.col(payload_col), rules))
    idx = F.col("_rule")
    techs = F.array(*[F.array(*[F.lit(t) for t in r.techniques]).cast("array<string>") for r in rules])
    result = F.struct(
        F.get(arr([r.title for r in rules]), idx).alias("title"),
        F.concat(F.get(arr([r.description for r in rules]), idx), from_suffix(F.col(ip_col)), F.lit("."))
        .alias("description"),
        F.get(arr([r.severity for r in rules]), idx).alias("severity"),
        F.get(techs, idx).alias("mitre_technique_ids"),
    )
    return staged.withColumn("detection", F.when(idx.isNotNull(), result)).drop("_rule")


def alerts_from_detections(detected: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK-4: one detected event → one alert row and one mapping row per
    technique; also the alerts with their (sorted) technique ids (P-2 shape)
    from the same projection.  Alert ids derive from the raw event id, so a
    replayed batch produces the same ids (ST-14)."""
    hits = keep_rows(detected, F.col("detection").isNotNull())
    alert_id = stable_id(F.lit("alert"), F.col(id_col))
    serialized = hits.select(
        alert_id.alias("id"),
        F.col("detection.title").alias("title"),
        F.col("detection.description").alias("description"),
        F.col("detection.severity").alias("severity"),
        F.lit("open").alias("status"),
        F.col("source_ip"),
        F.lit(None).cast("long").alias("asset_id"),
        F.col("ingestion_source_id"),
        F.lit(None).cast("long").alias("assigned_to_id"),
        F.lit(None).cast("long").alias("incident_id"),
        F.col("received_at").alias("created_at"),
        F.col("received_at").alias("updated_at"),
        F.col(id_col).alias("raw_event_id"),
        F.array_sort(F.col("detection.mitre_technique_ids")).alias("mitre_technique_ids"),
    )
    alerts = serialized.drop("mitre_technique_ids")
    # explode over an expression (not a bare column) so no size>0 filter is
    # inferred and pushed below the detection projection
    mappings = serialized.select(F.col("id").alias("alert_id"),
                                 F.explode(F.array_compact(F.col("mitre_technique_ids")))
                                 .alias("mitre_technique_id"))
    return alerts, mappings, serialized
