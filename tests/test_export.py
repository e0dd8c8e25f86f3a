"""SNK-1 / SNK-2 export, SNK-5 feed (reference export cases)."""

import glob
import json
import os

from helpers import mk
from nightjar.sinks.export import csv_text, export_csv, export_json
from nightjar.sinks.ingest import realtime_feed


def read_parts(path, ext):
    out = []
    for p in sorted(glob.glob(os.path.join(path, f"part-*{ext}"))):
        with open(p, newline="") as f:
            out.append(f.read())
    return out


def alerts(spark):
    return mk(spark, "alerts", [
        dict(id=1, title='Say "hi", now', description=None, severity="high", status="open",
             created_at="2024-01-01 00:00:00.123456", updated_at="2024-01-01 00:00:00"),
        dict(id=2, title="  plain  ", description="line1\nline2", severity="low", status="open",
             created_at="2024-01-02 00:00:00", updated_at="2024-01-02 00:00:00")])


def test_csv_escaping_and_order(spark, scratch):
    out = os.path.join(scratch, "csv")
    export_csv(alerts(spark).coalesce(1), out)
    (text,) = read_parts(out, ".csv")
    lines = text.split("\n")
    assert lines[0].startswith("id,title,description,severity")
    assert lines[1].startswith('2,  plain  ,"line1') and '""' not in lines[1]
    assert '"Say ""hi"", now"' in text
    assert "2024-01-01T00:00:00.123Z" in text
    assert ",high,open," in text and "1,\"Say" in text


def test_csv_empty_writes_no_part(spark, scratch):
    out = os.path.join(scratch, "empty")
    export_csv(alerts(spark).limit(0), out)
    assert read_parts(out, ".csv") == []


def test_csv_text_rule(spark):
    df = spark.createDataFrame([("a,b", 'q"', None)], "x string, y string, z string")
    assert csv_text(df).first().line == '"a,b","q""",'


def test_json_keeps_nulls(spark, scratch):
    out = os.path.join(scratch, "json")
    export_json(alerts(spark).coalesce(1), out)
    (text,) = read_parts(out, ".json")
    first = json.loads(text.splitlines()[0])
    assert first["id"] == 2 and "asset_id" in first and first["asset_id"] is None


def test_tags_joined(spark, scratch):
    a = mk(spark, "assets", [dict(id=1, name="h", type="server", criticality="low", tags=["a", "b"],
                                  created_at="2024-01-01 00:00:00", updated_at="2024-01-01 00:00:00")])
    out = os.path.join(scratch, "assets")
    export_csv(a.coalesce(1), out)
    (text,) = read_parts(out, ".csv")
    assert '"a,b"' in text


def test_realtime_feed_shape(spark):
    msg = json.loads(realtime_feed(alerts(spark).limit(1), "alert.created").first().message)
    assert msg["type"] == "alert.created" and msg["data"]["created_at"].endswith("Z")
    assert "asset_id" in msg["data"]


def test_export_report_dispatch(spark, scratch):
    import pytest

    from nightjar.sinks.export import export_report
    a = alerts(spark).withColumn("mitre_technique_ids", __import__("pyspark.sql.functions", fromlist=["array"])
                                 .array().cast("array<string>"))
    out = os.path.join(scratch, "rep")
    export_report({"alerts": a.coalesce(1)}, "alerts", "json", out)
    (text,) = read_parts(out, ".json")
    assert "mitre_technique_ids" not in text
    with pytest.raises(ValueError):
        export_report({"users": a}, "users", "csv", out)
