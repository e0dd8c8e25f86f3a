"""Per-key sequential state without one task per key (W-2, W-3, W-4, ST-8).

``lag``/running values over ``partitionBy(key)`` put every row of a key in one
task; a hot key (a third of all rows) then becomes one giant sort.  These
helpers split the sequence by (key, time bucket):

1. a window over (key, bucket) gives the value inside the bucket;
2. one summary row per (key, bucket) (partial aggregation, map-side);
3. a window over the *summaries* of a key (one row per bucket, so bounded by
   the time span, not by the data) carries the state across buckets;
4. the carried state is joined back on (key, bucket).

Every task then holds at most one bucket of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(ts_col: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts_col))


def carry_forward(df: DataFrame, key: str, ts_col: str, tie_col: str, value_col: str, present: Column | None = None,
                  seed: DataFrame | None = None, seed_col: str | None = None, bucket_unit: str = "hour",
                  before_col: str = "before", after_col: str = "after") -> DataFrame:
    """For each row: the field's state just before it (``before``) and just
    after it (``after``).  Rows where ``present`` is true set the field (to a
    value or to null); others leave it.  ``seed`` (key, seed_col) is the state
    before the first row (the snapshot).  Nulls set on purpose are kept
    apart from "no update" by wrapping values in a struct."""
    return carry_forward_many(df, key, ts_col, tie_col,
                              [(value_col, present, seed_col, before_col, after_col)], seed, bucket_unit)


def carry_forward_many(df: DataFrame, key: str, ts_col: str, tie_col: str,
                       fields: Sequence[tuple[str, Column | None, str | None, str, str]],
                       seed: DataFrame | None = None, bucket_unit: str = "hour") -> DataFrame:
    """``carry_forward`` for several fields in one pass: one window over
    (key, bucket), one summary row per (key, bucket), one window over the
    summaries and one join back, whatever the number of fields.
    ``fields``: (value_col, present, seed_col, before_col, after_col)."""
    b = "_cf_bucket"
    rows = df.withColumn(b, _bucket(ts_col, bucket_unit))
    wb = Window.partitionBy(key, b).orderBy(ts_col, tie_col)
    upto = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    tagged, win_cols, agg_cols, carry_cols = [], [], [], []
    for i, (value_col, present, _seed_col, _b, _a) in enumerate(fields):
        p = F.lit(True) if present is None else present
        tagged.append(F.when(p, F.struct(F.col(value_col).alias("v"))).alias(f"_cf_v{i}"))
    rows = rows.select("*", *tagged)
    for i in range(len(fields)):
        v = F.col(f"_cf_v{i}")
        win_cols += [F.last(v, ignorenulls=True).over(upto).alias(f"_cf_after{i}"),
                     F.last(v, ignorenulls=True).over(before).alias(f"_cf_before{i}")]
        agg_cols.append(F.max_by(v, F.when(v.isNotNull(), F.struct(ts_col, tie_col))).alias(f"_cf_last{i}"))
    rows = rows.select("*", *win_cols)
    summary = rows.groupBy(key, b).agg(*agg_cols)
    wk = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    for i in range(len(fields)):
        carry_cols.append(F.last(f"_cf_last{i}", ignorenulls=True).over(wk).alias(f"_cf_carry{i}"))
    summary = summary.select(key, b, *carry_cols)
    if seed is not None:
        seeded = [(i, f[2]) for i, f in enumerate(fields) if f[2] is not None]
        s = seed.select(F.col(key), *[F.struct(F.col(c).alias("v")).alias(f"_cf_seed{i}") for i, c in seeded])
        summary = summary.join(s, key, "left").select(
            key, b, *[F.coalesce(f"_cf_carry{i}", f"_cf_seed{i}").alias(f"_cf_carry{i}") if f[2] is not None
                      else F.col(f"_cf_carry{i}") for i, f in enumerate(fields)])
    out = rows.join(summary, [key, b], "left")
    finals = []
    for i, (_v, _p, _s, before_col, after_col) in enumerate(fields):
        finals += [F.coalesce(f"_cf_before{i}", f"_cf_carry{i}")["v"].alias(before_col),
                   F.coalesce(f"_cf_after{i}", f"_cf_carry{i}")["v"].alias(after_col)]
    keep = [c for c in df.columns]
    return out.select(*keep, *finals)


def running_sum(df: DataFrame, key: str | Sequence[str], ts_col: str, tie_col: str, value_col: str,
                out_col: str = "running", bucket_unit: str = "hour") -> DataFrame:
    """W-4: cumulative sum per key in (ts, tie) order, computed as the running
    sum inside the (key, bucket) plus the totals of the key's earlier buckets."""
    keys = [key] if isinstance(key, str) else list(key)
    b = "_rs_bucket"
    rows = df.withColumn(b, _bucket(ts_col, bucket_unit))
    wb = Window.partitionBy(*keys, b).orderBy(ts_col, tie_col).rowsBetween(Window.unboundedPreceding,
                                                                            Window.currentRow)
    rows = rows.withColumn("_rs_in", F.sum(value_col).over(wb))
    totals = rows.groupBy(*keys, b).agg(F.sum(value_col).alias("_rs_tot"))
    wk = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_rs_before", F.coalesce(F.sum("_rs_tot").over(wk), F.lit(0))).drop("_rs_tot")
    out = rows.join(totals, [*keys, b], "left")
    return out.withColumn(out_col, F.col("_rs_in") + F.col("_rs_before")).drop(b, "_rs_in", "_rs_before")

